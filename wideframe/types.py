"""Which column types a wide table holds, their widths, and which have statistics."""

from __future__ import annotations

from pyspark.sql import types as T


class TableError(ValueError):
    """A schema, predicate, import or write that the engine refuses."""


#: Bytes of a fixed-width value as it is stored; 0 is not used: variable widths have no entry.
WIDTHS = {
    T.BooleanType: 1,
    T.ByteType: 1,
    T.ShortType: 2,
    T.IntegerType: 4,
    T.LongType: 8,
    T.FloatType: 4,
    T.DoubleType: 8,
    T.DateType: 4,
    T.TimestampType: 8,
    T.TimestampNTZType: 8,
    T.TimeType: 4,
}
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Nanosecond timestamps: milliseconds since the epoch, and nanoseconds of the millisecond.
NANOS = T.StructType([T.StructField("millis", T.LongType()), T.StructField("nanos_of_milli", T.IntegerType())])
NANOS_WIDTH = 12


def is_nanos(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and [(f.name, f.dataType) for f in t] == [(f.name, f.dataType) for f in NANOS]


def width(t: T.DataType) -> int | None:
    """Bytes of a value, None if they vary."""
    if isinstance(t, T.DecimalType):
        return 8 if t.precision <= 18 else None
    if is_nanos(t):
        return NANOS_WIDTH
    return WIDTHS.get(type(t))


def is_nested(t: T.DataType) -> bool:
    return isinstance(t, (T.ArrayType, T.MapType))


def has_stats(t: T.DataType) -> bool:
    return width(t) is not None or isinstance(t, T.StringType)


def check_type(t: T.DataType, inside_array: bool = False) -> None:
    if isinstance(t, T.ArrayType):
        check_type(t.elementType, True)
    elif isinstance(t, T.MapType):
        if is_nested(t.keyType):
            raise TableError(f"unsupported map key type {t.keyType.simpleString()}")
        check_type(t.keyType)
        check_type(t.valueType)
    elif is_nanos(t):
        if inside_array:
            raise TableError("unsupported type: array of nanosecond timestamps")
    elif isinstance(t, T.DecimalType):
        if t.scale < 0:
            raise TableError(f"unsupported type {t.simpleString()}")
    elif not isinstance(t, (T.StringType, T.BinaryType, *WIDTHS)):
        raise TableError(f"unsupported type {t.simpleString()}")


def check_schema(schema: T.StructType) -> None:
    """Empty and repeated names (exact bytes count), and types that are not held, are refused."""
    seen: set[str] = set()
    for f in schema:
        if not f.name:
            raise TableError("empty column name")
        if f.name in seen:
            raise TableError(f"duplicate column name '{f.name}'")
        seen.add(f.name)
        check_type(f.dataType)


def check_stats_columns(schema: T.StructType, names: list[str]) -> list[str]:
    """The columns to take statistics of, in schema order."""
    for n in names:
        if n not in schema.names:
            raise TableError(f"unknown statistics column '{n}'")
        if not has_stats(schema[n].dataType):
            raise TableError(f"statistics are not supported for '{n}' of type {schema[n].dataType.simpleString()}")
    return [n for n in schema.names if n in set(names)]


#: How reports name types.
_NAMES = {
    T.BooleanType: "Boolean",
    T.ByteType: "Int8",
    T.ShortType: "Int16",
    T.IntegerType: "Int32",
    T.LongType: "Int64",
    T.FloatType: "Float32",
    T.DoubleType: "Float64",
    T.DateType: "Date32",
    T.StringType: "Utf8",
    T.BinaryType: "Binary",
    T.TimeType: "Time32(ms)",
    T.TimestampNTZType: "Timestamp(us)",
    T.TimestampType: "Timestamp(us, UTC)",
}


def type_name(t: T.DataType) -> str:
    if isinstance(t, T.DecimalType):
        return f"Decimal128({t.precision}, {t.scale})"
    if isinstance(t, T.ArrayType):
        return f"List({type_name(t.elementType)})"
    if isinstance(t, T.MapType):
        return f"Map({type_name(t.keyType)}, {type_name(t.valueType)})"
    return "Timestamp(ns)" if is_nanos(t) else _NAMES[type(t)]
