"""Rows as text: columnar text JSON, NDJSON, aligned tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.stats import ROW_GROUP, _name
from ..types import INTEGERS, TableError, is_nanos, is_nested, type_name
from .scalars import hex_bytes, json_string, number_text, strip_control

TEXT_TYPES = (*INTEGERS, T.DoubleType, T.DecimalType, T.StringType)


def text_json_support(df: DataFrame, row_group: str = ROW_GROUP, max_doubles: int | None = None) -> DataFrame:
    """(row_group, supported): not if a column that has values is of another type, or a double is not finite.

    max_doubles: also not if a column has more distinct doubles than that outside 1e-6 to 1e9, which other writers
    must format by the JVM one by one; this one needs no such limit.
    """
    columns = [f for f in df.schema if f.name != row_group]
    bad = [F.lit(not columns)]
    for f in columns:
        c = _name(f.name)
        if isinstance(f.dataType, T.DoubleType):
            bad.append(F.bool_or(c.isNotNull() & (F.isnan(c) | (F.abs(c) == float("inf")))))
            if max_doubles is not None:
                rare = F.when((F.abs(c) < 1e-6) | (F.abs(c) > 1e9), c)
                bad.append(F.count_distinct(rare) > max_doubles)
        elif is_nested(f.dataType):
            bad.append(F.lit(True))
        elif not isinstance(f.dataType, TEXT_TYPES):
            bad.append(F.count(c) > 0)
    flags = [b.alias(f"b{k}") for k, b in enumerate(bad)]
    found = df.groupBy(row_group).agg(F.count("*").alias("rows"), *flags)
    any_bad = F.lit(False)
    for k in range(len(bad)):
        any_bad = any_bad | F.coalesce(F.col(f"b{k}"), F.lit(False))
    return found.select(row_group, (~any_bad).alias("supported"))


def text_json(df: DataFrame, position: str, row_group: str = ROW_GROUP, columns: list[str] | None = None) -> DataFrame:
    """(row_group, supported, line): one JSON object, each column its values joined by commas, nulls as empty.

    Unsupported row groups have a null line. A line holds its row group, so row groups bound the memory.
    """
    columns = columns or [n for n in df.columns if n not in (row_group, position)]
    for n in columns:
        if n not in df.columns:
            raise TableError(f"unknown column '{n}'")
    flat = {n: k for k, n in enumerate(columns) if not is_nested(df.schema[n].dataType)}
    row = [F.coalesce(_name(n).cast("string"), F.lit("")).alias(f"c{k}") for n, k in flat.items()]
    # One sorted list of rows for all columns.
    lines = df.groupBy(row_group).agg(
        F.sort_array(F.collect_list(F.struct(_name(position).alias("p"), *row))).alias("rows")
    )
    members = [
        F.concat(
            F.lit('"'),
            json_string(F.lit(n)),
            F.lit('":"'),
            json_string(F.array_join(F.col(f"rows.c{flat[n]}"), ",") if n in flat else F.lit("")),
            F.lit('"'),
        )
        for n in columns
    ]
    line = F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))
    ok = text_json_support(df.select(row_group, *[_name(n) for n in columns]), row_group)
    made = lines.select(row_group, line.alias("line")).join(ok, row_group)
    return made.select(row_group, "supported", F.when(F.col("supported"), F.col("line")).alias("line"))


def _json_value(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.FloatType):
        v = number_text(c.cast("string").cast("double"))
    elif isinstance(t, T.DoubleType):
        v = number_text(c)
    elif isinstance(t, (*INTEGERS, T.DecimalType, T.BooleanType)):
        v = c.cast("string")
    elif isinstance(t, T.BinaryType):
        v = F.concat(F.lit('"'), hex_bytes(c), F.lit('"'))
    elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        v = F.concat(F.lit('"'), F.replace(c.cast("string"), F.lit(" "), F.lit("T")), F.lit('"'))
    elif isinstance(t, T.ArrayType):
        v = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: _json_value(x, t.elementType)), ","), F.lit("]"))
    elif isinstance(t, T.MapType):
        pairs = F.transform(
            F.map_entries(c),
            lambda e: F.concat(
                F.lit('"'), json_string(e["key"].cast("string")), F.lit('":'), _json_value(e["value"], t.valueType)
            ),
        )
        v = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    else:
        v = F.concat(F.lit('"'), json_string(c.cast("string")), F.lit('"'))
    return F.coalesce(v, F.lit("null"))


def ndjson(df: DataFrame, to: str = "line") -> DataFrame:
    """One JSON object a row, nulls written out; doubles that are not finite are null."""
    members = [
        F.concat(F.lit('"'), json_string(F.lit(f.name)), F.lit('":'), _json_value(_name(f.name), f.dataType))
        for f in df.schema
    ]
    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}")).alias(to))


def cells(df: DataFrame) -> DataFrame:
    """Every column as the text of a table cell: nulls empty, control characters replaced, other types by name."""
    out = []
    for f in df.schema:
        c = _name(f.name)
        if is_nested(f.dataType) or is_nanos(f.dataType) or isinstance(f.dataType, T.StructType):
            text = F.lit(f"<{type_name(f.dataType)}>")
        elif isinstance(f.dataType, T.BinaryType):
            text = hex_bytes(c)
        else:
            text = strip_control(c.cast("string"))
        out.append(F.coalesce(F.when(c.isNotNull(), text), F.lit("")).alias(f.name))
    return df.select(*out)


def table_lines(df: DataFrame, max_rows: int | None = None) -> Iterator[str]:
    """The lines of an aligned table, for a terminal; of all rows, or of the first max_rows.

    Without max_rows an aggregate finds the columns' widths, then the driver holds one partition's rows at a time.
    """
    shown = cells(df).toDF(*[f"c{k}" for k in range(len(df.columns))])
    heads = ["".join("\ufffd" if ord(ch) < 32 or 127 <= ord(ch) < 160 else ch for ch in n) for n in df.columns]
    if max_rows is not None:
        rows = [list(r) for r in shown.limit(max_rows).collect()]
        some, widths = len(rows), [max([len(h), *(len(r[k]) for r in rows)]) for k, h in enumerate(heads)]
    else:
        longest = [F.coalesce(F.max(F.length(c)), F.lit(0)) for c in shown.columns]
        some, *found = shown.agg(F.count("*"), *longest).first()
        rows, widths = shown.toLocalIterator(), [max(len(h), n) for h, n in zip(heads, found, strict=True)]
    if not some:
        yield "(no rows)\n"
        return

    def line(cells_) -> str:
        return "|" + "".join(f" {x:<{w}} |" for x, w in zip(cells_, widths, strict=True)) + "\n"

    rule = "+" + "".join("-" * (w + 2) + "+" for w in widths) + "\n"
    yield rule + line(heads) + rule
    for r in rows:
        yield line(r)
    yield rule


def table_text(df: DataFrame, max_rows: int) -> str:
    return "".join(table_lines(df, max_rows))
