"""ARRAY and MAP columns, shredded to lengths and child values, and put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import TableError, is_nested
from .stats import _name

AT = "array<int>"


def physical_columns(name: str, t: T.DataType) -> list[tuple[str, T.DataType]]:
    """The columns that a column becomes, depth first, a map's keys before its values."""
    if isinstance(t, T.ArrayType):
        return [(name, T.IntegerType()), *physical_columns(f"{name}.element", t.elementType)]
    if isinstance(t, T.MapType):
        keys = physical_columns(f"{name}.key", t.keyType)
        return [(name, T.IntegerType()), *keys, *physical_columns(f"{name}.value", t.valueType)]
    return [(name, t)]


def lengths(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, length): null for a null value, which differs from an empty one."""
    c = _name(column)
    size = F.when(c.isNotNull(), F.size(c))
    return df.select(key, size.alias("length"))


def flatten(df: DataFrame, key: str, column: str) -> DataFrame:
    """Child values of one column: (key, pos, element) of an array, (key, pos, key_, value) of a map, in order."""
    t = df.schema[column].dataType
    if isinstance(t, T.ArrayType):
        return df.select(key, F.posexplode(_name(column)).alias("pos", "element"))
    if isinstance(t, T.MapType):
        pairs = df.select(key, F.posexplode(F.map_entries(_name(column))).alias("pos", "e"))
        return pairs.select(key, "pos", F.col("e.key").alias("map_key"), F.col("e.value").alias("map_value"))
    raise TableError(f"column '{column}' is not nested")


def reassemble(sizes: DataFrame, children: DataFrame, key: str, column: str) -> DataFrame:
    """(key, column) from lengths and child values; empty and null values come back as they were."""
    is_map = "map_key" in children.columns
    child = ("pos", "map_key", "map_value") if is_map else ("pos", "element")
    lists = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*child))).alias("c"))
    if is_map:
        values = F.map_from_arrays(F.col("c.map_key"), F.col("c.map_value"))
        kt, vt = (children.schema[n].dataType.simpleString() for n in child[1:])
        empty = F.map_from_arrays(F.array().cast(f"array<{kt}>"), F.array().cast(f"array<{vt}>"))
    else:
        values = F.col("c.element")
        empty = F.array().cast(f"array<{children.schema['element'].dataType.simpleString()}>")
    whole = F.when(F.col("length").isNull(), F.lit(None)).when(F.col("length") == 0, empty).otherwise(values)
    return sizes.join(lists, key, "left").select(key, whole.alias(column))


# Columns of any depth. A physical column is a table (key, at, value): `at` is the path of positions that leads to the
# value, empty for the column itself. Lengths of null values are null; children of null values do not exist.


def _children(t: T.DataType, name: str) -> list[tuple[str, T.DataType]]:
    if isinstance(t, T.ArrayType):
        return [(f"{name}.element", t.elementType)]
    return [(f"{name}.key", t.keyType), (f"{name}.value", t.valueType)]


def shred(df: DataFrame, key: str, column: str) -> dict[str, DataFrame]:
    """The physical columns of a column of any depth, by name in the order of physical_columns."""
    out: dict[str, DataFrame] = {}

    def walk(rows: DataFrame, name: str, t: T.DataType) -> None:
        if not is_nested(t):
            out[name] = rows
            return
        out[name] = rows.select("key", "at", F.when(F.col("value").isNotNull(), F.size("value")).alias("value"))
        for k, (child, own) in enumerate(_children(t, name)):
            parts = F.col("value") if isinstance(t, T.ArrayType) else (F.map_values if k else F.map_keys)(F.col("value"))
            each = rows.select("key", "at", F.posexplode(parts).alias("pos", "value"))
            walk(each.select("key", F.concat("at", F.array("pos")).alias("at"), "value"), child, own)

    rows = df.select(F.col(key).alias("key"), F.array().cast(AT).alias("at"), _name(column).alias("value"))
    walk(rows, column, df.schema[column].dataType)
    return out


def gather(parts: dict[str, DataFrame], key: str, column: str, t: T.DataType) -> DataFrame:
    """(key, column) from what `shred` made, innermost values first; null, empty and nested values come back as they were."""

    def build(name: str, t: T.DataType) -> DataFrame:
        if not is_nested(t):
            return parts[name]
        found = parts[name].withColumnRenamed("value", "length")
        lists = []
        for k, (child, own) in enumerate(_children(t, name)):
            each = build(child, own).select(
                "key",
                F.slice("at", F.lit(1), F.size("at") - 1).alias("at"),
                F.struct(F.element_at("at", -1).alias("pos"), "value").alias("p"),
            )
            lists.append(each.groupBy("key", "at").agg(F.collect_list("p").alias(f"v{k}")))
        for each in lists:
            found = found.join(each, ["key", "at"], "left")

        def held(k: int, own: T.DataType) -> Column:
            # Positions are whole and from 0; values need no order of their own, as map values have none.
            inner = F.array_sort(F.col(f"v{k}"), lambda a, b: a["pos"] - b["pos"])
            return F.coalesce(F.transform(inner, lambda p: p["value"]), F.array().cast(T.ArrayType(own)))

        kinds = [own for _, own in _children(t, name)]
        made = held(0, kinds[0]) if len(kinds) == 1 else F.map_from_arrays(held(0, kinds[0]), held(1, kinds[1]))
        return found.select("key", "at", F.when(F.col("length").isNotNull(), made).alias("value"))

    return build(column, t).select(F.col("key").alias(key), F.col("value").alias(column))
