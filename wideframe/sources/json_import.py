"""JSON import: one object a line, types from all lines, no number changed on the way.

The types come from Spark's own inference over the whole file. Numbers of fields that become Float64 are then read once
more as they are written, and those that a double cannot hold exactly, or at all, are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import inexact
from ..operators.stats import _name
from ..types import TableError, check_schema
from . import files

MAX_DEPTH = 128
SUFFIXES = (".json", ".ndjson", ".jsonl")
#: Number tokens that a double may not hold: 16 digits or more, an exponent, no digits at all.
DOUBTFUL = r"^[+-]?\d{16,}$|[eE]|Infinity"


def is_json(path: str) -> bool:
    return path.lower().endswith(SUFFIXES)


def column_list(given: list[str]) -> list[str]:
    """Of repeated options with comma lists; the first of equal names stays."""
    names = list(dict.fromkeys(n.strip() for g in given for n in g.split(",") if n.strip()))
    if given and not names:
        raise TableError("the column list is empty")
    return names


def _held(t: T.DataType) -> T.DataType:
    """As it is stored: whole numbers as bigint, wider ones and fractions as double."""
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_held(t.elementType), True)
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _held(f.dataType), True) for f in t])
    if isinstance(t, (T.IntegerType, T.LongType)):
        return T.LongType()
    return T.DoubleType() if isinstance(t, (T.DecimalType, T.FloatType, T.DoubleType)) else t


def _raw(t: T.DataType) -> T.DataType:
    """The same shape with numbers as text."""
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_raw(t.elementType), True)
    return T.StringType() if isinstance(t, T.DoubleType) else t


def _doubles(path: str, c: Column, t: T.DataType) -> Iterator[tuple[str, Column]]:
    """(path such as a[], its number tokens as an array)."""
    if isinstance(t, T.DoubleType):
        yield path, F.array(c)
    elif isinstance(t, T.ArrayType):
        flat, depth, inner = c, 0, t
        name = path
        while isinstance(inner, T.ArrayType):
            flat = F.flatten(F.filter(flat, lambda x: x.isNotNull())) if depth else flat
            inner, depth, name = inner.elementType, depth + 1, name + "[]"
        if isinstance(inner, T.DoubleType):
            yield name, flat


def problems(tokens: DataFrame, held: T.StructType) -> None:
    """Refuse fields without a value, and numbers that a double does not hold: two aggregates, however many fields there are.

    Only tokens that may be wrong leave their row: long ones, those with an exponent, and words.
    """
    seen = tokens.agg(*[F.count(_name(f.name)).alias(str(k)) for k, f in enumerate(held)]).first() if len(held) else ()
    for f, n in zip(held, seen, strict=True):
        if not n:
            raise TableError(f"field '{f.name}' has no value to take its type from")
    places = [p for f in held for p in _doubles(f.name, _name(f.name), f.dataType)]
    if not places:
        return
    doubtful = [
        F.transform(F.filter(values, lambda t: F.rlike(t, F.lit(DOUBTFUL))), lambda t, k=k: F.struct(F.lit(k).alias("k"), t.alias("t")))
        for k, (_, values) in enumerate(places)
    ]
    # Null arrays have no tokens; flatten would make the whole row null.
    none = F.array().cast("array<struct<k:int,t:string>>")
    each = tokens.select(F.explode(F.flatten(F.array(*[F.coalesce(d, none) for d in doubtful]))).alias("d")).select("d.k", "d.t")
    v = F.col("t").try_cast("double")
    beyond = (F.abs(v) == float("inf")) | F.rlike("t", F.lit('^"?-?Infinity"?$'))
    counted = each.groupBy("k").agg(F.count_if(inexact(F.col("t"))).alias("inexact"), F.count_if(beyond).alias("beyond"))
    for r in counted.where("inexact > 0 OR beyond > 0").orderBy("k").limit(1).collect():
        what = "would change if it were held as Float64" if r["inexact"] else "is out of range for Float64"
        raise TableError(f"a number of field '{places[r['k']][0]}' {what}")


def infer(lines: DataFrame, path: str) -> T.StructType:
    spark = lines.sparkSession
    try:
        return spark.read.option("mode", "FAILFAST").option("maxNestingDepth", str(MAX_DEPTH)).json(path).schema
    except Exception as e:
        raise TableError(f"'{path}' is not one JSON object a line: {str(e)[:300]}") from e


def import_json(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The rows, or `columns` of them in that order; fields that are not asked for are neither typed nor checked."""
    files.require_regular(spark, [path])
    names = column_list(columns) if columns is not None else None
    lines = spark.read.text(path).where("trim(value) <> ''")
    found = infer(lines, path)
    fields = {f.name: f for f in found}
    if names is None:
        first = lines.select(F.json_object_keys("value")).first()
        early = [n for n in (first[0] or []) if n in fields] if first else []
        names = early + [n for n in fields if n not in early]
    for n in names:
        if n not in fields:
            raise TableError(f"unknown column '{n}'")
    held = T.StructType([T.StructField(n, _held(fields[n].dataType), True) for n in names])
    raw = T.StructType([T.StructField(f.name, _raw(f.dataType), True) for f in held])
    options = {"mode": "FAILFAST", "maxNestingDepth": str(MAX_DEPTH)}
    tokens = lines.select(F.from_json("value", raw, options).alias("r")).select("r.*")
    problems(tokens, held)
    check_schema(held)
    return lines.select(F.from_json("value", held, options).alias("r")).select("r.*")
