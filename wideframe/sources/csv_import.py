"""CSV import: types from the whole of every file, union by header name, checked conversions, then one write.

Files are read as text columns on the executors; one aggregate for each file counts, per column, which kinds of value
there are. The driver sees those counts, merges the schemas, and plans the casts.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import inexact, split_nanos
from ..operators.stats import _name
from ..session import ship
from ..types import NANOS, TableError
from . import files
from .sink import required

#: Kinds of value in the order in which they are tried. Timestamps have 0, 3, 6 or 9 digits below a second.
_STAMP = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d"
_ZONE = r"([Zz]|[+-]\d\d:?\d\d)?$"
PATTERNS = (
    ("bool", r"(?i)^(true|false)$"),
    ("int", r"^-?\d+$"),
    ("float", r"(?i)^-?((\d*\.\d+|\d+\.\d*)(e[-+]?\d+)?|\d+e[-+]?\d+|nan|inf|infinity)$"),
    ("date", r"^\d{4}-\d\d-\d\d$"),
    ("s", _STAMP + _ZONE),
    ("ms", _STAMP + r"\.\d{1,3}" + _ZONE),
    ("us", _STAMP + r"\.\d{4,6}" + _ZONE),
    ("ns", _STAMP + r"\.\d{7,9}" + _ZONE),
)
UNITS = ("s", "ms", "us", "ns")


@dataclass
class Dialect:
    delimiter: str = ","
    quote: str = '"'
    escape: str | None = None
    no_header: bool = False
    header: str | None = None
    skip_lines: int = 0

    def check(self) -> None:
        for name, v in (("delimiter", self.delimiter), ("quote", self.quote), ("escape", self.escape)):
            if v is not None and len(v.encode()) != 1:
                raise TableError(f"{name} must be one byte")
        if self.no_header and self.header is not None:
            raise TableError("no_header and header exclude each other")


@dataclass
class Field:
    """kind: null, bool, int, float, date, s, ms, us, ns or text."""

    name: str
    kind: str
    nullable: bool = True


@dataclass
class Source:
    path: str
    df: DataFrame
    fields: list[Field] = field(default_factory=list)


def _header(spark: SparkSession, path: str, d: Dialect) -> tuple[list[str] | None, int]:
    """(column names or None, lines before the data), from the first lines of the file."""
    first = [r[0] for r in spark.read.text(path).limit(d.skip_lines + 1).collect()]
    record = first[d.skip_lines] if len(first) > d.skip_lines else None
    if d.header is not None:
        rows = list(csv.reader(io.StringIO(d.header), delimiter=d.delimiter, quotechar=d.quote))
        if len(rows) != 1:
            raise TableError("the header must be exactly one record")
        return rows[0], d.skip_lines
    if record is None or not record:
        return None, d.skip_lines
    escape = d.escape
    cells = next(csv.reader([record], delimiter=d.delimiter, quotechar=d.quote, escapechar=escape, doublequote=escape is None))
    if d.no_header:
        return [f"field_{k}" for k in range(len(cells))], d.skip_lines
    return cells, d.skip_lines + 1


def check_header(names: list[str]) -> None:
    seen = set()
    for n in names:
        if not n:
            raise TableError("CSV header has an empty column name")
        if n in seen:
            raise TableError(f"column '{n}' is in the CSV header twice")
        seen.add(n)


@contextmanager
def readable(path: str) -> Iterator[None]:
    """What Spark, or a task of ours, finds wrong with a file's records is an error of the table."""
    try:
        yield
    except (PySparkException, Py4JError) as e:
        if "MALFORMED" in str(e).upper():
            raise TableError(f"{path}: a record is damaged or has another number of fields than the header") from e
        raise


def spans_lines(spark: SparkSession, path: str, d: Dialect) -> bool:
    """Whether a quoted value may go over a line's end: a line that opens one has an odd number of quotes."""
    quotes = F.col("value")
    if d.escape and d.escape != d.quote:
        quotes = F.regexp_replace(quotes, re.escape(d.escape) + ".", "")
    kept = F.length(F.regexp_replace(quotes, "[^" + re.escape(d.quote) + "]", ""))
    return not spark.read.text(path).where(F.contains("value", F.lit(d.quote))).where(kept % 2 == 1).isEmpty()


def _records(text: str, d: Dialect, skip: int) -> Iterator[list[str]]:
    """Of a file's whole text, without its first lines."""
    lines = io.StringIO(text, newline="")
    for _ in range(skip):
        lines.readline()
    yield from csv.reader(
        lines, delimiter=d.delimiter, quotechar=d.quote, escapechar=d.escape, doublequote=d.escape is None, strict=True
    )


def read_strings(spark: SparkSession, path: str, d: Dialect) -> tuple[DataFrame, bool] | None:
    """(all columns as text, empty values null; whether there are rows), or None for a file without content.

    A file is read in parts, line by line, unless a quoted value may hold a line's end; then one task reads the file.
    """
    names, skip = _header(spark, path, d)
    if names is None:
        return None
    reader = (
        spark.read.schema(T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names))]))
        .option("sep", d.delimiter)
        .option("quote", d.quote)
        .option("escape", d.escape or d.quote)
        .option("mode", "FAILFAST")
        .option("enforceSchema", "true")
        .option("maxCharsPerColumn", "-1")
    )
    whole = spans_lines(spark, path, d)
    if whole:
        reader = reader.option("multiLine", "true")
    if skip == 0:
        df = reader.csv(path)
    elif skip == 1 and d.header is None and not d.no_header:
        df = reader.option("header", "true").csv(path)
    elif whole:
        df = _whole_file(spark, path, d, skip, len(names))
    else:  # lines of one file keep their order within its parts: the first ones are in the first part
        lines = spark.read.text(path).withColumn("part", F.spark_partition_id()).withColumn("n", F.monotonically_increasing_id())
        kept = lines.where((F.col("part") > 0) | (F.col("n") >= skip)).select("value")
        parsed = F.from_csv(
            "value",
            ", ".join(f"c{k} string" for k in range(len(names))),
            {"sep": d.delimiter, "quote": d.quote, "escape": d.escape or d.quote, "mode": "FAILFAST"},
        )
        df = kept.where("value <> ''").select(parsed.alias("r")).select("r.*")
    with readable(path):
        some = not df.isEmpty()
    if some or d.header is not None or d.no_header:
        check_header(names)
    return df.toDF(*[f"c{k}" for k in range(len(names))]).withColumnsRenamed({f"c{k}": n for k, n in enumerate(names)}), some


def _whole_file(spark: SparkSession, path: str, d: Dialect, skip: int, width: int) -> DataFrame:
    """The records of a file with lines to skip and values that go over lines, read by one task."""

    def parse(content: bytes) -> list[list[str | None]]:
        csv.field_size_limit((1 << 31) - 1)
        try:
            found = [r for r in _records(content.decode("utf-8", "replace"), d, skip) if r]
        except csv.Error as e:
            raise ValueError(f"MALFORMED record: {e}") from e
        for record in found:
            if len(record) != width:
                raise ValueError(f"MALFORMED record: {len(record)} fields, not {width}")
        return [[x or None for x in record] for record in found]

    ship(spark)
    rows = F.udf(parse, T.ArrayType(T.ArrayType(T.StringType())))
    read = spark.read.format("binaryFile").load(path).select(F.explode(rows("content")).alias("r"))
    return read.select(*[F.col("r")[k].alias(f"c{k}") for k in range(width)])


def infer(df: DataFrame) -> list[Field]:
    """Kinds over all rows, in one aggregate."""
    aggs = []
    for k, n in enumerate(df.columns):
        c = _name(n)
        kind = F.when(c.isNull(), "null")
        for name, pattern in PATTERNS:
            kind = kind.when(F.rlike(c, F.lit(pattern)), name)
        wide = F.rlike(c, F.lit(r"^-?\d+$")) & c.try_cast("bigint").isNull()
        aggs += [F.collect_set(kind.otherwise("text")).alias(f"k{k}"), F.bool_or(wide).alias(f"w{k}"), F.count_if(c.isNull()).alias(f"n{k}")]
    row = df.agg(*aggs).first()
    out = []
    for k, n in enumerate(df.columns):
        kinds = set(row[f"k{k}"]) - {"null"}
        if row[f"w{k}"] and "int" in kinds:
            kinds = kinds - {"int"} | {"float"}
        out.append(Field(n, _join(kinds), True))
    return out


def _join(kinds: set[str]) -> str:
    if not kinds:
        return "null"
    if len(kinds) == 1:
        return kinds.pop()
    if kinds == {"int", "float"}:
        return "float"
    if kinds <= {*UNITS, "date"} and kinds & {*UNITS}:
        return max((k for k in kinds if k in UNITS), key=UNITS.index)
    return "text"


def merge_kinds(name: str, a: str, b: str) -> str:
    """Equal; null with any; int with float; timestamps to the finer unit, dates with them; else an error."""
    if a == b or b == "null":
        return a
    if a == "null":
        return b
    if {a, b} == {"int", "float"}:
        return "float"
    if a in UNITS and b in UNITS:
        return max(a, b, key=UNITS.index)
    if {a, b} <= {"date", *UNITS}:
        return b if a == "date" else a
    raise TableError(f"incompatible types for field '{name}': {a} and {b}")


def merge_fields(shards: list[list[Field]]) -> list[Field]:
    """By name, in the order first seen; a field that some shard lacks is nullable."""
    out: dict[str, Field] = {}
    for k, fields in enumerate(shards):
        here = {f.name: f for f in fields}
        if k and not out.keys() & here.keys():
            raise TableError("incompatible CSV headers: no field in common")
        for n, f in here.items():
            if n in out:
                out[n] = Field(n, merge_kinds(n, out[n].kind, f.kind), out[n].nullable or f.nullable)
            else:
                out[n] = Field(n, f.kind, True if k else f.nullable)
        for n in out.keys() - here.keys():
            out[n].nullable = True
    return list(out.values())


def spark_type(kind: str) -> T.DataType:
    return {
        "null": T.StringType(),
        "text": T.StringType(),
        "bool": T.BooleanType(),
        "int": T.LongType(),
        "float": T.DoubleType(),
        "date": T.DateType(),
        "s": T.TimestampNTZType(),
        "ms": T.TimestampNTZType(),
        "us": T.TimestampNTZType(),
        "ns": NANOS,
    }[kind]


def _stamp(c: Column) -> Column:
    """Whole seconds; a date alone is its midnight."""
    own = F.replace(F.substring(c, 1, 19), F.lit("T"), F.lit(" "))
    full = F.when(F.length(c) == 10, F.concat(own, F.lit(" 00:00:00"))).otherwise(own)
    return F.try_to_timestamp(full, F.lit("yyyy-MM-dd HH:mm:ss"))


def convert(c: Column, kind: str) -> Column:
    if kind in ("text", "null"):
        return c
    if kind == "ns":
        seconds = F.unix_seconds(_stamp(c))
        below = F.rpad(F.regexp_extract(c, r"\.(\d{1,9})", 1), 9, "0").cast("bigint")
        ns = seconds * F.lit(1_000_000_000) + F.coalesce(below, F.lit(0))
        return F.when(c.isNotNull(), split_nanos(ns))
    if kind in UNITS:
        micros = F.coalesce(F.rpad(F.regexp_extract(c, r"\.(\d{1,6})", 1), 6, "0").cast("bigint"), F.lit(0))
        return F.timestamp_micros(F.unix_micros(_stamp(c)) + micros).cast("timestamp_ntz")
    return c.try_cast(spark_type(kind))


def problems(df: DataFrame, fields: list[Field]) -> DataFrame | None:
    """Counts, over all rows, of values that the merged types cannot hold without loss."""
    aggs = []
    for k, f in enumerate(fields):
        if f.name not in df.columns:
            continue
        c = _name(f.name)
        if f.kind == "float":
            v = c.try_cast("double")
            token = F.rlike(c, F.lit(r"(?i)^-?(nan|inf|infinity)$"))
            aggs += [
                F.count_if(inexact(c)).alias(f"{k}:would change if it were held as Float64"),
                F.count_if(token).alias(f"{k}:is not finite"),
                F.count_if(~token & (F.abs(v) == float("inf"))).alias(f"{k}:is out of range for Float64"),
                F.count_if(c.isNotNull() & v.isNull()).alias(f"{k}:is no number"),
            ]
        elif f.kind in UNITS:
            zone = F.rlike(c, F.lit(r"([Zz]|[+-]\d\d:?\d\d)$")) & (F.length(c) > 19)
            aggs += [
                F.count_if(zone).alias(f"{k}:must not include a timezone"),
                F.count_if(c.isNotNull() & _stamp(c).isNull()).alias(f"{k}:is no timestamp"),
            ]
        elif f.kind in ("int", "bool", "date"):
            aggs.append(F.count_if(c.isNotNull() & c.try_cast(spark_type(f.kind)).isNull()).alias(f"{k}:is no {f.kind}"))
    return df.agg(*aggs) if aggs else None


def import_csv(
    spark: SparkSession, paths: list[str], dialect: Dialect = Dialect(), require: list[str] = (), legacy: bool = False
) -> DataFrame:
    """The union of the files by header name (by position without headers), with inferred, merged, checked types.

    Files without rows are skipped; if none has rows it is an error (legacy: an empty table).
    """
    dialect.check()
    files.require_regular(spark, list(paths))
    sources = []
    for p in paths:
        found = read_strings(spark, p, dialect)
        if found is not None and (found[1] or (legacy and len(paths) == 1)):
            with readable(p):
                sources.append(Source(p, found[0], infer(found[0])))
    if not sources:
        if legacy and len(paths) == 1:
            return spark.createDataFrame([], T.StructType([]))
        raise TableError("no CSV data in the inputs")
    widths = {len(s.fields) for s in sources}
    if dialect.no_header and len(widths) > 1:
        raise TableError("CSV files without headers must have the same number of fields")
    fields = merge_fields([s.fields for s in sources])
    by_name = {f.name: f for f in fields}
    for n in require:
        if n not in by_name:
            raise TableError(f"required field '{n}' is not in any header")
        by_name[n].nullable = False
    out = None
    for s in sources:
        counted = problems(s.df, fields)
        for label, n in (counted.first().asDict() if counted else {}).items():
            if n:
                k, _, what = label.partition(":")
                raise TableError(f"{s.path}: a value of field '{fields[int(k)].name}' {what}")
        here = {f.name for f in s.fields}
        missing = [f.name for f in fields if not f.nullable and f.name not in here]
        if missing:
            raise TableError(f"{s.path}: required field '{missing[0]}' is missing")
        columns = [
            (convert(_name(f.name), f.kind) if f.name in here else F.lit(None)).cast(spark_type(f.kind)).alias(f.name, metadata={"unit": f.kind} if f.kind in UNITS else {})
            for f in fields
        ]
        part = s.df.select(*columns)
        out = part if out is None else out.union(part)
    return required(out, list(require)) if require else out
