"""The physical layout as queryable metadata: buckets, encodings, dictionaries, sizes, row-group splits.

These are aggregates over the rows, so they run distributed and need no stored file.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.scalars import floor_div
from ..types import INTEGERS, TableError, check_schema, is_nanos, is_nested, type_name, width
from .facts import column_facts
from .stats import ROW_GROUP, _name


#: Of the folder layout that `sources.sink` writes.
VERSION = 1


@dataclass(frozen=True)
class Options:
    compression: str = "zstd"
    zstd_level: int = 1
    num_buckets: int = 100
    row_group_max_size: int = 256 << 20
    max_dict_total_bytes: int = 32 << 10
    max_dict_entries: int = 255
    stats_columns: tuple[str, ...] = ()
    page_size_threshold: int = 32 << 10

    def buckets(self, columns: int) -> int:
        return max(1, min(self.num_buckets or 100, columns))


def bucket_of(schema: T.StructType, options: Options = Options()) -> dict[str, int]:
    """Columns sorted by name as UTF-8 bytes fall into even, contiguous buckets."""
    names = sorted(schema.names, key=lambda n: n.encode("utf-8", "surrogatepass"))
    n = options.buckets(len(names))
    return {c: k * n // len(names) for k, c in enumerate(names)}


def schema_report(spark: SparkSession, schema: T.StructType, options: Options = Options()) -> DataFrame:
    """position, name, type, nullable, bucket, in the schema's order."""
    check_schema(schema)
    at = bucket_of(schema, options)
    rows = [(k, f.name, type_name(f.dataType), f.nullable, at[f.name]) for k, f in enumerate(schema)]
    return spark.createDataFrame(rows, "position int, name string, type string, nullable boolean, bucket int")


def varint_size(n: Column) -> Column:
    out = F.lit(5)
    for size in (4, 3, 2, 1):
        out = F.when(n < F.lit(1 << 7 * size), F.lit(size)).otherwise(out)
    return out


def index_bits(n: Column) -> Column:
    """Bits of a dictionary index of n entries: the least b with 2**b >= n."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(F.lit(0)).cast("long")


def value_size(c: Column, t: T.DataType) -> Column:
    """Bytes of a value as it is stored: its width, or its length with a prefix; of a null, null."""
    w = width(t)
    if w is not None:
        return F.when(c.isNotNull(), F.lit(w)).cast("long")
    if isinstance(t, T.DecimalType):  # two's complement, as few bytes as hold it
        unscaled = F.abs(c.cast(T.DecimalType(38, t.scale)) * F.lit(10).cast("decimal(38,0)") ** t.scale)
        n = F.floor(F.log2(F.greatest(unscaled.cast("double"), F.lit(1.0))) / 8 + 1.125).cast("long")
    else:
        n = F.octet_length(c).cast("long")
    return varint_size(n).cast("long") + n


def _value_key(c: Column, t: T.DataType) -> Column:
    """Equal exactly where the stored bytes are: 0.0 and -0.0 differ. NaN payloads are not told apart."""
    if isinstance(t, T.BinaryType):
        return F.hex(c)
    return F.to_json(F.struct(c)) if is_nanos(t) else c.cast("string")


def _columns(df: DataFrame, columns: list[str] | None, row_group: str) -> list[str]:
    return columns if columns is not None else [n for n in df.columns if n != row_group]


def _dict_bytes() -> Column:
    n = F.col("distinct")
    return varint_size(n) + F.col("entry_bytes") + F.ceil(F.col("non_null") * index_bits(n) / F.lit(8))


def _fits(short: Column, options: Options) -> Column:
    """Whether distinct, non_null, entry_bytes and plain_bytes make a dictionary; null where values were not all counted."""
    limits = (F.col("distinct") <= options.max_dict_entries) & (short | (F.col("entry_bytes") <= options.max_dict_total_bytes))
    return limits & (_dict_bytes() < F.col("plain_bytes"))


def _physical(
    df: DataFrame, columns: list[str], options: Options, row_group: str, schema: T.StructType | None = None
) -> DataFrame:
    """(row_group, parent, child, bucket, and what `encodings` has) of the physical columns."""
    at = bucket_of(schema or T.StructType([f for f in df.schema if f.name != row_group]), options)
    most = max(1, options.max_dict_entries)
    facts = column_facts(df, columns, {n: at[n] for n in columns}, most, row_group)
    n = F.col("distinct")
    kind = (
        F.when(F.col("non_null") == 0, "ALL_NULL")
        .when(n == 1, "CONST")
        .when(_fits(F.col("short"), options), "DICT")
        .otherwise("PLAIN")
    )
    stored = (
        F.when(F.col("encoding") == "ALL_NULL", F.lit(0).cast("long"))
        .when(F.col("encoding") == "CONST", F.col("entry_bytes"))
        .when(F.col("encoding") == "DICT", F.col("dict_bytes"))
        .otherwise(F.col("plain_bytes"))
    )
    nulls = F.when(
        (F.col("encoding") != "ALL_NULL") & (F.col("non_null") < F.col("rows")), F.ceil(F.col("rows") / F.lit(8))
    ).otherwise(F.lit(0))
    return (
        facts.withColumn("dict_bytes", F.when(n.isNotNull(), _dict_bytes()).cast("long"))
        .withColumn("encoding", kind)
        .withColumn("has_nulls", F.col("non_null") < F.col("rows"))
        .withColumn("bytes", (stored + nulls).cast("long"))
    )


def encodings(
    df: DataFrame, columns: list[str] | None = None, options: Options = Options(), row_group: str = ROW_GROUP
) -> DataFrame:
    """(row_group, column, rows, non_null, distinct, plain_bytes, dict_bytes, encoding, has_nulls, bytes).

    A row for each physical column: an ARRAY or MAP is its lengths, under its own name, and its children, which are
    encoded by themselves (name.element, name.key, name.value). distinct and dict_bytes are null where there are more
    values than a dictionary may have: they are counted no further. An empty table gives no rows.
    """
    found = _physical(df, _columns(df, columns, row_group), options, row_group)
    return found.select(
        row_group, "column", "rows", "non_null", "distinct", "plain_bytes", "dict_bytes", "encoding", "has_nulls", "bytes"
    )


def _pages(physical: DataFrame, row_group: str) -> DataFrame:
    """Of each column: its own encoding, and the bytes and live pages of all that it consists of."""
    own = F.max(F.when(~F.col("child"), F.col("encoding")))
    live = F.count_if(F.col("encoding") != "ALL_NULL")
    return physical.groupBy(row_group, F.col("parent").alias("column"), "bucket").agg(
        own.alias("encoding"), F.sum("bytes").alias("bytes"), live.alias("live")
    )


def pages(
    df: DataFrame,
    columns: list[str] | None = None,
    options: Options = Options(),
    row_group: str = ROW_GROUP,
    schema: T.StructType | None = None,
) -> DataFrame:
    """(row_group, column, bucket, encoding, bytes): what each column takes by itself, before compression.

    Bytes of an ARRAY's or MAP's children count for the column; the encoding is that of its lengths. `schema` is the
    table's, for the buckets, where df has some of its columns only.
    """
    found = _physical(df, _columns(df, columns, row_group), options, row_group, schema)
    return _pages(found, row_group).select(row_group, "column", "bucket", "encoding", "bytes")


def _buckets(physical: DataFrame, options: Options, row_group: str) -> DataFrame:
    grouped = physical.groupBy(row_group, "bucket").agg(
        F.sum("bytes").alias("values"),
        F.count("*").alias("n"),
        F.count_if("child").alias("children"),
        F.coalesce(F.sum(F.when(F.col("child"), varint_size(F.col("rows")))), F.lit(0)).alias("child_rows"),
        F.count_if(F.col("encoding") != "ALL_NULL").alias("n_pages"),
        F.sort_array(F.collect_list(F.when(~F.col("child"), F.col("column")))).alias("columns"),
    )
    n, kids = F.col("n"), F.col("children")
    head = F.when(kids > 0, varint_size(n - kids) + varint_size(kids) + F.col("child_rows")).otherwise(F.lit(0))
    raw = F.col("values") + F.ceil(n * 2 / F.lit(8)) + F.ceil(n / F.lit(8)) + head
    # A page has two bytes of its own: encoding and flags.
    page_bytes = F.col("values") + 2 * F.col("n_pages")
    paged = F.lit(options.compression == "zstd") & (raw >= options.page_size_threshold)
    paged = paged & (F.floor(page_bytes / F.col("n_pages")) >= options.page_size_threshold)
    kind = F.when(F.col("n_pages") == 0, "Empty").when(paged, "Paged").otherwise("Monolithic")
    return grouped.select(row_group, "bucket", kind.alias("kind"), raw.cast("long").alias("bytes"), "columns")


def buckets(df: DataFrame, options: Options = Options(), row_group: str = ROW_GROUP) -> DataFrame:
    """(row_group, bucket, kind, bytes, columns): Paged if compressed, and the bucket and its mean page are large."""
    return _buckets(_physical(df, _columns(df, None, row_group), options, row_group), options, row_group)


def column_sizes(
    df: DataFrame, options: Options = Options(), row_group: str = ROW_GROUP, columns: list[str] | None = None
) -> DataFrame:
    """(column, bytes, approximate): a paged bucket's columns exactly, others' bytes split evenly over the bucket.

    Columns that share a bucket with the chosen ones are read too, since they share its bytes.
    """
    at = bucket_of(T.StructType([f for f in df.schema if f.name != row_group]), options)
    wanted = _columns(df, columns, row_group)
    near = {at[n] for n in wanted}
    physical = _physical(df, [n for n in at if at[n] in near], options, row_group)
    whole, own = _buckets(physical, options, row_group), _pages(physical, row_group)
    each = whole.select(row_group, "bucket", "kind", F.col("bytes").alias("total"), "columns")
    met = own.join(each, [row_group, "bucket"])
    nth = F.array_position("columns", F.col("column"))
    share = even_share(F.col("total"), F.size("columns"), nth)
    exact = (F.col("kind") == "Paged") | (F.size("columns") == 1)
    size = F.when(F.col("kind") == "Paged", F.col("bytes") + 2 * F.col("live")).when(F.col("kind") == "Empty", F.lit(0)).otherwise(share)
    found = met.groupBy("column").agg(F.sum(size).cast("long").alias("bytes"), F.bool_or(~exact).alias("approximate"))
    return found if columns is None else found.where(F.col("column").isin(columns))


def even_share(total: Column, n: Column, nth: Column) -> Column:
    """Of a total split over n: the first ones (nth from 1) get one more each."""
    return (floor_div(total, n) + F.when(nth <= total % n, 1).otherwise(0)).cast("long")


def dictionary(
    df: DataFrame, column: str, position: str, options: Options = Options(), row_group: str = ROW_GROUP, whole: bool = False
) -> DataFrame:
    """(row_group, nth, value) of the row groups where the column is DICT: its values as text, by first appearance.

    whole: of the table as if it were one row group, 0, which has the rows of the others in their order.
    """
    if column not in df.columns:
        raise TableError(f"unknown column '{column}'")
    if is_nested(df.schema[column].dataType):
        raise TableError(f"column '{column}' is nested and has no dictionary")
    t = df.schema[column].dataType
    values = (
        df.select(row_group, _value_key(_name(column), t).alias("value"), value_size(_name(column), t).alias("size"), _name(position).alias("at"))
        .where("value IS NOT NULL")
        .groupBy(row_group, "value")
        .agg(F.min("at").alias("at"), F.count("*").alias("n"), F.first("size").alias("size"))
    )
    if whole:
        first = F.min(F.struct(F.col(row_group).alias("group"), "at")).alias("at")
        values = values.groupBy("value").agg(first, F.sum("n").alias("n"), F.first("size").alias("size")).withColumn(row_group, F.lit(0))
    # Of each row group: whether its values make a dictionary. The values' exchange is the same for both uses.
    facts = values.groupBy(row_group).agg(
        F.count("*").alias("distinct"), F.sum("n").alias("non_null"), F.sum("size").alias("entry_bytes"), F.sum(F.col("n") * F.col("size")).alias("plain_bytes")
    )
    short = F.lit((width(t) or 99) <= 8)
    held = facts.where((F.col("distinct") > 1) & _fits(short, options)).select(row_group)
    # At most max_dict_entries rows of a row group remain here.
    nth = F.row_number().over(Window.partitionBy(row_group).orderBy("at", "value")) - 1
    return values.join(held, row_group, "left_semi").select(row_group, nth.alias("nth"), "value")


def encoded_values(
    df: DataFrame, column: str, position: str, options: Options = Options(), row_group: str = ROW_GROUP
) -> DataFrame:
    """(row_group, position, encoding, nth, value) of each row: what a reader of the encoded column sees.

    value is the printed one, null for a null. nth is the value's place in the dictionary where the column is DICT, 0
    where it is CONST; null for nulls and where values are stored plainly.
    """
    entries = dictionary(df, column, position, options, row_group)
    kinds = encodings(df, [column], options, row_group).select(row_group, "encoding")
    shown = _value_key(_name(column), df.schema[column].dataType)
    rows = df.select(row_group, _name(position).alias("position"), shown.alias("value")).join(kinds, row_group)
    nth = F.when((F.col("encoding") == "CONST") & F.col("value").isNotNull(), F.lit(0)).otherwise(F.col("nth"))
    return rows.join(entries, [row_group, "value"], "left").select(row_group, "position", "encoding", nth.alias("nth"), "value")


def integer_blocks(
    df: DataFrame, column: str, position: str, row_group: str = ROW_GROUP, block: int = 4096
) -> DataFrame:
    """(row_group, block, rows, bytes_each) of a whole-number column: the least of 1, 2, 4, 8 bytes that hold the values
    of each block of positions (from 0 in their row group); null where a block has nulls only. Decimals without a scale
    are whole numbers too; those that 8 bytes do not hold count as 8, the widest there is."""
    t = df.schema[column].dataType
    whole = isinstance(t, T.DecimalType) and t.scale == 0
    if not (whole or isinstance(t, INTEGERS)):
        raise TableError(f"column '{column}' has no whole numbers")
    v = _name(column) if whole else _name(column).cast("long")
    cut = df.select(row_group, floor_div(_name(position).cast("long"), F.lit(block).cast("long")).alias("block"), v.alias("v"))
    met = cut.groupBy(row_group, "block").agg(F.count("*").alias("rows"), F.min("v").alias("low"), F.max("v").alias("high"))
    each = F.lit(8)
    for n in (4, 2, 1):
        top = (1 << 8 * n - 1) - 1
        each = F.when((F.col("low") >= -top - 1) & (F.col("high") <= top), F.lit(n)).otherwise(each)
    return met.select(row_group, "block", "rows", F.when(F.col("low").isNotNull(), each).alias("bytes_each"))


def batch_bytes(df: DataFrame, batch: str, options: Options = Options()) -> DataFrame:
    """(batch, rows, bytes): what each append adds to the buffers, null bitmaps of each bucket included."""
    columns = [f for f in df.schema if f.name != batch]
    held = bucket_of(T.StructType(columns), options)
    members = [sum(b == k for b in held.values()) for k in sorted(set(held.values()))]
    flat = sum(-(-m // 8) for m in members)
    total = sum((F.coalesce(value_size(_name(f.name), f.dataType), F.lit(0)) for f in columns), F.lit(0))
    return df.groupBy(batch).agg(F.count("*").alias("rows"), F.sum(total + flat).cast("long").alias("bytes"))


def running_split(batches: DataFrame, batch: str, max_size: int) -> DataFrame:
    """(batch, rows, bytes, row_group): a row group closes with the batch that brings it to max_size or beyond.

    What closes a row group depends on all batches before it, so one task folds them in order; it reads a row for each
    append (three numbers), as batch_bytes gives them, and none of the table's rows.
    """
    kind = f"{batch} {batches.schema[batch].dataType.simpleString()}, rows long, bytes long, row_group long"

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, group = 0, 0
        for pdf in parts:
            groups = []
            for size in pdf["bytes"]:
                groups.append(group)
                held += size
                if held >= max_size:
                    held, group = 0, group + 1
            yield pdf.assign(row_group=groups)

    ordered = batches.select(batch, "rows", "bytes").repartition(1).sortWithinPartitions(batch)
    return ordered.mapInPandas(fold, kind)


def footer(spark: SparkSession, buckets_: int, row_groups: int, options: Options = Options()) -> DataFrame:
    """(format, version, buckets, row_groups, compression), one row."""
    kind = "format string, version int, buckets int, row_groups int, compression string"
    return spark.createDataFrame([("parquet", VERSION, buckets_, row_groups, options.compression)], kind)


def ratio_text(stored: Column, raw: Column) -> Column:
    """How many times smaller the stored bytes are, with two decimals; empty where either is unknown (0 or null)."""
    known = (stored > 0) & (raw > 0)
    return F.when(known, F.format_string("%.2fx", raw / stored)).otherwise("")


def estimated_size(written: int, buffered: int, ratio: float | None = None, compression: str = "zstd") -> int:
    """Bytes of a file if it were closed now: the ratio is a guess until a row group was measured."""
    guess = 0.3 if compression == "zstd" else 1.0
    return written + int(buffered * (guess if ratio is None else ratio)) + 1024
