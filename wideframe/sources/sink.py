"""Writing wide tables: validated batches, row groups as files, statistics beside the data, one atomic install.

A table is a folder: `data` holds Parquet files, each one row group; `stats` has the opted-in statistics of each;
`layout` the options. Executors write the files in parallel; statistics are one aggregate over what was written.
"""

from __future__ import annotations

import dataclasses
import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.layout import Options, estimated_size, value_size
from ..operators.stats import ROW_GROUP, _name, row_group_stats
from ..types import TableError, check_schema, check_stats_columns, is_nested
from . import files


def required(df: DataFrame, names: list[str]) -> DataFrame:
    """df with these columns not null: a null in one ends the write, naming the column."""
    out = []
    for f in df.schema:
        c = _name(f.name)
        if f.name in names:
            stop = F.raise_error(F.lit(f"null in non-nullable column '{f.name}'")).cast(f.dataType)
            c = F.coalesce(c, stop)
        out.append(c.alias(f.name))
    return df.select(*out)


def check_batch(df: DataFrame, schema: T.StructType) -> DataFrame:
    """A batch must have the table's columns, in order, by exact name and type; its nulls must be allowed."""
    if len(df.schema) != len(schema):
        raise TableError(f"batch has {len(df.schema)} columns, the table has {len(schema)}")
    for k, (a, b) in enumerate(zip(df.schema, schema, strict=True)):
        if a.name != b.name:
            raise TableError(f"column {k} of the batch is '{a.name}', the table has '{b.name}'")
        if a.dataType.simpleString() != b.dataType.simpleString():
            raise TableError(f"column '{a.name}' is {a.dataType.simpleString()}, the table has {b.dataType.simpleString()}")
    return required(df, [f.name for f in schema if not f.nullable])


def row_bytes(schema: T.StructType) -> Column:
    sizes = [
        F.coalesce(value_size(_name(f.name), f.dataType), F.lit(0))
        if not is_nested(f.dataType)
        else F.length(_name(f.name).cast("string"))
        for f in schema
    ]
    return reduce(lambda a, b: a + b, sizes, F.lit(0)).cast("double")


class Writer:
    """Appends batches to a table that is installed on close. After a failure nothing more is taken."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, options: Options = Options(), overwrite: bool = False):
        check_schema(schema)
        check_stats_columns(schema, list(options.stats_columns))
        if options.compression not in ("zstd", "none"):
            raise TableError(f"unknown compression '{options.compression}'")
        files.refuse_existing(spark, path, overwrite)
        self.spark, self.path, self.schema, self.options, self.overwrite = spark, path, schema, options, overwrite
        self.made, self.state, self.batches, self.bytes = files.beside(path), "open", 0, 0

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            self.close()
        else:
            self.abort()

    def append(self, df: DataFrame) -> None:
        if self.state != "open":
            raise TableError(f"writer is {self.state}")
        try:
            checked = check_batch(df, self.schema)
            mean, rows = df.agg(F.avg(row_bytes(self.schema)), F.count("*")).first()
            per_file = max(1, math.floor(self.options.row_group_max_size / mean)) if mean else 0
            out = checked.write.mode("append").option("compression", self.options.compression)
            if self.options.compression == "zstd":
                out = out.option("parquet.compression.codec.zstd.level", self.options.zstd_level)
            out = out.option("parquet.block.size", self.options.row_group_max_size).option("maxRecordsPerFile", per_file)
            out.parquet(f"{self.made}/data")
            self.batches += 1
            self.bytes += int((mean or 0) * rows)
        except BaseException:
            self.abort()
            raise

    def estimated_size(self, pending: DataFrame | None = None) -> int:
        """Bytes of the table if it were closed now, or after another batch: by the ratio of stored to raw bytes so far."""
        written = 0
        if self.batches:
            fs, p = files._fs(self.spark, f"{self.made}/data")
            written = fs.getContentSummary(p).getLength()
        more = 0
        if pending is not None:
            more = int(pending.agg(F.coalesce(F.sum(row_bytes(self.schema)), F.lit(0.0))).first()[0])
        ratio = written / self.bytes if self.bytes else None
        return estimated_size(written, more, ratio, self.options.compression)

    def abort(self) -> None:
        if self.state == "open":
            self.state = "aborted"
            files.discard(self.spark, self.made)

    def close(self) -> None:
        if self.state == "closed":
            return
        if self.state == "aborted":
            raise TableError("writer is aborted")
        try:
            if not self.batches:
                self.spark.createDataFrame([], self.schema).write.parquet(f"{self.made}/data")
            kept = json.dumps({"options": dataclasses.asdict(self.options), "schema": json.loads(self.schema.json())})
            self.spark.createDataFrame([(kept,)], "value string").coalesce(1).write.text(f"{self.made}/layout")
            data = with_row_groups(self.spark.read.schema(self.schema).parquet(f"{self.made}/data"))
            if self.options.stats_columns:
                stats = row_group_stats(data, list(self.options.stats_columns))
                stats.write.parquet(f"{self.made}/stats")
            files.install(self.spark, self.made, self.path, self.overwrite)
            self.state = "closed"
        except BaseException:
            self.abort()
            raise


def with_row_groups(df: DataFrame) -> DataFrame:
    """df with the file that each row is in, as its row group."""
    return df.withColumn(ROW_GROUP, F.col("_metadata.file_name"))


def write_table(df: DataFrame, path: str, options: Options = Options(), overwrite: bool = False) -> None:
    with Writer(df.sparkSession, path, df.schema, options, overwrite) as w:
        w.append(df)
