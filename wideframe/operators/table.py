"""A wide table on disk: open, project, filter with row-group skipping, limit, count, statistics, layout reports."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.prune import kept_row_groups
from ..sources import files
from ..sources.sink import with_row_groups
from ..types import TableError
from . import layout, stats
from .layout import Options
from .predicate import Where, bind, parse_where
from .stats import ROW_GROUP, _name


#: Names of files that a condition may list.
NAMED_FILES = 5_000


def column_names(text: str | None) -> list[str] | None:
    """Of a comma list: trimmed, empty ones dropped; None stays None."""
    return None if text is None else [n.strip() for n in text.split(",") if n.strip()]


@dataclass(frozen=True)
class WideTable:
    """Immutable: projecting gives another one. Repeated names count once; no name gives rows without columns."""

    spark: SparkSession
    path: str
    schema_: T.StructType
    options: Options
    projection: tuple[str, ...] | None = None
    cache: dict = field(default_factory=dict, compare=False, repr=False)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> WideTable:
        if not files.exists(spark, f"{path}/layout"):
            raise TableError(f"'{path}' is no table")
        kept = json.loads(files.read_text(spark, f"{path}/layout"))
        options = Options(**{k: tuple(v) if isinstance(v, list) else v for k, v in kept["options"].items()})
        return cls(spark, path, T.StructType.fromJson(kept["schema"]), options)

    @property
    def schema(self) -> T.StructType:
        names = self.schema_.names if self.projection is None else self.projection
        return T.StructType([self.schema_[n] for n in names])

    def check(self, names: list[str]) -> None:
        for n in names:
            if n not in self.schema_.names:
                raise TableError(f"unknown column '{n}'")

    def project(self, *names: str) -> WideTable:
        self.check(list(names))
        return replace(self, projection=tuple(dict.fromkeys(names)))

    def _data(self, columns: list[str] | tuple[str, ...], only: str | None = None) -> DataFrame:
        """These columns; `only`: a file's name. The plan has no others, so its size is that of the projection, not of
        the table."""
        names = dict.fromkeys(columns) or self.schema_.names[:1]  # a plan needs a column; rows without one count too
        kind = T.StructType([self.schema_[n] for n in names])
        return self.spark.read.schema(kind).parquet(f"{self.path}/data" + (f"/{only}" if only else ""))

    def _select(self, df: DataFrame) -> DataFrame:
        return df.select(*[_name(n) for n in self.schema.names])

    @property
    def df(self) -> DataFrame:
        return self._select(self._data(self.schema.names))

    def row_groups(self) -> DataFrame:
        """(row_group, rows), from the files' footers."""
        return stats.row_group_rows(with_row_groups(self._data(())))

    def row_group(self, name: str) -> DataFrame:
        if not files.exists(self.spark, f"{self.path}/data/{name}"):
            raise TableError(f"unknown row group '{name}'")
        return self._select(self._data(self.schema.names, name))

    def count(self) -> int:
        return self._data(()).count()

    def stats(self) -> DataFrame:
        """(row_group, column, rows, nulls, min, max) of the columns that were opted in when the table was written."""
        if files.exists(self.spark, f"{self.path}/stats"):
            return self.spark.read.parquet(f"{self.path}/stats")
        kind = "row_group string, column string, rows long, nulls long, min string, max string"
        return self.spark.createDataFrame([], kind)

    def where(self, condition: str | Where) -> DataFrame:
        """The projected rows that match. Files whose statistics exclude a match are not opened.

        Names of files are a condition on the scan, which drops the others while it lists files. Where more than
        NAMED_FILES are left, the driver holds no names: then files are opened and their own footers exclude the groups.
        """
        w = parse_where(condition) if isinstance(condition, str) else condition
        mask = bind(self.schema_, w)
        data = self._data([*self.schema.names, w.column]).where(mask)
        if w.column in self.options.stats_columns:
            kept = kept_row_groups(self.stats(), self.schema_, w).limit(NAMED_FILES + 1).collect()
            if len(kept) <= NAMED_FILES:
                data = data.where(F.col("_metadata.file_name").isin([r[0] for r in kept]) if kept else F.lit(False))
        return self._select(data)

    def cat(self, num: int | None = None, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
        """Filter, then limit, then project; the predicate's column need not be shown. Conditions are checked first."""
        table = self if columns is None else self.project(*columns)
        out = table.df if where is None else table.where(where)
        return out if num is None else out.limit(num)

    def head(self, num: int = 10, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
        return self.cat(num, columns, where)

    # Reports. They take the written files as row groups.

    def _grouped(self, columns: list[str] | None = None) -> DataFrame:
        return with_row_groups(self._data(columns or self.schema_.names))

    def _flat(self, columns: list[str] | None) -> list[str]:
        self.check(columns or [])
        return list(dict.fromkeys(columns or self.schema_.names))

    def schema_report(self) -> DataFrame:
        return layout.schema_report(self.spark, self.schema_, self.options)

    def pages(self, columns: list[str] | None = None) -> DataFrame:
        names = self._flat(columns)
        return layout.pages(self._grouped(names), names, self.options, schema=self.schema_)

    def buckets(self) -> DataFrame:
        return layout.buckets(self._grouped(), self.options)

    def column_sizes(self, columns: list[str] | None = None) -> DataFrame:
        return layout.column_sizes(self._grouped(), self.options, columns=self._flat(columns))

    def dictionary(self, column: str, whole: bool = False) -> DataFrame:
        """Of each row group, or of the whole table as if it were one: its files in order of their names, 0 for row_group."""
        self.check([column])
        rows = self._grouped([column])
        place = "position"
        while place in rows.columns:
            place += "_"
        return layout.dictionary(rows.withColumn(place, F.col("_metadata.row_index")), column, place, self.options, whole=whole)

    def footer(self) -> DataFrame:
        return layout.footer(self.spark, self.n_buckets, self.row_groups().count(), self.options)

    @property
    def n_buckets(self) -> int:
        return self.options.buckets(len(self.schema_))

    def meta(self) -> DataFrame:
        """(rows, columns, buckets, row_groups), one row."""
        counted = self.row_groups().agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count("*").alias("row_groups"))
        return counted.select(
            "rows", F.lit(len(self.schema_)).alias("columns"), F.lit(self.n_buckets).alias("buckets"), "row_groups"
        )

    def stored(self) -> DataFrame:
        """(row_group, stored_bytes, raw_bytes, ratio): a file's size, its values' before compression, and how many times less."""
        files_ = self._data(()).select(
            F.col("_metadata.file_name").alias(ROW_GROUP), F.col("_metadata.file_size").alias("stored_bytes")
        )
        size = files_.groupBy(ROW_GROUP).agg(F.max("stored_bytes").alias("stored_bytes"))
        raw = self.buckets().groupBy(ROW_GROUP).agg(F.sum("bytes").alias("raw_bytes"))
        return size.join(raw, ROW_GROUP).withColumn("ratio", layout.ratio_text(F.col("stored_bytes"), F.col("raw_bytes")))


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    table = WideTable.open(spark, path)
    return table.df if columns is None else table.project(*columns).df
