"""Statistics of row groups, in long form: row_group, column, nulls, min, max."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import floor_div, split_nanos
from ..types import check_stats_columns, is_nanos, width

ROW_GROUP = "row_group"


def by_key(df: DataFrame, key: str, size: int, to: str = ROW_GROUP) -> DataFrame:
    """Row groups of `size` consecutive values of a whole-number key: no shuffle, and the same on every run."""
    return df.withColumn(to, floor_div(F.col(key), F.lit(size)).cast("long"))


def _name(c: str) -> Column:
    return F.col(f"`{c.replace('`', '``')}`")


def _extremes(c: Column, t: T.DataType, position: Column | None) -> tuple[Column, Column]:
    """Least and greatest. NaN is neither, but where the first value by position is NaN, both are."""
    if not isinstance(t, (T.FloatType, T.DoubleType)):
        return F.min(c), F.max(c)
    plain = F.when(~F.isnan(c), c)
    low, high = F.min(plain), F.max(plain)
    nan = F.lit(float("nan")).cast(t)
    if position is None:  # only if there is nothing else
        return F.coalesce(low, F.min(c)), F.coalesce(high, F.max(c))
    first = F.isnan(F.min_by(c, F.when(c.isNotNull(), position)))
    return F.when(first, nan).otherwise(low), F.when(first, nan).otherwise(high)


def shown(c: Column, t: T.DataType) -> Column:
    """A statistic as text: dates as days, timestamps as microseconds (nanoseconds where they are held)."""
    if isinstance(t, T.DateType):
        return F.unix_date(c).cast("string")
    if isinstance(t, T.TimestampType):
        return F.unix_micros(c).cast("string")
    if isinstance(t, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp")).cast("string")
    if is_nanos(t):
        exact = c["millis"].cast("decimal(38,0)") * 1_000_000 + c["nanos_of_milli"]
        return exact.cast("string")
    return c.cast("string")


def value_of(text: Column, t: T.DataType) -> Column:
    """A statistic's text as a value of the column's type again."""
    if isinstance(t, T.DateType):
        return F.date_from_unix_date(text.cast("int"))
    if isinstance(t, T.TimestampType):
        return F.timestamp_micros(text.cast("long"))
    if isinstance(t, T.TimestampNTZType):
        return F.timestamp_micros(text.cast("long")).cast("timestamp_ntz")
    return F.when(text.isNotNull(), split_nanos(text.cast("long"))) if is_nanos(t) else text.cast(t)


def typed(stats: DataFrame, schema: T.StructType, column: str, row_group: str = ROW_GROUP) -> DataFrame:
    """(row_group, rows, nulls, min, max) of one column, min and max of its type."""
    t = schema[column].dataType
    own = stats.where(F.col("column") == column)
    return own.select(row_group, "rows", "nulls", value_of(F.col("min"), t).alias("min"), value_of(F.col("max"), t).alias("max"))


def with_units(stats: DataFrame, schema: T.StructType) -> DataFrame:
    """Statistics for people: days, microseconds and nanoseconds say what they are."""
    units = {T.DateType: " (epoch-day)", T.TimestampType: " (us)", T.TimestampNTZType: " (us)"}
    unit = F.lit("")
    for text in sorted({*units.values(), " (ns)"}):
        own = [f.name for f in schema if (" (ns)" if is_nanos(f.dataType) else units.get(type(f.dataType))) == text]
        unit = F.when(F.col("column").isin(own), text).otherwise(unit) if own else unit
    return stats.withColumns({n: F.concat(n, unit) for n in ("min", "max")})


def row_group_stats(
    df: DataFrame, columns: list[str], row_group: str = ROW_GROUP, position: str | None = None
) -> DataFrame:
    """One pass over the rows with partial sums: (row_group, column, rows, nulls, min, max), min and max as text.

    min and max are null where a row group has only nulls. `position` is needed for the rule on a NaN that comes first.
    """
    columns = check_stats_columns(df.schema, columns)
    place = _name(position) if position else None
    aggs = []
    for k, n in enumerate(columns):
        t, c = df.schema[n].dataType, _name(n)
        low, high = _extremes(c, t, place)
        aggs += [F.count_if(c.isNull()).alias(f"n{k}"), low.alias(f"l{k}"), high.alias(f"h{k}")]
    rows = F.count("*")
    if any(width(df.schema[n].dataType) is None for n in columns):
        # Least and greatest texts alone would make Spark sort all rows. With an aggregate of objects beside them (this
        # one is of nothing) it hashes, and row groups of one task are few.
        rows = rows + F.size(F.collect_set(F.lit(None).cast("int")))
    wide = df.groupBy(row_group).agg(rows.alias("rows"), *aggs)
    each = [
        F.struct(
            F.lit(n).alias("column"),
            F.col(f"n{k}").alias("nulls"),
            shown(F.col(f"l{k}"), df.schema[n].dataType).alias("min"),
            shown(F.col(f"h{k}"), df.schema[n].dataType).alias("max"),
        )
        for k, n in enumerate(columns)
    ]
    return wide.select(row_group, "rows", F.explode(F.array(*each)).alias("s")).select(row_group, "s.column", "rows", "s.nulls", "s.min", "s.max")


def row_group_rows(df: DataFrame, row_group: str = ROW_GROUP) -> DataFrame:
    return df.groupBy(row_group).agg(F.count("*").alias("rows"))
