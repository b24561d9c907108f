"""Row-group pruning: which row groups a predicate can match, from their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.predicate import Where, bind, may_match
from ..operators.stats import ROW_GROUP, value_of


def excluded_row_groups(stats: DataFrame, schema: T.StructType, where: Where, row_group: str = ROW_GROUP) -> DataFrame:
    """The row groups whose statistics show that no row matches."""
    bind(schema, where)
    t = schema[where.column].dataType
    own = stats.where(F.col("column") == where.column)
    return own.where(~may_match(t, where, value_of(F.col("min"), t), value_of(F.col("max"), t))).select(row_group)


def kept_row_groups(stats: DataFrame, schema: T.StructType, where: Where, row_group: str = ROW_GROUP) -> DataFrame:
    """The other row groups: those that can match, and those without statistics of the column."""
    gone = excluded_row_groups(stats, schema, where, row_group)
    return stats.select(row_group).distinct().join(gone, row_group, "left_anti")


#: Row groups that a condition may list.
LISTED = 5_000


def pruned_scan(df: DataFrame, stats: DataFrame, where: Where, row_group: str = ROW_GROUP) -> DataFrame:
    """The rows that match, without those of excluded row groups: the same rows as without pruning.

    `stats` should be stored ones; excluded row groups become a condition on the scan. More than LISTED of them are
    left to the predicate itself, which costs less than a join. Row groups without statistics are kept.
    """
    rows = df.where(bind(df.schema, where))
    gone = [r[0] for r in excluded_row_groups(stats, df.schema, where, row_group).limit(LISTED + 1).collect()]
    gone = [g for g in gone if g is not None]
    if not gone or len(gone) > LISTED:
        return rows
    return rows.where(~F.col(row_group).isin(gone) | F.col(row_group).isNull())
