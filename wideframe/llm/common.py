"""What the operators share: reading tables, written intermediate tables and their end, batch sizes, free names."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship  # noqa: F401

#: Folders that `written` is writing under: the innermost step's last.
_STEPS: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/wideframe/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = "/".join([_root(spark), *_STEPS[-1:], f"{name}-{uuid.uuid4().hex}"])
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def step(spark: SparkSession) -> Iterator[Callable[[], None]]:
    """Tables that are `written` inside go when the step ends, so its result is to be written after `leave`:

    with step(spark) as leave:
        found = operator(docs)
        leave()
        docs = written(found, "found")
    """
    _STEPS.append(f"step-{uuid.uuid4().hex}")
    mine, left = _STEPS[-1], []

    def leave() -> None:
        _STEPS.pop()
        left.append(True)

    try:
        yield leave
    finally:
        if not left:
            _STEPS.pop()
        _delete(spark, f"{_root(spark)}/{mine}")


def release(spark: SparkSession) -> None:
    """Delete every table that `written` made in this application. Call it once results are stored."""
    _delete(spark, _root(spark))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows, since texts may be long; a smaller setting stays.

    Spark reads the setting when a plan runs, which is after the operator returned it, so it stays in the session.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name
