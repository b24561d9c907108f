"""Appending a stream to wide tables: every micro-batch is one table folder, installed at once, replaced if it is retried."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.layout import Options
from ..operators.table import WideTable
from ..sources.sink import Writer
from ..types import check_schema


def append_stream(
    stream: DataFrame, path: str, checkpoint: str, options: Options = Options(), available_now: bool = True
) -> StreamingQuery:
    """Starts a query that writes each batch of the stream to path/batch=<id>. A batch that comes again after a failure
    replaces its own folder, so each row is there once."""
    check_schema(stream.schema)
    schema = stream.schema

    def put(batch: DataFrame, batch_id: int) -> None:
        with Writer(batch.sparkSession, f"{path}/batch={batch_id:010d}", schema, options, overwrite=True) as w:
            w.append(batch)

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if available_now else q).start()


def batches(spark, path: str) -> list[WideTable]:
    """The tables of all batches, in order."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().toString() for s in fs.globStatus(p) or () if ".part-" not in s.getPath().getName())
    return [WideTable.open(spark, n) for n in names]
