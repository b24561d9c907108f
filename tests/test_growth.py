"""What fails, or grows faster than the input, on larger tables only."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideframe import registry_tables
from wideframe.operators import facts, layout


def test_cubes_beyond_bigint(spark, tmp_path):
    spark.range(2_093_056, 2_101_248, 1, 2).select(F.col("id").alias("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(100,), (105,), (106,), (131,)], "event_id long").write.mode("append").parquet(f"{tmp_path}/events.parquet")
    found = registry_tables.integer_block_widths(spark, str(tmp_path)).orderBy("block").collect()
    assert [(r.block, r.n_rows, r.bytes_each) for r in found] == [(0, 4, 2), (511, 4096, 8), (512, 4096, 8)]


def test_text_file_is_not_sorted(spark, tmp_path, monkeypatch):
    """A sort for the sake of the first line holds the whole file in one task."""
    sorts = []
    plain = type(spark.range(1)).sortWithinPartitions
    monkeypatch.setattr(type(spark.range(1)), "sortWithinPartitions", lambda self, *a, **b: sorts.append(a) or plain(self, *a, **b))
    made = {"many": spark.range(0, 5000, 1, 7).select(F.col("id").cast("string").alias("line")), "none": spark.createDataFrame([], "line string")}
    for name, lines in made.items():
        path = registry_tables._text_file(spark, str(tmp_path), name, lines, "a\nb")
        found = open(path.removeprefix("file:")).read().split("\n")
        assert found[:2] == ["a", "b"] and found[-1] == ""
        assert sorted(found[2:-1]) == sorted(r.line for r in lines.collect())
    assert not sorts


def test_mixed_row_groups_are_counted_like_long_ones(spark):
    """The same rows with their groups mixed, which are counted all at once, and one after the other, each by itself."""
    c = F.col
    v = F.when(c("id") % 7 != 0, c("n"))  # with nulls
    kinds = {
        "a": v.cast("int"), "b": v, "c": v.cast("string"), "d": (v / 2).cast("double"), "e": v % 2 == 0, "f": F.date_add(F.lit("2020-01-01").cast("date"), v.cast("int")),
        "g": F.timestamp_micros(v).cast("timestamp_ntz"), "h": (v - 5).cast("decimal(30,2)"), "i": (v - 5).cast("decimal(9,2)"), "j": v.cast("string").cast("binary"),
        "k": F.when(v.isNotNull(), F.struct(v.alias("millis"), (v % 3).cast("int").alias("nanos_of_milli"))), "l": F.lit(None).cast("int"),
        "m": F.when(v % 3 != 0, F.array(v, F.lit(None), v % 4)), "n": F.when(v % 5 != 0, F.create_map(v.cast("string"), F.array(v % 2))),
        "o": F.when(c("n") % 2 == 0, 0.0).otherwise(-0.0).cast("float"), "p": F.timestamp_micros(v),
    }
    # Groups have 3, 6, ... different values; the last ones more than a dictionary may have.
    rows = spark.range(0, 12_000, 1, 3).withColumn("g", c("id") % 30).withColumn("n", c("id") % (3 * (c("g") + 1)) + F.when(c("g") > 27, c("id")).otherwise(0))
    df = rows.select(F.when(c("g") > 0, c("g")).alias("row_group"), *[x.alias(n) for n, x in kinds.items()]).localCheckpoint()
    mixed = layout.encodings(df).collect()
    alone = [r for g in (None, 1, 11, 27, 28, 29) for r in layout.encodings(df.where(c("row_group").eqNullSafe(F.lit(g)))).collect()]
    assert sorted(map(repr, (r for r in mixed if r.row_group in (None, 1, 11, 27, 28, 29)))) == sorted(map(repr, alone))
    assert len(mixed) == 30 * 20 and {r.encoding for r in mixed} == {"ALL_NULL", "CONST", "DICT", "PLAIN"}


def test_time_of_mixed_row_groups():
    """Of 3000 groups in turn over 300,000 rows: all groups of a batch are counted at once, in a few batches."""
    n = 300_000
    codes, values = np.arange(n) % 3000, pa.array(np.arange(n) // 3000 % 5)
    began = time.process_time()
    counts, entries = facts._of_groups(values, T.LongType(), codes, pa.array(np.arange(3000)), 0, 255, "g")
    assert time.process_time() - began < 2
    assert len(counts) == 3000 and set(counts["rows"].to_pylist()) == {100} and set(counts["plain_bytes"].to_pylist()) == {800}
    assert len(entries) == 15_000 and not any(counts["many"].to_pylist())


def test_dictionary_of_ranges(spark, tmp_path, monkeypatch):
    """A table in many files has one dictionary, in order of the key; no task sorts all of it."""
    one = []
    plain = type(spark.range(1)).coalesce
    monkeypatch.setattr(type(spark.range(1)), "coalesce", lambda self, n: one.append(self.columns) or plain(self, n))
    key = F.col("o_orderkey")
    late = F.when(key >= 9_000, F.concat(F.lit("late"), (key % 3).cast("string"))).otherwise(F.concat(F.lit("p"), (key % 7 * 3 % 5).cast("string")))
    spark.range(11_999, -1, -1, 5).withColumnRenamed("id", "o_orderkey").withColumn("o_orderpriority", late).write.parquet(f"{tmp_path}/orders.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = registry_tables.table_dictionary(spark, str(tmp_path)).orderBy("nth").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [tuple(r) for r in found] == list(enumerate(["p0", "p3", "p1", "p4", "p2", "late0", "late1", "late2"]))
    assert not any("o_orderkey" in columns for columns in one)
    (path,) = [p for k, p in registry_tables._MADE.items() if k[1:] == (str(tmp_path), "priorities")]
    assert spark.read.parquet(f"{path}/data").select("_metadata.file_name").distinct().count() > 1
