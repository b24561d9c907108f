"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], and reads of a wide table, and prints one JSON line.

The wide table has 10,000 columns (nine of ten are text, names of about 80 bytes) and 500 or 4,500 rows, as in the
published figures, which are reads by a library in its own process; `published_ms` has them beside ours.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Scans and predicates, statistics and pruning, layout reports, nesting, export, import checks.
HEADLINE = (
    "cat_project_where_int",
    "where_float_exact",
    "where_date_iso",
    "count_rows",
    "count_per_row_group",
    "head_ordered",
    "rg_stats_long",
    "rg_stats_lineitem",
    "pruned_scan_rows",
    "encoding_choice",
    "encoding_choice_lineitem",
    "dictionary_entries",
    "column_plain_bytes",
    "row_group_running_split",
    "array_flatten",
    "array_reassemble",
    "text_json_columns",
    "json_escape",
    "union_by_name",
    "exact_promotion_violations",
    "table_cat_hidden_filter",
    "table_where_pruned",
    "table_project_by_names",
    "encodings_nested",
    "buckets_wide",
    "nested_gather",
    "csv_import_types",
    "json_import_rows",
)


WIDE_COLUMNS, WIDE_ROWS = 10_000, (500, 4_500)
#: Milliseconds to read so many of the 10,000 columns: (Parquet, the format of the published figures).
PUBLISHED_MS = {(500, 10): (53.2, 25.1), (500, 1): (50.9, 2.4), (4500, 10): (369.6, 67.3), (4500, 1): (360.5, 26.9)}


def wide_file(path: str, rows: int) -> None:
    """One Parquet file, Zstandard level 9."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(1)
    texts = pa.array([f"value {k:08d} of a text column" for k in range(5_000)])
    columns = {}
    for k in range(WIDE_COLUMNS):
        name = f"column_{k:05d}_".ljust(80, "x")
        picks = rng.integers(0, 5_000, rows)
        columns[name] = pa.array(picks.astype(np.int32)) if k % 10 == 0 else texts.take(pa.array(picks))
    pq.write_table(pa.table(columns), path, compression="zstd", compression_level=9, use_dictionary=False)


def wide_table(spark, folder: str, rows: int):
    """The file as a table of ours: its data beside its layout."""
    import dataclasses

    from pyspark.sql import types as T

    from wideframe.operators.layout import Options
    from wideframe.operators.table import WideTable

    os.makedirs(f"{folder}/data")
    wide_file(f"{folder}/data/part-0.parquet", rows)
    names = [f"column_{k:05d}_".ljust(80, "x") for k in range(WIDE_COLUMNS)]
    kinds = [T.IntegerType() if k % 10 == 0 else T.StringType() for k in range(WIDE_COLUMNS)]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, kinds, strict=True)])
    kept = json.dumps({"options": dataclasses.asdict(Options()), "schema": json.loads(schema.json())})
    spark.createDataFrame([(kept,)], "value string").coalesce(1).write.text(f"{folder}/layout")
    return WideTable.open(spark, folder), names


def best_of(n: int, run) -> float:
    times = []
    for _ in range(n):
        began = time.perf_counter()
        run()
        times.append(time.perf_counter() - began)
    return min(times)


def wide(spark) -> tuple[dict[str, float], dict[str, tuple[float, float]]]:
    """Seconds of reads and of a report on the wide tables."""
    times, folder = {}, tempfile.mkdtemp(prefix="wideframe-bench-")
    try:
        for rows in WIDE_ROWS:
            t, names = wide_table(spark, f"{folder}/{rows}", rows)
            for n in (10, 1):
                chosen = names[5 :: WIDE_COLUMNS // n][:n]
                times[f"wide_{rows}_read_{n}"] = best_of(5, lambda: t.project(*chosen).df.write.format("noop").mode("overwrite").save())
            times[f"wide_{rows}_pages_10"] = best_of(2, lambda: t.pages(names[5::1000]).collect())
    finally:
        shutil.rmtree(folder)
    return times, {f"wide_{r}_read_{n}": ms for (r, n), ms in PUBLISHED_MS.items()}


def main() -> None:
    from pyspark.sql import SparkSession

    from wideframe import registry

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # the session's start is not a query's time
    times = {}
    for name in HEADLINE:
        times[name] = best_of(2, lambda: registry.queries()[name](spark, sf).write.format("noop").mode("overwrite").save())
    more, published = wide(spark)
    times = {k: round(v, 3) for k, v in (times | more).items()}
    line = {"metric": "headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times}
    print(json.dumps(line | {"sf": os.path.basename(sf), "published_ms": published}))
    spark.stop()


if __name__ == "__main__":
    main()
