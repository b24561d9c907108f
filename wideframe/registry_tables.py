"""Registered queries that go through written tables: writer, reader, pruning, reports, imports, CLI, streams.

Each makes its table from the given ones, whole, in the shared folder, once for a session and a folder of tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import cli
from .functions import scalars
from .functions.render import cells, ndjson, text_json
from .operators import layout, names, nested, stats
from .operators.layout import Options
from .operators.table import WideTable, column_names, read_table
from .operators.predicate import bind, parse_where
from .plans import prune
from .registry import _NAMED, ORDERS_GROUP, _t, query
from .session import shared_dir
from .sources import files
from .sources.csv_import import Dialect, import_csv
from .sources.json_import import import_json, is_json
from .sources.sink import Writer, write_table
from .streaming.append import append_stream, batches
from .types import TableError, check_schema

_MADE: dict[tuple, str] = {}


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/wideframe-tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[str], None]) -> str:
    """The path of a table that `make` writes, once."""
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _MADE:
        path = _place(spark, name)
        make(path)
        _MADE[key] = path
    return _MADE[key]


def _orders(spark: SparkSession, sf_dir: str) -> WideTable:
    """Orders in four row groups by key, with statistics."""
    options = Options(num_buckets=3, stats_columns=("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"))
    rows = _t(spark, sf_dir, "orders").repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey")
    return WideTable.open(spark, _once(spark, sf_dir, "orders", lambda p: write_table(rows, p, options)))


def _nation(spark: SparkSession, sf_dir: str) -> WideTable:
    """Nation in one row group, in order of its key."""
    rows = _t(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey")
    return WideTable.open(spark, _once(spark, sf_dir, "nation", lambda p: write_table(rows, p, Options(num_buckets=1))))


def _refused(spark: SparkSession, cases: dict[str, Callable]) -> DataFrame:
    """(what, refused): whether each case raises an error of the table."""
    found = []
    for name, case in cases.items():
        try:
            out = case()
            if isinstance(out, DataFrame):
                out.count()
            found.append((name, False))
        except TableError:
            found.append((name, True))
    return spark.createDataFrame(found, "what string, refused boolean")


def _all_refused(names: str, fine: str = "") -> str:
    rows = [f"('{n}', true)" for n in names.split()] + [f"('{n}', false)" for n in fine.split()]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS v(what, refused)"


# Scans and projections.


@query("SELECT * FROM orders")
def table_round_trip(spark, sf_dir):
    return read_table(spark, _orders(spark, sf_dir).path)


@query("SELECT o_totalprice, o_orderkey FROM orders")
def table_project_by_names(spark, sf_dir):
    return read_table(spark, _orders(spark, sf_dir).path, ["o_totalprice", "o_orderkey"])


@query("SELECT n_name, n_nationkey FROM nation")
def table_duplicate_names(spark, sf_dir):
    return _nation(spark, sf_dir).project("n_name", "n_nationkey", "n_name").df


@query("SELECT n_regionkey, n_name FROM nation")
def table_column_list(spark, sf_dir):
    return _nation(spark, sf_dir).cat(columns=column_names(" n_regionkey,, n_name ,"))


@query("SELECT count(*) AS n_rows FROM orders")
def table_no_columns(spark, sf_dir):
    return _orders(spark, sf_dir).project().df.agg(F.count("*").alias("n_rows"))


@query("SELECT count(*) AS n_rows, sum(o_orderkey)::BIGINT AS total, 4::BIGINT AS groups FROM orders")
def table_row_group_scans(spark, sf_dir):
    t = _orders(spark, sf_dir)
    groups = [r[0] for r in t.row_groups().collect()]
    scans = [t.project("o_orderkey").row_group(n).withColumn("g", F.lit(n)) for n in groups]
    out = scans[0]
    for s in scans[1:]:
        out = out.union(s)
    return out.agg(F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("total"), F.countDistinct("g").alias("groups"))


@query("SELECT count(*) AS n_rows FROM orders")
def table_count(spark, sf_dir):
    n = _orders(spark, sf_dir).count()
    return spark.range(1).select(F.lit(n).cast("long").alias("n_rows"))


@query("SELECT count(*)::BIGINT AS n_rows, 4::BIGINT AS groups FROM orders")
def table_row_group_rows(spark, sf_dir):
    return _orders(spark, sf_dir).row_groups().agg(F.sum("rows").alias("n_rows"), F.count("*").alias("groups"))


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 7")
def table_head(spark, sf_dir):
    return _nation(spark, sf_dir).head(7, ["n_nationkey", "n_name"])


# Predicates with statistics.


@query("SELECT o_custkey FROM orders WHERE o_orderkey > 100")
def table_cat_hidden_filter(spark, sf_dir):
    return _orders(spark, sf_dir).cat(None, ["o_custkey"], "o_orderkey>100")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey <= 777")
def table_where_pruned(spark, sf_dir):
    return _orders(spark, sf_dir).cat(None, ["o_orderkey", "o_totalprice"], "o_orderkey<=777")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 12000")
def pruned_scan_rows(spark, sf_dir):
    """Row groups that are not files: stored statistics by a dense key, excluded groups as a condition on the scan."""
    rows = stats.by_key(_t(spark, sf_dir, "orders"), "o_orderkey", ORDERS_GROUP)
    found = stats.row_group_stats(rows, ["o_orderkey"])
    kept = spark.read.parquet(_once(spark, sf_dir, "orders-stats", lambda p: found.write.parquet(p)))
    return prune.pruned_scan(rows, kept, parse_where("o_orderkey>12000")).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE false")
def table_where_none_left(spark, sf_dir):
    return _orders(spark, sf_dir).cat(None, ["o_orderkey"], "o_orderkey>99999999999")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def table_where_text_stats(spark, sf_dir):
    return _orders(spark, sf_dir).cat(None, ["o_orderkey"], "o_orderstatus!=F")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount::FLOAT >= 0.07::FLOAT")
def table_where_float32(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").cast("float").alias("d"))
    rows = rows.repartitionByRange(3, "d")
    path = _once(spark, sf_dir, "discounts", lambda p: write_table(rows, p, Options(stats_columns=("d",))))
    return WideTable.open(spark, path).cat(None, ["l_orderkey", "l_linenumber"], "d>=0.07")


@query(
    """SELECT 'o_orderkey' AS "column", count(*)::BIGINT AS n_rows, 0::BIGINT AS nulls, min(o_orderkey)::VARCHAR AS least,
      max(o_orderkey)::VARCHAR AS most FROM orders
    UNION ALL SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus), min(o_orderstatus), max(o_orderstatus) FROM orders"""
)
def table_stats(spark, sf_dir):
    found = _orders(spark, sf_dir).stats()

    def of(name: str, kind: str) -> DataFrame:
        low, high = F.min(F.col("min").cast(kind)).cast("string"), F.max(F.col("max").cast(kind)).cast("string")
        own = found.where(F.col("column") == name)
        return own.groupBy("column").agg(F.sum("rows").alias("n_rows"), F.sum("nulls").alias("nulls"), low.alias("least"), high.alias("most"))

    return of("o_orderkey", "long").union(of("o_orderstatus", "string"))


@query("SELECT min(o_orderdate) AS least, max(o_orderdate) AS most, count(*)::BIGINT AS n_rows FROM orders")
def table_stats_typed(spark, sf_dir):
    """Stored least and greatest timestamps, as timestamps again."""
    t = _orders(spark, sf_dir)
    found = stats.typed(t.stats(), t.schema_, "o_orderdate")
    return found.agg(F.min("min").alias("least"), F.max("max").alias("most"), F.sum("rows").alias("n_rows"))


@query("SELECT (min(o_orderdate::DATE) - DATE '1970-01-01')::VARCHAR || ' (epoch-day)' AS least FROM orders")
def stats_with_units(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.lit(0).alias("row_group"), F.col("o_orderdate").cast("date").alias("day"))
    return stats.with_units(stats.row_group_stats(rows, ["day"]), rows.schema).select(F.col("min").alias("least"))


@query(_all_refused("unknown decimal timestamp text_order boolean_order boolean_word bad_number no_operator no_column no_value", "bad_number_equals date"))
def where_refusals(spark, sf_dir):
    """Conditions are checked before rows are read, so an empty table refuses them too."""
    schema = "i int, d decimal(9,2), t timestamp, s string, b boolean, day date"
    rows = spark.createDataFrame([], schema)

    def of(text: str) -> Callable:
        return lambda: rows.where(bind(rows.schema, parse_where(text)))

    cases = {
        "unknown": "x=1", "decimal": "d>1", "timestamp": "t=1", "text_order": "s>a", "boolean_order": "b>true", "boolean_word": "b=yes",
        "bad_number": "i>abc", "no_operator": "i", "no_column": "=1", "no_value": "i=", "bad_number_equals": "i=abc", "date": "day>2020-02-29",
    }
    return _refused(spark, {k: of(v) for k, v in cases.items()})


# Reports.


@query(
    """SELECT 'n_regionkey' AS "column", 0 AS bucket, 'DICT' AS encoding,
      (1 + 8 * count(DISTINCT n_regionkey) + ceil(count(n_regionkey) * 3 / 8.0))::BIGINT AS bytes FROM nation"""
)
def table_pages_by_names(spark, sf_dir):
    rows = _t(spark, sf_dir, "nation").withColumn("n_regionkey", F.col("n_regionkey").cast("long")).coalesce(1)
    path = _once(spark, sf_dir, "nation-long", lambda p: write_table(rows, p, Options(num_buckets=1)))
    return WideTable.open(spark, path).pages(["n_regionkey"]).drop("row_group")


@query(
    """SELECT * FROM (VALUES ('n_nationkey', 'Int64', 0), ('n_name', 'Utf8', 0), ('n_regionkey', 'Int64', 0)) AS v(name, "type", bucket)"""
)
def table_schema(spark, sf_dir):
    kinds = {"n_nationkey": "bigint", "n_name": "string", "n_regionkey": "bigint"}
    rows = _t(spark, sf_dir, "nation").select(*[F.col(n).cast(k) for n, k in kinds.items()])
    path = _once(spark, sf_dir, "nation-typed", lambda p: write_table(rows, p, Options(num_buckets=1)))
    return WideTable.open(spark, path).schema_report().select("name", "type", "bucket")


@query("SELECT count(*)::BIGINT AS n_rows, 3 AS n_buckets, 4::BIGINT AS row_groups FROM orders")
def table_meta(spark, sf_dir):
    return _orders(spark, sf_dir).meta().select(F.col("rows").alias("n_rows"), F.col("buckets").alias("n_buckets"), "row_groups")


@query("SELECT 'parquet' AS format, 1 AS version, 3 AS buckets, 4 AS row_groups, 'zstd' AS compression")
def table_footer(spark, sf_dir):
    return _orders(spark, sf_dir).footer()


@query("SELECT true AS stored, true AS smaller, 4::BIGINT AS groups")
def table_stored_ratio(spark, sf_dir):
    sized = _orders(spark, sf_dir).stored()
    ok = F.format_string("%.2fx", F.col("raw_bytes") / F.col("stored_bytes")) == F.col("ratio")
    return sized.agg(F.bool_and(F.col("stored_bytes") > 0).alias("stored"), F.bool_and(ok).alias("smaller"), F.count("*").alias("groups"))


@query(
    f"""WITH n AS (SELECT name, lag(name) OVER (ORDER BY name) AS before FROM ({_NAMED})),
    s AS (SELECT length(name) AS len, (SELECT max(i) FROM range(0, 99) AS r(i) WHERE i <= length(name) AND left(name, i) = left(coalesce(before, ''), i)) AS shared FROM n)
    SELECT 'plain' AS how, sum(len)::BIGINT AS bytes FROM s UNION ALL SELECT 'front_coded', (sum(len - shared) + 2 * count(*))::BIGINT FROM s"""
)
def schema_name_bytes(spark, sf_dir):
    return names.name_sizes(spark, _t(spark, sf_dir, "lineitem").schema).where("how IN ('plain', 'front_coded')")


@query("""SELECT * FROM (VALUES (0, 10, ''), (10, 0, ''), (10, 25, '2.50x'), (3, 1, '0.33x')) AS v(stored, raw, shown)""")
def ratio_texts(spark, sf_dir):
    rows = spark.createDataFrame([(0, 10), (10, 0), (10, 25), (3, 1)], "stored int, raw int")
    return rows.select("stored", "raw", layout.ratio_text(F.col("stored"), F.col("raw")).alias("shown"))


@query(
    """SELECT (row_number() OVER (ORDER BY seen, value) - 1)::INT AS nth, value FROM
    (SELECT o_orderpriority AS value, min(o_orderkey) AS seen FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1)"""
)
def table_dictionary(spark, sf_dir):
    """Ranges of the key are sorted and written side by side; their files, in order, are one row group to the report."""
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey")
    path = _once(spark, sf_dir, "priorities", lambda p: write_table(rows, p))
    return WideTable.open(spark, path).dictionary("o_orderpriority", whole=True).select("nth", "value")


@query(
    f"""WITH r AS (SELECT o_orderkey // {ORDERS_GROUP} AS row_group, o_orderkey AS position, o_orderpriority AS value FROM orders),
    d AS (SELECT row_group, value, (row_number() OVER (PARTITION BY row_group ORDER BY min(position), value) - 1)::INT AS nth
      FROM r WHERE value IS NOT NULL GROUP BY 1, 2)
    SELECT r.row_group, position, 'DICT' AS encoding, nth, r.value FROM r LEFT JOIN d ON d.row_group = r.row_group AND d.value = r.value"""
)
def encoded_dictionary(spark, sf_dir):
    rows = stats.by_key(_t(spark, sf_dir, "orders"), "o_orderkey", ORDERS_GROUP)
    return layout.encoded_values(rows, "o_orderpriority", "o_orderkey")


@query("SELECT 0 AS row_group, n_nationkey AS position, 'PLAIN' AS encoding, NULL::INT AS nth, n_name AS value FROM nation")
def encoded_plain(spark, sf_dir):
    return layout.encoded_values(_t(spark, sf_dir, "nation").withColumn("row_group", F.lit(0)), "n_name", "n_nationkey")


@query(
    """SELECT row_group, position // 4096 AS block, count(*) AS n_rows, CASE WHEN min(v) >= -128 AND max(v) <= 127 THEN 1
      WHEN min(v) >= -32768 AND max(v) <= 32767 THEN 2 WHEN min(v) >= -2147483648 AND max(v) <= 2147483647 THEN 4 ELSE 8 END AS bytes_each
    FROM (SELECT 0 AS row_group, event_id AS position, (event_id - 100) * (event_id - 100) * (event_id - 100) AS v FROM events) GROUP BY 1, 2"""
)
def integer_block_widths(spark, sf_dir):
    """Cubes beyond a BIGINT, from event 2,097,252 on, stay exact; the SQL's arithmetic ends there with an error."""
    k = F.col("event_id").cast("decimal(38,0)") - 100
    rows = _t(spark, sf_dir, "events").select(F.lit(0).alias("row_group"), F.col("event_id").alias("position"), (k * k * k).alias("v"))
    return layout.integer_blocks(rows, "v", "position").withColumnRenamed("rows", "n_rows")


#: An ARRAY, a MAP, an ARRAY of ARRAYs, with nulls and empty values, beside a flat column; one row group.
def _nested_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.when(F.col("event_id") % 7 == 0, F.lit(None)).when(F.col("event_id") % 5 == 0, F.array().cast("array<string>"))
    tags = tags.otherwise(F.array("event_type", F.col("user_id").cast("string")))
    props = F.when(F.col("event_id") % 3 != 0, F.create_map(F.lit("t"), F.col("event_type")))
    deep = F.array(F.array(F.col("event_id").cast("long"), F.lit(None).cast("long")), F.array().cast("array<bigint>"), F.lit(None).cast("array<bigint>"))
    deep = F.when(F.col("event_id") % 4 == 0, F.lit(None)).otherwise(deep)
    rows = _t(spark, sf_dir, "events")
    return rows.select("event_id", tags.alias("tags"), props.alias("props"), deep.alias("deep"), F.lit(0).alias("row_group"))


def _varying(c: str) -> str:
    return f"sum(strlen({c}) + CASE WHEN strlen({c}) < 128 THEN 1 ELSE 2 END)"


#: Bytes of each physical column that are PLAIN for sure in the given tables, by name.
_NESTED_PLAIN = f"""
WITH e AS (SELECT event_id, event_type, user_id::VARCHAR AS u, event_id % 7 <> 0 AND event_id % 5 <> 0 AS has,
             event_id % 7 <> 0 AS live, event_id % 3 <> 0 AS p, event_id % 4 <> 0 AS d FROM events)
SELECT 'tags' AS "column", 4 * count(*) FILTER (live) AS plain_bytes, count(*) AS n_rows, count(*) FILTER (live) AS n_live FROM e
UNION ALL SELECT 'tags.element', (coalesce({_varying("event_type")} FILTER (has), 0) + coalesce({_varying("u")} FILTER (has), 0))::BIGINT,
  2 * count(*) FILTER (has), count(event_type) FILTER (has) + count(u) FILTER (has) FROM e
UNION ALL SELECT 'props', 4 * count(*) FILTER (p), count(*), count(*) FILTER (p) FROM e
UNION ALL SELECT 'props.key', 2 * count(*) FILTER (p), count(*) FILTER (p), count(*) FILTER (p) FROM e
UNION ALL SELECT 'props.value', coalesce({_varying("event_type")} FILTER (p), 0)::BIGINT, count(*) FILTER (p), count(event_type) FILTER (p) FROM e
UNION ALL SELECT 'deep', 4 * count(*) FILTER (d), count(*), count(*) FILTER (d) FROM e
UNION ALL SELECT 'deep.element', 8 * count(*) FILTER (d), 3 * count(*) FILTER (d), 2 * count(*) FILTER (d) FROM e
UNION ALL SELECT 'deep.element.element', 8 * count(*) FILTER (d), 2 * count(*) FILTER (d), count(*) FILTER (d) FROM e
UNION ALL SELECT 'event_id', 8 * count(*), count(*), count(*) FROM e"""


@query(_NESTED_PLAIN)
def encodings_nested(spark, sf_dir):
    rows = _nested_rows(spark, sf_dir).withColumn("event_id", F.col("event_id").cast("long"))
    found = layout.encodings(rows)
    return found.select("column", "plain_bytes", F.col("rows").alias("n_rows"), F.col("non_null").alias("n_live"))


@query(
    """WITH e AS (SELECT count(*) AS n, count(*) FILTER (event_id % 4 <> 0) AS d FROM events)
    SELECT 'deep' AS "column", 'CONST' AS encoding,
      (4 + ceil(n / 8.0) + 1 + 4 * 2 + ceil(2 * d / 8.0) + ceil(3 * d / 8.0) + 8 * d + ceil(2 * d / 8.0))::BIGINT AS bytes FROM e"""
)
def pages_nested(spark, sf_dir):
    """A column of ARRAYs of ARRAYs: constant outer lengths, two inner lengths of one bit, and the values, all nullable."""
    rows = _nested_rows(spark, sf_dir).withColumn("event_id", F.col("event_id").cast("long"))
    return layout.pages(rows, ["deep"]).select("column", "encoding", "bytes")


@query(
    """WITH b AS (SELECT count(*) AS n, count(*) FILTER (event_id % 4 <> 0) AS d FROM events)
    SELECT 'deep' AS "column", (4 + ceil(n / 8.0) + 1 + 4 * 2 + ceil(2 * d / 8.0) + ceil(3 * d / 8.0) + 8 * d + ceil(2 * d / 8.0)
      + 1 + 1 + 2
      + CASE WHEN 3 * d < 128 THEN 1 WHEN 3 * d < 16384 THEN 2 WHEN 3 * d < 2097152 THEN 3 ELSE 4 END
      + CASE WHEN 2 * d < 128 THEN 1 WHEN 2 * d < 16384 THEN 2 WHEN 2 * d < 2097152 THEN 3 ELSE 4 END)::BIGINT AS bytes,
      false AS approximate FROM b"""
)
def column_size_nested(spark, sf_dir):
    """The only column of its bucket: its bytes, two header bits bytes, and the header of two children."""
    rows = _nested_rows(spark, sf_dir).select("deep", "row_group")
    return layout.column_sizes(rows, Options(compression="none"))


#: Columns of the wide example, each the key plus its number.
WIDE = 300


@query(
    f"""WITH n AS (SELECT count(*) AS n FROM nation)
    SELECT b::INT AS bucket, 'Monolithic' AS kind, (sum(CASE WHEN c % 2 = 0 THEN 4 ELSE 8 * n END) + ceil(2 * count(*) / 8.0) + ceil(count(*) / 8.0))::BIGINT AS bytes,
      count(*)::INT AS n_columns
    FROM (SELECT c, n, ((row_number() OVER (ORDER BY 'c' || lpad(c::VARCHAR, 4, '0')) - 1) * 7 // {WIDE}) AS b FROM range({WIDE}) AS r(c), n) GROUP BY 1"""
)
def buckets_wide(spark, sf_dir):
    """Even columns are constant ints, odd ones distinct longs."""
    made = [
        (F.lit(c) if c % 2 == 0 else F.col("n_nationkey").cast("long") + F.lit(c).cast("long")).alias(f"c{c:04d}") for c in range(WIDE)
    ]
    rows = _t(spark, sf_dir, "nation").select(F.lit(0).alias("row_group"), *made)
    found = layout.buckets(rows, Options(num_buckets=7))
    return found.select("bucket", "kind", "bytes", F.size("columns").alias("n_columns"))


# Nested columns of any depth.


@query(
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 0 ELSE 2 END AS n,
      CASE WHEN event_id % 7 <> 0 THEN CASE WHEN event_id % 5 = 0 THEN '' ELSE concat_ws('|', event_type, user_id::VARCHAR) END END AS shown FROM events"""
)
def table_project_one_array(spark, sf_dir):
    """A written table with several nested columns; null and empty ones differ."""
    rows = _nested_rows(spark, sf_dir).drop("row_group")
    path = _once(spark, sf_dir, "nested", lambda p: write_table(rows, p))
    tags = WideTable.open(spark, path).project("event_id", "tags").df
    return tags.select("event_id", F.when(F.col("tags").isNotNull(), F.size("tags")).alias("n"), F.array_join("tags", "|").alias("shown"))

_DEEP = "CASE WHEN event_id % 4 <> 0 THEN [[event_id::BIGINT, NULL], [], NULL] END"


@query(
    """SELECT event_id, 'deep' AS part, 0 AS depth, CASE WHEN event_id % 4 <> 0 THEN 3 END::BIGINT AS v FROM events
    UNION ALL SELECT event_id, 'deep.element', 1, unnest([2, 0, NULL])::BIGINT FROM events WHERE event_id % 4 <> 0
    UNION ALL SELECT event_id, 'deep.element.element', 2, unnest([event_id::BIGINT, NULL]) FROM events WHERE event_id % 4 <> 0"""
)
def nested_shred(spark, sf_dir):
    parts = nested.shred(_nested_rows(spark, sf_dir), "event_id", "deep")
    out = None
    for name, df in parts.items():
        own = df.select(F.col("key").alias("event_id"), F.lit(name).alias("part"), F.size("at").alias("depth"), F.col("value").cast("long").alias("v"))
        out = own if out is None else out.union(own)
    return out


@query(
    """SELECT event_id, true AS same_deep, true AS same_tags, true AS same_props FROM events"""
)
def nested_gather(spark, sf_dir):
    rows = _nested_rows(spark, sf_dir)
    out = rows
    for c in ("deep", "tags", "props"):
        back = nested.gather(nested.shred(rows, "event_id", c), "event_id", c, rows.schema[c].dataType)
        out = out.join(back.withColumnRenamed(c, f"{c}_back"), "event_id")
    same = [F.col(f"{c}_back").eqNullSafe(F.col(c)).alias(f"same_{c}") for c in ("deep", "tags")]
    pairs = F.map_entries("props_back").eqNullSafe(F.map_entries("props")).alias("same_props")
    return out.select("event_id", *same, pairs)


@query(f"SELECT event_id, len({_DEEP})::INT AS n FROM events")
def array_lengths_with_nulls(spark, sf_dir):
    return nested.lengths(_nested_rows(spark, sf_dir), "event_id", "deep").withColumnRenamed("length", "n")


# Imports. Texts are written from the given tables, one file each.


def _text_file(spark: SparkSession, sf_dir: str, name: str, lines: DataFrame, head: str = "") -> str:
    """One file of these lines (a column `line`), after a head. One task writes as it reads: it sorts and holds nothing."""

    def make(path: str) -> None:
        one = lines.select("line").repartition(1)
        if head and lines.isEmpty():
            one = spark.createDataFrame([(head,)], "line string").coalesce(1)
        elif head:  # before the first row of the only partition
            headed = F.concat(F.lit(head + "\n"), F.coalesce("line", F.lit("")))
            one = one.select(F.when(F.monotonically_increasing_id() == 0, headed).otherwise(F.col("line")).alias("line"))
        one.write.text(path)

    folder = _once(spark, sf_dir, name, make)
    fs, p = files._fs(spark, folder)
    (part,) = [s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")]
    return part


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_import_types(spark, sf_dir):
    line = F.concat_ws(",", "c_custkey", F.concat(F.lit('"'), F.col("c_name"), F.lit('"')), "c_acctbal", "c_mktsegment")
    path = _text_file(spark, sf_dir, "customer-csv", _t(spark, sf_dir, "customer").select(line.alias("line")), "c_custkey,c_name,c_acctbal,c_mktsegment")
    return import_csv(spark, [path])


@query("""SELECT n_nationkey, n_name || chr(10) || 'says "' || n_name || '", ' || chr(10) AS said, n_regionkey FROM nation""")
def csv_quoted_newlines(spark, sf_dir):
    said = F.concat(F.lit('"'), F.col("n_name"), F.lit('\nsays ""'), F.col("n_name"), F.lit('"", \n"'))
    line = F.concat_ws(",", "n_nationkey", said, "n_regionkey")
    path = _text_file(spark, sf_dir, "said-csv", _t(spark, sf_dir, "nation").select(line.alias("line")), "n_nationkey,said,n_regionkey")
    return import_csv(spark, [path])


@query("""SELECT n_nationkey AS id, n_name || chr(10) || 'x' AS said FROM nation""")
def csv_skipped_lines(spark, sf_dir):
    """A preamble, a delimiter and quotes of its own, a header that is given, and values over two lines."""
    line = F.concat_ws("|", "n_nationkey", F.concat(F.lit("'"), F.col("n_name"), F.lit("\nx'")))
    path = _text_file(spark, sf_dir, "skipped-csv", _t(spark, sf_dir, "nation").select(line.alias("line")), "not a header\nnor this")
    return import_csv(spark, [path], Dialect(delimiter="|", quote="'", header="id|said", skip_lines=2))


@query(
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('day', ts) ELSE ts END AS at
    FROM (SELECT event_id, make_timestamp(1700000000000000 + event_id * 3723000000) AS ts FROM events)"""
)
def csv_dates_with_timestamps(spark, sf_dir):
    ts = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("event_id") * 3_723_000_000)
    text = F.when(F.col("event_id") % 2 == 0, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
    line = F.concat_ws(",", "event_id", text)
    path = _text_file(spark, sf_dir, "dates-csv", _t(spark, sf_dir, "events").select(line.alias("line")), "event_id,at")
    return import_csv(spark, [path])


@query(
    """SELECT event_id, (1700000000000 + event_id * 1001)::BIGINT AS millis, (event_id % 1000000)::INT AS nanos_of_milli FROM events"""
)
def csv_nanoseconds(spark, sf_dir):
    """Nanoseconds of the present day, above what a double holds."""
    ms = F.lit(1_700_000_000_000) + F.col("event_id") * 1001
    ts = F.timestamp_millis(ms)
    below = F.format_string("%03d%06d", F.pmod(ms, F.lit(1000)), F.col("event_id") % 1_000_000)
    line = F.concat(F.col("event_id").cast("string"), F.lit(","), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), below)
    path = _text_file(spark, sf_dir, "nanos-csv", _t(spark, sf_dir, "events").select(line.alias("line")), "event_id,at")
    return import_csv(spark, [path]).select("event_id", "at.millis", "at.nanos_of_milli")


@query(
    """SELECT c_custkey AS id, c_name AS name, NULL::DOUBLE AS balance, 1.0::DOUBLE AS v FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_acctbal, 2.5 FROM supplier"""
)
def csv_union_by_name(spark, sf_dir):
    """Two files with their columns in different order; one lacks a column; whole numbers meet fractions."""
    a = _t(spark, sf_dir, "customer").select(F.concat_ws(",", "c_custkey", "c_name", F.lit("1")).alias("line"))
    b = _t(spark, sf_dir, "supplier").select(F.concat_ws(",", F.lit("2.5"), "s_acctbal", "s_suppkey", "s_name").alias("line"))
    paths = [_text_file(spark, sf_dir, "union-a", a, "id,name,v"), _text_file(spark, sf_dir, "union-b", b, "v,balance,id,name")]
    return import_csv(spark, paths, require=["id"]).select("id", "name", "balance", "v")


@query("SELECT r_regionkey AS field_0, r_name AS field_1 FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def csv_without_headers(spark, sf_dir):
    a = _t(spark, sf_dir, "region").select(F.concat_ws(",", "r_regionkey", "r_name").alias("line"))
    b = _t(spark, sf_dir, "nation").select(F.concat_ws(",", "n_nationkey", "n_name").alias("line"))
    paths = [_text_file(spark, sf_dir, "plain-a", a), _text_file(spark, sf_dir, "plain-b", b)]
    return import_csv(spark, paths, Dialect(no_header=True))


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def json_import_rows(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = _text_file(spark, sf_dir, "orders-json", ndjson(rows))
    return import_json(spark, path)


@query("SELECT n_name, n_nationkey FROM nation")
def json_import_projected(spark, sf_dir):
    """Fields that are not asked for are not checked: x would be refused."""
    x = F.when(F.col("n_nationkey") % 2 == 0, "9007199254740993").otherwise("1.5")
    line = F.concat(F.lit('{"n_nationkey":'), F.col("n_nationkey"), F.lit(',"x":'), x, F.lit(',"n_name":"'), F.col("n_name"), F.lit('"}'))
    path = _text_file(spark, sf_dir, "projected-json", _t(spark, sf_dir, "nation").select(line.alias("line")))
    return import_json(spark, path, ["n_name,n_nationkey"])


@query("SELECT vec_id, len(embedding)::INT AS n, true AS same FROM embeddings")
def json_import_arrays(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    back = import_json(spark, _text_file(spark, sf_dir, "arrays-json", ndjson(rows)))
    met = rows.join(back.withColumnRenamed("e", "b"), "vec_id")
    return met.select("vec_id", F.size("b").alias("n"), F.col("b").eqNullSafe(F.col("e")).alias("same"))


@query(_all_refused("ragged long_row twice empty_name zone inexact infinite nan incompatible no_data unknown_required two_bytes both_headers", "plain"))
def csv_refusals(spark, sf_dir):
    def of(name: str, text: str, **options) -> Callable:
        def run():
            head, *rest = text.split("\n")
            lines = spark.createDataFrame([(x,) for x in rest if x], "line string")
            return import_csv(spark, [_text_file(spark, sf_dir, f"bad-{name}", lines, head)], **options)

        return run

    return _refused(
        spark,
        {
            "plain": of("plain", "a,b\n1,2\n"),
            "ragged": of("ragged", "a,b\n1,2\n3\n"),
            "long_row": of("long", "a,b\n1,2\n3,4,5\n"),
            "twice": of("twice", "a,a\n1,2\n"),
            "empty_name": of("unnamed", ",a\n1,2\n"),
            "zone": of("zone", "t\n2026-08-20T12:34:56+08:00\n"),
            "inexact": of("inexact", "v\n1.5\n9007199254740993\n"),
            "infinite": of("infinite", "v\n1.5\n1e400\n"),
            "nan": of("nan", "v\n1.5\nNaN\n"),
            "incompatible": lambda: import_csv(
                spark,
                [
                    _text_file(spark, sf_dir, "bad-one", spark.createDataFrame([("1",)], "line string"), "a"),
                    _text_file(spark, sf_dir, "bad-two", spark.createDataFrame([("x",)], "line string"), "a"),
                ],
            ),
            "no_data": of("nothing", "a,b"),
            "unknown_required": of("plain", "a,b\n1,2\n", require=["c"]),
            "two_bytes": of("plain", "a,b\n1,2\n", dialect=Dialect(delimiter="||")),
            "both_headers": of("plain", "a,b\n1,2\n", dialect=Dialect(no_header=True, header="a,b")),
        },
    )


@query(_all_refused("inexact in_array infinite null_only over_lines too_deep struct unknown folder", "exact plain"))
def json_refusals(spark, sf_dir):
    def of(name: str, *lines: str, **options) -> Callable:
        def run():
            rows = spark.createDataFrame([(x,) for x in lines], "line string")
            return import_json(spark, _text_file(spark, sf_dir, f"bad-json-{name}", rows), **options)

        return run

    return _refused(
        spark,
        {
            "plain": of("plain", '{"v":1}', '{"v":2.5}'),
            "exact": of("exact", '{"v":1.5}', '{"v":18446744073709551616}'),
            "inexact": of("inexact", '{"v":1.5}', '{"v":9007199254740993}'),
            "in_array": of("in_array", '{"v":[1.5]}', '{"v":[9007199254740993]}'),
            "infinite": of("infinite", '{"v":1e400}'),
            "null_only": of("null_only", '{"a":1,"v":null}'),
            "over_lines": of("over_lines", "{", '"v":1', "}"),
            "too_deep": of("too_deep", '{"v":' + "[" * 200 + "1" + "]" * 200 + "}"),
            "struct": of("struct", '{"v":{"a":1}}'),
            "unknown": of("plain", '{"v":1}', '{"v":2.5}', columns=["w"]),
            "folder": lambda: import_json(spark, _orders(spark, sf_dir).path),
        },
    )


# The writer.


@query(
    _all_refused(
        "other_name other_type other_count null_in_required existing unknown_stats stats_of_binary unknown_codec twice "
        "unnamed no_struct nested_key unknown_column text_order no_table closed",
        "good",
    )
)
def writer_refusals(spark, sf_dir):
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("s", T.StringType())])
    good = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("s"))

    def write(df: DataFrame, schema: T.StructType = schema, options: Options = Options()) -> Callable:
        def run():
            with Writer(spark, _place(spark, "try"), schema, options) as w:
                w.append(df)

        return run

    def of_null():
        try:
            write(good.withColumn("id", F.when(F.col("id") > 3, F.col("id"))))()
        except TableError:
            raise
        except Exception as e:
            raise TableError(str(e)) from e

    def closed():
        w = Writer(spark, _place(spark, "try"), schema)
        w.append(good)
        w.close()
        w.append(good)

    types = {"twice": [("a", T.LongType())] * 2, "unnamed": [("", T.LongType())], "no_struct": [("a", T.StructType([T.StructField("x", T.LongType())]))]}
    types["nested_key"] = [("m", T.MapType(T.ArrayType(T.LongType()), T.LongType()))]
    schemas = {n: T.StructType([T.StructField(c, t) for c, t in cols]) for n, cols in types.items()}
    binary = T.StructType([T.StructField("b", T.BinaryType())])
    t = _nation(spark, sf_dir)
    return _refused(
        spark,
        {
            "good": write(good),
            "other_name": write(good.toDF("id", "t")),
            "other_type": write(good.withColumn("id", F.col("id").cast("int"))),
            "other_count": write(good.select("id")),
            "null_in_required": of_null,
            "existing": lambda: write_table(good, t.path),
            "unknown_stats": write(good, options=Options(stats_columns=("x",))),
            "stats_of_binary": write(good, binary, Options(stats_columns=("b",))),
            "unknown_codec": write(good, options=Options(compression="lz4")),
            **{n: (lambda s=s: check_schema(s)) for n, s in schemas.items()},
            "unknown_column": lambda: t.project("x"),
            "text_order": lambda: t.where("n_name>A"),
            "no_table": lambda: WideTable.open(spark, _place(spark, "none")),
            "closed": closed,
        },
    )


@query("SELECT (2 * count(*))::BIGINT AS n_rows, (2 * sum(n_nationkey))::BIGINT AS total, true AS estimated FROM nation")
def writer_batches(spark, sf_dir):
    """Two appends, an empty one between them, the second time over an old table."""
    rows = _t(spark, sf_dir, "nation")
    path = _place(spark, "twice")
    write_table(rows, path)
    with Writer(spark, path, rows.schema, overwrite=True) as w:
        w.append(rows)
        w.append(rows.limit(0))
        w.append(rows)
        size = w.estimated_size()
    back = read_table(spark, path)
    return back.agg(F.count("*").alias("n_rows"), F.sum("n_nationkey").cast("long").alias("total"), F.lit(size > 1024).alias("estimated"))


@query("SELECT event_id, event_type FROM events")
def stream_append_rows(spark, sf_dir):
    """A stream of files, appended batch by batch."""
    rows = _t(spark, sf_dir, "events").select("event_id", "event_type")

    def make(path: str) -> None:
        source = f"{path}-source"
        rows.repartition(3).write.parquet(source)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
        append_stream(stream, path, f"{path}-checkpoint").awaitTermination()

    path = _once(spark, sf_dir, "stream", make)
    out = None
    for t in batches(spark, path):
        out = t.df if out is None else out.union(t.df)
    return out


# Text.


@query(
    """SELECT n_regionkey AS row_group, true AS supported, '{"half":"' || string_agg((n_nationkey / 2)::VARCHAR, ',' ORDER BY n_nationkey)
    || '"}' AS line FROM nation GROUP BY 1"""
)
def text_json_doubles(spark, sf_dir):
    rows = _t(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("row_group"), "n_nationkey", (F.col("n_nationkey") / 2).alias("half"))
    return text_json(rows, "n_nationkey", columns=["half"])


@query("SELECT * FROM (VALUES ('a.JSON', true), ('b.ndjson', true), ('c.jsonl', true), ('d.csv', false), ('json', false)) AS v(name, is_json)")
def json_names(spark, sf_dir):
    given = ["a.JSON", "b.ndjson", "c.jsonl", "d.csv", "json"]
    return spark.createDataFrame([(n, is_json(n)) for n in given], "name string, is_json boolean")


@query(
    """SELECT '{"n_nationkey":' || n_nationkey || ',"odd":' || CASE WHEN n_nationkey % 2 = 1 THEN 'true' ELSE 'null' END || ',"half":'
      || (n_nationkey / 2)::VARCHAR || ',"list":' || CASE WHEN n_nationkey % 3 = 0 THEN '[]' ELSE '[' || n_nationkey || ',null]' END
      || ',"none":null,"bad":null}' AS line FROM nation"""
)
def ndjson_nulls_and_floats(spark, sf_dir):
    k = F.col("n_nationkey").cast("long")
    rows = _t(spark, sf_dir, "nation").select(
        k.alias("n_nationkey"),
        F.when(k % 2 == 1, F.lit(True)).alias("odd"),
        (k / 2).alias("half"),
        F.when(k % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(k, F.lit(None).cast("long"))).alias("list"),
        F.lit(None).cast("string").alias("none"),
        F.when(k % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("-inf"))).alias("bad"),
    )
    return ndjson(rows)


@query("SELECT n_nationkey::VARCHAR AS id, replace(n_name, 'A', chr(65533)) AS name, '' AS none, '<List(Int64)>' AS list FROM nation")
def table_cells(spark, sf_dir):
    return cells(
        _t(spark, sf_dir, "nation").select(
            F.col("n_nationkey").alias("id"),
            F.replace("n_name", F.lit("A"), F.lit("\x07")).alias("name"),
            F.lit(None).cast("double").alias("none"),
            F.array(F.col("n_nationkey").cast("long")).alias("list"),
        )
    )


def _cli_lines(spark: SparkSession, *argv: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in cli.run(spark, list(argv)).splitlines()], "line string")


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS line FROM nation WHERE n_nationkey >= 20""")
def cli_cat_json(spark, sf_dir):
    return _cli_lines(spark, "cat", _nation(spark, sf_dir).path, "-c", "n_nationkey,n_name", "--where", "n_nationkey>=20", "--json")


@query("SELECT count(*)::VARCHAR AS line FROM orders")
def cli_count(spark, sf_dir):
    return _cli_lines(spark, "count", _orders(spark, sf_dir).path)


@query(
    """WITH w AS (SELECT greatest(max(length(n_name)), 6)::INT AS w FROM nation)
    SELECT '| ' || rpad(n_name, w, ' ') || ' |' AS line FROM nation, w UNION ALL SELECT '| ' || rpad('n_name', w, ' ') || ' |' FROM w
    UNION ALL SELECT '+' || repeat('-', w + 2) || '+' FROM w, range(3)"""
)
def cli_cat_text(spark, sf_dir):
    return _cli_lines(spark, "cat", _nation(spark, sf_dir).path, "-c", "n_name")


# Scalars.


@query(
    """SELECT event_id, (1700000000000 + event_id)::BIGINT AS millis, (event_id * 7 % 1000000)::INT AS nanos_of_milli FROM events
    UNION ALL SELECT -1, -9223372036855, 224192 UNION ALL SELECT -2, 9223372036854, 775807"""
)
def ts_split_present_day(spark, sf_dir):
    ns = (F.lit(1_700_000_000_000) + F.col("event_id")) * F.lit(1_000_000) + F.col("event_id") * 7 % 1_000_000
    rows = _t(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("event_id"), ns.cast("long").alias("ns"))
    ends = spark.createDataFrame([(-1, -(1 << 63)), (-2, (1 << 63) - 1)], "event_id long, ns long")
    split = rows.union(ends).select("event_id", scalars.split_nanos(F.col("ns")).alias("s"))
    return split.select("event_id", "s.millis", "s.nanos_of_milli")


@query("SELECT n_nationkey::BIGINT AS nth, (1152921504606846975 // 25 + CASE WHEN n_nationkey <= 1152921504606846975 % 25 THEN 1 ELSE 0 END)::BIGINT AS share FROM nation")
def even_split_large(spark, sf_dir):
    nth = F.col("n_nationkey").cast("long")
    return _t(spark, sf_dir, "nation").select(nth.alias("nth"), layout.even_share(F.lit((1 << 60) - 1), F.lit(25), nth).alias("share"))


@query("SELECT event_id, ((1152921504606846977 + event_id) // 1000)::BIGINT AS row_group FROM events")
def row_group_of_large_keys(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", (F.lit((1 << 60) + 1) + F.col("event_id")).alias("key"))
    return stats.by_key(rows, "key", 1000).select("event_id", "row_group")


@query("SELECT doc_id, doc_id % 3 <> 0 AS valid FROM documents")
def utf8_invalid(spark, sf_dir):
    raw = F.col("text").cast("binary")
    bad = F.concat(raw, F.unhex(F.lit("C328")))
    return _t(spark, sf_dir, "documents").select(
        "doc_id", scalars.valid_utf8(F.when(F.col("doc_id") % 3 == 0, bad).otherwise(raw)).alias("valid")
    )


@query("SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE::VARCHAR AS shown FROM lineitem")
def double_texts(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.double_text(F.col("l_quantity").cast("double")).alias("shown"))


@query("SELECT event_id, (1700000000000000000 + event_id)::BIGINT AS ns FROM events")
def ts_join_nanos(spark, sf_dir):
    ns = F.lit(1_700_000_000_000_000_000) + F.col("event_id")
    split = _t(spark, sf_dir, "events").select("event_id", scalars.split_nanos(ns).alias("s"))
    return split.select("event_id", scalars.join_nanos(F.col("s.millis"), F.col("s.nanos_of_milli")).alias("ns"))


@query(
    """SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT, 'zstd', 1024::BIGINT), (0, 1000, 'zstd', 1324), (10, 1000, 'none', 2034), (500, 1000, 'half', 2024)) AS v(written, buffered, how, bytes)"""
)
def estimated_sizes(spark, sf_dir):
    cases = [(0, 0, "zstd", None), (0, 1000, "zstd", None), (10, 1000, "none", None), (500, 1000, "half", 0.5)]
    rows = [(w, b, how, layout.estimated_size(w, b, r, how)) for w, b, how, r in cases]
    return spark.createDataFrame(rows, "written long, buffered long, how string, bytes long")
