"""The registered queries of the wide-table engine, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .functions.render import ndjson, text_json, text_json_support
from .operators import layout, nested, stats
from .operators.layout import Options
from .operators.predicate import bind, parse_where
from .plans import prune
from .sources import csv_import

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Keys of a row group in the examples: whole numbers of a dense key.
ORDERS_GROUP = 4000
LINES_GROUP = 2000


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _where(df: DataFrame, condition: str) -> DataFrame:
    return df.where(bind(df.schema, parse_where(condition)))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_key(_t(spark, sf_dir, "orders"), "o_orderkey", ORDERS_GROUP)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_key(_t(spark, sf_dir, "lineitem"), "l_orderkey", LINES_GROUP)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _where(_t(spark, sf_dir, "orders"), "o_orderkey>100")
    return rows.select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(100)


@query("SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderkey > 100")
def cat_project_where_int(spark, sf_dir):
    return _where(_t(spark, sf_dir, "orders"), "o_orderkey>100").select("o_custkey", "o_orderpriority")


@query("SELECT event_id, event_type FROM events WHERE event_type IS NOT NULL AND event_type <> 'click'")
def where_ne_excludes_null(spark, sf_dir):
    return _where(_t(spark, sf_dir, "events"), "event_type != click").select("event_id", "event_type")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def where_string_eq(spark, sf_dir):
    return _where(_t(spark, sf_dir, "orders"), "o_orderstatus=F").select("o_orderkey", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount = 0.07::DOUBLE AND NOT isnan(l_discount)")
def where_float_exact(spark, sf_dir):
    return _where(_t(spark, sf_dir, "lineitem"), "l_discount=0.07").select("l_orderkey", "l_linenumber", "l_discount")


@query("""SELECT p_partkey FROM part WHERE p_retailprice::FLOAT >= 915.1::FLOAT""")
def where_float32_rounds_literal(spark, sf_dir):
    part = _t(spark, sf_dir, "part").withColumn("price", F.col("p_retailprice").cast("float"))
    return _where(part, "price>=915.1").select("p_partkey")


@query(
    """SELECT o_orderkey, o_orderkey + 1700000000000000001 AS big FROM orders
    WHERE o_orderkey + 1700000000000000001 = 1700000000000000101"""
)
def where_bigint_exact(spark, sf_dir):
    wide = _t(spark, sf_dir, "orders").withColumn("big", F.col("o_orderkey") + 1700000000000000001)
    return _where(wide, "big=1700000000000000101").select("o_orderkey", "big")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL")
def where_out_of_range_literal(spark, sf_dir):
    return _where(_t(spark, sf_dir, "orders"), "o_orderkey<99999999999999999999").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS shipped FROM lineitem WHERE l_shipdate::DATE >= DATE '1996-02-29'")
def where_date_iso(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").withColumn("shipped", F.col("l_shipdate").cast("date"))
    return _where(rows, "shipped>=1996-02-29").select("l_orderkey", "l_linenumber", F.col("shipped").cast("string"))


@query("SELECT o_orderkey FROM orders WHERE false")
def where_unparsable_eq_empty(spark, sf_dir):
    return _where(_t(spark, sf_dir, "orders"), "o_orderkey=abc").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL")
def where_unparsable_ne_all(spark, sf_dir):
    return _where(_t(spark, sf_dir, "orders"), "o_orderkey!=abc").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 150000")
def where_boolean(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").withColumn("dear", F.col("o_totalprice") > 150000)
    return _where(rows, "dear=true").select("o_orderkey")


@query("SELECT event_id FROM events WHERE value IS NOT NULL AND event_id % 3 = 0 OR value <> 5 AND event_id % 3 <> 0")
def where_nan_matches_only_ne(spark, sf_dir):
    nan = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    rows = _t(spark, sf_dir, "events").withColumn("v", F.when(F.col("value").isNotNull(), nan))
    return _where(rows, "v!=5").select("event_id")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10")
def head_ordered(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", "c_name").orderBy("c_custkey").limit(10)


@query("SELECT c_name FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 7")
def limit_after_filter(spark, sf_dir):
    rows = _where(_t(spark, sf_dir, "customer"), "c_acctbal>0")
    return rows.orderBy("c_custkey").limit(7).select("c_name")


@query("SELECT count(*) AS n_rows FROM lineitem")
def count_rows(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").agg(F.count("*").alias("n_rows"))


@query(f"SELECT l_orderkey // {LINES_GROUP} AS row_group, count(*) AS n_rows FROM lineitem GROUP BY 1")
def count_per_row_group(spark, sf_dir):
    return stats.row_group_rows(_lines(spark, sf_dir)).withColumnRenamed("rows", "n_rows")


@query("SELECT count(*) AS n_rows FROM nation")
def empty_projection_count(spark, sf_dir):
    return _t(spark, sf_dir, "nation").select().agg(F.count("*").alias("n_rows"))


_STAT = """SELECT {g} AS row_group, '{c}' AS "column", count(*) AS "rows", count(*) - count({c}) AS nulls,
  min({v})::VARCHAR AS min, max({v})::VARCHAR AS max FROM {t} GROUP BY 1"""


def _stat_sql(t: str, g: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(_STAT.format(g=g, c=c, v=v, t=t) for c, v in columns.items())


@query(
    _stat_sql(
        "orders",
        f"o_orderkey // {ORDERS_GROUP}",
        {"o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "o_orderstatus": "o_orderstatus", "o_orderdate": "epoch_us(o_orderdate)"},
    )
)
def rg_stats_long(spark, sf_dir):
    return stats.row_group_stats(_orders(spark, sf_dir), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"])


@query(
    _stat_sql(
        "lineitem",
        f"l_orderkey // {LINES_GROUP}",
        {"l_partkey": "l_partkey", "l_linenumber": "l_linenumber", "l_returnflag": "l_returnflag"},
    )
)
def rg_stats_lineitem(spark, sf_dir):
    return stats.row_group_stats(_lines(spark, sf_dir), ["l_partkey", "l_linenumber", "l_returnflag"])


@query(
    f"""SELECT row_group, min = 'nan' OR max = 'nan' AS nan_first FROM (
      SELECT o_orderkey // {ORDERS_GROUP} AS row_group,
        CASE WHEN arg_min(o_orderkey % 5 = 0, o_orderkey) THEN 'nan' ELSE '' END AS min,
        CASE WHEN arg_min(o_orderkey % 5 = 0, o_orderkey) THEN 'nan' ELSE '' END AS max
      FROM orders GROUP BY 1)"""
)
def rg_stats_nan_first(spark, sf_dir):
    nan = F.when(F.col("o_orderkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    found = stats.row_group_stats(_orders(spark, sf_dir).withColumn("v", nan), ["v"], position="o_orderkey")
    return found.select("row_group", ((F.col("min") == "NaN") & (F.col("max") == "NaN")).alias("nan_first"))


@query(
    f"""SELECT o_orderkey // {ORDERS_GROUP} AS row_group FROM orders GROUP BY 1
    HAVING max(o_orderkey) >= 9000 AND min(o_orderkey) <= 9000"""
)
def rg_prune_kept(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    found = stats.row_group_stats(rows, ["o_orderkey"])
    return prune.kept_row_groups(found, rows.schema, parse_where("o_orderkey=9000"))


_LINE_COLUMNS = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus "
    "l_shipdate"
).split()
_NAMED = " UNION ALL ".join(f"SELECT '{n}' AS name, {k} AS position" for k, n in enumerate(_LINE_COLUMNS))


@query(f"SELECT name, position::INT AS position, ((row_number() OVER (ORDER BY name) - 1) * 4 // 11)::INT AS bucket FROM ({_NAMED})")
def schema_buckets(spark, sf_dir):
    schema = _t(spark, sf_dir, "lineitem").schema
    return layout.schema_report(spark, schema, Options(num_buckets=4)).select("name", "position", "bucket")


@query(
    f"""SELECT bucket, string_agg(name, ',' ORDER BY name) AS members FROM (
    SELECT name, ((row_number() OVER (ORDER BY name) - 1) * 4 // 11)::INT AS bucket FROM ({_NAMED})) GROUP BY 1"""
)
def bucket_members(spark, sf_dir):
    report = layout.schema_report(spark, _t(spark, sf_dir, "lineitem").schema, Options(num_buckets=4))
    names = F.array_join(F.sort_array(F.collect_list("name")), ",")
    return report.groupBy("bucket").agg(names.alias("members"))


def _encoding_sql(t: str, g: str, columns: dict[str, int | None]) -> str:
    """width, or None for text: its bytes and a length prefix."""
    parts = []
    for c, w in columns.items():
        size = str(w) if w else f"(strlen({c}) + CASE WHEN strlen({c}) < 128 THEN 1 WHEN strlen({c}) < 16384 THEN 2 ELSE 3 END)"
        parts.append(
            f"SELECT {g} AS row_group, '{c}' AS col, {c}::VARCHAR AS v, count(*) AS n, any_value({size})::BIGINT AS size, "
            f"{str(bool(w and w <= 8)).lower()} AS short FROM {t} GROUP BY 1, 2, 3"
        )
    return f"""
WITH v AS ({' UNION ALL '.join(parts)}),
f AS (SELECT row_group, col, any_value(short) AS short, sum(n)::BIGINT AS total,
       coalesce(sum(n) FILTER (v IS NOT NULL), 0)::BIGINT AS non_null,
       count(*) FILTER (v IS NOT NULL) AS n, coalesce(sum(n * size) FILTER (v IS NOT NULL), 0)::BIGINT AS plain_bytes,
       coalesce(sum(size) FILTER (v IS NOT NULL), 0)::BIGINT AS entries FROM v GROUP BY 1, 2),
d AS (SELECT *, (CASE WHEN n < 128 THEN 1 WHEN n < 16384 THEN 2 WHEN n < 2097152 THEN 3 ELSE 4 END + entries
       + ceil(non_null * CASE WHEN n > 1 THEN length(bin(n - 1)) ELSE 0 END / 8.0))::BIGINT AS dict_bytes FROM f)
SELECT row_group, col AS "column", total AS "rows", non_null, CASE WHEN n <= 255 THEN n END AS "distinct", plain_bytes,
  CASE WHEN n <= 255 THEN dict_bytes END AS dict_bytes,
  CASE WHEN non_null = 0 THEN 'ALL_NULL' WHEN n = 1 THEN 'CONST'
       WHEN n <= 255 AND (short OR entries <= 32768) AND dict_bytes < plain_bytes THEN 'DICT' ELSE 'PLAIN' END AS encoding,
  non_null < total AS has_nulls FROM d"""


_ORDER_WIDTHS = {"o_orderkey": 8, "o_custkey": 8, "o_orderstatus": None, "o_orderpriority": None}


@query(_encoding_sql("orders", f"o_orderkey // {ORDERS_GROUP}", _ORDER_WIDTHS))
def encoding_choice(spark, sf_dir):
    return layout.encodings(_orders(spark, sf_dir), list(_ORDER_WIDTHS)).drop("bytes")


_LINE_WIDTHS = {"l_linenumber": 4, "l_suppkey": 8, "l_returnflag": None, "l_linestatus": None}


@query(_encoding_sql("lineitem", f"l_orderkey // {LINES_GROUP}", _LINE_WIDTHS))
def encoding_choice_lineitem(spark, sf_dir):
    return layout.encodings(_lines(spark, sf_dir), list(_LINE_WIDTHS)).drop("bytes")


@query(
    f"""SELECT row_group, (row_number() OVER (PARTITION BY row_group ORDER BY seen, value) - 1)::INT AS nth, value FROM (
      SELECT o_orderkey // {ORDERS_GROUP} AS row_group, o_orderpriority AS value, min(o_orderkey) AS seen
      FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1, 2)"""
)
def dictionary_entries(spark, sf_dir):
    return layout.dictionary(_orders(spark, sf_dir), "o_orderpriority", "o_orderkey")


@query(
    """SELECT 'l_linenumber' AS "column", 4 * count(l_linenumber) AS bytes FROM lineitem
    UNION ALL SELECT 'l_shipdate', 8 * count(l_shipdate) FROM lineitem
    UNION ALL SELECT 'l_returnflag', sum(strlen(l_returnflag) + 1)::BIGINT FROM lineitem"""
)
def column_plain_bytes(spark, sf_dir):
    found = layout.encodings(_lines(spark, sf_dir), ["l_linenumber", "l_shipdate", "l_returnflag"])
    return found.groupBy("column").agg(F.sum("plain_bytes").alias("bytes"))


@query(
    f"""SELECT name, (t // 11 + CASE WHEN nth <= t % 11 THEN 1 ELSE 0 END)::BIGINT AS share FROM
    (SELECT name, row_number() OVER (ORDER BY name) AS nth FROM ({_NAMED})), (SELECT count(*) AS t FROM lineitem)"""
)
def even_split_bytes(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem")
    names = spark.createDataFrame([(n, k + 1) for k, n in enumerate(sorted(df.columns))], "name string, nth int")
    total = df.agg(F.count("*").alias("t")).first()[0]
    return names.select("name", layout.even_share(F.lit(total), F.lit(11), F.col("nth")).alias("share"))


@query(
    f"""WITH RECURSIVE b AS (SELECT l_orderkey // {LINES_GROUP} AS batch, count(*) AS n_rows,
      (count(*) * (8 + 4 + 1))::BIGINT AS bytes FROM lineitem GROUP BY 1),
    o AS (SELECT *, row_number() OVER (ORDER BY batch) AS k FROM b),
    r AS (SELECT k, batch, n_rows, bytes, 0::BIGINT AS row_group, bytes AS held FROM o WHERE k = 1 UNION ALL
      SELECT o.k, o.batch, o.n_rows, o.bytes, r.row_group + CASE WHEN r.held >= 250000 THEN 1 ELSE 0 END,
        o.bytes + CASE WHEN r.held >= 250000 THEN 0 ELSE r.held END FROM r JOIN o ON o.k = r.k + 1)
    SELECT batch, n_rows, bytes, row_group FROM r"""
)
def row_group_running_split(spark, sf_dir):
    rows = stats.by_key(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", LINES_GROUP, "batch")
    sized = layout.batch_bytes(rows, "batch", Options(num_buckets=1))
    return layout.running_split(sized, "batch", 250_000).withColumnRenamed("rows", "n_rows")


@query("SELECT vec_id, len(embedding)::INT AS length FROM embeddings")
def array_lengths(spark, sf_dir):
    return nested.lengths(_t(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query("SELECT vec_id, (unnest(range(1, len(embedding) + 1)) - 1)::INT AS pos, unnest(embedding) AS element FROM embeddings")
def array_flatten(spark, sf_dir):
    return nested.flatten(_t(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query("SELECT vec_id, len(embedding)::INT AS n, true AS same FROM embeddings")
def array_reassemble(spark, sf_dir):
    df = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    back = nested.reassemble(nested.lengths(df, "vec_id", "embedding"), nested.flatten(df, "vec_id", "embedding"), "vec_id", "back")
    met = df.join(back, "vec_id")
    return met.select("vec_id", F.size("back").alias("n"), F.col("back").eqNullSafe(F.col("embedding")).alias("same"))


@query(
    """SELECT event_id, 0 AS pos, 'type' AS map_key, event_type AS map_value FROM events
    UNION ALL SELECT event_id, 1, 'user', user_id::VARCHAR FROM events"""
)
def map_entries_flatten(spark, sf_dir):
    made = F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    rows = _t(spark, sf_dir, "events").select("event_id", made.alias("m"))
    return nested.flatten(rows, "event_id", "m")


@query(
    """SELECT n_regionkey AS row_group, true AS supported, '{"n_nationkey":"' || string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey)
    || '","n_name":"' || string_agg(coalesce(n_name, ''), ',' ORDER BY n_nationkey) || '"}' AS line FROM nation GROUP BY 1"""
)
def text_json_columns(spark, sf_dir):
    rows = _t(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "row_group")
    return text_json(rows, "n_nationkey", columns=["n_nationkey", "n_name"])


@query("SELECT o_orderkey // 4000 AS row_group, NOT bool_or(o_orderkey % 7000 = 0) AS supported FROM orders GROUP BY 1")
def text_json_unsupported(spark, sf_dir):
    bad = F.when(F.col("o_orderkey") % 7000 == 0, F.lit(float("inf"))).otherwise(F.col("o_totalprice"))
    rows = _orders(spark, sf_dir).select("row_group", bad.alias("price"))
    return text_json_support(rows)


def _escape_sql(c: str) -> str:
    for raw, out in (("92", "\\\\"), ("34", '\\"'), ("8", "\\b"), ("12", "\\f"), ("10", "\\n"), ("13", "\\r"), ("9", "\\t")):
        c = f"replace({c}, chr({raw}), '{out}')"
    return c


@query(f"SELECT doc_id, md5({_escape_sql('text')}) AS escaped_md5 FROM documents")
def json_escape(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(scalars.json_string(F.col("text"))).alias("escaped_md5"))


@query(
    """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer
    UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier"""
)
def union_by_name(spark, sf_dir):
    a = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = _t(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT p_size::DOUBLE AS v FROM part UNION ALL SELECT p_retailprice FROM part")
def promote_int_float(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    shards = [part.select(F.col("p_size").cast("string").alias("v")), part.select(F.col("p_retailprice").cast("string").alias("v"))]
    fields = csv_import.merge_fields([csv_import.infer(s) for s in shards])
    kinds = [s.select(csv_import.convert(F.col("v"), fields[0].kind).cast(csv_import.spark_type(fields[0].kind)).alias("v")) for s in shards]
    return kinds[0].union(kinds[1])


@query(
    """SELECT event_id, tok FROM (SELECT event_id, (9007199254740990 + event_id)::VARCHAR AS tok FROM events)
    WHERE tok::HUGEINT <> tok::HUGEINT::DOUBLE::HUGEINT"""
)
def exact_promotion_violations(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", (F.lit(9007199254740990) + F.col("event_id")).cast("string").alias("tok"))
    return rows.where(scalars.inexact(F.col("tok")))


@query(
    """SELECT event_id, (ns - ((ns % 1000000) + 1000000) % 1000000) // 1000000 AS millis,
      (((ns % 1000000) + 1000000) % 1000000)::INT AS nanos_of_milli
    FROM (SELECT event_id, (event_id - 5000) * 1234567 AS ns FROM events)"""
)
def ts_split_millis_nanos(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", scalars.split_nanos((F.col("event_id") - 5000) * 1234567).alias("s"))
    return rows.select("event_id", "s.millis", "s.nanos_of_milli")


@query("SELECT o_orderkey, (o_orderdate::DATE - DATE '1970-01-01')::INT AS epoch_day FROM orders")
def iso_date_epoch_day(spark, sf_dir):
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    return _t(spark, sf_dir, "orders").select("o_orderkey", scalars.epoch_day(text).alias("epoch_day"))


@query("""SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS line FROM region""")
def ndjson_rows(spark, sf_dir):
    return ndjson(_t(spark, sf_dir, "region").select("r_regionkey", "r_name"))


@query("SELECT region.r_name, lower(hex(encode(r_name))) AS bytes_hex FROM region")
def hex_of_bytes(spark, sf_dir):
    return _t(spark, sf_dir, "region").select("r_name", scalars.hex_bytes(F.col("r_name").cast("binary")).alias("bytes_hex"))


@query("SELECT doc_id, true AS valid, octet_length(encode(text))::INT AS n_bytes FROM documents")
def utf8_valid(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return docs.select("doc_id", scalars.valid_utf8(F.col("text")).alias("valid"), F.octet_length("text").alias("n_bytes"))


@query("SELECT doc_id, md5(regexp_replace(text, '\\p{Cc}', chr(65533), 'g')) AS shown_md5 FROM documents")
def control_chars_replaced(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(scalars.strip_control(F.col("text"))).alias("shown_md5"))


@query("SELECT o_orderkey, o_totalprice::DECIMAL(18, 4)::VARCHAR AS price FROM orders")
def decimal_text(spark, sf_dir):
    price = F.col("o_totalprice").cast("decimal(18,4)")
    return _t(spark, sf_dir, "orders").select("o_orderkey", scalars.decimal_text(price).alias("price"))


def queries() -> dict[str, Query]:
    from . import registry_tables  # noqa: F401  # registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
