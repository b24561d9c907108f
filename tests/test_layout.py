import datetime
import decimal
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideframe.operators import layout, names, nested
from wideframe.operators.layout import Options, bucket_of, estimated_size
from wideframe.types import TableError, check_schema


def encoding(spark, kind, values, **options):
    df = spark.createDataFrame([(0, v) for v in values], f"row_group bigint, v {kind}")
    return layout.encodings(df, ["v"], Options(**options)).first()


def test_encodings(spark):
    assert encoding(spark, "int", [None, None]).encoding == "ALL_NULL"
    r = encoding(spark, "int", [7, None, 7])
    assert (r.encoding, r.has_nulls, r.bytes) == ("CONST", True, 5)
    assert encoding(spark, "double", [0.0, -0.0]).distinct == 2
    assert encoding(spark, "string", ["a", "b"]).encoding == "PLAIN"


@pytest.mark.parametrize("n,kind", [(254, "DICT"), (255, "DICT"), (256, "PLAIN")])
def test_entry_limit(spark, n, kind):
    df = spark.range(50_000).select(F.lit(0).alias("row_group"), (F.col("id") % n).cast("int").alias("v"))
    assert layout.encodings(df, ["v"]).first().encoding == kind


def test_byte_limit(spark):
    df = spark.range(10_000).select(F.lit(0).alias("row_group"), F.concat(F.repeat(F.lit("x"), 115), F.format_string("%03d", F.col("id") % 20)).alias("v"))
    assert layout.encodings(df, ["v"], Options(max_dict_total_bytes=1024)).first().encoding == "PLAIN"
    assert layout.encodings(df, ["v"]).first().encoding == "DICT"


def test_buckets_and_schema(spark):
    df = spark.createDataFrame([(1, 2, 3)], "zebra int, alpha int, middle int")
    assert bucket_of(df.schema, Options(num_buckets=2)) == {"alpha": 0, "middle": 0, "zebra": 1}
    assert [r.name for r in layout.schema_report(spark, df.schema).orderBy("position").collect()] == ["zebra", "alpha", "middle"]
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        check_schema(spark.createDataFrame([(1, 2)], "a int, A int").schema)
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    from pyspark.sql import types as T

    for fields in ([("", T.IntegerType())], [("a", T.IntegerType())] * 2, [("a", T.NullType())], [("a", T.StructType([]))], [("m", T.MapType(T.ArrayType(T.IntegerType()), T.IntegerType()))]):
        with pytest.raises(TableError):
            check_schema(T.StructType([T.StructField(n, t) for n, t in fields]))


def test_reports(spark):
    rows = [(k // 50, k, "abc"[k % 3], 7) for k in range(200)]
    df = spark.createDataFrame(rows, "row_group bigint, id int, kind string, flag int")
    assert [r.value for r in layout.dictionary(df, "kind", "id").where("row_group = 0").orderBy("nth").collect()] == ["a", "b", "c"]
    with pytest.raises(TableError):
        layout.dictionary(df.withColumn("a", F.array("id")), "a", "id")
    kinds = {r.column: r.encoding for r in layout.pages(df).where("row_group = 1").collect()}
    assert kinds == {"id": "PLAIN", "kind": "DICT", "flag": "CONST"}
    small = layout.buckets(df, Options(num_buckets=1)).where("row_group = 0").first()
    assert (small.kind, small.columns) == ("Monolithic", ["flag", "id", "kind"])
    paged = layout.buckets(df.select("row_group", "id"), Options(page_size_threshold=64)).first()
    assert paged.kind == "Paged"
    assert layout.buckets(df.select("row_group", "id"), Options(page_size_threshold=64, compression="none")).first().kind == "Monolithic"
    sizes = {r.column: r for r in layout.column_sizes(df, Options(num_buckets=1)).collect()}
    total = sum(r.bytes for r in layout.buckets(df, Options(num_buckets=1)).collect())
    assert sum(r.bytes for r in sizes.values()) == total and sizes["id"].approximate
    assert estimated_size(0, 1000) == 1324 and estimated_size(10, 1000, compression="none") == 2034


def test_nested(spark):
    df = spark.createDataFrame([(1, [10, 20, 30], {1: "a", 2: "b"}), (2, None, None), (3, [40, None], {}), (4, [], {})], "id int, tags array<int>, props map<int,string>")
    for c in ("tags", "props"):
        back = nested.reassemble(nested.lengths(df, "id", c), nested.flatten(df, "id", c), "id", c)
        assert {r.id: r[c] for r in back.collect()} == {r.id: r[c] for r in df.collect()}
    assert [n for n, _ in nested.physical_columns("m", df.schema["props"].dataType)] == ["m", "m.key", "m.value"]


def prefixed(n):
    return n + 1 + sum(n >= 1 << s for s in (7, 14, 21, 28))


SIZES = {
    "boolean": lambda v: 1,
    "short": lambda v: 2,
    "int": lambda v: 4,
    "bigint": lambda v: 8,
    "float": lambda v: 4,
    "double": lambda v: 8,
    "date": lambda v: 4,
    "timestamp": lambda v: 8,
    "decimal(12,2)": lambda v: 8,
    "string": lambda v: prefixed(len(v.encode())),
    "binary": lambda v: prefixed(len(v)),
    "decimal(38,3)": lambda v: prefixed((int(v.scaleb(3)) if v >= 0 else ~int(v.scaleb(3))).bit_length() // 8 + 1),
    "struct<millis:bigint,nanos_of_milli:int>": lambda v: 12,
}


def some_values(rng, kind):
    if kind == "boolean":
        return [True, False]
    if kind in ("short", "int", "bigint"):
        return [rng.randrange(-99, 99) for _ in range(9)]
    if kind in ("float", "double"):
        return [0.0, -0.0, 1.5, float("nan"), float("inf")]
    if kind == "date":
        return [datetime.date(2020, 1, d) for d in range(1, 9)]
    if kind == "timestamp":
        return [datetime.datetime(2020, 1, d) for d in range(1, 9)]
    if kind.startswith("decimal"):
        return [decimal.Decimal(k).scaleb(-2) for k in (0, -1, 127, -128, 12800, 3276700, -3276800, 10**9)] + (
            [decimal.Decimal(s * 2 ** (8 * k - 1) - d).scaleb(-3) for k in range(1, 15) for s in (1, -1) for d in (0, 1)] if "38" in kind else []
        )
    if kind == "string":
        return ["", "é", "x" * 127, "y" * 128, "z"]
    if kind == "binary":
        return [b"", b"\0", b"ab" * 99]
    return [(k, 5) for k in range(4)]


def test_facts_against_brute_force(spark):
    """Every kind of column, in arrays too, with nulls, over several row groups in mixed order."""
    rng = random.Random(8)
    kinds = list(SIZES)
    schema = ", ".join(f"c{k} {t}" for k, t in enumerate(kinds)) + ", arr array<string>, row_group int"
    rows = []
    for _ in range(400):
        arr = rng.choice([None, [], ["a", None], ["x" * 200]])
        rows.append((*(None if rng.random() < 0.3 else rng.choice(some_values(rng, t)) for t in kinds), arr, rng.choice([None, 1, 2])))
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = {(r.row_group, r.column): r for r in layout.encodings(df).collect()}
    for g in (None, 1, 2):
        own = [r for r in rows if r[-1] == g]
        for k, t in enumerate(kinds):
            live = [r[k] for r in own if r[k] is not None]
            r = got[g, f"c{k}"]
            assert (r.rows, r.non_null, r.plain_bytes) == (len(own), len(live), sum(map(SIZES[t], live))), t
            assert r.distinct == len({repr(v) for v in live}) and r.has_nulls == (len(live) < len(own)), t
        items = [x for r in own for x in r[-2] or []]
        r = got[g, "arr.element"]
        assert (r.rows, r.non_null, r.plain_bytes) == (len(items), sum(x is not None for x in items), sum(prefixed(len(x)) for x in items if x is not None))
        assert got[g, "arr"].non_null == sum(r[-2] is not None for r in own)
    assert layout.encodings(df.limit(0)).count() == 0


def test_ten_thousand_columns(spark):
    """Rows stay rows: a report on a very wide table is one pass in batches. With a row for each column and row it took
    many minutes; the limit leaves room for a slow machine."""
    n = 10_000
    schema = T.StructType([T.StructField("row_group", T.IntegerType())] + [T.StructField(f"c{k:05d}", T.StringType()) for k in range(n)])
    df = spark.createDataFrame([(g, *(f"v{(k * (g + 1)) % 7}" for k in range(n))) for g in range(2) for _ in range(6)], schema)
    began = time.time()
    found = layout.pages(df).collect()
    took = time.time() - began
    assert len(found) == 2 * n and {r.encoding for r in found} == {"CONST"} and {r.bytes for r in found} == {3}
    assert took < 240


def test_reports_of_nested_tables(spark):
    rows = [(0, k, [k, None] if k % 3 else None, {"k": [1.5] * k}) for k in range(50)]
    df = spark.createDataFrame(rows, "row_group int, id int, a array<int>, m map<string,array<double>>")
    names = [r.column for r in layout.encodings(df).collect()]
    assert sorted(names) == ["a", "a.element", "id", "m", "m.key", "m.value", "m.value.element"]
    parts = {r.column: r.bytes for r in layout.encodings(df).collect()}
    whole = {r.column: r.bytes for r in layout.pages(df).collect()}
    assert whole == {"id": parts["id"], "a": parts["a"] + parts["a.element"], "m": sum(parts[c] for c in parts if c.startswith("m"))}
    assert [r.column for r in layout.pages(df, ["id"]).collect()] == ["id"]
    one = layout.buckets(df, Options(num_buckets=1)).first()
    # 7 physical columns: their bits, 3 of the table and 4 children, and the rows of the children.
    header = 2 + 1 + 1 + 1 + 3 + 2
    assert one.bytes == sum(parts.values()) + header and one.columns == ["a", "id", "m"]
    sizes = {r.column: r.bytes for r in layout.column_sizes(df, Options(num_buckets=1), columns=["a"]).collect()}
    assert sizes == {"a": -(-one.bytes // 3)}


def test_shred_any_depth(spark):
    kind = "id int, v array<map<string,array<int>>>"
    rows = [(0, None), (1, []), (2, [None, {}]), (3, [{"a": [1, None], "b": None}, {"c": []}]), (4, [{"z": [3]}, None, {"y": [4, 5], "x": [6]}])]
    df = spark.createDataFrame(rows, kind)
    parts = nested.shred(df, "id", "v")
    assert list(parts) == [n for n, _ in nested.physical_columns("v", df.schema["v"].dataType)]
    back = nested.gather(parts, "id", "v", df.schema["v"].dataType)
    assert {r.id: r.v for r in back.collect()} == dict(rows)


def test_names(spark):
    rng = random.Random(2)
    made = [f"sensor_{k:04d}_temperature_{rng.choice(['max', 'min', 'aaaa', 'aaaaa'])}".encode() for k in range(500)] + [b"", b"aaa"]
    rules, short = names.merge_pairs(sorted(made))
    assert 1 < len(rules) <= 128 and [names.restore(rules, s) for s in short] == sorted(made)
    assert names.merge_pairs([b"abcabcabx"], 1) == ([(97, 98)], [bytes([128, 99, 128, 99, 128, 120])])
    assert names.merge_pairs([b"aaaaa"], 1) == ([(97, 97)], [bytes([128, 128, 97])]) and names.merge_pairs([]) == ([], [])
    assert names.merge_pairs([b"abcd", b"efgh"]) == ([], [b"abcd", b"efgh"])
    # One pair of each of ab and cd, twice: the greater one of equals goes first.
    assert names.merge_pairs([b"ab", b"cd", b"ab", b"cd"], 1)[0] == [(99, 100)]
    assert names.front_coded_bytes([b"abc", b"abd", b"x" * 200]) == (1 + 1 + 3) + (1 + 1 + 1) + (1 + 2 + 200)
    schema = T.StructType([T.StructField(n.decode() or "e", T.IntegerType()) for n in made])
    sizes = {r.how: r.bytes for r in names.name_sizes(spark, schema).collect()}
    assert sizes["stored"] == sizes["merged"] < sizes["front_coded"] < sizes["plain"]
    odd = {r.how: r.bytes for r in names.name_sizes(spark, T.StructType([T.StructField("é", T.IntegerType())])).collect()}
    assert odd == {"plain": 2, "front_coded": 4, "merged": None, "stored": 4}
