import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideframe import cli
from wideframe.functions import scalars
from wideframe.functions.render import ndjson, table_text, text_json
from wideframe.operators.layout import Options
from wideframe.operators.table import WideTable, read_table
from wideframe.sources import files
from wideframe.sources.csv_import import Dialect, import_csv
from wideframe.sources.json_import import import_json
from wideframe.sources.sink import Writer, write_table
from wideframe.streaming.append import append_stream, batches
from wideframe.types import TableError


def put(path, *texts, suffix="csv"):
    out = []
    for k, t in enumerate(texts):
        p = path / f"in{k}.{suffix}"
        p.write_bytes(t if isinstance(t, bytes) else t.encode())
        out.append(str(p))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(
    "texts,want",
    [
        (["id,kind\n1,a\n", "kind,id\nb,2\n"], [(1, "a"), (2, "b")]),
        (["id,left\n1,a\n", "id,right\n2,b\n"], [(1, "a", None), (2, None, "b")]),
        (["value\n1\n9007199254740992\n", "value\n3.5\n4.5\n"], [(1.0,), (3.5,), (4.5,), (9007199254740992.0,)]),
        (["id,value\n1,\n2,\n", "id,value\n3,9\n4,10\n"], [(1, None), (2, None), (3, 9), (4, 10)]),
        (["id,kind\n1,a\n2,b\n", ""], [(1, "a"), (2, "b")]),
        (["id\n1\n", "other,other\n"], [(1,)]),
        (["id,empty\n1,\n2,\n"], [(1, None), (2, None)]),
        (['place\n"D:\\new\\tab"\n'], [("D:\\new\\tab",)]),
    ],
)
def test_csv(spark, tmp_path, texts, want):
    assert rows(import_csv(spark, put(tmp_path, *texts))) == sorted(want, key=repr)


@pytest.mark.parametrize(
    "texts,options,message",
    [
        (["v\n9007199254740993\n", "v\n1.5\n"], {}, "as Float64"),
        (["v\n1.5\n", "v\n9223372036854775807\n"], {}, "as Float64"),
        (["v\n1.5\n1e400\n"], {}, "out of range"),
        (["v\n1.5\nNaN\n"], {}, "not finite"),
        (["id,kind\n1,a\n", "x,y\n1,2\n"], {}, "incompatible"),
        ([""], {}, "no CSV data"),
        ([",id\n1,2\n"], {}, "empty column name"),
        (["id,id\n1,2\n"], {}, "'id' is in the CSV header twice"),
        (["t\n2026-08-20T12:34:56+08:00\n"], {}, "timezone"),
        (["id,name\n1,a\n"], {"require": ["x"]}, "required"),
    ],
)
def test_csv_errors(spark, tmp_path, texts, options, message):
    with pytest.raises(TableError, match=message):
        import_csv(spark, put(tmp_path, *texts), **options)


def test_csv_dialects(spark, tmp_path):
    (p,) = put(tmp_path, "made by hand\nnr|who\n7|'o\\'k'\n")
    d = Dialect(delimiter="|", quote="'", escape="\\", skip_lines=1)
    assert rows(import_csv(spark, [p], d)) == [(7, "o'k")]
    (p,) = put(tmp_path, b"\xff\nid,name\n1,ok\n")
    assert rows(import_csv(spark, [p], Dialect(skip_lines=1))) == [(1, "ok")]
    (p,) = put(tmp_path, "1,a\n2,b\n")
    df = import_csv(spark, [p], Dialect(no_header=True))
    assert df.columns == ["field_0", "field_1"] and rows(df) == [(1, "a"), (2, "b")]
    df = import_csv(spark, [p], Dialect(header="id,kind"))
    assert df.columns == ["id", "kind"] and df.count() == 2


def test_csv_types_and_required(spark, tmp_path):
    ps = put(tmp_path, "t,d,b\n2026-08-20T12:34:56,2020-01-31,true\n", "t,d,b\n2026-08-20T12:34:56.123456789,2020-02-01,false\n")
    df = import_csv(spark, ps)
    assert df.schema["t"].dataType["nanos_of_milli"].dataType == T.IntegerType()
    assert sorted(r.t.nanos_of_milli for r in df.collect()) == [0, 456789]
    (p,) = put(tmp_path, "id,name\n1,a\n,b\n")
    with pytest.raises(Exception, match="'id'"):
        import_csv(spark, [p], require=["id"]).collect()
    (p,) = put(tmp_path, "a,b\n1\n")
    with pytest.raises(Exception):
        import_csv(spark, [p]).collect()


def json_file(path, *lines):
    return put(path, "\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines), suffix="json")[0]


def test_json(spark, tmp_path):
    p = json_file(tmp_path, *[{"id": k} for k in range(20)], {"id": 20, "late": "present"})
    df = import_json(spark, p)
    assert df.columns == ["id", "late"] and df.schema["id"].dataType == T.LongType() and df.count() == 21
    p = json_file(tmp_path, {"id": 1, "v": None})
    with pytest.raises(TableError, match="'v'"):
        import_json(spark, p)
    assert rows(import_json(spark, p, ["id"])) == [(1,)]
    p = json_file(tmp_path, '{"v":1.5}', '{"v":18446744073709551616}')
    assert [r.line for r in ndjson(import_json(spark, p)).collect()] == ['{"v":1.5}', '{"v":1.8446744073709552e19}']
    p = json_file(tmp_path, '{"kind":"a","id":1,"x":9007199254740993}', '{"kind":"b","id":2,"x":1.5}')
    assert rows(import_json(spark, p, ["kind,id"])) == [("a", 1), ("b", 2)]


@pytest.mark.parametrize(
    "lines,message",
    [
        (['{"v":1.5}', '{"v":9007199254740993}'], "'v'"),
        (['{"v":1.5}', '{"v":18446744073709551617}'], "'v'"),
        (['{"v":[1.5]}', '{"v":[9007199254740993]}'], r"'v\[\]'"),
        (['{"v":1e400}'], "'v'"),
        (["{", '"v": 1', "}"], "one JSON object"),
        (['{"v":' + "[" * 200 + "1" + "]" * 200 + "}"], "JSON"),
        (['{"v":{"a":1}}'], "unsupported type"),
    ],
)
def test_json_errors(spark, tmp_path, lines, message):
    with pytest.raises(TableError, match=message):
        import_json(spark, json_file(tmp_path, *lines))


def test_text_json(spark):
    df = spark.createDataFrame([(0, 0, 10, "on"), (0, 1, None, "off"), (0, 2, 12, None)], "row_group int, p int, speed int, state string")
    assert text_json(df, "p").first().line == '{"speed":"10,,12","state":"on,off,"}'
    df = spark.createDataFrame([(0, 0, None), (0, 1, ""), (0, 2, "a,b"), (0, 3, 'x"\n')], "row_group int, index int, text string")
    assert text_json(df, "index", columns=["index", "text"]).first().line == '{"index":"0,1,2,3","text":",,a,b,x\\"\\n"}'
    bad = spark.createDataFrame([(0, 0, float("inf")), (1, 0, 1.0)], "row_group int, p int, v double")
    assert {r.row_group: r.line for r in text_json(bad, "p").collect()} == {0: None, 1: '{"v":"1.0"}'}


def test_scalars(spark):
    df = spark.createDataFrame([("\x1f\\\"/é\x7f\b",)], "s string")
    assert df.select(scalars.json_string(F.col("s"))).first()[0] == '\\u001f\\\\\\"/é\x7f\\b'
    numbers = [(1.0, "1.0"), (9007199254740992.0, "9.007199254740992e15"), (12345678.5, "12345678.5"), (1e-4, "0.0001"), (1e9, "1.0e9"), (-2.5e8, "-250000000.0"), (float("nan"), None)]
    got = spark.createDataFrame([(n,) for n, _ in numbers], "v double").select(scalars.number_text(F.col("v"))).collect()
    assert [r[0] for r in got] == [t for _, t in numbers]
    tokens = ["18446744073709551616", "9223372036854775807", "1.5", "9007199254740993", "12", None]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select(F.coalesce(scalars.inexact(F.col("t")), F.lit(False))).collect()
    assert [r[0] for r in got] == [False, True, False, True, False, False]
    assert spark.range(1).select(scalars.split_nanos(F.lit(-1).cast("long")).alias("s")).select("s.*").first() == (-1, 999999)


def files_read(df):
    """What the scan says that it opened, once it has run."""
    df._jdf.queryExecution().executedPlan().executeCollect()
    plan = df._jdf.queryExecution().executedPlan()
    (leaf,) = [plan.collectLeaves().apply(k) for k in range(plan.collectLeaves().size())]
    return leaf.metrics().apply("numFiles").value()


def test_table(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(200).selectExpr("cast(id as int) AS id", "substr('abc', 1 + cast(id % 3 as int), 1) AS kind", "7 AS flag").repartitionByRange(4, "id")
    write_table(df, path, Options(stats_columns=("id",), num_buckets=3))
    t = WideTable.open(spark, path)
    assert t.count() == 200 and t.schema.names == ["id", "kind", "flag"]
    assert rows(t.cat(None, ["kind"], "id>197")) == [("a",), ("b",)]
    assert t.where("id>9999").count() == 0 and t.where("id!=abc").count() == 200
    assert t.row_groups().count() == 4 and t.stats().count() == 4
    one = t.where("id=150")
    assert one.collect() and files_read(one) == 1 and files_read(t.df) == 4
    assert t.project("kind", "id", "kind").schema.names == ["kind", "id"]
    assert t.project().df.count() == 200 and t.head(3).count() == 3
    for bad in (lambda: t.project("x"), lambda: t.where("x=1"), lambda: t.row_group("x"), lambda: t.where("kind>5")):
        with pytest.raises(TableError):
            bad()
    with pytest.raises(TableError, match="already exists"):
        write_table(df, path)
    (tmp_path / "link").symlink_to(tmp_path / "nowhere")
    with pytest.raises(TableError, match="already exists"):
        write_table(df, str(tmp_path / "link"))
    (tmp_path / "link").unlink()
    write_table(df.limit(5), path, overwrite=True)
    assert read_table(spark, path, ["id"]).count() == 5
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_writer_refuses(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("s", T.StringType())])
    good = spark.createDataFrame([(1, "a")], "id int, s string")
    with Writer(spark, str(tmp_path / "a"), schema) as w:
        w.append(good)
        w.append(good)
        so_far = w.estimated_size()
        assert so_far > 1024 and w.estimated_size(good) > so_far
    assert WideTable.open(spark, str(tmp_path / "a")).count() == 2
    for k, bad in enumerate((good.toDF("id", "t"), good.select("id"), spark.createDataFrame([("1", "a")], "id string, s string"), spark.createDataFrame([(None, "a")], "id int, s string"))):
        path = tmp_path / f"b{k}"
        with pytest.raises(Exception):
            with Writer(spark, str(path), schema) as w:
                w.append(bad)
        assert w.state == "aborted" and not path.exists()
    for options in (Options(stats_columns=("x",)), Options(compression="lz4")):
        with pytest.raises(TableError):
            Writer(spark, str(tmp_path / "c"), schema, options)
    Writer(spark, str(tmp_path / "empty"), schema).close()
    assert WideTable.open(spark, str(tmp_path / "empty")).count() == 0


def test_row_groups_are_sized_by_all_rows(spark, tmp_path):
    rows = spark.range(24_000, numPartitions=1).selectExpr("IF(id < 20000, '', repeat('x', 1000)) AS t")
    with Writer(spark, str(tmp_path / "late"), rows.schema, Options(row_group_max_size=1 << 20)) as w:
        w.append(rows)
    # 4 MB of text, of which the first 20,000 rows have nothing.
    assert len(list((tmp_path / "late").rglob("*.parquet"))) >= 4


def test_cli(spark, tmp_path):
    (p,) = put(tmp_path, "id,kind\n1,a\n2,b\n3,a\n")
    out = str(tmp_path / "out")
    assert cli.run(spark, ["convert-csv", p, "-o", out, "--stats", "id"]).endswith("(3 rows, 2 columns)\n")
    assert cli.run(spark, ["count", out]) == "3\n" and cli.run(spark, ["count", out, "--json"]) == '{"rows":3}\n'
    assert cli.run(spark, ["cat", out, "--where", "id>=3", "--json"]) == '{"id":3,"kind":"a"}\n'
    assert "| kind |" in cli.run(spark, ["head", out, "-c", "kind"])
    for command in ("schema", "meta", "pages", "footer", "column-size", "buckets"):
        assert cli.run(spark, [command, out]) and cli.run(spark, [command, out, "--json"])
    assert cli.run(spark, ["dictionary", out, "-c", "kind"]) == "(no rows)\n"
    with pytest.raises(TableError):
        cli.run(spark, ["convert-csv", p, "-o", out])
    j = json_file(tmp_path, {"id": 1, "s": "x"})
    cli.run(spark, ["convert", j, "-o", out, "--overwrite"])
    assert cli.run(spark, ["cat", out, "--json"]) == '{"id":1,"s":"x"}\n'
    assert table_text(spark.createDataFrame([(1, "a\tb", None)], "id int, s string, n int"), 5).splitlines()[3] == "| 1  | a�b |   |"


def test_stream(spark, tmp_path):
    src = tmp_path / "src"
    spark.range(10).write.parquet(str(src))
    q = append_stream(spark.readStream.schema("id long").parquet(str(src)), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    spark.range(10, 15).write.mode("append").parquet(str(src))
    q = append_stream(spark.readStream.schema("id long").parquet(str(src)), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert sorted(r.id for t in batches(spark, str(tmp_path / "out")) for r in t.df.collect()) == list(range(15))


def test_install_keeps_the_old_table(spark, tmp_path, monkeypatch):
    """A rename that fails leaves what was there, or says where it is; nothing is deleted before the new one is there."""
    path = str(tmp_path / "t")
    write_table(spark.range(3).toDF("id"), path)

    class Failing:
        def __init__(self, fs, bad):
            self.fs, self.bad, self.n = fs, bad, 0

        def rename(self, a, b):
            self.n += 1
            return False if self.n in self.bad else self.fs.rename(a, b)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    plain = files._fs
    for bad, message in (({1}, "stays"), ({2}, "back in its place"), ({2, 3}, "is at")):
        holder = {}

        def failing(spark, p, bad=bad, holder=holder):
            fs, q = plain(spark, p)
            return holder.setdefault("fs", Failing(fs, bad)), q

        made = f"{path}.part-x"
        write_table(spark.range(9).toDF("id"), made)
        monkeypatch.setattr(files, "_fs", failing)
        with pytest.raises(TableError, match=message) as e:
            files.install(spark, made, path, overwrite=True)
        monkeypatch.setattr(files, "_fs", plain)
        where = path if "is at" not in message else str(e.value).split("'")[-2]
        assert WideTable.open(spark, where).count() == 3 and WideTable.open(spark, made).count() == 9
        files.discard(spark, made)


def test_install_beside_another_writer(spark, tmp_path):
    """A folder that appears between the check and the rename does not swallow the new table."""
    made, path = tmp_path / "made", tmp_path / "t"
    made.mkdir()
    path.mkdir()
    fs, to = files._fs(spark, str(path))
    source = spark._jvm.org.apache.hadoop.fs.Path(str(made))
    assert not files._moved(fs, source, to) and made.exists() and not list(path.iterdir())


def test_csv_damage_is_a_table_error(spark, tmp_path):
    for text in ("a,b\n1\n", "a,b\n1,2,3\n", 'a,b\n1,"x\ny"\n2\n'):
        with pytest.raises(TableError, match="record"):
            import_csv(spark, put(tmp_path, text)).collect()
    (p,) = put(tmp_path, "x\n1|'a\nb'\n2\n")
    d = Dialect(delimiter="|", quote="'", header="id|t", skip_lines=1)
    with pytest.raises(TableError, match="record"):
        import_csv(spark, [p], d).collect()
    (p,) = put(tmp_path, "x\n1|'a\nb'c'\n")
    with pytest.raises(TableError, match="record"):
        import_csv(spark, [p], d).collect()
    (p,) = put(tmp_path, f"x\n1|'a\n{'b' * 300_000}'\n")
    assert import_csv(spark, [p], d).selectExpr("length(t)").first()[0] == 300_002


def test_csv_values_over_lines(spark, tmp_path):
    (p,) = put(tmp_path, 'id,t\n1,"a\nb"\n2,"say ""x""\n"\n3,plain\n')
    assert rows(import_csv(spark, [p])) == [(1, "a\nb"), (2, 'say "x"\n'), (3, "plain")]
    (p,) = put(tmp_path, "t,id\n2020-01-02,1\n2020-01-02T03:04:05.5,2\n")
    got = rows(import_csv(spark, [p]))
    assert [str(t) for t, _ in got] == ["2020-01-02 00:00:00", "2020-01-02 03:04:05.500000"]
    ps = put(tmp_path, "t\n2020-01-02\n", "t\n2020-01-02T03:04:05\n")
    assert import_csv(spark, ps).count() == 2


def test_json_of_many_doubles_takes_few_jobs(spark, tmp_path):
    p = json_file(tmp_path, {f"v{k}": k + 0.5 for k in range(300)})
    group = "many-doubles"
    spark.sparkContext.setJobGroup(group, "")
    assert len(import_json(spark, p).columns) == 300
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 12


def test_text_output_in_two_passes(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(spark.range(30).selectExpr("id", "repeat('x', cast(id as int)) AS s").repartition(4), path)
    text = cli.run(spark, ["cat", path])
    assert len(text.splitlines()) == 34 and len({len(x) for x in text.splitlines()}) == 1
    assert cli.run(spark, ["cat", path, "--where", "id>99"]) == "(no rows)\n"
    assert "(us)" not in cli.run(spark, ["meta", path])
    days = str(tmp_path / "d")
    write_table(spark.sql("SELECT DATE'2020-01-01' AS d"), days, Options(stats_columns=("d",)))
    assert "18262 (epoch-day)" in cli.run(spark, ["meta", days]) and '"min":"18262"' in cli.run(spark, ["meta", days, "--json"])
