import datetime as dt

import pytest
from pyspark.sql import types as T

from wideframe.operators import stats
from wideframe.operators.predicate import Where, bind, parse_where
from wideframe.plans.prune import kept_row_groups, pruned_scan
from wideframe.types import TableError


def match(spark, kind, values, condition):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.where(bind(df.schema, parse_where(condition))).collect()]


def test_parse():
    assert parse_where(" a >= 5 ") == Where("a", ">=", "5")
    assert parse_where("a<b=c") == Where("a<b", "=", "c")
    for bad in ("a", "=5", "a=", ""):
        with pytest.raises(TableError):
            parse_where(bad)


def test_integers(spark):
    v = [None, -1, 0, 197, 198, 199]
    assert match(spark, "int", v, "v>197") == [198, 199]
    assert match(spark, "int", v, "v!=0") == [-1, 197, 198, 199]
    assert match(spark, "int", v, "v=abc") == []
    assert match(spark, "int", v, "v!=abc") == [-1, 0, 197, 198, 199]
    assert match(spark, "int", v, "v<99999999999") == [-1, 0, 197, 198, 199]
    assert match(spark, "tinyint", [1, 127, -128], "v>=-129") == [1, 127, -128]
    big = [1700000000000000001, 1700000000000000003, 1700000000000000004]
    assert match(spark, "bigint", big, "v=1700000000000000003") == [1700000000000000003]
    with pytest.raises(TableError):
        match(spark, "int", v, "v>abc")


def test_floats(spark):
    nan = float("nan")
    assert match(spark, "float", [0.1, 1.0], "v=0.1") == [pytest.approx(0.1)]
    assert match(spark, "float", [1.0, 2.0], "v<1e40") == [1.0, 2.0]
    assert match(spark, "double", [nan, 1.0, 3.0, None], "v>1") == [3.0]
    assert len(match(spark, "double", [nan, 1.0, 3.0, None], "v!=1")) == 2
    assert match(spark, "double", [nan, 1.0], "v=NaN") == []
    assert len(match(spark, "double", [nan, 1.0, None], "v!=nan")) == 2


def test_others(spark):
    days = [dt.date(2020, 1, 1), dt.date(2021, 1, 1)]
    assert match(spark, "date", days, "v>2020-12-31") == [days[1]]
    assert match(spark, "date", days, "v=18262") == [days[0]]
    assert match(spark, "date", days, "v=2021-02-30") == []
    assert match(spark, "boolean", [True, False, None], "v!=true") == [False]
    assert match(spark, "string", ["a", "b", None], "v!=abc") == ["a", "b"]
    for kind, value, condition in (
        ("boolean", True, "v=yes"),
        ("boolean", True, "v>true"),
        ("string", "a", "v>5"),
        ("decimal(5,2)", None, "v=1"),
        ("binary", None, "v=1"),
        ("timestamp", None, "v=1"),
        ("int", 1, "w=1"),
    ):
        with pytest.raises(TableError):
            match(spark, kind, [value], condition)


def test_unknown_column_of_empty_table(spark):
    with pytest.raises(TableError):
        match(spark, "int", [], "w=1")


@pytest.mark.parametrize("condition", ["v=3", "v>3", "v>=3", "v<3", "v<=3", "v!=3", "v=abc", "v!=abc", "v>99999999999"])
def test_pruning_keeps_all_rows(spark, condition):
    df = spark.createDataFrame([(k, None if k % 4 == 0 else k // 3) for k in range(30)], "k bigint, v int")
    df = stats.by_key(df, "k", 5)
    found = stats.row_group_stats(df, ["v"])
    w = parse_where(condition)
    want = sorted(r.k for r in df.where(bind(df.schema, w)).collect())
    assert sorted(r.k for r in pruned_scan(df, found, w).collect()) == want
    none = found.where("false")
    assert sorted(r.k for r in pruned_scan(df, none, w).collect()) == want


def test_pruning_excludes(spark):
    df = stats.by_key(spark.range(100).withColumnRenamed("id", "k"), "k", 10)
    found = stats.row_group_stats(df, ["k"])
    assert [r[0] for r in kept_row_groups(found, df.schema, parse_where("k=45")).collect()] == [4]
    assert kept_row_groups(found, df.schema, parse_where("k!=45")).count() == 10
    assert kept_row_groups(found, df.schema, parse_where("k>9999")).count() == 0


def test_nan_statistics(spark):
    nan = float("nan")
    rows = [(0, 0, nan), (0, 1, 1.0), (1, 2, 2.0), (1, 3, nan), (1, 4, 5.0), (2, 5, None), (2, 6, nan)]
    df = spark.createDataFrame(rows, "row_group bigint, p bigint, v double")
    found = {r.row_group: (r.nulls, r.min, r.max) for r in stats.row_group_stats(df, ["v"], position="p").collect()}
    assert found == {0: (0, "NaN", "NaN"), 1: (0, "2.0", "5.0"), 2: (1, "NaN", "NaN")}
    for name in ("w", "b"):
        with pytest.raises(TableError):
            stats.row_group_stats(df.selectExpr("*", "cast('x' as binary) AS b"), [name])
    assert isinstance(df.schema["v"].dataType, T.DoubleType)
