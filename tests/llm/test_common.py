import os

import pytest

from wideframe.llm import common


def test_written_tables_are_shared_and_released(spark):
    root = common.shared_dir(spark)
    assert root == spark.conf.get("spark.checkpoint.dir")
    df = common.written(spark.range(5), "kept")
    (path,) = {os.path.dirname(f) for f in df.inputFiles()}
    assert path.startswith(root) and df.count() == 5
    assert not any("Range" in line for line in df._jdf.queryExecution().toString().splitlines())
    common.release(spark)
    assert not os.path.exists(path.removeprefix("file://"))


def test_cluster_must_name_the_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Conf:
        get = staticmethod(lambda key, default: default)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "a int, B_ int")
    assert common.fresh(df, "c") == "c" and common.fresh(df, "A") == "A_" and common.fresh(df, "b_") == "b__"


def test_a_step_takes_its_tables_along(spark):
    with common.step(spark) as leave:
        inner = common.written(spark.range(3), "inner")
        leave()
        kept = common.written(inner, "kept")
    assert kept.count() == 3
    (path,) = {os.path.dirname(f) for f in kept.inputFiles()}
    assert os.listdir(os.path.dirname(path).removeprefix("file://")) == [os.path.basename(path)]
    with pytest.raises(KeyError), common.step(spark):
        common.written(spark.range(3), "inner")
        raise KeyError
    assert common._STEPS == [] and kept.count() == 3
    common.release(spark)
