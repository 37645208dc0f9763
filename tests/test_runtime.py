import pytest
from pyspark.sql import functions as F

from marginalia import runtime


def test_hot_keys_and_salts(spark):
    rows = [("hot", i) for i in range(500)] + [(None, i) for i in range(200)] + [(f"k{i}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v int")
    hot = runtime.hot_keys(df, ["k"])
    assert {r["k"] for r in hot.collect()} == {"hot", None} and runtime.hot_keys(df.limit(0), ["k"]).count() == 0
    left = runtime.salt_left(df, ["k"], hot, ["v"])
    assert left.count() == len(rows) and left.where("k = 'hot'").select("_salt").distinct().count() == runtime.SALTS and left.where("k like 'k%' and _salt != 0").count() == 0
    right = runtime.salt_right(spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, w int"), ["k"], hot)
    assert right.count() == runtime.SALTS + 1
    assert left.join(right, ["k", "_salt"]).count() == 501


def test_broadcast_is_checked(spark):
    df = spark.range(20).withColumnRenamed("id", "a")
    plan = lambda n: spark.range(50).join(runtime.broadcast_if_small(df, n), F.col("id") == F.col("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(20) and "broadcast" not in plan(19)


def test_shared_folder(spark, tmp_path):
    before = runtime.shared_dir(spark)
    assert runtime.shared_dir(spark) == before
    df = runtime.materialize(spark.range(5).withColumn("p", F.col("id") % 2), "t", ["p"])
    assert df.count() == 5 and "Parquet" in df._jdf.queryExecution().toString().title()
    assert runtime.clear(spark) >= 1
    with pytest.raises(Exception):
        spark.read.parquet(runtime._PATHS[0] if runtime._PATHS else before + "/none").count()


def test_nothing_is_left_of_intermediate_tables(spark):
    since = len(runtime._PATHS)
    fs, at = runtime.hadoop(spark, runtime.shared_dir(spark))
    names = lambda: {x.getPath().getName() for x in fs.listStatus(at)}
    before = names()
    with runtime.cleared(spark):
        kept = runtime.materialize(spark.range(7), "kept")
        gone = runtime.materialize(spark.range(3), "gone")
        runtime.forget(gone)
        assert kept.count() == 7 and len(names() - before) == 1
    assert names() == before and len(runtime._PATHS) == since


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    conf = SimpleNamespace(get=lambda key, default=None: default, set=lambda *a: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)))
