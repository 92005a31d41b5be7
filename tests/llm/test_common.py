from blockloom.llm import common
from pyspark.sql import functions as F


def test_a_dealt_join_is_an_equi_join(spark, monkeypatch):
    monkeypatch.setattr(common, "SHARE", 8)
    rows = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(300)] + [(300, None)], "row long, k long")
    groups = common.materialize(rows.groupBy("k").agg(F.count("*").alias("n")).filter("k IS NULL OR k % 2 = 0"), "groups")
    for how in ("inner", "left_anti", "left_semi", "left"):
        want = rows.join(groups, "k", how)
        got = common.dealt_join(rows, groups, ["k"], "n", ["row"], how)
        assert got.columns == want.columns
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_a_dealt_join_spreads_a_key_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "SHARE", 8)
    rows = spark.range(400).select(F.col("id").alias("row"), F.lit(1).alias("k"))
    groups = common.materialize(spark.createDataFrame([(1, 400)], "k int, n long"), "groups")
    before = {c: spark.conf.get(c, None) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        met = common.dealt_join(rows, groups, ["k"], "n", ["row"])
        parts = [r["count"] for r in met.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    assert sum(parts) == 400 and len(parts) > 8 and max(parts) < 100


def test_a_dealt_join_of_empty_tables(spark):
    none = spark.createDataFrame([], "row long, k long")
    groups = spark.createDataFrame([], "k long, n long")
    assert common.dealt_join(none, groups, ["k"], "n", ["row"]).count() == 0
    one = spark.createDataFrame([(1, 2)], "row long, k long")
    assert common.dealt_join(one, groups, ["k"], "n", ["row"], "left_anti").count() == 1
