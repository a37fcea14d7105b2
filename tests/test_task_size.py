from kgloom.operators import graph as G
from kgloom.plans import star
from kgloom.sources import tables

SF = "/root/testdata/sf0.001"


def test_tasks_of_the_star_graph_follow_the_size_of_its_files(spark, monkeypatch):
    keys = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        size = tables.stored_bytes(spark, SF, ("orders", "lineitem"))
        assert size > 10_000
        star.relations(spark, SF)
        assert spark.conf.get(keys[0]) == before[keys[0]]  # small tables need no more partitions
        assert int(spark.conf.get(keys[1])) <= tables.SPLIT_BYTES
        monkeypatch.setattr(tables, "SHUFFLE_BYTES", size // 30)
        star.relations(spark, SF)
        assert int(spark.conf.get(keys[0])) >= 30
        spark.conf.set(keys[0], "5000")
        star.entities(spark, SF)
        assert spark.conf.get(keys[0]) == "5000"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_neighbourhood_makes_only_what_it_reaches_distinct(spark):
    pairs = [("a", "b"), ("a", "b"), ("c", "b"), ("c", "c"), ("d", "c"), ("e", "d"), ("x", "y"), (None, "a")]
    edges = spark.createDataFrame(pairs, "source string, target string")
    starts = spark.createDataFrame([("a",), ("a",)], "id string")
    for hops, want in ((0, {"a": 0}), (1, {"a": 0, "b": 1, None: 1}), (2, {"a": 0, "b": 1, None: 1, "c": 2}), (3, {"a": 0, "b": 1, None: 1, "c": 2, "d": 3})):
        got = G.neighbourhood(edges, starts, hops)
        assert {r.id: r.hop for r in got.collect()} == want and got.count() == len(want)
    plan = G.neighbourhood(edges, starts, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "LocalRelation [source" not in plan  # the edges are read back, not derived for each step


def test_shuffle_files_go_when_rows_are_numbered(spark):
    """The shuffles that went into numbered rows are removed once these are written; the session's setting stays."""
    import time

    from pyspark.sql import functions as F

    from kgloom.operators.graph import ordered_index

    held = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").count("shuffle_")
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = held(), spark.conf.get(setting)
    rows = ordered_index(spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")).distinct(), "k", "n")
    ends = time.time() + 10
    while held() > before and time.time() < ends:
        time.sleep(0.2)
    assert held() <= before and spark.conf.get(setting) == was
    assert [r.n for r in rows.orderBy("k").collect()] == list(range(1, 5001))
