from kgloom.operators import graph as G
from kgloom.plans import graph_queries as Q


def test_renumbering_alone_drops_relations_without_ends(spark):
    entities = spark.createDataFrame([("a", "t", 2), ("b", "t", 1), ("c", None, 3)], "id string, type string, ord long")
    relations = spark.createDataFrame([("a", "b", "r", 2), ("a", "b", "r", 1), ("a", "c", "r", 3), ("x", "b", "r", 4), ("b", "a", None, 5)], "source string, target string, type string, ord long")
    both = [sorted(G.renumber(entities, r)[1].select("source", "target", "type", "ord").collect()) for r in (G.once(relations), G.clean_relations(entities, relations))]
    assert both[0] == both[1] == [("e1", "e2", "", 5), ("e2", "e1", "r", 1)]


def test_kg_renumber_joins_each_end_once(spark):
    plan = Q.kg_renumber(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and "metricValue" not in plan
