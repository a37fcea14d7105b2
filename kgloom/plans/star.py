"""The driver's tables seen as a knowledge graph, in Spark and in SQL.

Regions and nations are locations, customers and suppliers companies, parts products, orders
transactions with a financial metric each.  Some rows are made faulty on purpose (by key): types
and relations that no ontology declares, relations to entities that don't exist, and repeated relations.
``ord`` keeps the order that the graph operators need.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from kgloom.sources.tables import bound_tasks, table

ATTRIBUTES = ("name", "locationName", "contextName", "metricName", "metricValue", "DateOrPeriod", "brand", "status", "segment")

_ENTITIES = {
    "region": "SELECT concat('r', r_regionkey) AS id, 'kg:Location' AS type, CAST(r_regionkey AS BIGINT) AS ord, 'geo' AS doc, r_name AS locationName FROM region",
    "nation": "SELECT concat('n', n_nationkey) AS id, 'kg:Location' AS type, 1000000000 + CAST(n_nationkey AS BIGINT) AS ord, 'geo' AS doc, n_name AS locationName FROM nation",
    "customer": "SELECT concat('c', c_custkey) AS id, 'kg:Company' AS type, 2000000000 + c_custkey AS ord, 'sales' AS doc, c_name AS name, c_mktsegment AS segment FROM customer",
    "supplier": "SELECT concat('s', s_suppkey) AS id, 'kg:Company' AS type, 3000000000 + s_suppkey AS ord, 'supply' AS doc, s_name AS name FROM supplier",
    "part": "SELECT concat('p', p_partkey) AS id, CASE WHEN p_partkey % 50 = 0 THEN 'kg:Gadget' ELSE 'kg:ProductOrService' END AS type, 4000000000 + p_partkey AS ord, 'supply' AS doc, p_name AS name, p_brand AS brand FROM part",
    "orders": "SELECT concat('o', o_orderkey) AS id, 'kg:TransactionContext' AS type, 5000000000 + o_orderkey AS ord, 'sales' AS doc, concat('Order ', o_orderkey) AS contextName, o_orderstatus AS status FROM orders",
    "metric": "SELECT concat('m', o_orderkey) AS id, 'kg:FinancialMetric' AS type, 6000000000 + o_orderkey AS ord, 'sales' AS doc, concat('Order total ', o_orderkey % 100) AS metricName, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS {text}) AS metricValue, CAST(year(o_orderdate) AS {text}) AS DateOrPeriod FROM orders",
}
_RELATIONS = {
    "nation": "SELECT concat('n', n_nationkey) AS source, concat('r', n_regionkey) AS target, 'kg:locatedIn' AS type, CAST(n_nationkey AS BIGINT) AS ord, 'geo' AS doc FROM nation",
    "again": "SELECT concat('n', n_nationkey) AS source, concat('r', n_regionkey) AS target, 'kg:locatedIn' AS type, 1000000000 + CAST(n_nationkey AS BIGINT) AS ord, 'sales' AS doc FROM nation",
    "customer": "SELECT concat('c', c_custkey) AS source, concat('n', c_nationkey) AS target, 'kg:hasHeadquartersIn' AS type, 2000000000 + c_custkey AS ord, 'sales' AS doc FROM customer",
    "supplier": "SELECT concat('s', s_suppkey) AS source, concat('n', s_nationkey) AS target, 'kg:hasHeadquartersIn' AS type, 3000000000 + s_suppkey AS ord, 'supply' AS doc FROM supplier",
    "order": "SELECT concat('o', o_orderkey) AS source, concat('c', o_custkey) AS target, 'kg:involvesCompany' AS type, 4000000000 + o_orderkey AS ord, 'sales' AS doc FROM orders",
    "metric": "SELECT concat('c', o_custkey) AS source, concat('m', o_orderkey) AS target, 'kg:reportsMetric' AS type, 5000000000 + o_orderkey AS ord, 'sales' AS doc FROM orders",
    "offer": "SELECT concat('s', l_suppkey) AS source, concat('p', l_partkey) AS target, 'kg:offersProduct' AS type, 6000000000 + min(l_orderkey * 10 + l_linenumber) AS ord, 'supply' AS doc FROM lineitem GROUP BY l_suppkey, l_partkey",
    "dangling": "SELECT concat('o', o_orderkey) AS source, concat('x', o_orderkey) AS target, 'kg:involvesCompany' AS type, 90000000000 + o_orderkey AS ord, 'sales' AS doc FROM orders WHERE o_orderkey % 97 = 0",
    "undeclared": "SELECT concat('p', p_partkey) AS source, 'r0' AS target, 'kg:soldIn' AS type, 95000000000 + p_partkey AS ord, 'supply' AS doc FROM part WHERE p_partkey % 10 = 0",
}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _frames(spark: SparkSession, sf_dir: str, parts: dict[str, str]) -> DataFrame:
    bound_tasks(spark, sf_dir, _TABLES)
    views = {t: table(spark, sf_dir, t) for t in _TABLES}
    frames = []
    for sql in parts.values():
        name = sql.split(" FROM ")[1].split()[0]
        frames.append(spark.sql(sql.format(text="STRING").replace(f" FROM {name}", " FROM {it}"), it=views[name]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir, _ENTITIES)


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir, _RELATIONS)


#: The start of a DuckDB statement: ``ent`` and ``rel`` as common table expressions, to be continued by ``, x AS (...)`` or SELECT.
SQL = (
    "WITH ent AS ("
    + " UNION ALL BY NAME ".join(s.format(text="VARCHAR") for s in _ENTITIES.values())
    + "), rel AS ("
    + " UNION ALL ".join(_RELATIONS.values())
    + ")"
)
