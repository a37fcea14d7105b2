"""Rules as columns against plain matches of all pairs, and the queries' SQL against the same."""

import random

import duckdb
import pytest

from kgloom.operators import match as M
from kgloom.plans import registry, rule_queries
from tests.plain import kind_of, page_match, strategy_match

SF = "/root/testdata/sf0.001"
KINDS = sorted({*M.BY_TYPE, *M.STRATEGIES})
TEXTS = ["name", "metricName", "kpiName", "headcountName", "fullName", "contextName", "eventName", "locationName", "segmentName", "titleName"]
WORDS = ["acme", "acmes", "acme holding", "Acme, holdings", "zeta bank", "beta bank", "ann lee", "ann b lee", "ann c lee jones", "", None]
SCHEMA = "id string, type string, ord long, " + ", ".join(f"{t} string" for t in TEXTS) + ", alias array<string>, DateOrPeriod string, kpiDateOrPeriod string, dateOrYear string, scope string, status string, typeSought string, eventType string, amount double"


def rows(n, seed):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    out = []
    for i in range(n):
        kind = rng.choice(KINDS + ["other"])
        names = [rng.choice(WORDS) if rng.random() < 0.6 else None for _ in TEXTS]
        out.append((f"i{i}", f"{pick('kg', 'firm', 'organisation')}:{kind.title()}", (i * 37) % n, *names, rng.sample(WORDS[:9], rng.randrange(3)) or None, *(pick("FY21", "fy21 ", "FY22", "", None) for _ in range(4)), *(pick("open", "Open", "shut", None) for _ in range(3)), pick(0.0, 1.5, None)))
    return out


@pytest.mark.parametrize(("rules", "match"), [
    (M.page_rules(), lambda a, b: page_match(a, b, {k: t for k, (_, t) in M.STRATEGIES.items()}, 0.75)), (M.strategy_rules(), strategy_match),
])
def test_first_rule_match(spark, rules, match):
    df = spark.createDataFrame(rows(900, 3), SCHEMA)
    if rules.by_type is not M.BY_TYPE and "advisor" in rules.by_type and rules.by_type["advisor"].alike:
        df = df.drop("scope")  # a missing column is a missing attribute
    entities = [{k: v for k, v in r.asDict().items() if v is not None} for r in df.collect()]
    by_kind = {}
    for e in sorted(entities, key=lambda e: e["ord"]):
        by_kind.setdefault(kind_of(e), []).append(e)
    expected = {(e["id"], next((o["id"] for o in by_kind[kind_of(e)] if match(e, o)), None)) for e in entities if kind_of(e) != "other"}
    got = {(r.id, r.match_id) for r in M.first_rule_match(df, df, rules, KINDS).collect()}
    assert got == {x for x in expected if x[1]} and len(got) > 200
    assert M.first_rule_match(df.where("false"), df, rules, KINDS).collect() == []


@pytest.mark.parametrize("name", sorted(rule_queries.QUERIES))
def test_rule_query_against_all_pairs(spark, name):
    """The queries' SQL says equal names where the rule says similar ones, so it is held to the rule itself."""
    ents, rules, match = rule_queries.CASES[name]
    entities = [{k: v for k, v in r.asDict().items() if v is not None} for r in ents(spark, SF).orderBy("ord").collect()]
    plain = {"page": lambda a, b: page_match(a, b, {}, 0.75), "strategy": strategy_match}[match]
    first, expected = {}, set()
    for e in entities:
        key = str({k: v for k, v in e.items() if k not in ("id", "ord")})
        if key not in first:
            first[key] = next((o["id"] for o in entities if plain(e, o)), None)
        expected.add((e["id"], first[key]))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    assert set(con.sql(f"SELECT id, match_id FROM ({registry.ORACLES[name]})").fetchall()) == {x for x in expected if x[1]}
