"""The merge across tasks compares only names that another name could be similar to, and brings together only values of entities of several rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from kgloom.functions.text import ratio
from kgloom.operators import match as M
from kgloom.operators import settle
from kgloom.operators.overlap import with_partners


def test_numbered_names_are_not_compared(spark, monkeypatch):
    """Names of which each differs from all others by too much for its type meet no other name, but repeated ones are merged."""
    rows = [("p", i, "d", f"o{i}", "kg:TransactionContext", json.dumps({"contextName": f"Order {i % 300}", "status": "F"})) for i in range(400)]
    rows += [("p", 400 + i, "d", f"c{i}", "kg:Company", json.dumps({"name": f"Customer#{i:09d}"})) for i in range(100)]
    rows += [("p", 500 + i, "d", f"m{i}", "kg:FinancialMetric", json.dumps({"metricName": f"Order total {i}"})) for i in range(20)]
    compared, values, pairs, bring = [], [], settle.similar_pairs, settle._merge_values
    monkeypatch.setattr(settle, "similar_pairs", lambda a, *rest: (compared.extend(r["a"] for r in a.collect()), pairs(a, *rest))[1])
    monkeypatch.setattr(settle, "_merge_values", lambda documents: values.append(documents) or bring(documents))
    frame = spark.createDataFrame(rows, "project string, ord long, doc string, id string, type string, attrs_json string")
    kept, went = settle.merged_across(frame, "project", M.project_rules(), "doc", documents=True)
    assert sorted(compared) == sorted(f"order total {i}" for i in range(20)) and values == [True]
    counts = {r["kind"]: (r["n"], r["rows"]) for r in kept.groupBy(F.substring_index("type", ":", -1).alias("kind")).agg(F.count("*").alias("n"), F.sum("n").alias("rows")).collect()}
    assert counts["TransactionContext"] == (300, 400) and counts["Company"] == (100, 100) and counts["FinancialMetric"][1] == 20
    assert went.count() == 520


@pytest.mark.parametrize("least", [0.6, 0.8, 0.95])
def test_partners_by_lengths(spark, least):
    """No name that is similar to another is left out."""
    rng = random.Random(5)
    names = sorted({"".join(rng.choices("ab ", k=rng.choice([1, 4, 12, 13, 19, 30]))) for _ in range(200)})
    kept = {r["name"] for r in with_partners(spark.createDataFrame([("k", n) for n in names], "kind string, name string"), "name", F.lit(least), ["kind"]).collect()}
    assert {x for a in names for b in names if a != b and ratio(a, b) >= least for x in (a, b)} <= kept
