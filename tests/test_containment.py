"""The containment index against all pairs."""

import random

from kgloom.operators.diagnose import contained_names, lost_entities


def test_contained_names(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 6)))
    short = {("t", word()) for _ in range(150)} | {("u", "holding"), ("u", ""), ("t", "old")}
    long = {("t", word() + word() + word()) for _ in range(150)} | {("u", f"holding {i}{word()}") for i in range(90)} | {("u", f"firm {i}") for i in range(10)} | {("t", "holdings")}
    got = contained_names(spark.createDataFrame(sorted(short), "type string, name string"), spark.createDataFrame(sorted(long), "type string, other string"))
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted((t, a, b) for t, a in short for u, b in long if t == u and a in b) and len(rows) > 300


def test_lost_within_words(spark):
    schema = "id string, type string, name string, page int, ord long"
    before = spark.createDataFrame([("a", "kg:Company", "Hold", 1, 1), ("b", "kg:Company", "Acme Holdings Ltd", 1, 2), ("c", "kg:Company", "Zeta", 2, 3), ("d", "kg:SomeContext", "Hold", 2, 4), ("e", "kg:Company", "old", None, 5)], schema)
    after = spark.createDataFrame([("x", "kg:Company", "holdings", 1, 1), ("y", "kg:SomeContext", "zzz", 1, 2)], schema).drop("page")
    got = {r.id: r.reason.split(" ")[0] for r in lost_entities(before, after).collect()}
    assert got == {"a": "Merged", "b": "Merged", "c": "Unknown", "d": "Context", "e": "Merged"}
    assert lost_entities(before, before).collect() == []
