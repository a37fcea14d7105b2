"""The overlap join loses no pair, and its bounds hold."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from kgloom.functions.text import multiset_bound, ratio, ratios, runs_bound
from kgloom.operators import overlap
from kgloom.operators.match import fuzzy_first_match
from kgloom.operators.overlap import scored_pairs, similar_pairs


def variants(rng, n):
    """Names of all lengths, many of them some edits away from another."""
    out = set()
    while len(out) < n:
        base = rng.choice(sorted(out)) if out and rng.random() < 0.7 else "".join(rng.choice("abcdeÉ é12") for _ in range(rng.randint(1, 26)))
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(base))
            base = rng.choice([base[:i] + rng.choice("abxÉ") + base[i:], base[:i] + base[i + 1 :], base[i:] + base[:i], base.upper()])
        out.add(base)
    return sorted(out)


@pytest.mark.parametrize("threshold", [0.4, 0.75, 0.8, 0.9, 0.95, 0.98, 1.0])
def test_no_pair_is_lost(spark, threshold):
    names = [n for n in variants(random.Random(int(threshold * 100)), 260) if n]
    df = spark.createDataFrame([(n,) for n in [*names, "", None]], "a string")
    got = {(r.a, r.b) for r in similar_pairs(df, df.withColumnRenamed("a", "b"), threshold).collect()}
    expected = {(a, b) for a, b in itertools.product(names, names) if ratio(a, b) >= threshold}
    assert expected <= got and len(expected) >= len(names)
    if threshold >= 0.9:
        assert len(got) <= 3 * len(expected)


def test_names_that_differ_in_digits_dont_all_meet(spark):
    """Of 300 numbered names the few that one character apart allows are proposed, where nearly all 90,000 pairs were listed together."""
    names = [f"Customer#{i * 7919 % 1_000_000_000:09d}" for i in range(300)] + ["Customer#000000001x", "Customer#00000000"]
    df = spark.createDataFrame([(n,) for n in names], "a string")
    listed_pairs = similar_pairs(df, df.withColumnRenamed("a", "b"), 0.9)
    assert {(a, b) for a, b in itertools.product(names, names) if ratio(a, b) >= 0.9} <= {(r.a, r.b) for r in listed_pairs.collect()}
    ranks = [""]
    of = lambda c, left: overlap.listed(df.withColumnRenamed("a", c), c, F.lit(0.9), ranks, [17, 18, 19], left)
    assert of("a", True).join(of("b", False).drop("_len"), "_key").select("a", "b").distinct().count() < 9_000


def test_bounds_hold(spark):
    rng = random.Random(9)
    names = variants(rng, 120)
    pairs = [(a, b, ratio(a, b)) for a in names for b in names if a and b]
    df = spark.createDataFrame(pairs, "a string, b string, r double")
    assert df.where((runs_bound(F.col("a"), F.col("b")) < F.col("r") - 1e-9) | (multiset_bound(F.col("a"), F.col("b")) < F.col("r") - 1e-9)).count() == 0


def test_first_match_with_blocks_and_ties(spark):
    rows = [(1, "x", "acme holding", 5), (2, "x", "acme holdings", 3), (3, "x", "zeta", 1), (4, "y", "acme holding", 0), (5, "x", None, 2), (6, "x", "", 2), (7, "x", "acme holding", 9)]
    df = spark.createDataFrame(rows, "id long, part string, name string, ord long")
    got = {(r.id, r.match_id) for r in fuzzy_first_match(df, df, 0.8, ["part"]).collect()}
    assert got == {(1, 2), (2, 2), (3, 3), (4, 4), (7, 2)}


def test_ratios_of_many_pairs():
    """Pairs compared at once have the similarity of one pair's own comparison, ties of blocks, long names and letters of any size included."""
    rng = random.Random(3)
    a = ["", None, "x" * 63 + "y", "ab" * 40, "İx", "a\0", *(rng.choice(variants(rng, 40)) * rng.randint(1, 3) for _ in range(50))] * 40
    b = [None if x is None else "".join(c for c in x if rng.random() < 0.9) + rng.choice(["", "ab", "0\0", "\U0001f600"]) for x in a]
    a += ["".join(rng.choice("01") for _ in range(18)) for _ in range(6000)]
    b += ["".join(rng.choice("01") for _ in range(18)) for _ in range(6000)]
    assert ratios(a, b).tolist() == [ratio(x, y) for x, y in zip(a, b, strict=True)]


def test_pairs_are_scored_once_and_in_many_tasks(spark):
    """Of 3000 numbered names, all pairs that are similar come with their similarity; neither side's lists are broadcast, nor pairs written."""
    names = [f"Customer#{i:09d}" for i in range(0, 9000, 3)] + ["y" * 70, "y" * 71, "Bolt", "bolt", "bolts"]
    got = scored_pairs(spark.createDataFrame([(n,) for n in names], "a string"), 0.9)
    rows = {(r.a, r.b): r.score for r in got.collect()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "Scan parquet" not in plan
    some = [n for i, n in enumerate(names) if i % 50 == 0 or i >= 3000]
    for a in some:
        assert {(b, rows[a, b]) for b in names if (a, b) in rows} == {(b, ratio(a, b)) for b in names if a < b and ratio(a, b) >= 0.9}
    assert all(a < b for a, b in rows)
