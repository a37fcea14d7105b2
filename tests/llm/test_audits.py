"""Quality rules, whitening and source divergence against brute force, and on awkward tables."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.llm import divergence as D
from kgloom.llm import quality as Q
from kgloom.llm import whitening as W

DOCS = "doc_id long, text string, lang string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    """Nulls, empty and long texts, ties, repeated rows, words that repeat in all ways, and columns whose names clash with results."""
    rng = random.Random(5)
    word = lambda n=6: "".join(rng.choice("abcdéfg") for _ in range(rng.randint(1, n)))
    rows = [(1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "en", None), (4, "a a a a", "en", "b"), (None, "no id here", "en", "a"), (5, "x " * 3000, "de", "a"), (6, "1" * 200_000, "de", "b")]
    rows += [(7, "a b c a b c x\n\na b c\n a b c\na b c", "en", "b"), (8, " ".join(word(2) for _ in range(40_000)), "en", "c"), (9, "é" * 5000 + " À🦆 z", "fr", "a")]
    rows += [(10 + i, "\n".join(" ".join(word(3) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 9))), rng.choice(["en", "de", "", None]), rng.choice(["a", "b", "ä", "", None])) for i in range(150)]
    rows += [(200, "BIG SHOUTING! WORDS! " * 30 + " ".join(word(8).upper() for _ in range(120)), "en", "a"), (201, " | ".join(word(9) for _ in range(90)), "en", "a"), (202, " ".join(word(9) for _ in range(90)) + " Lorem Ipsum", "en", "a")]
    rows += [(203, "\n".join(" ".join(word(9) for _ in range(12)) + " ..." for _ in range(9)), "en", "a"), (204, " ".join(word(9) for _ in range(90)), "en", "a"), (204, " ".join(word(9) for _ in range(90)), "en", "a")]
    df = spark.createDataFrame(rows + rows[-1:], DOCS)
    return df.withColumns({"n_words": F.lit("x"), "kept": F.lit("y"), "_both": F.lit(1), "term": F.lit(2), "chunk": F.lit(3), "rank": F.lit(4), "i": F.lit(0)})


def measured(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len({i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)})


def test_measures_against_brute_force(texts):
    got = Q.measure_texts(texts).select("doc_id", "text", *Q.MEASURES).collect()
    assert len(got) == texts.count()
    for r in got:
        assert tuple(r[m] for m in Q.MEASURES) == measured(r.text), r.doc_id


def test_verdicts_by_rule(spark, texts):
    got = Q.quality_rules(texts)
    assert len(got.columns) == len(set(got.columns))
    by = defaultdict(set)
    for r in got.collect():
        assert r.kept == (r.rejected_by is None) and r.base_failed == (r.rejected_by == "base")
        by[r.doc_id].add(r.rejected_by)
    assert by[1] == by[2] == by[4] == by[5] == by[6] == {"base"} and by[204] == {None}
    assert by[201] <= {"symbols", "few letters"} and by[202] == {"placeholder"} and by[203] == {"ellipses"} and by[200] <= {"capitals", "base"}
    assert Q.quality_rules(texts.where("false")).collect() == []


def test_order_changes_no_verdict_and_stops_early(spark, texts):
    measures = Q.measure_texts(texts)
    kept = {tuple(sorted((str(r.doc_id), r.kept) for r in Q.apply_cascade(measures, order, "text").collect())) for order in (Q.RULES, Q.RULES[::-1])}
    assert len(kept) == 1
    # A rule that fails on texts that the rule before it rejects is never asked about them.
    first = Q.Rule("long words", lambda text, m: m["word_chars"] > 2 * m["n_words"])
    trap = Q.Rule("trap", lambda text, m: F.when(m["word_chars"] > 2 * m["n_words"], F.raise_error(F.lit("asked"))).otherwise(F.lit(False)).cast("boolean"))
    assert Q.apply_cascade(measures, [first, trap], "text").where("rejected_by = 'trap'").count() == 0
    with pytest.raises(Exception, match="asked"):
        Q.apply_cascade(measures, [trap, first], "text").collect()


def test_cheapest_order_looks_at_what_is_left():
    # Rule 0 rejects the same 90 texts as rule 1 at twice the cost, so rule 2 goes before it.
    assert Q.cheapest_order([2.0, 1.0, 4.0], {0b011: 90, 0b100: 20, 0: 50}) == [1, 2, 0]
    rng = random.Random(2)
    for _ in range(30):
        costs, patterns = [rng.uniform(0.1, 3) for _ in range(4)], {rng.randrange(16): rng.randint(1, 50) for _ in range(6)}

        def spent(order):
            return sum(costs[i] * sum(n for mask, n in patterns.items() if not any(mask >> j & 1 for j in order[:k])) for k, i in enumerate(order))

        # Published bound of the greedy order: four times the least.
        assert spent(Q.cheapest_order(costs, patterns)) <= 4 * min(spent(o) for o in itertools.permutations(range(4))) + 1e-9


def test_plan_is_the_rules_in_some_order(spark, texts):
    assert sorted(r.name for r in Q.plan_cascade(texts)) == sorted(r.name for r in Q.RULES)
    assert Q.plan_cascade(texts.where("false")) == list(Q.RULES)


# ---- whitening --------------------------------------------------------------------------------------------------


def plain_whitening(vectors):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(int) + 100_000
    n, sums = len(x), x.sum(axis=0)
    d = n * x.astype(object) - sums
    c = d.astype(float) / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    return n, (d * d).sum(axis=1), values[::-1], c @ axes[:, ::-1]


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(y) for y in rng.normal(size=12) * np.arange(1, 13) + 3], "z") for i in range(300)]
    odd = [(900, None, "z"), (901, [], "z"), (902, [1.0, None] * 6, "z"), (903, [float("nan")] * 12, "z"), (904, [float("inf")] + [0.0] * 11, "z"), (905, [1.0] * 11, "z"), (906, [1e300] * 12, "z")]
    rows += [(7, rows[7][1], "z"), (None, rows[8][1], "z")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, whitened string").withColumn("component", F.lit("c"))
    got = defaultdict(list)
    for r in W.whiten(df.repartition(7)).collect():
        got[r.vec_id].append(r)
    n, deviation, values, projected = plain_whitening([v for _, v, _ in rows])
    assert set(got) == {i for i, *_ in rows} and len(got[7]) == 16 and n == 302
    signs = None
    for (i, *_), dev, p in zip(rows, deviation, projected):
        own = sorted(got[i], key=lambda r: r.component)[:: 2 if i == 7 else 1]
        assert [r.component for r in own] == list(range(1, 9)) and {(r.n, r.deviation) for r in own} == {(n, dev)}
        y = np.array([r.whitened for r in own])
        plain = p[:8] / np.sqrt(values[:8])
        signs = np.sign(y * plain) if signs is None else signs
        np.testing.assert_allclose(y, signs * plain, atol=1e-9)
        np.testing.assert_allclose([r.explained for r in own], values[:8] / values.sum(), rtol=1e-9)
        assert own[0].identity_error < 1e-9


def test_whitening_without_variance(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert W.whiten(frame([])).collect() == [] and W.whiten(frame([(1, None)])).collect() == []
    got = W.whiten(frame([(1, [0.5, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(1, 1, 0, 0.0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0, 0.0)]
    got = W.whiten(frame([(1, [0.5, 2.0, 1.0]), (2, [0.5, 3.0, 1.0])])).collect()
    first = [r for r in got if r.component == 1]
    assert sorted(round(r.whitened, 9) for r in first) == [-1.0, 1.0] and all(r.identity_error < 1e-9 for r in got) and all(r.whitened == 0 for r in got if r.component > 1)


def test_deviation_beyond_a_long():
    x = np.array([[1 << 40, 0], [0, 1 << 40], [5, 6]])
    assert W.squared_deviation(x, 3, x.sum(axis=0).astype(object)) == [None, None, None]
    small = np.array([[1, 2], [3, 4]])
    assert W.squared_deviation(small, 2, np.array([4, 6], object)) == [8, 8]
    assert W.squared_deviation(small, 1 << 31, np.array([1 << 31, 1 << 32], object)) == [0, None]


# ---- source divergence ------------------------------------------------------------------------------------------


def plain_divergence(rows, least=3, top=200):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [(la or "", so or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (te or "").translate(lower))) for te, la, so in rows]
    out = []
    for lang in {x[0] for x in found}:
        seen = Counter(t for la, _, ts in found if la == lang for t in set(ts))
        kept = sorted(t for t, n in seen.items() if n >= least)
        count = defaultdict(Counter)
        for la, so, ts in found:
            if la == lang:
                count[so].update(t for t in ts if seen[t] >= least)
        whole = sum(count.values(), Counter())

        def p(c):
            total = sum(c.values()) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        ps, q = {s: p(c) for s, c in count.items()}, p(whole)
        for s in ps:
            parts = {"pair": [(sum((ps[s][t] - ps[o][t]) ** 2 // ps[o][t] for t in kept), o) for o in ps if o != s]}
            parts["term"] = [((ps[s][t] - q[t]) ** 2 // q[t], t) for t in kept if count[s][t] and ps[s][t] > q[t]]
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(items, 1) if part == "pair" or i <= top]
    return sorted(out)


@pytest.mark.parametrize("chunk", [1, 7, 512])
def test_divergence_against_brute_force(texts, chunk):
    expected = plain_divergence([(r.text, r.lang, r.source) for r in texts.collect()], top=15)
    got = D.source_divergence(texts, top_terms=15, chunk_terms=chunk)
    assert sorted(map(tuple, got.collect())) == expected and len(expected) > 200


def test_divergence_awkward(spark, texts):
    assert D.source_divergence(texts.where("false")).collect() == []
    few = spark.createDataFrame([(1, None, None, None), (2, "word", None, "b"), (3, "", "x", "a"), (4, "z" * 300_000, "x", "ü")], DOCS)
    assert sorted(map(tuple, D.source_divergence(few).collect())) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1), ("x", "a", "pair", "ü", 0, 1), ("x", "ü", "pair", "a", 0, 1)]


def test_parts_per_billion_is_exact():
    rng = random.Random(8)
    counts = [rng.randrange(10 ** rng.randint(1, 15)) for _ in range(500)]
    totals = [c + rng.randint(1, 10 ** rng.randint(1, 15)) for c in counts]
    got = D.parts_per_billion(np.array(counts), np.array(totals))
    assert got.tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(counts, totals)]
