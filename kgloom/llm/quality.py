"""Operator 11: quality rules as a short-circuit cascade, with DataFrame functions only.

Every text is measured once (words, symbols, repeated lines and repeated windows of three words).  A text that fails the base rules is
rejected on these measures alone; the other rules are asked one after the other, and a text that one of them rejects meets no
further rule.  Their order comes from a bounded sample: each rule's cost is timed and its verdicts are kept, and the next
rule is always the one that rejects most per second among the texts that the rules before it let pass.  The order changes the time only: a text is kept
if no rule rejects it, in any order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import bind, materialize, spare_name

#: Base rules: fewer words, or more than this percentage of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Words of a window whose repeats count.
WINDOW = 3
#: Rows that are timed, about.
SAMPLE_ROWS = 2000
#: Timings of each rule, the least of which counts, and what a timing counts at least.
TIMINGS, LEAST_S = 2, 1e-4
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_WS, _BLANKS = r"\x20\x09-\x0D", " \t\n\x0b\x0c\r"
#: Bits of a packed key that hold the place of a window; a text of 2 GB has no more words.
_PLACE = 30


@dataclass(frozen=True)
class Rule:
    """``rejects``: from the text and the measures (a dict of columns by name) to a boolean; null counts as false."""

    name: str
    rejects: Callable[[Column, dict[str, Column]], Column]


def _left(text: Column, others: str) -> Column:
    """How many characters are left without runs of ``others``."""
    return F.length(F.regexp_replace(text, f"{others}+", ""))


def _lines(text: Column) -> Column:
    """The lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{_WS}]"))


def _share_of_lines(text: Column, pattern: str, most: float) -> Column:
    return bind(_lines(text), lambda lines: F.size(F.filter(lines, lambda x: x.rlike(pattern))) > most * F.size(lines))


#: Thresholds as in published filters of web corpora, wider where languages differ.
RULES = (
    Rule("symbols", lambda text, m: m["n_symbols"] > 0.1 * m["n_words"]),
    Rule("word length", lambda text, m: ~(m["word_chars"] / m["n_words"]).between(2.0, 30.0)),
    Rule("repeated lines", lambda text, m: m["n_dup_lines"] > 0.4 * F.size(_lines(text))),
    Rule("few letters", lambda text, m: F.regexp_count(text, F.lit(rf"(?<![^{_WS}])[^{_WS}\p{{L}}]*+\p{{L}}")) < 0.8 * m["n_words"]),
    Rule("capitals", lambda text, m: _left(text, r"\P{Lu}") > 0.5 * _left(text, r"\P{L}")),
    Rule("exclamations", lambda text, m: _left(text, "[^!]") > 0.5 * m["n_words"]),
    Rule("digits", lambda text, m: _left(text, "[^0-9]") > 0.3 * m["word_chars"]),
    Rule("ellipses", lambda text, m: _share_of_lines(text, r"(?:\.\.\.|…)[\x20\x09-\x0D]*\z", 0.3)),
    Rule("bullets", lambda text, m: _share_of_lines(text, r"^[\x20\x09-\x0D]*[-*•]", 0.9)),
    Rule("unbroken run", lambda text, m: text.rlike("(?<![!-~])[!-~]{1000}")),
    Rule("placeholder", lambda text, m: text.rlike("(?i)lorem ipsum")),
)


def _repeated(words: Column) -> Column:
    """How many of ``words`` lie in a window that occurs twice or more.

    Hashes of windows are sorted together with their places; only windows whose hash has a neighbour are then compared as texts, so a
    collision changes nothing.  Time and memory go with n log n of one text.
    """

    def window(w: Column, i: Column) -> list[Column]:
        return [F.get(w, i + k) for k in range(WINDOW)]

    def beside(rows: Column, of: Callable[[Column], Column]) -> Column:
        """The entries of sorted ``rows`` that agree with one next to them."""
        return F.filter(rows, lambda x, j: (of(x) == of(F.get(rows, j - 1))) | (of(x) == of(F.get(rows, j + 1))))

    def covered(starts: Column) -> Column:
        moved = lambda k: F.transform(starts, lambda i: i + k)
        later = [moved(k) for k in range(1, WINDOW)]
        return F.size(reduce(F.array_union, later, starts))

    def compared(w: Column, found: Column) -> Column:
        texts = F.transform(found, lambda x: F.struct(F.concat_ws(" ", *window(w, x)).alias("g"), x.alias("i")))
        again = bind(F.sort_array(texts), lambda rows: F.transform(beside(rows, lambda x: x["g"]), lambda x: x["i"]))
        return bind(again, covered)

    def candidates(w: Column, h: Column) -> Column:
        keys = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))), lambda x, i: F.shiftleft(F.xxhash64(*window(h, i)), _PLACE).bitwiseOR(i))
        found = bind(F.sort_array(keys), lambda rows: F.transform(beside(rows, lambda x: F.shiftright(x, _PLACE)), lambda x: x.bitwiseAND((1 << _PLACE) - 1).cast("int")))
        return bind(found, lambda p: F.when(F.size(p) > 0, compared(w, p)).otherwise(0))

    return bind(F.transform(words, lambda x: F.xxhash64(x)), lambda h: candidates(words, h))


def measure_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``MEASURES`` (longs), which replace columns of these names; a null text has 0 of each."""
    both, text = spare_name(docs, "both"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.when(text.rlike(f"[^{_WS}]"), F.split(F.btrim(text, F.lit(_BLANKS)), f"[{_WS}]+")).otherwise(F.array().cast("array<string>"))
    # A projection of its own, as what is split is used twice.
    rows = docs.withColumn(both, bind(words, lambda w: F.struct(F.size(w).alias("n"), _repeated(w).alias("r"))))
    made = {
        "n_words": F.col(both)["n"],
        "word_chars": _left(text, f"[{_WS}]").cast("long"),
        "n_symbols": _left(text, r"[^#*$%&|<>]"),
        "n_dup_lines": bind(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": F.col(both)["r"],
    }
    return rows.withColumns({k: v.cast("long") for k, v in made.items()}).drop(both)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _verdicts(rules: Sequence[Rule], text_col: str) -> list[Column]:
    measures = {m: F.col(m) for m in MEASURES}
    return [F.coalesce(r.rejects(F.col(text_col).cast("string"), measures), F.lit(False)) for r in rules]


def cheapest_order(costs: Sequence[float], patterns: dict[int, int]) -> list[int]:
    """Rules in the order of rejections per cost, each among what the rules before it leave.

    ``patterns``: how many texts each set of rejecting rules (a bit mask) has.  Rules that reject nothing more come last, the cheapest first.
    """
    left, order = dict(patterns), []
    while len(order) < len(costs):
        gain = {i: sum(n for mask, n in left.items() if mask >> i & 1) for i in range(len(costs)) if i not in order}
        best = min(gain, key=lambda i: (-gain[i] / costs[i], costs[i], i))
        order.append(best)
        left = {mask: n for mask, n in left.items() if not mask >> best & 1}
    return order


def plan_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> list[Rule]:
    """The rules in the order that a sample of ``docs`` shows to be the cheapest.

    About ``sample_rows`` rows are drawn at random, measured, and written once; what reaches the driver is one
    count for each set of rules that reject a sampled text together.  Without rows, or where no sampled row passes the base rules, the order is that given.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    # Drawn before it is measured: measures cost more than all rules.
    drawn = measure_texts(docs.sample(share, seed).select(text_col), text_col)
    sample = materialize(drawn.where(~base_failed()), "sample")
    verdicts = _verdicts(rules, text_col)
    mask = sum((v.cast("long") * (1 << i) for i, v in enumerate(verdicts)), F.lit(0).cast("long"))
    patterns = {r["mask"]: r["n"] for r in sample.groupBy(mask.alias("mask")).agg(F.count("*").alias("n")).collect()}
    if not patterns:
        return list(rules)

    def seconds(rejects: Column) -> float:
        job = sample.agg(F.sum(F.length(text_col)), F.sum("n_words"), F.count_if(rejects))
        took = []
        for _ in range(TIMINGS):
            began = time.perf_counter()
            job.collect()
            took.append(time.perf_counter() - began)
        return min(took)

    scan = seconds(F.col("n_words") < 0)
    costs = [max(LEAST_S, seconds(v) - scan) for v in verdicts]
    return [rules[i] for i in cheapest_order(costs, patterns)]


def apply_cascade(measured: DataFrame, rules: Sequence[Rule], text_col: str = "text") -> DataFrame:
    """``measured`` with ``base_failed``, ``rejected_by`` (string) and ``kept`` (boolean); rules are asked in their order until one rejects."""
    chain = F.when(F.col("base_failed"), F.lit("base"))
    for rule, rejects in zip(rules, _verdicts(rules, text_col), strict=True):
        chain = chain.when(rejects, F.lit(rule.name))
    rows = measured.withColumn("base_failed", base_failed())
    return rows.withColumn("rejected_by", chain).withColumn("kept", F.col("rejected_by").isNull())


def quality_rules(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, order: Sequence[Rule] | None = None, **options) -> DataFrame:
    """``docs`` with ``MEASURES``, ``base_failed``, ``rejected_by`` and ``kept``, a row for each row; columns of these names are replaced.

    ``order``: the rules as ``plan_cascade`` has put them, found by it from ``docs`` by default.  ``rejected_by`` names the first rule in that
    order (``base`` for the base rules), which may differ between plans; ``kept`` doesn't.  A null or empty text has no words and fails the base rules.
    Words end at ASCII white space; texts of any length are read whole.  Rows are independent of each other, so repeated rows agree and an empty table gives
    none.
    """
    order = plan_cascade(docs, rules, text_col, **options) if order is None else order
    return apply_cascade(measure_texts(docs, text_col), order, text_col)


#: The same rows in DuckDB's SQL; the rules in the order of RULES, as a verdict doesn't depend on it.
QUALITY_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT row_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT row_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
a AS (SELECT row_id, i FROM (SELECT *, count(*) OVER (PARTITION BY row_id, g) AS n FROM g) WHERE n > 1),
r AS (SELECT row_id, count(DISTINCT i + k) AS n FROM a, (SELECT unnest([0, 1, 2]) AS k) GROUP BY row_id),
m AS (
  SELECT doc_id, text, lines, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN r USING (row_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(
    n_symbols > 0.1 * n_words
    OR NOT (word_chars / n_words BETWEEN 2 AND 30)
    OR n_dup_lines > 0.4 * len(lines)
    OR len(regexp_extract_all(text, '[^\x20\x09-\x0D]*\p{L}[^\x20\x09-\x0D]*')) < 0.8 * n_words
    OR length(regexp_replace(text, '\P{Lu}+', '', 'g')) > 0.5 * length(regexp_replace(text, '\P{L}+', '', 'g'))
    OR length(regexp_replace(text, '[^!]+', '', 'g')) > 0.5 * n_words
    OR length(regexp_replace(text, '[^0-9]+', '', 'g')) > 0.3 * word_chars
    OR len(list_filter(lines, lambda x: regexp_matches(x, '(?:\.\.\.|…)[\x20\x09-\x0D]*\z'))) > 0.3 * len(lines)
    OR len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) > 0.9 * len(lines)
    OR regexp_matches(text, '[!-~]{1000}')
    OR regexp_matches(text, '(?i)lorem ipsum'), FALSE) AS kept
FROM b
"""
