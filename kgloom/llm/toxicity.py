"""Operator 5: toxicity by weak supervision.

Many voters look at a text: each lexicon word, each word beginning, and a few patterns of writing.
The lexicon is induced from labelled rows, and so is where the label model starts.  That generative model then estimates, by
expectation-maximisation on the votes of labelled and unlabelled rows alike, the share of toxic rows,
how often each voter fires on either class and, from the conditional covariance of votes, which voters repeat each other; correlated voters share one
voice.  A label, where there is one, is one more voter, of a fixed accuracy below 1; the rates seen on labelled rows stay as a weak prior.  Its posteriors are the targets of a linear (logistic) classifier that scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import held_out, materialize, md5_fraction, small_batches
from kgloom.llm.textbytes import slices, span_hashes, utf8

#: The model is fitted on at most so many labelled rows of each class.
SAMPLE_PER_CLASS = 8000
#: The label model also sees the votes of about so many rows without a label at most.
SAMPLE_UNLABELLED = 8000
#: Rows that the rates seen on labelled rows count for in the label model.
STRENGTH = 50.0
#: How often a label is taken to be right.
LABEL_ACCURACY = 0.98
MAX_LEXICON = 400
PREFIXES = (4, 5)
PATTERNS = ("exclaims", "shouts", "short", "clean")

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True
#: A word for Spark: the same runs that _LETTER finds in the bytes of lower-cased text.
WORD = "[a-z\\x{80}-\\x{10FFFF}]+"


@dataclass
class ToxicityModel:
    entries: list[str] = field(default_factory=list)  # words, and beginnings that end in *
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -4.0

    def __post_init__(self) -> None:
        words = [(i, e.encode()) for i, e in enumerate(self.entries) if not e.endswith("*")]
        stems = [(i, e[:-1].encode()) for i, e in enumerate(self.entries) if e.endswith("*")]
        self.word_keys = _keys(words)
        self.stem_keys = {n: _keys([x for x in stems if len(x[1]) == n]) for n in sorted({len(x[1]) for x in stems})}


def _keys(entries: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([len(e) for _, e in entries], dtype=np.int64)
    starts = ends - np.array([len(e) for _, e in entries], np.int64)
    h = span_hashes(np.frombuffer(b"".join(e for _, e in entries), np.uint8), starts, ends)
    order = np.argsort(h)
    return h[order], np.array([i for i, _ in entries], np.int64)[order]


def _find(h: np.ndarray, keys: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``h`` are keys, and the entries of those."""
    if not len(keys[0]) or not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(keys[0], h), len(keys[0]) - 1)
    hit = np.flatnonzero(keys[0][at] == h)
    return hit, keys[1][at[hit]]


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    solid = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros_like(solid), np.zeros_like(solid)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))


def votes(model: ToxicityModel, lower: pa.Array, capitals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which voter fires in which text: (rows, voters), distinct.  ``capitals``: upper-case letters of each text."""
    data, offsets = utf8(lower)
    n, voters = len(offsets) - 1, len(model.entries) + len(PATTERNS)
    fired = np.zeros(0, np.int64)
    for i, j in slices(offsets):
        own, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        size = np.diff(off)
        if len(own):
            starts, ends, docs = _spans(own, off)
            hit, entry = _find(span_hashes(own, starts, ends), model.word_keys)
            got = [docs[hit] * voters + entry]
            for length, keys in model.stem_keys.items():
                longer = np.flatnonzero(ends - starts > length)
                hit, entry = _find(span_hashes(own, starts[longer], starts[longer] + length), keys)
                got.append(docs[longer[hit]] * voters + entry)
            bangs = np.diff(np.concatenate([[0], np.cumsum(own == ord("!"))])[off])
        else:
            got, bangs = [], np.zeros(j - i, np.int64)
        got = np.unique(np.concatenate([*got, np.empty(0, np.int64)]))
        quiet = np.setdiff1d(np.arange(j - i), got // voters)
        rest = [bangs * 50 > size, capitals[i:j] * 2 > size, size < 200]
        got = [got, *(np.flatnonzero(x) * voters + len(model.entries) + k for k, x in enumerate(rest)), quiet * voters + voters - 1]
        fired = np.concatenate([fired, *(g + i * voters for g in got)])
    fired = np.sort(fired)
    return fired // voters, fired % voters


def label_model(
    v: np.ndarray, weight: np.ndarray, prior: float, expected1: np.ndarray, expected0: np.ndarray, strength: float = STRENGTH, rounds: int = 40, told: np.ndarray | float = 0.0
) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row of the votes ``v`` (rows, voters; 0/1) of weight ``weight``, and each voter's voice.

    The share of class 1 and each voter's rates of firing on both classes are estimated by EM on the votes and on what is ``told``; ``prior``,
    ``expected1`` and ``expected0`` are where it starts, and the rates also count as ``strength`` rows.  ``told`` are the log-odds that a row's label, a voter of
    known accuracy that most rows lack, adds.  A voter's voice is divided
    by the sum of its correlations, given the class, above 0.6.
    """
    weight = weight * (len(v) / weight.sum())
    n = len(v)
    voice, r1, r0, share = np.ones(v.shape[1]), expected1, expected0, prior
    for step in range(rounds):
        fires, rests = (np.log(np.clip(a, 1e-5, 1 - 1e-5) / np.clip(b, 1e-5, 1 - 1e-5)) for a, b in ((r1, r0), (1 - r1, 1 - r0)))
        odds = v @ (voice * (fires - rests)) + (voice * rests).sum() + np.log(share / (1 - share)) + told
        toxic = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        mass = float((weight * toxic).sum())
        share = float(np.clip((mass + strength * prior) / (n + strength), 1e-4, 1 - 1e-4))
        r1 = (v.T @ (weight * toxic) + strength * expected1) / (mass + strength)
        r0 = (v.T @ (weight * (1 - toxic)) + strength * expected0) / (n - mass + strength)
        if step in (0, 5, 15, 25):
            rest = v - np.outer(toxic, r1) - np.outer(1 - toxic, r0)
            cov = (rest * weight[:, None]).T @ rest / n
            sd = np.sqrt(np.diag(cov)) + 0.01  # a voter that the class explains wholly repeats none
            rho = np.abs(cov / np.outer(sd, sd))
            np.fill_diagonal(rho, 1)
            voice = 1 / np.where(rho > 0.6, rho, 0).sum(axis=0)
    return toxic, voice


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-6, rounds: int = 60) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the last coefficient is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    weight = weight / weight.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _prepared(docs: DataFrame, *more: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    capitals = F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return docs.select("doc_id", *more, F.lower(text).alias("text"), (F.length(text) - capitals).alias("capitals"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS, max_lexicon: int = MAX_LEXICON, unlabelled: int = SAMPLE_UNLABELLED) -> ToxicityModel:
    """Learn from ``labels(doc_id, toxic)`` of rows that aren't held out, at most ``sample_per_class`` of each class, and from the
    texts of about ``unlabelled`` rows at most that have no label and aren't held out.

    Without labels of both classes the model scores every text near 0.  Lexicon counts and the votes of
    the sample come to the driver; both are bounded by the parameters.
    """
    small_batches(docs.sparkSession)
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_class = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    if not by_class.get(0) or not by_class.get(1):
        return ToxicityModel(weights=np.zeros(len(PATTERNS)))
    ordered = [usable.where(F.col("toxic") == c).orderBy(md5_fraction(F.col("doc_id")), "doc_id").limit(sample_per_class) for c in (0, 1)]
    sample = F.broadcast(ordered[0].unionByName(ordered[1]))  # at most 2 * sample_per_class narrow rows
    rows = materialize(_prepared(docs.select("doc_id", "text").join(sample, "doc_id"), "toxic").dropDuplicates(["text"]), "labelled")

    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return ToxicityModel(weights=np.zeros(len(PATTERNS)))
    word = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    words = rows.select("doc_id", "toxic", word.alias("word"))
    stems = [words.where(F.length("word") > k).select("doc_id", "toxic", F.concat(F.substring("word", 1, k), F.lit("*")).alias("word")).distinct() for k in PREFIXES]
    seen = words.unionByName(stems[0]).unionByName(stems[1]).groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("all"))
    seen = materialize(seen, "lexicon")
    # A word must stand out of chance among all words that were tried: the likelihood ratio of its share against the classes' own.
    share, t, rest = n[1] / (n[0] + n[1]), F.col("t"), F.col("all") - F.col("t")
    gain = 2 * (t * F.log(t / (F.col("all") * share)) + F.when(rest > 0, rest * F.log(rest / (F.col("all") * (1 - share)))).otherwise(0.0))
    rate1, rate0 = F.col("t") / n[1], (F.col("all") - F.col("t") + 0.5) / n[0]
    picked = (
        seen.where((t >= 4) & (rate1 > 8 * rate0) & (gain >= 2 * np.log(max(2, seen.count()))))
        .where(~F.col("word").endswith("*") | (F.col("t") >= 50 * (F.col("all") - F.col("t"))))  # a beginning must be pure
        .select("word", (rate1 / rate0).alias("ratio"), rate1.alias("rate1"), rate0.alias("rate0"), "t")
        .orderBy(F.desc(F.col("t") * F.log(F.col("ratio"))), "word")
        .limit(max_lexicon)
        .toPandas()
    )
    model = ToxicityModel(list(picked["word"]))
    width = len(model.entries) + len(PATTERNS)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, voter = votes(shared.value, b.column(1), b.column(2).to_numpy())
            cut = np.searchsorted(at, np.arange(b.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(voter.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["toxic", "fired"])

    free = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rate = min(1.0, unlabelled / max(1, free.count()))
    # By another digest than the sample of the labelled ones; a row that has a label after all is dropped by its id.
    free = free.where(md5_fraction(F.concat(F.lit("free"), F.col("doc_id").cast("string"))) < rate * float(1 << 32))
    free = _prepared(free.join(usable.select("doc_id").hint("shuffle_hash"), "doc_id", "left_anti"))
    everything = rows.select("toxic", "text", "capitals").unionByName(free.select(F.lit(None).cast("int").alias("toxic"), "text", "capitals"))
    got = everything.mapInArrow(look, "toxic int, fired array<int>").toPandas()
    v = np.zeros((len(got), width))
    for k, fired in enumerate(got["fired"]):
        v[k, fired] = 1
    truth = got["toxic"].to_numpy(float)
    shape1, shape0 = ((v[truth == c].sum(axis=0)[-len(PATTERNS) :] + 0.5) / (n[c] + 1) for c in (1, 0))
    expected1 = np.concatenate([picked["rate1"].to_numpy(float), shape1])
    expected0 = np.concatenate([picked["rate0"].to_numpy(float), shape0])
    real = by_class[1] / (by_class[0] + by_class[1])  # the sample holds as many of each class; rows count by the real share
    labelled = np.where(truth == 1, real / max(1, (truth == 1).sum()), (1 - real) / max(1, (truth == 0).sum()))
    blank = np.isnan(truth)
    weight = np.where(blank, 1 / max(1, len(truth)), labelled * (~blank).sum() / max(1, len(truth)))
    posterior, _ = label_model(v, weight, float(np.clip(real, 0.001, 0.999)), expected1, expected0, told=np.where(blank, 0, (2 * np.nan_to_num(truth) - 1) * np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY))))
    w = _logistic(v, posterior, weight)
    return ToxicityModel(model.entries, w[:-1], float(w[-1]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row; a null text is scored as an empty one."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            at, voter = votes(m, b.column(1), b.column(2).to_numpy())
            odds = np.bincount(at, weights=m.weights[voter], minlength=b.num_rows) + m.bias
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(odds, -30, 30))))], ["doc_id", "score"])

    out = _prepared(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
