"""Operator 6: language identification by multilingual mixture inference.

A model holds log-likelihoods of hashed four-byte grams for each language.  A document is a sequence of
short segments; expectation-maximisation estimates the proportions of the languages that best explain
them, and the set of languages is the one with the best likelihood less a penalty for each member.
Everything works on UTF-8 buffers, segments of many documents at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.llm.common import held_out, md5_fraction, small_batches, spare_name
from kgloom.llm.textbytes import SLICE_BYTES, slices, utf8

TABLE_BITS = 16
SEGMENT_BYTES = 48
GRAM = 4
#: Expected number of training documents of each language; the model is fitted on at most about so many.
SAMPLE_PER_LANGUAGE = 2000
#: Share of the background common to all languages in a gram's likelihood.
BACKGROUND = 0.02
#: Languages by which the best set of a size is tried to grow.
TRIED = 4
UNKNOWN = "und"

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[0x80:] = np.arange(0x80, 0x100)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # (2**TABLE_BITS, languages), float32


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table places of all grams, which of them count, and the padded offsets of the documents."""
    sizes = np.diff(offsets)
    folded = _FOLD[data]
    if len(data) > 1:  # upper-case Latin-1 letters
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        folded[1:][capital] += 0x20
    padded = offsets + GRAM * np.arange(len(offsets))
    buf = np.full(int(padded[-1]) + GRAM, 0x20, np.uint8)
    buf[np.arange(len(data)) + np.repeat(padded[:-1] + 1 - offsets[:-1], sizes)] = folded
    wide = buf.astype(np.uint32)
    n = int(padded[-1])
    key = wide[:n] << 24
    for i in range(1, GRAM):
        key |= wide[i : n + i] << np.uint32(24 - 8 * i)
    place = (key * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS)
    return place, buf[1 : n + 1] != 0x20, padded


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, place, n)."""
    for b in batches:
        langs = np.array(b.column(0).to_pylist(), object)
        data, offsets = utf8(b.column(1))
        total: dict[str, np.ndarray] = {}
        for i, j in slices(offsets):
            place, counts, padded = _grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            of = np.repeat(langs[i:j], np.diff(padded))
            for lang in set(langs[i:j]):
                got = np.bincount(place[counts & (of == lang)], minlength=1 << TABLE_BITS)
                total[lang] = total.get(lang, 0) + got
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "place", "n"])


def log_likelihoods(counts: np.ndarray, background: float = BACKGROUND) -> np.ndarray:
    """Log-likelihoods of grams (places, languages): each language's own shares, mixed with a background common to all.

    The background is the mean of the languages' shares and of an even one.  A gram that no text of a language holds is as likely
    in every such language, however much text each was learned from.
    """
    own = counts / np.maximum(counts.sum(axis=0), 1)
    common = (own.mean(axis=1) + 1 / len(counts)) / 2
    return np.log((1 - background) * own + background * common[:, None]).astype(np.float32)


def fit_languages(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE, background: float = BACKGROUND) -> LanguageModel | None:
    """Learn from ``(doc_id, text, lang)`` with a text and a lang, but for held-out rows; None if there are none.

    About ``sample_per_language`` documents of each language are used, chosen by a hash of the id.
    Only gram counts (at most 2**16 for a language) come to the driver.
    """
    small_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return None
    rate = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample_per_language / n))])
    chosen = known.where("text is not null").where(md5_fraction(F.coalesce("doc_id", F.lit(0))) < F.element_at(rate, F.col("lang")) * float(1 << 32))
    rows = (
        chosen.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
        .mapInArrow(_gram_counts, "lang string, place int, n long")
        .groupBy("lang", "place")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = sorted(sizes)
    counts = np.zeros((1 << TABLE_BITS, len(languages)))
    counts[rows["place"], rows["lang"].map(languages.index).astype(int)] = rows["n"]
    return LanguageModel(languages, log_likelihoods(counts, background))


def _segment_likelihoods(data: np.ndarray, offsets: np.ndarray, log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segments, languages) log-likelihoods, tempered by the overlap of grams, and each segment's document."""
    place, counts, padded = _grams(data, offsets)
    like = log_p[place]
    like[~counts] = 0
    lengths = np.diff(padded)
    per_doc = -(-lengths // SEGMENT_BYTES)
    docs = np.repeat(np.arange(len(lengths)), per_doc)
    rank = np.arange(len(docs)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    return np.add.reduceat(like, padded[:-1][docs] + rank * SEGMENT_BYTES, axis=0) / GRAM, docs


def infer_mixtures(like: np.ndarray, docs: np.ndarray, n_docs: int, rounds: int = 8, max_languages: int | None = None, penalty: float = 2.0):
    """Proportions (n_docs, languages) of the chosen set of each document; every document has a segment.

    Sets grow a language at a time, up to ``max_languages`` (all learned ones by default), for the documents where a
    set of that size can still win: as the likelihood is concave in the proportions, its slope bounds that of any set.
    Sets of each size that are tried: the largest proportions among all languages, and the best set before with each of the ``TRIED`` languages
    in whose direction the likelihood rises most steeply.
    """
    n_langs = like.shape[1]
    first = np.searchsorted(docs, np.arange(n_docs))
    n_segments = np.diff(np.append(first, len(docs)))
    top = like.max(axis=1, keepdims=True)
    p = np.exp((like - top).astype(np.float64))
    base = np.add.reduceat(top[:, 0].astype(np.float64), first)

    def run(allowed: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Proportions, likelihoods and slopes of the documents ``of`` (ascending)."""
        rows = np.flatnonzero(np.isin(docs, of)) if len(of) < n_docs else np.arange(len(docs))
        own, at, start = p[rows], np.searchsorted(of, docs[rows]), np.cumsum(n_segments[of]) - n_segments[of]
        theta = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(rounds):
            r = theta[at] * own
            r /= r.sum(axis=1, keepdims=True) + 1e-300
            theta = np.add.reduceat(r, start, axis=0)
            theta /= theta.sum(axis=1, keepdims=True) + 1e-300
        mass = (theta[at] * own).sum(axis=1) + 1e-300
        return theta, base[of] + np.add.reduceat(np.log(mass), start), np.add.reduceat(own / mass[:, None], start, axis=0)

    free, likely, slope = run(np.ones((n_docs, n_langs)), np.arange(n_docs))
    bound = likely + slope.max(axis=1) - n_segments
    order = np.argsort(-free, axis=1, kind="stable")
    alone = np.add.reduceat(like.astype(np.float64), first, axis=0)
    best = np.zeros((n_docs, n_langs))
    best[np.arange(n_docs), alone.argmax(axis=1)] = 1
    best_score = alone.max(axis=1) - penalty * np.log1p(n_segments)
    grown = best.copy()
    mass = np.maximum(p[np.arange(len(docs)), alone.argmax(axis=1)[docs]], 1e-300)
    steep = np.add.reduceat(p / mass[:, None], first, axis=0)
    for k in range(2, min(max_languages or n_langs, n_langs) + 1):
        of = np.flatnonzero(bound - penalty * k * np.log1p(n_segments) > best_score)
        if not len(of):
            break
        prefix = np.zeros((len(of), n_langs))
        np.put_along_axis(prefix, order[of, :k], 1, axis=1)
        steepest = np.argsort(-np.where(grown[of] > 0, -np.inf, steep[of]), axis=1, kind="stable")
        tried = [prefix]
        for place in range(min(TRIED, n_langs - k + 1)):
            tried.append(grown[of].copy())
            tried[-1][np.arange(len(of)), steepest[:, place]] = 1
        top_score = np.full(len(of), -np.inf)
        for at, allowed in enumerate(tried):
            theta, score, slope = run(allowed, of)
            score -= penalty * k * np.log1p(n_segments[of])
            better = score > best_score[of]
            best[of[better]], best_score[of[better]] = theta[better], score[better]
            if at:
                up = score > top_score
                grown[of[up]], steep[of[up]], top_score[up] = allowed[up], slope[up], score[up]
    return best


def identify_languages(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``score``, ``languages``.

    ``languages`` lists the chosen set as ``code:proportion``, largest first; ``lang_pred`` is the first
    and ``score`` its proportion.  A text that is null or has no letter gets ``und``, 0 and an empty list,
    and so does any text without a model.  A set may hold as many languages as were learned.  Existing columns of these names are replaced; whole texts of any length
    are read, in pieces.
    """
    small_batches(docs.sparkSession)
    new = ["lang_pred", "score", "languages"]
    kept = docs.drop(*new)
    fields = [*kept.schema.fields, T.StructField(new[0], T.StringType()), T.StructField(new[1], T.DoubleType()), T.StructField(new[2], T.ArrayType(T.StringType()))]
    letter = F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return kept.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "languages": F.array().cast("array<string>")})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, width = kept.columns, len(kept.columns)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, log_p = shared.value.languages, shared.value.log_p
        limit = max(1 << 14, SLICE_BYTES * 4 // len(languages))
        for b in batches:
            data, offsets = utf8(b.column(width))
            has_letter = b.column(width + 1).to_numpy(zero_copy_only=False)
            shares = np.zeros((b.num_rows, len(languages)))
            for i, j in slices(offsets, limit):
                own = offsets[i : j + 1]
                if j == i + 1 and own[1] - own[0] > limit:  # one long text, a piece at a time
                    cuts = [*range(int(own[0]), int(own[1]), limit), int(own[1])]
                    like = np.concatenate([_segment_likelihoods(data[x:y], np.array([0, y - x]), log_p)[0] for x, y in zip(cuts, cuts[1:], strict=False)])
                    seg_docs = np.zeros(len(like), np.int64)
                else:
                    like, seg_docs = _segment_likelihoods(data[own[0] : own[-1]], own - own[0], log_p)
                shares[i:j] = infer_mixtures(like, seg_docs, j - i)
            order = np.argsort(-shares, axis=1, kind="stable")
            pred, score, sets = [], [], []
            for known, row, by in zip(has_letter.tolist(), shares.tolist(), order.tolist(), strict=True):
                pred.append(languages[by[0]] if known else UNKNOWN)
                score.append(min(1.0, row[by[0]]) if known else 0.0)
                sets.append([f"{languages[k]}:{row[k]:.3f}" for k in by if row[k] > 0.0005] if known else [])
            cols = [b.column(k) for k in range(width)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string()))], [*names, *new])

    asked = kept.select("*", F.col(text_col).cast("string").alias(spare_name(kept, "text")), letter.alias(spare_name(kept, "letter")))
    return asked.mapInArrow(predict, T.StructType(fields))
