"""Operator 1: near-duplicate groups by ProbMinHash.

Each text is a set of its five-word shingles (lower-cased words without white space), all of weight 1:
links are of plain sets, so candidates must be too, however often a text repeats a shingle.  Every shingle runs its own Poisson process of rate
equal to its weight; each arrival falls on a random register, and a register keeps the shingle of its
earliest arrival.  A process ends as soon as its clock passes the document's latest register, which
is the early termination that makes the work about n + m log m instead of n * m.  Two registers agree
with the probability Jaccard similarity of the documents, which is the plain Jaccard similarity
as all weights are equal.

Candidates share a band of registers.  Within a band's bucket every text is compared with the
bucket's least text, and with the least text of the part that shares the next band as well, so the pairs
grow with the rows of a bucket and not with their square.  All candidates are verified on their whole
shingle sets; connected components of verified links are the groups.

A bucket whose texts fall into several groups may hide a link between two texts that both differ from its least.
All texts of such buckets are signed again with more registers to a band, so that they meet only texts more like them, and each
is compared with the least text of its new buckets where that is of another group; this goes on, with ever longer
bands, until no bucket holds several groups.  The pairs of a round are at most its rows, however large a bucket is.  ``exact_links``
finds all links by a join of prefixes, whose pairs grow with the square of a group: it measures what the bands miss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import materialize, small_batches
from kgloom.operators.components import connected_components
from kgloom.llm.textbytes import U64, distinct_counts, mix, shingles, slices, utf8, word_hashes

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS = 24
ROWS = 5
#: Registers of a band and bands of the first finer round; the next rounds have GROWTH times as many of both, up to MOST_ROWS registers,
#: where two texts below the threshold share a band with a chance of 1e-6.
FINER_ROWS, FINER_BANDS, GROWTH, MOST_ROWS = 8, 32, 1.5, 62
#: Counters of shingles, by the upper bits of their hashes, that order them by rarity.
RARITY_BITS = 18
_CLOCK, _PLACE, _ALL = 0xD1342543DE82EF95, 0xA24BAED4963EE407, (1 << 64) - 1


def prob_minhash(items: np.ndarray, docs: np.ndarray, weights: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures (n_docs, m) of weighted sets; ``docs`` ascending.  A document without items keeps zeros."""
    clock = np.full(n_docs * m, np.inf)
    won = np.zeros(n_docs * m, U64)
    sizes = np.bincount(docs, minlength=n_docs) if len(docs) else np.zeros(n_docs, np.int64)
    only = sizes[docs] == 1 if len(docs) else np.empty(0, bool)
    if only.any():  # a single shingle wins every register
        won.reshape(n_docs, m)[docs[only]] = items[only][:, None]
    live = np.flatnonzero(~only)
    x, d, w, t = items[live], docs[live], weights[live], np.zeros(len(live))
    arrival = 0
    while len(x):
        arrival += 1
        u = mix(x + U64(arrival * _CLOCK & _ALL))
        t = t - np.log(((u >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
        latest = clock.reshape(n_docs, m).max(axis=1)
        go = t < latest[d]
        x, d, w, t = x[go], d[go], w[go], t[go]
        place = ((mix(x ^ U64(arrival * _PLACE & _ALL)) >> U64(32)) * U64(m)) >> U64(32)
        at = d * m + place.astype(np.int64)
        np.minimum.at(clock, at, t)
        first = clock[at] == t
        won[at[first]] = x[first]
    return won.reshape(n_docs, m)


def _counted_shingles(data: np.ndarray, offsets: np.ndarray, k: int):
    words, counts = word_hashes(data, offsets)
    return distinct_counts(*shingles(words, counts, k))


def _band_hashes(items: np.ndarray, docs: np.ndarray, n_docs: int, bands: int, rows: int) -> np.ndarray:
    sig = prob_minhash(items, docs, np.ones(len(items)), n_docs, bands * rows).reshape(n_docs, bands, rows)
    h = np.zeros((n_docs, bands), U64)
    for r in range(rows):
        h = mix(h ^ sig[:, :, r])
    return h


def band_hashes(text: pa.Array, k: int, bands: int, rows: int) -> pa.Array:
    """A list of ``bands`` hashes for each text; null for one without a word."""
    data, offsets = utf8(text)
    parts, empty = [], []
    for i, j in slices(offsets):
        items, docs, _ = _counted_shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
        parts.append(_band_hashes(items, docs, j - i, bands, rows))
        empty.append(np.bincount(docs, minlength=j - i) == 0)
    flat = np.concatenate(parts).reshape(-1).view(np.int64) if parts else np.empty(0, np.int64)
    none = np.concatenate(empty) if empty else np.empty(0, bool)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands), pa.int32()), pa.array(flat))
    return pa.compute.if_else(pa.array(none), pa.nulls(len(none), lists.type), lists)


def shingle_sets(text: pa.Array, k: int) -> pa.Array:
    """The sorted distinct shingle hashes of each text as bytes."""
    data, offsets = utf8(text)
    out: list[bytes] = []
    for i, j in slices(offsets):
        items, docs, _ = _counted_shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
        cut = np.searchsorted(docs, np.arange(j - i + 1))
        raw = items.tobytes()
        out += [raw[a * 8 : b * 8] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    return pa.array(out, pa.binary())


def _verify(threshold: float):
    """Of ``(a, b, ga, gb, x, y)`` the pairs whose sets x and y are similar, without the sets."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                p, q = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(both >= threshold * (len(p) + len(q) - both) - 1e-9)
            yield batch.select([0, 1, 2, 3]).filter(pa.array(ok, pa.bool_()))

    return verify


def _verified(pairs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """The links among ``pairs(a, b, ga, gb)``, checked on whole sets."""
    fits = F.least(F.length("x"), F.length("y")) >= threshold * F.greatest(F.length("x"), F.length("y")) - 1e-9
    both = pairs.join(items.toDF("a", "x"), "a").join(items.toDF("b", "y"), "b").where(fits)
    return materialize(both.select("a", "b", "ga", "gb", "x", "y").mapInArrow(_verify(threshold), "a long, b long, ga long, gb long"), "links")


def _open_texts(buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """``(class_id, group)`` of the texts in ``buckets(class_id, band, h)`` that hold more than two of several groups."""
    named = buckets.select("class_id", "band", "h").join(groups.toDF("class_id", "group"), "class_id", "left")
    named = named.withColumn("group", F.coalesce("group", "class_id"))
    mixed = named.groupBy("band", "h").agg(F.count("*").alias("n"), F.min("group").alias("g1"), F.max("group").alias("g2")).where("n > 2 and g1 <> g2")
    mixed = materialize(mixed.select("band", "h"), "mixed")
    return materialize(named.join(mixed, ["band", "h"], "left_semi").select("class_id", "group").distinct(), "open")


def _finer_buckets(open_: DataFrame, items: DataFrame, bands: int, rows: int) -> DataFrame:
    """``(class_id, group, band, h, least, other)`` of the buckets with several groups, ``other`` being the group of the least text."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(2)
            ends = np.cumsum([len(x.as_buffer()) for x in raw], dtype=np.int64)
            for i, j in slices(np.concatenate([[0], ends])):
                sets_ = [np.frombuffer(raw[k].as_buffer(), U64) for k in range(i, j)]
                docs = np.repeat(np.arange(j - i), [len(x) for x in sets_])
                h = _band_hashes(np.concatenate(sets_), docs, j - i, bands, rows).reshape(-1).view(np.int64)
                at = pa.array(np.repeat(np.arange(i, j), bands))
                band = pa.array(np.tile(np.arange(bands, dtype=np.int32), j - i))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), band, pa.array(h)], ["class_id", "group", "band", "h"])

    texts = open_.join(items.withColumnRenamed("doc_id", "class_id"), "class_id").select("class_id", "group", "items")
    cell = materialize(texts.mapInArrow(sign, "class_id long, group long, band int, h long"), "cells")
    least = cell.groupBy("band", "h").agg(F.min("class_id").alias("least"), F.min_by("group", "class_id").alias("other"), F.max("group").alias("g2"), F.min("group").alias("g1"))
    shared = materialize(least.where("g1 <> g2").drop("g1", "g2"), "shared")
    return materialize(cell.join(shared, ["band", "h"]), "buckets")


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups`` with those that ``links(ga, gb)`` connect made one; a group is named by its least text."""
    joined = connected_components(links.select(F.col("ga").alias("a"), F.col("gb").alias("b")))
    new = joined.toDF("component", "into")
    kept = groups.join(new, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    return materialize(kept.unionByName(joined.join(groups.select("node"), "node", "left_anti")), "groups")


def prefixes(sets: pa.Array, rarity: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rarest shingles of each set, as many as sets at ``threshold`` must share one of; their rows and places, and all sets' sizes."""
    rows, first, places, sizes = [np.empty(0, np.int64)], [np.empty(0, U64)], [np.empty(0, np.int64)], []
    for i, raw in enumerate(sets):
        items = np.frombuffer(raw.as_buffer(), U64)
        n = len(items) - int(np.ceil(threshold * len(items) - 1e-9)) + 1
        first.append(items[np.lexsort((items, rarity[(items >> U64(64 - RARITY_BITS)).astype(np.int64)]))[:n]])
        rows.append(np.full(len(first[-1]), i))
        places.append(np.arange(len(first[-1])))
        sizes.append(len(items))
    return np.concatenate(rows), np.concatenate(first), np.concatenate(places), np.array(sizes, np.int64)


def exact_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """All links ``(a, b)`` between different texts, each named by its least id: a join by prefixes, to measure recall with.

    Of two sets that similar, in any one order of all shingles, the first parts share a shingle; the order is by rarity.  Pairs whose sizes or
    places of the shared shingle rule the threshold out are left out.  The pairs of texts that share much, but not enough, grow with the square of
    their number, so this isn't for corpora with large groups; ``near_duplicates`` doesn't use it.  Texts without a word and nulls have no links.
    """
    small_batches(docs.sparkSession)
    k = shingle_words

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), shingle_sets(b.column(1), k)], ["doc_id", "items"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    texts = src.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lower("text").alias("text"))
    texts = materialize(texts.mapInArrow(sets, "doc_id long, items binary").where("length(items) > 0"), "sets")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << RARITY_BITS, np.int64)
        for b in batches:
            for raw in b.column(0):
                np.add.at(total, (np.frombuffer(raw.as_buffer(), U64) >> U64(64 - RARITY_BITS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 14):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + (1 << 14)]), pa.array(total[at[i : i + (1 << 14)]])], ["slot", "n"])

    # At most 2**RARITY_BITS sums reach the driver, whatever the corpus.
    counted = texts.select("items").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    rarity = np.zeros(1 << RARITY_BITS, np.int64)
    rarity[counted["slot"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(rarity)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, tokens, places, sizes = prefixes(b.column(1), shared.value, threshold)
            for i in range(0, len(rows), 1 << 16):
                at = rows[i : i + (1 << 16)]
                columns = [pa.array(tokens[i : i + (1 << 16)].view(np.int64)), b.column(0).take(pa.array(at)), pa.array(places[i : i + (1 << 16)]), pa.array(sizes[at])]
                yield pa.RecordBatch.from_arrays(columns, ["token", "doc_id", "place", "size"])

    rows = materialize(texts.mapInArrow(first, "token long, doc_id long, place long, size long"), "prefixes")
    # The first shared shingle stands at places i and j: what follows it bounds what is shared.
    enough = F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j")) >= threshold / (1 + threshold) * (F.col("m") + F.col("n")) - 1e-9
    similar = F.least("m", "n") >= threshold * F.greatest("m", "n") - 1e-9
    both = rows.toDF("token", "a", "i", "m").join(rows.toDF("token", "b", "j", "n"), "token").where("a < b").where(similar & enough)
    pairs = both.select("a", "b").distinct().select("a", "b", F.col("a").alias("ga"), F.col("b").alias("gb"))
    return _verified(materialize(pairs, "pairs"), texts, threshold).select("a", "b")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row ``(doc_id, class_id, group_id, n_links, keep)`` for each row of ``docs``.

    ``class_id`` is the least id with exactly the same text, ``group_id`` the least id of its group of near
    copies, ``n_links`` the links of its class that were verified (a spanning part of all), and ``keep`` marks the row whose id
    is its group's.  A row with a null text or null id is its own class and group and is kept; rows
    with an empty text are exact copies of each other, a text of fewer than ``shingle_words`` words is one
    shingle.  Repeated rows with one id share its group and all carry its ``keep``.  An empty table gives
    none.  Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    k, m_bands, m_rows = shingle_words, bands, rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), band_hashes(b.column(2), k, m_bands, m_rows)], ["doc_id", "digest", "bands"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), shingle_sets(b.column(1), k)], ["doc_id", "items"])

    usable = src.where("doc_id is not null and text is not null")
    signed = usable.select("doc_id", F.unhex(F.md5("text")).alias("digest"), F.lower("text").alias("text")).mapInArrow(
        sign, "doc_id long, digest binary, bands array<long>"
    )
    signed = materialize(signed, "signed")
    classes = materialize(signed.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.first("bands").alias("bands")), "classes")

    cell = classes.where("bands is not null").select("class_id", "bands", F.posexplode("bands").alias("band", "h"))
    cell = cell.select("class_id", "band", "h", F.element_at("bands", (F.col("band") + 1) % bands + 1).alias("h2"))
    shared = cell.groupBy("band", "h").agg(F.min("class_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Written before it is joined: adaptive execution splits a bucket that is large, but only between plain exchanges.
    crowded = materialize(cell.join(materialize(shared, "shared"), ["band", "h"]), "buckets")
    finer = crowded.groupBy("band", "h", "h2").agg(F.min("class_id").alias("least2"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = (
        crowded.select(F.col("least").alias("a"), F.col("class_id").alias("b"))
        .unionByName(crowded.join(materialize(finer, "finer"), ["band", "h", "h2"]).select(F.col("least2").alias("a"), F.col("class_id").alias("b")))
        .where("a < b")
        .distinct()
    )
    pairs = materialize(pairs.select("a", "b", F.col("a").alias("ga"), F.col("b").alias("gb")), "pairs")

    asked = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # Always dealt by id, never broadcast: which texts are asked for grows with the corpus.
    items = usable.join(asked.hint("shuffle_hash"), "doc_id", "left_semi").select("doc_id", F.lower("text").alias("text")).mapInArrow(sets, "doc_id long, items binary")
    items = materialize(items.groupBy("doc_id").agg(F.first("items").alias("items")), "items")

    links = _verified(pairs, items, threshold)
    groups = connected_components(links)
    buckets, per_band, n_bands = crowded, FINER_ROWS, FINER_BANDS
    while per_band <= MOST_ROWS:
        open_ = _open_texts(buckets, groups)
        if open_.isEmpty():
            break
        buckets = _finer_buckets(open_, items, n_bands, per_band)
        pairs = buckets.where("group <> other").select(F.col("least").alias("a"), F.col("class_id").alias("b"), F.col("other").alias("ga"), F.col("group").alias("gb")).distinct()
        more = _verified(pairs, items, threshold)
        if not more.isEmpty():
            links = links.unionByName(more)
            groups = _merged(groups, more)
        per_band, n_bands = int(per_band * GROWTH), int(n_bands * GROWTH)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))

    known = groups.join(degree, "node", "left").toDF("class_id", "group_id", "n_links")
    named = materialize(classes.select("digest", "class_id").join(known, "class_id", "left"), "named")
    done = signed.select("doc_id", "digest").join(named, "digest").select(
        "doc_id",
        "class_id",
        F.coalesce("group_id", "class_id").alias("group_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
    rest = src.where("doc_id is null or text is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("group_id"), F.lit(0).cast("long").alias("n_links")
    )
    return done.unionByName(rest).withColumn("keep", F.coalesce(F.col("doc_id") == F.col("group_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns; rows without id stay."""
    gone = near_duplicates(docs, id_col, text_col, **options).where("not keep").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")
