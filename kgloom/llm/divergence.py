"""Operator 13: how far the words of each source are from those of the other sources of its language.

Texts become counts of terms in one pass: a task encodes the terms of a batch as integers and counts them by (language, source), and Spark
adds the counts up.  The terms that a language keeps are sorted by their bytes and cut into chunks; a task takes the sorted array of one chunk's terms,
finds the ids of all counts in it by ``searchsorted`` and adds them up by ``bincount`` into a dense matrix, a row for each source.
Sources are compared on such matrices chunk by chunk, and the chunks' sums are exact integers.  As ids follow the order of
the terms, ties are broken by id.

Nothing of a corpus-wide size is in one place: a chunk has CHUNK_TERMS terms, or as many as the language has sources if that is more, so that the pairs
of a chunk are no more than its counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.llm.common import materialize, small_batches
from kgloom.llm.textbytes import slices, utf8
from kgloom.operators.graph import ordered_index

#: Documents of a language that a term must occur in.
LEAST_DOCS = 3
#: Probabilities are counted in parts of this.
ONE = 1_000_000_000
TOP_TERMS = 200
CHUNK_TERMS = 512
SLICE_BYTES = 2 << 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms of some texts as a dictionary array, A-Z lower-cased, and the text of each."""
    solid = _LETTER[data]
    before = np.concatenate([[False], solid[:-1]])
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    place = np.cumsum(solid) - solid
    joined = _LOWER[data[solid]]
    ends = np.append(place[starts], len(joined)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(joined.tobytes())])
    return words.dictionary_encode(), np.searchsorted(offsets, starts, "right") - 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, source, term, n, docs)`` of ``(lang, source, text)``, added up over slices of a batch."""
    for b in batches:
        group = b.select([0, 1])
        names = pa.Table.from_batches([group]).group_by(["lang", "source"]).aggregate([])
        at = {k: i for i, k in enumerate(zip(names["lang"].to_pylist(), names["source"].to_pylist(), strict=True))}
        groups = np.array([at[k] for k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], np.int64)
        data, offsets = utf8(b.column(2))
        for i, j in slices(offsets, SLICE_BYTES):
            words, texts = terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            size = len(words.dictionary)
            if not size:
                continue
            ids = words.indices.to_numpy().astype(np.int64)
            # (text, term) pairs first: their number by (group, term) is that of the documents, their counts add up to the occurrences.
            pairs, times = np.unique(texts * size + ids, return_counts=True)
            keys, back, docs = np.unique(groups[i + pairs // size] * size + pairs % size, return_inverse=True, return_counts=True)
            n = np.bincount(back, weights=times, minlength=len(keys)).astype(np.int64)
            which = pa.array(keys // size)
            yield pa.RecordBatch.from_arrays(
                [pc.take(names["lang"].combine_chunks(), which), pc.take(names["source"].combine_chunks(), which), words.dictionary.take(pa.array(keys % size)).cast(pa.string()), pa.array(n), pa.array(docs)],
                ["lang", "source", "term", "n", "docs"],
            )


def parts_per_billion(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(ONE * (count + 1) / total), exact: the quotient is found three decimal places at a time, as the product may exceed a long.

    ``total`` is at least count + 1 and below 2**53.
    """
    rest = count + 1
    out = rest // total
    rest = rest - out * total
    for _ in range(3):
        rest = rest * 1000
        step = rest // total
        out, rest = out * 1000 + step, rest - step * total
    return 1 + out


def _compare(key: tuple, counts: pd.DataFrame, groups: pd.DataFrame, top: int) -> pd.DataFrame:
    """Sums of a chunk for all pairs of sources, and the chunk's first ``top`` terms of each source."""
    # Python strings sort by code point, which is the order of their UTF-8 bytes.
    sources = np.array(sorted(groups["source"]), object)
    chunk = np.array(sorted(set(counts["term"])), object)
    stats = groups.set_index("source").loc[list(sources)]
    row, col = np.searchsorted(sources, counts["source"].to_numpy(object)), np.searchsorted(chunk, counts["term"].to_numpy(object))
    s, c = len(sources), len(chunk)
    # Weights of a bincount are doubles, exact below 2**53; no cell has two counts.
    dense = np.bincount(row * c + col, weights=counts["n"].to_numpy(np.float64), minlength=s * c).astype(np.int64).reshape(s, c)
    kept, all_n = int(stats["kept"].iloc[0]), int(stats["lang_n"].iloc[0])
    p = parts_per_billion(dense, (stats["source_n"].to_numpy(np.int64) + kept)[:, None])
    q = parts_per_billion(dense.sum(axis=0), np.int64(all_n + kept))
    out = []
    for i in range(s):
        value = ((p[i] - p) ** 2 // p).sum(axis=1)
        others = np.arange(s) != i
        out.append(pd.DataFrame({"source": sources[i], "part": "pair", "item": sources[others], "value": value[others]}))
        ids = np.flatnonzero((dense[i] > 0) & (p[i] > q))
        f = (p[i, ids] - q[ids]) ** 2 // q[ids]
        best = np.lexsort((ids, -f))[:top]
        out.append(pd.DataFrame({"source": sources[i], "part": "term", "item": chunk[ids[best]], "value": f[best]}))
    frame = pd.concat(out, ignore_index=True)
    frame.insert(0, "lang", groups["lang"].iloc[0])
    return frame


def source_divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, chunk_terms: int = CHUNK_TERMS
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: the distance of each source to all others of its language, and the terms it is known by.

    Null text, lang and source count as empty; every (lang, source) that occurs is a group, without terms too.  A term is a run of ASCII letters and
    characters beyond ASCII; terms in ``least_docs`` rows of a language are kept, repeated rows being rows of their own.  ``part`` is ``pair`` (``item``: the other source)
    or ``term`` (``item``: a term more frequent in the source than in the language; the first ``top_terms`` by value, then by the term's bytes).  Counts are exact to 2**53 of a term.
    An empty table gives none; a language of one source has no pairs and no terms, as it is the language.  Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    counted = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # A term's list has an entry for each source of its language that has it.
    by_term = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
    kept = materialize(by_term.where(F.col("docs") >= least_docs).select("lang", "term", "counts"), "terms")

    groups = rows.groupBy("lang", "source").agg(F.count("*").alias("rows"))
    per_source = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("source_n"))
    per_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    stats = groups.join(per_source, ["lang", "source"], "left").join(per_lang, "lang", "left")
    stats = stats.select("lang", "source", F.coalesce("source_n", F.lit(0)).alias("source_n"), F.coalesce("kept", F.lit(0)).alias("kept"))
    totals = stats.groupBy("lang").agg(F.sum("source_n").alias("lang_n"), F.count("*").alias("n_sources"))
    stats = materialize(stats.join(totals, "lang"), "groups")

    numbered = ordered_index(kept, ["lang", "term"], "i")
    first = numbered.groupBy("lang").agg(F.min("i").alias("first"), F.max("i").alias("last")).join(totals.select("lang", "n_sources"), "lang")
    first = materialize(first.select("lang", "first", "last", F.greatest(F.lit(chunk_terms), "n_sources").alias("size")), "chunks")
    # A row for each language: joined as tables of their own size are, and not broadcast by hand.
    cells = numbered.join(first, "lang").select("lang", F.expr("(i - first) div size").alias("chunk"), "term", F.explode("counts").alias("c")).select("lang", "chunk", "term", "c.source", "c.n")
    chunks = first.select("lang", F.explode(F.expr("sequence(0, (last - first) div size)")).alias("chunk"))
    needed = chunks.join(stats, "lang").select("lang", "chunk", "source", "source_n", "kept", "lang_n")

    compare = lambda key, counts, stats: _compare(key, counts, stats, top_terms)
    parts = cells.groupBy("lang", "chunk").cogroup(needed.groupBy("lang", "chunk")).applyInPandas(compare, "lang string, source string, part string, item string, value long")
    parts = materialize(parts, "parts")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # Languages that keep no term: all their pairs are 0.
    bare = stats.where("kept = 0").select("lang", "source")
    zero = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    best = ranked(parts.where("part = 'term'"), "term").where(F.col("rank") <= top_terms)
    return ranked(pairs.unionByName(zero), "pair").unionByName(best)


#: The same rows in DuckDB's SQL.
DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (
  SELECT row_id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row_id) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
n AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (n.total + v.v) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(s) + any_value(v)) AS q
  FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS s FROM n GROUP BY lang) USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL SELECT a.lang, a.source, b.source, 0 FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM v)),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (
  SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT * FROM (SELECT *, 'term' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms) WHERE rank <= 200)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r
"""
