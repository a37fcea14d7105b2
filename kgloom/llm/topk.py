"""Operator 2: exact top-k search by inner product, with block-at-a-time pruning.

Documents lie in ranges of a locality order (their largest term first), and each range is a block: ids, a forward
index (the block's whole rows) and the largest and smallest value of each term.  For a query, the
sum over terms of weight times the block's maximum (its minimum, for a negative weight) bounds every score in the block.
Blocks are taken in descending order of that bound, whole blocks are scored from the forward
index, and a query is done when the next bound is below its k-th score, so results are exact; a bound that
equals it is still scored, as ties go to the smaller id.

Queries and documents meet in cells (a block of queries, a group of blocks); every cell returns k rows for each
of its queries, and one window over those gives the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.llm.common import materialize
from kgloom.llm.vectors import block_of, matrix, usable_vectors

BLOCK_ROWS = 128
GROUP_ROWS = 8192
QUERY_ROWS = 4096


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int, block_rows: int = BLOCK_ROWS):
    """The k best documents (ids, scores) for each query other than itself, how many there are, and how many scores were computed.

    Values are whole numbers: 64-bit floats where they hold all sums exactly, or else Python's integers.
    """
    cuts = list(range(0, len(d), block_rows))
    top = np.array([d[c : c + block_rows].max(axis=0) for c in cuts])
    low = np.array([d[c : c + block_rows].min(axis=0) for c in cuts])
    bound = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bound, axis=1, kind="stable")
    best, best_ids = np.zeros((len(q), k), q.dtype), np.zeros((len(q), k), np.int64)
    have = np.zeros(len(q), np.int64)
    going, scored = np.arange(len(q)), 0
    for turn in range(len(cuts)):
        block = order[going, turn]
        stay = (have[going] < k) | (bound[going, block] >= best[going, k - 1])
        going, block = going[stay], block[stay]
        if not len(going):
            break
        for b in np.unique(block).tolist():
            who, c = going[block == b], cuts[b]
            scores = q[who] @ d[c : c + block_rows].T
            own = np.broadcast_to(ids[c : c + block_rows], scores.shape)
            scored += scores.size
            all_ids = np.concatenate([best_ids[who], own], axis=1)
            all_scores = np.concatenate([best[who], scores], axis=1)
            valid = np.concatenate([np.arange(k) < have[who][:, None], own != q_ids[who][:, None]], axis=1)
            pick = _first(all_ids, all_scores, valid, k)
            best_ids[who] = np.take_along_axis(all_ids, pick, axis=1)
            best[who] = np.take_along_axis(all_scores, pick, axis=1)
            have[who] = np.minimum(k, valid.sum(axis=1))
    return best_ids, best, have, scored


def _first(ids: np.ndarray, scores: np.ndarray, valid: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best of each row: valid ones, by score, ties to the smaller id."""
    if scores.dtype == object:
        return np.array([sorted(range(ids.shape[1]), key=lambda j: (not v[j], -s[j], i[j]))[:k] for i, s, v in zip(ids, scores, valid, strict=True)])
    if ids.shape[1] > 4 * k:  # only what reaches the k-th score can be among the best
        kth = np.partition(np.where(valid, scores, -np.inf), ids.shape[1] - k, axis=1)[:, ids.shape[1] - k]
        close = valid & (scores >= kth[:, None])
        width = max(k, int(close.sum(axis=1).max()))
        if width < ids.shape[1]:
            near = np.argsort(~close, axis=1, kind="stable")[:, :width]
            take = lambda x: np.take_along_axis(x, near, axis=1)
            return take_order(near, np.lexsort((take(ids), -take(scores), ~take(valid)), axis=1)[:, :k])
    return np.lexsort((ids, -scores, ~valid), axis=1)[:, :k]


def take_order(places: np.ndarray, order: np.ndarray) -> np.ndarray:
    return np.take_along_axis(places, order, axis=1)


def whole_terms(v: np.ndarray) -> np.ndarray:
    """floor(256 * x), as floats if they keep all sums of products exact, or else as Python's integers."""
    v = np.floor(256.0 * v)
    peak = float(np.abs(v).max()) if v.size else 0.0
    if peak * peak * max(1, v.shape[1]) * 2 < 2.0**53:
        return v
    return np.array([[int(x) for x in row] for row in v], object)


def top_k_search(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each id divisible by ``every``, its ``k`` best others.

    Terms are floor(256 * component); the score is the whole inner product (clipped to 64 bits).  Ties go to the
    smaller id; fewer than k candidates give fewer rows.  Rows whose id or vector is null, or whose vector is empty or
    has a null or non-finite component, take no part; vectors are compared with those of their length.  A row
    doesn't answer queries with its own id, and of repeated query rows one asks.  Other columns are ignored.
    """
    rows = usable_vectors(vectors, id_col, vector_col, nonzero=False)
    # Locality: the place of the largest term, then its size; a group is a range of that order.
    rows = rows.withColumn("place", F.array_position("v", F.array_max("v")) * 1000.0 - F.least(F.array_max("v"), F.lit(900.0)))
    count = rows.count()
    rows = rows.repartitionByRange(max(1, -(-count // GROUP_ROWS)), "place", "vec_id")
    rows = materialize(rows.withColumn("group", F.spark_partition_id()), "topk")
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    n_groups, n_queries = rows.agg(F.max("group")).first()[0], queries.count()
    if not n_queries:
        return queries.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.col("vec_id").alias("score")).where("false")
    n_blocks = max(1, -(-n_queries // QUERY_ROWS))
    dim, numbers = F.size("v").alias("dim"), lambda n: F.explode(F.sequence(F.lit(0), F.lit(n)))
    docs = rows.select(numbers(n_blocks - 1).alias("block"), "group", dim, "vec_id", "v", "place")
    queries = queries.select(block_of(F.col("vec_id"), QUERY_ROWS, n_queries, "topk").alias("block"), numbers(n_groups).alias("group"), dim, "vec_id", "v")

    def cell(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not asked.num_rows or not held.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names)
        held = held.sort_by([("place", "ascending"), ("vec_id", "ascending")])
        q_ids, ids = asked["vec_id"].to_numpy(), held["vec_id"].to_numpy()
        both = whole_terms(np.concatenate([matrix(asked["v"]), matrix(held["v"])]))
        found, scores, have, _ = search_block(q_ids, both[: len(q_ids)], ids, both[len(q_ids) :], k)
        at, rank = np.nonzero(np.arange(k) < have[:, None])
        top = (1 << 63) - 1
        clipped = [min(max(int(x), -top - 1), top) for x in scores[at, rank].tolist()]
        return pa.table([pa.array(q_ids[at]), pa.array(found[at, rank]), pa.array(clipped, pa.int64())], names)

    got = queries.groupBy("block", "group", "dim").cogroup(docs.groupBy("block", "group", "dim")).applyInArrow(cell, "query_id long, vec_id long, score long")
    return ranked(got, F.desc("score"), k).select("query_id", "rank", "vec_id", "score")


def ranked(found: DataFrame, best_first, k: int) -> DataFrame:
    """The k best rows of each query, ties to the smaller id, with their rank from 1."""
    order = Window.partitionBy("query_id").orderBy(best_first, "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS t FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.t, d.t)::BIGINT AS score
  FROM v AS q, v AS d WHERE q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
