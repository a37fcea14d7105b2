"""Operator 7: approximate nearest neighbours by an inverted file with product-quantised residuals.

The index is fitted on a bounded sample: coarse centroids, and a codebook of residuals for each group of
components.  Every vector is then put into the list of its nearest centroid with the codes of its residual.
A query goes to its nearest lists; in each cell (a part of a list) it makes its table of
asymmetric distances and sums table entries by code.  An estimate is off by no more than the length of the row's coding error, which is
stored with it, so the rows that could be among the cell's nearest are known and reranked by their exact distances on the original vectors: a visited cell loses none,
however alike its rows.  How many lists a query visits is measured on a bounded number of the queries themselves against every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import materialize
from kgloom.llm.topk import ranked
from kgloom.llm.vectors import block_of, matrix, usable_vectors

#: The index is fitted on at most so many vectors.
SAMPLE_ROWS = 20_000
MAX_LISTS = 4096
CODES = 256
PART = 4
CELL_ROWS = 2048
QUERY_ROWS = 16_384
RERANK = 64
#: Queries whose true neighbours are looked up among all rows, to set the number of lists to visit.
TRIED = 512


@dataclass
class PQIndex:
    centroids: np.ndarray  # (lists, dim)
    books: np.ndarray  # (parts, codes, PART)
    center: np.ndarray  # (dim,): vectors far from the origin would lose their differences in squares

    def nearest_lists(self, v: np.ndarray, n: int) -> np.ndarray:
        c = self.centroids - self.center
        d = (c**2).sum(axis=1) - 2 * (v - self.center) @ c.T
        return np.argsort(d, axis=1, kind="stable")[:, :n]

    def encode(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of residuals, and the length of what the codes leave out."""
        cut = _parts(residuals)
        codes = np.stack([((b**2).sum(axis=1) - 2 * cut[:, i] @ b.T).argmin(axis=1) for i, b in enumerate(self.books)], axis=1).astype(np.uint8)
        return codes, np.sqrt(((cut - self.books[np.arange(len(self.books)), codes]) ** 2).sum(axis=(1, 2)))

    def estimates(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of one query's residual to coded residuals, by its table."""
        table = ((self.books - _parts(residual[None])[0][:, None]) ** 2).sum(axis=2)
        return table[np.arange(len(self.books)), codes].sum(axis=1)


def _parts(v: np.ndarray) -> np.ndarray:
    """(rows, parts, PART), filled up with zeros."""
    return np.pad(v, ((0, 0), (0, -v.shape[1] % PART))).reshape(len(v), -1, PART)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from distinct rows; an empty centroid moves to the row that is worst served."""
    x = np.asarray(x, np.float64)
    start = np.unique(x, axis=0)
    c = start[rng.permutation(len(start))[:k]].copy()
    for _ in range(rounds):
        d = (c**2).sum(axis=1) - 2 * x @ c.T
        own = d.argmin(axis=1)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        full = n > 0
        c[full] = sums[full] / n[full][:, None]
        if not full.all():
            worst = np.argsort(-(d[np.arange(len(x)), own] + (x**2).sum(axis=1)))[: int((~full).sum())]
            c[np.flatnonzero(~full)[: len(worst)]] = x[worst]
    return c


def fit_index(sample: np.ndarray, rows: int, seed: int = 5) -> PQIndex:
    """Centroids, about the root of the number of ``rows`` to index, and residual codebooks."""
    rng = np.random.default_rng(seed)
    center = sample.mean(axis=0)
    centroids = center + kmeans(sample - center, max(1, min(MAX_LISTS, int(rows**0.5), len(sample))), rng)
    lists = PQIndex(centroids, np.empty(0), center).nearest_lists(sample, 1)[:, 0]
    cut = _parts(sample - centroids[lists])
    books = [kmeans(cut[:, i], CODES, rng, rounds=8) for i in range(cut.shape[1])]
    return PQIndex(centroids, np.stack([np.pad(b, ((0, CODES - len(b)), (0, 0)), mode="edge") for b in books]), center)


def nearest_in(residuals: np.ndarray, squares: np.ndarray, x: np.ndarray, rough: np.ndarray, errors: np.ndarray, k: int) -> np.ndarray:
    """Places, in order, of rows that hold the ``k`` nearest of ``x``: those whose least distance is no more than the k-th most one."""
    if len(rough) <= k:
        return np.arange(len(rough))
    slack = 1e-9 * (rough + np.abs(x).max(initial=0.0))  # for rounding; what isn't a number stays
    pick = np.flatnonzero(~(rough - errors - slack > np.partition(rough + errors + slack, k - 1)[k - 1]))
    if len(pick) > RERANK:
        own = (x**2).sum()
        d = squares[pick] - 2 * (residuals[pick] if len(pick) < len(rough) else residuals) @ x + own
        off = 1e-12 * (squares[pick] + own)
        pick = pick[~(d - off > np.partition(d + off, k - 1)[k - 1])]
    return pick


def probes_for(index: PQIndex, tried: np.ndarray, ids: np.ndarray, stored: DataFrame, recall: float, k: int) -> int:
    """The fewest lists that hold ``recall`` of the true ``k`` neighbours, among all ``stored`` rows, of the queries ``tried``."""
    shared = stored.sparkSession.sparkContext.broadcast((tried - index.center, ids, index.center))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, own, center = shared.value
        best = [np.empty((len(asked), 0)), np.empty((len(asked), 0), np.int64), np.empty((len(asked), 0), np.int32)]
        for b in batches:
            v = matrix(b.column("v")).reshape(b.num_rows, -1) - center
            for at in range(0, len(v), 2048):
                part, n = v[at : at + 2048], b.column("vec_id").to_numpy()[at : at + 2048]
                d = (part**2).sum(axis=1) - 2 * asked @ part.T
                d[own[:, None] == n[None]] = np.inf
                lists = b.column("list").to_numpy()[at : at + 2048]
                best = [np.concatenate([o, np.broadcast_to(x, d.shape)], axis=1) for o, x in zip(best, (d, n, lists), strict=True)]
                if best[0].shape[1] > k:
                    keep = np.argpartition(best[0], k - 1, axis=1)[:, :k]
                    best = [np.take_along_axis(o, keep, axis=1) for o in best]
        q = np.repeat(np.arange(len(asked)), best[0].shape[1])
        real = np.isfinite(best[0].reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(x[real]) for x in (q, *(o.reshape(-1) for o in best))], ["query_id", "score", "vec_id", "list"])

    found = stored.select("vec_id", "v", "list").mapInArrow(nearest, "query_id long, score double, vec_id long, list int")
    true = ranked(found, F.asc("score"), k).select("query_id", "list").collect()  # k rows a query tried
    if not true:
        return len(index.centroids)
    order = index.nearest_lists(tried, len(index.centroids))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None], axis=1)
    need = np.sort([place[r["query_id"], r["list"]] for r in true]) + 1
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)])


def nearest_neighbours(
    vectors: DataFrame, every: int = 100, k: int = 10, recall: float = 0.97, min_probes: int = 16, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each id divisible by ``every``, the ``k`` nearest found of all others.

    The score is the Euclidean distance on the original vectors in double precision, ties go to the smaller id.  Every row
    is indexed but those whose id or vector is null, or whose vector is zero, or has a null or
    non-finite component, or another length than most vectors of the sample; they take no part.  A row
    doesn't answer queries with its own id, of repeated query rows one asks.  A query visits as many lists as hold
    ``recall`` of the true neighbours of queries that were tried, but at least ``min_probes``; if there are fewer lists, all.  A list of any size is split into cells, so equal
    vectors never meet in one task.
    """
    rows = usable_vectors(vectors, id_col, vector_col, nonzero=True)
    head = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").toPandas()["v"]
    if not len(head):
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    lengths = np.array([len(v) for v in head])
    dim = int(np.bincount(lengths).argmax())
    rows = rows.where(F.size("v") == dim)
    index = fit_index(np.array([v for v in head if len(v) == dim]), rows.count())
    n_lists = len(index.centroids)
    shared = vectors.sparkSession.sparkContext.broadcast(index)  # bounded by MAX_LISTS and CODES

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column(1)).reshape(b.num_rows, dim)
            lists = shared.value.nearest_lists(v, 1)[:, 0]
            codes, errors = shared.value.encode(v - shared.value.centroids[lists])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors)], ["vec_id", "v", "list", "codes", "error"]
            )

    stored = materialize(rows.mapInArrow(assign, "vec_id long, v array<double>, list int, codes binary, error double"), "ivf")
    queries = rows.where(F.col("vec_id") % every == 0)
    tried = queries.orderBy(F.xxhash64("vec_id", F.lit("tried")), "vec_id").limit(TRIED).toPandas()
    if not len(tried):
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    probes = min(n_lists, max(min_probes, probes_for(index, np.array(list(tried["v"])), tried["vec_id"].to_numpy(), stored, recall, k)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = shared.value.nearest_lists(matrix(b.column(1)).reshape(b.num_rows, dim), probes)
            ends = pa.array(np.arange(0, lists.size + 1, probes), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, pa.array(lists.reshape(-1).astype(np.int32)))], ["vec_id", "v", "lists"])

    asked = queries.dropDuplicates(["vec_id"]).mapInArrow(route, "vec_id long, v array<double>, lists array<int>")
    n_queries = queries.count()
    n_blocks = max(1, -(-n_queries // QUERY_ROWS))
    counts = {r["list"]: -(-r["count"] // CELL_ROWS) for r in stored.groupBy("list").count().collect()}  # a row for each list
    cells = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])
    numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    stored = stored.withColumn("cell", F.pmod(F.xxhash64("vec_id", F.lit("cell")), F.element_at(cells, F.col("list"))).cast("int"))
    stored = stored.select(numbers(F.lit(n_blocks)).alias("block"), "list", "cell", "vec_id", "v", "codes", "error")
    asked = asked.select(block_of(F.col("vec_id"), QUERY_ROWS, n_queries, "ann").alias("block"), F.explode("lists").alias("list"), "vec_id", "v")
    asked = asked.withColumn("n", F.element_at(cells, F.col("list"))).where("n is not null").select("block", "list", numbers(F.col("n")).alias("cell"), "vec_id", "v")

    def search(queries: pa.Table, held: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if queries.num_rows and held.num_rows:
            ids, v, at = held["vec_id"].to_numpy(), matrix(held["v"]), held["list"][0].as_py()
            order = np.argsort(ids, kind="stable")  # then a stable sort by distance puts ties in the order of ids
            ids, v = ids[order], v[order]
            codes = np.frombuffer(b"".join(held["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            errors, residuals = held["error"].to_numpy()[order], v - shared.value.centroids[at]
            squares = (residuals**2).sum(axis=1)
            for q, x in zip(queries["vec_id"].to_pylist(), matrix(queries["v"]), strict=True):
                moved = x - shared.value.centroids[at]
                rough, other = np.sqrt(shared.value.estimates(moved, codes)), ids != q
                if other.all():
                    pick = nearest_in(residuals, squares, moved, rough, errors, k)
                else:
                    places = np.flatnonzero(other)
                    pick = places[nearest_in(residuals[places], squares[places], moved, rough[places], errors[places], k)]
                exact = np.sqrt(((v[pick] - x) ** 2).sum(axis=1))
                best = np.argsort(exact, kind="stable")[:k]
                out[0] += [q] * len(best)
                out[1] += ids[pick[best]].tolist()
                out[2] += exact[best].tolist()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    key = ["block", "list", "cell"]
    found = asked.groupBy(*key).cogroup(stored.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")
    return ranked(found, F.asc("score"), k).select("query_id", "rank", "vec_id", "score")
