"""Operator 10: mixture-controlled packing.

Each source is a queue of documents; a window is ``window_sequences`` sequences.  By deficit round-robin every
source sends its quota to each window; what rounding leaves of a quota is a deficit that the next windows
pay, and as a queue's running sum is taken over all partitions, it is carried across partitions too.  Quotas
follow the target proportions among the sources that still have tokens.  By default these are the sources' shares of all tokens, so
all queues run dry together and every window holds the mixture of the whole, to within one token of a source.

In closed form: at the time v a source has sent min(T_s, w_s * v) of its T_s tokens, w_s being its target; the sum X(v) of all
grows by pieces, a piece ending where a source runs dry.  Before window w it has sent the floor of that at X(v) = w * window.  The
windows, their sources in turn, make one gapless stream that is cut every ``seq_len`` tokens, so only
the last sequence has padding.  A document's place follows from the tokens before it in its queue and
from the totals of the queues alone.  Shorter windows mix more finely and cut documents more often.  The table of queues, a number for
each source, is held by every task.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.llm.common import materialize, md5_fraction, small_batches
from kgloom.llm.mixing import source_key

SEQ_LEN = 1024
WINDOW_SEQUENCES = 16
SEPARATOR = 0
CELL_ROWS = 100_000
MIN_SALTS = 16


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def load_encoder(path: str):
    """A function from a text to its ids.

    Ids are those of the tokenizer file; byte-level BPE files whose ids follow their merges are run by
    tiktoken, which gives the same ids about four times as fast, others by tokenizers.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, added = spec["model"], {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    pre = spec.get("pre_tokenizer") or {}
    # The alphabet of byte-level BPE: printable Latin-1 characters stand for themselves, other bytes for 256 and up.
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    ids = [model["vocab"].get("".join(m), -1) for m in merges]
    follows = all(x < y for x, y in zip(ids, ids[1:], strict=False)) and (not ids or ids[0] >= 0)
    if model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer") and follows:
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        enc = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        return lambda text: enc.encode_to_numpy(text, allowed_special="all")
    tok = Tokenizer.from_file(path)
    return lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, np.uint32)


def tokenize(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``(uid, doc_id, source, n, ids)`` with the separator's id at the end of ids (little-endian; 16 bits where all fit)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        to_ids, uid = load_encoder(tokenizer_path), TaskContext.get().partitionId() << 40
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                n, packed = [], []
                for text in part.column(2):
                    ids = np.append(to_ids(text.as_py() or ""), np.uint32(SEPARATOR)).astype("<u4")
                    n.append(len(ids))
                    packed.append((ids.astype("<u2") if len(ids) and ids.max() < 1 << 16 else ids).tobytes())
                rows = pa.array(range(uid, uid + part.num_rows), pa.int64())
                uid += part.num_rows
                yield pa.RecordBatch.from_arrays([rows, part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], ["uid", "doc_id", "source", "n", "ids"])

    return docs.mapInArrow(encode, "uid long, doc_id long, source string, n long, ids binary")


def queue_places(sized: DataFrame) -> tuple[DataFrame, list[str], list[int]]:
    """``(uid, queue, before)`` for ``sized(uid, doc_id, source, n)``, and the queues and their totals.

    ``before``: the tokens of the queue ahead of the document, in the order of a hash of the id.  Sums go
    by cells (queue, salt), so a queue with most of all rows isn't one task's work.
    """
    key = source_key(F.col("source"))
    salts = max(MIN_SALTS, -(-sized.count() // CELL_ROWS))
    h = md5_fraction(F.coalesce(F.col("doc_id"), F.lit(-1)))
    rows = sized.select("uid", key.alias("queue"), h.alias("h"), (h % salts).alias("salt"), "n")
    cells = rows.groupBy("queue", "salt").agg(F.sum("n").alias("m"))
    totals = sorted((r["queue"], r["m"]) for r in cells.groupBy("queue").agg(F.sum("m").alias("m")).collect())
    ahead = F.sum("m").over(Window.partitionBy("queue").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("queue", "salt", F.coalesce(ahead, F.lit(0)).alias("base"))
    upto = F.sum("n").over(Window.partitionBy("queue", "salt").orderBy("h", "uid").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).join(cells, ["queue", "salt"])
    return rows.select("uid", "queue", (F.col("base") + F.col("upto") - F.col("n")).alias("before")), [q for q, _ in totals], [m for _, m in totals]


class Rota:
    """Where the tokens of each queue go: windows of ``window`` tokens, the queues in turn by ``weights`` (their totals by default)."""

    def __init__(self, totals: list[int], window: int, weights: list[int] | None = None):
        self.total, self.window, self.sizes, self.weights = sum(totals), window, totals, weights or totals
        # Queues in the order in which they run dry: then (as fractions), and before each: tokens of the dry ones and weights of the others.
        order = sorted(range(len(totals)), key=lambda q: Fraction(totals[q], self.weights[q]))
        self.dry, self.gone, self.left, self.sent = [], [], [], []
        gone, left = 0, sum(self.weights)
        for q in order:
            then = Fraction(totals[q], self.weights[q])
            if not self.dry or then > self.dry[-1]:
                self.dry.append(then)
                self.gone.append(gone)
                self.left.append(left)
                self.sent.append(gone + left * then)
            gone, left = gone + totals[q], left - self.weights[q]
        small = max([self.total, *self.weights]) * max([self.total, sum(self.weights)]) < 1 << 62  # products fit in 64 bits
        self.array = np.array(totals, np.int64 if small else object)
        self.weight = np.array(self.weights, np.int64 if small else object)
        self.at = lru_cache(maxsize=max(16, (1 << 22) // max(1, len(totals))))(self._at)

    def _sent(self, tokens: int) -> np.ndarray:
        """What each queue has sent when all have sent ``tokens``."""
        if tokens >= self.total:
            return self.array
        k = bisect_left(self.sent, tokens)
        return np.minimum(self.weight * (tokens - self.gone[k]) // self.left[k], self.array)

    def _at(self, w: int) -> tuple[list[int], list[int], list[int]]:
        """Before window w: tokens sent by each queue; then the ends of their runs; and where the runs begin in the stream."""
        sent, then = self._sent(w * self.window), self._sent((w + 1) * self.window)
        begin = sent.sum() + np.cumsum(then - sent) - (then - sent)
        return sent.tolist(), then.tolist(), begin.tolist()

    def runs(self, queue: int, before: int, n: int):
        """(start, length, position) of the document's runs; ``start`` counts from its first token."""
        start, weight = 0, self.weights[queue]
        while start < n:
            c = before + start
            k = bisect_left(self.dry, Fraction(c + 1, weight))
            w = -(-(self.gone[k] * weight + self.left[k] * (c + 1)) // (self.window * weight)) - 1  # the last window before which at most c are sent
            sent, then, begin = self.at(w)
            length = min(n - start, then[queue] - c)
            yield start, length, begin[queue] + c - sent[queue]
            start += length


def _weights(queues: list[str], totals: list[int], targets: dict[str | None, float] | None) -> list[int]:
    if targets is None:
        return totals
    of = {"b" if source is None else f"a{source}": share for source, share in targets.items()}
    if missing := [q for q in queues if not of.get(q, 0) > 0]:
        raise ValueError(f"targets need a share above 0 for each source; not so: {missing[:5]}")
    return [max(1, round(of[q] / sum(of.values()) * (1 << 30))) for q in queues]


def pack_documents(
    docs: DataFrame, tokenizer_path: str | None = None, seq_len: int = SEQ_LEN, window_sequences: int = WINDOW_SEQUENCES, targets: dict[str | None, float] | None = None
) -> DataFrame:
    """The pieces of all documents: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``targets`` are the sources' proportions of each window's tokens, among those that have tokens left; by default their shares of
    all.  All documents are packed whatever the targets.  A null or empty text is its separator alone.  Repeated rows are packed each; null sources are one
    queue; a null doc_id stays null.  An empty table gives no piece.
    """
    small_batches(docs.sparkSession)
    path = tokenizer_path or default_tokenizer()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    tokens = materialize(tokenize(rows, path), "tokens")
    places, queues, totals = queue_places(tokens.select("uid", "doc_id", "source", "n"))
    number, weights = {q: i for i, q in enumerate(queues)}, _weights(queues, totals, targets)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        rota = Rota(totals, seq_len * window_sequences, weights)
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for doc, n, packed, queue, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                raw = packed.as_buffer()
                ids = np.frombuffer(raw, "<u2" if raw.size == 2 * n else "<u4").astype("<u4")
                for start, run, position in rota.runs(number[queue], before, n):
                    end = start + run
                    while start < end:
                        offset = position % seq_len
                        length = min(end - start, seq_len - offset)
                        for c, x in zip(cols, (doc, start, length, zlib.crc32(ids[start : start + length]), n, position // seq_len, offset), strict=True):
                            c.append(x)
                        start, position = start + length, position + length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return tokens.join(places, "uid").select("doc_id", "n", "ids", "queue", "before").mapInArrow(cut, schema)
