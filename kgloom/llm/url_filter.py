"""Operator 3: URL filters by a sorted digest array.

A rule is a host and the beginning of a path, such as ``example.net/en/``.  The index file holds the 64-bit xxhash
digests of all rules in ascending order, and their full strings; tasks map it into memory, make
the few candidate rules that a url can match (one for each shape, labels and path length, that some rule has), probe the
digests of a whole batch with one vectorised binary search, and compare the stored strings of
hits, so a collision never decides.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import shared_root, write_bytes

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DEFAULT_VERDICT = "allow"
#: A list of rules is a configuration, not a table: larger indexes are refused.
MAX_INDEX_BYTES = 4 << 30


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def index_bytes(rules: Iterable[tuple[str, str]]) -> bytes:
    """The index of ``(rule, verdict)``; a rule's host ends at its first ``/``."""
    own = sorted((xxhash.xxh64_intdigest(r.encode()), r.encode(), v) for r, v in dict(rules).items())
    verdicts = sorted({v for *_, v in own})
    shapes = sorted({(r.decode().partition("/")[0].count(".") + 1, len(r.decode()) - r.decode().index("/") if b"/" in r else 0) for _, r, _ in own})
    head = json.dumps({"n": len(own), "verdicts": verdicts, "shapes": shapes}).encode()
    head += b" " * (-(len(head) + 8) % 8)
    ends = np.cumsum([0, *(len(r) for _, r, _ in own)], dtype=np.uint64)
    parts = [np.uint64(len(head)).tobytes(), head, np.array([h for h, *_ in own], np.uint64).tobytes(), ends.tobytes(), np.array([verdicts.index(v) for *_, v in own], np.uint8).tobytes()]
    return b"".join([*parts, *(r for _, r, _ in own)])


class DigestIndex:
    """An index file, mapped into memory."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        at = 8 + int(raw[:8].view(np.uint64)[0])
        head = json.loads(raw[8:at].tobytes())
        n, self.verdicts, self.shapes = head["n"], head["verdicts"], [tuple(s) for s in head["shapes"]]
        self.keys = raw[at : at + 8 * n].view(np.uint64)
        self.ends = raw[at + 8 * n : at + 16 * n + 8].view(np.uint64)
        self.codes = raw[at + 16 * n + 8 : at + 17 * n + 8]
        self.blob = raw[at + 17 * n + 8 :]

    def match(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str | None]]:
        """The longest rule for each url and its verdict; of two equally long ones that with the longer host."""
        rules: list[str | None] = [None] * len(hosts)
        verdicts: list[str | None] = [None] * len(hosts)
        found: list[tuple[int, int]] = [(0, 0)] * len(hosts)
        owners, asked = [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            dots: list[int] = []
            for labels, length in self.shapes:
                if not host or length > len(path):
                    continue
                while len(dots) < labels and (not dots or dots[-1] > 0):  # starts of the last 1, 2, ... labels
                    dots.append(host.rfind(".", 0, dots[-1] - 1 if dots else len(host)) + 1)
                if len(dots) >= labels:
                    owners.append((i, len(host) - dots[labels - 1]))
                    asked.append(host[dots[labels - 1] :] + path[:length])
        if not asked or not len(self.keys):
            return rules, verdicts
        digests = np.array([xxhash.xxh64_intdigest(a.encode()) for a in asked], np.uint64)
        places = np.searchsorted(self.keys, digests)
        hits = np.flatnonzero(self.keys[np.minimum(places, len(self.keys) - 1)] == digests)
        for k in hits.tolist():
            at, text = int(places[k]), asked[k].encode()
            while at < len(self.keys) and self.keys[at] == digests[k]:
                if self.blob[int(self.ends[at]) : int(self.ends[at + 1])].tobytes() == text:
                    i, host_length = owners[k]
                    if (len(asked[k]), host_length) > found[i]:
                        found[i], rules[i], verdicts[i] = (len(asked[k]), host_length), asked[k], self.verdicts[self.codes[at]]
                at += 1
        return rules, verdicts


@lru_cache(maxsize=4)
def _index(name: str) -> DigestIndex:
    from pyspark import SparkFiles

    return DigestIndex(SparkFiles.get(name))


def publish_index(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> str:
    """Write the index once and let every executor, also later ones, fetch it; the name for tasks."""
    data, name = index_bytes(rules), f"kgloom-urls-{uuid.uuid4().hex}.idx"
    if len(data) > MAX_INDEX_BYTES:
        raise ValueError(f"an index of {len(data)} bytes is over {MAX_INDEX_BYTES}")
    write_bytes(spark, path := f"{shared_root(spark)}/{name}", data)
    spark.sparkContext.addFile(path)
    return name


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, default: str = DEFAULT_VERDICT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row.

    A rule fits its host and all subdomains if the url's path starts with the rule's; the longest wins.  Without
    a rule, as for a null url or one without ``://`` (host and path empty), the verdict is ``default``.  Repeated
    rows give repeated results; other columns are ignored.
    """
    name = publish_index(pages.sparkSession, rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, verdicts = _index(name).match(b.column(1).to_pylist(), b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string()), pa.array([v or default for v in verdicts], pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    url = F.col(url_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    return rows.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")


URL_SQL = r"""
WITH r AS (
  SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS t(rhost, rpath, rverdict)),
s AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM s)
SELECT u.page_id, u.host, u.path,
  (SELECT max_by(rhost || rpath, length(rhost || rpath)) FROM r WHERE (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath)) AS rule,
  coalesce((SELECT max_by(rverdict, length(rhost || rpath)) FROM r WHERE (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath)), 'allow') AS verdict
FROM u
"""
