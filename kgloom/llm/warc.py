"""Operator 9: WARC archives, written by tasks and read back by byte ranges.

Every record is a gzip member of its own.  A reading task gets a byte range of a file, looks for gzip
magic from the range's start, takes a candidate for a member only if it inflates to a WARC header whose
Content-Length is met by the whole member and its checksum, and then goes from member to member; it owns the records
that start inside its range, and reads past the end for the last one.  So a file of any size is
shared by many tasks, and a lost task is simply read again.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import materialize, small_batches

MAGIC = b"\x1f\x8b\x08"
_CHUNK = 1 << 20
MAX_TASKS = 20_000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
MANIFEST = "path string, bytes long, records long"
RECORDS = "page_id long, target_uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, path string, offset long"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _from_urn(value: str | None) -> int | None:
    tail = (value or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(tail) if tail.lstrip("-").isdigit() else None


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, level: int) -> bytes:
    """One WARC record as a gzip member; a revisit holds the HTTP header only."""
    kind = "response" if refers_to is None else "revisit"
    block = _HTTP % len(payload) + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write_warc(
    pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", max_file_bytes: int = 512 << 20, level: int = 3
) -> DataFrame:
    """Write a record for each row of ``pages(page_id, url, html)`` below ``path``; a manifest of the files, once written.

    Of records with equal payloads of at least ``min_bytes`` bytes, those with the smallest page_id are
    responses and the others revisit it; smaller payloads are always responses.  A null html is an empty payload, a null page_id
    sorts last and, where no equal payload has an id, is a response; repeated rows with the smallest id are all responses.
    Line ends in a url are percent-encoded.  Each attempt of a task writes files of its own names; the manifest holds those of the attempts that
    counted, so files that a lost or repeated attempt left behind are in no manifest: read with it (``read_warc``).
    """
    small_batches(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long_enough = rows.where(F.length("payload") >= min_bytes)
    first = long_enough.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    rows = rows.join(first, "digest", "left").withColumn(
        "refers_to", F.when((F.length("payload") >= min_bytes) & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx, fs, out, done = TaskContext.get(), None, None, []
        stem = f"{path}/part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        try:
            for b in batches:
                for page_id, url, body, digest, refers in zip(*(b.column(i) for i in range(5)), strict=True):
                    if out is None:
                        name = f"{stem}-{len(done):04d}.warc.gz"
                        fs, to = _open(name)
                        temp = f"{to}.tmp"
                        if fs.type_name == "local":
                            fs.create_dir(to.rpartition("/")[0], recursive=True)
                        out, size, count = fs.open_output_stream(temp), 0, 0
                    raw = encode_record(page_id.as_py(), url.as_py(), body.as_py(), base64.b32encode(bytes.fromhex(digest.as_py())).decode(), refers.as_py(), date, level)
                    out.write(raw)
                    size, count = size + len(raw), count + 1
                    if size >= max_file_bytes:
                        out.close()
                        fs.move(temp, to)
                        done.append((name, size, count))
                        out = None
            if out is not None:
                out.close()
                fs.move(temp, to)
                done.append((name, size, count))
                out = None
        finally:
            if out is not None:
                out.close()
                fs.delete_file(temp)
        cols = list(zip(*done, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["path", "bytes", "records"])

    written = rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, MANIFEST)
    return materialize(written, "warc-manifest")


def _inflate(f, at: int, size: int) -> tuple[bytes, int] | None:
    """The whole member at ``at`` and where it ends; None if it isn't a sound WARC record."""
    z, got, pos, checked = zlib.decompressobj(31), bytearray(), at, False
    f.seek(at)
    try:
        while not z.eof and pos < size:
            chunk = f.read(min(_CHUNK if checked else 1 << 12, size - pos))
            pos += len(chunk)
            seen = len(got)
            got += z.decompress(chunk)
            if not checked and len(got) >= 5:
                if got[:5] != b"WARC/":
                    return None
                checked = got.find(b"\r\n\r\n", max(0, seen - 3)) >= 0
    except zlib.error:
        return None
    if not z.eof:
        return None
    head, sep, block = bytes(got).partition(b"\r\n\r\n")
    length = next((x[15:].strip() for x in head.split(b"\r\n") if x[:15].lower() == b"content-length:"), b"")
    if not sep or not length.isdigit() or len(block) != int(length) + 4:
        return None
    return bytes(got), pos - len(z.unused_data)


def read_range(path: str, start: int, end: int, strict: bool = True) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header, block) of the records that start in [start, end) of a file of gzip members."""
    fs, where = _open(path)
    with fs.open_input_file(where) as f:
        size = f.size()
        end, pos, chained = min(end, size), start, start == 0
        while pos < end:
            got = _inflate(f, pos, size)
            if got is None:
                if chained and strict:
                    raise ValueError(f"{path}: no sound record at byte {pos}")
                chained = False
                pos = _next_magic(f, pos + 1, end)
                continue
            raw, after = got
            head, _, rest = raw.partition(b"\r\n\r\n")
            lines = head.decode("utf-8", "replace").split("\r\n")
            header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            yield pos, header, rest[:-4]
            pos, chained = after, True


def _next_magic(f, pos: int, end: int) -> int:
    """The next place below ``end`` where gzip magic begins, or ``end``."""
    while pos < end:
        f.seek(pos)
        chunk = f.read(min(_CHUNK, end - pos) + len(MAGIC) - 1)
        at = chunk.find(MAGIC)
        if at >= 0:
            return min(pos + at, end)
        pos += _CHUNK
    return end


def read_warc(spark: SparkSession, path: str, split_bytes: int = 16 << 20, strict: bool = True, manifest: DataFrame | None = None) -> DataFrame:
    """The records of the files of ``manifest``, or else of all ``*.warc.gz`` files below ``path`` (columns RECORDS).

    A response has its payload, whose length and digest are computed from it and must agree with the header; a revisit has
    those of its header and no payload.  ``strict``: bytes between two records raise an error, else they are skipped.
    """
    small_batches(spark)
    if manifest is not None:
        files = manifest.select("path", F.col("bytes").alias("length"))
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").schema(
            "path string, modificationTime timestamp, length long, content binary"
        ).load(path).select("path", "length")
    ranges = files.where("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    # A task for each range, up to MAX_TASKS: the rows are too small for their size to tell how much work they are.
    ranges = ranges.repartition(max(1, min(MAX_TASKS, ranges.count())), "path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64()]
        names = ["page_id", "target_uri", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "path", "offset"]
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                for offset, header, block in read_range(name, start, start + split_bytes, strict):
                    kind, payload = header.get("warc-type"), None
                    digest, size = header.get("warc-payload-digest", "").removeprefix("sha1:"), int(header.get("x-payload-length", -1))
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if (digest and own != digest) or size not in (-1, len(payload)):
                            raise ValueError(f"{name}: the payload at byte {offset} differs from its header")
                        digest, size = own, len(payload)
                    rows.append((_from_urn(header.get("warc-record-id")), header.get("warc-target-uri"), kind, _from_urn(header.get("warc-refers-to")), size, digest, payload, name, offset))
                    held += len(payload or b"")
                    if held > 8 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return ranges.mapInArrow(read, RECORDS)


def verified(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """``records``, which have a ``path``, as they were read once; an error if a file has not as many as ``manifest`` says."""
    records = materialize(records, "warc-records")
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    read = records.groupBy(name).agg(F.count("*").alias("read"))
    wrong = manifest.select(name, "records").join(read, "name", "full").where(~F.col("records").eqNullSafe(F.col("read"))).head(5)
    if wrong:
        raise ValueError("records written and read differ: " + ", ".join(f"{r['name']} {r['records']} and {r['read']}" for r in wrong))
    return records


_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {1 + 5 * g}, 5))::BIGINT >> {15 - 5 * k}) & 31)::INT + 1, 1)" for g in range(8) for k in range(4)
)
WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, {_B32} AS payload_digest,
  CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NOT DISTINCT FROM page_id THEN NULL ELSE first END AS refers_to
FROM f
"""
