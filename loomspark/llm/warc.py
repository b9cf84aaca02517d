"""WARC archives: one gzip member per record, and a sequential reader with bounded memory.

Writing: digests are computed by Spark, the first page of each repeated payload is
found by a grouped minimum (partial minima before the shuffle), and every task
writes its own archive to the shared folder.  An archive has a name of its own per
task attempt; only attempts that ended are in the returned manifest, so a lost
executor leaves at most an unlisted file.  Reading: archives are dealt one to a
task and read as a stream: incremental zlib, header, content-length framing, digest.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.shared import map_arrow, save, shared_dir

MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 1 << 30
#: Revisits up to this many (24 bytes each) are broadcast to the pages; more are joined by shuffle.
BROADCAST_REVISITS = 500_000
CHUNK = 1 << 16

# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "<urn:x-page:{}>"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, digest, refers_to: the smallest page_id with the same payload, null for a response.

    Null html is an empty payload.  Payloads under min_bytes never revisit.  Rows
    that share the smallest page_id are all responses; a null page_id comes after
    all others and revisits if any other has its payload.
    """
    key = lambda c: F.xxhash64(c)
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    sums = base.where(F.octet_length("html") >= min_bytes).select("page_id", F.sha2("html", 256).alias("digest"))
    firsts = sums.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).where("n > 1 and first is not null")
    revisits = sums.join(firsts.drop("n"), "digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
    revisits = save(revisits.select(F.col("page_id").alias("r_id"), "digest", F.col("first").alias("refers_to")).distinct().select("r_id", key("digest").alias("r_key"), "refers_to"), "revisits")
    # three numbers a row: few enough to broadcast, the pages' text isn't shuffled
    hint = F.broadcast if revisits.count() <= BROADCAST_REVISITS else (lambda d: d)
    base = base.withColumn("digest", F.sha2("html", 256))
    return base.join(hint(revisits), F.col("page_id").eqNullSafe(F.col("r_id")) & (key("digest") == F.col("r_key")), "left").drop("r_id", "r_key")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record, uncompressed.  A revisit holds the HTTP header with the full length and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": RECORD_ID.format("null" if page_id is None else page_id),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Length": str(len(block)),
    }
    if url:
        head["WARC-Target-URI"] = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    if refers_to is not None:
        head["WARC-Refers-To"] = RECORD_ID.format(refers_to)
        head["WARC-Profile"] = IDENTICAL
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items())
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def write_archives(marked: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = 6) -> DataFrame:
    """Write each partition of mark_revisits() as archives in folder; returns the stored manifest (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _filesystem(folder)
        done: list[tuple[str, int]] = []
        out, path, size, n = None, "", 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, size, n = f"{folder}/{name}", 0, 0
                    fs.create_dir(at, recursive=True)
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = record(row["page_id"], row["url"], row["html"].encode(), row["digest"], row["refers_to"])
                member = z.compress(raw) + z.flush()
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], ["path", "records"])

    return save(map_arrow(marked.select("page_id", "url", "html", "digest", "refers_to"), run, "path string, records long"), "manifest")


def read_members(stream) -> Iterator[Iterator[bytes]]:
    """For each gzip member of a byte stream an iterator over its inflated chunks."""
    state = {"buf": b"", "end": False}

    def more() -> bool:
        if not state["buf"] and not state["end"]:
            state["buf"] = stream.read(CHUNK)
            state["end"] = not state["buf"]
        return bool(state["buf"])

    def member() -> Iterator[bytes]:
        z = zlib.decompressobj(31)
        while not z.eof:
            if not more():
                raise ValueError("the archive ends inside a record")
            data = z.decompress(state["buf"], CHUNK)
            state["buf"] = z.unused_data if z.eof else z.unconsumed_tail
            if data:
                yield data

    while more():
        yield member()


class _Bytes:
    """Lines and exact lengths from an iterator of chunks."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.buf = chunks, b""

    def fill(self) -> bool:
        data = next(self.chunks, b"")
        self.buf += data
        return bool(data)

    def header(self) -> list[bytes]:
        while (end := self.buf.find(b"\r\n\r\n")) < 0:
            if not self.fill():
                raise ValueError("a record without a header")
        lines = self.buf[:end].split(b"\r\n")
        self.buf = self.buf[end + 4 :]
        return lines

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buf and not self.fill():
                raise ValueError("a record shorter than its Content-Length")
            part, self.buf = self.buf[:n], self.buf[n:]
            n -= len(part)
            yield part


def _fields(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8").partition(":") for x in lines)}


def parse_record(chunks: Iterator[bytes], with_payload: bool) -> dict:
    """Header, framing and digests of one record; the payload is hashed as it passes."""
    src = _Bytes(chunks)
    lines = src.header()
    if lines[0] != VERSION:
        raise ValueError(f"not a WARC record: {lines[0][:20]!r}")
    head = _fields(lines[1:])
    block = hashlib.sha256()
    payload = hashlib.sha256()
    kept: list[bytes] = []
    http, pending, got = None, b"", 0
    for part in src.take(int(head["content-length"])):
        block.update(part)
        if http is None:
            pending += part
            if (end := pending.find(b"\r\n\r\n")) < 0:
                continue
            http, part = _fields(pending[:end].split(b"\r\n")[1:]), pending[end + 4 :]
        payload.update(part)
        got += len(part)
        if with_payload:
            kept.append(part)
    if b"".join([*src.take(4)]) != b"\r\n\r\n":
        raise ValueError("a record that is not ended by two line ends")
    if src.buf or next(src.chunks, b""):
        raise ValueError("a gzip member with more than one record")
    kind = head["warc-type"]
    length = int((http or {}).get("content-length", 0))
    told = head["warc-payload-digest"].partition(":")[2]
    if head["warc-block-digest"].partition(":")[2] != block.hexdigest():
        raise ValueError(f"the block digest of {head['warc-record-id']} does not hold")
    if kind == "response" and (told != payload.hexdigest() or length != got):
        raise ValueError(f"the payload digest of {head['warc-record-id']} does not hold")
    ident = lambda s: None if s is None or s.endswith(":null>") else int(s[len(RECORD_ID) - 3 : -1])
    return {
        "page_id": ident(head["warc-record-id"]),
        "url": head.get("warc-target-uri"),
        "payload_bytes": length,
        "payload_digest": told,
        "record_type": kind,
        "refers_to": ident(head.get("warc-refers-to")),
        "payload": b"".join(kept) if with_payload and kind == "response" else None,
    }


READ_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives named by manifest.path, digests verified.

    A broken frame or digest raises an error that names the record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = _filesystem(path)
                rows, size = [], 0
                with fs.open_input_stream(at, compression=None, buffer_size=CHUNK) as f:
                    for chunks in read_members(f):
                        rows.append(parse_record(chunks, with_payload))
                        size += len(rows[-1]["payload"] or b"") + 200
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, READ_SCHEMA)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, READ_SCHEMA)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    n = max(1, manifest.count())
    return map_arrow(manifest.select("path").repartition(n, "path"), run, schema)


def check_revisits(records: DataFrame) -> None:
    """Raise an error if a revisit names no response with its payload's digest and length.

    Claims are made distinct first, so a response with many revisits is one row.
    """
    same = ["page_id", "payload_digest", "payload_bytes"]
    claims = records.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), *same[1:]).distinct()
    bad = claims.join(records.where("record_type = 'response'").select(*same), same, "left_anti").limit(1).collect()
    if bad:
        raise ValueError(f"a revisit refers to page {bad[0]['page_id']}, which has no response of {bad[0]['payload_bytes']} bytes with digest {bad[0]['payload_digest']}")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_archives(mark_revisits(pages), shared_dir(spark))
    records = save(read_archives(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"), "records")
    check_revisits(records)
    return records


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= {MIN_REVISIT_BYTES} GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN f.first_id <> d.page_id AND d.payload_bytes >= {MIN_REVISIT_BYTES} THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_id <> d.page_id AND d.payload_bytes >= {MIN_REVISIT_BYTES} THEN f.first_id END AS refers_to, u.url
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest JOIN pages u ON u.page_id = d.page_id
"""
