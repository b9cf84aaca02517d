"""Physical records of native logs, read by byte ranges.

`native_records` is a data source that plans ranges of bytes.  A record belongs to the
range that holds its first byte: a range that starts inside a record skips to the next
one, and finishes its last record beyond its end.  One log of any size is so read by
many tasks, each holding a chunk and a record; what is longer than the limit is
counted and thrown away.  Byte offsets are exact as they are read.  Line numbers need
the lines of the ranges before, which a second, narrow scan of split files counts.

Files are opened through Arrow's file systems: plain paths and file:, hdfs:, s3: and
gs: addresses.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

MAX_RECORD = 16 << 20
RANGE = 64 << 20
CHUNK = 1 << 20
BLANK = "blank_record"
#: Discovery reads so much of a file.
HEAD_BYTES, HEAD_RECORDS = 1 << 18, 50
#: Counts of lines of up to so many ranges are broadcast; more are joined by shuffle.
BROADCAST_RANGES = 100_000

SCHEMAS = {
    "records": "path string, range_no int, line_in_range long, byte_offset long, raw_bytes long, value string, diagnostic string",
    "count": "path string, range_no int, n_lines long",
    "digest": "path string, sha256 string, bytes long",
}
SCHEMAS["head"] = SCHEMAS["records"]
COLUMNS = ("path", "line_no", "byte_offset", "raw_bytes", "value", "diagnostic")


def opened(path: str):
    """A random-access file of a plain path or an address."""
    system, at = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(at)


def sized(path: str) -> int:
    system, at = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    info = system.get_file_info(at)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def first_record(file, start: int, end: int) -> int | None:
    """Offset of the first record that starts in [start, end), or None."""
    if start == 0:
        return 0 if end else None
    at = start - 1  # a record that starts at start has a line end before it
    file.seek(at)
    while at < end - 1:
        chunk = file.read(min(CHUNK, end - 1 - at))
        if not chunk:
            return None
        if (i := chunk.find(b"\n")) >= 0:
            return at + i + 1
        at += len(chunk)
    return None


def physical(file, start: int, end: int, most: int = MAX_RECORD) -> Iterator[tuple[int, int, bytes | None]]:
    """(offset, bytes, content with its line end) of the records that start in [start, end); content is None over the limit."""
    begin = first_record(file, start, end)
    if begin is None:
        return
    file.seek(begin)
    chunk, at, size, held = b"", 0, 0, []
    while begin < end:
        if at == len(chunk):
            chunk, at = file.read(CHUNK), 0
            if not chunk:
                if size:
                    yield begin, size, b"".join(held) if size <= most else None
                return
        i = chunk.find(b"\n", at)
        to = i + 1 if i >= 0 else len(chunk)
        size += to - at
        if size <= most:
            held.append(chunk[at:to])
        else:
            held.clear()
        at = to
        if i >= 0:
            yield begin, size, b"".join(held) if size <= most else None
            begin, size = begin + size, 0
            held.clear()


def _refuse(name: str):
    raise ValueError(name)


def judged(raw: bytes | None) -> tuple[str | None, str | None]:
    """(text, diagnostic) of a record: a JSON object and nothing after it, or what is wrong."""
    if raw is None:
        return None, "record_too_large"
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None, "invalid_utf8"
    try:
        is_object = isinstance(json.loads(text, parse_constant=_refuse, parse_int=str, parse_float=str), dict)
    except (ValueError, RecursionError):
        is_object = False
    return (text, None) if is_object else (None, "invalid_record" if text.strip() else BLANK)


@dataclass
class Range(InputPartition):
    path: str
    number: int
    start: int
    end: int

    def __init__(self, path: str, number: int, start: int, end: int):
        super().__init__(None)
        self.path, self.number, self.start, self.end = path, number, start, end


class RecordReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.what = options.get("what", "records")
        self.paths = json.loads(options["paths"])
        self.range_bytes = int(options.get("range_bytes", RANGE))
        self.most = int(options.get("max_record", MAX_RECORD))

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for path in self.paths:
            size = sized(path)
            step = self.range_bytes if self.what in ("records", "count") else max(1, size)
            starts = range(0, size, step)
            if self.what == "digest" and not size:
                starts = [0]
            if self.what == "count" and len(starts) < 2:
                continue
            out += [Range(path, i, at, min(at + step, size)) for i, at in enumerate(starts)]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        schema = _arrow(SCHEMAS[self.what])
        if not partition.path:
            return
        with opened(partition.path) as file:
            if self.what == "digest":
                digest, size = hashlib.sha256(), 0
                while chunk := file.read(CHUNK):
                    digest.update(chunk)
                    size += len(chunk)
                yield pa.record_batch([[partition.path], [digest.hexdigest()], [size]], schema=schema)
            elif self.what == "count":
                n = sum(1 for _ in physical(file, partition.start, partition.end, 0))
                yield pa.record_batch([[partition.path], [partition.number], [n]], schema=schema)
            else:
                if self.what == "head":  # the last record of the head may be cut off: it is not one
                    head = file.read(HEAD_BYTES)
                    whole = head if len(head) < HEAD_BYTES or len(head) == partition.end else head[: head.rfind(b"\n") + 1]
                    rows = physical(pa.BufferReader(whole), 0, len(whole), self.most)
                    rows = (r for r, _ in zip(rows, range(HEAD_RECORDS)))
                else:
                    rows = physical(file, partition.start, partition.end, self.most)
                held, size = [], 0
                for line, (offset, n, raw) in enumerate(rows, 1):
                    held.append((partition.path, partition.number, line, offset, n, *judged(raw)))
                    size += n
                    if len(held) >= 5000 or size >= 8 * CHUNK:
                        yield _batch(held, schema)
                        held, size = [], 0
                yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", "))])


class NativeRecords(DataSource):
    """Options: paths (a JSON list), what (records, head, count or digest), range_bytes, max_record."""

    @classmethod
    def name(cls) -> str:
        return "native_records"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("what", "records")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordReader(dict(self.options))


def _source(spark: SparkSession, paths: Sequence[str], what: str, **options: int) -> DataFrame:
    spark.dataSource.register(NativeRecords)
    reader = spark.read.format("native_records").option("paths", json.dumps(list(dict.fromkeys(paths)))).option("what", what)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def records(spark: SparkSession, paths: Sequence[str], range_bytes: int = RANGE, max_record: int = MAX_RECORD, skip_blank: bool = False) -> DataFrame:
    """(path, line_no, byte_offset, raw_bytes, value, diagnostic): every physical line of logs; blank ones are invalid records unless they are skipped.

    value is the record with its line end, a JSON object; what is none is told by
    diagnostic: record_too_large, invalid_utf8 or invalid_record.  A last line without
    a line end is a record, an empty file has none; a path named twice is read once.
    """
    rows = _source(spark, paths, "records", range_bytes=range_bytes, max_record=max_record)
    counts = _source(spark, paths, "count", range_bytes=range_bytes)
    before = F.sum("n_lines").over(Window.partitionBy("path").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1))
    placed = counts.select("path", "range_no", F.coalesce(before, F.lit(0)).alias("lines_before"))
    ranges = sum(-(-sized(p) // range_bytes) for p in set(paths))
    joined = rows.join(F.broadcast(placed) if ranges <= BROADCAST_RANGES else placed, ["path", "range_no"], "left")
    if skip_blank:
        joined = joined.where(F.coalesce(F.col("diagnostic") != BLANK, F.lit(True)))
    joined = joined.withColumn("diagnostic", F.when(F.col("diagnostic") == BLANK, "invalid_record").otherwise(F.col("diagnostic")))
    return joined.withColumn("line_no", F.col("line_in_range") + F.coalesce("lines_before", F.lit(0))).select(*COLUMNS)


def heads(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The same, without blank lines, for the first 50 lines in the first 256 KiB of each file, of which no more is read."""
    rows = _source(spark, paths, "head").where(F.coalesce(F.col("diagnostic") != BLANK, F.lit(True)))
    return rows.withColumnRenamed("line_in_range", "line_no").select(*COLUMNS)


def digests(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, sha256, bytes): a task a file, which holds a chunk of it."""
    return _source(spark, paths, "digest")


def scan_stats(spark: SparkSession, paths: Sequence[str], range_bytes: int = RANGE, max_record: int = MAX_RECORD) -> DataFrame:
    """(path, sha256, hash_scope, bytes, lines, malformed, stop_reason) of whole files."""
    counted = records(spark, paths, range_bytes, max_record).groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.count("diagnostic").alias("malformed"))
    out = digests(spark, paths).join(counted, "path", "left")
    return out.select("path", "sha256", F.lit("whole_source").alias("hash_scope"), "bytes", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("malformed", F.lit(0)).alias("malformed"), F.lit("eof").alias("stop_reason"))
