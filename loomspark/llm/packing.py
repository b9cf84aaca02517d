"""Packing by power-of-two decomposition: every piece of a document is a sequence of its own.

A document of n ids is cut into as many pieces of max_len as fit and then into the
powers of two of the remainder, largest first.  Pieces of one length form a bucket
and are batched together, so no sequence crosses documents and none is padded.
Work is per document: no shuffle, and a task holds one Arrow batch.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.shared import map_arrow

MAX_LEN = 2048
END_ID = 1
#: Tokenizer words whose ids a worker remembers; the memory is emptied when it is full.
WORD_MEMORY = 600_000

# The tokenizer lower-cases, drops white space and encodes each of these parts for itself.  The
# split is spelled out for ASCII and the letters from A grave on; other texts go by white space.
_PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t\n\r\f\va-z0-9ß-öø-ÿ]+")
_OTHER = re.compile("[^\x00-\x7fÀ-ÿ]|<\\|")
_WORD = re.compile("[^ \t\n\r\f\v]+")
_TOKENIZERS: dict = {}


class WordIds(dict):
    """The ids of a part of text, as little-endian unsigned 32-bit bytes; each is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORD_MEMORY:
            self.clear()
        ids = self[word] = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return ids


def word_ids(path: str) -> WordIds:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


_LAST = np.array([END_ID], "<u4").tobytes()


def encode(text: str | None, known: WordIds) -> bytes:
    """All ids of a text and the end id, as bytes."""
    text = text or ""
    parts = _WORD.findall(text) if _OTHER.search(text) else _PART.findall(text.lower())
    return b"".join([*map(known.__getitem__, parts), _LAST])


def piece_lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """max_len as often as it fits, then the powers of two of the rest, largest first."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << k for k in range(max_len.bit_length() - 1, -1, -1) if rest >> k & 1]


PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long"


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids_crc32, bucket, sequence_id, offset and, if asked, ids.

    max_len must be a power of two.  A piece fills its sequence: offset is 0 and
    bucket (log2 of the length) names the batch it belongs to.  Null and empty texts
    give the end id alone.  Repeated rows are packed each for itself; a null doc_id
    stays null.  sequence_id is unique; it follows the order of partitions and rows.
    """
    if max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                cols: list[list] = [[] for _ in range(6 if with_ids else 5)]
                for doc_id, text in zip(part.column(0).to_pylist(), texts):
                    ids = memoryview(encode(text, known))
                    n = len(ids) // 4
                    start = 0
                    for length in piece_lengths(n, max_len):
                        piece = ids[4 * start : 4 * (start + length)]
                        row = (doc_id, start, length, n, zlib.crc32(piece))
                        for c, v in zip(cols, row):
                            c.append(v)
                        if with_ids:
                            cols[5].append(np.frombuffer(piece, "<i4"))
                        start += length
                arrays = [pa.array(c, pa.int64()) for c in cols[:5]]
                names = ["doc_id", "start", "length", "doc_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(cols[5], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    pieces = map_arrow(docs.select("doc_id", "text"), run, schema)
    return pieces.select(
        "*",
        F.log2(F.col("length").cast("double")).cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per bucket, so a reader draws batches of equal length."""
    pieces.write.partitionBy("bucket").parquet(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = pack(docs, default_tokenizer(), with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")
