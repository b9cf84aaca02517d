"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Items become windows of ten words (an item of fewer is one window).  The distinct
windows are numbered word by word on the driver and broadcast: a vocabulary, and for
each length a sorted array of hashes beside the word numbers themselves.  Each task
turns the words of its documents into numbers (0: no word of any item), looks at the
places where a whole window of known words stands, finds their hashes in the set and
verifies every hit number by number.  Nothing is shuffled: a document is scanned where it is
read.  What is broadcast follows the benchmark, not the documents, and its size is
counted first: a benchmark of more than BLOCK pairs of window and item is dealt into blocks, each
broadcast for a scan of its own, and the hits of all scans, which are few, are joined.
A window held by many items is dealt over the blocks too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm.shared import LOWER, UPPER, fold_ascii, map_arrow, save

# Fixed values of the contract.
WINDOW = 10
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: (window, item) pairs and bytes of windows that one broadcast holds, about (a task keeps some 150 bytes a pair); more are dealt into blocks.
BLOCK = 500_000
BLOCK_BYTES = 64 << 20

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes as the words are cut: A-Z folded, whatever is no part of a word a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
HITS = "array<struct<first:int,last:int,start:int,end:int>>"
_HITS = pa.list_(pa.struct([(x, pa.int32()) for x in ("first", "last", "start", "end")]))
ADDED = ("n_words", "n_hit", "spans", "items")


def windows(benchmark: DataFrame) -> DataFrame:
    """(window, item): the distinct windows of each item, words joined by a space, and its item_id as a string.

    Items without words, or with a null item_id, have none.
    """
    words = F.regexp_extract_all(fold_ascii(F.col("text")), F.lit(WORD), F.lit(0))
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(1)))
    return items.select(F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, WINDOW), " "))).alias("window"), "item").distinct()


class NGrams:
    """A hash set of windows as arrays, with the numbers of their words for verification."""

    def __init__(self, rows: list[tuple[str, list[str]]]):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, list] = {}
        for window, items in rows:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in window.encode().split(b" ")]
            by_length.setdefault(len(ids), []).append((ids, items))
        self.sets = []
        for length, found in sorted(by_length.items()):
            ids = np.array([x for x, _ in found], np.int32)
            hashes = self.hashed(ids)
            order = np.argsort(hashes, kind="stable")
            self.sets.append((length, hashes[order], ids[order], [found[i][1] for i in order]))

    @staticmethod
    def hashed(ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.uint64)
        with np.errstate(over="ignore"):
            for column in ids.T:
                out = (out ^ column.astype(np.uint64)) * _FACTOR
                out ^= out >> np.uint64(29)
        return out

    def occurrences(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, list[list[str]]]]:
        """(places, length, numbers of the windows, items by number) of the windows that stand in the word numbers, some at a time."""
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for length, hashes, known, items in self.sets:
            if len(ids) < length:
                continue
            at = np.flatnonzero(unknown[length:] == unknown[:-length])
            asked = ids[at[:, None] + np.arange(length)]
            h = self.hashed(asked)
            left, right = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            while (live := np.flatnonzero(left < right)).size:  # windows of one hash lie side by side: each is held against the words
                live = live[(known[left[live]] == asked[live]).all(axis=1)]
                yield at[live], length, left[live], items
                left += 1


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the stretches of true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


def _hits(data: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    """Runs of hit words with their code points, from the first character of the first word to the end of the last."""
    places = [m.span() for m in _WORD.finditer(data.translate(_TABLE))]
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [{"first": a, "last": b, "start": int(chars[places[a][0]]), "end": int(chars[places[b][1]])} for a, b in runs]


def _scan(docs: DataFrame, rows: list[tuple[str, list[str]]]) -> DataFrame:
    """docs, which hold text, with n_words, hits and items as far as these windows go."""
    held = docs.sparkSession.sparkContext.broadcast(NGrams(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = held.value
        number = grams.vocabulary.get
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            counts, ids = [], []
            for data in texts:
                words = (data or b"").translate(_TABLE).split()
                counts.append(len(words))
                ids += [number(w, 0) for w in words]
                ids.append(0)  # no window goes on into the next document
            ids = np.array(ids, np.int32)
            starts = np.concatenate([[0], np.cumsum(np.array(counts, np.int64) + 1)])
            hit = np.zeros(len(ids), bool)
            items: dict[int, set[str]] = {}
            for places, length, windows_, held_by in grams.occurrences(ids):
                for j in range(length):
                    hit[places + j] = True
                of = np.searchsorted(starts, places, "right") - 1
                for i, w in np.unique(np.column_stack([of, windows_]), axis=0).tolist():
                    items.setdefault(i, set()).update(held_by[w])
            hits = [_hits(texts[i], _runs(hit[starts[i] : starts[i + 1] - 1])) if i in items else [] for i in range(len(texts))]
            found = [pa.array(counts, pa.int64()), pa.array(hits, _HITS), pa.array([sorted(items.get(i, ())) for i in range(len(texts))], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, "n_words", "hits", "items"])

    columns = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    return map_arrow(docs, run, f"{columns}n_words long, hits {HITS}, items array<string>")


def _joined(docs: DataFrame, scans: list[DataFrame]) -> DataFrame:
    """The same as one scan over all windows: hits that overlap or touch become one, items are united."""
    key = [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), F.length("text").alias("k3")]
    keys = ["k1", "k2", "k3"]
    found = scans[0]
    for more in scans[1:]:
        found = found.unionByName(more)
    place = Window.partitionBy(*keys).orderBy("first", "last")
    before = F.max("last").over(place.rowsBetween(Window.unboundedPreceding, -1))
    marks = found.select(*keys, F.inline("hits")).distinct().withColumn("new", F.coalesce(F.col("first") > before + 1, F.lit(True)))
    marks = marks.withColumn("run", F.count_if("new").over(place)).groupBy(*keys, "run").agg(*[f(c).alias(c) for c, f in (("first", F.min), ("last", F.max), ("start", F.min), ("end", F.max))])
    hits = marks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", "last", "start", "end"))).alias("hits"))
    items = found.select(*keys, F.explode("items").alias("item")).groupBy(*keys).agg(F.array_sort(F.collect_set("item")).alias("items"))
    n_words = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count(fold_ascii(F.col("text")), F.lit(WORD))).cast("long").alias("n_words")
    out = docs.select("*", *key, n_words).join(hits.join(items, keys), keys, "left")
    return out.withColumns({"hits": F.coalesce("hits", F.array().cast(HITS)), "items": F.coalesce("items", F.array().cast("array<string>"))}).drop(*keys)


def find_windows(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs with n_words, n_hit, spans (start and end of each run of hit words, in code points) and items (sorted ids).

    docs: text and any others, of which those named as the four are replaced.
    benchmark: item_id, text.  Null and empty texts have no words; repeated rows and
    null ids are rows like others; repeated item_ids are one item of several texts.  An
    empty benchmark hits nothing.
    """
    docs = docs.drop(*ADDED)
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select(*[F.struct(*[F.col(f"`{c}`") for c in others]).alias("others")] if others else [], "text")
    pairs = save(windows(benchmark.select("item_id", "text")), "windows")
    n, size = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("window")), F.lit(0))).first()
    blocks = max(1, -(-n // block), -(-size // BLOCK_BYTES))

    def rows(b: int) -> list[tuple[str, list[str]]]:
        mine = pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == b)
        return [(r["window"], r["items"]) for r in mine.groupBy("window").agg(F.collect_list("item").alias("items")).collect()]

    if blocks == 1:
        found = _scan(packed, rows(0))
    else:
        keyed = docs.select("text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), F.length("text").alias("k3")).where("text <> ''")
        scans = [save(_scan(keyed, rows(b)).where(F.size("items") > 0).drop("text", "n_words").dropDuplicates(["k1", "k2", "k3"]), "hits") for b in range(blocks)]
        found = _joined(packed, scans)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    named = {c: F.col("others").getField(c).alias(c) for c in others} | {"text": F.col("text")}
    return found.select(*[named[c] for c in docs.columns], "n_words", n_hit.alias("n_hit"), F.transform("hits", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("spans"), "items")


def remove(found: DataFrame, how: str = "spans") -> DataFrame:
    """Rows of find_windows() without the four columns: hit spans cut out of the text, or hit documents left out."""
    if how == "documents":
        return found.where("n_hit = 0").drop(*ADDED)
    if how != "spans":
        raise ValueError("how is spans or documents")
    from_ = lambda i: F.when(i > 0, F.get("spans", i - 1)["end"]).otherwise(0)
    to = lambda i: F.when(i < F.size("spans"), F.get("spans", i)["start"]).otherwise(F.char_length("text"))
    left = F.transform(F.sequence(F.lit(0), F.size("spans")), lambda i: F.substring("text", from_(i) + 1, to(i) - from_(i)))
    return found.withColumn("text", F.when(F.col("n_hit") > 0, F.array_join(left, "")).otherwise(F.col("text"))).drop(*ADDED)


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_windows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
ORACLE = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT item, unnest([array_to_string(w[p:p + {WINDOW - 1}], ' ') FOR p IN range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)]) AS gram, least(len(w), {WINDOW}) AS n FROM b WHERE len(w) > 0),
g AS (SELECT gram, n, list(DISTINCT item) AS items FROM i GROUP BY gram, n),
d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
n AS (SELECT DISTINCT n FROM g),
p AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d, n WHERE len(w) >= n),
h AS (SELECT p.r, p.p, p.n, g.items FROM p JOIN g ON g.n = p.n AND g.gram = array_to_string(p.w[p.p:p.p + p.n - 1], ' ')),
k AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS at FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE C) AS ids FROM (SELECT DISTINCT r, unnest(items) AS item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN k ON d.r = k.r LEFT JOIN t ON d.r = t.r
"""
