"""Approximate nearest neighbours by multiprobe p-stable hashing.

The index has several tables; a table's bucket is the tuple of floor((a.v + b) / w)
for a few Gaussian projections.  A query visits, in every table, its own bucket and
perturbed ones in the order of estimated success (the smaller the squared distances
to the crossed cell borders, the earlier), the candidates of all tables are merged,
and inner products in double precision on the original vectors rank them.  A query
that has found too few goes on: to all perturbed buckets of its shape, then to cells
that are wider at each further round, again in the order of success.

Largest inner product is turned into smallest distance by one more component,
sqrt(M^2 - |v|^2) for stored vectors and 0 for queries, which are scaled to M.  Vectors
are put into bands of similar norm, each with tables, a width and an M of its own, so
a few long vectors don't blur the others.  By Cauchy-Schwarz no vector of a band
has more than |q| M with a query; bands below what the query has already seen are left out.

Exact copies are one entry of the index; the answer is expanded to their smallest
ids, so a vector of a third of all rows costs one entry.  Buckets are cut into
blocks of bounded size for points and for queries; no bucket is capped.
"""

from __future__ import annotations

import copy
import heapq
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm.shared import map_arrow, map_groups, save
from loomspark.llm.vectors import keyed, matrix, sample

K = 20
SEED = 20240613
#: Vectors on which width and number of probes are fitted (driver; bounded), and how many of them ask.
FIT_ROWS = 4096
FIT_QUERIES = 256
FIT_RECALL = 0.96
#: Vectors that every query is compared with first, half of them the longest: its k-th best there is a bound below which nothing is passed on (8 MB at 64 components).
BOUND_ROWS = 16384
#: One in so many vectors at most is among them, so that on small tables too the bound lies far below the answer and recall is the hashing's.
BOUND_SHARE = 16
#: Cells grow by this factor at each further round of the queries that found too few.
WIDER = 4.0
TABLES = 4
#: Norms in a band differ by this factor at most; the last of so many bands takes all that are shorter.
BAND = 1.4
BANDS = 24
#: (projections a table, cell width in standard deviations, most probes a table), finest first.
SHAPES = ((10, 2.0, 80), (8, 1.8, 80), (6, 1.6, 80), (4, 1.4, 81), (3, 1.6, 27))
#: Points and queries of a bucket that meet in one call.
BLOCK = 1024
#: Bucket counts up to this many rows are broadcast; more are joined by shuffle.
BROADCAST_BUCKETS = 50_000


def probe_sets(m: int, limit: int) -> list[tuple[int, ...]]:
    """Perturbations as sets of ranks among the 2m border distances, by expected score (Lv et al. 2007)."""
    low = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    high = [1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, 2 * m + 1)]
    z = low + high
    out: list[tuple[int, ...]] = [()]
    heap = [(z[0], (0,))]
    while heap and len(out) < limit:
        score, s = heapq.heappop(heap)
        if all(2 * m - 1 - j not in s for j in s):  # not both borders of one cell
            out.append(s)
        j = s[-1] + 1
        if j < 2 * m:
            heapq.heappush(heap, (score - z[j - 1] + z[j], (*s[:-1], j)))
            heapq.heappush(heap, (score + z[j], (*s, j)))
    return out


class Hashes:
    """The projections of all tables; the same on every machine."""

    def __init__(self, dim: int, m: int, width: float, probes: int, norm: float):
        rng = np.random.default_rng(SEED)
        self.norm, self.m = norm, m
        self.a = rng.normal(size=(TABLES, dim + 1, m)) / (width * norm)
        self.b = rng.uniform(size=(TABLES, m))
        self.mult = rng.integers(1, 1 << 62, size=m, dtype=np.int64) * 2 + 1
        self.sets = np.zeros((probes, 2 * m))
        sets = probe_sets(m, probes)
        self.sets = self.sets[: len(sets)]
        for i, s in enumerate(sets):
            self.sets[i, list(s)] = 1
        self.every = self.sets

    def further(self, round_: int) -> Hashes:
        """The hashes of a round: 0 the fitted probes, 1 all probes of the shape, from 2 on wider cells."""
        if round_ == 0:
            return self
        h = copy.copy(self)
        h.sets, h.a = self.every, self.a / WIDER ** (round_ - 1)
        return h

    def cells(self, v: np.ndarray, t: int, query: bool) -> np.ndarray:
        size = np.sum(v * v, axis=1)
        if query:
            v, last = v * (self.norm / np.sqrt(np.maximum(size, np.finfo(float).tiny)))[:, None], np.zeros(len(v))
        else:
            last = np.sqrt(np.maximum(self.norm**2 - size, 0))
        return np.column_stack([v, last]) @ self.a[t] + self.b[t]

    def keys(self, v: np.ndarray, t: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.floor(self.cells(v, t, False)).astype(np.int64) @ self.mult

    def probes(self, v: np.ndarray, t: int) -> np.ndarray:
        """Bucket keys in the order of estimated success: queries x probes."""
        at = self.cells(v, t, True)
        base = np.floor(at)
        f = at - base
        border = np.concatenate([f, 1 - f], axis=1)
        step = np.concatenate([-self.mult, self.mult])
        order = np.argsort(border, axis=1, kind="stable")
        with np.errstate(over="ignore"):
            own = base.astype(np.int64) @ self.mult
            return own[:, None] + step[order] @ self.sets.astype(np.int64).T


def bands(v: np.ndarray, longest: float) -> np.ndarray:
    """The band of each vector: 0 holds norms from longest down to longest / BAND, and so on."""
    norms = np.sqrt(np.sum(v * v, axis=1))
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(np.log(longest / norms) / np.log(BAND) + 1e-9), 0, BANDS - 1).astype(np.int64)


def fit(vectors: np.ndarray, n: int, longest: float, tops: dict[int, float], k: int = K) -> list[Hashes]:
    """For each band (tops: the longest norm in those that hold any) the finest shape whose probes reach FIT_RECALL on the sample.

    Among s of n vectors the nearest k * s / n stand for the k nearest of all, so a
    larger table, whose neighbours lie closer, gets finer buckets.  A band that holds
    next to none of them is fitted to the nearest inside it.
    """
    of = bands(vectors, longest)
    q = vectors[:FIT_QUERIES]
    near = min(max(1, round(k * len(vectors) / max(n, 1))), max(1, len(vectors) - 1))
    score = q @ vectors.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    top = np.argpartition(-score, near - 1, axis=1)[:, :near]
    found = [(np.repeat(np.arange(len(q)), near)[at], top.ravel()[at]) for at in (np.flatnonzero(of[top.ravel()] == b) for b in range(BANDS))]
    out = []
    for b in range(BANDS):
        asks, hits = found[b]
        inside = np.flatnonzero(of == b)
        if len(asks) < FIT_QUERIES // 8 and len(inside):
            own = score[:, inside]
            asks = np.arange(len(q))
            hits = inside[own.argmax(axis=1)]
            asks, hits = asks[asks != hits], hits[asks != hits]
        out.append(_fitted(vectors, q, asks, hits, tops.get(b, longest / BAND**b)))
    return out


def _fitted(vectors: np.ndarray, q: np.ndarray, asks: np.ndarray, hits: np.ndarray, norm: float) -> Hashes:
    """The finest shape whose probes find the pairs (query, vector); without pairs the coarsest, as the band is nearly empty."""
    for m, width, most in SHAPES if len(asks) else SHAPES[-1:]:
        h = Hashes(vectors.shape[1], m, width, most, norm)
        if not len(asks):
            return h
        # first probe that finds each pair, over the tables
        first = np.full(len(asks), np.iinfo(np.int64).max)
        for t in range(TABLES):
            hit = h.keys(vectors[hits], t)[:, None] == h.probes(q, t)[asks]
            first = np.where(hit.any(axis=1), np.minimum(first, hit.argmax(axis=1)), first)
        found = np.sort(first)
        need = found[min(len(found) - 1, int(np.ceil(FIT_RECALL * len(found))) - 1)]
        if need < len(h.sets) or (m, width, most) == SHAPES[-1]:
            h.sets = h.sets[: min(len(h.sets), int(need) + 1 + int(need) // 8)]
            return h
    raise AssertionError


def _met(placed: DataFrame, k: int) -> DataFrame:
    """(q, rep, score): the best k + 1 in every block that a query visits.  placed: t, bucket, rep, embedding, floor (null for points)."""
    counts = placed.groupBy("t", "bucket").agg(F.count_if(F.col("floor").isNull()).alias("np"), F.count("floor").alias("nq")).where("np > 0 and nq > 0")
    counts = save(counts.select("t", "bucket", F.ceil(F.col("np") / BLOCK).cast("int").alias("pb"), F.ceil(F.col("nq") / BLOCK).cast("int").alias("qb")), "buckets")
    hint = F.broadcast if counts.count() <= BROADCAST_BUCKETS else (lambda d: d)
    tiles = placed.join(hint(counts), ["t", "bucket"])
    salt = F.pmod(F.xxhash64("rep"), F.lit(1 << 30))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    is_point = F.col("floor").isNull()
    tiles = tiles.withColumn("pblk", F.explode(F.when(is_point, F.array((salt % F.col("pb")).cast("int"))).otherwise(upto("pb"))))
    tiles = tiles.withColumn("qblk", F.explode(F.when(is_point, upto("qb")).otherwise(F.array((salt % F.col("qb")).cast("int")))))
    tiles = tiles.select("t", "bucket", "pblk", "qblk", "rep", "embedding", "floor")

    def meet(key, table: pa.Table) -> pa.Table | None:
        floor = table.column("floor").to_numpy()
        v = matrix(table.column("embedding"))
        rep = table.column("rep").to_numpy()
        p, q = np.isnan(floor), ~np.isnan(floor)
        if not p.any() or not q.any():
            return None
        score = v[q] @ v[p].T
        ids, asks, low = rep[p], rep[q], floor[q]
        if score.shape[1] > k + 1:
            at = score.shape[1] - k - 1
            low = np.maximum(low, np.partition(score, at, axis=1)[:, at])
        i, j = np.nonzero(score >= low[:, None])
        return pa.table({"q": asks[i], "rep": ids[j], "score": score[i, j]})

    return map_groups(tiles, ["t", "bucket", "pblk", "qblk"], meet, "q long, rep long, score double")


def _best(met: DataFrame, k: int) -> DataFrame:
    """(q, rep, score): the best k + 1 of each query by score and id."""
    best = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    return met.groupBy("q", "rep").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")


def _listed(top: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(q, near): the nearest rows of each query by score and id, copies included."""
    rows = top.select("q", "rep", "score").join(members, "rep").select("q", F.explode("ids").alias("vec_id"), "score")
    near = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id")))
    return rows.groupBy("q").agg(F.slice(near, 1, 4 * (k + 1)).alias("near"))


def search(rows: DataFrame, is_query, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query holds, the k nearest other rows found.

    rows: vec_id, embedding.  Ties go to the smaller vec_id.  Null, zero and
    non-finite vectors take no part, neither do rows with a null vec_id; vectors of
    different lengths never meet.  Every query has k answers, or all there are.  Rows
    that repeat a vec_id with its vector are one candidate; with other vectors they are
    candidates each for itself, but none is an answer to its own id.
    """
    spark = rows.sparkSession
    kind = "float" if rows.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    all_rows = save(keyed(rows.where("vec_id is not null")).withColumn("ask", F.coalesce(is_query, F.lit(False))), "vectors")
    distinct = save(all_rows.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("rep"), F.max("ask").alias("ask"), F.count_distinct("vec_id").alias("copies")), "distinct")
    shapes = {r["d"]: (r["n"], r["m"], r["rows"]) for r in distinct.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("rows"), F.max(F.aggregate("embedding", F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("m")).collect()}
    fitted = {}
    picked: dict[int, list] = {}
    for e in sample(distinct, BOUND_ROWS).select(F.col("embedding").cast("array<double>").alias("e")).toArrow().column("e").to_pylist():
        picked.setdefault(len(e), []).append(e)
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double")))
    longest = {d: float(np.sqrt(m)) or 1.0 for d, (_, m, _) in shapes.items()}
    top = F.coalesce(*[F.when(F.size("embedding") == d, F.lit(m)) for d, m in longest.items()], F.lit(1.0))
    band = F.greatest(F.lit(0), F.least(F.lit(BANDS - 1), F.floor(F.log(top / size) / float(np.log(BAND)) + 1e-9))).cast("int")
    # the longest norm of each band that holds any
    tops: dict[int, dict[int, float]] = {}
    for r in distinct.groupBy(F.size("embedding").alias("d"), band.alias("b")).agg(F.max(size).alias("m")).collect():
        tops.setdefault(r["d"], {})[r["b"]] = r["m"] * (1 + 1e-12)
    for d, vs in picked.items():
        v = np.array(vs, dtype=np.float64)
        n = shapes[d][0]
        most = max(1, min(BOUND_ROWS, n // BOUND_SHARE))
        long = distinct.where(F.size("embedding") == d).orderBy(size.desc(), "h1", "h2").limit(most // 2).select(F.col("embedding").cast("array<double>").alias("e")).toArrow().column("e").to_pylist()
        seen = np.unique(np.concatenate([v[: most - len(long)], np.array(long, dtype=np.float64).reshape(-1, v.shape[1])]), axis=0)
        fitted[d] = (fit(v[:FIT_ROWS], n, longest[d], tops[d], k), longest[d], seen)
    held = spark.sparkContext.broadcast(fitted)
    def lowest(v: np.ndarray, seen: np.ndarray, norm: float) -> np.ndarray:
        """For each query a score that its k-th nearest reaches, -inf if too few are known."""
        at = len(seen) - 1 - k  # the query itself may be among them
        if at <= 0:
            return np.full(len(v), -np.inf)
        parts = [np.partition(v[i : i + 512] @ seen.T, at, axis=1)[:, at] for i in range(0, len(v), 512)]
        # a product can differ in its last bits from one call to the next
        return np.concatenate(parts) - 1e-12 * norm**2 if parts else np.zeros(0)

    def bucket(batches, round_):
        names = ["t", "bucket", "rep", "embedding", "floor"]
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(1)]) if batch.num_rows else np.zeros(0, int)
            for d in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == d)))
                by_band, far, seen = held.value[int(d)]
                v = matrix(pa.chunked_array([part.column(1)]))
                reps, vectors, of = part.column(0), part.column(1), part.column(3).to_numpy()
                asked = np.flatnonzero(part.column(2).to_numpy(zero_copy_only=False).astype(bool))
                floor = lowest(v[asked], seen, far)
                reach = np.sqrt(np.sum(v[asked] ** 2, axis=1))
                for b, fitted_band in enumerate(by_band):
                    h = fitted_band.further(round_)
                    stored = np.flatnonzero(of == b)
                    ask = np.flatnonzero(reach * h.norm * (1 + 1e-9) >= floor)
                    for t in range(TABLES):
                        table = (b * TABLES + t) * 1_000_000 + d
                        if len(stored):
                            at = pa.array(stored)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(stored), table, np.int64)), pa.array(h.keys(v[stored], t)), reps.take(at), vectors.take(at), pa.nulls(len(stored), pa.float64())], names)
                        for i in range(0, len(ask), 64) if b in tops[int(d)] else ():
                            now = ask[i : i + 64]
                            keys = h.probes(v[asked[now]], t)
                            at = pa.array(np.repeat(asked[now], keys.shape[1]))
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(keys.size, table, np.int64)), pa.array(keys.ravel()), reps.take(at), vectors.take(at), pa.array(np.repeat(floor[now], keys.shape[1]))], names)

    def met(points: DataFrame, round_: int) -> DataFrame:
        placed = map_arrow(points.select("rep", F.col("embedding").cast(f"array<{kind}>"), "ask", band.alias("band")), lambda batches: bucket(batches, round_), f"t long, bucket long, rep long, embedding array<{kind}>, floor double")
        return _met(placed, k)

    best = save(_best(met(distinct, 0), k), "best")
    # queries that found too few go on, among the vectors of their length, until none is left: in the end a cell holds all
    total = F.coalesce(*[F.when(F.size("embedding") == d, rows_) for d, (_, _, rows_) in shapes.items()], F.lit(0))
    for round_ in count(1):
        found = best.join(distinct.select("rep", "copies"), "rep").groupBy("q").agg(F.sum("copies").alias("found"))
        short = distinct.where("ask").join(found, F.col("rep") == F.col("q"), "left").where(F.coalesce("found", F.lit(0)) < F.least(F.lit(k + 1), total))
        short = save(short.select("rep", F.size("embedding").alias("d")), "short")
        lengths = [r["d"] for r in short.select("d").distinct().collect()]
        if not lengths:
            break
        asking = short.select("rep", F.lit(True).alias("ask"))
        points = distinct.where(F.size("embedding").isin(lengths)).drop("ask").join(asking, "rep", "left").withColumn("ask", F.coalesce("ask", F.lit(False)))
        best = save(_best(best.unionByName(met(points, round_)), k), "best")
    # the smallest ids of each class of copies are all that can be among the k nearest
    ids = all_rows.join(distinct.select("h1", "h2", "rep"), ["h1", "h2"]).select("rep", "vec_id", "ask").distinct()
    by_id = Window.partitionBy("rep").orderBy("vec_id")
    members = ids.select("rep", "vec_id").withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1).groupBy("rep").agg(F.collect_list("vec_id").alias("ids"))
    lists = save(_listed(best, members, k), "lists")
    asked = ids.where("ask").select(F.col("rep").alias("q"), F.col("vec_id").alias("query_id"))
    own = asked.join(lists, "q").withColumn("near", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k))
    out = own.select("query_id", F.posexplode("near").alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, F.col("vec_id") % 20 == 0)
