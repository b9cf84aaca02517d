"""Vector code compression: product codes from exact integer k-means with Yinyang bounds.

Vectors become integers and are cut into parts; each part position has a codebook.  A round
assigns every part to its nearest entry and moves entries to the floored means of
their parts.  Entries are put into groups once.  For every part and group a lower
bound of the distance to the group's entries, other than the assigned one, is kept
with the row from round to round; what the group's entries have moved is taken off,
and only groups whose bound doesn't exceed the distance of the best entry so far are
scanned.  Bounds are rounded down and only exclude; every comparison that chooses an
entry is made on exact integers, and ties go to the lower index.

A round is one pass over the table of the round before, which lies in the shared
folder.  Sums leave a task as one row per part and entry, Spark adds them up, and the
codebooks (4 x 256 entries, whatever the number of rows) go through the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.shared import delete, map_arrow, map_groups, save

# Fixed values of the contract.
PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024

#: Entries a group holds on average: 16 groups of a full codebook, whose bounds take 256 bytes a vector.
GROUP = 16
#: Sums of labels up to this many rows are broadcast; more are joined by shuffle.
BROADCAST_LABELS = 50_000
_UP = 1 + 1e-9  # more than double precision can be off
_DOWN = np.float32(1 - 2.0**-21)  # more than single precision can be off


def integers(col: pa.Array, exact: type) -> np.ndarray:
    """floor(1024 x) of a list column whose rows have one length; exact: float and int for machine numbers, object for any size."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if exact is object:
        flat = np.array([math.floor(SCALE * x) if abs(x) < 2.0**53 else SCALE * int(x) for x in flat.tolist()] + [None], object)[:-1]
    else:
        flat = np.floor(SCALE * flat)
    return flat.reshape(len(col), -1).astype(exact)


def arithmetic(largest: float, width: int) -> type:
    """float if products of parts of such integers are exact in double precision, int if they fit 64 bits, else object."""
    most = 16.0 * max(1, width) * (SCALE * largest + 1) * (SCALE * largest + 1)
    return float if most < 2.0**52 else int if most < 2.0**62 else object


class Codebooks:
    """Entries of all part positions as exact numbers, their groups, and how far groups have moved since the last round."""

    def __init__(self, entries: list[np.ndarray], groups: list[np.ndarray], drift: list[np.ndarray]):
        self.entries, self.groups, self.drift = entries, groups, drift
        self.members = [[np.flatnonzero(g == i) for i in range(len(d))] for g, d in zip(groups, drift)]

    @classmethod
    def start(cls, vectors: np.ndarray) -> Codebooks:
        entries = np.split(vectors, PARTS, axis=1)
        groups = [grouped(e) for e in entries]
        return cls(entries, groups, [np.zeros(int(g.max()) + 1) for g in groups])

    def moved(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebooks:
        """The next round's codebooks from (part, entry): (count, sums); entries without parts stay."""
        fresh = [e.copy() for e in self.entries]
        for (p, i), (n, total) in sums.items():
            for j, s in enumerate(total):
                fresh[p][i, j] = s // n
        drift = []
        for old, new, members in zip(self.entries, fresh, self.members):
            step = np.array([_float_root(sum((int(a) - int(b)) ** 2 for a, b in zip(x, y))) for x, y in zip(old, new)])
            drift.append(np.array([step[m].max() * _UP for m in members]))
        return Codebooks(fresh, self.groups, drift)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for e in self.entries for row in e for x in row).encode()).hexdigest()


def grouped(entries: np.ndarray) -> np.ndarray:
    """A group for each entry, by a few rounds of k-means over entries; groups steer the work, never the result."""
    scale = max(1, np.abs(entries).max(initial=0))
    x = (entries / scale).astype(np.float64)
    k = max(1, len(x) // GROUP)
    centres = x[:: max(1, len(x) // k)][:k]
    for _ in range(5):
        near = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        centres = np.array([x[near == i].mean(0) if (near == i).any() else c for i, c in enumerate(centres)])
    return np.unique(near, return_inverse=True)[1]


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries."""
    if x.dtype == np.float64:
        return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)[None]
    return np.stack([((x - e) ** 2).sum(1) for e in entries], axis=1)


def _float_root(n: int) -> float:
    """Square root of an integer of any size; beyond double precision's range, its end."""
    return math.sqrt(n) if n < 1 << 1000 else float(min(math.isqrt(n), 10**308))


def _root(d: np.ndarray) -> np.ndarray:
    return np.array([_float_root(v) for v in d.tolist()]) if d.dtype == object else np.sqrt(d.astype(np.float64))


def nearest(x: np.ndarray, books: Codebooks, p: int, near: np.ndarray | None, bounds: np.ndarray | None):
    """(nearest entry, exact squared distance, bounds, distances computed) for the rows of part p."""
    entries, members = books.entries[p], books.members[p]
    n, of = len(x), books.groups[p]
    if near is None:
        near, bounds = np.zeros(n, np.int64), np.zeros((n, len(members)))
    else:
        bounds = np.maximum(bounds.astype(np.float64) - books.drift[p], 0)
    before = near
    own = ((x - entries[near]) ** 2).sum(1)
    near, best, seen = near.copy(), own.copy(), np.full(n, 1)
    first, second = np.full((n, len(members)), np.inf), np.full((n, len(members)), np.inf)
    scanned = np.zeros((n, len(members)), bool)
    for g, m in enumerate(members):
        rows = np.flatnonzero(bounds[:, g] <= _root(best) * _UP)
        if not len(rows):
            continue
        d = squared(x[rows], entries[m])
        at = d.argmin(1)  # the lowest index of a tie
        least = d[np.arange(len(rows)), at]
        scanned[rows, g], seen[rows] = True, seen[rows] + len(m)
        first[rows, g] = _root(least)
        if len(m) > 1:
            d = d.copy()
            d[np.arange(len(rows)), at] = d.max()
            second[rows, g] = _root(np.maximum(d.min(1), least))
        better = (least < best[rows]) | ((least == best[rows]) & (m[at] < near[rows]))
        near[rows[better]], best[rows[better]] = m[at[better]], least[better]
    # a scanned group's bound is its nearest entry but the assigned one; the entry left is under its group's bound from now on
    new = np.where(scanned, first, bounds)
    every = np.arange(n)
    in_own = scanned[every, of[near]]
    new[every[in_own], of[near[in_own]]] = second[every[in_own], of[near[in_own]]]
    left = near != before
    new[every[left], of[before[left]]] = np.minimum(new[every[left], of[before[left]]], _root(own[left]))
    return near, best, new, seen


def _assign(state: DataFrame, books: Codebooks, exact: type, started: bool, last: bool) -> DataFrame:
    """A round's assignment of all rows: vec_id, label, x, codes, bounds, seen; after the last round vec_id, label, code, error, seen."""
    spark = state.sparkSession
    held = spark.sparkContext.broadcast(books)
    width = "double" if exact is object else "int"
    label = state.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels, col = batch.column(0), batch.column(1), batch.column(2)
            if started and exact is not object:
                x = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1).astype(exact)
            else:
                x = integers(col, exact)
            codes = bounds = None
            if started:
                codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(x), PARTS).astype(np.int64)
                bounds = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.float32).reshape(len(x), -1)
            near, error, lower, seen, at = [], 0, [], 0, 0
            for p, part in enumerate(np.split(x, PARTS, axis=1)):
                groups = len(books.members[p])
                a, d, low, s = nearest(part, books, p, codes[:, p] if started else None, bounds[:, at : at + groups] if started else None)
                near.append(a.astype(np.uint8))
                lower.append(np.minimum(low, 3e38).astype(np.float32) * _DOWN)
                error, seen, at = error + d, seen + s, at + groups
            near = np.column_stack(near)
            if last:
                error = [int(e) if e < 2**63 else None for e in error.tolist()]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([r.tobytes().hex() for r in near]), pa.array(error, pa.int64()), pa.array(seen, pa.int64())], ["vec_id", "label", "code", "error", "seen"])
                continue
            kept = col
            if not started and exact is not object:
                kept = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel().astype(np.int32)))
            lower = np.concatenate(lower, axis=1)
            yield pa.RecordBatch.from_arrays([ids, labels, kept, pa.array([r.tobytes() for r in near]), pa.array([r.tobytes() for r in lower]), pa.array(seen, pa.int64())], ["vec_id", "label", "x", "codes", "bounds", "seen"])

    out = f"vec_id long, label {label}, code string, error long, seen long" if last else f"vec_id long, label {label}, x array<{width}>, codes binary, bounds binary, seen long"
    return map_arrow(state, run, out)


def _sums(state: DataFrame, exact: type, books: Codebooks, long_sums: bool) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry): (count, sums of its parts); at most one row a part and entry comes from each task, and of all together."""
    sizes = [len(e) for e in books.entries]
    width = books.entries[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[[0] * width for _ in range(k)] for k in sizes]
        counts = [np.zeros(k, np.int64) for k in sizes]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = integers(batch.column(0), object) if exact is object else batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.int64)
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(x), PARTS)
            for p, part in enumerate(np.split(x, PARTS, axis=1)):
                order = np.argsort(codes[:, p], kind="stable")
                which, at = np.unique(codes[order, p], return_index=True)
                for i, s, n in zip(which.tolist(), np.add.reduceat(part[order], at, axis=0).tolist() if width else [[]] * len(which), np.diff([*at, len(x)]).tolist()):
                    counts[p][i] += n
                    total[p][i] = [a + b for a, b in zip(total[p][i], s)]
        rows = [(p, i, int(counts[p][i]), [v if long_sums else str(v) for v in total[p][i]]) for p, k in enumerate(sizes) for i in range(k) if counts[p][i]]
        kind = pa.list_(pa.int64() if long_sums else pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int64(), kind))], ["part", "entry", "n", "sums"])

    partial = map_arrow(state.select("x", "codes"), run, f"part int, entry int, n long, sums array<{'long' if long_sums else 'string'}>")
    if long_sums:
        added = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(j))) for j in range(width)]).alias("sums"))
    else:

        def add(key, table: pa.Table) -> pa.Table:
            rows = table.column("sums").to_pylist()
            return pa.table({"part": [key[0]], "entry": [key[1]], "n": [sum(table.column("n").to_pylist())], "sums": [[str(sum(map(int, c))) for c in zip(*rows)]]})

        added = map_groups(partial, ["part", "entry"], add, "part int, entry int, n long, sums array<string>")
    return {(r["part"], r["entry"]): (r["n"], [int(s) for s in r["sums"]]) for r in added.collect()}


def compress(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 and seen (distances computed in the last round), one row for each kept row.

    rows: vec_id, embedding, label.  Rows whose vector is null or holds null or
    non-finite components are dropped.  The codebooks fit vectors of one length, that
    of most rows (the shorter of a tie) among the multiples of 4; rows of other lengths
    stay with null code and error.  Codebooks start from the rows of the 256 smallest
    vec_ids, rows of one vec_id by their components, null ids last; fewer rows make
    smaller codebooks.  Repeated rows count each for itself.  An error beyond 64 bits is
    null, and so is a label_error with such a part.  No rows, no result.
    """
    spark = rows.sparkSession
    finite = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").where(finite)
    largest = F.max(F.aggregate("embedding", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double")))))
    of_length = kept.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"), largest.alias("largest"))
    most = of_length.where(f"d % {PARTS} = 0").orderBy(F.desc("n"), "d").first()
    if most is None:
        out = kept.select("vec_id", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("long").alias("label_error"), F.lit(hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"), F.lit(None).cast("long").alias("seen"))
        return out
    exact = arithmetic(most["largest"], most["d"] // PARTS)
    long_sums = exact is not object and most["n"] * (SCALE * most["largest"] + 1) < 2.0**62
    fitting = kept.where(F.size("embedding") == most["d"])
    first = fitting.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select(F.col("embedding").cast("array<double>").alias("e")).toArrow().column("e").combine_chunks()
    books = Codebooks.start(integers(first, exact))
    state = fitting.select("vec_id", "label", "embedding")
    for i in range(rounds):
        fresh = save(_assign(state, books, exact, i > 0, False), "codes")
        if i:
            delete(state)
        state = fresh
        books = books.moved(_sums(state, exact, books, long_sums))
    coded = save(_assign(state, books, exact, rounds > 0, True), "coded")
    if rounds:
        delete(state)
    others = kept.where(F.size("embedding") != most["d"]).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("long").alias("seen"))
    coded = coded.unionByName(others)
    whole = F.when(F.count_if(F.col("error").isNull() & F.col("code").isNotNull()) == 0, F.try_sum("error")).alias("label_error")
    labels = save(coded.groupBy(F.col("label").alias("of")).agg(whole), "labels")
    hint = F.broadcast if labels.count() <= BROADCAST_LABELS else (lambda d: d)
    out = coded.join(hint(labels), F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"), "seen")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")).drop("seen")


def _oracle() -> str:
    near = (
        "a{i} AS MATERIALIZED (SELECT r, part, arg_min(entry, d * 1000 + entry) AS entry, min(d) AS d FROM (SELECT r, p.part, entry, "
        "CAST(list_sum([(x[j] - c[j]) * (x[j] - c[j]) FOR j IN range(1, len(x) + 1)]) AS BIGINT) AS d FROM p JOIN c{i} USING (part)) GROUP BY r, part)"
    )
    move = (
        "s{i} AS (SELECT part, entry, j, CAST(sum(x[j]) AS BIGINT) AS s, count(*) AS n FROM a{i} JOIN p USING (r, part), range(1, 1000000) AS t(j) WHERE j <= len(x) GROUP BY part, entry, j),\n"
        "m{i} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM s{i} GROUP BY part, entry),\n"
        "c{j} AS MATERIALIZED (SELECT part, entry, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (part, entry))"
    )
    move = move.replace("range(1, 1000000)", "(SELECT unnest(range(1, max(len(x)) + 1)) FROM p)")
    steps = ",\n".join(near.format(i=i) + (",\n" + move.format(i=i, j=i + 1) if i < ROUNDS else "") for i in range(ROUNDS + 1))
    return f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v, row_number() OVER (ORDER BY vec_id) AS r
    FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS MATERIALIZED (SELECT r, part, v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] AS x FROM k, range({PARTS}) AS t(part)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= {ENTRIES}),
{steps},
f AS (SELECT r, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM c{ROUNDS}) AS codebooks_sha256
FROM k JOIN f USING (r)
"""


ORACLE = _oracle()
