import hashlib
from collections import defaultdict
from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest
from loomspark.llm import vector_codes as V
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, entries, rounds=4):
    """Exact k-means by whole scans over Python integers: sorted (vec_id, code, error, label_error), digest."""
    kept = [(i, e, g) for i, e, g in rows if e is not None and all(x is not None and isfinite(x) for x in e)]
    ints = [[floor(Fraction(x) * 1024) for x in e] for _, e, _ in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))
    w = len(ints[0]) // 4
    cut = [[v[p * w : p * w + w] for p in range(4)] for v in ints]
    books = [[cut[r][p] for r in order[:entries]] for p in range(4)]

    def assigned(r, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut[r][p], c)), i) for i, c in enumerate(books[p]))

    for _ in range(rounds):
        near = [[assigned(r, p)[1] for p in range(4)] for r in range(len(cut))]
        for p in range(4):
            for i in range(len(books[p])):
                mine = [cut[r][p] for r in range(len(cut)) if near[r][p] == i]
                if mine:
                    books[p][i] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [[assigned(r, p) for p in range(4)] for r in range(len(cut))]
    errors = [sum(d for d, _ in x) for x in last]
    of_label = defaultdict(int)
    for (_, _, g), e in zip(kept, errors):
        of_label[g] += e
    fits = lambda n: n if n < 2**63 else None
    big = {g for (_, _, g), e in zip(kept, errors) if e >= 2**63}
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, "".join(f"{a:02x}" for _, a in x), fits(e), None if g in big else fits(of_label[g])) for (i, _, g), x, e in zip(kept, last, errors)), key=repr), digest


def result(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).withColumn("code", F.lit("clash")).withColumn("x", F.lit("clash")).repartition(4)
    got = V.compress(df).collect()
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr), {r.codebooks_sha256 for r in got}, got


def made(rng, n, dim=8, spread=0.2):
    centres = rng.normal(size=(9, dim))
    return [(i * 3 % 1000, (centres[i % 9] + spread * rng.normal(size=dim)).tolist(), i % 4 or None) for i in range(n)]


BAD = [(5, None, 1), (6, [None] * 8, 1), (7, [float("nan")] * 8, 1), (0, [float("-inf")] + [0.0] * 7, 2)]


@pytest.mark.parametrize("scale", [1, 3e4, 3e7, 1e30, 1e304])
def test_against_whole_scans(spark, monkeypatch, scale):
    """Machine numbers, 64-bit integers and integers of any size give the result of whole scans."""
    monkeypatch.setattr(V, "ENTRIES", 24)
    monkeypatch.setattr(V, "GROUP", 4)
    rows = [(i, [x * scale for x in e], g) for i, e, g in made(np.random.default_rng(2), 400)]
    rows += [(None, rows[3][1], 3), *rows[:40], *BAD]
    want, digest = brute(rows, 24)
    got, digests, _ = result(spark, rows)
    assert got == want and digests == {digest}


def test_arithmetic_by_size():
    assert [V.arithmetic(x, 16) for x in (10.0, 1e5, 1e8, 1e300)] == [float, int, object, object]


def test_ties_and_unused_entries(spark, monkeypatch):
    """Vectors on a coarse grid: many equal distances, equal entries of which the later ones stay unused."""
    monkeypatch.setattr(V, "ENTRIES", 40)
    monkeypatch.setattr(V, "GROUP", 3)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-2, 3, size=8) / 512).tolist(), 1) for i in range(500)]
    want, digest = brute(rows, 40)
    got, digests, _ = result(spark, rows)
    assert got == want and digests == {digest}


def test_bounds_save_distances(spark):
    """Full codebooks on clustered vectors: the last round computes a part of all distances; results are those of whole scans."""
    rows = [(i, e, g) for i, (_, e, g) in enumerate(made(np.random.default_rng(4), 1500, spread=0.05))]
    got, digests, all_ = result(spark, rows)
    want, digest = brute(rows, 256)
    assert got == want and digests == {digest}
    assert sum(r.seen for r in all_) < 0.5 * 4 * 256 * len(rows)


def test_odd_tables(spark):
    assert V.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    assert V.compress(spark.createDataFrame(BAD, SCHEMA)).count() == 0
    # one row; floats; lengths that don't fit
    one, digests, _ = result(spark, [(9, [0.5] * 4, None)], "vec_id long, embedding array<float>, label int")
    assert one == [(9, "00000000", 0, 0)] and digests == {hashlib.sha256(b"512,512,512,512").hexdigest()}
    got, _, _ = result(spark, [(1, [1.0] * 4, 1), (2, [1.0] * 4, 1), (3, [1.0] * 8, 1), (4, [1.0] * 3, 2), (5, [], 2)])
    assert got == [(1, "00000000", 0, 0), (2, "00000000", 0, 0), (3, None, None, 0), (4, None, None, None), (5, None, None, None)]
    got, digests, _ = result(spark, [(1, [1.0] * 3, 1)])
    assert got == [(1, None, None, None)]
    got, digests, _ = result(spark, [(1, [], 1), (2, [], 1)])
    assert got == [(1, "00000000", 0, 0), (2, "00000000", 0, 0)]
