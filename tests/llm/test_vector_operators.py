from collections import Counter

import numpy as np
from loomspark.llm import ann, embed_dedup
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows_of(rng, n=900, dim=16, centres=12):
    c = rng.normal(size=(centres, dim))
    v = c[rng.integers(centres, size=n)] + 0.35 * rng.normal(size=(n, dim))
    rows = [(i, [float(x) for x in np.float32(v[i])], int(i % 3)) for i in range(n)]
    near = np.float32(v[5])
    rows += [(n + i, [float(x) for x in np.float32(near + 0.02 * rng.normal(size=dim))], 2) for i in range(60)]
    rows += [(2000 + i, rows[7][1], 1) for i in range(80)]
    bad = [(3000, None, 1), (3020, [0.0] * dim, 1), (3040, [float("nan")] * dim, 1), (3060, [float("inf")] + [1.0] * (dim - 1), 1), (3080, [None] + [1.0] * (dim - 1), 1), (3100, rows[7][1], None), (None, rows[7][1], 1), (3120, [1.0, 2.0], 1), (3140, [2.0, 4.0], 1)]
    return rows + bad


def usable(e):
    return e is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)


def test_ann(spark):
    rows = rows_of(np.random.default_rng(4))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("bucket", F.lit("clash")).repartition(5)
    got = ann.search(df.select("vec_id", "embedding"), F.col("vec_id") % 20 == 0).collect()
    ok = [(i, np.array(e, np.float64)) for i, e, _ in rows if i is not None and usable(e)]
    asks = {i: v for i, v in ok if i % 20 == 0}
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(asks)
    hit = total = 0
    for q, v in asks.items():
        near = sorted(((-float(v @ w), i) for i, w in ok if i != q and len(w) == len(v)))[:20]
        res = sorted(by[q], key=lambda r: r.rank)
        assert [r.rank for r in res] == list(range(1, len(near) + 1))
        assert [(-r.score, r.vec_id) for r in res] == sorted((-r.score, r.vec_id) for r in res)
        exact = dict((i, -s) for s, i in sorted(((-float(v @ w), i) for i, w in ok if i != q and len(w) == len(v))))
        assert all(abs(exact[r.vec_id] - r.score) < 1e-9 for r in res)
        hit += len({i for _, i in near} & {r.vec_id for r in res})
        total += len(near)
    assert hit / total >= 0.9
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def test_ann_is_hashing_on_small_tables_too(spark, monkeypatch):
    """With few probes fitted, recall falls: no full scan makes up for the buckets.  Still each query has all its answers."""
    monkeypatch.setattr(ann, "FIT_RECALL", 0.3)
    v = np.float32(np.random.default_rng(11).normal(size=(3000, 16)))
    df = spark.createDataFrame([(i, [float(x) for x in e]) for i, e in enumerate(v)], "vec_id long, embedding array<float>")
    by = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        by.setdefault(r.query_id, set()).add(r.vec_id)
    assert len(by) == 150 and all(len(x) == 20 for x in by.values())
    score = v.astype(np.float64) @ v.T.astype(np.float64)
    np.fill_diagonal(score, -np.inf)
    hit = sum(len(by[q] & set(np.argsort(-score[q])[:20].tolist())) for q in by)
    assert 0.2 < hit / (20 * len(by)) < 0.9


def test_probe_order():
    sets = ann.probe_sets(4, 81)
    assert len(sets) == len(set(sets)) == 81 and sets[0] == () and sets[1] == (0,)
    assert all(7 - j not in s for s in sets for j in s)


def test_embedding_dedup(spark):
    rows = rows_of(np.random.default_rng(9))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rep", F.lit("clash")).repartition(4)
    got = embed_dedup.near_duplicates(df).collect()
    links, up = Counter(), {i: i for i, _, _ in rows}
    ok = [(i, np.array(e, np.float64), g) for i, e, g in rows if i is not None and g is not None and usable(e)]

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ok)):
        for b in range(a):
            (i, v, g), (j, w, h) = ok[a], ok[b]
            if g == h and len(v) == len(w) and v @ w >= 0.98 * np.sqrt((v @ v) * (w @ w)):
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    want = Counter((i, links[i] if i is not None else 0, None if i is None else find(i)) for i, _, _ in rows)
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embed_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_embedding_dedup_recall_at_the_threshold(spark):
    """Pairs barely above the cosine among vectors that are not near: the hardest to find."""
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    v = unit(rng.normal(size=(3000, 24)))
    u = rng.normal(size=(1000, 24))
    u = unit(u - np.sum(u * v[:1000], axis=1, keepdims=True) * v[:1000])
    near = 0.9802 * v[:1000] + np.sqrt(1 - 0.9802**2) * u
    rows = [(i, e.tolist(), 1) for i, e in enumerate(np.concatenate([v, near]))]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    ends = sum(r.n_links for r in got)
    assert 0.99 * 2000 <= ends <= 2000 and all(r.component_id == r.vec_id % 3000 or r.n_links == 0 for r in got)


def test_sample_is_the_same_and_bounded(spark):
    from loomspark.llm.vectors import keyed, sample

    df = spark.range(5000).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float") + 1, F.lit(1.0).cast("float")).alias("embedding"))
    rows = keyed(df)
    first = {r.vec_id for r in sample(rows, 100).collect()}
    assert len(first) == 100 and first == {r.vec_id for r in sample(rows.repartition(7), 100).collect()}
    assert sample(rows, 10_000).count() == 5000


def test_ann_bands_of_norms():
    """Lognormal lengths and one very long vector: the fit of the bands leaves most of the table out and still finds the neighbours."""
    rng = np.random.default_rng(0)
    c = rng.normal(size=(500, 64))
    u = (c / np.linalg.norm(c, axis=1, keepdims=True))[rng.integers(500, size=50_000)] + 0.05 * rng.normal(size=(50_000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    far = u.copy()
    far[7] *= 100
    for v in (u, u * np.exp(rng.normal(size=(len(u), 1))), far):
        norms = np.linalg.norm(v, axis=1)
        of = ann.bands(v, norms.max())
        tops = {int(b): float(norms[of == b].max()) for b in np.unique(of)}
        order = rng.permutation(len(v))
        fitted = ann.fit(v[order[: ann.FIT_ROWS]], len(v), norms.max(), tops)
        half = len(v) // ann.BOUND_SHARE // 2
        seen = np.concatenate([v[order[:half]], v[np.argsort(-norms)[:half]]])
        asks = rng.choice(len(v), 100, replace=False)
        q = v[asks]
        floor = np.partition(q @ seen.T, len(seen) - 21, axis=1)[:, len(seen) - 21]
        met = [set() for _ in asks]
        for b, h in enumerate(fitted):
            inside = np.flatnonzero(of == b)
            ask = np.flatnonzero(norms[asks] * h.norm >= floor)
            for t in range(ann.TABLES) if len(inside) and len(ask) else ():
                keys = h.keys(v[inside], t)
                by_key = np.argsort(keys, kind="stable")
                for a, probes in zip(ask, h.probes(q[ask], t)):
                    left, right = np.searchsorted(keys[by_key], probes, "left"), np.searchsorted(keys[by_key], probes, "right")
                    for x, y in zip(left, right):
                        met[a].update(inside[by_key[x:y]].tolist())
        score = q @ v.T
        score[np.arange(len(q)), asks] = -np.inf
        top = np.argpartition(-score, 20, axis=1)[:, :20]
        assert np.mean([len(met[i] & set(t.tolist())) / 20 for i, t in enumerate(top)]) >= 0.9
        assert np.mean([len(m) for m in met]) < 0.1 * len(v)


def test_ann_unequal_lengths_and_doubles(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(2000, 8)) * np.exp(rng.normal(size=(2000, 1)))
    v[40] *= 1e6
    df = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(v)] + [(60, v[61].tolist()), (60, v[60].tolist())], "vec_id long, embedding array<double>").repartition(3)
    by = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).where("query_id <> 60").collect():
        by.setdefault(r.query_id, {})[r.vec_id] = r.score
    score = v @ v.T
    np.fill_diagonal(score, -np.inf)
    assert len(by) == 99 and all(len(x) == 20 for x in by.values())
    assert np.mean([len(set(by[q]) & set(np.argsort(-score[q])[:20].tolist())) / 20 for q in by]) >= 0.9
    assert all(np.isclose(s, score[q, i], rtol=1e-14) for q, x in by.items() for i, s in x.items() if i not in (60, 61))
