"""Recovered contents against a fold over lists."""

import random

from loomspark.operators import recovery

DDL = "session_id string, source_ordinal long, timestamp string, path string, kind string, content string, old string, new string"


def by_hand(rows):
    out = {}
    for s, n, t, path, kind, content, old, new in sorted(rows, key=lambda r: (r[2] is not None, r[2] or "", r[0], r[1])):
        text, applied, missed = out.get(path, (None, 0, 0))
        if kind == "write" and content is not None:
            out[path] = (content, applied + 1, missed)
        elif kind == "edit" and text is not None and old and old in text:
            out[path] = (text.replace(old, new or "", 1), applied + 1, missed)
        else:
            out[path] = (text, applied, missed + 1)
    return out


def made_up(rng, n, paths):
    rows = []
    for i in range(n):
        kind = rng.choice(["write", "edit", "edit", "edit", "edit"])
        rows.append((f"s{rng.randint(0, 5)}", i, rng.choice([None, *[f"2024-01-0{d}" for d in range(1, 6)]]), rng.choice(paths), kind, rng.choice([None, "", "abcabc", "xyz"]) if kind == "write" else None, rng.choice([None, "", "a", "bc", "z", "Q"]), rng.choice([None, "", "a", "QQ"])))
    return rows


def test_against_lists(spark):
    for seed in range(2):
        rows = made_up(random.Random(seed), 3000, ["/hot"] * 6 + [f"/p{i}" for i in range(8)])
        got = {r.path: (r.content, r.applied, r.missed) for r in recovery.reconstruct(spark.createDataFrame(rows, DDL).repartition(7)).collect()}
        assert got == by_hand(rows)


def test_edges(spark):
    # no full write; a write of nothing; only edits of an empty file; no operations
    rows = [("s", 0, None, "/none", "edit", None, "a", "b"), ("s", 1, "1", "/null", "write", None, None, None), ("s", 2, "1", "/empty", "write", "", None, None), ("s", 3, "2", "/empty", "edit", None, "", "x")]
    got = {r.path: (r.content, r.applied, r.missed) for r in recovery.reconstruct(spark.createDataFrame(rows, DDL)).collect()}
    assert got == by_hand(rows) == {"/none": (None, 0, 1), "/null": (None, 0, 1), "/empty": ("", 1, 1)}
    assert recovery.reconstruct(spark.createDataFrame([], DDL)).collect() == []


def test_batches_carry_a_segment(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rows = [("s", 0, "0", "/f", "write", "a" * 50, None, None), *[("s", i, f"{i:03}", "/f", "edit", None, "a", "b") for i in range(1, 40)]]
        assert recovery.reconstruct(spark.createDataFrame(rows, DDL)).first()[1:] == ("b" * 39 + "a" * 11, 40, 0)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
