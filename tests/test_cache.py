import threading
import time

import pytest
from loomspark.sources.archives import SourceSet, inventory
from loomspark.sources.cache import TableCache, cache_key, fingerprint
from pyspark.sql import functions as F


def tables(spark, n, calls=None):
    def make():
        if calls is not None:
            calls.append(n)
        return {"t": spark.range(n).select("id", F.repeat(F.sha2(F.col("id").cast("string"), 256), F.lit(4)).alias("x"))}

    return make


def test_changed_sources_are_never_served_stale(spark, tmp_path):
    cache, calls = TableCache(spark, str(tmp_path / "cache")), []
    file = tmp_path / "a.json"

    def load():
        src = SourceSet().files([str(file)]).read(spark)
        key = cache_key([r.sha256 for r in inventory(src).collect()])
        with cache.get(key, lambda: calls.append(1) or {"t": src.select("content")}) as t:
            return t["t"].first().content

    for text, made in (("one", 1), ("one", 1), ("two", 2), ("one", 2)):
        file.write_text(text)
        assert load() == text and len(calls) == made


def test_budget_and_leases(spark, tmp_path):
    size = TableCache(spark, str(tmp_path / "one"))
    size.get("k", tables(spark, 2000)).release()
    each = size.held()["k"]["bytes"]
    cache, calls = TableCache(spark, str(tmp_path / "cache"), budget=int(2.5 * each)), []
    for k in ("a", "b"):
        cache.get(k, tables(spark, 2000, calls)).release()
        time.sleep(0.02)
    cache.get("a", tables(spark, 2000, calls)).release()  # b is now the one used least lately
    time.sleep(0.02)
    cache.get("c", tables(spark, 2000, calls)).release()
    assert set(cache.held()) == {"a", "c"} and len(calls) == 3 and sum(e["bytes"] for e in cache.held().values()) <= cache.budget
    left = {p.name for p in (tmp_path / "cache").iterdir()}
    assert left == {"commits", *(e["folder"] for e in cache.held().values())}
    # leased entries stay over the budget until they are released; another process sees the same entries
    lease = cache.get("a", tables(spark, 2000, calls))
    others = [cache.get(k, tables(spark, 2000, calls)) for k in ("d", "e")]
    assert {"a", "d", "e"} <= set(cache.held()) and lease.tables["t"].count() == 2000
    [x.release() for x in (lease, lease, *others)]
    assert len(cache.held()) == 2 and TableCache(spark, str(tmp_path / "cache")).held() == cache.held()


def test_tiers(spark, tmp_path):
    cache, calls = TableCache(spark, str(tmp_path / "cache")), []
    one, two = (cache.get("k", tables(spark, 5, calls), "memory") for _ in range(2))
    assert one.tables["t"] is two.tables["t"] and one.tables["t"].is_cached and len(calls) == 1 and cache.held() == {}
    assert cache.get("k", tables(spark, 5, calls)).tables["t"] is one.tables["t"]
    held = one.tables["t"]
    one.release()
    two.release()
    assert held.is_cached
    cache._done("k")
    assert not held.is_cached and cache.memory == {}
    assert cache.get("k", tables(spark, 5, calls), "none").tables["t"].count() == 5 and len(calls) == 2 and cache.held() == {}
    with pytest.raises(ValueError):
        cache.get("k", tables(spark, 5), "tape")


def test_two_writers_of_a_key_keep_one_copy(spark, tmp_path):
    caches, got = [TableCache(spark, str(tmp_path)) for _ in range(4)], []
    threads = [threading.Thread(target=lambda c=c: got.append(c.get("k", tables(spark, 50)).tables["t"].count())) for c in caches]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert got == [50] * 4 and len(caches[0].held()) == 1 and len([p for p in tmp_path.iterdir() if p.name != "commits"]) == 1


def test_fingerprint_and_projection_follow_the_files(spark, tmp_path):
    from loomspark.plans.projection import project

    src = "/root/testdata/sf0.001"
    for name in ("events", "conversations", "labels", "documents", "benchmark"):
        spark.read.parquet(f"{src}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    before = fingerprint(spark, str(tmp_path))
    t = project(spark, str(tmp_path))
    n = t["annotations"].count()
    assert fingerprint(spark, str(tmp_path)) == before and project(spark, str(tmp_path)) is t
    spark.read.parquet(f"{src}/labels.parquet").limit(3).write.mode("append").parquet(str(tmp_path / "labels.parquet"))
    again = project(spark, str(tmp_path))
    assert fingerprint(spark, str(tmp_path)) != before and again is not t and again["annotations"].count() == n + 3
