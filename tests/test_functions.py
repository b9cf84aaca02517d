import json

from loomspark import schema
from loomspark.functions import text as X
from loomspark.sources import cache
from loomspark.streaming import activity
from pyspark.sql import functions as F


def test_text(spark):
    df = spark.createDataFrame([("ééé", "12abc", "2024-05-01T10:00:00Z", '{"a": true}'), ("abc", "", "", "{}"), (None, None, None, None)], "t string, n string, d string, j string")
    got = df.select(X.cut_bytes(F.col("t"), 3).alias("cut"), X.as_number(F.col("n")).alias("n"), X.as_date(F.col("d")).cast("string").alias("d"), X.json_value(F.col("j"), "$.a").alias("j"), X.substr_zero(F.col("t"), 0, 2).alias("z"), X.truncation(F.col("t"), 3).alias("x")).collect()
    assert [(r.cut, r.d, r.j, r.z) for r in got] == [("é", "2024-05-01", "1", "é"), ("abc", None, None, "a"), (None, None, None, None)]
    assert [r.n for r in got[:2]] == [12.0, 0.0] and got[0].x.full_bytes == 6 and got[1].x.full_hash is None
    b = spark.createDataFrame([("git commit -m AB-12 > x.md",)], "c string").select(X.badges(F.col("c")).alias("b"), X.flags_sum(F.lit(True), F.lit(None).cast("boolean"), F.lit(True)).alias("n")).first()
    assert b.b == ["commit", "document", "ticket", "write"] and b.n == 2


def test_cache(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return schema.empty(spark)

    key = cache.cache_key(["b", "a"])
    assert key == cache.cache_key(["a", "b"]) != cache.cache_key(["a", "b"], {"x": 1})
    for _ in range(2):
        assert cache.cached_tables(spark, str(tmp_path), key, make)["turns"].count() == 0
    assert made == [1]
    inv = spark.createDataFrame([("p", "h", 3), ("q", "i", 4)], "path string, sha256 string, bytes long")
    r = cache.receipt("SELECT 1", inv, "ok", 1, {"rows": 10})
    assert r["bytes"] == 7 and r["inventory"] == cache.receipt("SELECT 2", inv.orderBy(F.desc("path")), "ok", 1, {})["inventory"] and json.dumps(r)
    found = spark.createDataFrame([("p", "/w/A", "2024"), ("q", "/w/a", "2025")], "path string, cwd string, started_at string")
    act = spark.createDataFrame([("p", "2024-02-01"), ("q", "2025-03-01")], "path string, last_time string").withColumn("last_time", F.to_timestamp("last_time"))
    assert [x.path for x in cache.discovered(found, act, cwd="/a", active_since="2025-01-01").collect()] == ["q"]


def test_streams_equal_batches(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{source}/events.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(source)
    for name, fn in (("visits", activity.visits), ("rates", activity.rates)):
        q = fn(stream).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        got = spark.table(name)
        want = fn(batch)
        assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count() and want.count() > 10
