import pytest
from loomspark import schema
from loomspark.operators import sequence as S
from loomspark.operators.relation import Database, Parameter, RelationError, bind
from loomspark.operators.sandbox import Sandbox, SandboxError, cell, masked, single_select, tagged
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def db(spark):
    s = spark.createDataFrame([("a", "one", 5), ("b", None, 7), ("c", "three", 7)], "session_id string, title string, n long")
    c = spark.createDataFrame([("a", 1), ("a", 2), ("c", 3)], "sid string, k long")
    return Database(spark, {"sessions": s, "calls": c})


def test_relation(db):
    r = db.table("Sessions").order_by(lambda x: [x.n.desc(), x.session_id]).where(lambda x: x.n.gte(5))
    out = r.count_of(db.table("calls"), {"session_id": "sid"}, "calls")
    assert [(x.session_id, x.calls) for x in out.build().collect()] == [("b", 0), ("c", 1), ("a", 2)]
    kept = r.select(lambda x: {"id": x.session_id, "m": x.n})
    assert [x.id for x in kept.build().collect()] == ["b", "c", "a"]
    with pytest.raises(RelationError, match="order needs"):
        r.select(lambda x: {"id": x.session_id})
    with pytest.raises(RelationError, match="can't be compared"):
        r.where(lambda x: x.title.eq(3))
    with pytest.raises(RelationError, match="isNull"):
        r.where(lambda x: x.title.eq(None))
    with pytest.raises(RelationError, match="boolean"):
        r.where(lambda x: x.n)
    with pytest.raises(RelationError, match="no column"):
        r.where(lambda x: x.other.is_null())
    assert r.where(lambda x: x.title.contains("e").and_(x.title.ne("three"))).build().count() == 1
    assert r.where(lambda x: x.title.is_null().not_().or_(x.n.eq(7))).build().count() == 3


def test_relation_owner_and_sql(spark, db):
    other = Database(spark, db.tables)
    e = []
    db.table("sessions").where(lambda x: e.append(x.n.gt(1)) or e[0])
    with pytest.raises(RelationError, match="two databases"):
        other.table("sessions").where(lambda x: e[0])
    r = db.sql("SELECT session_id, n FROM {sessions} WHERE n > ?", [5], {"session_id": "string", "n": "integer"})
    assert r.build().count() == 2
    with pytest.raises(RelationError, match="declared"):
        db.sql("SELECT n FROM {sessions}", [], {"n": "string"})
    assert {x.u for x in r.map_rows(lambda row: {"u": row["session_id"].upper()}, "u string").collect()} == {"B", "C"}
    assert r.use(lambda q: q.where(lambda x: x.n.eq(7)), ["n"]).build().count() == 2


def test_parameters():
    p = [Parameter("a", "integer", 3, 1, 5), Parameter("b", "string", "x")]
    assert bind(p, {"a": 4}) == {"a": 4, "b": "x"}
    for bad in ({"c": 1}, {"a": 9}, {"a": "x"}):
        with pytest.raises(RelationError):
            bind(p, bad)
    with pytest.raises(RelationError):
        bind([p[0], Parameter("a", "string", "q")], {})


def test_single_select():
    assert single_select("SELECT 1; ") == "SELECT 1"
    assert single_select("-- x\nWITH a AS (SELECT ';') SELECT * FROM a") .startswith("--")
    for bad in ("DELETE FROM x", "SELECT 1; SELECT 2", "INSERT INTO t SELECT 1", "", "/* SELECT */ DROP TABLE x"):
        with pytest.raises(SandboxError):
            single_select(bad)
    assert len(masked("SELECT 'a;b' -- c")) == len("SELECT 'a;b' -- c")
    assert tagged(["SELECT * FROM t WHERE a = ", ""], [1]) == ("SELECT * FROM t WHERE a = ?", [1])
    assert cell("é" * 3, 5) == ("éé", 6)


def test_sandbox(spark, db):
    box = Sandbox(spark, db.tables, rows=2, cell_bytes=4)
    r = box.query("SELECT session_id, title FROM sessions ORDER BY 1")
    assert r.count == 2 and r.rows_truncated and not r.complete and r.error is None
    r = box.query("WITH q AS (SELECT title FROM sessions WHERE n = ? AND title IS NOT NULL) SELECT * FROM q", [7])
    assert r.rows == [{"title": "thre"}] and r.cell_diagnostics[0]["bytes"] == 5
    assert box.query("SELECT title FROM sessions WHERE title = 'three'", strict=True).rows == []
    for bad in ("SELECT * FROM nothing", "DROP VIEW sessions", "SELECT * FROM parquet.`/tmp/x`", "SELECT bad FROM sessions", "SELECT (SELECT max(x) FROM hidden) FROM sessions"):
        r = box.query(bad)
        assert r.error and r.rows == [] and r.columns == [] and not r.complete


def test_sandbox_bypasses(spark, db):
    spark.createDataFrame([(1,)], "k int").createOrReplaceTempView("hiddentab")
    box = Sandbox(spark, db.tables)
    box.spark.sql("CREATE OR REPLACE TEMPORARY VIEW hiddentab AS SELECT 1 AS k")
    for bad in (
        "WITH hiddentab AS (SELECT * FROM hiddentab) SELECT * FROM hiddentab",
        "WITH q AS (WITH hiddentab AS (SELECT 1) SELECT * FROM hiddentab) SELECT * FROM hiddentab",
        "SELECT (WITH hiddentab AS (SELECT 1 AS k) SELECT max(k) FROM hiddentab) FROM hiddentab",
        "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a",
        "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT * FROM r",
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home')",
        "SELECT title FROM sessions WHERE try_reflect('java.lang.System', 'getProperty', 'user.home') IS NOT NULL",
        "SELECT * FROM range(3)",
        "SELECT * FROM sessions, LATERAL explode(array(1, 2))",
        "SELECT * FROM IDENTIFIER('hiddentab')",
        "SELECT input_file_name() FROM sessions",
        "SELECT TRANSFORM(title) USING 'cat' FROM sessions",
        "SELECT * FROM json.`/etc/passwd`",
        "SELECT * FROM (TABLE hiddentab)",
        "SELECT title FROM sessions WHERE EXISTS (SELECT 1 FROM hiddentab)",
        "SELECT title FROM sessions UNION SELECT k FROM hiddentab",
    ):
        r = box.query(bad)
        assert r.error and r.rows == [], bad
    for good in (
        "WITH s AS (SELECT n, title FROM sessions), t AS (SELECT n FROM s) SELECT max(n) AS n FROM t JOIN s USING (n)",
        "SELECT n, row_number() OVER (ORDER BY n) AS r FROM sessions GROUP BY n HAVING count(*) > 0 ORDER BY n LIMIT 2",
        "SELECT transform(array(1, 2), x -> x + 1) AS a, CASE WHEN n > 5 THEN upper(title) END AS u FROM sessions WHERE n IN (SELECT k FROM calls) OR EXISTS (SELECT 1 FROM calls)",
        "SELECT a.title FROM sessions a LEFT JOIN calls c ON a.session_id = c.sid UNION ALL SELECT 'x' ORDER BY 1",
        "SELECT * FROM VALUES (1, 'a') AS v(k, s)",
    ):
        assert box.query(good).error is None, (good, box.query(good).error)


def test_sequence(spark):
    t = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 1, 2, 2, 2, 1])], "k string, i long, v long")
    assert [r.run for r in S.number_runs(t, "k", "i", ["v"]).orderBy("i").collect()] == [1, 1, 2, 2, 2, 3]
    assert [r.block for r in S.number_blocks(t, "k", "i", F.col("v") == 2).orderBy("i").collect()] == [0, 0, 1, 2, 3, 3]
    assert t.groupBy("k").agg(S.upper_median("v").alias("m")).first().m == 2
    ts = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:05:00"), ("a", "2024-01-01 00:10:01"), ("b", "2024-01-01 00:00:00")], "k string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r.k: r.active_seconds for r in S.active_seconds(ts, "k", "ts").collect()} == {"a": 300.0, "b": None}
    right = spark.createDataFrame([("a", 0, "x"), ("a", 3, "y")], "k string, j long, w string")
    assert [r.w for r in S.as_of(t, right, "k", "i", "j", ["w"]).orderBy("i").collect()] == ["x", "x", "x", "y", "y", "y"]
    assert {(r.v_a, r.v_b, r.n) for r in S.pairs_within(t, "k", "v").collect()} == {(1, 2, 1)}


def test_empty_tables(spark):
    from loomspark.plans.catalog import CATALOG
    from loomspark.plans.verbs import VERBS

    tables = schema.empty(spark)
    for key in [k for k in CATALOG.by_key if k.startswith("pre_")]:
        assert CATALOG.get(key).run(spark, tables).count() == 0
    for key in ("vrb_01", "vrb_06", "met_09"):
        assert VERBS[key][0](tables).count() == 0


def test_catalog(spark):
    from loomspark.plans.catalog import CATALOG

    assert CATALOG.get("cmd_04").path == "timing/timing-analysis"
    assert CATALOG.get("tool-pair-matrix").key == "shw_06"
    with pytest.raises(KeyError):
        CATALOG.get("session-list")
    with pytest.raises(ValueError):
        CATALOG.get("cmd_01").bind(nothing=1)
    assert "'o''x'" in CATALOG.get("cmd_01").oracle(title_like="o'x")
