"""Row scopes, counts that depend on an enclosing row, and declared sources."""

import pytest
from loomspark.operators.relation import Database, RelationError, lift

ROWS = [("a", 1, 5), ("a", 2, None), ("b", 3, 7), (None, 4, 1)]


@pytest.fixture(scope="module")
def db(spark):
    calls = spark.createDataFrame([("a", 10), ("a", 11), ("c", 12), (None, 13)], "sid string, k long")
    return Database(spark, {"tools": spark.createDataFrame(ROWS, "session_id string, id long, n long"), "calls": calls})


def peers(rows, keep):
    return [sum(1 for u in rows if keep(u, t)) for t in rows]


def test_a_relation_counts_itself(db):
    source = "SELECT 'a' AS session_id, 1L AS id UNION ALL SELECT 'a', 2 UNION ALL SELECT 'b', 3"
    tools = db.sql(source, columns={"session_id": "string", "id": "integer"})
    counts = tools.select(lambda t: {"id": t.id, "peers": tools.where(lambda u: u.session_id.eq(t.session_id)).count()}).order_by(lambda r: r.id.asc())
    assert [r.peers for r in counts.build().collect()] == [2, 2, 1]


def test_counts_against_loops(db):
    tools, calls = db.table("tools"), db.table("calls")
    out = tools.select(lambda t: {
        "id": t.id,
        "same": tools.where(lambda u: u.session_id.eq(t.session_id)).count(),
        "before": tools.where(lambda u: u.session_id.eq(t.session_id).and_(u.id.lt(t.id))).count(),
        "less": tools.where(lambda u: u.id.lt(t.id)).count(),
        "calls": calls.where(lambda c: c.sid.eq(t.session_id)).count(),
        "all": calls.count(),
    })
    got = out.order_by(lambda r: r.id).build().collect()
    assert [r.same for r in got] == peers(ROWS, lambda u, t: u[0] is not None and u[0] == t[0])
    assert [r.before for r in got] == peers(ROWS, lambda u, t: u[0] is not None and u[0] == t[0] and u[1] < t[1])
    assert [r.less for r in got] == peers(ROWS, lambda u, t: u[1] < t[1])
    assert [r.calls for r in got] == [2, 2, 0, 0] and {r["all"] for r in got} == {4}


def test_counts_filter_and_order(db):
    tools, calls = db.table("tools"), db.table("calls")
    busy = tools.where(lambda t: calls.where(lambda c: c.sid.eq(t.session_id)).count().gt(1))
    assert sorted(r.id for r in busy.build().collect()) == [1, 2]
    ordered = tools.select(lambda t: {"id": t.id, "n": calls.where(lambda c: c.sid.eq(t.session_id)).count()}).order_by(lambda r: [r.n.desc(), r.id.desc()])
    assert [r.id for r in ordered.build().collect()] == [2, 1, 4, 3]
    mixed = tools.order_by(lambda t: [calls.count().asc(), t.id.desc()])
    assert [r.id for r in mixed.build().collect()] == [4, 3, 2, 1] and mixed.build().columns == ["session_id", "id", "n"]
    # the order is kept by expression, through filters and a select that renames
    kept = tools.order_by(lambda t: [t.session_id.is_null().asc(), t.id.desc()]).where(lambda t: t.id.gt(1)).select(lambda t: {"none": t.session_id.is_null(), "i": t.id})
    assert [r.i for r in kept.build().collect()] == [3, 2, 4]


def test_plan_is_one_join_by_key(db):
    tools = db.table("tools")
    plan = tools.select(lambda t: {"id": t.id, "n": tools.where(lambda u: u.session_id.eq(t.session_id)).count()}).explain()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Join" in plan


def test_columns_stay_in_their_callbacks(db):
    tools, held = db.table("tools"), []
    tools.where(lambda t: held.append(t.id) or t.id.gt(0))
    with pytest.raises(RelationError, match="outside its callback"):
        tools.where(lambda t: held[0].gt(1))
    with pytest.raises(RelationError, match="further in"):
        tools.select(lambda t: {"n": tools.where(lambda u: tools.where(lambda v: v.id.eq(t.id)).count().gt(0)).count()})
    deep = lift(True)
    with pytest.raises(RelationError, match="nested"):
        for _ in range(40):
            deep = deep.not_()


def test_declared_values(spark, db):
    n = 200_000
    db = Database(spark, {"src": spark.range(n).selectExpr("id", "IF(id = 199999, NULL, id) AS gap", "IF(id = 199999, double('NaN'), 1.5D) AS x", "id % 2 AS bit", "id % 3 AS trit")})
    good = db.sql("SELECT id, gap, bit FROM {src}", columns={"id": "number", "gap": "integer?", "bit": "boolean"})
    assert dict(good.fields) == {"id": "number", "gap": "integer", "bit": "boolean"}
    assert good.where(lambda r: r.bit).build().count() == n // 2
    for column, kind in (("gap", "integer"), ("x", "number"), ("trit", "boolean")):
        r = db.sql(f"SELECT id, {column} FROM {{src}}", columns={"id": "integer", column: kind})
        # the bad value lies in a row and a column that the query drops
        with pytest.raises(Exception, match=f"column {column} is declared {kind}"):
            r.where(lambda q: q.id.lt(3)).select(lambda q: {"id": q.id}).build().collect()
    one = db.sql("SELECT id, x FROM {src}", columns={"id": "integer", "x": "number?"}).where(lambda q: q.id.lt(3)).build()
    assert one._jdf.queryExecution().executedPlan().toString().count("Range (") == 1  # no second scan
    for wrong in ({"id": "string"}, {"ID": "integer"}, {"id": "text"}, {"id": "integer", "x": "number"}):
        with pytest.raises(RelationError):
            db.sql("SELECT id FROM {src}", columns=wrong)
    nothing = db.sql("SELECT CAST(NULL AS STRING) AS s, NULL AS v FROM {src} WHERE id < 0", columns={"s": "string", "v": "integer?"})
    assert nothing.build().collect() == []


def test_declared_sources_count_themselves(db):
    t = db.sql("SELECT session_id, id FROM {tools} WHERE session_id IS NOT NULL", columns={"session_id": "string", "id": "integer"})
    out = t.select(lambda a: {"id": a.id, "n": t.where(lambda b: b.session_id.eq(a.session_id)).count()}).order_by(lambda r: r.id)
    assert [r.n for r in out.build().collect()] == [2, 2, 1]
    with pytest.raises(RelationError, match="1 MiB"):
        db.sql("SELECT 1 -- " + "x" * (1 << 20))
