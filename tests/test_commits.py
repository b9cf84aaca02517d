import threading

import pytest
from loomspark.operators.sandbox import Sandbox, SandboxError
from loomspark.sources.annotations import AnnotationStore
from loomspark.sources.commits import CommitLog
from pyspark.sql import functions as F

ROW = "annotation_id string, session_id string, category string, title string"


def notes(spark, *rows):
    return spark.createDataFrame(list(rows), ROW)


@pytest.mark.parametrize("hadoop", [False, True])
def test_a_number_is_put_once(spark, tmp_path, hadoop):
    log, other = CommitLog(spark, f"file://{tmp_path}/log"), CommitLog(spark, f"file://{tmp_path}/log")
    if hadoop:
        log.local = other.local = None
    assert log.entries() == []
    assert log.commit(lambda there: {"by": "a", "saw": len(there)}) == 1
    assert not other.put(1, {"by": "b"}) and other.put(2, {"by": "b"})
    # the third is taken while a commit prepares: it looks again and takes the fourth
    seen = []

    def build(there):
        seen.append([n for n, _ in there])
        if len(seen) == 1:
            other.put(3, {"by": "b"})
        return {"by": "a", "saw": len(there)}

    assert log.commit(build) == 4 and seen == [[1, 2], [1, 2, 3]]
    assert [(n, e["by"]) for n, e in other.entries()] == [(1, "a"), (2, "b"), (3, "b"), (4, "a")]
    with pytest.raises(KeyError):
        log.commit(lambda there: there[99] if len(there) > 99 else {}["no"])
    assert len(log.entries()) == 4


def test_many_writers_of_one_log(spark, tmp_path):
    def write(who):
        for i in range(10):
            CommitLog(spark, str(tmp_path)).commit(lambda there: {"who": who, "i": i, "after": there[-1][0] if there else 0})  # noqa: B023

    threads = [threading.Thread(target=write, args=(w,)) for w in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    entries = CommitLog(spark, str(tmp_path)).entries()
    assert [n for n, _ in entries] == list(range(1, 61)) and all(e["after"] == n - 1 for n, e in entries)
    assert {(e["who"], e["i"]) for _, e in entries} == {(w, i) for w in range(6) for i in range(10)}


def test_two_writers_of_annotations(spark, tmp_path, monkeypatch):
    """The one that comes second checks again: an id is not added twice, other changes go through, no serial is shared."""
    one, two = AnnotationStore(spark, str(tmp_path)), AnnotationStore(spark, str(tmp_path))
    one.add(notes(spark, ("a", "s1", "risk", "first")))
    put, raced = one.commits.put, []

    def late(n, entry):
        if not raced:
            raced.append(n)
            two.add(notes(spark, ("b", "s2", "risk", "of two")))
        return put(n, entry)

    monkeypatch.setattr(one.commits, "put", late)
    with pytest.raises(ValueError, match="b"):
        one.add(notes(spark, ("b", "s1", "risk", "of one")))
    raced.clear()
    two_adds = two.add
    monkeypatch.setattr(two, "add", lambda rows: two_adds(notes(spark, ("c", "s3", "risk", "of two"))))
    one.add(notes(spark, ("d", "s1", "risk", "of one")))
    assert {(r.annotation_id, r.title) for r in one.current().collect()} == {("a", "first"), ("b", "of two"), ("c", "of two"), ("d", "of one")}
    serials = [r.serial for r in one._log().collect()]
    assert sorted(serials) == [1, 2, 3, 4] and {r.changes for r in one.unsynced().collect()} == {1, 2}
    # deleted meanwhile: a patch of it fails instead of bringing it back
    raced.clear()
    monkeypatch.setattr(two, "add", lambda rows: two.delete(notes(spark, ("a", "", "", ""))))
    with pytest.raises(KeyError):
        one.patch(notes(spark, ("a", "s1", "risk", "late")))
    assert "a" not in {r.annotation_id for r in two.current().collect()}


def test_second_namespace_is_live(spark, tmp_path):
    store = AnnotationStore(spark, str(tmp_path))
    store.add(notes(spark, ("a", "s1", "risk", "one")))
    own = spark.createDataFrame([("s1", "archived"), ("s2", "other")], "session_id string, title string")
    box = Sandbox(spark, {"sessions": own, "annotations": own, "anno.annotations": store.current})
    count = "SELECT count(*) AS n FROM anno.annotations"
    assert box.query(count).rows == [{"n": 1}]
    store.add(notes(spark, ("b", "s2", "risk", "two")))
    assert box.query(count).rows == [{"n": 2}]
    store.delete(notes(spark, ("a", "", "", "")))
    joined = "SELECT s.title AS t, anno.annotations.title AS n FROM sessions s JOIN anno.annotations ON s.session_id = annotations.session_id ORDER BY 1"
    assert box.query(joined).rows == [{"t": "other", "n": "two"}]
    for sql, rows in {
        "SELECT a.title FROM ANNO.Annotations AS a": [{"title": "two"}],
        "SELECT anno.annotations.title AS t FROM `anno`.`annotations` WHERE anno.annotations.category = 'risk' AND 'anno.annotations' <> ''": [{"t": "two"}],
        "WITH annotations AS (SELECT 'cte' AS title) SELECT x.title AS a, y.title AS b FROM annotations x, anno.annotations y": [{"a": "cte", "b": "two"}],
        "SELECT (SELECT max(title) FROM anno.annotations) AS m, count(*) AS n FROM annotations": [{"m": "two", "n": 2}],
        "SELECT count(*) AS n FROM (SELECT anno.annotations.* FROM anno.annotations) WHERE title = 'two'": [{"n": 1}],
    }.items():
        got = box.query(sql)
        assert got.rows == rows, (sql, got.error)
    for sql in ("SELECT * FROM other.annotations", "SELECT * FROM anno.sessions", "SELECT * FROM anno__annotations", "SELECT * FROM global_temp.x", "SELECT * FROM a.anno.annotations"):
        with pytest.raises(SandboxError):
            box.plan(sql)
    only = Sandbox(spark, {"anno.annotations": store.current})
    with pytest.raises(SandboxError):
        only.plan("SELECT * FROM annotations")
    assert only.query("SELECT title FROM anno.annotations").rows == [{"title": "two"}]
    assert box.plan("SELECT F.title FROM anno.annotations F").where(F.col("title") == "two").count() == 1
