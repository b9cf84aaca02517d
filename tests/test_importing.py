import json

import pytest
from loomspark import schema
from loomspark.operators import metrics
from loomspark.sources import chat_transcripts, claude_code, importing
from loomspark.sources.annotations import AnnotationStore
from loomspark.sources.archives import SourceError, SourceSet
from pyspark.sql import functions as F


def source(spark, **texts):
    return spark.createDataFrame([(k, v) for k, v in texts.items()], "path string, content string")


def test_load(spark, tmp_path):
    native = json.dumps({"id": "n1", "schema_version": "1", "turns": [], "tool_calls": []})
    pi = "\n".join(json.dumps(r) for r in ({"type": "session", "id": "p1", "cwd": "/w"}, {"type": "message", "message": {"role": "user", "content": "hi"}}))
    df = source(spark, native=native, pi=pi, bad="{not json\n" + pi, odd='{"a": 1}', empty=" \n")
    tables, told = importing.load(df)
    assert {r.session_id for r in tables["sessions"].collect()} == {"n1", "p1"}
    assert {(r.path, r.message) for r in told.collect()} == {("bad", "line 1: not a JSON object"), ("odd", "no known format"), ("empty", "no records")}
    with pytest.raises(SourceError):
        importing.load(df, strict=True)
    only, told = importing.load(source(spark, native=native, pi=pi), auto_convert=False)
    assert only["sessions"].count() == 1 and [r.path for r in told.collect()] == ["pi"]


def test_receipt_and_saved_import(spark, tmp_path):
    df = source(spark, a="x", b="y")
    tables = schema.empty(spark) | {"sessions": spark.createDataFrame([("s1",)], "session_id string")}
    tables = {n: tables[n] for n in ("sessions", "turns", "tool_calls")}
    told = spark.createDataFrame([("b", "error", "no known format")], "path string, level string, message string")
    receipt = importing.conversion_receipt(df, tables, told)
    assert receipt["status"] == "partial" and receipt["outputs"] == {"sessions": 1, "turns": 0, "tool_calls": 0} and receipt["inputs"]["files"] == 2 and receipt["failures"] == 1
    assert receipt["inputs"] == importing.conversion_receipt(df.repartition(3), {}, told)["inputs"]
    path = importing.save_import(tables, str(tmp_path), "one")
    assert spark.read.parquet(f"{path}/sessions").count() == 1
    with pytest.raises(ValueError):
        importing.save_import(tables, str(tmp_path), "../x")
    importing.emit(tables["sessions"], str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["session_id"]


def test_runtime_archives_and_query_files(spark, tmp_path):
    spark.conf.unset(importing.ARCHIVES)
    with pytest.raises(SourceError):
        importing.runtime_archives(spark)
    (tmp_path / "a.jsonl").write_text("{}\n")
    spark.conf.set(importing.ARCHIVES, f" {tmp_path}/*.jsonl ")
    assert importing.runtime_archives(spark) == SourceSet().files([str(tmp_path / "a.jsonl")])
    for root, text in (("one", "SELECT 1"), ("two", "SELECT 2")):
        (tmp_path / root / "x").mkdir(parents=True)
        (tmp_path / root / "x" / "q.sql").write_text(text)
    (tmp_path / "two" / "r.sql").write_text("SELECT 3")
    found = importing.query_files([str(tmp_path / "one"), str(tmp_path / "two")])
    assert {k: v[0].rpartition("/")[2] for k, v in found.items()} == {"x/q": "one", "r": "two"}


def test_annotation_store(spark, tmp_path):
    store = AnnotationStore(spark, str(tmp_path / "notes"))
    row = lambda *r: spark.createDataFrame([r], "annotation_id string, session_id string, scope_type string, category string, annotator string, title string, minitrace_taxonomy_json string")
    assert store.current().count() == 0 and store.unsynced().count() == 0
    store.add(row("a1", "s1", "session", "risk", "me", "one", '["F1"]').unionByName(row("a2", "s2", "turn", "success", "you", "two", None)))
    with pytest.raises(ValueError):
        store.add(row("a1", "s1", "session", "risk", "me", "again", None))
    store.patch(spark.createDataFrame([("a1", "better")], "annotation_id string, title string"))
    assert [(r.annotation_id, r.title, r.category) for r in store.list(category="risk").collect()] == [("a1", "better", "risk")]
    assert store.list(taxonomy="f1").count() == 1 and store.list(annotator="you", session="s2", scope="turn").count() == 1 and store.list(limit=1).count() == 1 and store.list(offset=1).count() == 1
    assert {(r.session_id, r.changes) for r in store.unsynced().collect()} == {("s1", 2), ("s2", 1)}
    store.mark_synced(spark.createDataFrame([("s1",)], "session_id string"))
    assert {r.session_id for r in store.unsynced().collect()} == {"s2"}
    store.delete(spark.createDataFrame([("a1",)], "annotation_id string"))
    assert [r.annotation_id for r in store.list().collect()] == ["a2"] and {(r.session_id, r.changes) for r in store.unsynced().collect()} == {("s1", 1), ("s2", 1)}
    with pytest.raises(KeyError):
        store.delete(spark.createDataFrame([("a1",)], "annotation_id string"))


def test_claude_code(spark, tmp_path):
    records = [{"type": "user", "message": {"content": "hi"}}, {"type": "user", "message": {"content": [{"type": "tool_result"}]}}, {"type": "user", "message": {"content": "<command-name>x"}}, {"type": "user", "message": {"content": "<available-deferred-tools>"}}, {"type": "assistant"}, {"type": "system"}, {"type": "summary"}]
    lines = spark.createDataFrame([("p", i, json.dumps(r)) for i, r in enumerate(records)], "path string, line_no long, value string")
    got = [(r.source, r.input_channel) for r in claude_code.classified(lines).orderBy("line_no").collect()]
    assert got == [("human", "user_input"), ("framework", "tool_output"), ("framework", "framework_control"), ("human", "framework_control"), ("model", None), ("system", "system_prompt"), (None, None)]
    tools = spark.createDataFrame([(t,) for t in ("Read", "Write", "Bash", "Task", "mcp__x", "New")], "t string").select("t", claude_code.operation(F.col("t")).alias("o"), claude_code.content_origin(F.col("t")).alias("c")).collect()
    assert [(r.o, r.c) for r in tools] == [("READ", "local_file"), ("NEW", "local_file"), ("EXECUTE", "local_exec"), ("DELEGATE", "sub_agent"), ("OTHER", "mcp_server"), ("OTHER", None)]
    for s, n in (("s1", 12), ("s2", 1)):
        (tmp_path / s / "tool-results").mkdir(parents=True)
        for i in range(n):
            (tmp_path / s / "tool-results" / f"c{i:02d}.txt").write_text(f"result\n{i}")
    made = claude_code.folder_sessions(spark, str(tmp_path))
    assert {(r.session_id, r.quality, r.tool_call_count) for r in made["sessions"].collect()} == {("s1", "B", 12), ("s2", "C", 1)}
    assert made["tool_calls"].where("tool_call_id = 'c03'").first().result == "result\n3"
    calls = spark.createDataFrame([("p", "c2", 2, "Task", '{"prompt":"do it"}', None), ("p", "c1", 1, "Agent", '{"subagent_type":"x"}', None), ("p", "c3", 3, "Bash", "{}", None)], "session_id string, tool_call_id string, source_ordinal long, tool_name string, arguments_json string, spawned_agent_sub_session_id string")
    agents = spark.createDataFrame([("k1", "b", "p", "slug"), ("k2", "a", "p", "")], "session_id string, agent_id string, parent_session string, slug string")
    linked = {r.tool_call_id: (r.spawned_agent_sub_session_id, r.spawned_agent_type) for r in claude_code.link_subagents(claude_code.spawned(calls), agents).collect()}
    assert linked == {"c1": ("a", "x"), "c2": ("b", "general"), "c3": (None, None)}
    sessions = spark.createDataFrame([("k1", None, "v2", None, "t"), ("k2", None, "v2", None, "t"), ("p", "o", "v2", "q", "main")], "session_id string, original_session_id string, source_format string, predecessor_session string, title string")
    assert {tuple(r) for r in claude_code.subagent_sessions(sessions, agents).collect()} == {("b", "b", "v2+subagent", "p", "[subagent] slug"), ("a", "a", "v2+subagent", "p", "[subagent] t"), ("p", "o", "v2", "q", "main")}


def test_chat_transcripts(spark, tmp_path):
    def node(i, role, text="", kind="text", exchange=None, **m):
        content = {"content_type": kind, "parts": [text]} if kind == "text" else {"content_type": kind, "text": text}
        return {"parent": f"n{i - 1}" if i else None, "message": {"author": {"role": role, "name": m.pop("name", None)}, "content": content, "metadata": {"turn_exchange_id": exchange, "model_slug": m.pop("model", None), "is_visually_hidden_from_conversation": m.pop("hidden", None)}, "create_time": i, **m}}

    chain = [
        node(0, "system", "note"), node(1, "user", "ask"), node(2, "assistant", "let me", exchange="e1", model="m1"), node(3, "assistant", "search()", "code", "e1", recipient="web"), node(4, "tool", "r1", exchange="e1", name="web"), node(5, "tool", "r2", exchange="e1", name="web"),
        node(6, "tool", "lost", exchange="e1", name="other"), node(7, "assistant", "again()", "code", "e1", recipient="web"), node(8, "assistant", "answer", exchange="e1", model="m2"), node(9, "assistant", "next", exchange="e2"), node(10, "user", "hide", hidden=True), node(11, "user", "bye"),
    ]
    doc = {"conversation_id": "abc", "current_node": "n11", "mapping": {f"n{i}": n for i, n in enumerate(chain)}}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text(json.dumps({**doc, "conversation_id": "xyz"}))
    stepped = chat_transcripts.steps(chat_transcripts.transcript_nodes(spark, str(tmp_path), "ab"))
    turns = [(r.path, r.role, r.content, r.model) for r in chat_transcripts.transcript_turns(stepped).orderBy("turn_index").collect()]
    assert turns == [("abc", "system", "note", None), ("abc", "user", "ask", None), ("abc", "assistant", "let me\n\nanswer", "m2"), ("abc", "assistant", "next", None), ("abc", "user", "bye", None)]
    calls, orphans = chat_transcripts.transcript_calls(stepped)
    assert [(r.tool_call_id, r.tool_name, r.result, r.tool_nodes, r.turn_index) for r in calls.orderBy("tool_call_id").collect()] == [("chatgpt-tool-e1-0", "web", "r1\nr2", 2, 2), ("chatgpt-tool-e1-1", "web", None, 0, 2)]
    assert [(r.author, r.text) for r in orphans.collect()] == [("other", "lost")]


def test_paths_and_titles(spark):
    calls = spark.createDataFrame([("a", "/home/x/y"), ("a", None), ("b", "/srv/z"), ("c", "/Users/q")], "session_id string, file_path string")
    assert {r.session_id: r.pii for r in calls.groupBy("session_id").agg(metrics.names_home("file_path").alias("pii")).collect()} == {"a": True, "b": False, "c": True}
    cut = spark.createDataFrame([("é" * 60,), ("a b\n c",)], "t string").select(metrics.cut_bytes(F.col("t"), 80).alias("c")).collect()
    assert [r.c for r in cut] == ["é" * 40, "a b\n c"]
