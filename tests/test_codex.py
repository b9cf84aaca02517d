import json

import pytest
from loomspark.sources import codex
from pyspark.sql import functions as F


def log(spark, *records, path="log"):
    rows = [(path, i, json.dumps(r)) for i, r in enumerate(records, 1)]
    return spark.createDataFrame(rows, "path string, line_no long, value string")


def item(kind, phase, id_, payload=None, **fields):
    return {"type": "event_msg", "timestamp": "2024-05-01T10:00:00Z", "payload": {"type": f"item_{phase}", "item": {"type": kind, **({"id": id_} if id_ else {}), **fields}, **(payload or {})}}


def response(**payload):
    return {"type": "response_item", "timestamp": "2024-05-01T10:00:01Z", "payload": payload}


def event(**payload):
    return {"type": "event_msg", "payload": payload}


def test_messages(spark):
    said = lambda role, text, **more: response(type="message", role=role, content=[{"type": "input_text", "text": t} for t in text], **more)
    lines = log(
        spark,
        {"type": "turn_context", "payload": {"turn_id": "t1"}},
        event(type="user_message", message="one two"), said("user", ["one ", "two"], id="m1"),
        said("user", ["again"]), said("user", ["again"]),
        event(type="agent_message", message="done"), event(type="token_count"), said("assistant", ["done"], id="m2"),
        {"type": "event_msg", "payload": {"type": "item_completed", "turn_id": "t1", "item": {"type": "AgentMessage", "id": "m2", "content": [{"type": "text", "text": "other"}]}}},
        said("developer", ["rules"]), event(type="exec_command_end"),
    )
    got = [(r.line_no, r.role, r.message_id, r.content, r.conflict) for r in codex.messages(lines).orderBy("line_no").collect()]
    assert got == [(2, "user", "m1", "one \ntwo", False), (4, "user", None, "again", False), (5, "user", None, "again", False), (6, "assistant", None, "done", False), (8, "assistant", "m2", "done", True), (10, "system", None, "rules", False)]
    calls = spark.createDataFrame([("log", "c1", "t1", "m2"), ("log", "c2", "t1", "m9"), ("log", "c3", "t1", None)], "path string, call_id string, turn_id string, emitting_message_id string")
    linked = {r.call_id: (r.message_line, r.turn_association, r.diagnostic) for r in codex.link_calls(calls, codex.messages(lines)).collect()}
    assert linked == {"c1": (8, "explicit_message_id", None), "c2": (None, "unknown", "unresolved_emitting_message_id"), "c3": (None, "unknown", None)}


def test_output_evidence(spark):
    cases = [
        (json.dumps({"output": "hi", "metadata": {"exit_code": 0, "duration_seconds": 1.5}}), ("hi", 0, 1500)),
        (json.dumps({"output": "hi", "chunk_id": "x", "exit_code": 2, "wall_time_seconds": 0.25}), ("hi", 2, 250)),
        (json.dumps({"status": "fulfilled", "value": {"output": "in", "metadata": {"exit_code": 3}}}), ("in", 3, None)),
        ("Chunk ID: a\nWall time: 0.5 seconds\nProcess exited with code 1\nOutput:\nExit code: 9\nrest", ("Exit code: 9\nrest", 1, 500)),
        ("Exit code: 0\nno marker", ("Exit code: 0\nno marker", None, None)),
        ('{"exit_code": 0}', ('{"exit_code": 0}', None, None)),
        ('{"output": "x", "metadata": {"exit_code": "a"}}', ('{"output": "x", "metadata": {"exit_code": "a"}}', None, None)),
        ("Output:\nplain", ("Output:\nplain", None, None)),
    ]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", codex.output_evidence(F.col("t")).alias("e")).collect()
    for r in got:
        assert tuple(r.e) == cases[r.i][1], cases[r.i][0]


def test_outputs(spark):
    told = lambda code: json.dumps({"output": "x", "metadata": {"exit_code": code}})
    call = lambda id_, name="shell": response(type="function_call", call_id=id_, name=name)
    out = lambda id_, o: response(type="function_call_output", call_id=id_, output=o)
    lines = log(spark, out("early", told(0)), call("early"), call("bad"), out("bad", told(2)), call("both"), out("both", told(0)), out("both", told(1)), call("wrap", "exec"), out("wrap", told(0)), call("two"), out("two", [{"type": "text", "text": told(0)}, {"type": "output_text", "text": told(1)}, {"type": "image"}, {"type": "new"}]), call("none"))
    got = {r.call_id: (r.outcome_status, r.exit_code, r.diagnostics, r.result) for r in codex.outputs(lines).collect()}
    assert got == {
        "early": ("succeeded", 0, [], "x"), "bad": ("failed", 2, [], "x"), "both": ("unknown", None, ["conflicting_response_output_exit_codes"], "x"),
        "wrap": ("unknown", None, [], "x"), "two": ("unknown", None, ["multiple_output_envelopes"], "x\nx\n[image output]\n[unsupported output block]"),
    }
    calls = spark.createDataFrame([("log", "a", None, "unknown"), ("log", "b", 0, "succeeded"), ("log", "c", 1, "failed")], "path string, tool_call_id string, exit_code int, outcome_status string")
    ends = log(spark, event(type="exec_command_end", call_id="a", exit_code=0), event(type="exec_command_end", call_id="b", exit_code=4), event(type="exec_command_end", call_id="x", exit_code=4))
    assert {r.tool_call_id: (r.exit_code, r.outcome_status) for r in codex.legacy_ends(ends, calls).collect()} == {"a": (0, "succeeded"), "b": (None, "unknown"), "c": (1, "failed")}


def test_executions(spark):
    run = lambda phase, id_, payload=None, **f: item("CommandExecution", phase, id_, payload, **f)
    lines = log(
        spark,
        run("started", "a", {"started_at_ms": 1000, "turn_id": "t1"}, command=["bash", "-lc", "ls x"], cwd="/w", call_id="c1"),
        run("completed", "a", {"completed_at_ms": 1500, "turn_id": "t1"}, status="completed", exit_code=0, aggregated_output="out"),
        run("completed", "b", status="failed", command=["git", "it's"], stderr="boom"),
        run("completed", "c", status="failed", exit_code=0), run("completed", "d", status="cancelled"), run("started", "e"),
        run("started", "f", cwd="/a"), run("completed", "f", cwd="/b", status="completed", exit_code=0), run("completed", None, status="completed", exit_code=1.5),
        run("completed", "g", status="completed", exit_code=1, call_id="c2"), run("completed", "h", status="completed", exit_code=0, call_id="c3"), run("completed", "i", status="completed", exit_code=0, call_id="c3"),
    )
    runs = codex.executions(lines)
    got = {r.tool_call_id.partition(":")[2]: r for r in runs.collect()}
    assert {k: (r.outcome_status, r.exit_code) for k, r in got.items()} == {
        "a": ("succeeded", 0), "b": ("failed", None), "c": ("unknown", None), "d": ("cancelled", None), "e": ("pending", None), "f": ("unknown", None), "anonymous-line-9": ("unknown", None), "g": ("failed", 1), "h": ("succeeded", 0), "i": ("succeeded", 0),
    }
    assert (got["a"].command, got["a"].duration_ms, got["a"].result) == ("ls x", 500, "out")
    assert got["b"].command == "'git' 'it'\"'\"'s'" and got["b"].error == "boom" and got["f"].diagnostics == ["conflicting_execution_cwd"]
    assert set(got["anonymous-line-9"].diagnostics) == {"missing_execution_id", "invalid_execution_exit_code"}
    calls = spark.createDataFrame([("log", c, "exec_command", "old", "unknown", code, None, "tool_call") for c, code in (("c1", None), ("c2", 0), ("c3", None))], "path string, tool_call_id string, tool_name string, command string, outcome_status string, exit_code int, result string, record_kind string")
    made = {r.tool_call_id: r for r in codex.with_executions(calls, runs).collect()}
    assert len(made) == 3 + 8 and "codex-execution:a" not in made and "codex-execution:h" in made
    assert (made["c1"].command, made["c1"].outcome_status, made["c1"].exit_code) == ("ls x", "succeeded", 0)
    assert (made["c2"].outcome_status, made["c2"].exit_code) == ("unknown", None) and made["c3"].outcome_status == "unknown"
    report = {r.diagnostic: r.n for r in codex.fidelity(runs).collect()}
    assert report["conflicting_execution_cwd"] == 1 and report["conflicting_execution_outcome"] == 1


def test_file_changes(spark):
    change = lambda id_, status, changes, cwd="/w": item("FileChange", "completed", id_, status=status, changes=changes, cwd=cwd)
    lines = log(
        spark, item("FileChange", "started", "a"), change("a", "completed", {"x.py": {"type": "add"}, "/abs/../y.py": {"type": "update", "move_path": "z.py"}}, "file:///w"),
        change("b", "failed", {"q": {"type": "delete"}}), change("c", "completed", {"q": {"type": "update"}}), change("c", "completed", {"r": {"type": "update"}}), change("d", "completed", {"s": {"type": "odd"}}),
    )
    got = {(r.tool_call_id.partition(":")[2], r.target, r.operation_type, r.evidence_status) for r in codex.file_changes(lines).collect()}
    assert got == {("a", "/w/x.py", "NEW", "confirmed"), ("a", "/y.py", "DELETE", "confirmed"), ("a", "/w/z.py", "NEW", "confirmed"), ("b", "/w/q", "DELETE", "attempted"), ("c", "/w/q", "MODIFY", "attempted"), ("c", "/w/r", "MODIFY", "attempted")}


@pytest.mark.parametrize("script, want", [
    ("echo hi > a.txt", [("a.txt", "MODIFY")]), ("cat < in >> 'o ut'", [("in", "READ"), ("o ut", "MODIFY")]), ("make 2> err; sort \"a b\" > c\\ d # > no", [("err", "MODIFY"), ("c d", "MODIFY")]), ("ls -la", []), ("", []),
    ("echo $X > a", None), ("a | b > c", None), ("cd x\necho > y", None), ("V=1 run > a", None), ("cat <<E\nE", None), ("echo > ; ls", None), ("echo 2>&1 > a", None), ("for i in a; do > b", None), ("echo \"$(x)\" > a", None), ("echo 'open > a", None), ("echo ~/x > a", None),
    ("x" * 50_000 + " > " + "y\\ " * 20_000, [("y " * 20_000, "MODIFY")]),
])
def test_shell_targets(spark, script, want):
    got = spark.createDataFrame([(script,)], "s string").select(codex.shell_targets(F.col("s")).alias("t")).first().t
    assert (None if got is None else [tuple(x) for x in got]) == want


def test_patch_targets(spark):
    patch = "*** Begin Patch\n*** Add File: a\n+x\n*** Update File: b\n*** Move to: c\n@@\n*** Delete File: d\n*** End Patch"
    cases = {patch: [("a", "NEW"), ("b", "DELETE"), ("c", "NEW"), ("d", "DELETE")], "*** Begin Patch\n*** Move to: c\n*** End Patch": None, "*** Begin Patch\n*** Add File: \n*** End Patch": None, "*** Update File: a": None, "*** Begin Patch\n*** End Patch": []}
    for text, want in cases.items():
        got = spark.createDataFrame([(text,)], "s string").select(codex.patch_targets(F.col("s")).alias("t")).first().t
        assert (None if got is None else [tuple(x) for x in got]) == want, text
    calls = spark.createDataFrame([("l", "1", "apply_patch", "MODIFY", None, json.dumps({"input": patch}), "/r"), ("l", "2", "exec_command", "EXECUTE", "echo > ../o", "{}", "/r/s"), ("l", "3", "read_file", "READ", None, '{"path": "f"}', None)], "path string, tool_call_id string, tool_name string, operation_type string, command string, arguments string, cwd string")
    got = {(r.tool_call_id, r.target, r.operation_type, r.evidence_kind) for r in codex.file_targets(calls).collect()}
    assert got == {("1", "/r/a", "NEW", "patch_header"), ("1", "/r/b", "DELETE", "patch_header"), ("1", "/r/c", "NEW", "patch_header"), ("1", "/r/d", "DELETE", "patch_header"), ("2", "/r/o", "MODIFY", "shell_redirect"), ("3", "f", "READ", "tool_path_argument")}
