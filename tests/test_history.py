"""Small made-up sessions that set off the rules one by one."""

import pytest
from loomspark import schema
from loomspark.plans import history as H
from pyspark.sql import functions as F


def table(spark, name, rows):
    """Rows of a table from dictionaries; columns that aren't named are null."""
    fields = schema.TABLES[name].fields
    given = [f for f in fields if any(f.name in r for r in rows)]
    df = spark.createDataFrame([tuple(r.get(f.name) for f in given) for r in rows], schema.T.StructType([schema.T.StructField(f.name, f.dataType) for f in given]))
    return df.select(*[(F.col(f.name) if f in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def call(i, turn, tool="Bash", **more):
    return {"session_id": "s", "tool_call_id": f"c{i:02d}", "source_ordinal": i, "emitting_turn_index": turn, "timestamp": f"2024-01-01T00:{i:02d}:00Z", "tool_name": tool, "record_kind": "tool_call", **more}


@pytest.fixture(scope="module")
def empty(spark):
    return schema.empty(spark)


def test_failure_triage(spark, empty):
    bad = [
        ("self-kill", {"command": "pkill -f 'work' ; ./work", "exit_code": 144}), ("zsh-expansion", {"error": "(eval):1: == not found"}), ("zsh-expansion", {"result": "x\n=== not found"}), ("read-before-edit", {"error": "File has not been read yet."}),
        ("nul-byte", {"error": "illegal character NUL"}), ("cwd-drift", {"error": "sed: can't read docs/a.md: No such file"}), ("missing-file", {"error": "cat: cannot stat /abs/x: No such file"}), ("timeout", {"error": "Command timed out"}),
        ("go-test", {"result": "ok\n--- FAIL: TestA"}), ("go-compile", {"error": "./a.go:1:2: undefined: x"}), ("partial-success", {"result": "row " * 60}), ("nonzero-exit", {"error": "exit 1", "result": "row " * 60 + "error"}), ("nonzero-exit", {}),
    ]
    calls = [call(0, 0, command="cd one && ls", success=1), call(1, 1, command="make; cd two", success=1)] + [call(i, i, success=0, **more) for i, (_, more) in enumerate(bad, 2)]
    got = H.failure_triage(empty | {"tool_calls": table(spark, "tool_calls", calls)}).orderBy("tool_call_id").collect()
    assert [r.category for r in got] == [k for k, _ in bad]
    assert got[0].detail == "pattern work is in its own command" and got[5].detail == "docs/a.md after cd to two" and got[6].detail == "/abs/x"


def test_file_history(spark, empty):
    args = '{"input":"*** Begin Patch\\n*** Update File: pkg/notes.go\\n*** Add File: docs/other.md\\n"}'
    calls = [
        call(0, 1, "Write", operation_type="NEW", file_path="/home/me/w/notes.md", success=1), call(1, 2, "Edit", operation_type="MODIFY", file_path="~/w/notes.md", arguments_json='{"file_path":"/home/me/w/notes.md"}', success=1),
        call(2, 3, "apply", arguments_json=args), call(3, 3, command="echo x >> w/notes.md 2>&1 > (y)"), call(4, 3, "exec", arguments_json='{"cmd":"cat a > out/Notes.txt"}'), call(5, 3, command="say notes"), call(6, 4, "read", operation_type="OTHER", file_path="notes.txt"),
    ]
    turns = [{"session_id": "s", "turn_index": i, "role": "user", "content": t} for i, t in enumerate(["start", "<tool>", "then", "Caveat: no"])]
    t = empty | {"tool_calls": table(spark, "tool_calls", calls), "turns": table(spark, "turns", turns), "sessions": table(spark, "sessions", [{"session_id": "s", "agent_framework": "pi"}])}
    rows = H.file_timeline(t, "NOTES").orderBy("tool_call_id").collect()
    assert [(r.tool_call_id, r.file_path, r.op, r.match_source, r.preceding_instruction) for r in rows] == [
        ("c00", "/home/me/w/notes.md", "NEW", "file_path", "start"), ("c01", "~/w/notes.md", "MODIFY", "file_path", "then"), ("c02", "pkg/notes.go", "OTHER", "arguments", "then"),
        ("c03", "w/notes.md", "OTHER-exec", "arguments", "then"), ("c04", "out/Notes.txt", "OTHER-exec", "arguments", "then"), ("c06", "notes.txt", "READ-inferred", "file_path", "then"),
    ]
    s = {r.file_path: r for r in H.file_history(t, "notes").collect()}
    assert (s["w/notes.md"].creates, s["w/notes.md"].modifies, s["w/notes.md"].other, s["w/notes.md"].created_before_visible_history) == (1, 1, 1, 0)


def test_probes_episodes_and_documents(spark, empty):
    calls = [
        call(0, 1, command="grep -rn 'Alpha\\|^Beta' ../lib/src"), call(1, 30, command='rg "Alpha" /x/go/pkg/mod/github.com/a/b@v1/f.go', success=0), call(2, 31, command="sed -n '1,9p' ../lib/main.go", success=1), call(3, 31, command="echo ../lib"),
        call(40, 60, "Skill", arguments_json='{"skill":"one"}', success=1), call(41, 60, command="bin/app help topic && git help add"), call(42, 60, "Read", file_path="/w/ttmp/a.md"), call(43, 60, command="cat ~/.claude/skills/x"), call(44, 60, "Read", file_path="/w/pkg/doc/x.md"),
    ]
    turns = [{"session_id": "s", "turn_index": i, "role": "user", "content": t} for i, t in ((1, "go"), (40, "This session is being continued"), (50, "more"))]
    t = empty | {"tool_calls": table(spark, "tool_calls", calls), "turns": table(spark, "turns", turns), "sessions": table(spark, "sessions", [{"session_id": "s"}, {"session_id": "none"}])}
    waves = [(r.first_turn, r.last_turn, r.probes, r.repos, r.symbols) for r in H.source_probes(t).orderBy("wave").collect()]
    assert waves == [(1, 1, 1, "../lib", "Alpha,Beta"), (30, 31, 2, "../lib,github.com/a/b", "Alpha,[read 1,9p of main.go]")]
    assert [(r.symbol, r.waves) for r in H.repeated_probes(t).collect()] == [("Alpha", 2)]
    e = [(r.episode, r.start_turn, r.end_turn, r.tool_calls, r.failures, r.unknown_outcomes, r.wall_min, r.idle_min, r.top_tools) for r in H.episodes(t).orderBy("episode").collect()]
    assert e == [(1, 1, 49, 4, 1, 2, 3, 0, "Bash:4"), (2, 50, None, 5, 0, 4, 4, 0, "Bash:2 Read:2 Skill:1")]
    d = {r.session_id: r for r in H.doc_consumption(t).collect()}
    assert (d["s"].skill_loads, d["s"].skill_names, d["s"].skill_sideloads, d["s"].embedded_help_calls, d["s"].md_reads_ticket, d["s"].md_reads_other, d["s"].embedded_doc_reads) == (1, "one", 1, 1, 1, 1, 1) and d["none"].skill_loads == 0
