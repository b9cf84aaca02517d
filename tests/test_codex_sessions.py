import json

from loomspark.sources import archives, codex_sessions, importing

from tests.test_codex import event, item, log, response

T = "2024-05-01T10:00:{:02d}Z"


def stamped(records):
    return [{**r, "timestamp": T.format(i)} for i, r in enumerate(records)]


PATCH = "*** Begin Patch\n*** Add File: new.py\n+x\n*** Update File: old.py\n@@\n*** End Patch"
RECORDS = stamped([
    {"type": "session_meta", "payload": {"id": "child", "cwd": "/home/me/w", "cli_version": "1", "model_provider": "p", "base_instructions": {"text": "rules"}, "git": {"branch": "dev", "commit_hash": "abc"}}},
    {"type": "session_meta", "payload": {"id": "parent"}},
    {"type": "turn_context", "payload": {"turn_id": "t1", "model": "m1", "cwd": "/home/me/w", "approval_policy": "never"}},
    event(type="user_message", message="fix it"), response(type="message", role="user", content=[{"type": "input_text", "text": "fix it"}]),
    event(type="agent_reasoning", text="hm"), response(type="reasoning", summary=[{"text": "so"}]),
    response(type="message", role="assistant", id="m1", content=[{"type": "output_text", "text": "on it"}]),
    event(type="token_count", info={"last_token_usage": {"input_tokens": 9, "output_tokens": 4, "cached_input_tokens": 2, "reasoning_output_tokens": 0}}),
    response(type="function_call", call_id="run", name="exec_command", arguments=json.dumps({"cmd": "make > out.txt"}), message_id="m1"),
    item("CommandExecution", "started", "x1", command=["bash", "-lc", "make > out.txt"], cwd="/home/me/w", call_id="run"),
    item("CommandExecution", "completed", "x1", command=["bash", "-lc", "make > out.txt"], cwd="/home/me/w", call_id="run", status="failed", exit_code=2, aggregated_output="no rule"),
    response(type="function_call_output", call_id="run", output="Exit code: 2\nOutput:\nno rule"),
    response(type="custom_tool_call", call_id="patch", name="apply_patch", input=PATCH),
    response(type="custom_tool_call_output", call_id="patch", output=json.dumps({"output": "done", "metadata": {"exit_code": 0, "duration_seconds": 0.5}})),
    response(type="function_call", call_id="legacy", name="shell", arguments=json.dumps({"command": ["ls", "-la"]})), event(type="exec_command_end", call_id="legacy", exit_code=0),
    response(type="function_call", call_id="open", name="web", arguments="{}"), response(type="function_call", call_id="open", name="web", arguments="{}"),
    item("CommandExecution", "completed", "x2", command=["pwd"], cwd="/home/me/w", status="completed", exit_code=0),
    item("FileChange", "completed", "f1", status="completed", cwd="/home/me/w", changes={"a.py": {"type": "update", "move_path": "b.py"}, "c.py": {"type": "add"}}),
])


def test_evidence_in_the_tables(spark):
    t = codex_sessions.convert(log(spark, *RECORDS))
    s = t["sessions"].first()
    assert (s.session_id, s.working_directory, s.model, s.system_prompt, s.git_branch, s.git_ref, s.autonomy_level, s.title, s.contains_pii) == ("child", "~/w", "m1", "rules", "dev", "abc", "full-auto", "fix it", 1)
    turns = [(r.role, r.content, r.thinking, r.input_tokens, r.output_tokens, r.model) for r in t["turns"].orderBy("turn_index").collect()]
    assert turns == [("user", "fix it", None, None, None, None), ("assistant", "on it", "hm\nso", 9, 4, "m1")]
    c = {r.tool_call_id: r for r in t["tool_calls"].collect()}
    told = lambda i: (c[i].record_kind, c[i].tool_name, c[i].success, c[i].outcome_status, c[i].exit_code)
    assert told("run") == ("tool_call", "exec_command", 0, "failed", 2) and (c["run"].command, c["run"].result, c["run"].emitting_turn_index, c["run"].file_path) == ("make > out.txt", "no rule", 1, "/home/me/w/out.txt")
    assert told("patch") == ("tool_call", "apply_patch", 1, "succeeded", 0) and c["patch"].duration_ms == 500
    assert told("legacy") == ("tool_call", "shell", 1, "succeeded", 0) and c["legacy"].command == "ls -la"
    assert told("open") == ("tool_call", "web", None, "unknown", None)
    assert told("codex-execution:x2") == ("execution", "exec_command", 1, "succeeded", 0) and told("codex-file-change:f1") == ("file_change", "file_change", 1, "succeeded", None)
    assert "codex-execution:x1" not in c and [r.title for r in t["annotations"].collect()] == ["Deduplicated 1 duplicate tool calls"]
    files = {(r.tool_call_id, r.path, r.operation_type, r.evidence_kind, r.evidence_status, r.resolved) for r in t["files"].collect()}
    assert files == {
        ("run", "/home/me/w/out.txt", "MODIFY", "shell_redirect", "attempted", 1), ("patch", "/home/me/w/new.py", "NEW", "patch_header", "confirmed", 1), ("patch", "/home/me/w/old.py", "MODIFY", "patch_header", "confirmed", 1),
        ("codex-file-change:f1", "/home/me/w/a.py", "DELETE", "native_change", "confirmed", 1), ("codex-file-change:f1", "/home/me/w/b.py", "NEW", "native_change", "confirmed", 1), ("codex-file-change:f1", "/home/me/w/c.py", "NEW", "native_change", "confirmed", 1),
    }
    m = t["metrics"].first()
    assert (m.turn_count, m.tool_call_count, m.total_input_tokens, m.total_cache_read_tokens) == (2, 6, 9, 2)


def test_load_shows_the_evidence(spark, tmp_path):
    (tmp_path / "rollout.jsonl").write_text("\n".join(map(json.dumps, RECORDS)) + "\n")
    tables, told = importing.load_set(spark, archives.SourceSet().directory(str(tmp_path)))
    assert told.count() == 0
    assert {r.tool_call_id for r in tables["tool_calls"].where("outcome_status = 'failed'").collect()} == {"run"}
    assert tables["files"].where("session_id = 'child'").count() == 6 and tables["sessions"].first().session_id == "child"
    none = codex_sessions.convert(spark.createDataFrame([], "path string, line_no long, value string"))
    assert all(df.count() == 0 for df in none.values())
