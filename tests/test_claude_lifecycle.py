import hashlib
import json
import random

from loomspark.sources import adapters, claude_lifecycle
from pyspark.sql import functions as F


def lines(spark, logs):
    rows = [(path, n, json.dumps(x, ensure_ascii=False)) for path, log in logs.items() for n, x in enumerate(log, 1)]
    return spark.createDataFrame(rows, "path string, line_no long, value string")


def at(s):
    return f"2024-05-01T10:{s // 60:02d}:{s % 60:02d}.000Z"


def use(id_, name, s, text="", **given):
    return {"type": "assistant", "sessionId": "sess", "timestamp": at(s), "message": {"role": "assistant", "model": "m1", "usage": {"input_tokens": 3, "output_tokens": 5, "cache_read_input_tokens": 0}, "content": [{"type": "text", "text": text}, {"type": "tool_use", "id": id_, "name": name, "input": given}]}}


def result(id_, s, content, beside=None, is_error=False):
    x = {"type": "user", "sessionId": "sess", "timestamp": at(s), "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": id_, "content": content, "is_error": is_error}]}}
    return x if beside is None else x | {"toolUseResult": beside}


LOG = [
    {"type": "file-history-snapshot", "timestamp": at(5000), "entrypoint": "cli"},
    {"type": "mode", "mode": "plan-mode", "timestamp": at(0), "cwd": "/home/me/w", "version": "2.1", "gitBranch": "dev", "sessionId": "sess"},
    {"type": "permission-mode", "permissionMode": "bypassPermissions", "timestamp": at(0)},
    {"type": "permission-mode", "permissionMode": "default", "timestamp": at(0)},
    {"type": "system", "timestamp": at(0), "message": {"content": [{"type": "text", "text": "be good"}, {"type": "other", "text": "x"}]}},
    {"type": "user", "timestamp": at(1), "uuid": "u1", "isSidechain": False, "message": {"role": "user", "content": "Please\nfix it"}},
    {"type": "user", "timestamp": at(1), "message": {"role": "user", "content": [{"type": "text", "text": "<system-reminder>be quick</system-reminder>"}]}},
    {"type": "attachment", "uuid": "att", "timestamp": at(1), "parentUuid": "u1", "attachment": {"type": "file", "fileName": "a.PNG", "mediaType": "x/y", "path": "/home/me/a.PNG", "fileSize": 12, "content": "c" * 300}},
    {"type": "attachment", "timestamp": at(1)},
    {"type": "assistant", "timestamp": at(2), "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "hm", "signature": "s"}, {"type": "text", "text": "one"}, {"type": "text", "text": "two"}], "stop_reason": "end_turn"}},
    use("ok", "Bash", 3, command="ls"), result("ok", 5, [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}], {"stdout": "a\nb", "interrupted": False}),
    use("int", "Bash", 6, command="sleep"), result("int", 9, "", {"stdout": "", "stderr": "bad", "interrupted": True}),
    use("code", "Bash", 10, command="false"), result("code", 11, "failed " * 200, "Error: Exit code 3\nout", is_error=True),
    use("err", "Edit", 12, file_path="/x"), result("err", 13, "long", {"stderr": "  stale file ", "exitCode": 7}, is_error=True),
    use("big", "Read", 14, file_path="/home/me/big"), result("big", 15, "é" * 9000, {"file": "z" * 20000, "n": 1}),
    use("task", "Task", 16, subagent_type="explorer", prompt="p" * 300), result("task", 17, "done"),
    use("mcp", "mcp__a__b", 18), result("nobody", 19, "?"), result("ok", 20, "again"),
    use("", "Glob", 21, pattern="*"), use("twice", "Grep", 22), result("twice", 23, "1"), use("twice", "Grep", 24), result("twice", 25, "2"),
    {"type": "ai-title", "aiTitle": "Fixing it", "timestamp": at(26)}, {"type": "progress", "timestamp": at(4000)},
]


def test_lifecycle(spark):
    t = claude_lifecycle.convert(lines(spark, {"log": LOG}))
    s = t["sessions"].first()
    assert (s.session_id, s.working_directory, s.agent_version, s.git_branch, s.model, s.autonomy_level, s.title, s.classification, s.contains_pii) == ("sess", "~/w", "2.1", "dev", "m1", "full-auto", "Fixing it", "confidential", 1)
    config = json.loads(s.framework_config_json)
    assert config["mode"] == "plan-mode" and config["permission_mode"] == "default" and config["entrypoint"] == "cli" and config["is_sidechain"] is False
    assert (s.started_at, s.ended_at, s.duration_seconds, s.quality, s.source_format) == (at(0), at(26), 26.0, "A", "claude-code-jsonl-v2") or s.quality == "B"
    turns = t["turns"].orderBy("turn_index").collect()
    assert [(r.role, r.source, r.input_channel, r.content) for r in turns[:4]] == [("system", "framework", "system_prompt", "be good"), ("user", "human", "user_input", "Please\nfix it"), ("user", "framework", "framework_control", "<system-reminder>be quick</system-reminder>"), ("assistant", "model", None, "one\ntwo")]
    meta = json.loads(turns[3].framework_metadata_json)
    assert (turns[3].thinking, turns[3].was_streamed, meta["signed_thinking_blocks"], meta["stop_reason"]) == ("hm", 1, 1, "end_turn")
    c = {r.tool_call_id: r for r in t["tool_calls"].collect()}
    told = lambda i: (c[i].success, c[i].result, c[i].error, c[i].exit_code, c[i].duration_ms)
    assert told("ok") == (1, "a\nb", None, None, 2000) and told("int") == (0, "", claude_lifecycle.INTERRUPTED, None, 3000)
    assert told("code") == (0, "failed " * 200, ("failed " * 200)[:500], 3, 1000) and told("err") == (0, "long", "  stale file ", 7, 1000)
    big = c["big"]
    assert big.result == "é" * 5120 + "\n[truncated]" and (big.truncated, big.full_bytes, big.full_hash) == (1, 18000, "sha256:" + hashlib.sha256(("é" * 9000).encode()).hexdigest())
    kept = json.loads(big.framework_metadata_json)["tool_use_result"]
    assert kept == {"file": "z" * 2048, "n": 1} and json.loads(c["int"].framework_metadata_json)["interrupted"] is True and json.loads(c["code"].framework_metadata_json)["tool_use_result"] == "Error: Exit code 3\nout"
    assert (c["task"].spawned_agent_type, c["task"].spawned_agent_task_scope, c["task"].operation_type, c["task"].content_origin) == ("explorer", "p" * 200, "DELEGATE", "sub_agent")
    assert (c["mcp"].success, c["mcp"].error, c["mcp"].content_origin, c["mcp"].emitting_turn_index) == (0, claude_lifecycle.NO_RESULT, "mcp_server", 10)
    assert c["tc-0007"].success == 0 and c["twice"].result == "1"
    assert json.loads(c["task"].tools_before_json) == ["Bash", "Bash", "Bash", "Edit", "Read"] and c["task"].source_ordinal == 5
    notes = {r.annotation_id: (r.scope_type, r.target_id) for r in t["annotations"].collect()}
    assert notes == {"ann-orphan-mcp": ("tool_call", "mcp"), "ann-orphan-tc-0007": ("tool_call", "tc-0007"), "ann-dedup-sess": ("session", "sess")}
    lost = claude_lifecycle.unmatched_results(lines(spark, {"log": LOG})).collect()
    assert {(r.tool_call_id, r.message) for r in lost} == {("nobody", "a result without a call"), ("ok", "a second result of this call")}
    events = t["events"].orderBy("ordinal").collect()
    assert [(r.event_id, r.summary) for r in events if r.kind != "attachment"] == [("claude-mode-change-000000", "plan-mode"), ("claude-permission-mode-change-000001", "bypassPermissions"), ("claude-permission-mode-change-000002", "default"), ("claude-title-change-000005", "Fixing it")]
    assert events[3].summary.startswith("uuid=att; parent_uuid=u1; type=file; file=a.PNG; media=x/y; content=ccc") and events[4].summary == "Claude Code attachment with no structured payload."
    a = {r.attachment_id: r for r in t["attachments"].collect()}
    assert (a["att"].kind, a["att"].path, a["att"].size_bytes, len(a["att"].text_preview), a["att"].event_id) == ("image", "~/a.PNG", 12, 240, "claude-attachment-000003") and a["attachment-2"].kind == "attachment"
    m = t["metrics"].first()
    assert (m.tool_call_count, m.read_count, m.execute_count, m.modify_count, m.delegate_count, m.subagent_count, m.total_input_tokens, m.total_cache_read_tokens, m.time_to_first_action) == (9, 3, 3, 1, 1, 1, 30, None, 3.0)
    assert {(r.turn_index, r.tool_call_id) for r in t["turn_tool_calls"].collect()} >= {(4, "ok"), (10, "mcp")}


def paired(log):
    """(id, result or None, turn) of the calls that stay, in one pass."""
    waiting, done, turn = {}, [], 0
    for x in log:
        blocks = x["message"]["content"]
        if x["type"] == "assistant":
            for b in blocks:
                if b["type"] == "tool_use":
                    waiting[b["id"]] = (x["timestamp"], turn)
            turn += 1
        else:
            for b in blocks:
                if b["tool_use_id"] in waiting:
                    done.append((b["tool_use_id"], b["content"], *waiting.pop(b["tool_use_id"])))
    done += [(i, None, *w) for i, w in waiting.items()]
    first = {}
    for i, r, when, t in sorted(done, key=lambda x: (x[2], x[3])):
        first.setdefault(i, (r, t))
    return first


def test_pairs_against_one_pass(spark):
    rng, logs = random.Random(4), {}
    for n in range(25):
        log = []
        for s in range(rng.choice([3, 60])):
            ids = [f"c{rng.randrange(12)}" for _ in range(rng.choice([1, 2]))]
            log.append({"type": "assistant", "timestamp": at(s), "message": {"content": [{"type": "tool_use", "id": i, "name": "Bash", "input": {}} for i in dict.fromkeys(ids)]}} if rng.random() < 0.5 else {"type": "user", "timestamp": at(s), "message": {"content": [{"type": "tool_result", "tool_use_id": i, "content": f"r{s}{i}"} for i in dict.fromkeys(ids)]}})
        logs[f"log{n}"] = log
    got = {}
    for r in claude_lifecycle.convert(lines(spark, logs))["tool_calls"].collect():
        got[r.session_id, r.tool_call_id] = (r.result, r.emitting_turn_index)
    want = {(p, i): v for p, log in logs.items() for i, v in paired(log).items()}
    assert got == want and len(want) > 100


def test_nothing_and_odd_records(spark):
    none = claude_lifecycle.convert(spark.createDataFrame([], "path string, line_no long, value string"))
    assert all(df.count() == 0 for df in none.values())
    odd = adapters.convert(lines(spark, {"x": [{"type": "user"}, {"type": "assistant", "message": {"content": "plain"}}, {"type": "user", "message": {"content": [{"type": "tool_result"}, 5, None]}}, {"type": "assistant", "message": {"content": [{"type": "tool_use"}]}}, {}]}), "claude-code")
    assert odd["turns"].count() == 3 and odd["tool_calls"].where(F.col("tool_name") == "").count() == 1
