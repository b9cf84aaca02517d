import json
import random

from loomspark.sources import copilot
from pyspark.sql import functions as F


def lines(spark, logs):
    rows = [(path, n, json.dumps(x)) for path, log in logs.items() for n, x in enumerate(log, 1)]
    return spark.createDataFrame(rows, "path string, line_no long, value string")


def event(kind, id_=None, parent=None, at=0, **data):
    return {"type": kind, "id": id_, "parentId": parent, "timestamp": f"2026-06-17T10:{at // 60:02d}:{at % 60:02d}Z", "data": data}


FULL = [
    event("session.start", "ev-1", None, 0, sessionId="sess-1", copilotVersion="1.0.0", producer="cli", context={"cwd": "/home/me/project", "branch": "main", "headCommit": "abc", "content": "private"}),
    event("session.info", "i-1", "ev-1", 0, message="hello"),
    event("system.message", "sy", "ev-1", 0, content="You help"),
    event("user.message", "ev-2", "ev-1", 1, content="Inspect", transformedContent="Inspect README.md", interactionId="int-1", attachments=[{}, {}]),
    event("assistant.turn_start", "ev-3", "ev-2", 2, turnId="turn-1", interactionId="int-1"),
    event("permission.requested", "ev-4", "ev-3", 3, requestId="perm-1", permissionRequest={"toolCallId": "tool-1", "intention": "Read the README", "possiblePaths": ["README.md"], "hasWriteFileRedirection": False, "detailedContent": "private"}),
    event("tool.execution_start", "ev-5", "ev-4", 4, toolCallId="tool-1", toolName="bash", turnId="turn-1", model="gpt-tool", arguments={"command": "cat README.md", "mode": "default"}),
    event("permission.completed", "ev-7", "ev-5", 4, requestId="perm-1", toolCallId="tool-1", result={"kind": "allow"}),
    event("tool.execution_complete", "ev-6", "ev-5", 6, toolCallId="tool-1", turnId="turn-1", success=True, result={"content": "# Example"}, toolTelemetry={"metrics": {"n": 1}, "sessionLog": "private"}),
    event("assistant.message", "ev-8", "ev-7", 7, turnId="turn-1", interactionId="int-1", model="gpt-a", content="The README has a title.", encryptedContent="s", outputTokens=7),
    event("hook.start", "h-1", "ev-8", 7, hookType="post"),
    event("hook.end", "h-2", "h-1", 7, hookType="post"),
    event("session.model_change", "m-1", "h-2", 8, newModel="gpt-b"),
    event("brand.new", "n-1", "m-1", 8, content="private"),
    event("assistant.turn_end", "ev-9", "ev-8", 8, turnId="turn-1"),
    event("tool.execution_complete", "lone", "ev-8", 9, toolCallId="tool-2", success=False, result={"content": "no such file"}),
    event("tool.execution_start", "open", "ev-8", 9, toolCallId="tool-3", toolName="create_file", arguments={"path": "/x", "description": "new one"}),
    event("session.shutdown", "ev-10", "ev-9", 10, currentModel="gpt-c", tokenDetails={"input": {"tokenCount": 100}, "output": {"tokenCount": 20}, "cache_read": {"tokenCount": 5}}, shutdownType="user", totalApiDurationMs=12, modelMetrics={"textResultForLlm": "private", "n": 2}),
]


def test_every_kind_of_event(spark):
    files = spark.createDataFrame([("/s/sess/workspace.yaml", "id: w\nname: 'Session Initialization'\ncwd: /home/me/project\nbranch: feature\ngit_root: /r\nrepository: a/b\n")], "path string, content string")
    bad = spark.createDataFrame([("/s/sess/events.jsonl", 99, "not JSON")], "path string, line_no long, message string")
    t = copilot.convert(lines(spark, {"/s/sess/events.jsonl": FULL}), copilot.workspaces_of(files), bad)
    s = t["sessions"].first()
    assert (s.session_id, s.agent_version, s.model, s.system_prompt, s.working_directory, s.git_branch, s.git_ref, s.project_id) == ("sess-1", "1.0.0", "gpt-c", "You help", "~/project", "feature", "abc", "a/b")
    assert (s.title, s.quality, s.contains_error, s.turn_count, s.tool_call_count, s.read_count, s.duration_seconds) == ("Inspect README.md", "B", 1, 2, 3, 1, 10.0)
    assert json.loads(s.tools_enabled_json) == ["bash", "create_file", "unknown"]
    config = json.loads(s.framework_config_json)
    assert config["context"]["content"] == copilot.REDACTED and config["model_metrics"] == {"textResultForLlm": copilot.REDACTED, "n": 2} and config["producer"] == "cli" and config["total_api_duration_ms"] == 12
    m = t["metrics"].first()
    assert (m.total_input_tokens, m.total_output_tokens, m.total_cache_read_tokens, m.read_ratio) == (100, 20, 5, 0.333)
    user, said = t["turns"].orderBy("turn_index").collect()
    assert (user.role, user.source, user.content, json.loads(user.framework_metadata_json)["attachment_count"]) == ("user", "human", "Inspect README.md", 2)
    assert (said.role, said.source, said.model, said.output_tokens, json.loads(said.framework_metadata_json)["encrypted_content_present"]) == ("assistant", "model", "gpt-a", 7, True)
    c = {r.tool_call_id: r for r in t["tool_calls"].collect()}
    one, two, three = c["tool-1"], c["tool-2"], c["tool-3"]
    assert (one.operation_type, one.file_path, one.command, one.justification, one.success, one.result, one.emitting_turn_index, one.duration_ms) == ("READ", "README.md", "cat README.md", "Read the README", 1, "# Example", 1, 2000)
    meta = json.loads(one.framework_metadata_json)
    assert meta["permission"]["result"] == "allow" and meta["permission"]["request"]["detailedContent"] == copilot.REDACTED and meta["tool_telemetry"]["sessionLog"] == copilot.REDACTED and meta["model"] == "gpt-tool"
    assert (two.tool_name, two.success, two.error, two.operation_type, two.emitting_turn_index) == ("unknown", 0, "no such file", "EXECUTE", 1)
    assert (three.operation_type, three.success, three.error, three.justification, three.emitting_turn_index, three.file_path) == ("NEW", 0, copilot.NO_COMPLETION, "new one", 1, "/x")
    assert [(r.turn_index, r.tool_call_id, r.ordinal) for r in t["turn_tool_calls"].orderBy("ordinal").collect()] == [(1, "tool-1", 0), (1, "tool-2", 1), (1, "tool-3", 2)]
    events = {r.event_id: r for r in t["events"].collect()}
    assert sorted(r.kind for r in events.values()) == sorted(["session_start", "session_info", "system_message", "assistant_turn_start", "permission_request", "permission_decision", "hook_start", "hook_end", "model_change", "copilot_unknown", "assistant_turn_end", "session_shutdown"])
    told = {r.kind: (r.summary, r.turn_index, r.role, r.tool_call_id) for r in events.values()}
    assert told["session_start"] == ("sess-1", None, "system", None) and told["permission_request"] == ("Read the README", None, "system", "tool-1") and told["permission_decision"] == ("allow", None, "system", "tool-1")
    assert told["hook_end"] == ("post", 1, "system", None) and told["model_change"] == ("gpt-b", 1, "system", None) and told["copilot_unknown"] == ("brand.new", 1, "system", None) and told["assistant_turn_end"] == ("turn-1", None, "assistant", None)
    assert "copilot-permission-requested-perm-1" in events and not any("private" in (r.raw_json or "") + (r.framework_metadata_json or "") for r in events.values())
    assert {(r.annotation_id, r.scope_type, r.target_id) for r in t["annotations"].collect()} == {("ann-copilot-incomplete-tool-tool-3", "tool_call", "tool-3"), ("ann-copilot-bad-json-99", "session", "sess-1")}


def folded(log):
    """Turns' calls, calls' turns and permissions, and events' turns, event by event."""
    turns, calls, pending, out_events = [], {}, {}, []
    turn_of, key_of, by_key, by_turn, waiting, granted = {}, {}, {}, {}, {}, {}
    for x in log:
        d, parent, kind = x["data"], x["parentId"], x["type"]
        key = lambda: f"{d['interactionId']}:{d['turnId']}" if d.get("interactionId") and d.get("turnId") else ""  # noqa: B023, E731
        above_key = key_of.get(parent, "")
        above = turn_of[parent] if parent in turn_of else by_key.get(above_key)
        if kind == "user.message":
            turns.append([])
        elif kind == "assistant.message":
            k, n = key(), len(turns)
            turns.append([])
            if d.get("turnId"):
                by_turn[d["turnId"]] = n
            if k:
                by_key[k] = n
                turns[n] += waiting.get(k, [])
                for c in waiting.get(k, []):
                    if c in calls:
                        calls[c]["turn"] = n
                key_of[x["id"]] = k
            turn_of[x["id"]] = n
        elif kind == "assistant.turn_start":
            if key():
                key_of[x["id"]] = key()
        elif kind == "tool.execution_start":
            c = d["toolCallId"]
            k = above_key or key()
            pending[c] = {"turn": above, "key": k, "turn_id": d.get("turnId"), "granted": granted.get(c)}
            if above is not None:
                turns[above] += [c] if c not in turns[above] else []
                turn_of[x["id"]] = above
            if k:
                waiting.setdefault(k, [])
                waiting[k] += [c] if c not in waiting[k] else []
                key_of[x["id"]] = k
        elif kind == "tool.execution_complete":
            c = d["toolCallId"]
            p = pending.pop(c, None) or {"turn": above, "key": above_key or key(), "turn_id": d.get("turnId"), "granted": granted.get(c)}
            at = next((v for v in (p["turn"], by_key.get(p["key"]), by_turn.get(p["turn_id"])) if v is not None), None)
            calls[c] = {"turn": at, "granted": dict(p["granted"]) if p["granted"] else None}
            if at is not None:
                turns[at] += [c] if c not in turns[at] else []
                turn_of[x["id"]] = at
            elif p["key"]:
                waiting.setdefault(p["key"], [])
                waiting[p["key"]] += [c] if c not in waiting[p["key"]] else []
        else:
            if kind == "permission.requested":
                granted[d["permissionRequest"]["toolCallId"]] = g = {"request": d["permissionRequest"]["intention"], "result": None}
                if d["permissionRequest"]["toolCallId"] in pending:
                    pending[d["permissionRequest"]["toolCallId"]]["granted"] = g
            elif kind == "permission.completed" and d["toolCallId"] in granted:
                granted[d["toolCallId"]]["result"] = d["result"]["kind"]
            elif kind == "permission.completed" and d["toolCallId"] in pending:
                pending[d["toolCallId"]]["granted"] = pending[d["toolCallId"]]["granted"] or {"request": None, "result": None}
                pending[d["toolCallId"]]["granted"]["result"] = d["result"]["kind"]
            if above is not None:
                turn_of[x["id"]] = above
            if above_key:
                key_of[x["id"]] = above_key
            out_events.append((x["id"], above))
    for c in sorted(pending):
        p = pending[c]
        at = next((v for v in (p["turn"], by_key.get(p["key"]), by_turn.get(p["turn_id"])) if v is not None), None)
        calls[c] = {"turn": at, "granted": p["granted"]}
        if at is not None:
            turns[at] += [c] if c not in turns[at] else []
    return turns, calls, out_events


def made(rng, n):
    log, ids, open_ = [], [], []
    for i in range(n):
        parent = rng.choice(ids[-4:] + [None]) if ids else None
        scope = {"interactionId": rng.choice(["a", "b", "c", ""]), "turnId": rng.choice(["0", "1", ""])}
        kind = rng.choice(["user.message", "assistant.message", "assistant.turn_start", "hook.start", "tool.execution_start", "tool.execution_start", "tool.execution_complete", "tool.execution_complete", "permission.requested", "permission.completed"])
        call = f"t{i}" if kind == "tool.execution_start" else rng.choice(open_[-3:] or [f"u{i}"])
        if kind == "tool.execution_start":
            open_.append(call)
        if kind == "tool.execution_complete":
            call = open_.pop(rng.randrange(len(open_))) if open_ and rng.random() < 0.8 else f"u{i}"
        data = {"permission.requested": {"requestId": f"q{i}", "permissionRequest": {"toolCallId": call, "intention": f"want {i}"}}, "permission.completed": {"requestId": f"q{i}", "toolCallId": call, "result": {"kind": rng.choice(["yes", "no"])}}}.get(kind, scope | ({"toolCallId": call} if kind.startswith("tool") else {}))
        log.append(event(kind, f"e{i}", parent, i, **data))
        ids.append(f"e{i}")
    return log


def test_places_and_permissions_against_a_fold(spark):
    rng = random.Random(12)
    logs = {f"/logs/s{i}/events.jsonl": made(rng, rng.choice([5, 30, 80])) for i in range(30)}
    t = copilot.convert(lines(spark, logs))
    calls, listed, events = {}, {}, {}
    for r in t["tool_calls"].collect():
        g = json.loads(r.framework_metadata_json).get("permission")
        calls[r.session_id, r.tool_call_id] = (r.emitting_turn_index, g and ((g.get("request") or {}).get("intention"), g.get("result")))
    for r in t["turn_tool_calls"].collect():
        listed.setdefault((r.session_id, r.turn_index), set()).add(r.tool_call_id)
    for r in t["events"].collect():
        if r.kind in ("hook_start", "permission_request", "permission_decision"):
            events[r.session_id, json.loads(r.raw_json)["id"]] = r.turn_index
    n = 0
    for path, log in logs.items():
        s = path.split("/")[2]
        want_turns, want_calls, want_events = folded(log)
        for c, w in want_calls.items():
            n += 1
            assert calls[s, c] == (w["turn"], w["granted"] and (w["granted"]["request"], w["granted"]["result"])), (s, c)
        for i, w in enumerate(want_turns):
            assert listed.get((s, i), set()) == set(w), (s, i)
        for e, at in want_events:
            assert events[s, e] == at, (s, e)
    assert n == len(calls) > 100


def test_empty_and_odd_logs(spark):
    none = copilot.convert(spark.createDataFrame([], "path string, line_no long, value string"))
    assert all(df.count() == 0 for df in none.values())
    odd = copilot.convert(lines(spark, {"x": [{"type": "user.message"}, {"type": None, "data": []}, {"data": {"content": 5}}, {"type": "tool.execution_complete", "data": {}}, {"type": "tool.execution_start", "data": {"arguments": "text"}}]}))
    assert odd["sessions"].first().session_id == "copilot-session" and odd["tool_calls"].count() == 2 and odd["turns"].count() == 1
    assert copilot.operation(F.lit("x"), F.lit("y"), F.lit(None), F.lit(None)) is not None
