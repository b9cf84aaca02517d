"""Listing on executors and the locators of each framework, against what the folders hold."""

import json
import os

import pytest
from loomspark.sources import discovery as D


def put(path, *rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def found(df):
    return {(r.id, r.format_hint, r.source_path, r.cwd, r.started_at, r.parent_session_id) for r in df.collect()}


A, B, C = "a" * 36, "b" * 36, "c" * 36


@pytest.mark.parametrize("spread", [0, 2])
def test_listing_is_what_a_walk_finds(spark, tmp_path, spread):
    for i in range(5):
        put(f"{tmp_path}/d{i}/e{i}/f/g/x{i}.jsonl", "{}")
    put(f"{tmp_path}/top ü.txt", "x")
    os.makedirs(f"{tmp_path}/empty")
    want = {(os.path.join(d, n), n in ds) for d, ds, fs in os.walk(tmp_path) for n in ds + fs}
    got = D.listing(spark, [str(tmp_path)], spread).collect()
    assert {(r.path, r.is_dir) for r in got} == want and len(got) == len(want)
    # by an address, and below two roots
    both = D.listing(spark, [f"file://{tmp_path}/d0", f"file://{tmp_path}/d1/"], spread).where("not is_dir").collect()
    assert {(r.root, r.path) for r in both} == {(f"file://{tmp_path}/d{i}", f"file://{tmp_path}/d{i}/e{i}/f/g/x{i}.jsonl") for i in (0, 1)}
    with pytest.raises(Exception, match="nowhere"):
        D.listing(spark, [f"{tmp_path}/nowhere"]).count()


def test_claude_code(spark, tmp_path):
    t = str(tmp_path)
    put(f"{t}/p1/{A}.jsonl", {"type": "file-history-snapshot"}, "{broken", {"cwd": "", "timestamp": "t0"}, {"cwd": "/w", "timestamp": "t1"}, {"cwd": "/later"})
    put(f"{t}/p1/{B}.jsonl", {"cwd": "/one"})
    put(f"{t}/p2/{B}.jsonl", {"cwd": "/two"})
    put(f"{t}/p1/short.jsonl", {"cwd": "/no"})
    put(f"{t}/p1/{A}/tool-results/1.txt", "x")  # its log is there
    put(f"{t}/p1/{C}/tool-results/1.txt", "x")
    put(f"{t}/p1/{A}/subagents/agent-1.jsonl", {"cwd": "/w"})
    put(f"{t}/p1/{A}/subagents/deep/subagents/agent-2.jsonl", {})
    assert found(D.discover(spark, "claude-code", [t])) == {
        (A, "jsonl-v2", f"{t}/p1/{A}.jsonl", "/w", "t1", None), (B, "jsonl-v2", f"{t}/p2/{B}.jsonl", "/two", None, None), (C, "dir-v1", f"{t}/p1/{C}", None, None, None),
        ("agent-1", "subagent", f"{t}/p1/{A}/subagents/agent-1.jsonl", None, None, A), ("agent-2", "subagent", f"{t}/p1/{A}/subagents/deep/subagents/agent-2.jsonl", None, None, A),
    }


def test_codex_and_pi(spark, tmp_path):
    t = str(tmp_path)
    put(f"{t}/x/sessions/2024/r1.jsonl", "", {"type": "session_meta", "payload": {"cwd": "/c", "timestamp": "p"}}, {"type": "session_meta", "payload": {"cwd": "/d"}})
    put(f"{t}/x/sessions/r2.jsonl", {"type": "thread.started"})
    put(f"{t}/x/sessions/r3.jsonl", *[{"type": "noise"}] * 5, {"type": "event_msg"})
    put(f"{t}/x/other/r4.jsonl", {"type": "session_meta"})
    put(f"{t}/y/2024/r5.jsonl", {"type": "session_meta", "timestamp": "s", "payload": {"timestamp": "p"}})
    s = f"{t}/x/sessions"
    assert found(D.discover(spark, "codex", [f"{t}/x", f"{t}/y"])) == {
        ("r1", "session-jsonl-v1", f"{s}/2024/r1.jsonl", "/c", "p", None), ("r2", "exec-jsonl-v1", f"{s}/r2.jsonl", None, None, None), ("r3", "unknown-jsonl", f"{s}/r3.jsonl", None, None, None),
        ("r5", "session-jsonl-v1", f"{t}/y/2024/r5.jsonl", None, "s", None),
    }
    put(f"{t}/pi/2024_01_abc.jsonl", {"type": "session", "cwd": "/q", "timestamp": "1"})
    put(f"{t}/pi/plain.jsonl", "x" * 300_000)
    put(f"{t}/pi/ends_.jsonl", {"type": "message"})
    assert {(r.id, r.cwd, r.started_at) for r in D.discover(spark, "pi", [f"{t}/pi"]).collect()} == {("abc", "/q", "1"), ("plain", None, None), ("ends_", None, None)}


def test_copilot(spark, tmp_path):
    t = str(tmp_path)
    for name, yaml in {"s1": 'id: "real"\ncwd: /w # here\ncreated_at: 2024-01-02T03:04:05.5+01:00\nmore:\n  id: inner', "s2": "id: ''\ncreated_at: '2024-01-02'", "s3": None}.items():
        put(f"{t}/h/session-state/{name}/events.jsonl", "{}")
        if yaml:
            put(f"{t}/h/session-state/{name}/workspace.yaml", yaml)
    put(f"{t}/h/session-state/none/workspace.yaml", "id: x")
    put(f"{t}/h/session-state/s3/deeper/events.jsonl", "{}")
    put(f"{t}/h/beside/events.jsonl", "{}")
    rows = {(r.id, r.cwd, r.started_at, r.source_path[len(t) :]) for r in D.discover(spark, "copilot", [f"{t}/h"]).collect()}
    assert rows == {("real", "/w", "2024-01-02T02:04:05Z", "/h/session-state/s1/events.jsonl"), ("s2", None, "2024-01-02", "/h/session-state/s2/events.jsonl"), ("s3", None, None, "/h/session-state/s3/events.jsonl")}
    assert [r.id for r in D.discover(spark, "copilot", [f"{t}/h/session-state/s1", f"{t}/h/beside"]).orderBy("id").collect()] == ["beside", "real"]
    os.makedirs(f"{t}/void")
    for name in D.FRAMEWORKS:
        assert D.discover(spark, name, [f"{t}/void"]).collect() == []
    with pytest.raises(ValueError):
        D.discover(spark, "other", [t])
