"""Turn stores against a fold over dictionaries, on made-up snapshots."""

import json
import random
import sqlite3

import pytest
from loomspark.sources import turn_store as S
from loomspark.sources.archives import SourceSet
from loomspark.sources.importing import load_set

KINDS = ["llm_text", "user", "system", "reasoning", "tool_call", "tool_use", "other"]


def made_up(seed, bad=False):
    """A store whose turns repeat and extend the blocks of the turns before."""
    rng = random.Random(seed)
    turns, members, blocks = [], [], {}
    for conv in ("c1", "c2", "c3"):
        known = []
        for turn in range(rng.randint(2, 6)):
            run = f"run{rng.randint(0, 2)}"
            turns.append((conv, run, f"t{turn}", 1_700_000_000_000 + rng.randint(0, 3) * 60_000, rng.choice(["", "gpt-5", "cerebras-x", "local"]), "", "{}", "{}"))
            for _ in range(rng.randint(1, 9)):
                kind, n = rng.choice(KINDS), len(blocks)
                key = f"k{rng.randint(0, 4)}"
                payload = {
                    "tool_call": {"id": key, "name": rng.choice(["", "ls", "cat"]), "args": {"a": n}}, "tool_use": {"id": key, "result": rng.choice(["ok", {"x": 1}, None, "é" * 9000]), "error": rng.choice(["", "boom"])},
                    "system": {"text": rng.choice(["You are an assistant", "rules"])}, "user": {"text": rng.choice(["hello\nthere", "<currentMode>x", " ", "a <agent:agent_mode_switch:v1>"])}, "reasoning": {"text": rng.choice(["", "think", "more"])},
                }.get(kind, {"text": f"says {n}"} if rng.random() < 0.8 else {"other": n})
                blocks[(f"b{n}", f"h{n}")] = (kind, kind, json.dumps(payload))
                known.append((f"b{n}", f"h{n}"))
            for phase in rng.sample([*S.PHASES, "odd", "even"], rng.randint(1, 4)):
                part = known[: rng.randint(max(1, len(known) - 3), len(known))]
                at = 5_000 + rng.randint(0, 3) * 1000 + turn
                members += [(conv, run, f"t{turn}", phase, at, i, *b) for i, b in enumerate(part)]
    turns.append(("none", "r", "t", 1, "", "", "{}", "{}"))
    if bad:
        blocks[("bx", "hx")] = ("tool_call", "", "{}")
        turns.append(("broken", "r", "t", 5, "", "", "{}", "{}"))
        members.append(("broken", "r", "t", "final", 1, 0, "bx", "hx"))
    return turns, members, [(*k, *v, "{}") for k, v in blocks.items()]


def fold(turns, members, blocks):
    """What the store holds, by hand: {conv: (turns, calls, notes)}."""
    body = {b[:2]: b[2:] for b in blocks}
    snaps = {}
    for m in members:
        snaps.setdefault(m[:3], {}).setdefault((m[3], m[4]), []).append((m[5], m[6], m[7]))
    out = {}
    for conv in sorted({t[0] for t in turns}):
        mine = sorted((t for t in turns if t[0] == conv and t[:3] in snaps), key=lambda t: (t[3], t[1], t[2]))
        seen, runs, said, calls, notes = set(), set(), [], {}, []
        for t in mine:
            kinds = snaps[t[:3]]
            best = next(([k for k in kinds if k[0] == p] for p in S.PHASES if any(k[0] == p for k in kinds)), list(kinds))
            phase, at = max(best, key=lambda k: (k[1], [-ord(x) for x in k[0]]))
            if t[1] not in runs and runs:
                notes.append(("session-change", "session"))
            runs.add(t[1])
            new = []
            for o, b, h in sorted(kinds[(phase, at)]):
                kind, role, payload = body[(b, h)][:3]
                payload = json.loads(payload)
                who = f"{kind}|{payload['id']}" if kind in ("tool_call", "tool_use") else f"{kind}|{role}|{h if kind == 'system' else b}"
                if who not in seen:
                    seen.add(who)
                    new.append((kind, payload))
            thinking, assistant, pending, loose, late = [], None, {}, [], []
            for kind, p in new:
                text = p["text"] if "text" in p else json.dumps(p)
                if kind == "reasoning":
                    thinking += [text] if text.strip() else []
                elif kind == "tool_call":
                    calls[p["id"]] = {"turn": assistant, "name": p["name"] or "unknown", "ok": 0, "result": None, "error": S.PENDING}
                    pending[p["id"]] = 1
                    loose += [p["id"]] if assistant is None else []
                elif kind == "tool_use":
                    if pending.pop(p["id"], None):
                        r = p["result"]
                        calls[p["id"]] |= {"ok": int(not p["error"]), "result": "" if r is None else r if isinstance(r, str) else json.dumps(r, separators=(",", ":")), "error": p["error"] or None}
                    else:
                        late.append(("tool-use-orphan", "session"))
                elif kind != "other":
                    control = kind == "user" and ("<currentMode>" in text or "agent_mode_switch" in text)
                    role = {"llm_text": "assistant", "system": "system", "user": "system" if control else "user"}[kind]
                    source = {"llm_text": "model", "system": "system" if text == S.SYSTEM_PROMPT else "framework", "user": "framework" if control else "human"}[kind]
                    said.append((len(said), role, source, text, "\n\n".join(thinking) if role == "assistant" and thinking else None, t[4] or None))
                    if role == "assistant":
                        thinking, assistant = [], len(said) - 1
                        for k in loose:
                            calls[k]["turn"] = assistant
                        loose = []
            notes += late + [("tool-call-pending", k) for k in pending] + [("snapshot", phase, len(new))]
        if mine:
            out[conv] = (said, calls, notes)
    return out


def frames(spark, store, path="x"):
    from pyspark.sql import functions as F

    return {name: spark.createDataFrame(rows, ddl).withColumn("path", F.lit(path)) for (name, ddl), rows in zip(S.STORE.items(), store)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_a_fold(spark, seed):
    store = made_up(seed, bad=seed == 3)
    tables, bad = S.convert(frames(spark, store), "agent")
    want = fold([t for t in store[0] if t[0] != "broken"], *store[1:])
    assert [(r.conv_id, r.message) for r in bad.collect()] == ([("broken", "tool_call block without an identity")] if seed == 3 else [])
    got = {name: df.collect() for name, df in tables.items()}
    assert sorted(r.session_id for r in got["sessions"]) == sorted(want)
    for conv, (said, calls, notes) in want.items():
        mine = lambda name: [r for r in got[name] if r.session_id == conv]  # noqa: B023, E731
        assert sorted((r.turn_index, r.role, r.source, r.content, r.thinking, r.model) for r in mine("turns")) == said
        ordered = sorted(mine("tool_calls"), key=lambda r: r.source_ordinal)
        assert [r.tool_call_id for r in ordered] == list(calls)
        for i, (r, w) in enumerate(zip(ordered, calls.values())):
            whole = w["result"] or ""
            assert (r.emitting_turn_index, r.tool_name, r.success, r.error) == (w["turn"], w["name"], w["ok"], w["error"])
            if len(whole.encode()) > 10240:
                assert r.truncated == 1 and r.full_bytes == len(whole.encode()) and r.result.startswith(whole[:5000])
            else:
                assert r.result == w["result"] and r.truncated == 0
            assert json.loads(r.tools_before_json) == [x.tool_name for x in ordered[max(0, i - 5) : i]]
        told = sorted(mine("annotations"), key=lambda r: int(r.annotation_id.rsplit("-", 1)[1]))
        plain = [("snapshot", json.loads(r.detail)["phase"], json.loads(r.detail)["new_block_count"]) if r.title.startswith("Canonical") else (r.annotation_id.removeprefix("ann-").rsplit("-", 1)[0], r.target_id) for r in told]
        assert plain == notes and [int(r.annotation_id.rsplit("-", 1)[1]) for r in told] == list(range(len(notes)))
        head = mine("sessions")[0]
        human = [s[3] for s in said if s[2] == "human" and s[3].strip()]
        assert head.title == (human[0].replace("\n", " ").strip() if human else None) and head.turn_count == len(said) and head.tool_call_count == len(calls)
        links = [(r.turn_index, r.tool_call_id) for r in mine("turn_tool_calls")]
        assert sorted(links) == sorted((w["turn"], k) for k, w in calls.items() if w["turn"] is not None)


def test_stores_of_sqlite_and_empty_ones(spark, tmp_path):
    store, file = made_up(5), f"{tmp_path}/turns.db"
    with sqlite3.connect(file) as db:
        for (name, ddl), rows in zip(S.STORE.items(), store):
            db.execute(f"CREATE TABLE {name} ({', '.join(c.split()[0] for c in ddl.split(', '))})")
            db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(ddl.split(', ')))})", rows)
    tables, bad = S.convert(S.read_store(spark, [file]))
    assert {r.session_id for r in tables["sessions"].collect()} == set(fold(*store)) and bad.count() == 0
    assert {r.source_path for r in tables["sessions"].collect()} == {file}
    loaded, told = load_set(spark, SourceSet().files([file]).content("{", "bad"))
    assert {r.session_id for r in loaded["sessions"].collect()} == set(fold(*store)) and [r.path for r in told.collect()] == ["bad"]
    assert loaded["tool_calls"].count() == tables["tool_calls"].count()
    empty, _ = S.convert(frames(spark, ([], [], [])))
    assert all(df.count() == 0 for df in empty.values())
