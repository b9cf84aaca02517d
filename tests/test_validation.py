"""Every kind of drift of an archive planted once, and found where it lies."""

import hashlib
import json
import os

import pytest
from loomspark.sources import validation as V
from loomspark.sources.archives import SourceError

PERIOD = "2024-01"


def put(path, doc):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(doc if isinstance(doc, str) else json.dumps(doc))
    return os.path.getsize(path)


def session(root, key, period=PERIOD, name=None, started="2024-01-05T00:00:00Z", **provenance):
    path = f"{root}/active/{period}/{name or key}{V.SUFFIX}"
    size = put(path, {"id": key, "timing": {"started_at": started}, "provenance": provenance})
    return {"id": key, "period": period, "file_path": f"{name or key}{V.SUFFIX}", "file_size_bytes": size}


def manifests(root, entries, count=None, **root_more):
    put(f"{root}/active/{PERIOD}/manifest.json", {"period": PERIOD, "sessions": entries})
    put(f"{root}/manifest.json", {"periods": [{"period": PERIOD, "path": f"active/{PERIOD}/manifest.json", "session_count": len(entries) if count is None else count}], **root_more})


def receipt(root, **over):
    doc = {"schema": f"any-{V.RECEIPT_SCHEMA}", "adapter": "pi", "started_at": "a", "finished_at": "b", "output_dir": f"{root}/active", "complete": True, "outputs": [], "failures": [], "summary": {"requested": 0, "published": 0, "failed": 0}}
    return doc | over


def codes(df, root):
    return [(r.code, r.path[len(root) + 1 :], r.session_id) for r in df.collect()]


def test_a_sound_archive_has_no_findings(spark, tmp_path):
    t = str(tmp_path)
    with open(f"{t}/src.jsonl", "wb") as f:
        f.write(b"x" * 3_000_000)
    sha = hashlib.sha256(b"x" * 3_000_000).hexdigest()
    entries = [session(t, "a", source_path=f"{t}/src.jsonl", source_fingerprint=sha), session(t, "b c", name="b_c"), session(t, "..", name="unknown")]
    manifests(t, entries)
    put(f"{t}/runs/r.json", receipt(t, outputs=[{"session_id": "a", "path": f"{PERIOD}/a{V.SUFFIX}", "status": "created"}], summary={"requested": 1, "published": 1, "failed": 0}))
    for place in (t, f"{t}/active/{PERIOD}", f"file://{t}"):
        assert V.validate(spark, place).collect() == []
    got = {r.session_id: (r.in_archive, r.in_manifest, r.in_receipt) for r in V.reconcile(spark, t).collect()}
    assert got == {"a": (True, True, True), "b c": (True, True, False), "..": (True, True, False)}
    with pytest.raises(SourceError):
        V.archive_root("/nowhere/at/all")
    with pytest.raises(ValueError):
        V.validate(spark, t, ["other"])


def test_drift_of_files_and_manifests(spark, tmp_path):
    t = str(tmp_path)
    a, moved = session(t, "a"), session(t, "m", period="2024-02", started="2024-01-09")
    session(t, "a", name="copy")
    session(t, "lost")
    late = session(t, "u", period="unknown", started="soon")
    put(f"{t}/active/{PERIOD}/bad{V.SUFFIX}", "[1]")
    put(f"{t}/active/{PERIOD}/worse{V.SUFFIX}", "{")
    entries = [a | {"file_size_bytes": 1}, {"id": "gone", "file_path": "x"}, moved, late | {"file_path": f"sub/{late['file_path']}"}]
    manifests(t, entries, count=9)
    at, here = f"active/{PERIOD}", f"active/{PERIOD}/manifest.json"
    want = [
        ("orphan-manifest-entry", here, "gone"), ("manifest-size-mismatch", here, "a"), ("manifest-period-mismatch", here, "m"), ("manifest-period-mismatch", here, "u"), ("manifest-path-mismatch", here, "u"),
        ("archive-json-invalid", f"{at}/bad{V.SUFFIX}", ""), ("archive-json-invalid", f"{at}/worse{V.SUFFIX}", ""), ("duplicate-archive-id", f"{at}/copy{V.SUFFIX}", "a"), ("archive-filename-id-mismatch", f"{at}/copy{V.SUFFIX}", "a"),
        ("orphan-archive", f"{at}/lost{V.SUFFIX}", "lost"), ("archive-period-mismatch", f"active/2024-02/m{V.SUFFIX}", "m"), ("root-manifest-count-mismatch", "manifest.json", ""),
    ]
    got = codes(V.validate(spark, t), t)
    assert sorted(got) == sorted(want)
    assert [(p, c) for c, p, _ in got] == sorted((p, c) for c, p, _ in got)
    assert {c for c, _, _ in codes(V.validate(spark, t, ["archive"]), t)} == {"archive-json-invalid", "duplicate-archive-id", "archive-filename-id-mismatch", "archive-period-mismatch"}
    put(f"{t}/manifest.json", {"periods": [{"period": "x", "path": here, "session_count": 4}, {"period": "y", "path": "no.json"}, {"period": "z", "path": "sub/broken.json"}]})
    put(f"{t}/sub/broken.json", "{")
    got = {(c, p) for c, p, _ in codes(V.validate(spark, t, ["manifest"]), t)}
    assert {("period-manifest-period-mismatch", here), ("period-manifest-missing", "no.json"), ("period-manifest-invalid", "sub/broken.json")} <= got
    for text, code in (("nope", "root-manifest-invalid"), (None, "root-manifest-missing")):
        os.remove(f"{t}/manifest.json")
        if text:
            put(f"{t}/manifest.json", text)
        got = codes(V.validate(spark, t, ["manifest"]), t)
        assert (code, "manifest.json", "") in got and sum(c == "orphan-archive" for c, _, _ in got) == 4


def test_sources_and_receipts(spark, tmp_path):
    t = str(tmp_path)
    put(f"{t}/s.jsonl", "x")
    put(f"{t}/active/{PERIOD}/there.txt", "x")
    session(t, "a", source_path=f"{t}/s.jsonl")
    session(t, "b", source_path=f"{t}/s.jsonl", source_fingerprint="0")
    session(t, "c", source_path=f"{t}/none.jsonl", source_fingerprint="0")
    got = [(r.code, r.severity, r.session_id) for r in V.validate(spark, t, ["source"]).collect()]
    assert got == [("source-fingerprint-missing", "warning", "a"), ("source-fingerprint-mismatch", "error", "b"), ("source-unavailable", "info", "c")]
    out = lambda k, p, s="created": {"session_id": k, "path": p, "status": s}
    bad = {
        "1": {"adapter": "", "complete": None}, "2": {"summary": {"requested": 2, "published": 1, "failed": 1}}, "3": {"summary": {"requested": -1, "published": 0, "failed": 0}},
        "4": {"failures": [{"stage": "s", "error": "e"}], "summary": {"requested": 1, "published": 0, "failed": 1}}, "5": {"complete": False},
        "6": {"outputs": [out("", "x"), out("k", "x", "odd"), out("k", f"{PERIOD}/there.txt"), out("k", "missing"), out("q", "/no/such")], "summary": {"requested": 5, "published": 5, "failed": 0}},
        "7": {"complete": False, "failures": [{"stage": "", "error": "e"}], "summary": {"requested": 1, "published": 0, "failed": 1}}, "8": {"schema": "other", "adapter": ""},
    }
    for name, over in bad.items():
        put(f"{t}/runs/{name}.json", receipt(t, **over))
    put(f"{t}/runs/not.json", "{")
    rows = V.validate(spark, t, ["receipt"]).collect()
    found = sorted((os.path.basename(r.path)[0], r.code.removeprefix("conversion-receipt-"), r.session_id, r.detail.split()[-1]) for r in rows)
    assert found == sorted([
        ("1", "invalid", "", "state"), ("2", "invalid", "", "failures"), ("3", "invalid", "", "results"), ("4", "invalid", "", "failures"), ("5", "invalid", "", "failure"),
        ("6", "invalid", "", "status"), ("6", "invalid", "", "status"), ("6", "output-missing", "k", "missing"), ("6", "output-missing", "q", "/no/such"), ("7", "invalid", "", "detail"),
    ])
