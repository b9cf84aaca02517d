import json
import random
from collections import Counter

from loomspark.sources import inspection

FIELDS = "path string, line_no long, byte_offset long, raw_bytes long, value string, diagnostic string"


def as_records(spark, logs):
    rows = []
    for path, log in logs.items():
        at = 0
        for n, x in enumerate(log, 1):
            raw = json.dumps(x) + "\n"
            rows.append((path, n, at, len(raw), raw, None))
            at += len(raw)
    return spark.createDataFrame(rows, FIELDS)


def folded(log):
    """One pass in order, with references copied from request to request."""
    blobs, shapes, odd_blobs, odd_shapes, first, out, diagnostics = {}, {}, set(), set(), {}, [], []
    text = lambda v: v if isinstance(v, str) else ""
    for line, d in enumerate(log, 1):
        kind = text(d.get("type"))
        if kind in (inspection.BLOB, inspection.SHAPE):
            held, odd, key, of = (blobs, odd_blobs, "hash", "message") if kind == inspection.BLOB else (shapes, odd_shapes, "shapeHash", "shape")
            key = text(d.get(key))
            if not key:
                diagnostics.append((line, "missing_identity"))
            elif key not in held:
                held[key] = (line, d.get(of))
            elif held[key][1] != d.get(of):
                odd.add(key)
                diagnostics.append((line, "duplicate_identity"))
        if kind != inspection.REQUEST:
            continue
        said, refs, base_line, kept = [], [], None, 0
        if not text(d.get("id")):
            said.append("unsupported")
        if text(d.get("shapeHash")) not in shapes:
            said.append("missing_shape")
        if text(d.get("shapeHash")) in odd_shapes:
            said.append("unsupported")
        keep = d.get("keep")
        if type(keep) is not int or not 0 <= keep < 2**63:
            said.append("unsupported")
        elif keep:
            base = first.get(text(d.get("base")))
            if base is None or keep > len(out[base]["refs"]):
                said.append("missing_base")
            else:
                refs, base_line, kept = out[base]["refs"][:keep], out[base]["line"], keep
                if any(c in inspection.INCOMPLETE for c in out[base]["said"]):
                    said.append("missing_base")
        tail = d.get("tail")
        if not isinstance(tail, list):
            said.append("unsupported")
        for ref in tail if isinstance(tail, list) else ():
            if isinstance(ref, str):
                refs = [*refs, ref]
            else:
                said.append("unsupported")
        of_refs = [(p, r, r not in blobs, r in odd_blobs) for p, r in enumerate(refs)]
        for _, _, missing, odd in of_refs:
            said += ["unsupported"] * odd + ["missing_blob"] * missing
        if text(d.get("id")) in first:
            said.append("unsupported")
        out.append({"line": line, "refs": refs, "said": said, "of_refs": of_refs, "base_line": base_line, "kept": kept})
        if text(d.get("id")):
            first.setdefault(d["id"], len(out) - 1)
    return out, diagnostics, blobs, shapes


def check(spark, logs, expand=True):
    got = inspection.inspect(as_records(spark, logs))
    requests = {(r.path, r.line_no): r for r in got.requests.collect()}
    assert got.requests.count() == len(requests)
    expanded = {}
    if expand:
        for r in got.expand(got.requests).collect():
            expanded.setdefault((r.path, r.line_no), []).append((r.position, r.ref, r.missing, r.ambiguous))
    told = Counter((r.path, r.line_no, r.code) for r in got.diagnostics.collect())
    objects = {(r.path, r.kind, r.key): r.line_no for r in got.objects.collect()}
    want_told, want_objects, n, digests = Counter(), {}, 0, {}
    for path, log in logs.items():
        fold, diagnostics, blobs, shapes = folded(log)
        want_told.update((path, line, code) for line, code in diagnostics)
        want_objects |= {(path, inspection.BLOB, k): line for k, (line, _) in blobs.items()} | {(path, inspection.SHAPE, k): line for k, (line, _) in shapes.items()}
        for w in fold:
            n += 1
            r = requests[path, w["line"]]
            assert (r.status, r.n_refs, r.base_line, r.keep) == ((w["said"] or ["complete"])[0], len(w["refs"]), w["base_line"], w["kept"]), (path, w["line"], r)
            own = [c for c in w["said"]]
            assert set(own) == {d.code for d in r.diagnostics}
            if expand:
                assert sorted(expanded.get((path, w["line"]), [])) == w["of_refs"]
            assert digests.setdefault(r.refs_digest, tuple(w["refs"])) == tuple(w["refs"])
    assert n == len(requests) and told == want_told and objects == want_objects
    return got


def made(rng, n):
    log, ids = [], []
    for _ in range(n):
        p = rng.random()
        ref = lambda: rng.choice("abcdefghijklmnop")
        if p < 0.25:
            log.append({"type": inspection.BLOB, "hash": rng.choice([ref(), ref(), ref(), "", 5]), "message": {"x": rng.choice([1, 1, 1, 1, 1, 1, 2]), "y": [None]}})
        elif p < 0.32:
            log.append({"type": inspection.SHAPE, "shapeHash": rng.choice(["s", "s", "t", ""]), "shape": rng.choice([{"a": 1, "b": 2}, {"b": 2, "a": 1}, {"a": 1, "b": 2}, {"a": 3}])})
        else:
            new = f"r{len(ids)}"
            base = rng.choice(ids[-3:]) if ids and rng.random() < 0.8 else rng.choice(["none", None, 7, *ids[:5]])
            log.append({
                "type": inspection.REQUEST, "id": rng.choice([new] * 12 + [None, *ids[:1]]), "querySource": "main", "shapeHash": rng.choice(["s", "s", "s", "s", "t", None]), "base": base,
                "keep": rng.choice([0, 1, 1, 2, 2, 3, 4, 5, 6, 8, -1, 0.5, "1", None, 2**63] if rng.random() < 0.3 else [0, 1, 2, 3, 4, 5]),
                "tail": rng.choice([[ref()], [ref(), ref()], [ref()], [], [ref(), {}, ref()], "x", [None]] if rng.random() < 0.3 else [[ref()], [ref(), ref()], [ref(), ref(), ref()]]),
            })
            ids.append(new)
    return log


def test_random_logs_against_a_fold(spark):
    rng = random.Random(8)
    check(spark, {f"log{i}": made(rng, rng.choice([3, 40, 120])) for i in range(40)} | {"none": [{"type": "x"}]})


def test_known_cases_and_compactions(spark):
    shape, request = {"type": inspection.SHAPE, "shapeHash": "s"}, lambda **x: {"type": inspection.REQUEST, "shapeHash": "s", **x}
    user, assistant = lambda u, **x: {"type": "user", "uuid": u, **x}, lambda u, **x: {"type": "assistant", "uuid": u, **x}
    boundary = lambda u, **x: {"type": "system", "subtype": "compact_boundary", "uuid": u, **x}
    one = [
        shape | {"shape": {"system": []}}, {"type": inspection.BLOB, "hash": "a", "message": {"content": "hello"}}, request(id="r1", querySource="main", keep=0, tail=["a"]), {"type": inspection.BLOB, "hash": "b", "message": {"content": "world"}},
        request(id="r2", base="r1", keep=1, tail=["b"]), request(id="r3", base="missing", keep=1, tail=["lost"]), {"type": inspection.REQUEST, "id": "r4", "shapeHash": "no-shape", "keep": 0, "tail": [{}]},
        assistant("old"), boundary("boundary", logicalParentUuid="later", compactMetadata={"preservedSegment": {"headUuid": "old"}}), user("summary", parentUuid="boundary", isCompactSummary=True), {"type": "attachment", "uuid": "later"}, assistant("new", parentUuid="later"), user("after", isCompactSummary=True),
    ]
    two = [boundary("b1"), boundary("b2"), user("u1", isCompactSummary=True), user("u2", isCompactSummary="true"), user("u3", isCompactSummary=True), boundary("b3"), user("u4"), boundary("b4", compactMetadata=[1])]
    future = [shape, request(id="r", keep=0, tail=["future"]), {"type": inspection.BLOB, "hash": "future", "message": {}}, request(id="bad", keep=0.5, tail=[])]
    got = check(spark, {"one": one, "two": two, "future": future})
    by = {(r.path, r.id): r.status for r in got.requests.collect()}
    assert [by[k] for k in (("one", "r2"), ("one", "r3"), ("one", "r4"), ("future", "r"), ("future", "bad"))] == ["complete", "missing_base", "missing_shape", "missing_blob", "unsupported"]
    uuid = lambda m: m and m.uuid
    c = {r.boundary.uuid: (uuid(r.before_message), uuid(r.first_following_message), uuid(r.first_following_assistant), r.logical_parent_uuid) for r in got.compactions.collect()}
    assert c == {"boundary": ("old", "summary", "new", "later"), "b1": (None, None, None, ""), "b2": (None, "u1", None, ""), "b3": ("u3", "u4", None, ""), "b4": ("u4", None, None, "")}
    assert {(r.path, r.boundary_line, r.uuid) for r in got.summaries.collect()} == {("one", 9, "summary"), ("two", 2, "u1"), ("two", 2, "u3")}
    meta = {r.boundary.uuid: r.metadata for r in got.compactions.collect()}
    assert json.loads(meta["boundary"]) == {"preservedSegment": {"headUuid": "old"}} and meta["b4"] is None
    at = {r.boundary.uuid: r.boundary.byte_offset for r in got.compactions.collect()}
    assert at["boundary"] == sum(len(json.dumps(x)) + 1 for x in one[:8])


def test_compactions_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(inspection, "BLOCK", 3)
    log = [{"type": k, "uuid": f"{k[0]}{i}", **({"subtype": "compact_boundary"} if k == "system" else {})} for i, k in enumerate("user x x x x x x system x x x x user x x x x assistant system".split())]
    got = inspection.inspect(as_records(spark, {"p": log})).compactions.collect()
    assert {(r.boundary.uuid, r.before_message.uuid, r.first_following_message and r.first_following_message.uuid, r.first_following_assistant and r.first_following_assistant.uuid) for r in got} == {("s7", "u0", "u12", "a17"), ("s18", "a17", None, None)}


def test_a_chain_of_a_hundred_thousand_links(spark):
    """Each request keeps all of the one before, but for some that fall back; the last ones keep a few of the deepest."""
    n = 100_000
    log = [{"type": inspection.SHAPE, "shapeHash": "s"}, {"type": inspection.BLOB, "hash": "b", "message": 1}]
    length, spine = 0, []  # the sequence as positions of tails: (position, ref)
    for i in range(n):
        keep = length if i % 1000 else max(0, length - 3)
        log.append({"type": inspection.REQUEST, "id": f"r{i}", "shapeHash": "s", **({"base": f"r{i - 1}"} if i else {}), "keep": keep, "tail": ["b" if i != 70_000 else "lost"]})
        spine = spine[:keep] if keep < len(spine) else spine
        spine.append("b" if i != 70_000 else "lost")
        length = keep + 1
    log += [{"type": inspection.REQUEST, "id": f"x{k}", "shapeHash": "s", "base": f"r{n - 1}", "keep": k, "tail": []} for k in (1, 5, 60_000)]
    got = inspection.inspect(as_records(spark, {"deep": log}))
    rows = {r.id: r for r in got.requests.collect()}
    assert len(rows) == n + 3 and rows[f"r{n - 1}"].n_refs == length and rows["x60000"].n_refs == 60_000
    lost = spine.index("lost") if "lost" in spine else None
    assert rows[f"r{n - 1}"].status == ("missing_blob" if lost is not None else "complete") and rows["r69999"].status == rows["x5"].status == rows["x60000"].status == "complete"
    assert rows["r70000"].status == rows["r70001"].status == "missing_blob"
    assert rows["x5"].refs_digest == rows["r4"].refs_digest and rows["x1"].refs_digest == rows["r0"].refs_digest
    refs = sorted((r.position, r.ref) for r in got.expand(got.requests.where(f"id in ('r{n - 1}')")).collect())
    assert refs == list(enumerate(spine))
