import hashlib
import json
import random

import pytest
from loomspark.sources import archives, records
from pyspark.sql import functions as F


def sequential(content, most):
    """(line, offset, bytes, value, diagnostic) by one pass over the bytes."""
    out, at = [], 0
    for n, raw in enumerate(content.splitlines(keepends=True) if b"\r" not in content else [x + b"\n" for x in content.split(b"\n")[:-1]] + ([content.rsplit(b"\n", 1)[-1]] if content and not content.endswith(b"\n") else []), 1):
        value = said = None
        if len(raw) > most:
            said = "record_too_large"
        else:
            try:
                value = raw.decode()
                if not isinstance(json.loads(value), dict):
                    raise ValueError
            except UnicodeDecodeError:
                said = "invalid_utf8"
            except ValueError:
                value, said = None, "invalid_record"
        out.append((n, at, len(raw), value, said))
        at += len(raw)
    return out


def rows(df):
    return [(r.line_no, r.byte_offset, r.raw_bytes, r.value, r.diagnostic) for r in df.orderBy("path", "line_no").collect()]


RAW = '{"type":"é"}\r\n'.encode() + b"x" * 70_000 + b"\n{bad}\n" + b'{"x":"\xff"}\n' + b'\n{} {}\n[1]\n{"n":9007199254740993}\n{"n":NaN}\n{}'


@pytest.mark.parametrize("step", [1, 2, 3, 7, 64, 1000, 10**6])
def test_ranges_give_the_sequential_coordinates(spark, tmp_path, step, monkeypatch):
    monkeypatch.setattr(records, "CHUNK", 5)
    file = tmp_path / "a.jsonl"
    content = RAW.replace(b"x" * 70_000, b"x" * 70)
    file.write_bytes(content)
    want = [x if b"NaN" not in content[x[1] : x[1] + x[2]] else (*x[:3], None, "invalid_record") for x in sequential(content, 32)]
    got = []
    with records.opened(str(file)) as f:
        for start in range(0, len(content), step):
            got += [(o, n, *records.judged(raw)) for o, n, raw in records.physical(f, start, min(start + step, len(content)), 32)]
    said = [(o, n, v, "invalid_record" if d == records.BLANK else d) for o, n, v, d in got]
    assert said == [x[1:] for x in want]


def test_many_tasks_read_one_log(spark, tmp_path):
    rng = random.Random(3)
    parts = [json.dumps({"i": i, "text": "é" * rng.randrange(300)}, ensure_ascii=False).encode() + rng.choice([b"\n", b"\r\n"]) for i in range(3000)]
    parts[700] = b"\n" * 5
    parts[1500] = b"{" + b"x" * 200_000 + b"\n"
    content, other = b"".join(parts), b'{"a":1}\n{"b":2}'
    for name, data in (("big.jsonl", content), ("small.jsonl", other), ("empty.jsonl", b"")):
        (tmp_path / name).write_bytes(data)
    paths = [str(tmp_path / n) for n in ("big.jsonl", "small.jsonl", "empty.jsonl", "big.jsonl")]
    df = records.records(spark, paths, range_bytes=20_000, max_record=100_000)
    assert df.where(F.col("path").endswith("big.jsonl")).select(F.spark_partition_id()).distinct().count() > 10
    assert rows(df) == sequential(content, 100_000) + sequential(other, 100_000)
    assert records.records(spark, paths[:1], 20_000, skip_blank=True).count() == len(sequential(content, 1 << 24)) - 5
    stats = {r.path: r for r in records.scan_stats(spark, paths, 20_000, 100_000).collect()}
    big = stats[paths[0]]
    assert (big.sha256, big.bytes, big.lines, big.malformed) == (hashlib.sha256(content).hexdigest(), len(content), len(sequential(content, 1)), 6)
    assert (stats[paths[2]].bytes, stats[paths[2]].lines, stats[paths[2]].sha256) == (0, 0, hashlib.sha256(b"").hexdigest())
    assert records.records(spark, [paths[2]]).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        records.records(spark, [str(tmp_path / "nowhere.jsonl")]).count()


def test_heads_read_no_more_than_their_bytes(spark, tmp_path, monkeypatch):
    file = tmp_path / "a.jsonl"
    lines = [json.dumps({"i": i, "x": "y" * 10_000}).encode() for i in range(100)]
    file.write_bytes(b"\n".join(lines))
    got = records.heads(spark, [str(file)]).orderBy("line_no").collect()
    assert len(got) == (1 << 18) // (len(lines[0]) + 1) and [json.loads(r.value)["i"] for r in got] == list(range(len(got)))
    (tmp_path / "b.jsonl").write_bytes(b"\n\n" + b'{"a":1}\n' * 80)
    got = archives.heads(spark, [str(tmp_path / "b.jsonl")]).orderBy("line_no").collect()
    assert [r.line_no for r in got] == list(range(3, 51)) and got[0].value == '{"a":1}'
    read = []

    class Counting:
        def __init__(self, f):
            self.f = f

        def read(self, n):
            read.append(n)
            return self.f.read(n)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

    really = records.opened
    monkeypatch.setattr(records, "opened", lambda p: Counting(really(p)))
    reader = records.RecordReader({"what": "head", "paths": json.dumps([str(file)])})
    for part in reader.partitions():
        list(reader.read(part))
    assert read == [1 << 18]


def test_addresses(spark, tmp_path):
    (tmp_path / "a b.jsonl").write_bytes(b'{"a":1}\n')
    assert rows(records.records(spark, [f"file://{tmp_path}/a b.jsonl".replace(" ", "%20")])) == [(1, 0, 8, '{"a":1}\n', None)]


def test_load_set_reads_logs_by_ranges(spark, tmp_path, monkeypatch):
    from loomspark.sources import importing

    monkeypatch.setattr(archives.records, "RANGE", 300)
    log = [{"type": "session", "id": "s1", "cwd": "/w"}] + [{"type": "message", "timestamp": f"2024-01-01T00:00:{i:02d}Z", "message": {"role": "user" if i % 2 else "assistant", "content": [{"type": "text", "text": f"say {i}"}]}} for i in range(40)]
    (tmp_path / "pi.jsonl").write_text("\r\n".join(json.dumps(x) for x in log))
    (tmp_path / "bad.jsonl").write_bytes(json.dumps(log[0]).encode() + b"\n{no\n\xff\n")
    (tmp_path / "empty.jsonl").write_text("")
    (tmp_path / "odd.jsonl").write_text('{"a": 1}\n')
    (tmp_path / "n.minitrace.json").write_text(json.dumps({"id": "n1", "schema_version": "1", "turns": [], "tool_calls": []}))
    src = archives.SourceSet().directory(str(tmp_path))
    tables, told = importing.load_set(spark, src)
    assert sorted(r.session_id for r in tables["sessions"].collect()) == ["n1", "s1"]
    assert [r.content for r in tables["turns"].where("session_id = 's1'").orderBy("turn_index").collect()] == [f"say {i}" for i in range(40)]
    assert sorted((r.path.rsplit("/", 1)[1], r.message) for r in told.collect()) == [("bad.jsonl", "line 2: not a JSON object"), ("bad.jsonl", "line 3: not UTF-8"), ("empty.jsonl", "no records"), ("odd.jsonl", "no known format")]
    with pytest.raises(archives.SourceError):
        importing.load_set(spark, src, strict=True)
