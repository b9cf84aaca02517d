import random

import numpy as np
import pytest
from loomspark.llm import decontaminate as D
from pyspark.sql import functions as F

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def places(text):
    """(word, start, end) character by character."""
    out, held, at = [], "", 0
    for i, c in enumerate((text or "").translate(FOLD) + " "):
        if c >= "\x80" or c.isdigit() and c < "\x80" or "a" <= c <= "z":
            at, held = (i, c) if not held else (at, held + c)
        elif held:
            out.append((held, at, i))
            held = ""
    return out


def brute(docs, items):
    grams = {}
    for i, t in items:
        w = [x for x, _, _ in places(t)]
        if i is not None and w:
            for a in range(max(1, len(w) - 9)):
                grams.setdefault(tuple(w[a : a + 10]), set()).add(str(i))
    out = []
    for i, text in docs:
        p = places(text)
        w = [x for x, _, _ in p]
        hit, held = set(), set()
        for a in range(len(w)):
            for n in range(1, 11):
                if a + n <= len(w) and tuple(w[a : a + n]) in grams:
                    hit |= set(range(a, a + n))
                    held |= grams[tuple(w[a : a + n])]
        spans = []
        for a in sorted(hit):
            if a - 1 in hit:
                spans[-1][1] = p[a][2]
            else:
                spans.append([p[a][1], p[a][2]])
        left = text
        for s, e in reversed(spans):
            left = left[:s] + left[e:]
        out.append((i, len(w), len(hit), tuple(tuple(x) for x in spans), tuple(sorted(held)), left))
    return sorted(out, key=repr)


def tables():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "çA", "ß", "x9"]
    say = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "\x00", "_"]) for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 3, 9, 10, 11, 30, 60]))) for i in range(40)] + [(7, say(15)), (100, None), (None, say(20)), (-3, say(25)), (101, "a " * 12), (102, "Hello, world"), (103, "!!"), (104, "a " * 10)]
    items = [(i, t) for i, t in items if t is None or len(places(t)) != 1 or i == 101]
    docs = [(i, say(rng.randrange(80))) for i in range(120)]
    for i, t in items:
        if t:
            docs.append((1000 + (i or 0), say(5) + t.upper() + say(7) + t))
    docs += [(1, None), (1, ""), (None, items[3][1]), (2, "hello\nWORLD and hello world"), (3, "A " * 5000), (4, "a" * 9), (5, "é" * 50_000 + " hello world"), (6, "\U0001f600 hello \U0001f600"), (2, "hello\nWORLD and hello world")]
    return docs, items


def rows_of(found):
    cleaned = {}
    for r in D.remove(found.withColumn("key", F.monotonically_increasing_id())).collect():
        cleaned[r.key] = r.text
    got = found.withColumn("key", F.monotonically_increasing_id()).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(tuple(x) for x in r.spans), tuple(r.items), cleaned[r.key]) for r in got), key=repr)


@pytest.mark.parametrize("block", [1_000_000, 300])
def test_against_brute_force(spark, block):
    docs, items = tables()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("clash")).withColumn("others", F.lit("clash")).withColumn("k1", F.lit(1)).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit(3))
    from loomspark.llm.shared import save

    found = save(D.find_windows(df, bench, block))
    assert found.columns == ["doc_id", "text", "others", "k1", "n_words", "n_hit", "spans", "items"]
    assert rows_of(found) == brute(docs, items)
    clean = D.remove(found, "documents")
    assert clean.columns == ["doc_id", "text", "others", "k1"] and clean.count() == sum(x[2] == 0 for x in brute(docs, items))
    assert {r.text for r in D.remove(found.where("doc_id = 2 and n_hit > 0")).collect()} == {" and "}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r) for r in D.find_windows(docs, none).collect()] == [(1, "a b", 2, 0, [], [])]
    assert D.find_windows(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        D.remove(docs, "words")


def test_equal_hashes_are_told_apart(monkeypatch):
    """With one hash for all windows, the words decide."""
    monkeypatch.setattr(D.NGrams, "hashed", staticmethod(lambda ids: np.zeros(len(ids), np.uint64)))
    grams = D.NGrams([("a b", ["1"]), ("b c", ["2"]), ("c a", ["3"]), ("d d", ["4"])])
    ids = np.array([grams.vocabulary.get(w, 0) for w in b"a b c x d a b".split()], np.int32)
    found = sorted((int(p), items[w][0]) for places_, _, which, items in grams.occurrences(ids) for p, w in zip(places_, which))
    assert found == [(0, "1"), (1, "2"), (5, "1")]
