from collections import Counter
from itertools import permutations

from loomspark.llm import filter_audit
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(docs, labels):
    """Document by document, order by order."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    out = Counter()
    for i, text, lang in docs:
        text = text or ""
        w = words_of(text)
        fails = set()
        if len(w) < 100:
            fails.add("A")
        if 100 * len(set(w)) < 80 * len(w):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text):
            fails.add("C")
        if any(c in "#$%&*|" for c in text):
            fails.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == text for j, u, _ in docs):
            fails.add("E")
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                key = (lang or "", "".join(order), step)
                removed = not gone and f in fails
                redundant = gone and f in fails
                gone = gone or removed
                for name, is_so in (("rows", True), ("kept", not gone), ("removed", removed), ("redundant", redundant), ("unique_fails", fails == {f}), ("good_lost", removed and i in good), ("toxic_lost", removed and i in toxic)):
                    out[*key, name] += is_so
                out[lang or "", f, "shapley"] += removed
    return out


def check(spark, docs, labels, partitions=3):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("part", F.lit("clash")).withColumn("flags", F.lit(7)).repartition(partitions)
    got = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("clash"))).collect()
    want = brute(docs, labels)
    assert len(got) == 600 * len({lang or "" for _, _, lang in docs})
    assert len({(r.part, r.filter_order, r.step) for r in got}) == len(got)
    for r in got:
        assert r.filter == r.filter_order[r.step - 1]
        for name in filter_audit.COUNTS:
            assert r[name] == want[r.part, r.filter_order, r.step, name], (r, name)
        assert r.shapley == want[r.part, r.filter, "shapley"]


def test_every_order_against_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(100))
    docs = [
        (1, long, "en"), (2, long, "en"), (3, long, None), (4, long + " #", "en"), (5, "A" * 11 + "é" * 89, "de"), (6, "A" * 10 + "é" * 90, "de"),
        (7, "x " * 100 + long, "en"), (8, " ".join(["x"] * 21 + [f"v{i}" for i in range(79)]), ""), (9, " ".join(["x"] * 20 + [f"v{i}" for i in range(81)]), ""),
        (10, None, "en"), (11, "", "en"), (12, SPACE, None), (None, long, "en"), (None, None, None), (2, long, "en"), (3, "other", "en"), (14, "a\x85b\xa0c" * 60, "fr"),
        (15, "Kk $ " * 30_000, "fr"), (16, "w\x0bx\x0c\r\n\ty", "fr"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, None, 1), (7, None, None), (None, 1, 1), (99, 1, 1), (15, 1, 1), (15, 1, 1)]
    check(spark, docs, labels)


def test_copies_of_one_text_and_empty_tables(spark):
    check(spark, [(i, "the same", "en") for i in range(40, 0, -1)] + [(100, "The same", "en")], [(i, i % 2, 1) for i in range(50)])
    check(spark, [], [])
    check(spark, [(1, "a", "b")], [])
