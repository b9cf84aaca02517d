import random
import zlib
from collections import Counter

import corpus_pipeline as cp
import pytest
from loomspark.llm import langid, packing
from loomspark.llm.shared import save

from tests.llm.test_text_operators import DOCS, SPACE, brute_join, brute_lines, docs, water

SF = "/root/testdata/sf0.001"
BAD = [(9001, None, "en", "s", None), (9002, "", None, None, 0), (9003, "½ 12 !!", "en", "s", 7), (None, "the and of the people that was in a house", "en", "s", 5)]


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def table(spark):
    """Whole test documents with nulls, repeats and columns of clashing names."""
    base = spark.read.parquet(f"{SF}/documents.parquet").select(*cp.COLUMNS)
    rows = [tuple(r) for r in base.collect()]
    return rows + BAD + rows[:3]


def test_language_stage(spark, table):
    df = docs(spark, table, DOCS)
    got = rows_of(cp.known_language(spark, df, SF))
    models = langid.fit(df)
    scorer = langid.Scorer(models)

    def known(text):
        h, n = scorer.texts([text])
        if not n[0]:
            return False
        j = int(h[0].argmin())
        mean, between, per_char = scorer.stats[j]
        return h[0, j] - mean <= langid.REJECT_BITS + langid.REJECT_Z * (between + per_char / n[0]) ** 0.5

    assert got == Counter(r for r in table if known(r[1]))
    assert not {9001, 9002, 9003} & {r[0] for r in got} and len(got) > 0.9 * len(set(table))


def test_line_stage(spark, table):
    got = rows_of(cp.without_common_lines(spark, docs(spark, [(*r, "clash", 1) for r in table], DOCS + ", n_lines string, h1 int"), SF))
    kept = {(i, t): (n, x) for (i, _, n, x), t in zip(list(brute_lines_each(table)), [r[1] for r in table])}
    want = Counter()
    for i, t, lang, source, n_chars in table:
        n, x = kept[(i, t)]
        want[(i, x, lang, source, len(x) if n else n_chars)] += 1
    assert got == want


def brute_lines_each(table):
    """brute_lines row by row, in order."""
    every = brute_lines([r[:2] for r in table])
    by = {}
    for i, n, gone, x in every:
        by.setdefault((i, n), []).append((gone, x))
    for i, t, *_ in table:
        lines = (t or "").split("\n")
        fits = [(g, x) for g, x in by[(i, len(lines))] if set(x.split("\n")) <= set(lines) or g == len(lines)]
        yield (i, len(lines), *fits[0])


def near(rng):
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows = []
    for g in range(25):
        base = [word() for _ in range(rng.choice([3, 12, 60]))]
        for _ in range(rng.randint(1, 5)):
            x = list(base)
            if rng.random() < 0.5:
                x[rng.randrange(len(x))] = word()
            rows.append((len(rows), " ".join(x), rng.choice(["en", None]), rng.choice("abc"), 3))
    return rows + BAD + rows[:4] + [(0, rows[0][1], "fr", "other", 9), (9002, "another text of the same number, long enough for shingles", None, None, 1)]


def test_near_copy_stage(spark):
    rows = near(random.Random(4))
    df = docs(spark, [(*r, "clash") for r in rows], DOCS + ", component_id string")
    got = cp.one_of_each(spark, df, SF).collect()
    classes = {}
    for i, _, c in brute_join([r[:2] for r in rows]):
        classes.setdefault(i, c)
    want = {(i, t) for i, t, *_ in rows if classes[i] == i}
    assert {(r.doc_id, r.text) for r in got} == want and len(got) == len(want)
    assert {tuple(r) for r in got} <= set(rows)


def test_mix_stage(spark, table):
    got = rows_of(cp.mixed(spark, docs(spark, [(*r, 1) for r in table], DOCS + ", mix_copies int"), SF))
    assert set(got) <= set(table)
    size = lambda t: len([w for w in (t or "").translate(str.maketrans(SPACE, " " * len(SPACE))).split(" ") if w])
    total, taken = Counter(), Counter()
    for r in table:
        total[r[3]] += size(r[1])
    for r, n in got.items():
        taken[r[3]] += size(r[1]) * n
        assert n <= 3 * table.count(r)
    order = sorted(s for s in total if s is not None) + ([None] if None in total else [])
    want = water(order, total)
    biggest = max(size(r[1]) for r in table)
    assert all(abs(taken[s] - want[s]) <= max(0.1 * want[s], biggest) for s in order)


def test_run(spark, tmp_path, table):
    """run() is its stages one after the other, and the pieces are the words of what the mix left."""
    df = docs(spark, table, DOCS)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in cp.run(spark, str(tmp_path)).collect())
    for name, stage in cp.STAGES[:-1]:
        df = save(stage(spark, df, str(tmp_path)), name)
        assert df.columns == list(cp.COLUMNS)
    known = packing.word_ids(packing.default_tokenizer())
    want = Counter()
    for r in df.collect():
        ids, at = packing.encode(r.text, known), 0
        for n in packing.piece_lengths(len(ids) // 4):
            want[(r.doc_id, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), len(ids) // 4)] += 1
            at += n
    assert got == want and len(got) > 100


def test_stages_on_an_empty_table(spark):
    empty = docs(spark, [], DOCS)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0
