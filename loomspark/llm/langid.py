"""Language identification by interpolated Kneser-Ney character models, one per language.

Training counts character n-grams of a bounded, hash-ordered sample of labelled rows,
one task per language.  A model is, for each order, a sorted array of n-gram hashes
with discounted probabilities and a sorted array of context hashes with back-off
weights.  A text's words are scored under every model; the language with the lowest
cross-entropy per character is chosen, and a text whose cross-entropy is too high for
the chosen language, as calibrated on sample rows kept out of training, is rejected.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm.shared import map_arrow, ship

ORDER = 5
#: Labelled rows per language that are used at most, and the share of them kept for calibration.
SAMPLE_ROWS = 400
CALIBRATION = 0.25
#: So many languages are scored in one pass; more take further passes over the texts.
LANGUAGE_BLOCK = 512
_HASHES = 1 << 40
#: Texts up to this many bytes are taken first, so the sample stays small.
SAMPLE_BYTES = 20_000
#: Bytes of text that the sample of a language holds at most (beyond its first row).
SAMPLE_TOTAL = 64 << 20
#: A text is rejected REJECT_BITS a character plus REJECT_Z standard deviations above the
#: calibration mean.  The bits leave room for clean texts with keys, tables or a passage in
#: another learned language; letters in no learned language's order lie further off.
REJECT_BITS = 2.0
REJECT_Z = 6.0
WORD_MEMORY = 400_000
UNKNOWN = "und"

_WORDS = re.compile(r"[^\W\d_]+")
_BEGIN, _END = "\x01", "\x02"
_MIX = [np.uint64(2 * v + 1) for v in np.random.default_rng(20240501).integers(1 << 61, 1 << 62, ORDER)]
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    text = (text or "").lower()
    words = _WORDS.findall(text)
    # beyond ASCII, \w also holds fractions, circled numbers and other numerals: those are no letters
    return words if text.isascii() else [p for w in words for p in ((w,) if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def windows(words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Hashes of the n-grams and of their contexts for each order, at every predicted character; characters per word."""
    pad = _BEGIN * (ORDER - 1)
    flat = "".join(f"{pad}{w}{_END}" for w in words)
    codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    x = (codes.astype(np.uint64) + np.uint64(1)) * _SPREAD
    x ^= x >> np.uint64(29)
    at = np.flatnonzero(codes != 1)
    contexts, grams = [], []
    c = np.zeros(len(at), np.uint64)
    for k in range(1, ORDER + 1):
        if k > 1:
            c = c + x[at - (k - 1)] * _MIX[k - 1]
        contexts.append(c)
        grams.append(c + x[at] * _MIX[0])
    return grams, contexts, np.array([len(w) + 1 for w in words])


def train(counts: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: sorted n-gram hashes, their probabilities, sorted context hashes, their back-off weights."""
    words = list(counts)
    grams, contexts, sizes = windows(words)
    weight = np.repeat(np.array([counts[w] for w in words], float), sizes)
    model = []
    keep = np.arange(len(weight))
    for k in range(ORDER, 0, -1):
        uniq, first, inv = np.unique(grams[k - 1][keep], return_index=True, return_inverse=True)
        # the highest order counts occurrences, the others distinct n-grams one longer
        n = np.bincount(inv, weights=weight[keep] if k == ORDER else None, minlength=len(uniq)).astype(float)
        one, two = np.sum(n == 1), np.sum(n == 2)
        d = float(np.clip(one / (one + 2 * two) if one else 0.5, 0.1, 0.95))
        keep = keep[first]
        ctx, cinv = np.unique(contexts[k - 1][keep], return_inverse=True)
        total = np.bincount(cinv, weights=n)
        back = d * np.bincount(cinv) / total
        model.append((uniq, (np.maximum(n - d, 0) / total[cinv]).astype(np.float32), ctx, back.astype(np.float32)))
    return model[::-1]


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, values[at], np.float32(missing)).astype(float)


class Scorer:
    """Bits per language of words; remembers a bounded number of words."""

    def __init__(self, models: dict[str, dict]):
        self.langs = sorted(models)
        self.models = [models[g]["orders"] for g in self.langs]
        self.stats = np.array([models[g]["stats"] for g in self.langs])  # mean, variance between texts, variance per character
        self.floor = 1.0 / 512
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(self.langs) + 1))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > WORD_MEMORY:
            self.known, self.table, new = {}, self.table[:0], list(words)
        rows = [self.score(new[i : i + 20_000]) for i in range(0, len(new), 20_000)]
        self.known.update((w, i) for i, w in enumerate(new, len(self.known)))
        self.table = np.concatenate([self.table, *rows])

    def score(self, words: list[str]) -> np.ndarray:
        grams, contexts, sizes = windows(words)
        _, first, inv = np.unique(grams[-1], return_index=True, return_inverse=True)
        g, c = [a[first] for a in grams], [a[first] for a in contexts]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        out = np.empty((len(words), len(self.langs) + 1))
        for j, model in enumerate(self.models):
            p = np.full(len(first), self.floor)
            for k, (keys, probs, ctx, back) in enumerate(model):
                p = _find(keys, probs, g[k], 0.0) + _find(ctx, back, c[k], 1.0) * p
            out[:, j] = np.add.reduceat(-np.log2(p)[inv], starts)
        out[:, -1] = sizes
        return out

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in bits a character (texts x languages) and characters; NaN without letters."""
        lists = [words_of(t) for t in texts]
        self.learn({w for ws in lists for w in ws})
        sums = np.zeros((len(texts), len(self.langs) + 1))
        for i, ws in enumerate(lists):
            if ws:
                sums[i] = self.table[np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
        n = sums[:, -1]
        with np.errstate(invalid="ignore", divide="ignore"):
            return sums[:, :-1] / n[:, None], n


def train_language(rows: pd.DataFrame) -> dict:
    """A model from sample rows (text, in sample order) and its calibration."""
    texts = list(rows["text"])
    held = max(1, int(len(texts) * CALIBRATION)) if len(texts) > 3 else 0
    counts = Counter(w for t in texts[held:] for w in words_of(t))
    model = {"orders": train(counts), "stats": (0.0, 0.0, 0.0)} if counts else None
    if model is None:
        return {}
    one = Scorer({"x": model})
    h, n = one.texts(texts[:held] or texts)
    h, n = h[n > 0, 0], n[n > 0]
    per_word = one.table[:, 0] / one.table[:, -1]
    per_char = float(np.mean((per_word - per_word.mean()) ** 2 * one.table[:, -1])) if len(per_word) else 1.0
    mean = float(np.average(h, weights=np.minimum(n, 2000))) if len(h) else 0.0
    between = float(np.mean(np.maximum((h - mean) ** 2 - per_char / np.maximum(n, 1), 0))) if len(h) else 0.0
    model["stats"] = (mean, between, per_char)
    return model


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict[str, dict]:
    """Models per language from rows with text, lang and doc_id that are not held out.

    The sample of a language is its sample_rows documents first by length class and hash
    of doc_id; it is chosen on ids alone, and texts are read for the chosen ones only.
    Of a doc_id that rows of a language repeat, one text counts, the smallest.  Every
    label gets a model; what reaches the driver is a model of a bounded sample for
    each, so it grows with the number of labels, not with rows.
    """
    ok = docs.where("text is not null and lang is not null and doc_id is not null").where(~_held_out(F.col("doc_id")))
    ok = ok.where(F.col("text").rlike("\\p{L}"))
    # ranked on lengths and hashes only
    size = F.octet_length("text")
    ranked = ok.select("lang", "doc_id", (size > SAMPLE_BYTES).alias("long"), size.cast("long").alias("bytes"), F.xxhash64("doc_id").alias("h"))
    # repeated ids count once; estimates do, since the limits take twice what is needed
    ids = lambda cond: F.approx_count_distinct(F.when(cond, F.col("doc_id")))
    counts = ranked.groupBy("lang").agg(ids(F.col("long")).alias("n_long"), ids(~F.col("long")).alias("n_short"))
    # hashes below a limit are enough for the sample and few enough for the task that ranks a language
    wanted = 2 * sample_rows + 100
    limit = lambda n: F.floor(F.least(F.lit(1.0), wanted / F.greatest(n, F.lit(1))) * _HASHES)
    limits = counts.select("lang", limit("n_short").alias("short_limit"), F.when(F.col("n_short") < wanted, limit("n_long")).otherwise(0).alias("long_limit"))
    hashed = F.pmod("h", F.lit(_HASHES))
    near = ranked.join(F.broadcast(limits), "lang").where(hashed < F.when(F.col("long"), F.col("long_limit")).otherwise(F.col("short_limit")))
    near = near.groupBy("lang", "doc_id", "h").agg(F.min("long").alias("long"), F.max("bytes").alias("bytes"))
    order = Window.partitionBy("lang").orderBy("long", hashed, "doc_id")
    chosen = near.withColumn("r", F.row_number().over(order)).withColumn("read", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chosen = chosen.where((F.col("r") <= sample_rows) & ((F.col("r") == 1) | (F.col("read") <= SAMPLE_TOTAL))).select("lang", "doc_id", "r")
    # what is broadcast is far smaller than the models: sample_rows ids a label; texts of one id meet before they are grouped
    sample = ok.select("lang", "doc_id", "text").join(F.broadcast(chosen), ["lang", "doc_id"]).groupBy("lang", "doc_id", "r").agg(F.min("text").alias("text"))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["r", "text"]).head(sample_rows)
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "model": [pickle.dumps(train_language(rows))]})

    ship(docs.sparkSession)
    made = sample.groupBy("lang").applyInPandas(one, "lang string, model binary").collect()
    models = {r["lang"]: pickle.loads(r["model"]) for r in made}
    return {g: m for g, m in models.items() if m}


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, models: dict[str, dict], reject_z: float = REJECT_Z) -> DataFrame:
    """docs plus lang_pred, lang_score, lang_rejected, lang_bits.

    lang_pred is `und`, with score 0 and rejected, where text is null or has no letter
    or nothing was learned.  lang_score is the share of the chosen language when the
    models' likelihoods over at most 50 characters compete.  Each row stands for
    itself; columns of docs with the added names are replaced.
    """
    added = ["lang_pred", "lang_score", "lang_rejected", "lang_bits"]
    docs = docs.drop(*added)
    names = sorted(models)
    blocks = [{g: models[g] for g in names[i : i + LANGUAGE_BLOCK]} for i in range(0, len(names), LANGUAGE_BLOCK)] or [{}]
    if len(blocks) == 1:
        return _score(docs, blocks[0], reject_z, added).drop(_CHARS)
    # each pass adds the best language of its block; the likelihoods of all of them compete in the end
    out, passes = docs, [[f"__{c}_{i}" for c in added] for i in range(len(blocks))]
    for block, to in zip(blocks, passes):
        out = _score(out.drop(_CHARS), block, reject_z, to)
    best = F.array_min(F.array(*[F.when(F.col(bits).isNotNull(), F.struct(F.col(bits).alias("bits"), F.lit(i).alias("i"), F.col(pred).alias("pred"), F.col(rejected).alias("rejected"))) for i, (pred, _, rejected, bits) in enumerate(passes)]))
    out = out.withColumn("__best", best)
    chars = F.least(F.col(_CHARS), F.lit(50.0))
    total = sum((F.coalesce(F.pow(F.lit(2.0), (F.col("__best.bits") - F.col(bits)) * chars) / F.col(score), F.lit(0.0)) for _, score, _, bits in passes), F.lit(0.0))
    out = out.withColumns({"lang_pred": F.coalesce("__best.pred", F.lit(UNKNOWN)), "lang_score": F.when(F.col("__best").isNotNull(), 1 / total).otherwise(0.0), "lang_rejected": F.coalesce("__best.rejected", F.lit(True)), "lang_bits": F.col("__best.bits")})
    return out.select(*docs.columns, *added)


_CHARS = "__lang_chars"


def _score(docs: DataFrame, models: dict[str, dict], reject_z: float, added: list[str]) -> DataFrame:
    """docs plus, under the names `added`, the best of some languages, its share among them, whether it is rejected and its bits; and the characters scored."""
    cols = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(models)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    schema += "".join(f", `{n}` {t}" for n, t in zip([*added, _CHARS], ("string", "double", "boolean", "double", "double")))
    at = cols.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = batch.column(at).to_pylist()
                n = len(texts)
                pred, score, rejected, bits, chars = [UNKNOWN] * n, [0.0] * n, [True] * n, [None] * n, [0.0] * n
                if scorer:
                    h, size = scorer.texts(texts)
                    for i in np.flatnonzero(size > 0):
                        j = int(np.argmin(h[i]))
                        mean, between, per_char = scorer.stats[j]
                        pred[i] = scorer.langs[j]
                        score[i] = float(1.0 / np.sum(2.0 ** (-(h[i] - h[i, j]) * min(size[i], 50.0))))
                        rejected[i] = bool(h[i, j] - mean > REJECT_BITS + reject_z * np.sqrt(between + per_char / size[i]))
                        bits[i], chars[i] = float(h[i, j]), float(size[i])
                more = [pa.array(pred), pa.array(score, pa.float64()), pa.array(rejected), pa.array(bits, pa.float64()), pa.array(chars, pa.float64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *added, _CHARS])

    return map_arrow(docs, run, schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    models = fit(docs)
    out = identify(docs.select("doc_id", "text"), models)
    return out.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
