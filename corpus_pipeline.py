"""From raw documents to packed sequences: language, repeated lines, near copies, source weights, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that its
predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm import langid, line_dedup, mixing, ngram_join, packing
from loomspark.llm.shared import save

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models accept.  A document without a letter is rejected."""
    models = langid.fit(docs)
    return langid.identify(docs.select(*COLUMNS), models).where(~F.col("lang_rejected")).select(*COLUMNS)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines of five documents or more stay in one of them; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies; of repeated rows, one."""
    classes = ngram_join.near_duplicate_classes(docs)
    gone = classes.where("component_id <> doc_id").select("doc_id").distinct()
    left = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    same = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    repeated = F.col("doc_id").isNotNull() & F.xxhash64("text").eqNullSafe(F.lag(F.xxhash64("text")).over(same))
    return left.withColumn("repeated", repeated).where(~F.col("repeated")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    out = mixing.mix_sources(docs.select(*COLUMNS)).where("mix_copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, one per piece."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("language", known_language),
    ("lines", without_common_lines),
    ("near_copies", one_of_each),
    ("mix", mixed),
    ("pack", packed),
]

#: Language models and the tokenizer are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
