"""Mixing sources to target weights, with repetition instead of sampling loss.

Tokens are summed per source, targets follow from the weights with a cap on
repetition, and each document is emitted floor(rate) times plus one hash-seeded
Bernoulli copy with the fraction as its probability.  The draw of a document comes
from SHA-256 of its id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm.shared import WORD_PATTERN, save

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
#: SHA-256 of the id holds eight draws of 32 bits; each source uses the one whose total lies nearest its target.
DRAWS = 8
#: A table of sources up to this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 10_000


def _draw(i: int):
    digest = F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), 256)
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_rates(sized: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source: source, source_size, target, rate.

    Sources by code point, null last, take the weights in turn.  Targets share the
    total by weight; a source is never above max_repeat times its size, and what is
    over goes to the others by weight: the targets are min(cap, level * weight),
    where the level follows from prefix sums over sources ordered by cap / weight.
    The windows run over sources only, which are already one row each.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    s = sums.select("source", "source_size", weight.alias("w"), (F.lit(float(max_repeat)) * F.col("source_size")).alias("cap"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(
        "*",
        F.sum("source_size").over(everything).cast("double").alias("total"),
        F.sum("w").over(everything).alias("all_w"),
        F.coalesce(F.sum("cap").over(below), F.lit(0.0)).alias("cap_below"),
        F.coalesce(F.sum("w").over(below), F.lit(0.0)).alias("w_below"),
    )
    # the level if exactly the sources before this one are capped; the first that holds is the level
    level = (F.col("total") - F.col("cap_below")) / (F.col("all_w") - F.col("w_below"))
    s = s.withColumn("level", F.when(level <= F.col("cap") / F.col("w"), level))
    s = s.withColumn("level", F.max("level").over(everything))
    target = F.least(F.col("cap"), F.col("level") * F.col("w"))
    return s.select("source", "source_size", target.alias("target"), F.try_divide(target, F.col("source_size").cast("double")).alias("rate"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """docs plus mix_size, mix_source_size, mix_target, mix_copies (how often the mix takes the row).

    Null text has size 0; null source is a source of its own.  Rows with one doc_id
    share a draw.  A source without words takes nothing.  An empty table gives an
    empty one.  Columns of docs with those names are replaced.
    """
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_copies")
    cols = docs.columns
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"),
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
    )
    small = docs.select(F.col("doc_id"), F.col("source"), F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"))
    # words by source and draw below a threshold need the rate, so sizes are kept per document: 3 columns, no text
    small = save(small, "sizes")
    rates = save(source_rates(small, weights, max_repeat), "rates")
    few = rates.count() <= BROADCAST_SOURCES
    hint = F.broadcast if few else (lambda d: d)
    r = rates.select(F.col("source").alias("r_source"), "source_size", "target", "rate")
    seen = small.join(hint(r), F.col("source").eqNullSafe(F.col("r_source")), "inner")
    frac = F.col("rate") - F.floor("rate")
    extra = [F.sum(F.when(_draw(i) < frac, F.col("size")).otherwise(0)).alias(f"x{i}") for i in range(DRAWS)]
    totals = seen.groupBy("r_source", "source_size", "target", "rate").agg(*extra)
    gap = [F.abs(F.floor("rate") * F.col("source_size") + F.col(f"x{i}") - F.col("target")) for i in range(DRAWS)]
    best = F.array_position(F.array(*gap), F.least(*gap)).cast("int")
    plan = save(totals.select("r_source", "source_size", "target", "rate", best.alias("draw")), "plan")
    joined = packed.join(hint(plan), F.col("source").eqNullSafe(F.col("r_source")), "left")
    draw = F.element_at(F.array(*[_draw(i) for i in range(DRAWS)]), F.col("draw"))
    copies = F.coalesce(F.floor("rate") + F.when(draw < frac, 1).otherwise(0), F.lit(0)).cast("long")
    return joined.select(
        *[F.col("row").getField(c).alias(c) for c in cols],
        F.col("size").alias("mix_size"),
        F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"),
        copies.alias("mix_copies"),
    )


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return out.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


_U = ", ".join(f"CAST(('0x' || substr(dg, {8 * i + 1}, 8)) AS BIGINT) / 4294967296.0::DOUBLE" for i in range(DRAWS))
ORACLE = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}')) AS BIGINT) AS size,
    sha256(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS dg FROM documents),
u AS (SELECT doc_id, source, size, [{_U}] AS us FROM d),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
    3.0::DOUBLE * source_size AS cap FROM s0),
s2 AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(w) OVER () AS all_w,
    coalesce(sum(cap) OVER o, 0.0) AS cap_below, coalesce(sum(w) OVER o, 0.0) AS w_below FROM s1
    WINDOW o AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, (total - cap_below) / (all_w - w_below) AS lv FROM s2),
s4 AS (SELECT source, source_size, w, cap, max(lv) FILTER (WHERE lv <= cap / w) OVER () AS level FROM s3),
s5 AS (SELECT source, source_size, least(cap, level * w) AS target FROM s4),
s6 AS (SELECT *, CASE WHEN source_size = 0 THEN NULL ELSE target / CAST(source_size AS DOUBLE) END AS rate FROM s5),
e AS (SELECT u.*, s6.source_size, s6.target, floor(s6.rate) AS whole, s6.rate - floor(s6.rate) AS frac FROM u JOIN s6 ON u.source IS NOT DISTINCT FROM s6.source),
g AS (SELECT source, i, abs(any_value(whole) * any_value(source_size) + sum(CASE WHEN us[i] < frac THEN size ELSE 0 END) - any_value(target)) AS gap
    FROM e, range(1, {DRAWS + 1}) AS r(i) GROUP BY source, i),
b AS (SELECT source, arg_min(i, row(gap, i)) AS draw FROM g GROUP BY source)
SELECT e.doc_id, e.size, e.source_size, e.target,
  CAST(e.size * coalesce(whole + CASE WHEN us[b.draw] < frac THEN 1 ELSE 0 END, 0) AS BIGINT) AS taken
FROM e LEFT JOIN b ON e.source IS NOT DISTINCT FROM b.source
"""
