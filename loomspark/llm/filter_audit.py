"""Filter interaction audit by direct relational replay of every order of the filters.

Each document carries one flag per filter.  Documents' flags are crossed with the 120
orders, a fixed table that is broadcast, the first failing step of each pair is
computed, the five steps are exploded, and conditional sums combine on the map side:
a task sends parts x 600 rows at most, whatever it has read.  Text never leaves the
scan; the one flag that needs other documents (identical to an earlier text) comes from the
smallest doc_id of each text, so that the join back is by doc_id and a text held by
a third of all rows is one row of it.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm.shared import ASCII_SPACE, WORD_PATTERN, save

# Fixed values of the contract: filters and what they fail on.
FILTERS = "ABCDE"
MIN_WORDS = 100
DISTINCT_PERCENT = 80
CAPITAL_PERCENT = 10
SIGNS = "[#$%&*|]"
SPACES = "[\\x20\\x09-\\x0D]+"

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def _bit(condition, letter: str):
    return F.when(condition, F.lit(1 << FILTERS.index(letter))).otherwise(F.lit(0))


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, flags, good, toxic), one row per row of docs; bit i of flags: the document fails filter i.

    docs: doc_id, text, lang.  labels: doc_id, quality, toxic; a document is good or
    toxic if any of its label rows says so.  Null text is empty, null lang the part
    ''.  A row with a null doc_id has no smaller doc_id and no label.  Rows that repeat
    a doc_id with its text are no copies of each other.
    """
    text = F.coalesce("text", F.lit(""))
    read = docs.select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("text_key"),
        F.split(F.btrim(text, F.lit(ASCII_SPACE)), SPACES).alias("words"),
        F.regexp_count(text, F.lit("[A-Z]")).alias("capitals"),
        F.char_length(text).alias("chars"),
        text.rlike(SIGNS).alias("signs"),
    )
    words = F.when(F.col("words") == F.array(F.lit("")), 0).otherwise(F.size("words"))
    alone = read.select(
        "doc_id", "part", "text_key",
        (_bit(words < MIN_WORDS, "A") + _bit(100 * F.size(F.array_distinct("words")) < DISTINCT_PERCENT * words, "B")
        + _bit(100 * F.col("capitals").cast("long") > CAPITAL_PERCENT * F.col("chars").cast("long"), "C") + _bit(F.col("signs"), "D")).alias("flags"),
    )
    alone = save(alone, "flags")  # texts are read and split once
    first = alone.where("doc_id is not null").groupBy("text_key").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text_key", F.lit(True).alias("is_first"))
    marks = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id")
    marks = marks.agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    copied = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return (
        alone.join(first, ["doc_id", "text_key"], "left")
        .join(marks, "doc_id", "left")
        .select("part", (F.col("flags") + _bit(copied, "E")).alias("flags"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    )


def orders(spark: SparkSession) -> DataFrame:
    """The 120 orders: filter_order and the bits of its five filters in turn."""
    rows = [("".join(p), *(1 << FILTERS.index(c) for c in p)) for p in permutations(FILTERS)]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, rows))} AS t(filter_order, b1, b2, b3, b4, b5)")


def replay(flags: DataFrame) -> DataFrame:
    """part, filter_order, step, the counts, shapley and filter: one row per part, order and step.

    flags: as flagged() gives them.  Every part has all 600 rows, zeros included; no
    documents, no rows.
    """
    spark = flags.sparkSession
    # four short columns are dealt evenly before each row becomes 600: Spark sizes partitions by bytes and would use few tasks
    dealt = flags.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    crossed = dealt.join(F.broadcast(orders(spark)))
    bits = [F.col(f"b{i}") for i in range(1, 6)]
    fails = lambda bit: F.col("flags").bitwiseAND(bit) != 0
    first = F.lit(6)
    for i in range(5, 0, -1):
        first = F.when(fails(bits[i - 1]), i).otherwise(first)
    steps = crossed.select("part", "filter_order", "flags", "good", "toxic", first.alias("first"), F.posexplode(F.array(*bits)).alias("pos", "bit"))
    step = F.col("pos") + 1
    removed = F.col("first") == step
    out = steps.groupBy("part", "filter_order", step.cast("int").alias("step")).agg(
        F.count_if(F.col("first") > step).alias("kept"),
        F.count_if(removed).alias("removed"),
        F.count_if(fails(F.col("bit")) & (F.col("first") < step)).alias("redundant"),
        F.count_if(F.col("flags") == F.col("bit")).alias("unique_fails"),
        F.count_if(removed & F.col("good")).alias("good_lost"),
        F.count_if(removed & F.col("toxic")).alias("toxic_lost"),
    )
    out = out.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))  # 120 rows each
    return out.select("part", "filter_order", "step", *COUNTS, shapley.alias("shapley"), "filter")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """How the five filters act on docs in each of their 120 orders; see flagged() and replay()."""
    return replay(flagged(docs.select("doc_id", "text", "lang"), labels.select("doc_id", "quality", "toxic")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))
_FIRST = "CASE " + " ".join(f"WHEN contains(fails, substr(filter_order, {i}, 1)) THEN {i}" for i in range(1, 6)) + " ELSE 6 END"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD_PATTERN}') AS words, min(doc_id) OVER (PARTITION BY text) AS smallest FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < {MIN_WORDS} THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < {DISTINCT_PERCENT} * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > {CAPITAL_PERCENT} * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '{SIGNS}') THEN 'D' ELSE '' END || CASE WHEN coalesce(smallest < w.doc_id, false) THEN 'E' ELSE '' END AS fails
    FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
o AS (SELECT * FROM (VALUES {_ORDERS}) AS v(filter_order)),
x AS (SELECT *, {_FIRST} AS first FROM f, o),
s AS (SELECT *, substr(filter_order, step, 1) AS filter FROM x, (VALUES (1), (2), (3), (4), (5)) AS t(step)),
a AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, count(*) FILTER (WHERE first > step) AS kept, count(*) FILTER (WHERE first = step) AS removed,
    count(*) FILTER (WHERE first < step AND contains(fails, filter)) AS redundant, count(*) FILTER (WHERE fails = filter) AS unique_fails,
    count(*) FILTER (WHERE first = step AND good) AS good_lost, count(*) FILTER (WHERE first = step AND toxic) AS toxic_lost
    FROM s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley, filter FROM a
"""
