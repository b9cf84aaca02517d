"""Line dedup: lines found in many documents stay only in the document with the largest id.

Lines are exploded, normalised and hashed; documents are counted per hash (partial
sums before each shuffle, so a line of a third of all documents is a few rows);
hits go back by hash and the text is put together again by position.  The most
frequent lines go back by broadcast, and their occurrences are dealt by document, so
no task gets all occurrences of one line.  Only DataFrame functions run.  Text
itself is shuffled once, by document, and split twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.shared import ASCII_SPACE, LOWER, UPPER, fold_ascii, hash_pair, save

MIN_CHARS = 40
MIN_DOCS = 5
#: Lines that hold at least one in so many of all occurrences, and HOT_DOCS documents, go back by broadcast: so many lines at most.
HOT_LINES = 10_000
HOT_DOCS = 1000


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with text less the lines held by at least min_docs documents, plus n_lines and n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased;
    keys under min_chars code points never drop.  The document with the largest
    doc_id keeps all its lines.  Null text is one empty line.  Rows that share a
    doc_id are one document for the count and each keeps its own text; a row with a
    null doc_id holds no line and passes unchanged.  An empty table gives an empty one.
    Other columns stay as they are; columns named n_lines or n_dropped are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("others")] if others else []
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *packed)
    lines = (
        base.where("doc_id is not null")
        .drop("others")
        .select("doc_id", F.xxhash64("text").alias("row_hash"), F.posexplode(F.split(fold_ascii(F.col("text")), "\n", -1)).alias("pos", "line"))
        .withColumn("line", F.btrim("line", F.lit(ASCII_SPACE)))
        .where(F.char_length("line") >= min_chars)
    )
    h1, h2 = hash_pair(F.col("line"))
    keys = lines.select("doc_id", "row_hash", "pos", h1.alias("h1"), h2.alias("h2"))
    common = (
        keys.groupBy("h1", "h2")
        .agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs)
    )
    common = save(common, "common")
    least = max(HOT_DOCS, (common.agg(F.sum("n")).first()[0] or 0) // HOT_LINES)
    hot = F.broadcast(common.where(F.col("n") >= least).select("h1", "h2", F.col("keeper").alias("hot_keeper")))
    told = keys.join(hot, ["h1", "h2"], "left")
    # occurrences of hot lines have their keeper already and pass the join below each in a place of its own
    is_hot = F.col("hot_keeper").isNotNull()
    told = told.select(
        "doc_id", "row_hash", "pos", "hot_keeper", is_hot.alias("is_hot"),
        F.when(is_hot, F.xxhash64("doc_id", "pos")).otherwise(F.col("h1")).alias("h1"), F.when(is_hot, F.lit(0)).otherwise(F.col("h2")).alias("h2"),
    )
    rest = common.where(F.col("n") < least).select("h1", "h2", F.lit(False).alias("is_hot"), "keeper")
    hits = (
        told.join(rest, ["is_hot", "h1", "h2"], "left")
        .where(F.col("doc_id") < F.coalesce("hot_keeper", "keeper"))
        .groupBy("doc_id", "row_hash")
        .agg(F.collect_set("pos").alias("dropped"))
    )
    joined = base.withColumn("row_hash", F.xxhash64("text")).join(hits, ["doc_id", "row_hash"], "left")
    # the lines are bound once, as the only element of an array: a lambda would split the text again for every line
    lines_of = F.array(F.split("text", "\n", -1))

    def without_dropped(lines):
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
        return F.array_join(F.transform(kept, lambda p: F.get(lines, p)), "\n")

    text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.get(F.transform(lines_of, without_dropped), F.lit(0))).alias("text")
    n_lines = F.length(F.col("text")) - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    named = {c: F.col("others").getField(c).alias(c) for c in others} | {"doc_id": F.col("doc_id"), "text": text}
    return joined.select(
        *[named[c] for c in docs.columns],
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
bad AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
j AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id <> bad.keeper, false) AS gone FROM k LEFT JOIN bad ON k.key = bad.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
