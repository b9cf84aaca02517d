"""Archives as partitioned tables: publication, manifests, validation, annotations, previews."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators.metrics import period

# Fixed values of annotations.
CATEGORIES = ("success", "ai-failure", "user-correction", "observation", "question", "pattern", "risk", "other")
SCOPES = ("session", "turn", "tool_call")
CLASSIFICATIONS = ("public", "internal", "confidential", "restricted")


class Collision(ValueError):
    """An id that is published already, with other content."""


def plan_publication(new: DataFrame, old: DataFrame | None) -> DataFrame:
    """new (id, fingerprint, period, ...) with status created, unchanged or replaced against what is published."""
    if old is None:
        return new.withColumn("status", F.lit("created"))
    there = old.select("id", F.col("fingerprint").alias("_old"))
    joined = new.join(there, "id", "left")
    status = F.when(F.col("_old").isNull(), "created").when(F.col("_old") == F.col("fingerprint"), "unchanged").otherwise("replaced")
    return joined.withColumn("status", status).drop("_old")


def publish(docs: DataFrame, path: str, on_collision: str = "error") -> DataFrame:
    """Write session documents below path by period of start; rows that are unchanged are not written again.

    Returns (id, period, status).  A period that changes is written as a whole, from its old
    and new rows, and takes its place at once (dynamic partition overwrite).
    """
    spark = docs.sparkSession
    new = docs.withColumn("fingerprint", F.sha2(F.to_json(F.struct("*")), 256)).withColumn("period", period(F.col("timing.started_at")))
    try:
        old = spark.read.schema(new.schema).parquet(path)
        old.limit(1).count()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    planned = plan_publication(new, old)
    if on_collision == "error" and (bad := planned.where("status = 'replaced'").select("id").limit(5).collect()):
        raise Collision(", ".join(r.id for r in bad))
    # what is to happen to each id is kept beside the archive, which itself changes below; it counts once the rows are there
    run = uuid.uuid4().hex  # folders of this run alone
    statuses, planned_at = f"{path.rstrip('/')}.status-{run}", f"{path.rstrip('/')}.planned-{run}"
    planned.select("id", "period", "status").write.mode("overwrite").parquet(planned_at)
    changed = planned.where("status <> 'unchanged'")
    rows = changed.drop("status")
    if old is not None:
        touched = changed.select("period").unionByName(old.join(changed.select("id"), "id", "left_semi").select("period")).distinct()
        kept = old.join(touched, "period", "left_semi").join(changed.select("id"), "id", "left_anti")
        rows = rows.unionByName(kept.select(*rows.columns))
        staged = f"{path.rstrip('/')}.staged-{run}"
        rows.write.mode("overwrite").parquet(staged)
        rows = spark.read.schema(rows.schema).parquet(staged)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path)
    spark.read.schema("id string, period string, status string").parquet(planned_at).write.mode("overwrite").parquet(statuses)
    return spark.read.schema("id string, period string, status string").parquet(statuses)


def manifest(docs: DataFrame) -> DataFrame:
    """(period, sessions, first_start, last_start, by_quality, by_profile, by_classification): one row per period and one for all."""
    base = docs.select(period(F.col("timing.started_at")).alias("period"), F.col("timing.started_at").alias("started"), *[F.coalesce(c, F.lit("none")).alias(c) for c in ("quality", "profile", "classification")])
    both = base.unionByName(base.withColumn("period", F.lit("all")))
    out = both.groupBy("period").agg(F.count(F.lit(1)).alias("sessions"), F.min("started").alias("first_start"), F.max("started").alias("last_start"))
    for c in ("quality", "profile", "classification"):
        n = both.groupBy("period", c).agg(F.count(F.lit(1)).alias("n")).groupBy("period").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(f"by_{c}"))
        out = out.join(n, "period")
    return out


def validate_annotations(notes: DataFrame) -> DataFrame:
    """(annotation_id, findings): rules that a row breaks; rows without findings are left out."""
    rule = lambda bad, text: F.when(F.coalesce(bad, F.lit(True)), F.lit(text))
    rules = F.array(
        rule(F.coalesce("annotation_id", F.lit("")) == "", "no id"), rule(F.coalesce("session_id", F.lit("")) == "", "no session"), rule(~F.col("category").isin(*CATEGORIES), "category"), rule(~F.col("scope_type").isin(*SCOPES), "scope"),
        rule((F.col("scope_type") != "session") & (F.coalesce("target_id", F.lit("")) == ""), "no target"), F.when(F.col("classification").isNotNull() & ~F.col("classification").isin(*CLASSIFICATIONS), "classification"),
    )
    out = notes.select("annotation_id", F.filter(rules, lambda r: r.isNotNull()).alias("findings"))
    return out.where(F.size("findings") > 0)


def validate_archive(published: DataFrame, listed: DataFrame) -> DataFrame:
    """(id, finding) sorted: duplicates, period mismatch, fingerprint drift, and ids in only one of archive and manifest.  listed: id, fingerprint."""
    dup = published.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("duplicate id").alias("finding"))
    moved = published.where(F.col("period") != period(F.col("timing.started_at"))).select("id", F.lit("period mismatch").alias("finding"))
    both = published.select("id", "fingerprint").join(listed.select("id", F.col("fingerprint").alias("f")), "id", "full_outer")
    drift = both.select("id", F.when(F.col("f").isNull(), "not in manifest").when(F.col("fingerprint").isNull(), "orphan in manifest").when(F.col("f") != F.col("fingerprint"), "fingerprint drift").alias("finding")).where("finding is not null")
    return dup.unionByName(moved).unionByName(drift).distinct().orderBy("id", "finding")


def sync_annotations(docs: DataFrame, notes: DataFrame) -> DataFrame:
    """docs with their annotations replaced by those of the store, in order of id; documents without notes keep theirs."""
    note = docs.schema["annotations"].dataType.elementType
    listed = F.transform(F.array_sort(F.collect_list(F.struct("annotation_id", F.struct(
        F.col("annotation_id").alias("id"), "timestamp", "annotator", F.struct(F.col("scope_type").alias("type"), "target_id").alias("scope"),
        F.struct("category", F.from_json("tags_json", "array<string>").alias("tags"), "title", "detail").alias("content"),
        F.struct(*[F.from_json(f"{n}_taxonomy_json", "array<string>").alias(n) for n in ("minitrace", "mast", "toolemu")]).alias("taxonomy_mappings"), "classification",
    ).cast(note).alias("x")))), lambda s: s["x"])
    grouped = notes.groupBy(F.col("session_id").alias("id")).agg(listed.alias("_notes"))
    return docs.join(grouped, "id", "left").withColumn("annotations", F.coalesce("_notes", "annotations")).select(*docs.columns)


def preview(tables: dict[str, DataFrame], privacy: str = "structural", samples: int = 3) -> DataFrame:
    """(session_id, kind, label, n, sample): counts by role and tool; snippets or full texts only if asked."""
    if privacy not in ("structural", "snippets", "full"):
        raise ValueError(f"no privacy level {privacy}")
    from pyspark.sql import Window

    def side(df, kind, label, text, order):
        w = Window.partitionBy("session_id", label)
        shown = {"structural": F.lit(None).cast("string"), "snippets": F.substring(text, 1, 80), "full": F.col(text)}[privacy]
        ranked = df.select("session_id", F.lit(kind).alias("kind"), F.col(label).alias("label"), F.count(F.lit(1)).over(w).alias("n"), F.row_number().over(w.orderBy(order)).alias("r"), shown.alias("sample"))
        return ranked.where(F.col("r") <= samples).drop("r")

    return side(tables["turns"], "turn", "role", "content", "turn_index").unionByName(side(tables["tool_calls"], "tool", "tool_name", "command", "source_ordinal"))


def import_annotations(spark: SparkSession, path: str) -> DataFrame:
    """An array of annotation objects from JSON as rows of the store."""
    return spark.read.schema("annotation_id string, session_id string, annotator string, scope_type string, target_id string, category string, title string, detail string, classification string").option("multiLine", True).json(path)
