"""Annotations as a log of changes: the store is what the latest change of each id leaves."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.sources.commits import CommitLog

FIELDS = "annotation_id string, session_id string, annotator string, scope_type string, target_id string, category string, title string, detail string, tags_json string, minitrace_taxonomy_json string, mast_taxonomy_json string, toolemu_taxonomy_json string, classification string"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
PATCHED = [n for n in NAMES if n not in ("annotation_id", "session_id")]
CHANGES = FIELDS + ", change string, at timestamp"
LOG = CHANGES + ", serial long"
SYNCED = "session_id string, upto long"


class AnnotationStore:
    """add, patch, delete and list annotations; every change is a folder of rows of its own, which a numbered commit makes part of the store.

    Of writers that change the store at once each gets a number; one that comes second checks its change against what
    the first has left.  Folders that no commit names are not read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.commits = CommitLog(spark, f"{self.path}/commits")

    def _read(self, kind: str, schema: str, entries: list | None = None) -> DataFrame:
        """Rows of all commits of a kind, with the numbers of their commits as serial."""
        found = [(e["folder"], n) for n, e in (self.commits.entries() if entries is None else entries) if e["kind"] == kind]
        if not found:
            return self.spark.createDataFrame([], f"{schema}, serial long")
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{folder}" for folder, _ in found])
        rows = rows.withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), "/data/([^/]+)/[^/]+$", 1))
        numbers = self.spark.createDataFrame(found, "folder string, serial long")
        return rows.join(F.broadcast(numbers), "folder").drop("folder")

    def _log(self, entries: list | None = None) -> DataFrame:
        return self._read("change", CHANGES, entries)

    def _write(self, rows: DataFrame) -> str:
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{folder}")
        return folder

    def _append(self, rows: DataFrame, change: str, check: Callable[[list], None], staged: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        """Commit rows as a change; check and staged see the store as the commit will find it."""

        def build(entries: list) -> dict:
            check(entries)
            made = staged(rows)
            cols = [(F.col(n) if n in made.columns else F.lit(None)).cast("string").alias(n) for n in NAMES]
            return {"kind": "change", "change": change, "folder": self._write(made.select(*cols, F.lit(change).alias("change"), F.current_timestamp().alias("at")))}

        self.commits.commit(build)

    def current(self, entries: list | None = None) -> DataFrame:
        """Annotations (as of some entries of the log, else now) with created_at and updated_at; of a field, the latest change that gives it a value stands."""
        log = self._log(entries)
        order = F.struct("serial", "at")
        value = lambda n: F.max_by(n, F.when(F.col(n).isNotNull(), order)).alias(n)
        g = log.groupBy("annotation_id").agg(*[value(n) for n in NAMES if n != "annotation_id"], F.min("at").alias("created_at"), F.max("at").alias("updated_at"), F.max_by("change", order).alias("last"))
        return g.where("last <> 'delete'").drop("last")

    def add(self, rows: DataFrame) -> None:
        """New annotations; an id that is blank, repeated or in the store is an error and nothing is written."""
        twice = rows.groupBy("annotation_id").count().where("count > 1 or coalesce(annotation_id, '') = ''").select("annotation_id")

        def check(entries: list) -> None:
            there = rows.select("annotation_id").join(self.current(entries).select("annotation_id"), "annotation_id", "left_semi")
            if bad := there.unionByName(twice).limit(5).collect():
                raise ValueError(f"can't be added: {', '.join(str(r[0]) for r in bad)}")

        self._append(rows, "add", check)

    def _change(self, rows: DataFrame, change: str) -> None:
        held: list = []

        def check(entries: list) -> None:
            held[:] = [self.current(entries).select("annotation_id", "session_id")]
            missing = rows.join(held[0], "annotation_id", "left_anti").select("annotation_id").limit(5).collect()
            if missing:
                raise KeyError(", ".join(str(r[0]) for r in missing))

        self._append(rows.drop("session_id"), change, check, lambda rows: rows.join(held[0], "annotation_id"))

    def patch(self, rows: DataFrame) -> None:
        """Other values for the fields that rows hold (nulls leave a field as it is)."""
        self._change(rows, "patch")

    def delete(self, rows: DataFrame) -> None:
        self._change(rows.select("annotation_id"), "delete")

    def list(self, session: str | None = None, scope: str | None = None, category: str | None = None, annotator: str | None = None, taxonomy: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        """Annotations by five filters, the latest first; taxonomy is part of any taxonomy entry."""
        df = self.current()
        for column, wanted in (("session_id", session), ("scope_type", scope), ("category", category), ("annotator", annotator)):
            df = df.where(F.col(column) == wanted) if wanted else df
        if taxonomy:
            df = df.where(F.coalesce(*[F.when(F.contains(F.lower(c), F.lit(taxonomy.lower())), True) for c in NAMES if c.endswith("_taxonomy_json")], F.lit(False)))
        df = df.orderBy(F.desc("created_at"), "annotation_id")
        df = df.offset(offset) if offset else df
        return df.limit(limit) if limit else df

    def unsynced(self) -> DataFrame:
        """(session_id, changes): sessions with changes since they were last synced."""
        done = self._synced()
        log = self._log().join(done, "session_id", "left").where(F.col("serial") > F.coalesce("upto", F.lit(0)))
        return log.groupBy("session_id").agg(F.count(F.lit(1)).alias("changes"))

    def _synced(self) -> DataFrame:
        return self._read("synced", SYNCED).groupBy("session_id").agg(F.max("upto").alias("upto"))

    def mark_synced(self, sessions: DataFrame) -> None:
        """Sessions (session_id) whose documents hold all changes made until now."""
        upto = self._log().groupBy("session_id").agg(F.max("serial").alias("upto"))
        folder = self._write(upto.join(sessions.select("session_id").distinct(), "session_id", "left_semi").select("session_id", "upto"))
        self.commits.commit(lambda entries: {"kind": "synced", "folder": folder})
