"""Session documents and native logs as DataFrames: locations, formats, strict and lenient import."""

from __future__ import annotations

import glob
import os
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.schema import SESSION_DDL
from loomspark.sources import records

ARCHIVE_GLOB = "*.minitrace.json"
SUFFIXES = (".minitrace.json", ".jsonl")


class SourceError(ValueError):
    """A source that can't be read; strict imports raise it."""


def expand(patterns: Sequence[str]) -> list[str]:
    """Absolute paths of local glob patterns, in order, each once; no match at all is an error."""
    out: dict[str, None] = {}
    for p in dict.fromkeys(p.strip() for p in patterns if p.strip()):
        for f in sorted(glob.glob(p)) or ([p] if os.path.exists(p) else []):
            out[os.path.abspath(f)] = None
    if not out:
        raise SourceError(f"nothing matches {', '.join(patterns)}")
    return list(out)


def walk(folder: str) -> list[str]:
    """Archive and log files below a folder, sorted."""
    found = [os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs if f.endswith(SUFFIXES)]
    return sorted(os.path.abspath(f) for f in found)


@dataclass(frozen=True)
class SourceSet:
    """Immutable collection of locations and inline texts."""

    paths: tuple[str, ...] = ()
    inline: tuple[tuple[str, str], ...] = ()

    def files(self, paths: Sequence[str]) -> SourceSet:
        new = [os.path.abspath(p) for p in paths]
        return replace(self, paths=tuple(dict.fromkeys([*self.paths, *new])))

    def directory(self, folder: str) -> SourceSet:
        return self.files(walk(folder))

    def globs(self, patterns: Sequence[str]) -> SourceSet:
        return self.files(expand(patterns))

    def content(self, text: str, name: str = "inline") -> SourceSet:
        if not text.strip():
            raise SourceError(f"{name} is empty")
        return replace(self, inline=(*self.inline, (name, text)))

    def logs(self, spark: SparkSession, range_bytes: int = records.RANGE) -> DataFrame:
        """(path, line_no, value, diagnostic) of the sources named .jsonl, each file read by many tasks."""
        paths = [p for p in self.paths if p.endswith(".jsonl")]
        return records.records(spark, paths, range_bytes, skip_blank=True).select("path", "line_no", F.rtrim("value", F.lit("\r\n ")).alias("value"), "diagnostic")

    def read(self, spark: SparkSession) -> DataFrame:
        """(path, content): one row per source, read on the executors."""
        parts = []
        if self.paths:
            parts.append(spark.read.format("binaryFile").load(list(self.paths)).select("path", F.col("content").cast("string").alias("content")))
        if self.inline:
            parts.append(spark.createDataFrame(list(self.inline), "path string, content string"))
        if not parts:
            raise SourceError("no source")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def lines(sources: DataFrame) -> DataFrame:
    """(path, line_no, value): non-blank lines of text sources, numbered from 1 with blanks counted."""
    each = sources.select("path", F.posexplode(F.split("content", "\n")).alias("pos", "value"))
    return each.where(F.trim("value") != "").select("path", (F.col("pos") + 1).alias("line_no"), F.rtrim(F.col("value")).alias("value"))


def _json(c: str, path: str) -> Column:
    return F.get_json_object(c, path)


def line_format(value: str = "value") -> Column:
    """The native format that a record shows, or null."""
    kind, role = _json(value, "$.type"), _json(value, "$.message.role")
    return (
        F.when(kind.isin("session_meta", "response_item", "event_msg", "turn_context") | _json(value, "$.record_type").isNotNull() | kind.startswith("thread."), "codex")
        .when((kind == "session") | ((kind == "message") & role.isNotNull()), "pi")
        .when(kind.startswith("session.") | kind.startswith("assistant.") | kind.startswith("tool.") | kind.startswith("user."), "copilot")
        .when(kind.isin("user", "assistant", "summary", "file-history-snapshot", "queue-operation", "system") & (role.isNotNull() | _json(value, "$.sessionId").isNotNull() | _json(value, "$.summary").isNotNull()), "claude-code")
    )


def detect(all_lines: DataFrame) -> DataFrame:
    """(path, format): what the first record that shows a format shows."""
    shown = all_lines.withColumn("format", line_format()).where("format is not null")
    return shown.groupBy("path").agg(F.min_by("format", "line_no").alias("format"))


def documents(sources: DataFrame, strict: bool = True) -> DataFrame:
    """Native session documents: (path, doc, error).  A document needs an id and a mark of a session.

    strict raises on the first bad source when the rows are read; otherwise error says what is wrong and doc is null.
    """
    doc = F.from_json("content", SESSION_DDL, {"mode": "PERMISSIVE"})
    parsed = sources.select("path", "content", doc.alias("doc"))
    marked = F.coalesce(F.col("doc.schema_version"), F.col("doc.provenance.source_format"), F.col("doc.environment.agent_framework"), F.col("doc.timing.started_at"), F.when(F.col("doc.turns").isNotNull(), "turns"))
    error = F.when(F.col("doc").isNull() | F.get_json_object("content", "$").isNull(), "not a JSON object").when(F.coalesce("doc.id", F.lit("")) == "", "no id").when(marked.isNull(), "no session")
    out = parsed.withColumn("error", error)
    if strict:
        out = out.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat("path", F.lit(": "), "error")).cast("string")))
    return out.select("path", F.when(F.col("error").isNull(), F.col("doc")).alias("doc"), "error")


def last_activity(all_lines: DataFrame) -> DataFrame:
    """(path, last_time): the latest valid timestamp of a log; malformed lines are skipped."""
    stamp = F.try_to_timestamp(_json("value", "$.timestamp"))
    return all_lines.groupBy("path").agg(F.max(stamp).alias("last_time"))


def heads(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, line_no, value) of the first records of each file, for discovery; no more than their bytes are read."""
    return records.heads(spark, paths).where("value is not null").select("path", "line_no", F.rtrim("value", F.lit("\r\n ")).alias("value"))


def inventory(sources: DataFrame) -> DataFrame:
    """(path, sha256, bytes) of each source; equal digests under two names are byte duplicates."""
    return sources.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))


def duplicates(docs: DataFrame) -> DataFrame:
    """(session_id, paths, contents, finding) of ids in more than one source: same bytes or a conflict.  docs: path, session_id, sha256."""
    g = docs.groupBy("session_id").agg(F.count(F.lit(1)).alias("paths"), F.count_distinct("sha256").alias("contents")).where("paths > 1")
    return g.withColumn("finding", F.when(F.col("contents") > 1, "conflict").otherwise("duplicate"))
