"""File contents from recorded writes and edits: an ordered fold from each full write on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _arg(name: str, *more: str) -> Column:
    return F.coalesce(*[F.get_json_object("arguments_json", f"$.{n}") for n in (name, *more)])


def write_operations(calls: DataFrame) -> DataFrame:
    """Calls that write or edit a file: path, kind, and their texts, in order of session and call."""
    path = F.coalesce("file_path", _arg("file_path", "path"))
    kind = F.when(F.lower("tool_name").isin("write", "create") | (F.col("operation_type") == "NEW"), "write").when(F.lower("tool_name").isin("edit", "multiedit", "str_replace") | (F.col("operation_type") == "MODIFY"), "edit")
    out = calls.select("session_id", "source_ordinal", "timestamp", "success", path.alias("path"), kind.alias("kind"), _arg("content", "file_text").alias("content"), _arg("old_string", "old_str", "oldText").alias("old"), _arg("new_string", "new_str", "newText").alias("new"))
    return out.where("path is not null and kind is not null and coalesce(success, 1) = 1")


def shell_edits(calls: DataFrame) -> DataFrame:
    """Shell commands that may change files in place or by redirection."""
    return calls.where(F.col("command").rlike(r"(\bsed\s+-i|\btee\b|>{1,2}\s*[^&\s]|\bperl\s+-pi|\bmv\b|\bpatch\b)")).select("session_id", "source_ordinal", "timestamp", "command")


def read_results(calls: DataFrame) -> DataFrame:
    """What reads returned."""
    return calls.where((F.col("operation_type") == "READ") & F.col("result").isNotNull()).select("session_id", "source_ordinal", "file_path", "result")


_FOLDED = "path string, segment long, content string, applied long, missed long"


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted operations to one row a segment; what is held is a batch and one file's text, across batches."""
    at, text, applied, missed = None, None, 0, 0
    names = [c.split()[0] for c in _FOLDED.split(", ")]
    for pdf in batches:
        done = []
        for r in pdf.itertuples():
            if (r.path, r.segment) != at:
                if at is not None:
                    done.append((*at, text, applied, missed))
                at, text, applied, missed = (r.path, r.segment), None, 0, 0
            if r.kind == "write" and r.content is not None:
                text, applied = r.content, applied + 1
            elif r.kind == "edit" and text is not None and r.old and r.old in text:
                text, applied = text.replace(r.old, r.new or "", 1), applied + 1
            else:
                missed += 1
        yield pd.DataFrame(done, columns=names)
    if at is not None:
        yield pd.DataFrame([(*at, text, applied, missed)], columns=names)


def reconstruct(operations: DataFrame) -> DataFrame:
    """(path, content, applied, missed): from a full write on, first-occurrence replacements in order of time.

    A full write forgets what was there before, so a path's operations fall into
    segments that begin at its full writes and are folded apart, by as many tasks as
    there are; the content is that of the last segment, the counts are of all.  Times
    that are null come first; operations of one call (session_id, source_ordinal)
    belong together.  Segments are numbered on keys alone, without texts.  A path
    without a full write has null content.
    """
    full = (F.col("kind") == "write") & F.col("content").isNotNull()
    call = ["path", "session_id", "source_ordinal"]
    keys = operations.groupBy(*call).agg(F.min("timestamp").alias("time"), F.max(full.cast("int")).alias("full"))
    order = Window.partitionBy("path").orderBy(F.asc_nulls_first("time"), F.asc_nulls_first("session_id"), F.asc_nulls_first("source_ordinal"))
    placed = keys.select(*[F.col(c).alias(f"k_{c}") for c in call], F.sum("full").over(order).alias("segment"), F.row_number().over(order).alias("n"))
    placed = operations.join(placed, [operations[c].eqNullSafe(placed[f"k_{c}"]) for c in call]).select("path", "segment", "n", "kind", "content", "old", "new")
    dealt = placed.repartition("path", "segment").sortWithinPartitions("path", "segment", "n", "kind", "content", "old", "new")
    folded = dealt.drop("n").mapInPandas(_fold, _FOLDED)
    return folded.groupBy("path").agg(F.max_by("content", "segment").alias("content"), F.sum("applied").alias("applied"), F.sum("missed").alias("missed"))
