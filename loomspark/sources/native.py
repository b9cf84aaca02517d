"""Physical records of native logs with exact coordinates, and readers of exports that hold many sessions."""

from __future__ import annotations

import io
import json
import os
import sqlite3
import tempfile
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from loomspark.sources.records import records

def scan_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """records() of logs without their blank lines, which keep their numbers."""
    return records(spark, paths, skip_blank=True)


def zip_conversations(spark: SparkSession, paths: Sequence[str], id_prefix: str = "", member: str = "conversations.json") -> DataFrame:
    """(path, conversation_id, value): conversations of exported ZIP archives as JSON text, by prefix of their id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in [n for n in z.namelist() if n.rpartition("/")[2] == member]:
                        rows = []
                        for c in json.loads(z.read(name)):
                            key = str(c.get("uuid") or c.get("conversation_id") or c.get("id") or "")
                            if key.startswith(id_prefix):
                                rows.append((path, key, json.dumps(c, ensure_ascii=False)))
                        yield pd.DataFrame(rows, columns=["path", "conversation_id", "value"])

    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInPandas(run, "path string, conversation_id string, value string")


def sqlite_rows(spark: SparkSession, paths: Sequence[str], sql: str, schema: str) -> DataFrame:
    """Rows of a query over SQLite files, one task per file, opened read-only from a copy of its bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with tempfile.TemporaryDirectory() as d:
                    with open(file := os.path.join(d, "x.db"), "wb") as f:
                        f.write(content)
                    db = sqlite3.connect(f"file:{file}?mode=ro", uri=True)
                    try:
                        yield from pd.read_sql_query(sql, db, chunksize=5000)
                    finally:
                        db.close()

    return spark.read.format("binaryFile").load(list(paths)).select("content").mapInPandas(run, schema)
