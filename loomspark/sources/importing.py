"""One way in: native documents and logs of any known format, with diagnostics, receipts and saved imports."""

from __future__ import annotations

import glob
import hashlib
import json
import os
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators.flatten import flatten
from loomspark.schema import TABLES
from loomspark.sources import turn_store
from loomspark.sources.adapters import FORMATS, convert
from loomspark.sources.archives import SourceError, SourceSet, detect, documents, expand, inventory, lines
from loomspark.sources.cache import VERSION, stored
from loomspark.sources.publish import preview

#: Session setting with the globs of the host's archives, comma-separated.
ARCHIVES = "loomspark.archives"
#: A record longer than this is an error that names its line.
LINE_BYTES = 16 << 20


def runtime_archives(spark: SparkSession) -> SourceSet:
    """The archives that the host names in the session's settings."""
    named = [g.strip() for g in (spark.conf.get(ARCHIVES, "") or "").split(",") if g.strip()]
    if not named:
        raise SourceError(f"{ARCHIVES} is not set")
    return SourceSet().files(expand(named))


def checked_lines(sources: DataFrame, line_bytes: int = LINE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(records, diagnostics): JSON records of logs, and what is wrong by path and line."""
    every = lines(sources)
    size, parsed = F.octet_length("value"), F.get_json_object("value", "$")
    said = F.when(size > line_bytes, F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": record too large"))).when(parsed.isNull() | ~F.startswith(F.ltrim("value"), F.lit("{")), F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": not a JSON object")))
    marked = every.withColumn("message", said)
    empty = sources.select("path").join(every.select("path").distinct(), "path", "left_anti").select("path", F.lit("no records").alias("message"))
    return marked.where("message is null").drop("message"), marked.where("message is not null").select("path", "message").unionByName(empty)


# What the reader of logs says about records, as messages.
_SAID = {"record_too_large": "record too large", "invalid_utf8": "not UTF-8", "invalid_record": "not a JSON object"}


def load_set(spark: SparkSession, sources: SourceSet, strict: bool = False, stores: str = "turn-store") -> tuple[dict[str, DataFrame], DataFrame]:
    """load() of a source set: logs are read by byte ranges, so one of any size is dealt over many tasks; documents are whole.

    Files named .db are stores of turn snapshots that the agent `stores` kept.
    """
    db, logs = [p for p in sources.paths if p.endswith(".db")], [p for p in sources.paths if p.endswith(".jsonl")]
    whole = SourceSet(tuple(p for p in sources.paths if p not in {*db, *logs}), sources.inline)
    df = whole.read(spark) if whole.paths or whole.inline else spark.createDataFrame([], "path string, content string")
    tables, diagnostics = load(df, strict=strict, logs=_read_logs(spark, logs) if logs else None)
    if db:
        kept, bad = turn_store.convert(turn_store.read_store(spark, db), stores)
        bad = bad.select("path", F.lit("error").alias("level"), F.concat_ws(": ", "conv_id", "message").alias("message"))
        if strict and (first := bad.orderBy("path", "message").limit(1).collect()):
            raise SourceError(f"{first[0]['path']}: {first[0]['message']}")
        tables, diagnostics = {name: df.unionByName(kept[name]) if name in kept else df for name, df in tables.items()}, diagnostics.unionByName(bad)
    return tables, diagnostics


def _read_logs(spark: SparkSession, logs: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(records, diagnostics) of logs, as load() takes them."""
    every = SourceSet(tuple(logs)).logs(spark)
    line = F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "))
    message = F.concat(line, F.coalesce(*[F.when(F.col("diagnostic") == k, v) for k, v in _SAID.items()]))
    empty = spark.createDataFrame([(p,) for p in logs], "path string").join(every.select("path"), "path", "left_anti").select("path", F.lit("no records").alias("message"))
    bad = every.where("diagnostic is not null").select("path", message.alias("message")).unionByName(empty)
    return every.where("diagnostic is null").drop("diagnostic"), bad


def load(sources: DataFrame, auto_convert: bool = True, strict: bool = False, logs: tuple[DataFrame, DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, diagnostics) of sources (path, content): native documents, and with auto_convert logs of every known format.

    logs: records (path, line_no, value) and diagnostics (path, message) of logs that are read already.
    diagnostics: path, level, message.  strict raises at the first bad source; otherwise
    bad sources are errors in the diagnostics and the others are loaded.
    """
    # unions of differently coalesced shuffles fail in Spark 4.1 when they keep their children's partitioning
    sources.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    native = documents(sources, strict=False)
    good = native.where("error is null")
    rest = sources.join(native.where("error is not null").select("path"), "path", "left_semi")
    tables = {name: [df] for name, df in flatten(good.select("doc.*")).items()}
    if auto_convert:
        records, bad = checked_lines(rest)
        if logs is not None:
            records, bad = records.unionByName(logs[0]), bad.unionByName(logs[1])
        # a log with a bad record is not loaded in part
        records = records.join(bad.select("path").distinct(), "path", "left_anti")
        # conversions read their records several times: they are parsed, and their formats found, once
        records = stored(records, "records")
        formats = stored(detect(records), "formats")
        for name in sorted({r["format"] for r in formats.select("format").distinct().collect()} & set(FORMATS)):
            mine = stored(records.join(formats.where(F.col("format") == name).select("path"), "path", "left_semi"), "lines")
            for table, df in convert(mine, name).items():
                tables.setdefault(table, []).append(df)
        known = rest.select("path") if logs is None else rest.select("path").unionByName(logs[0].select("path").distinct())
        none = known.join(formats.select("path").unionByName(bad.select("path")), "path", "left_anti").select("path", F.lit("no known format").alias("message"))
        told = bad.unionByName(none)
    else:
        told = native.where("error is not null").select("path", F.col("error").alias("message"))
    diagnostics = told.select("path", F.lit("error").alias("level"), "message")
    if strict and (first := diagnostics.orderBy("path", "message").limit(1).collect()):
        raise SourceError(f"{first[0]['path']}: {first[0]['message']}")
    out = {}
    for name, parts in tables.items():
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p, allowMissingColumns=True)
        out[name] = df.select(*TABLES[name].fieldNames())
    return out, diagnostics


def conversion_receipt(sources: DataFrame, tables: dict[str, DataFrame], diagnostics: DataFrame) -> dict[str, Any]:
    """What a conversion read, made and could not read, as plain JSON; its digest does not depend on the order of files."""
    one = inventory(sources).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.bit_xor(F.xxhash64("path", "sha256")).alias("x")).first()
    failed = diagnostics.agg(F.count_distinct("path").alias("n")).first()["n"]
    rows = {name: df.count() for name, df in sorted(tables.items())}
    return {"version": VERSION, "inputs": {"files": one["files"], "bytes": one["bytes"], "digest": one["x"]}, "outputs": rows, "failures": failed, "status": "partial" if failed else "complete"}


def save_import(tables: dict[str, DataFrame], root: str, name: str, privacy: str = "structural") -> str:
    """Write an import's tables and its preview below root; the name may not lead out of it."""
    if not name or os.path.basename(name) != name or name in (".", ".."):
        raise ValueError(f"not a name: {name!r}")
    path = f"{root.rstrip('/')}/{name}"
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{table}")
    preview(tables, privacy).coalesce(1).write.mode("overwrite").json(f"{path}/preview")
    return path


def emit(result: DataFrame, path: str, form: str = "json") -> None:
    """Rows of a result in the order of its columns, as json, csv or parquet, written by the executors."""
    if form not in ("json", "csv", "parquet"):
        raise ValueError(f"no form {form}")
    writer = result.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else getattr(writer, form)(path)


def query_files(roots: Sequence[str]) -> dict[str, tuple[str, str]]:
    """SQL files by path below their root: (root, digest); roots come in order and the first that has a path wins."""
    out: dict[str, tuple[str, str]] = {}
    for root in roots:
        for file in sorted(glob.glob(os.path.join(root, "**", "*.sql"), recursive=True)):
            with open(file, "rb") as f:
                out.setdefault(os.path.relpath(file, root).removesuffix(".sql"), (root, hashlib.sha256(f.read()).hexdigest()))
    return out


def as_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, default=str)
