"""Integrity of archive folders: session files, manifests, recorded sources and conversion receipts against each other.

Files are rows that the executors read and parse.  Session ids of files, manifests and
receipts meet in one aggregate, a bit for each place that knows an id; what an id's file
is called, where it lies and how long it is comes along, so every comparison after it is
a join by id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.sources.archives import ARCHIVE_GLOB, SourceError
from loomspark.sources.cache import stored
from loomspark.sources.discovery import located
from loomspark.sources.records import CHUNK, opened

ARCHIVE, MANIFEST, SOURCE, RECEIPT = CHECKS = ("archive", "manifest", "source", "receipt")
IN_FILE, IN_MANIFEST, IN_RECEIPT = 1, 2, 4
FINDING = ("path", "code", "severity", "session_id", "detail")

# Fixed values of the folders and documents.
SUFFIX = ARCHIVE_GLOB.removeprefix("*")
RECEIPT_SCHEMA = "conversion-run-v1"
STATUSES = ("created", "unchanged", "replaced")
ID_BYTES = 200

_ROOT_MANIFEST = "periods array<struct<period:string,path:string,session_count:bigint>>"
_PERIOD_MANIFEST = "period string, sessions array<struct<id:string,period:string,file_path:string,file_size_bytes:bigint>>"
_RECEIPT = "schema string, adapter string, started_at string, finished_at string, output_dir string, complete boolean, outputs array<struct<session_id:string,path:string,status:string>>, failures array<struct<stage:string,error:string>>, summary struct<requested:bigint,published:bigint,failed:bigint>"


def archive_root(path: str) -> str:
    """The folder at or above path that has a folder `active`."""
    system, at, before = located(path.rstrip("/"))
    steps = at.split("/")
    for n in range(len(steps), 0, -1):
        here = "/".join(steps[:n])
        if here and system.get_file_info(f"{here}/active").type == fs.FileType.Directory:
            return before + here
    raise SourceError(f"no archive at or above {path}")


def file_name(c: Column) -> Column:
    """The name of a session's file, without suffix: safe characters of its id, no dots in front, 200 at most."""
    safe = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^a-zA-Z0-9_\-.]", "_"), r"^\.+", "")
    return F.when(safe == "", "unknown").otherwise(F.substring(safe, 1, ID_BYTES))


def _base(path: Column, at: int = -1) -> Column:
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(at)), F.lit(""))


def _findings(df: DataFrame, code: str | Column, path: str | Column, detail: str | Column, session: str | Column | None = None, severity: str = "error") -> DataFrame:
    as_column = lambda v: F.lit(v) if isinstance(v, str) or v is None else v
    path = F.col(path) if isinstance(path, str) else path
    session = F.col(session) if isinstance(session, str) else F.lit("") if session is None else session
    return df.select(path.alias("path"), as_column(code).alias("code"), F.lit(severity).alias("severity"), F.coalesce(session, F.lit("")).alias("session_id"), as_column(detail).alias("detail"))


def _files(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, text) of the JSON files below root; text is read only where it is used."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root)
    # local paths come as file:/x
    plain = F.regexp_replace("path", "^file:/+", "/") if ":/" not in root else F.regexp_replace("path", "^file:/+", "file:///")
    return raw.select(plain.alias("path"), F.col("length").alias("bytes"), F.col("content").cast("string").alias("text"))


def _sessions(files: DataFrame, root: str) -> DataFrame:
    """(path, bytes, valid, id, period, started, source_path, fingerprint) of session files below active."""
    j = lambda p: F.get_json_object("text", p)
    mine = files.where(F.startswith("path", F.lit(f"{root}/active/")) & F.endswith("path", F.lit(SUFFIX)))
    valid = F.coalesce(F.startswith(j("$"), F.lit("{")), F.lit(False))
    return mine.select("path", "bytes", valid.alias("valid"), F.coalesce(j("$.id"), F.lit("")).alias("id"), _base(F.col("path"), -2).alias("period"), j("$.timing.started_at").alias("started"), j("$.provenance.source_path").alias("source_path"), j("$.provenance.source_fingerprint").alias("fingerprint"))


def _entries(files: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(entries, findings): what period manifests list, and what is wrong with manifests themselves."""
    at = f"{root}/manifest.json"
    text = files.select(F.col("path").alias("manifest"), "text")
    one = files.sparkSession.createDataFrame([(at,)], "root_path string").join(text, F.col("root_path") == F.col("manifest"), "left")
    one = one.withColumn("doc", F.from_json("text", _ROOT_MANIFEST)).withColumn("valid", F.coalesce(F.startswith(F.get_json_object("text", "$"), F.lit("{")), F.lit(False)))
    bad = [_findings(one.where("manifest is null"), "root-manifest-missing", "root_path", "no such file"), _findings(one.where("manifest is not null and not valid"), "root-manifest-invalid", "root_path", "not a JSON object")]
    listed = one.where("valid").select(F.explode("doc.periods").alias("p")).select(F.coalesce("p.period", F.lit("")).alias("period"), F.concat(F.lit(f"{root}/"), F.coalesce("p.path", F.lit(""))).alias("path"), F.coalesce("p.session_count", F.lit(0)).alias("n"))
    got = listed.join(text.withColumnRenamed("manifest", "path").withColumn("there", F.lit(True)), "path", "left")
    got = stored(got.select("path", "period", "n", "there", F.coalesce(F.startswith(F.get_json_object("text", "$"), F.lit("{")), F.lit(False)).alias("valid"), F.from_json("text", _PERIOD_MANIFEST).alias("doc")), "manifests")
    good = got.where("valid")
    bad += [
        _findings(got.where("there is null"), "period-manifest-missing", "path", "no such file"),
        _findings(got.where("there and not valid"), "period-manifest-invalid", "path", "not a JSON object"),
        _findings(good.where("coalesce(doc.period, '') <> period"), "period-manifest-period-mismatch", "path", "root and period manifest disagree"),
        _findings(good.where("n <> coalesce(array_size(doc.sessions), 0)"), "root-manifest-count-mismatch", F.lit(at), "period count disagrees with period manifest"),
    ]
    each = good.select("path", "period", F.explode("doc.sessions").alias("s"))
    entries = each.select(F.coalesce("s.id", F.lit("")).alias("id"), "path", "period", F.coalesce("s.file_path", F.lit("")).alias("named"), F.coalesce("s.file_size_bytes", F.lit(0)).alias("size"))
    return entries, _union(bad)


def _receipts(files: DataFrame) -> DataFrame:
    """(path, r) of conversion receipts anywhere below the root."""
    name = _base(F.col("path"))
    others = files.where(~F.endswith("path", F.lit(SUFFIX)) & (name != "manifest.json"))
    return others.where(F.endswith(F.get_json_object("text", "$.schema"), F.lit(RECEIPT_SCHEMA))).select("path", F.from_json("text", _RECEIPT).alias("r"))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def presence(sessions: DataFrame, entries: DataFrame, outputs: DataFrame) -> DataFrame:
    """(id, places, file): where an id is known (1 file, 2 manifest, 4 receipt), and its first file (path, period, bytes)."""
    file = F.struct(F.split("path", "/").alias("parts"), "path", "period", "bytes")
    known = sessions.select("id", F.lit(IN_FILE).alias("place"), file.alias("file"))
    for df, place in ((entries, IN_MANIFEST), (outputs, IN_RECEIPT)):
        known = known.unionByName(df.select("id", F.lit(place).alias("place"), F.lit(None).cast(known.schema["file"].dataType).alias("file")))
    return known.groupBy("id").agg(F.bit_or("place").alias("places"), F.min("file").alias("file"))


def reconcile(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, in_archive, in_manifest, in_receipt) of every id that any of the three knows."""
    root = archive_root(path)
    files = _files(spark, root)
    outputs = _receipts(files).select(F.explode("r.outputs").alias("o")).select(F.coalesce("o.session_id", F.lit("")).alias("id")).where("id <> ''")
    known = presence(_sessions(files, root).where("valid"), _entries(files, root)[0], outputs)
    flag = lambda bit: F.col("places").bitwiseAND(F.lit(bit)) != 0
    return known.select(F.col("id").alias("session_id"), flag(IN_FILE).alias("in_archive"), flag(IN_MANIFEST).alias("in_manifest"), flag(IN_RECEIPT).alias("in_receipt"))


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path in pdf["source_path"]:
            try:
                digest = hashlib.sha256()
                with opened(path) as file:
                    while chunk := file.read(CHUNK):
                        digest.update(chunk)
                rows.append((path, digest.hexdigest(), None))
            except (OSError, ValueError) as e:
                rows.append((path, None, str(e)))
        yield pd.DataFrame(rows, columns=["source_path", "sha256", "failed"])


def _there(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = []
        for path in pdf["target"]:
            system, at, _ = located(path)
            found.append(system.get_file_info(at).type != fs.FileType.NotFound)
        yield pd.DataFrame({"target": pdf["target"], "found": found})


def _archive_findings(sessions: DataFrame, known: DataFrame) -> list[DataFrame]:
    s = sessions.join(known.select("id", F.col("file.path").alias("first")), "id")
    name = F.concat(file_name(F.col("id")), F.lit(SUFFIX))
    month = F.substring("started", 1, 7)
    period = F.when(month.rlike(r"^\d{4}-\d{2}$"), month).otherwise("unknown")
    return [
        _findings(s.where("path <> first"), "duplicate-archive-id", "path", F.concat(F.lit("also present at "), "first"), "id"),
        _findings(sessions.where(_base(F.col("path")) != name), "archive-filename-id-mismatch", "path", F.concat(F.lit("expected "), name), "id"),
        _findings(sessions.where(F.col("period") != period), "archive-period-mismatch", "path", F.concat(F.lit("expected period "), period), "id"),
    ]


def _manifest_findings(entries: DataFrame, known: DataFrame) -> list[DataFrame]:
    e = stored(entries.join(known.select("id", "places", "file"), "id", "left").withColumn("has_file", F.col("places").bitwiseAND(F.lit(IN_FILE)) != 0), "entries")
    there, name = e.where("has_file"), _base(F.col("file.path"))
    alone = known.where(F.col("places").bitwiseAND(F.lit(IN_FILE | IN_MANIFEST)) == IN_FILE)
    return [
        _findings(e.where("not has_file"), "orphan-manifest-entry", "path", "manifest entry has no archive", "id"),
        _findings(there.where(F.col("named") != name), "manifest-path-mismatch", "path", F.concat(F.lit("expected file_path "), name), "id"),
        _findings(there.where("file.period <> period"), "manifest-period-mismatch", "path", "archive is in a different period", "id"),
        _findings(there.where("file.bytes <> size"), "manifest-size-mismatch", "path", "recorded file size differs from archive", "id"),
        _findings(alone, "orphan-archive", "file.path", "archive is absent from manifests", "id"),
    ]


def _source_findings(sessions: DataFrame) -> list[DataFrame]:
    s = sessions.where("source_path is not null")
    told = s.where("coalesce(fingerprint, '') <> ''")
    hashes = told.select("source_path").distinct().mapInPandas(_hashed, "source_path string, sha256 string, failed string")
    met = stored(told.join(hashes, "source_path"), "sources")
    return [
        _findings(s.where("coalesce(fingerprint, '') = ''"), "source-fingerprint-missing", "path", "source path is recorded without a source fingerprint", "id", "warning"),
        _findings(met.where("sha256 <> fingerprint"), "source-fingerprint-mismatch", "path", "source bytes no longer match recorded fingerprint", "id"),
        _findings(met.where("failed is not null"), "source-unavailable", "path", F.col("failed"), "id", "info"),
    ]


def _receipt_findings(receipts: DataFrame) -> list[DataFrame]:
    n = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    total = lambda c: F.coalesce(F.col(f"r.summary.{c}"), F.lit(0))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    lacks = blank(F.col("r.adapter")) | blank(F.col("r.output_dir")) | blank(F.col("r.started_at")) | blank(F.col("r.finished_at")) | F.col("r.complete").isNull()
    rules = F.array(
        F.when(lacks, "receipt lacks adapter, output directory, timestamps, or completion state"),
        F.when((total("published") != n("r.outputs")) | (total("failed") != n("r.failures")), "receipt summary does not reconcile with outputs and failures"),
        F.when(total("requested") < total("published") + total("failed"), "receipt requested count is smaller than terminal results"),
        F.when(F.col("r.complete") & (n("r.failures") > 0), "complete receipt contains failures"),
        F.when(~F.col("r.complete") & (n("r.failures") == 0), "incomplete receipt does not explain its failure"),
    )
    said = receipts.select("path", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("said"))
    out = receipts.select("path", "r.output_dir", F.explode("r.outputs").alias("o"))
    known = ~blank(F.col("o.session_id")) & F.coalesce(F.col("o.status").isin(*STATUSES), F.lit(False))
    to = F.coalesce("o.path", F.lit(""))
    target = F.when(to.rlike(r"^(/|[A-Za-z][A-Za-z0-9+.-]*:/)"), to).otherwise(F.concat_ws("/", F.regexp_replace(F.coalesce("output_dir", F.lit("")), "/+$", ""), F.nullif(to, F.lit(""))))
    placed = out.where(known).withColumn("target", target)
    seen = placed.select("target").distinct().mapInPandas(_there, "target string, found boolean")
    lost = placed.join(seen.where("not found"), "target")
    failures = receipts.select("path", F.explode("r.failures").alias("f")).where(blank(F.col("f.stage")) | blank(F.col("f.error")))
    code = "conversion-receipt-invalid"
    return [
        _findings(said, code, "path", F.col("said")),
        _findings(out.where(~known), code, "path", "receipt output lacks session identity or has an unknown status"),
        _findings(lost, "conversion-receipt-output-missing", "path", F.coalesce("o.path", F.lit("")), "o.session_id"),
        _findings(failures, code, "path", "receipt failure lacks stage or error detail"),
    ]


def validate(spark: SparkSession, path: str, checks: Sequence[str] = ()) -> DataFrame:
    """(path, code, severity, session_id, detail) of what is wrong with the archive at or around path, sorted; no check named: all.

    Files that are no JSON objects are always told.  An id in several files belongs to
    the first of them in order of their paths.  Empty archives have no findings but
    the missing manifest.
    """
    if unknown := [c for c in checks if c not in CHECKS]:
        raise ValueError(f"no check {unknown[0]}; there are {', '.join(CHECKS)}")
    wanted = checks or CHECKS
    root = archive_root(path)
    files = _files(spark, root)
    every = stored(_sessions(files, root), "sessions")
    sessions = every.where("valid")
    parts = [_findings(every.where("not valid"), "archive-json-invalid", "path", "not a JSON object")]
    if {ARCHIVE, MANIFEST} & set(wanted):
        entries, bad = _entries(files, root)
        known = stored(presence(sessions, entries, entries.limit(0)), "presence")
        if ARCHIVE in wanted:
            parts += _archive_findings(sessions, known)
        if MANIFEST in wanted:
            parts += [bad, *_manifest_findings(entries, known)]
    if SOURCE in wanted:
        parts += _source_findings(sessions)
    if RECEIPT in wanted:
        parts += _receipt_findings(stored(_receipts(files), "receipts"))
    return _union(parts).orderBy(*FINDING)
