"""Sessions of native agents below folders: a listing made on the executors, and locators of each framework.

Folders are rows: the first levels are listed a round each, so that folders spread over
tasks; what lies deeper is walked by the task that got the folder, which holds its open
folders and one folder's names.  Headers read no more than the head of a log, on the
executors; no list of files reaches the driver.  Addresses (hdfs:, s3:, gs:, file:) work
like plain paths.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.sources.cache import stored
from loomspark.sources.records import HEAD_BYTES, HEAD_RECORDS, judged, opened, physical

LISTED = "root string, path string, parent string, name string, is_dir boolean, bytes long"
LOCATOR = ("framework", "id", "format_hint", "source_path", "cwd", "started_at", "parent_session_id")
#: Rows that a listing task sends at a time.
BATCH = 10_000

# Fixed values of the frameworks' folders and logs.
SESSION_ID_CHARS = 32
CODEX_SESSION = ("session_meta", "response_item", "event_msg", "turn_context")
CODEX_EXEC = ("thread.started", "turn.started", "turn.completed", "item.started", "item.completed")
FORMAT_LINES = 5


def located(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what precedes that path in an address)."""
    if ":/" not in path:
        return fs.LocalFileSystem(), path, ""
    system, at = fs.FileSystem.from_uri(path)
    plain = path.rstrip("/")
    return system, at, plain[: -len(at)] if at and plain.endswith(at) else ""


def _entries(root: str, folder: str) -> Iterator[tuple]:
    system, at, before = located(folder)
    for info in system.get_file_info(fs.FileSelector(at)):
        yield root, before + info.path, folder, info.base_name, info.type == fs.FileType.Directory, info.size or 0


def _list(deep: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        names = [c.split()[0] for c in LISTED.split(", ")]
        for pdf in batches:
            for root, folder in zip(pdf["root"], pdf["path"]):
                todo = [folder]
                while todo:
                    for entry in _entries(root, todo.pop()):
                        held.append(entry)
                        if deep and entry[4]:
                            todo.append(entry[1])
                        if len(held) >= BATCH:
                            yield pd.DataFrame(held, columns=names)
                            held = []
        yield pd.DataFrame(held, columns=names)

    return run


def listing(spark: SparkSession, roots: Sequence[str], spread: int = 2) -> DataFrame:
    """(root, path, parent, name, is_dir, bytes): all that lies below folders; a root that isn't there is an error.

    spread: so many levels are listed in rounds of their own; each folder below is walked whole by one task.
    """
    tasks = 4 * spark.sparkContext.defaultParallelism
    folders = spark.createDataFrame([(r.rstrip("/") or "/",) * 2 for r in dict.fromkeys(roots)], "root string, path string")
    levels = []
    for deep in [False] * spread + [True]:
        level = stored(folders.repartition(tasks, "path").mapInPandas(_list(deep), LISTED), "listing")
        levels.append(level)
        folders = level.where("is_dir").select("root", "path")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def head_lines(paths: DataFrame, as_text: bool = False) -> DataFrame:
    """(path, line_no, value) of the JSON objects in the heads of logs, or of a head's lines as_text; unreadable files have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                try:
                    with opened(path) as file:
                        head = file.read(HEAD_BYTES)
                except OSError:
                    continue
                if as_text:
                    rows = [(path, i, line) for i, line in enumerate(head.decode(errors="replace").splitlines(), 1)]
                else:
                    each = zip(range(HEAD_RECORDS), physical(pa.BufferReader(head), 0, len(head)))
                    rows = [(path, i + 1, text) for i, (_, _, raw) in each if (text := judged(raw)[0]) is not None]
                yield pd.DataFrame(rows, columns=["path", "line_no", "value"])

    return paths.select("path").mapInPandas(run, "path string, line_no long, value string")


def _j(path: str) -> Column:
    return F.get_json_object("value", path)


def _first(heads: DataFrame, found: Column, cwd: Column, started: Column) -> DataFrame:
    """(path, cwd, started_at) of the first head record where `found` holds."""
    got = heads.where(found).groupBy("path").agg(F.min_by(F.struct(cwd.alias("cwd"), started.alias("started_at")), "line_no").alias("h"))
    return got.select("path", "h.cwd", "h.started_at")


def _locators(framework: str, df: DataFrame) -> DataFrame:
    have = {"framework": F.lit(framework)}
    return df.select(*[(have.get(c) if c in have else F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in LOCATOR])


def _stem() -> Column:
    return F.regexp_replace("name", r"\.jsonl$", "")


def _logs(files: DataFrame) -> DataFrame:
    return files.where(~F.col("is_dir") & F.endswith("name", F.lit(".jsonl")))


def claude_code(files: DataFrame) -> DataFrame:
    """Logs named by a session id; session folders that only keep tool results; logs of subagents with their parents.

    Of two logs of one id, that of the last path stays, as folders are walked in order of their names.
    """
    logs = _logs(files).withColumn("parts", F.split("path", "/"))
    below = F.array_position("parts", F.lit("subagents"))
    is_sub = (below > 0) & (below < F.size("parts"))
    own = logs.where(~is_sub).withColumn("id", _stem()).where(F.char_length("id") >= SESSION_ID_CHARS)
    own = own.groupBy("id").agg(F.max_by("path", "parts").alias("path"))
    head = _first(head_lines(own), F.coalesce(_j("$.cwd"), F.lit("")) != "", _j("$.cwd"), _j("$.timestamp"))
    sessions = own.join(head, "path", "left").select("id", F.lit("jsonl-v2").alias("format_hint"), F.col("path").alias("source_path"), "cwd", "started_at")
    kept = files.where(F.col("is_dir") & (F.col("name") == "tool-results")).select(F.col("parent").alias("source_path"))
    kept = kept.withColumn("id", F.element_at(F.split("source_path", "/"), -1)).where(F.char_length("id") >= SESSION_ID_CHARS)
    kept = kept.groupBy("id").agg(F.min_by("source_path", F.split("source_path", "/")).alias("source_path")).join(own.select("id"), "id", "left_anti")
    subs = logs.where(is_sub & (below > 1)).select(_stem().alias("id"), F.lit("subagent").alias("format_hint"), F.col("path").alias("source_path"), F.get("parts", (below - 2).cast("int")).alias("parent_session_id"))
    return _locators("claude-code", sessions).unionByName(_locators("claude-code", kept.withColumn("format_hint", F.lit("dir-v1")))).unionByName(_locators("claude-code", subs))


def codex(files: DataFrame) -> DataFrame:
    """Logs below a root's folder `sessions` if there is one, below the root if not."""
    top = files.where(F.col("is_dir") & (F.col("name") == "sessions") & (F.col("parent") == F.col("root"))).select("root").distinct().withColumn("_s", F.lit(True))
    logs = _logs(files).join(F.broadcast(top), "root", "left")
    logs = logs.where(F.col("_s").isNull() | F.startswith("path", F.concat("root", F.lit("/sessions/"))))
    heads = stored(head_lines(logs.select("path").distinct()), "heads")
    kind = _j("$.type")
    started = F.coalesce(F.nullif(_j("$.timestamp"), F.lit("")), _j("$.payload.timestamp"))
    head = _first(heads, kind == "session_meta", _j("$.payload.cwd"), started)
    hint = F.when(kind.isin(*CODEX_SESSION), "session-jsonl-v1").when(kind.isin(*CODEX_EXEC), "exec-jsonl-v1")
    hints = heads.where(F.col("line_no") <= FORMAT_LINES).withColumn("h", hint).where("h is not null").groupBy("path").agg(F.min_by("h", "line_no").alias("format_hint"))
    out = logs.join(head, "path", "left").join(hints, "path", "left")
    return _locators("codex", out.select(_stem().alias("id"), F.coalesce("format_hint", F.lit("unknown-jsonl")).alias("format_hint"), F.col("path").alias("source_path"), "cwd", "started_at"))


def pi(files: DataFrame) -> DataFrame:
    """All logs; an id is what follows the last underscore of a name."""
    logs = _logs(files)
    head = _first(head_lines(logs.select("path").distinct()), _j("$.type") == "session", _j("$.cwd"), _j("$.timestamp"))
    after = F.regexp_extract(_stem(), "_([^_]+)$", 1)
    out = logs.join(head, "path", "left")
    return _locators("pi", out.select(F.when(after != "", after).otherwise(_stem()).alias("id"), F.lit("jsonl-v3").alias("format_hint"), F.col("path").alias("source_path"), "cwd", "started_at"))


def copilot(files: DataFrame) -> DataFrame:
    """Folders with events: the root itself, or those right below it or below its `session-state`; workspace.yaml names the session."""
    events = files.where(~F.col("is_dir") & (F.col("name") == "events.jsonl"))
    of_root = events.where(F.col("parent") == F.col("root")).select("root").distinct().withColumn("_own", F.lit(True))
    state = files.where(F.col("is_dir") & (F.col("name") == "session-state") & (F.col("parent") == F.col("root"))).select("root").distinct().withColumn("_state", F.lit(True))
    placed = events.join(F.broadcast(of_root), "root", "left").join(F.broadcast(state), "root", "left")
    above = F.regexp_replace("parent", "/[^/]+$", "")
    want = F.when(F.col("_own"), F.col("parent") == F.col("root")).when(F.col("_state"), above == F.concat("root", F.lit("/session-state"))).otherwise(above == F.col("root"))
    mine = placed.where(want).select("path", "parent")
    spaces = files.where(~F.col("is_dir") & (F.col("name") == "workspace.yaml")).join(mine.select("parent"), "parent", "left_semi").select("parent", "path")
    part = lambda i: F.regexp_extract("value", r"""^(id|cwd|created_at):[ \t]+(?:"([^"]*)"|'([^']*)'|([^#]*?))[ \t]*(?:#.*)?$""", i)
    quoted = F.concat(part(2), part(3))
    bare = part(4)
    # a bare date is a date in YAML, and told in UTC to the second
    time = F.date_format(F.to_utc_timestamp(F.try_to_timestamp(F.when(bare.rlike(r"^\d{4}-\d\d-\d\d([Tt ].*)?$"), bare)), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    value = F.trim(F.when((part(1) == "created_at") & (quoted == ""), F.coalesce(time, bare)).otherwise(F.concat(quoted, bare)))
    pairs = head_lines(spaces, as_text=True).where(part(1) != "").select("path", part(1).alias("k"), value.alias("v")).where("v <> ''")
    named = pairs.groupBy("path").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in ("id", "cwd", "created_at")])
    known = spaces.join(named, "path").drop("path")
    out = mine.join(known, "parent", "left")
    folder = F.element_at(F.split("parent", "/"), -1)
    return _locators("copilot", out.select(F.coalesce("id", folder).alias("id"), F.lit("copilot-cli-events-jsonl-v1").alias("format_hint"), F.col("path").alias("source_path"), "cwd", F.col("created_at").alias("started_at")))


FRAMEWORKS = {"claude-code": claude_code, "codex": codex, "pi": pi, "copilot": copilot}


def discover(spark: SparkSession, framework: str, roots: Sequence[str], spread: int = 2) -> DataFrame:
    """(framework, id, format_hint, source_path, cwd, started_at, parent_session_id) of a framework's sessions below folders, sorted."""
    if framework not in FRAMEWORKS:
        raise ValueError(f"no framework {framework}; there are {', '.join(FRAMEWORKS)}")
    return FRAMEWORKS[framework](listing(spark, roots, spread)).orderBy("parent_session_id", "source_path")
