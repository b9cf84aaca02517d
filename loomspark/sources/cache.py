"""Flattened tables kept as Parquet under a key of their sources, run receipts, and discovery filters."""

from __future__ import annotations

import hashlib
import json
import tempfile
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.schema import TABLES

VERSION = "loomspark-1"
_FOLDERS: dict[str, str] = {}


def cache_key(digests: Sequence[str], options: Mapping[str, Any] | None = None) -> str:
    """SHA-256 of the sorted source digests, the options and the format version."""
    return hashlib.sha256(json.dumps([VERSION, sorted(digests), sorted((options or {}).items())]).encode()).hexdigest()


def cached_tables(spark: SparkSession, root: str, key: str, make: Callable[[], Mapping[str, DataFrame]], allow: str = "auto") -> dict[str, DataFrame]:
    """The ten tables of a key: read if they are complete below root, else made, written and read.

    A set is complete when its marker is there, which is written last.  allow: auto, none (never stored).
    """
    if allow == "none":
        return dict(make())
    path = f"{root.rstrip('/')}/{key}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_COMPLETE")
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        for name, df in make().items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        fs.create(hadoop, True).close()
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in TABLES.items()}


def fingerprint(spark: SparkSession, *folders: str) -> str:
    """SHA-256 over names, sizes and times of change of all files below folders of any Hadoop file system."""
    files = []
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
        while found.hasNext():
            f = found.next()
            files.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(files)).encode()).hexdigest()


#: Bytes that a disk cache holds.
BUDGET = 2 << 30


class Lease:
    """Tables of a cache entry in use: it stays until the last lease on it is released."""

    def __init__(self, tables: Mapping[str, DataFrame], release: Callable[[], None]):
        self.tables, self._release = tables, release

    def release(self) -> None:
        self._release, once = (lambda: None), self._release
        once()

    def __enter__(self) -> Mapping[str, DataFrame]:
        return self.tables

    def __exit__(self, *_: object) -> None:
        self.release()


class TableCache:
    """Tables by key (cache_key of their sources' digests), in memory or below root, of which the least lately used go beyond a budget.

    What the disk tier holds is what its commit log says: an entry is written into a folder of its own and
    counts from its commit on, whole; an entry dropped is committed as dropped before its files go.  Entries with leases of this
    process are not dropped.  A changed source has another digest and so another key.
    """

    def __init__(self, spark: SparkSession, root: str, budget: int = BUDGET):
        from loomspark.sources.commits import CommitLog

        self.spark, self.root, self.budget = spark, root.rstrip("/"), budget
        self.commits = CommitLog(spark, f"{self.root}/commits")
        self.leases: dict[str, int] = {}
        self.memory: dict[str, dict[str, DataFrame]] = {}

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def held(self, entries: list | None = None) -> dict[str, dict[str, Any]]:
        """Entries on disk by key."""
        out: dict[str, dict[str, Any]] = {}
        for n, e in self.commits.entries() if entries is None else entries:
            if e["op"] == "put":
                out.setdefault(e["key"], e | {"n": n})
            elif out.get(e["key"], {}).get("folder") == e["folder"]:
                del out[e["key"]]
        return out

    def _used(self, entry: Mapping[str, Any], now: int | None = None) -> int:
        """When an entry was used last in ms; with now, it is used then."""
        fs, path = self._fs(f"{entry['folder']}/_USED")
        if now is not None:
            if not fs.exists(path):
                fs.create(path, True).close()
            fs.setTimes(path, now, -1)
        return fs.getFileStatus(path).getModificationTime() if fs.exists(path) else 0

    def _store(self, key: str, tables: Mapping[str, DataFrame]) -> dict[str, Any]:
        folder = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{folder}/{name}")
        fs, path = self._fs(folder)
        entry = {"op": "put", "key": key, "folder": folder, "bytes": fs.getContentSummary(path).getLength(), "schemas": {n: df.schema.json() for n, df in tables.items()}}
        self._used(entry, int(time.time() * 1000))
        mine: list[bool] = []

        def build(entries: list) -> dict[str, Any]:
            # another writer of the key came first: this one's copy is dropped again at once
            mine[:] = [key not in self.held(entries)]
            return entry if mine[0] else {"op": "drop", "key": key, "folder": folder}

        self.commits.commit(build)
        if not mine[0]:
            fs.delete(path, True)
        return self.held()[key]

    def _evict(self) -> None:
        """Drop entries nobody leases, the least lately used first, until the budget holds."""
        held = self.held()
        total = sum(e["bytes"] for e in held.values())
        for key, entry in sorted(held.items(), key=lambda x: (self._used(x[1]), x[1]["n"])):
            if total <= self.budget:
                return
            if not self.leases.get(key):
                self.commits.commit(lambda entries: {"op": "drop", "key": key, "folder": entry["folder"]})  # noqa: B023
                fs, path = self._fs(entry["folder"])
                fs.delete(path, True)
                total -= entry["bytes"]

    def get(self, key: str, make: Callable[[], Mapping[str, DataFrame]], tier: str = "auto") -> Lease:
        """Tables of a key, made if they aren't held.  tier: none, memory, disk, or auto (memory if there, else disk)."""
        if tier not in ("auto", "none", "memory", "disk"):
            raise ValueError(f"no tier {tier}")
        if tier == "none":
            return Lease(dict(make()), lambda: None)
        if tier == "memory" or (tier == "auto" and key in self.memory):
            if key not in self.memory:
                self.memory[key] = {n: df.persist() for n, df in make().items()}
            tables: Mapping[str, DataFrame] = self.memory[key]
        else:
            entry = self.held().get(key) or self._store(key, make())
            self._used(entry, int(time.time() * 1000))
            read = lambda n, schema: self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(f"{self.root}/{entry['folder']}/{n}")
            tables = {n: read(n, schema) for n, schema in entry["schemas"].items()}
        self.leases[key] = self.leases.get(key, 0) + 1
        self._evict()
        return Lease(tables, lambda: self._done(key))

    def _done(self, key: str) -> None:
        self.leases[key] -= 1
        if not self.leases[key]:
            del self.leases[key]
            for df in self.memory.pop(key, {}).values():
                df.unpersist()
            self._evict()


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir; on one machine without that setting, a temporary one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if sc.applicationId not in _FOLDERS:
            _FOLDERS[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="loomspark-tables-")
        base = _FOLDERS[sc.applicationId]
    return f"{base.rstrip('/')}/tables-{sc.applicationId}"


class StoredTables(Mapping):
    """Tables that are written when they are first asked for and read from then on, with the columns a query needs.

    make(name, tables) gives the DataFrame of a table; it may ask tables for others.
    A table that is only partly there (its writer was lost) is written again.
    """

    def __init__(self, spark: SparkSession, key: str, names: Sequence[str], make: Callable[[str, Mapping[str, DataFrame]], DataFrame]):
        self.spark, self.names, self.make = spark, tuple(names), make
        self.root = f"{shared_folder(spark)}/{hashlib.sha256(key.encode()).hexdigest()[:24]}"
        self.held: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        if name not in self.held:
            df = self.make(name, self)
            df.write.mode("overwrite").parquet(f"{self.root}/{name}")
            self.held[name] = self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")
        return self.held[name]

    def __iter__(self):
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)


def receipt(sql: str, inventory: DataFrame, status: str, rows: int, limits: Mapping[str, int]) -> dict[str, Any]:
    """What a run read and gave, as plain JSON: the inventory's digest does not depend on the order of files."""
    one = inventory.agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.bit_xor(F.xxhash64("path", "sha256")).alias("x")).first()
    return {"version": VERSION, "sql_sha256": hashlib.sha256(sql.encode()).hexdigest(), "files": one["files"], "bytes": one["bytes"], "inventory": one["x"], "status": status, "rows": rows, "limits": dict(limits)}


def discovered(found: DataFrame, activity: DataFrame | None = None, cwd: str | None = None, since: str | None = None, active_since: str | None = None) -> DataFrame:
    """Sessions found (path, cwd, started_at) by directory (case-sensitive), start and last activity.

    The cheap filters come first: activity is scanned only for what they leave.
    """
    if cwd:
        found = found.where(F.contains("cwd", F.lit(cwd)))
    if since:
        found = found.where(F.col("started_at") >= since)
    if active_since and activity is not None:
        found = found.join(activity.join(found.select("path"), "path", "left_semi"), "path").where(F.col("last_time") >= F.to_timestamp(F.lit(active_since)))
    return found


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the application's shared folder and read again: lineage ends here and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
