"""What the operators of this subpackage share: the shared folder and streamed groups."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the contracts: ASCII white space, and the letters that are folded.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"

#: Bytes of an Arrow batch that goes to a Python task.  Larger buffers lie outside the pools of the JVM, which then keeps
#: pieces of them for good: an executor's memory would grow from stage to stage.
ARROW_BYTES = 4 << 20
_ARROW_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"

_LOCAL_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()
_SAVED: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share.

    Where the session names none and runs on one machine (tests), one temporary
    folder is set for the application; on a cluster that is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _LOCAL_DIRS.get(sc.applicationId)
        if base is None:
            base = _LOCAL_DIRS[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="loomspark-")
            sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/loomspark-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str = "part") -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here and survives lost executors.

    The table stays until delete() or clean(): a result that is read later may need it.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    _SAVED.setdefault(spark.sparkContext.applicationId, set()).add(folder)
    df.write.parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clean(spark: SparkSession) -> None:
    """Delete every table that this application saved; call it when the results have been written."""
    for folder in _SAVED.pop(spark.sparkContext.applicationId, set()):
        _remove(spark, folder)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def delete(*tables: DataFrame) -> None:
    """Delete tables of save() that have served; the caller holds what was made of them in other tables."""
    for df in tables:
        for folder in {p.rsplit("/", 2)[0] for p in df.inputFiles()}:
            _remove(df.sparkSession, folder)
            _SAVED.get(df.sparkSession.sparkContext.applicationId, set()).discard(folder)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python tasks can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    to = Path(tempfile.mkdtemp(prefix="loomspark-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(to))
    _SHIPPED.add(sc.applicationId)


def limit_batches(spark: SparkSession) -> None:
    """Arrow batches of the session hold ARROW_BYTES at most; a lower limit that is set already stays."""
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_ARROW_LIMIT))
    if not 0 < now <= ARROW_BYTES:
        spark.conf.set(_ARROW_LIMIT, str(ARROW_BYTES))


def give_back() -> None:
    """Return free memory of this process to the system: Python workers are used again by other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; others give back by themselves
    if trim:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """df.mapInArrow(fn, schema) with this package at hand in the tasks, in batches of bounded size."""
    ship(df.sparkSession)
    limit_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def together(batches: Iterator[pa.RecordBatch], rows: int, most: int = 8 * ARROW_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in batches of `rows`, or fewer if they hold `most` bytes; the last holds the rest."""
    held: list[pa.RecordBatch] = []
    n = size = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n, size = n + part.num_rows, size + part.nbytes
            if n == rows or size >= most:
                yield pa.concat_batches(held)
                held, n, size = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def fold_ascii(text):
    """A-Z to a-z and nothing else; plain lower() where the text is all ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hash_pair(col) -> list:
    """Two independent 64-bit hashes, to be used together as a 128-bit key."""
    return [F.xxhash64(col), F.xxhash64(F.lit(1), col)]


def map_groups(df: DataFrame, keys: list[str], fn: Callable, schema: str) -> DataFrame:
    """Call fn(key, pyarrow.Table) for each group of keys and stream its tables out.

    Groups are dealt by hash and sorted inside the partition, so one task holds one
    group at a time and many small groups share an Arrow batch.  Callers bound the
    size of a group beforehand (blocks of a salted key).
    """
    out = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        waiting: list[pa.Table] = []
        rows = 0

        def done(key, parts):
            res = fn(key, pa.Table.from_batches(parts))
            return None if res is None else res.cast(out) if res.schema != out else res

        def flush():
            for b in pa.concat_tables(waiting).to_batches():
                yield b

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            tuples = list(zip(*cols))
            start = 0
            for i in range(len(tuples) + 1):
                if i == len(tuples) or (tuples[i] != (tuples[i - 1] if i else last) and (i or last is not None)):
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if i < len(tuples) and held:
                        res = done(tuples[i - 1] if i else last, held)
                        held = []
                        if res is not None and res.num_rows:
                            waiting.append(res)
                            rows += res.num_rows
                            if rows > 20000:
                                yield from flush()
                                waiting, rows = [], 0
                    start = i
            last = tuples[-1]
        if held:
            res = done(last, held)
            if res is not None and res.num_rows:
                waiting.append(res)
        if waiting:
            yield from flush()

    return map_arrow(df.repartition(*keys).sortWithinPartitions(*keys), run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Connected components of undirected long edges: (node, component), component the smallest node.

    Labels start at the smallest neighbour; each round takes the smallest label among
    the neighbours and then jumps along labels (label of label), so paths halve.
    State is a table in the shared folder after every round; nothing reaches the
    driver but the count of labels that changed.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    e = save(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    state = save(e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "labels")
    while True:
        pull = (
            e.join(state.select(F.col("a").alias("b"), F.col("m").alias("bm")), "b")
            .groupBy("a")
            .agg(F.min("bm").alias("bm"))
        )
        near = state.join(pull, "a").select("a", F.col("m").alias("old"), F.least("m", "bm").alias("m"))
        # the label's own (old) label: a jump along the pointer
        up = state.select(F.col("a").alias("m"), F.col("m").alias("mm"))
        jumped = near.join(up, "m", "left").select("a", "old", F.least("m", F.coalesce("mm", "m")).alias("m"))
        nxt = save(jumped, "labels")
        moved = nxt.where("m < old").limit(1).count()
        delete(state)
        state = nxt.select("a", "m")
        if not moved:
            delete(e)
            return state.select(F.col("a").alias("node"), F.col("m").alias("component"))
