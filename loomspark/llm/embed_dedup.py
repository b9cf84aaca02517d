"""Near-duplicate embeddings by a pivot-permutation index.

Every vector is described by its few nearest reference points (pivots) in order.
Vectors must share two pivots to be compared, so there is an inverted list for each
pair of pivots, with the ids of the vectors that name both: the shared count is known
before a vector is fetched.  With pivots growing as the square root of the vectors,
pairs of pivots grow as the vectors do and lists stay short.  Vectors are fetched for
lists of two or more and verified by cosine in double precision.  Exact copies are one
entry with a count.  A list longer than a block is cut into pairs of blocks, so no
list is capped and none lands in one task.  Pairs are never written: a block gives,
per vector, how many others it links with and one link towards the smallest member of
its part, which is what counts and components need.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.shared import components, map_arrow, map_groups, save
from loomspark.llm.vectors import keyed, matrix, sample, takes_part

COSINE = 0.98
#: Pivots: twice the square root of the number of distinct vectors, within these bounds.
PIVOTS = (32, 4096)
#: Pivots closer than this are one: a crowd of near copies must not fill its own descriptions.
PIVOT_COSINE = 0.8
#: Nearest pivots that describe a vector: 15 lists each.
PREFIX = 6
#: Lists up to this long meet together, about as many rows at a time.
BUCKET = 192
BLOCK = 512


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.sum(v * v, axis=1, keepdims=True))


def spread(v: np.ndarray, most: int) -> np.ndarray:
    """Rows of v, in order, that aren't close to an earlier one, up to most."""
    kept = np.zeros((0, v.shape[1]))
    for x in v:
        if len(kept) < most and (kept @ x < PIVOT_COSINE).all():
            kept = np.vstack([kept, x])
    return kept


def near_duplicates(rows: DataFrame, cosine: float = COSINE, prefix: int = PREFIX) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of rows (vec_id, embedding, label).

    Only rows with the same non-null label and the same vector length are compared.
    Null, zero and non-finite vectors, and rows with a null label or vec_id, link
    with nothing and are kept as components of their own.  Rows that repeat a vec_id
    count as vectors each for itself and share its component.
    """
    spark = rows.sparkSession
    rows = rows.select("vec_id", "embedding", "label")
    ok = keyed(rows.where("label is not null and vec_id is not null"), "label")
    classes = save(ok.groupBy("label", "h1", "h2").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    total = classes.count()
    wanted = int(np.clip(2 * total**0.5, *PIVOTS))
    picked: dict[int, list] = {}
    for r in sample(classes.select("embedding", "h1", "h2").dropDuplicates(["h1", "h2"]), 2 * wanted).select("embedding").collect():
        picked.setdefault(len(r["embedding"]), []).append(r["embedding"])
    held = spark.sparkContext.broadcast({d: spread(_unit(np.array(v, np.float64)), wanted) for d, v in picked.items()})

    def describe(batches):
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(2)]) if batch.num_rows else np.zeros(0, int)
            for d in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == d)))
                pivots = held.value[int(d)]
                score = _unit(matrix(pa.chunked_array([part.column(2)]))) @ pivots.T
                n = min(prefix, len(pivots))
                order = np.argsort(-score, axis=1, kind="stable")[:, :n].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(order), pa.list_(pa.int32()))], [*part.schema.names, "pivots"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.select("label", "rep", "embedding", "n").schema.fields)
    described = save(map_arrow(classes.select("label", "rep", "embedding", "n"), describe, schema + ", pivots array<int>"), "described")
    key = ["label", "dim", "p", "q"]
    named = F.array_sort("pivots")
    couples = F.flatten(F.transform(named, lambda p, i: F.transform(F.slice(named, i + 2, F.size(named)), lambda q: F.struct(p.alias("p"), q.alias("q")))))
    # where there is a single pivot, its list holds all
    couples = F.when(F.size("pivots") > 1, couples).otherwise(F.transform(named, lambda p: F.struct(p.alias("p"), p.alias("q"))))
    lists = described.select("label", F.size("embedding").alias("dim"), "rep", F.explode(couples).alias("c")).select("label", "dim", "c.p", "c.q", "rep")
    sizes = lists.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    # short lists of one length of vectors share a bucket; of a long one the number of blocks, the block of the vector and the pairs of blocks that it takes part in
    placed = lists.join(sizes.select(*key, F.when(F.col("size") > BUCKET, F.ceil(F.col("size") / BLOCK)).otherwise(0).cast("int").alias("nb")), key)
    long = F.col("nb") > 0
    placed = placed.withColumn("list", F.xxhash64(*key)).withColumn("bucket", F.when(long, F.col("list")).otherwise(F.pmod("list", F.lit(-(-total * prefix * prefix // (2 * BUCKET))))))
    placed = placed.withColumn("blk", F.when(long, F.pmod(F.xxhash64("rep"), F.col("nb"))).otherwise(0).cast("int"))
    placed = placed.withColumn("other", F.explode(F.when(long, F.sequence(F.lit(0), F.col("nb") - 1)).otherwise(F.array(F.lit(0)))))
    placed = placed.select("dim", long.alias("long"), "bucket", F.least("blk", "other").alias("ti"), F.greatest("blk", "other").alias("tj"), "list", "p", "q", "blk", "rep")
    tiles = placed.join(described.drop("label"), "rep")

    def meet(group, table: pa.Table) -> pa.Table:
        ti, tj = group[3:]
        rep, n, blk, lists_, p, q = (table.column(c).to_numpy() for c in ("rep", "n", "blk", "list", "p", "q"))
        v, x = _unit(matrix(table.column("embedding"))), matrix(table.column("pivots"), np.int64)
        order = np.argsort(rep, kind="stable")
        rep, n, blk, lists_, p, q, v, x = rep[order], n[order], blk[order], lists_[order], p[order, None], q[order, None], v[order], x[order]
        link = (v @ v.T >= cosine) & (lists_[:, None] == lists_[None, :])
        np.fill_diagonal(link, False)
        if ti != tj:
            link &= blk[:, None] != blk[None, :]
        label = np.arange(len(rep))
        while True:  # the smallest linked row, until nothing changes
            new = np.minimum(label, np.where(link, label[None, :], len(rep)).min(axis=1, initial=len(rep)))
            new = new[new]
            if (new == label).all():
                break
            label = new
        # a pair counts in the list of its two smallest shared pivots only: no other shared one below q
        at, other = np.nonzero((x < q) & (x != p))
        if len(at) and link.any():
            seen, column = np.unique(x[at, other], return_inverse=True)
            has = np.zeros((len(x), len(seen)), np.float32)
            has[at, column] = 1
            link &= has @ has.T == 0
        links = link @ n
        use = (links > 0) | (label != np.arange(len(rep)))
        return pa.table({"rep": rep[use], "links": links[use].astype(np.int64), "root": rep[label][use]})

    met = save(map_groups(tiles, ["dim", "long", "bucket", "ti", "tj"], meet, "rep long, links long, root long"), "links")
    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(met.where("rep <> root").select("rep", "root").distinct(), "rep", "root")
    per_class = classes.select("label", "h1", "h2", "rep", "n").join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = per_class.select("label", "h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    inside = ok.select("vec_id", "label", "h1", "h2").join(per_class, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(F.col("label").isNull() | F.col("vec_id").isNull() | ~takes_part(F.col("embedding")))
    out = inside.unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = f"""
WITH RECURSIVE ok AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach(v, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.v, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT e.vec_id, (SELECT CAST(count(*) AS BIGINT) FROM links WHERE links.a = e.vec_id) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e JOIN (SELECT v, min(r) AS c FROM reach GROUP BY v) m ON m.v = e.vec_id
"""
