"""Nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors. A vector stands for the order of its nearest pivots; in each index shard every
vector is posted, with its place in that order, to the inverted files of its nearest pivots. A query walks the files of its
own pivots, which sums up the footrule distance of the two orders for all vectors of the shard, and the closest share of them is
reranked by exact cosine. Queries go to all shards, in blocks.

Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part, nor do
rows without an id. Of equal vectors only the k + 1 smallest ids are indexed: no other can be among a query's k nearest,
since ties go to smaller ids. Queries with no candidate return no row. Rows are told apart by a number of their own, so
of rows with one id each is a candidate for the others, and each query row gets its own k.

A query meets every shard: at recall 0.9 the lists of some nearest pivots don't do. On the test tables (64 dimensions, where a
row's nearest others have cosines of 0.35 to 0.5) lists that hold 0.9 of the true neighbours hold 0.3 to 0.5 of all rows:
with 452 pivots, 8 postings a row and 16 lists a query 0.877 and 0.236 on 51282 rows, 0.716 and 0.128 with 8 lists. So work
is the square of the rows here, on packed arrays, and shards and blocks bound what a task holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import written

#: Pivots, how many of them a vector is posted to, and the rows that they are drawn from.
PIVOTS, POSTED, PIVOT_ROWS = 128, 64, 2048
#: Share of a shard's vectors that is reranked, and how many at least; besides, all within this part of the largest footrule
#: distance are, however many (a tight cluster's members have nearly the same orders).
SHARE, LEAST, CLOSE = 0.2, 512, 0.25
SHARD_ROWS, BLOCK_QUERIES = 20_000, 8192


def _matrix(column) -> np.ndarray:
    """The vectors of an Arrow list column as rows of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return scaled(np.asarray(flat.flatten(), np.float64).reshape(n, -1)) if n else np.zeros((0, 0))


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that squares neither over- nor underflow; cosines stay what they are to the last bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def orders(x: np.ndarray, pivots: np.ndarray, posted: int) -> np.ndarray:
    """Weights of the pivots for each vector: `posted` for the nearest, less by one for each next, 0 beyond those posted."""
    near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ pivots.T
    ranks = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1, kind="stable")
    return np.maximum(posted - ranks, 0).astype(np.int16)


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """n of the sample's directions that lie far apart: each next is the one least like those taken (a dense cluster gets few)."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    taken, like = [0], unit @ unit[0]
    while len(taken) < min(n, len(unit)):
        taken.append(int(like.argmin()))
        if like[taken[-1]] > 1 - 1e-9:
            taken.pop()
            break
        like = np.maximum(like, unit @ unit[taken[-1]])
    return unit[taken]


def search(ids: np.ndarray, rows: np.ndarray, x: np.ndarray, query_rows: np.ndarray, q: np.ndarray, pivots: np.ndarray, k: int, posted: int, share: float, least: int, close: float = CLOSE):
    """The k nearest found of each query in one shard: (query row, id, cosine). rows: numbers that tell rows apart."""
    weights, wanted = orders(x, pivots, posted), orders(q, pivots, posted)
    files = [(at := np.flatnonzero(weights[:, p]), weights[at, p]) for p in range(len(pivots))]
    norms, n, full = np.linalg.norm(x, axis=1), len(ids), posted * (posted + 1)
    reranked = min(n, max(least, int(np.ceil(share * n))))
    out = []
    for i in range(len(q)):
        # footrule = constant - 2 * sum of the smaller weight over shared pivots
        shared = np.zeros(n, np.int32)
        for p in np.flatnonzero(wanted[i]):
            at, w = files[p]
            shared[at] += np.minimum(w, wanted[i, p])
        best = np.argpartition(-shared, reranked - 1)[:reranked] if reranked < n else np.arange(n)
        if reranked < n:  # with all ties at the edge, so the order of rows plays no part
            best = np.flatnonzero(shared >= min(shared[best].min(), (1 - close) * full / 2))
        best = best[rows[best] != query_rows[i]]
        cosine = (x[best] * q[i]).sum(1) / (norms[best] * np.linalg.norm(q[i]))
        top = np.lexsort((ids[best], -cosine))[:k]
        out += zip([query_rows[i]] * len(top), ids[best][top], cosine[top], strict=True)
    return out


def nearest(df: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, posted: int = POSTED, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row for which `is_query` (a condition) holds."""
    v = F.col("v")
    usable = df.select(df[key].cast("long").alias("id"), df[vector].cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where(
        F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False))) & F.exists(v, lambda c: c != 0)
    )
    usual = usable.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # numbered once, since a number must be the same wherever it is read
    usable = written(usable.where(F.size(v) == usual["n"]).withColumn("row", F.monotonically_increasing_id()), "vectors")
    drawn = {tuple(r["v"]) for r in usable.select("v", "id").orderBy(F.xxhash64("id"), "id").limit(PIVOT_ROWS).collect()}
    pivot = spread(scaled(np.array(sorted(drawn))), pivots)
    posted = min(posted, max(1, len(pivot) // 2) if len(pivot) > 1 else 1)

    copies = Window.partitionBy("v").orderBy("id", "row")
    index = usable.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)
    totals = usable.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("q")).first()
    shards, blocks = -(-totals["n"] // SHARD_ROWS), max(1, -(-totals["q"] // BLOCK_QUERIES))
    place = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    # each shard meets each block of queries once
    left = index.select("id", "row", "v", place(shards, 1).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = usable.where("is_query").select("row", "v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), place(blocks, 2).alias("block"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = search(a["id"].to_numpy(), a["row"].to_numpy(), _matrix(a["v"]), b["row"].to_numpy(), _matrix(b["v"]), pivot, k, posted, share, least) if a.num_rows and b.num_rows else []
        columns = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table({"row": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(run, "row long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.join(usable.where("is_query").select("row", F.col("id").alias("query_id")), "row").select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op8_permutation_index(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, F.pmod("vec_id", F.lit(50)) == 0)
