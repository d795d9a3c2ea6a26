"""Target-distribution importance resampling with a dictionary of distinct features.

A feature is a run of 1 to n consecutive words. Feature strings are counted over all documents and over all target texts; each
distinct string is hashed once, in that dictionary; the counts of strings that share a hash bucket add up; a bucket's gain is the
logarithm of its share in the target over its share in the documents. Gains go back to the strings and from them to the feature
counts of documents, whose sums are the weights. Gumbel noise by a hash of the row's id turns the highest weights into a sample
without replacement.

Words are the runs of ASCII letters, digits and characters beyond ASCII; A-Z are lower-cased. Null, empty and wordless texts have no
features: weight 0, and they are never drawn where `least` is above 0. Equal texts weigh the same; equal ids draw the same
noise (a null id that of "null"). Of wholly equal rows each has a rank of its own. An empty table gives an empty one; an empty
target has no counts, so gains come from the smoothing alone. Columns of the result replace equally named ones of the input.

Counts meet by string, one row a block and distinct string (keyed_blocks.py), in one exchange that both the dictionary and the way
back read. The table of gains has at most `buckets` rows, a parameter; it is broadcast up to `BROADCAST_BUCKETS`. Ranks come from
rows written in order of their scores, numbered within their partition; only the partitions' counts are summed up in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StringType

from .common import documents, dropped, fresh, split_words, written
from .keyed_blocks import Keyed, KeyedBlocks, per_document, summed
from .sharding import crc_step

#: Buckets of a table of gains that is sent to all tasks (16 bytes each).
BROADCAST_BUCKETS = 100_000
#: Bytes that end a word become spaces, and A-Z small letters.
_BYTES = bytes(32 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def plain_words(texts: pa.Array) -> pa.Array:
    """The texts with A-Z in lower case and a space for every byte that is no part of a word."""
    texts = texts.cast(pa.large_binary()) if pa.types.is_large_string(texts.type) else texts.cast(pa.binary())
    _, offsets, data = texts.buffers()
    moved = pa.py_buffer(data.to_pybytes().translate(_BYTES)) if data else data
    return pa.Array.from_buffers(pa.large_string() if texts.type == pa.large_binary() else pa.string(), len(texts), [None, offsets, moved], offset=texts.offset)


def features(texts: pa.Array, n: int) -> Keyed:
    """The runs of 1 to n words of each text; n_words and n_features as figures."""
    words, first, bounds = split_words(plain_words(texts))
    words = words.cast(pa.string())
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    n_words = np.diff(bounds)
    keys, which, owners = [words], [first.astype(np.int64)], [owner]
    strings, codes, begun = words, first.astype(np.int64), len(words)
    for k in range(2, n + 1):  # a run of k words is one of k - 1 and its next word
        m = len(first) - k + 1
        if m <= 0:
            break
        inside = owner[:m] == owner[k - 1 :]
        starts = np.flatnonzero(inside)
        runs, at = np.unique(codes[starts] * max(len(words), 1) + first[starts + k - 1], return_inverse=True)
        strings = pc.binary_join_element_wise(strings.take(pa.array(runs // max(len(words), 1))), words.take(pa.array(runs % max(len(words), 1))), " ")
        codes = np.full(m, -1, np.int64)
        codes[starts] = at
        keys.append(strings)
        which.append(begun + at)
        owners.append(owner[starts])
        begun += len(strings)
    which, owners = np.concatenate(which), np.concatenate(owners)
    by = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(bounds) - 1)
    at_bounds = np.concatenate(([0], np.cumsum(counts)))
    ptr, at, times = per_document(which[by], at_bounds, begun)
    used, at = np.unique(at, return_inverse=True)  # the empty string between white space is no word
    return Keyed(pa.concat_arrays(keys).take(pa.array(used)), ptr, at, times, [pa.array(n_words.astype(np.int64)), pa.array(counts.astype(np.int64))])


def gain(s: Column, t: Column, all_s: Column, all_t: Column, buckets: int) -> Column:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), in doubles."""
    d = lambda c: c.cast("double")
    return F.floor(1000 * F.log((d(t) + 1) * (d(all_s) + buckets) / ((d(s) + 1) * (d(all_t) + buckets)))).cast("long")


def weights(df: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10_000, text: str = "text", target_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df, or its columns `keep`, with n_words, n_features and weight: the summed gains of its text's features.

    The gains compare all of df with all of target.
    """
    figures = [("n_words", LongType()), ("n_features", LongType())]
    source = KeyedBlocks(df, text, lambda t: features(t, n), StringType(), df.columns if keep is None else keep, figures)
    aim = KeyedBlocks(target, target_text, lambda t: features(t, n), StringType(), [], figures)
    zero = F.lit(0).cast("long")
    own = source.entries().select("block", "at", "key", F.col("n").alias("s"), zero.alias("t"))
    other = aim.entries().select(F.lit(None).cast("long").alias("block"), F.lit(None).cast("int").alias("at"), "key", zero.alias("s"), F.col("n").alias("t"))
    entries = own.unionByName(other).repartition("key")
    # every distinct string is hashed here, once
    dictionary = entries.groupBy("key").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).withColumn("bucket", F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(buckets)).cast("int"))
    counts = written(dictionary.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "bucket-counts")
    both = counts.agg(F.coalesce(F.sum("s"), zero).alias("all_s"), F.coalesce(F.sum("t"), zero).alias("all_t")).first()
    gains = counts.select("bucket", gain(F.col("s"), F.col("t"), F.lit(both["all_s"]), F.lit(both["all_t"]), buckets).alias("gain"))
    gains = F.broadcast(gains) if buckets <= BROADCAST_BUCKETS else gains
    valued = dictionary.join(gains, "bucket").select("key", "gain")
    back = entries.where(F.col("block").isNotNull()).select("block", "at", "key").join(valued, "key")

    def weigh(block: Keyed, values: list[np.ndarray]) -> list[pa.Array]:
        return [pa.array(summed(values[0][block.at] * block.times, block.bounds))]

    out = written(source.with_values(back, ["gain"], weigh, [("weight", LongType())]), "weights")
    source.drop()
    aim.drop()
    dropped(counts)
    return out


def noise(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))), u from the first 32 bits of a digest of seed and key."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def drawn(df: DataFrame, percent: int, least: int, seed: int, key: str = "doc_id") -> DataFrame:
    """df, which has n_words and weight, with score and rank: of the N rows with at least `least` words, the floor(percent N / 100) of
    the highest scores are numbered from 1, ties by key; all other rows have no rank."""
    able, part, at, n, before, all_n = fresh(df, "able", "part", "at", "n", "before", "all_n")
    scored = df.withColumn("score", F.col("weight") + noise(df[key], seed)).withColumn(able, F.col("n_words") >= least)
    order = [F.col(able).desc(), F.col("score").desc(), F.col(key).asc_nulls_last()]
    # rows in order of rank, numbered within their partition; a partition's rows are counted and the counts summed up
    ranged = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ranged.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranked")
    sizes = placed.where(able).groupBy(part).agg(F.count(F.lit(1)).alias(n))  # one row a partition
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(part, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before), F.sum(n).over(Window.partitionBy(F.lit(0))).alias(all_n))
    out = placed.join(F.broadcast(sizes), part, "left")
    rank = F.col(before) + F.col(at) + 1
    return out.select(*[c for c in df.columns if c not in ("score", "rank")], "score", F.when(F.col(able) & (rank <= F.floor(F.lit(percent) * F.col(all_n) / 100)), rank).cast("long").alias("rank"))


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    weighed = weights(docs, target, n=1, buckets=10_000, keep=["doc_id"])
    return drawn(weighed, percent=10, least=20, seed=2024).select("doc_id", "n_features", "weight", "score", "rank")


def oracle() -> str:
    """DuckDB twin of op11_importance_resampling. CRC-32 is folded over the bytes of distinct words."""
    table = ", ".join(str(crc_step(b)) for b in range(256))
    words = lambda t: f"list_filter(regexp_split_to_array(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, {words('text')} AS ws FROM documents),
f AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY ALL),
b AS (SELECT w, count(*) AS n FROM (SELECT unnest({words('text')}) AS w FROM benchmark) GROUP BY w),
c AS (SELECT w, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM (SELECT w, n AS s, 0 AS t FROM f UNION ALL SELECT w, 0, n FROM b) GROUP BY w),
h AS (SELECT w, s, t, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(range(0, strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)),
        lambda c, x: xor(c // 256, [{table}][xor(c % 256, x) + 1]::BIGINT)))::BIGINT % 10000 AS bucket FROM c),
k AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM h GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0) AS al, coalesce(sum(t), 0) AS bl FROM k),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (al + 10000)::DOUBLE / ((s + 1)::DOUBLE * (bl + 10000)::DOUBLE)))::BIGINT AS gain FROM k, a),
v AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM f JOIN h USING (w) JOIN g USING (bucket) GROUP BY doc_id),
s AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
             (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5) / 4294967296))))::BIGINT AS score
      FROM d LEFT JOIN v USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS total FROM s WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= floor(10 * total / 100) THEN rank END::BIGINT AS rank
FROM s LEFT JOIN r USING (doc_id)"""


SQL = {"op11_importance_resampling": oracle()}
