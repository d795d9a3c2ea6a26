"""Window by window: set operations, distances, samples and means of windowed signatures (seq_id, window_id, bit).

Windows of a sequence are numbered from 0 without gaps and hold a bit each at least, so a sequence's windows are those of its
rows. Two sequences have the windows of the shorter in common; what the longer has beyond is its tail.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import metrics
from . import aggregates, pairs, sketches, window_pairs

#: Ways to compare sequences of windows.
METHODS = ("matching", "local", "global")


def measures(bits: DataFrame) -> DataFrame:
    """(i, j, inter, union_, hd, hd_common, overlap) of sequences that share a bit in some window.

    inter adds up the common windows; union_ and hd count the longer one's tail with all its bits, hd_common leaves it out; overlap is
    inter as a share of the second's bits.
    """

    def run(x: window_pairs.Shared) -> dict:
        inter = x.total(x.inter)
        na, nb = x.sizes
        return {"i": x.i, "j": x.j, "inter": inter, "union_": na + nb - inter, "hd": na + nb - 2 * inter, "hd_common": sum(x.common) - 2 * inter, "overlap": inter / nb}

    return window_pairs.each_two(bits, run, "i long, j long, inter long, union_ long, hd long, hd_common long, overlap double")


def combined(a: DataFrame, b: DataFrame, how: str = "or") -> DataFrame:
    """(key, window_id, bit) of two windowed tables (key, window_id, bit) with equal keys, window by window: `or` or `and` over common windows, and the longer one's tail whole."""
    last = lambda x, name: x.groupBy("key").agg(F.max("window_id").alias(name))
    ends = last(a, "la").join(last(b, "lb"), "key").select("key", F.least("la", "lb").alias("last"))
    each = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(2))).join(ends, "key")
    found = each.groupBy("key", "window_id", "bit").agg(F.count_distinct("side").alias("sides"), F.first("last").alias("last"))
    keep = F.lit(True) if how == "or" else (F.col("sides") == 2) | (F.col("window_id") > F.col("last"))
    return found.where(keep).select("key", "window_id", "bit")


def similarity(bits: DataFrame, window_counts: DataFrame, method: str = "matching", threshold: int = 2) -> DataFrame:
    """(i, j, similarity) by one of METHODS: share of matching windows, mean Jaccard of windows, or Jaccard of all windows' bits together."""
    if method == "global":
        return pairs.measure(bits.select("seq_id", "bit").distinct(), metrics.jaccard)
    if method == "local":
        return pairs.local_jaccard(bits, window_counts)
    if method == "matching":
        return pairs.matching_windows(bits, window_counts, threshold)
    raise ValueError(f"{method!r} is none of {METHODS}")


def sampled_similarity(bits: DataFrame, ids: DataFrame, window_counts: DataFrame, size: int, runs: int, method: str = "matching", threshold: int = 2) -> DataFrame:
    """(run, i, j, similarity in per cent) of all pairs of each run's sample, 0 where nothing is shared."""
    chosen = aggregates.sampled(ids, size, runs)
    all_pairs = chosen.select("run", F.col("seq_id").alias("i")).join(chosen.select("run", F.col("seq_id").alias("j")), "run").where("i < j")
    some = chosen.select("seq_id").distinct()
    found = similarity(bits.join(some, "seq_id"), window_counts.join(some, "seq_id"), method, threshold)
    return all_pairs.join(found, ["i", "j"], "left").select("run", "i", "j", (100 * F.coalesce("similarity", F.lit(0.0))).alias("similarity"))


def truncated_mean(members: DataFrame, group: str) -> DataFrame:
    """(group, window_id, bit): majority means of windowed members (group, seq_id, window_id, bit), as long as the shortest of them."""
    least = members.groupBy(group, "seq_id").agg(F.max("window_id").alias("last")).groupBy(group).agg(F.min("last").alias("last"))
    cut = members.join(least, group).where("window_id <= last").drop("last")
    return aggregates.mean_signature(cut, "majority", group, "window_id")


def truncated_mean_keys(members: DataFrame, group: str) -> DataFrame:
    """(group, bit): the same of members (group, seq_id, bits), a row each, whose bits stand for (window, bit) as sketches.window_keys makes them."""
    window = F.floor(F.array_max("bits") / sketches.WINDOW)
    full = members.where(F.size("bits") > 0).select(group, "seq_id", "bits")
    least = full.groupBy(group).agg(F.min(window).alias("last"))
    cut = full.join(least, group).select(group, "seq_id", F.filter("bits", lambda b: b < (F.col("last") + 1) * sketches.WINDOW).alias("bits"))
    return aggregates.mean_signature(cut, "majority", group)


def mosaic(members: DataFrame, group: str, count: int, seed: int = 0) -> DataFrame:
    """(group, cluster, window_id, bit): seeds for k-means, each window taken from a member that a hash of seed, cluster and window picks; as long as the shortest member."""
    ends = members.groupBy(group, "seq_id").agg(F.max("window_id").alias("last"))
    least = ends.groupBy(group).agg(F.min("last").alias("last"))
    wanted = least.withColumn("cluster", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("window_id", F.explode(F.sequence(F.lit(0), F.col("last").cast("int"))))
    draw = F.md5(F.concat_ws("/", F.lit(seed), "cluster", "window_id", "seq_id"))
    picked = wanted.join(ends.select(group, "seq_id"), group).groupBy(group, "cluster", "window_id").agg(F.min(F.struct(draw.alias("draw"), "seq_id")).alias("x"))
    return picked.select(group, "cluster", "window_id", "x.seq_id").join(members, [group, "seq_id", "window_id"]).select(group, "cluster", "window_id", "bit")
