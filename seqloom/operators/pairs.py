"""Similarity of all pairs by an inverted index on bits, windowed ones and those above a least similarity by blocks.

Pairs that share no bit are never formed: their similarity is 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import metrics
from . import block_pairs, window_pairs

EDGES = "i long, j long, similarity double"
#: No window.
NEVER = 1 << 40


def shared(bits: DataFrame, *on: str) -> DataFrame:
    """(i, j, on, inter) for i < j: common bits, by window where `on` names it. bits: a row a set bit."""
    a, b = bits.select(F.col("seq_id").alias("i"), *on, "bit"), bits.select(F.col("seq_id").alias("j"), *on, "bit")
    return a.join(b, [*on, "bit"]).where("i < j").groupBy("i", "j", *on).agg(F.count(F.lit(1)).alias("inter"))


def with_sizes(pairs: DataFrame, sizes: DataFrame, *on: str) -> DataFrame:
    """Pairs with both sides' sizes (na, nb). sizes: (seq_id, on, n)."""
    out = pairs.join(sizes.select(F.col("seq_id").alias("i"), *on, F.col("n").alias("na")), ["i", *on])
    return out.join(sizes.select(F.col("seq_id").alias("j"), *on, F.col("n").alias("nb")), ["j", *on])


def measure(bits: DataFrame, metric, name: str = "similarity") -> DataFrame:
    """(i, j, name) of flat signatures; metric(na, nb, inter) is a column."""
    sizes = bits.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = with_sizes(shared(bits), sizes)
    return pairs.select("i", "j", metric(F.col("na"), F.col("nb"), F.col("inter")).alias(name))


def both_ways(pairs: DataFrame, ids: DataFrame, diagonal: Column | None = None) -> DataFrame:
    """Upper-triangle pairs mirrored, with the diagonal: ids is (seq_id)."""
    value = pairs.columns[-1]
    own = ids.select(F.col("seq_id").alias("i"), F.col("seq_id").alias("j"), (F.lit(1.0) if diagonal is None else diagonal).alias(value))
    # both from one row, so that pairs are found once
    two = F.array(F.struct("i", "j", value), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), value))
    return pairs.select(F.inline(two)).unionByName(own)


def matching_windows(bits: DataFrame, window_counts: DataFrame, threshold: int) -> DataFrame:
    """(i, j, similarity): matching windows over the larger number of windows. window_counts: (seq_id, n)."""

    def share(x: window_pairs.Shared) -> dict:
        # metrics.window_matches
        hits = (x.inter >= threshold) | (x.inter == x.na + x.nb - x.inter)
        return {"i": x.i, "j": x.j, "similarity": x.total(hits.astype(np.int64)) / np.maximum(*x.counts)}

    return window_pairs.each_two(bits, share, EDGES, window_counts)


def local_jaccard(bits: DataFrame, window_counts: DataFrame, least_anchor: int = 0) -> DataFrame:
    """(i, j, similarity): mean Jaccard of the windows from the first that shares least_anchor bits on to the shorter's end."""

    def mean(x: window_pairs.Shared) -> dict:
        first = np.zeros(len(x.i), np.int64)
        if least_anchor > 0:
            first = np.minimum.reduceat(np.where(x.inter >= least_anchor, x.window, NEVER), x.first)
        after = x.window >= np.repeat(first, np.diff(np.concatenate((x.first, [len(x.window)]))))
        real = first < NEVER
        total, n = x.total(np.where(after, x.jaccard(), 0.0)), np.minimum(*x.counts) - first
        return {"i": x.i[real], "j": x.j[real], "total": total[real], "n": n[real]}

    return window_pairs.each_two(bits, mean, "i long, j long, total double, n long", window_counts).select("i", "j", F.try_divide("total", "n").alias("similarity"))


def mean_window_jaccard(bits: DataFrame, window_counts: DataFrame) -> DataFrame:
    """(i, j, similarity): sum of the windows' Jaccard over the larger number of windows."""
    return window_pairs.each_two(bits, lambda x: {"i": x.i, "j": x.j, "similarity": x.total(x.jaccard()) / np.maximum(*x.counts)}, EDGES, window_counts)


def windowed_hamming(bits: DataFrame) -> DataFrame:
    """(i, j, hd) of sequences that share a bit in some window; the longer one's tail counts with all its bits."""
    return window_pairs.each_two(bits, lambda x: {"i": x.i, "j": x.j, "hd": sum(x.sizes) - 2 * x.total(x.inter)}, "i long, j long, hd long")


def similar(signatures: DataFrame, least: float) -> DataFrame:
    """(i, j, similarity) of flat signatures (seq_id, bits) with Jaccard >= least, by blocks: nothing is shuffled by bit."""
    return block_pairs.similar(signatures, least)


def against(queries: DataFrame, references: DataFrame) -> DataFrame:
    """(i, j, inter) of two bit tables; i from the first."""
    a = queries.select(F.col("seq_id").alias("i"), "bit")
    return a.join(references.select(F.col("seq_id").alias("j"), "bit"), "bit").groupBy("i", "j").agg(F.count(F.lit(1)).alias("inter"))
