"""Exact search over lists of window minima: equal lists share a leaf, so a tree is a group-by and a search is a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import SketchConfig
from .sketches import window_lists


def lists(seqs: DataFrame, cfg: SketchConfig) -> DataFrame:
    """(seq_id, hashes): the least hash of each window, in order. Sequences without windows have no list."""
    return window_lists(seqs, cfg).where(F.size("hashes") > 0)


def index(rows: DataFrame) -> DataFrame:
    """(hashes, n, first): leaves with their number of members and the smallest id."""
    return rows.groupBy("hashes").agg(F.count(F.lit(1)).alias("n"), F.min("seq_id").alias("first"))


def search(queries: DataFrame, leaves: DataFrame) -> DataFrame:
    """Queries with the leaf that has their whole list; a list that is only a beginning of another finds nothing."""
    return queries.join(leaves, "hashes")


def members(rows: DataFrame) -> DataFrame:
    """(hashes, seq_ids)."""
    return rows.groupBy("hashes").agg(F.array_sort(F.collect_list("seq_id")).alias("seq_ids"))
