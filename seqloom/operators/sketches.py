"""Sequences to k-mer, window and signature tables.

A signature's logical form is one row a set bit: (seq_id, bit) flat, (seq_id, window_id, bit) windowed. Everything before the
explode is narrow, and bits are made distinct inside the row's own array, so building a table needs no shuffle. Sequences go through numpy
in slices of an Arrow batch (functions/batches.py), each evaluated once, whatever follows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StructField, StructType

from ..config import SketchConfig
from ..functions import batches, kmers


def dna(df: DataFrame, id_column: str, text: str, *keep: str) -> DataFrame:
    """(seq_id, seq, kept columns) from any text: its ACGT letters."""
    return df.select(F.col(id_column).alias("seq_id"), kmers.text_as_dna(F.col(text)).alias("seq"), *keep)


def hash_array(cfg: SketchConfig, seq: str = "seq") -> Column:
    return kmers.hashes(F.col(seq), cfg.k, cfg.canonical, cfg.seed)


def _mapped(seqs: DataFrame, keep: tuple[str, ...], run: Callable, **made: DataType) -> DataFrame:
    """(seq_id, kept, made): run(sequences) -> (rows of the slice or None for each once, arrays of the made columns), slice by slice."""
    kept = ["seq_id", *keep]
    schema = StructType([seqs.schema[c] for c in kept] + [StructField(c, kind) for c, kind in made.items()])

    def each(found):
        for batch in found:
            seq = batch.column(len(kept))
            for low, high in batches.slices(seq):
                rows, columns = run(seq.slice(low, high - low))
                own = [batch.column(i).slice(low, high - low) for i in range(len(kept))]
                own = own if rows is None else [c.take(pa.array(rows)) for c in own]
                yield pa.record_batch([*own, *columns], [*kept, *made])

    return seqs.select(*kept, "seq").mapInArrow(each, schema)


def _numbered(at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(row, place in the row) of what lies between bounds."""
    n = np.diff(at)
    return np.repeat(np.arange(len(n)), n), pa.array(batches.runs(np.zeros_like(n), n), pa.int32())


def kmer_rows(seqs: DataFrame, cfg: SketchConfig, *keep: str) -> DataFrame:
    """(seq_id, kept, pos, h): every k-mer."""

    def run(seq: pa.Array) -> tuple:
        h, at = batches.hashes(seq, cfg)
        rows, places = _numbered(at)
        return rows, [places, pa.array(h)]

    return _mapped(seqs, keep, run, pos=IntegerType(), h=LongType())


def _chosen(seq: pa.Array, cfg: SketchConfig) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's minimisers, or of all k-mers where k = w, and bounds."""
    h, at = batches.hashes(seq, cfg)
    return (h, at) if cfg.k == cfg.w else batches.minimisers(h, at, cfg.width)


def minimiser_rows(seqs: DataFrame, cfg: SketchConfig, *keep: str) -> DataFrame:
    """(seq_id, kept, h): each sequence's distinct window minima; all k-mers where k = w."""

    def run(seq: pa.Array) -> tuple:
        h, at = batches.distinct(*_chosen(seq, cfg))
        return _numbered(at)[0], [pa.array(h)]

    return _mapped(seqs, keep, run, h=LongType())


def window_rows(seqs: DataFrame, cfg: SketchConfig, *keep: str) -> DataFrame:
    """(seq_id, kept, window_id, hashes): the s smallest hashes of each window."""

    def run(seq: pa.Array) -> tuple:
        found, at = batches.windows(*batches.hashes(seq, cfg), cfg)
        rows, places = _numbered(at)
        return rows, [places, batches.listed(found.ravel(), np.arange(len(found) + 1) * cfg.s, pa.int64())]

    return _mapped(seqs, keep, run, window_id=IntegerType(), hashes=ArrayType(LongType(), False))


def window_lists(seqs: DataFrame, cfg: SketchConfig, *keep: str) -> DataFrame:
    """(seq_id, kept, hashes): the least hash of each window, in order; an empty list without windows."""

    def run(seq: pa.Array) -> tuple:
        found, at = batches.windows(*batches.hashes(seq, cfg), cfg)
        return None, [batches.listed(found[:, 0], at, pa.int64())]

    return _mapped(seqs, keep, run, hashes=ArrayType(LongType(), False))


#: Bits of a window's part of a number that stands for (window, bit).
WINDOW = 1 << 20


def window_keys(seqs: DataFrame, cfg: SketchConfig, *keep: str) -> DataFrame:
    """(seq_id, kept, bits): the signatures of all windows in one array of numbers window * WINDOW + bit, ascending; empty without windows."""

    def run(seq: pa.Array) -> tuple:
        found, at = batches.windows(*batches.hashes(seq, cfg), cfg)
        bits, upto = batches.distinct(batches.bits(found.ravel(), cfg.bits, cfg.k), np.arange(len(found) + 1) * cfg.s)
        n = np.diff(at)
        window = np.repeat(batches.runs(np.zeros_like(n), n), np.diff(upto)).astype(np.int64)
        return None, [batches.listed(window * WINDOW + bits, upto[at], pa.int64())]

    return _mapped(seqs, keep, run, bits=ArrayType(LongType(), False))


def flat(seqs: DataFrame, cfg: SketchConfig, *keep: str) -> DataFrame:
    """(seq_id, kept, bits): one signature a sequence over its minimisers, or over all k-mers where k = w."""

    def run(seq: pa.Array) -> tuple:
        h, at = _chosen(seq, cfg)
        return None, [batches.listed(*batches.distinct(batches.bits(h, cfg.bits, cfg.k), at), pa.int32())]

    return _mapped(seqs, keep, run, bits=ArrayType(IntegerType(), False))


def windowed(seqs: DataFrame, cfg: SketchConfig, *keep: str) -> DataFrame:
    """(seq_id, kept, window_id, bits): one signature a window."""

    def run(seq: pa.Array) -> tuple:
        found, at = batches.windows(*batches.hashes(seq, cfg), cfg)
        rows, places = _numbered(at)
        own = batches.distinct(batches.bits(found.ravel(), cfg.bits, cfg.k), np.arange(len(found) + 1) * cfg.s)
        return rows, [places, batches.listed(*own, pa.int32())]

    return _mapped(seqs, keep, run, window_id=IntegerType(), bits=ArrayType(IntegerType(), False))


def bit_rows(signatures: DataFrame) -> DataFrame:
    """One row a set bit."""
    return signatures.select(*[c for c in signatures.columns if c != "bits"], F.explode("bits").alias("bit"))


def merged(signatures: DataFrame, *by: str) -> DataFrame:
    """Signatures united by group: (group, bit). Equal bits meet map-side before the shuffle."""
    return bit_rows(signatures).select(*by, "bit").distinct()


def compressed(signatures: DataFrame, sizes: list[int]) -> DataFrame:
    """(seq_id, bits) of flat signatures folded to each of the sizes in turn, distinct in the row: nothing is shuffled."""

    def each(found):
        for batch in found:
            own = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            for size in sizes:
                own = own % size
            at = batches.bounds(pa.compute.fill_null(pa.compute.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            yield pa.record_batch([batch.column(0), batches.listed(*batches.distinct(own, at), pa.int32())], ["seq_id", "bits"])

    schema = StructType([signatures.schema["seq_id"], StructField("bits", ArrayType(IntegerType(), False))])
    return signatures.select("seq_id", "bits").mapInArrow(each, schema)


def folded(signatures: DataFrame, m: int) -> DataFrame:
    """Windows folded modulo m: (seq_id, window_id, bit)."""
    return bit_rows(signatures).select("seq_id", F.pmod("window_id", F.lit(m)).alias("window_id"), "bit").distinct()


def counts(signatures: DataFrame) -> DataFrame:
    """(seq_id, n): set bits of the signature, of all windows' union where it is windowed. Sequences without bits count 0."""
    if "window_id" in signatures.columns:
        signatures = signatures.groupBy("seq_id").agg(F.array_distinct(F.flatten(F.collect_list("bits"))).alias("bits"))
    return signatures.select("seq_id", F.size("bits").cast("long").alias("n"))


def elements(seqs: DataFrame, cfg: SketchConfig, approximate: bool = False, all_windows: bool = True) -> DataFrame:
    """Distinct hashes kept over all sequences: what to size a signature for."""
    rows = window_rows(seqs, cfg)
    rows = rows if all_windows else rows.where("window_id = 0")
    h = rows.select(F.explode("hashes").alias("h"))
    return h.agg((F.approx_count_distinct("h") if approximate else F.count_distinct("h")).alias("n"))


def disjoint(seqs: DataFrame, cfg: SketchConfig, *keep: str) -> DataFrame:
    """(seq_id, kept, window_id, h, pos): the least hash of each window and its right-most place; windows don't overlap in bases."""
    return seqs.select("seq_id", *keep, F.posexplode(kmers.window_minima(hash_array(cfg), cfg.width, cfg.hop)).alias("window_id", "x")).select("seq_id", *keep, "window_id", "x.h", "x.pos")


def membership(asked: DataFrame, signatures: DataFrame, by: str) -> DataFrame:
    """(seq_id, by, contains_all, contains_none, first_missing, first_found): asked (seq_id, bits), a row an id, against signatures (by, bit).

    Only bits that both have meet, by an equi-join; names come to the asked rows in blocks. An asked row without bits has no result.
    """
    from ..sources.storage import written
    from .facing import facing

    asked = written(asked.select("seq_id", F.array_distinct("bits").alias("asked_bits")).where(F.size("asked_bits") > 0), "asked")
    signatures = written(signatures.select(by, "bit").distinct(), "signatures")
    names = facing(asked.select("seq_id"), F.col("seq_id"), signatures.select(by).distinct(), by)
    pairs = names.select("seq_id", F.inline("block"))
    bits = asked.select("seq_id", F.explode("asked_bits").alias("bit"))
    got = bits.join(signatures, "bit").groupBy("seq_id", by).agg(F.collect_list("bit").alias("got"))  # at most a signature's bits
    met = pairs.join(got, ["seq_id", by], "left").join(asked, "seq_id")
    got = F.coalesce("got", F.array().cast("array<int>"))
    missing = F.array_except("asked_bits", got)
    return met.select("seq_id", by, (F.size(missing) == 0).alias("contains_all"), (F.size(got) == 0).alias("contains_none"), F.array_min(missing).alias("first_missing"), F.array_min(got).alias("first_found"))


def shuffled(seqs: DataFrame, seed: int) -> DataFrame:
    """With a column `order` that a seed gives: the order in which sequences are inserted."""
    return seqs.withColumn("order", F.md5(F.concat_ws("/", F.lit(seed), "seq_id")))


def capped(seqs: DataFrame, most: int, *by: str) -> DataFrame:
    """The first `most` sequences in an order."""
    return seqs.orderBy(*(by or ("seq_id",))).limit(most)


def placed(seqs: DataFrame, *by: str) -> DataFrame:
    """(seq_id, place): places from 0 in an order, counted by ranges of it."""
    from .leader import ordered

    return ordered(seqs.select("seq_id", *[c for c in by if c != "seq_id"]), *[F.col(c) for c in by]).select("seq_id", F.col("rank").cast("long").alias("place"))
