"""k-mers, windows and bits of many sequences at once, as flat numpy arrays with bounds of the rows.

The column expressions of kmers.py and bloom.py say the same for one sequence; these give equal arrays, for tasks that go through whole tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from ..config import MASK32, SALT, SketchConfig

#: Bases that are worked on at once; a longer sequence is a slice of its own.
BASES = 1 << 20
_CODES = np.full(256, 255, np.uint8)
_CODES[np.frombuffer(b"ACGT", np.uint8)] = range(4)


def slices(seqs: pa.Array, most: int = BASES) -> list[tuple[int, int]]:
    """(first, after the last) row of stretches of at most so many bases, or of one row."""
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(seqs), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, at = [], 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        out.append((at, to))
        at = to
    return out


def bounds(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    return np.arange(counts.sum()) + np.repeat(starts - bounds(counts)[:-1], counts)


def _rolled(c: np.ndarray, k: int, least_first: bool = False) -> np.ndarray:
    """Base-4 values of all runs of k codes, by doubling; the first code counts least, if asked."""
    have, value, out, done = 1, c, None, 0
    while True:
        if k & have:
            if out is None:
                out = value
            else:
                n = max(len(c) - done - have + 1, 0)
                left, right = out[:n], value[done : done + n]
                out = left + right * 4**done if least_first else left * 4**have + right
            done += have
        if 2 * have > k:
            return out
        n = max(len(value) - have, 0)
        left, right = value[:n], value[have : have + n]
        value, have = (left + right * 4**have if least_first else left * 4**have + right), 2 * have


def hashes(seqs: pa.Array, cfg: SketchConfig) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all k-mers in order, bounds of the rows); null is like a sequence without bases."""
    seqs = pa.compute.cast(pa.compute.fill_null(seqs, ""), pa.large_string())
    at = np.frombuffer(seqs.buffers()[1], np.int64)[seqs.offset : seqs.offset + len(seqs) + 1]
    letters = seqs.buffers()[2]
    codes = _CODES[np.frombuffer(letters, np.uint8)[at[0] : at[-1]]] if letters is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    if codes.max(initial=0) > 3:
        raise ValueError("a sequence holds letters other than ACGT")
    codes, counts = codes.astype(np.int64), np.maximum(np.diff(at) - cfg.k + 1, 0)
    places = runs(at[:-1] - at[0], counts)
    h = _rolled(codes, cfg.k)[places] ^ cfg.seed
    if cfg.canonical:
        h = np.minimum(h, _rolled(3 - codes, cfg.k, least_first=True)[places] ^ cfg.seed)
    return h, bounds(counts)


def bits(h: np.ndarray, m: int, k: int) -> np.ndarray:
    """bloom.bloom_bit of each hash."""
    first = (SALT ^ (SALT << 7 & MASK32)) ^ ((h & MASK32) * (SALT >> 3) & MASK32)
    low, fifth = SALT << 11 & MASK32, SALT >> 5
    rest = ~(low + fifth) & MASK32 if k <= 16 else MASK32 - (low + ((h >> 32) ^ fifth) & MASK32)
    return (first ^ rest) % m


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values of each row, ascending; bounds). Values lie between 0 and 2^62."""
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    if values.max(initial=0) < 1 << 31:
        keys = np.unique(rows << 31 | values)
        rows, values = keys >> 31, keys & ((1 << 31) - 1)
    else:
        order = np.lexsort((values, rows))
        rows, values = rows[order], values[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
        rows, values = rows[new], values[new]
    return values, np.searchsorted(rows, np.arange(len(at)))


def minimisers(h: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """kmers.minimiser_set of each row."""
    counts = np.diff(at)
    least, have = h, 1  # minima of runs of `have` from each place on
    while have < width:
        step = min(have, width - have)
        n = max(len(least) - step, 0)
        least, have = np.minimum(least[:n], least[step : step + n]), have + step
    whole = np.maximum(counts - width + 1, 0)
    short = (counts > 0) & (counts < width)
    each = np.where(short, 1, whole)
    out, to = np.zeros(each.sum(), np.int64), bounds(each)
    out[runs(to[:-1], whole)] = least[runs(at[:-1], whole)]
    for i in np.flatnonzero(short).tolist():
        out[to[i]] = h[at[i] : at[i + 1]].min()
    return distinct(out, to)


def windows(h: np.ndarray, at: np.ndarray, cfg: SketchConfig) -> tuple[np.ndarray, np.ndarray]:
    """(a row a window: its s smallest hashes, ascending; bounds of the sequences). kmers.windows: each window has all of its k-mers."""
    n = np.maximum(-((cfg.width - np.diff(at)) // cfg.hop), 0)
    starts = np.repeat(at[:-1], n) + runs(np.zeros_like(n), n) * cfg.hop
    every = h[starts[:, None] + np.arange(cfg.width)[None, :]] if len(starts) else np.zeros((0, cfg.width), np.int64)
    if cfg.s == 1:
        return every.min(1, keepdims=True), bounds(n)
    some = np.partition(every, cfg.s - 1, 1)[:, : cfg.s] if cfg.s < cfg.width else every
    return np.sort(some, 1), bounds(n)


def listed(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))
