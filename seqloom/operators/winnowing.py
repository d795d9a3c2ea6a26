"""Robust winnowing at the level of positions, which depends on what came before, as a numpy fold over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import batches

#: Bases whose emissions a task holds at once, about; a longer sequence is held alone.
EMITTED = 1 << 17

def hashes(seq: str, k: int) -> np.ndarray:
    """Base-4 values of all k-mers."""
    c = np.frombuffer(seq.encode().translate(bytes.maketrans(b"ACGT", bytes(range(4)))), np.uint8).astype(np.int64)
    n = max(len(c) - k + 1, 0)
    out = np.zeros(n, np.int64)
    for i in range(k):
        out = out * 4 + c[i : i + n]
    return out


def emitted(h: np.ndarray, width: int) -> list[tuple[int, int]]:
    """(position, value) of each emission: the right-most least of a window when the last one leaves it, or a strictly lesser that enters."""
    n = len(h)
    width = min(width, n)
    if not n:
        return []
    right = lambda a: a + width - 1 - int(np.argmin(h[a : a + width][::-1]))
    at = right(0)
    out = [(at, int(h[at]))]
    for a in range(1, n - width + 1):
        new = a + width - 1
        if at < a:
            at = right(a)
        elif h[new] < h[at]:
            at = new
        else:
            continue
        out.append((at, int(h[at])))
    return out


def emissions(seqs: DataFrame, k: int, width: int, most: int = EMITTED) -> DataFrame:
    """(seq_id, ord, pos, h) of every emission."""

    def run(found):
        for batch in found:
            for low, high in batches.slices(batch.column(1), most):  # a slice's emissions are held, not a batch's
                own = [emitted(hashes(x or "", k), width) for x in batch.column(1).slice(low, high - low).to_pylist()]
                n = np.array([len(x) for x in own])
                both = np.array([x for rows in own for x in rows], np.int64).reshape(-1, 2)
                ids = batch.column(0).slice(low, high - low).take(pa.array(np.repeat(np.arange(high - low), n)))
                yield pa.record_batch([ids.cast(pa.int64()), pa.array(batches.runs(np.zeros_like(n), n), pa.int32()), pa.array(both[:, 0], pa.int32()), pa.array(both[:, 1])], ["seq_id", "ord", "pos", "h"])

    return seqs.select("seq_id", "seq").mapInArrow(run, "seq_id long, ord int, pos int, h long")
