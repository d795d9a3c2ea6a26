"""Documents in blocks that name each distinct key once, and the values of keys brought back to them.

A block is some megabytes of documents. Its row holds the block's distinct keys with their totals, and for each document which
keys it has and how often (as positions among them). Counting keys over the table, and joining values back, then moves one
row a block and distinct key, however often documents repeat it: a key that a third of all rows share costs one row a
block. The blocks are written once, bucketed, so that values meet them without moving them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DataType, LongType, StructField, StructType

from .blocks import tidied
from .common import new_path, remove, text_of

#: UTF-8 bytes of one block (one document at least).
BLOCK_BYTES = 8_000_000


@dataclass
class Keyed:
    """What the documents of a block have: the block's distinct keys, for each document (bounds) which of them (at) how often
    (times), and arrays of figures, one a document."""

    keys: pa.Array
    bounds: np.ndarray
    at: np.ndarray
    times: np.ndarray
    figures: list[pa.Array]

    def totals(self) -> np.ndarray:
        return np.bincount(self.at, self.times, len(self.keys)).astype(np.int64)


def per_document(which: np.ndarray, bounds: np.ndarray, keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, keys, times) of each document's distinct keys, from all of its keys one after the other."""
    owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.int64), np.diff(bounds))
    pairs, times = np.unique(owner * max(keys, 1) + which, return_counts=True)
    return np.searchsorted(pairs, np.arange(len(bounds), dtype=np.int64) * max(keys, 1)), (pairs % max(keys, 1)).astype(np.int32), times.astype(np.int32)


def summed(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of each document's stretch of values."""
    upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)))
    return upto[bounds[1:]] - upto[bounds[:-1]]


def slices(batches, column: int, size: int):
    """The batches in slices of at most `size` bytes of a text column, one row at least."""
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(batch):
            before = upto[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(upto, before + size, "right")))
            yield batch.slice(start, end - start)
            start = end


class KeyedBlocks:
    """The documents of df, by `keyed(texts)`, with the columns `keep` of df and figures of the given types."""

    def __init__(self, df: DataFrame, text: str, keyed: Callable[[pa.Array], Keyed], key: DataType, keep: list[str], figures: list[tuple[str, DataType]], size: int | None = None):
        spark = df.sparkSession
        size = size or BLOCK_BYTES
        self.keep, self.figures = keep, figures
        rows = df.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(keep)], text_of(df, text).alias("t"))
        kept = rows.schema.fields[:-1]
        self.schema = StructType([*kept, *[StructField(f"f{i}", t) for i, (_, t) in enumerate(figures)]])
        out = StructType([StructField("block", LongType()), StructField("docs", ArrayType(self.schema)), StructField("keys", ArrayType(key)), StructField("totals", ArrayType(LongType())), *[StructField(n, BinaryType()) for n in ("bounds", "at", "times")]])

        def blocked(batches):
            base = TaskContext.get().partitionId() << 32
            for i, part in enumerate(slices(batches, len(kept), size)):
                k = keyed(part.column(len(kept)))
                names = self.schema.names
                docs = pa.StructArray.from_arrays([*part.columns[:-1], *k.figures], names=names)
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                packed = [pa.array([x.tobytes()], pa.binary()) for x in (k.bounds.astype(np.int64), k.at.astype(np.int32), k.times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array([base + i], pa.int64()), one(docs), one(k.keys), one(pa.array(k.totals())), *packed], out.names)

        name = self.name = f"keyed_{uuid.uuid4().hex}"
        self.path = new_path(spark, name)
        buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows.mapInArrow(blocked, out).write.bucketBy(buckets, "block").option("path", self.path).option("compression", "zstd").saveAsTable(name)
        self.table = spark.table(name)

    def entries(self) -> DataFrame:
        """(block, at, key, n): each block's distinct keys, where they stand in it and how often they occur."""
        zipped = self.table.select("block", F.posexplode(F.arrays_zip("keys", "totals")).alias("at", "e"))
        return zipped.select("block", "at", F.col("e.keys").alias("key"), F.col("e.totals").alias("n"))

    def with_values(self, values: DataFrame, names: list[str], weigh: Callable[[Keyed, list[np.ndarray]], list[pa.Array]], added: list[tuple[str, DataType]]) -> DataFrame:
        """All documents, with the columns kept, the figures, and `added` columns by weigh(block, values of its keys in order).

        `values` has (block, at, *names) for each entry.
        """
        schema = StructType([*self.schema.fields, *[StructField(f"a{i}", t) for i, (_, t) in enumerate(added)]])

        def back(blocks: pa.Table, found: pa.Table) -> pa.Table:
            if not len(blocks):
                return nothing
            docs = blocks.column("docs").combine_chunks().flatten()
            bounds, at, times = (np.frombuffer(blocks.column(n)[0].as_buffer(), t) for n, t in (("bounds", np.int64), ("at", np.int32), ("times", np.int32)))
            by = np.argsort(found.column("at").to_numpy(), kind="stable")
            got = [found.column(n).to_numpy()[by] for n in names]
            new = weigh(Keyed(None, bounds, at, times, []), got)
            return pa.table([*docs.flatten(), *new], names=schema.names)

        nothing = to_arrow_schema(schema).empty_table()
        columns = self.table.select("block", "docs", "bounds", "at", "times")
        rows = columns.groupBy("block").cogroup(values.select(F.col("block").alias("of"), "at", *names).groupBy("of")).applyInArrow(lambda b, v: tidied(back, b, v), schema)
        renamed = [*self.keep, *[n for n, _ in self.figures], *[n for n, _ in added]]
        last = {n: i for i, n in enumerate(renamed)}
        return rows.select(*[F.col(schema.names[i]).alias(n) for n, i in last.items()])

    def drop(self) -> None:
        """Deletes the blocks; nothing may read them any more."""
        spark = self.table.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(spark, self.path)
