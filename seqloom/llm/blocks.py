"""Documents in blocks, and the exchange of sorted keys between blocks and buckets.

A block is some megabytes of consecutive documents. The blocks are written once to the shared folder, bucketed by block, so
each later pass over them reads a whole block in one group without moving the text. A pass sends the block's distinct keys, packed
as numpy arrays, to the buckets they hash to; a bucket merges the keys of all blocks and answers each block with values in the
order asked. So a key that a third of all rows share costs one entry a block, and no task holds more than a bucket or a block.
"""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .common import new_path, remove, text_of

#: UTF-8 bytes of one block (one document at least), and keys of one bucket on average.
BLOCK_BYTES, BUCKET_KEYS = 8_000_000, 1_500_000
ASKED = StructType([StructField("bucket", IntegerType()), StructField("block", LongType()), StructField("n", LongType()), StructField("data", BinaryType())])


class Blocks:
    """df's rows as a table (block, place, its columns as c0, c1, ...; the text coalesced as t)."""

    def __init__(self, df: DataFrame, text: str = "text", size: int = BLOCK_BYTES):
        spark = df.sparkSession
        self.names, self.schema = df.columns, df.schema
        renamed = df.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(df.columns)]) if df.columns else df
        renamed = renamed.withColumn("t", text_of(renamed, f"c{df.columns.index(text)}")).drop(f"c{df.columns.index(text)}")
        self.text_at = df.columns.index(text)
        total = renamed.agg(F.sum(F.octet_length("t")).alias("n"), F.count(F.lit(1)).alias("rows")).first()
        self.bytes, self.rows = total["n"] or 0, total["rows"]
        out = StructType([StructField("block", LongType()), StructField("place", LongType()), *renamed.schema.fields])
        at = renamed.columns.index("t")

        def cut(batches):
            base = TaskContext.get().partitionId() << 32
            block, filled, place = base, 0, 0
            for batch in batches:
                sizes = np.diff(np.frombuffer(batch.column(at).buffers()[1], np.int32 if pa.types.is_string(batch.column(at).type) else np.int64)[batch.column(at).offset :][: len(batch) + 1].astype(np.int64)) if len(batch) else np.zeros(0, np.int64)
                blocks = np.empty(len(batch), np.int64)
                for i, x in enumerate(sizes.tolist()):
                    if filled and filled + x > size:
                        block, filled = block + 1, 0
                    blocks[i] = block
                    filled += x
                places = np.arange(place, place + len(batch), dtype=np.int64)
                place += len(batch)
                yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(places), *batch.columns], out.names)

        name = self.name = f"blocks_{uuid.uuid4().hex}"
        self.buckets = int(max(1, min(100_000, self.bytes // size + 1)))
        self.path = new_path(spark, name)
        renamed.mapInArrow(cut, out).write.bucketBy(self.buckets, "block").option("path", self.path).option("compression", "zstd").saveAsTable(name)
        self.table = spark.table(name)

    def drop(self) -> None:
        """Deletes the blocks; nothing may read them any more."""
        spark = self.table.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(spark, self.path)

    def ask(self, function, schema=ASKED) -> DataFrame:
        """function(table of a block), for every block."""
        return self.table.groupBy("block").applyInArrow(lambda t: tidied(function, t), schema)

    def ask_with(self, answers: DataFrame, function, schema) -> DataFrame:
        """function(table of a block, table of its answers), for every block."""
        return self.table.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda t, a: tidied(function, t, a), schema)


def tidied(function, *tables: pa.Table) -> pa.Table:
    """function(tables), after which the worker gives free memory back: it waits for other tasks with what it holds."""
    out = function(*tables)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
    return out


def in_buckets(asked_: DataFrame, function, schema, *by: str) -> DataFrame:
    """function(rows of a bucket), for every bucket."""
    return asked_.groupBy(*(by or ("bucket",))).applyInArrow(lambda t: tidied(function, t), schema)


def buckets_for(keys: int) -> int:
    return max(1, -(-keys // BUCKET_KEYS))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each 64-bit key, by its upper bits: sorted keys lie in bucket order."""
    return ((keys >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def asked(block: int, bucket: np.ndarray, buckets: int, *arrays: np.ndarray) -> pa.Table:
    """The rows that a block sends: arrays are aligned and sorted by bucket; each row packs its slices one after the other."""
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    rows = [(b, block, int(cuts[b + 1] - cuts[b]), b"".join(a[cuts[b] : cuts[b + 1]].tobytes() for a in arrays)) for b in range(buckets) if cuts[b + 1] > cuts[b]]
    return packed(rows)


def packed(rows: list[tuple]) -> pa.Table:
    b, k, n, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"bucket": pa.array(b, pa.int32()), "block": pa.array(k, pa.int64()), "n": pa.array(n, pa.int64()), "data": pa.array(data, pa.binary())})


def unpacked(data: bytes, n: int, *types) -> list[np.ndarray]:
    out, at = [], 0
    for t in types:
        out.append(np.frombuffer(data, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def release(spark) -> None:
    """Lets Spark delete the shuffle files of what Python no longer holds; it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
