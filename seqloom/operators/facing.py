"""A table against each row of a smaller one, in blocks: for results that need every pair of a row and a centre or name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.storage import written

#: Rows of the smaller table in a block, about; tasks that share a block's rows where the join shuffles.
BLOCK, SALTS = 256, 64


def facing(rows: DataFrame, key: Column, few: DataFrame, *by: str) -> DataFrame:
    """rows, once with each block of `few`: a column `block`, an array of about BLOCK structs of its columns, `by` first and in their order.

    `by` tells the rows of `few` apart; a hash of it gives the block. The join is by block and a salt from the row's `key`, so a few blocks
    don't gather all rows in a few tasks, and Spark may broadcast the blocks or not. No rows come back where `few` is empty.
    """
    few = written(few, "few")
    n = -(-few.count() // BLOCK)
    if n == 0:
        return rows.withColumn("block", F.array(F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in few.schema]))).limit(0)
    no = F.pmod(F.xxhash64(*by), F.lit(n)).cast("int").alias("block_no")
    packed = few.groupBy(no).agg(F.array_sort(F.collect_list(F.struct(*by, *[c for c in few.columns if c not in by]))).alias("block"))
    left = rows.withColumns({"block_no": F.explode(F.sequence(F.lit(0), F.lit(n - 1))), "salt": F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")})
    right = packed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, ["block_no", "salt"]).drop("block_no", "salt")
