"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At every level each child of the node reached draws -ln(u) / weight, u being a uniform hash of the row's key and the child;
the least draw wins. A child's draw depends on its own weight only, so a weight that changes moves rows only into or out of
the subtrees whose weights change. `grow` gives a new shard a region of its own: no older weight changes, so one more shard
takes rows only into itself.

Only DataFrame functions are used. Rows with a null key all draw alike and share a shard; repeated keys too. Slots number a
shard's rows from 0 without gaps: rows are counted by (shard, bucket), the counts are summed up, and rows are numbered
within a bucket, so no task has to hold a whole shard.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import documents, fresh

#: Rows that a bucket of the slot numbering has on average.
BUCKET_ROWS = 20_000


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int, per_rack: int = 4, racks: int = 2) -> list[Leaf]:
    """Equal shards, filled rack by rack and region by region."""
    return [Leaf(i // (per_rack * racks), i // per_rack % racks, i) for i in range(shards)]


def grow(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a new region."""
    return [*leaves, Leaf(max((x.region for x in leaves), default=-1) + 1, 0, max((x.shard for x in leaves), default=-1) + 1, weight)]


def _uniform(key: Column, node: Column) -> Column:
    """52 bits of an MD5, as a number in (0, 1)."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("/", key, node)), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))


def _draw(key: Column, node: Column, children: dict[str, list[tuple[str, float]]]) -> Column:
    """Name of the child that wins below `node`; the node's children are looked up in a folded map."""
    table = F.create_map(*[x for name, below in children.items() for x in (F.lit(name), F.array(*[F.struct(F.lit(c).alias("name"), F.lit(float(w)).alias("weight")) for c, w in below]))])
    draws = F.transform(F.element_at(table, node), lambda c: F.struct((-F.ln(_uniform(key, c["name"])) / c["weight"]).alias("draw"), c["name"].alias("name")))
    return F.array_min(draws)["name"]


def levels(leaves: list[Leaf]) -> list[dict[str, list[tuple[str, float]]]]:
    """For each level, the children (name, weight) of each node; a node's weight is its leaves' sum."""
    out: list = [defaultdict(lambda: defaultdict(float)) for _ in range(3)]
    for x in leaves:
        if x.weight > 0:
            path = ["", f"{x.region}", f"{x.region}.{x.rack}", f"{x.region}.{x.rack}.{x.shard}"]
            for level in range(3):
                out[level][path[level]][path[level + 1]] += x.weight
    if not out[0]:
        raise ValueError("no shard has a positive weight")
    return [{node: sorted(below.items()) for node, below in sorted(level.items())} for level in out]


def place(df: DataFrame, leaves: list[Leaf], key: str = "doc_id", shard: str = "shard", path: str | None = None) -> DataFrame:
    """df with the shard of each row, by three weighted draws; `path` names a column for region.rack.shard.

    Leaves of no positive weight get no rows.
    """
    k = F.coalesce(df[key].cast("string"), F.lit("null"))
    node = F.lit("")
    for level in levels(leaves):
        node = _draw(k, node, level)
    name = path or fresh(df, "path")[0]
    out = df.withColumn(name, node).withColumn(shard, F.substring_index(F.col(name), ".", -1).cast("int"))
    return out if path else out.drop(name)


def slots(df: DataFrame, shard: str, by: list[str], slot: str = "slot") -> DataFrame:
    """df with each row's number in its shard, in order of a hash bucket and then `by`."""
    n = df.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    bucket, at, of, in_bucket, start, rows = fresh(df, "bucket", "at", "of", "in_bucket", "start", "rows")
    hashed = F.conv(F.substring(F.md5(F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in by])), 1, 13), 16, 10).cast("long")
    df = df.withColumn(bucket, F.pmod(hashed, F.lit(buckets)).cast("long"))
    counts = df.groupBy(F.col(shard).alias(of), F.col(bucket).alias(in_bucket)).agg(F.count(F.lit(1)).alias(rows))
    before = Window.partitionBy(of).orderBy(in_bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(of, in_bucket, F.coalesce(F.sum(rows).over(before), F.lit(0)).cast("long").alias(start))
    # the counts have a row for 20,000 of the input and shard: they are joined, never assumed small
    within = F.row_number().over(Window.partitionBy(shard, bucket).orderBy(*by))
    numbered = df.withColumn(at, within.cast("long") - 1)
    out = numbered.join(starts, (F.col(shard) == F.col(of)) & (F.col(bucket) == F.col(in_bucket)))
    return out.withColumn(slot, F.col(start) + F.col(at)).drop(bucket, at, of, in_bucket, start)


def op5_hash_tree(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    leaves = topology(24)
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = place(place(rows, leaves), grow(leaves), shard="grown_shard")
    numbered = slots(placed, "shard", ["doc_id", "text_crc32", "size"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), "slot", F.col("grown_shard").cast("int"))


def _sql_draws(name: str, leaves: list[Leaf]) -> str:
    """Common table expressions that place t's rows in `name`(doc_id, shard)."""
    u = lambda child: f"((('0x' || substr(md5(k || '/' || {child}), 1, 13))::BIGINT + 0.5) / {1 << 52}.0)"
    out, last = [], f"{name}0"
    out.append(f"{name}0 AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, '' AS node FROM documents)")
    for i, level in enumerate(levels(leaves), 1):
        rows = ", ".join(f"('{node}', '{child}', {w!r})" for node, below in level.items() for child, w in below)
        out.append(f"{name}{i} AS (SELECT doc_id, k, arg_min(c.child, -ln({u('c.child')}) / c.w) AS node FROM {last} JOIN (VALUES {rows}) c(parent, child, w) ON c.parent = {last}.node GROUP BY doc_id, k)")
        last = f"{name}{i}"
    return ", ".join(out)




def crc_step(byte: int) -> int:
    """Entry of the CRC-32 table for a byte."""
    for _ in range(8):
        byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
    return byte


def oracle(shards: int = 24) -> str:
    """DuckDB twin of op5_hash_tree. CRC-32 is folded over the bytes, as that engine has no such function."""
    table = ", ".join(str(crc_step(b)) for b in range(256))
    leaves = topology(shards)
    last = len(levels(leaves))
    hashed = "('0x' || substr(md5(doc_id::VARCHAR || '/' || text_crc32::VARCHAR || '/' || size::VARCHAR), 1, 13))::BIGINT"
    return f"""
WITH {_sql_draws("a", leaves)}, {_sql_draws("b", grow(leaves))},
bytes AS (SELECT doc_id, coalesce(strlen(text), 0) + 8 AS size, list_prepend(4294967295::BIGINT,
            list_transform(range(0, strlen(coalesce(text, ''))), lambda i: ('0x' || substr(hex(encode(coalesce(text, ''))), 2 * i + 1, 2))::BIGINT)) AS bs FROM documents),
d AS (SELECT doc_id, size::BIGINT AS size, xor(4294967295::BIGINT, list_reduce(bs, lambda c, x: xor(c // 256, [{table}][xor(c % 256, x) + 1]::BIGINT)))::BIGINT AS text_crc32 FROM bytes),
p AS (SELECT d.*, string_split(a{last}.node, '.')[3]::INT AS shard, string_split(b{last}.node, '.')[3]::INT AS grown_shard,
             {hashed} % greatest(1, (SELECT ceil(count(*) / {BUCKET_ROWS}.0)::BIGINT FROM documents)) AS bucket
      FROM d JOIN a{last} USING (doc_id) JOIN b{last} USING (doc_id))
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM p"""


SQL = {"op5_hash_tree": oracle()}
