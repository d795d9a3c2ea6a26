"""Scans by list file, by sample and by name, and what can be known of a file before it is read."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import split_sequences
from .splits import SignatureSource, files, opened


def paths(spark: SparkSession, list_file: str) -> DataFrame:
    """(path) of a list file, one a line."""
    return spark.read.text(list_file).select(F.trim("value").alias("path")).where("path <> ''")


def list_length(spark: SparkSession, list_file: str) -> int:
    return paths(spark, list_file).count()


def sampled_paths(found: DataFrame, n: int, seed: int) -> DataFrame:
    """n paths by a hash of seed and path: the same for the same seed."""
    return found.orderBy(F.md5(F.concat_ws("/", F.lit(seed), "path")), "path").limit(n)


def _named(found: DataFrame) -> list[str]:
    """A path table's rows: names of files, which Spark's readers take from the driver anyway."""
    return sorted(r["path"] for r in found.collect())


def records(spark: SparkSession, *where: str, split: int | None = None) -> DataFrame:
    """(path, record, bits) of signature files and folders, split by byte ranges; records of zeros too."""
    spark.dataSource.register(SignatureSource)
    reader = spark.read.format("signatures").option("paths", ",".join(where))
    return (reader.option("split", split) if split else reader).load()


def flat(spark: SparkSession, *where: str, split: int | None = None) -> DataFrame:
    """(path, seq_id, bits): a record a sequence."""
    return records(spark, *where, split=split).withColumnRenamed("record", "seq_id")


def windowed(spark: SparkSession, *where: str, split: int | None = None) -> DataFrame:
    """(path, seq_id, window_id, bits): a record of zeros ends a sequence.

    Sequences are numbered by the zero records before them. A file's runs of records are numbered first and their zeros
    summed up, so no task sees a whole file.
    """
    rows = records(spark, *where, split=split).withColumn("run", F.floor(F.col("record") / RUN)).withColumn("ends", (F.size("bits") == 0).cast("int"))
    runs = rows.groupBy("path", "run").agg(F.sum("ends").alias("n"), F.max(F.when(F.col("ends") == 1, F.col("record"))).alias("last_end"))
    before = Window.partitionBy("path").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("path", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("seqs"), F.coalesce(F.max("last_end").over(before), F.lit(-1)).alias("started"))
    within = Window.partitionBy("path", "run").orderBy("record").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("own", F.coalesce(F.sum("ends").over(within), F.lit(0))).withColumn("mine", F.max(F.when(F.col("ends") == 1, F.col("record"))).over(within)).join(runs, ["path", "run"])
    start = F.greatest(F.coalesce("mine", F.lit(-1)), "started")
    return placed.where("ends = 0").select("path", (F.col("seqs") + F.col("own")).cast("long").alias("seq_id"), (F.col("record") - start - 1).cast("int").alias("window_id"), "bits")


#: Records of a run that are numbered together.
RUN = 100_000


def flat_list(spark: SparkSession, list_file: str) -> DataFrame:
    """Signatures of all files that a list file names."""
    return flat(spark, *_named(paths(spark, list_file)))


def windowed_list(spark: SparkSession, list_file: str) -> DataFrame:
    return windowed(spark, *_named(paths(spark, list_file)))


def flat_list_sample(spark: SparkSession, list_file: str, n: int, seed: int) -> DataFrame:
    """Signatures of n of the files that a list file names, drawn by hash."""
    return flat(spark, *_named(sampled_paths(paths(spark, list_file), n, seed)))


def windowed_list_sample(spark: SparkSession, list_file: str, n: int, seed: int) -> DataFrame:
    return windowed(spark, *_named(sampled_paths(paths(spark, list_file), n, seed)))


def sampled_sequences(windows: DataFrame, n: int, seed: int) -> DataFrame:
    """All windows of n sequences, drawn by a hash of seed, path and id."""
    ids = windows.select("path", "seq_id").distinct()
    return windows.join(ids.orderBy(F.md5(F.concat_ws("/", F.lit(seed), "path", "seq_id")), "path", "seq_id").limit(n), ["path", "seq_id"])


def first_sequences(windows: DataFrame, most: int) -> DataFrame:
    """All windows of the first `most` sequences of each file."""
    return windows.where(F.col("seq_id") < most)


def estimated_sequences(path: str) -> int:
    """How many sequences a windowed file (or a folder's files together) would hold if all had as many windows as its first; 0 if that has no end."""
    total = 0
    for name, size in files([path]):
        store, own = opened(name)
        with store.open_input_file(own) as f:
            head = f.read(8)
            width = struct.unpack("<Q", head)[0] if len(head) == 8 else 0
            windows = 0
            while width and len(record := f.read(width)) == width:
                if not any(record):
                    total += int((size - 8) / width / windows) if windows else 0
                    break
                windows += 1
    return total


def node_signatures(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(parent, node, bits): a tree's edges (parent, child) with the signatures (node, bits) of their children."""
    return edges.select("parent", F.col("child").alias("node")).join(nodes.select("node", "bits"), "node").select("parent", "node", "bits")


def by_name(spark: SparkSession, folder: str, pattern: str, schema: str, parameter: str = "k([0-9]+)", header: bool = True) -> DataFrame:
    """The CSV files of a folder whose names match a glob pattern, as one table with (file, parameter): the number that a regular expression finds in the name."""
    rows = spark.read.csv(folder, schema=schema, header=header, pathGlobFilter=pattern)
    file = F.col("_metadata.file_name")
    return rows.select("*", file.alias("file"), F.expr(f"try_cast(regexp_extract(_metadata.file_name, '{parameter}', 1) AS int)").alias("parameter"))


def hash_lists(spark: SparkSession, *where: str) -> DataFrame:
    """(path, seq_id, hashes) of lists that the greatest 64-bit number ends, by byte ranges."""
    return split_sequences.hash_lists(spark, *where).withColumnRenamed("file", "path")


def sample(signatures: DataFrame, n: int, seed: int) -> DataFrame:
    """n signatures by a hash of seed and id: the same for the same seed."""
    return signatures.orderBy(F.xxhash64("seq_id", F.lit(seed)), "seq_id").limit(n)
