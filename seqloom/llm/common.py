"""What the operators share: shared storage, written tables, word splitting and hashing."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

#: The six ASCII characters that end a word: \x20 and \x09-\x0D. bytes.split() and Arrow's split exactly at these.
SPACE = "\\x20\\x09-\\x0D"

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local session gets a temporary folder of its own; on a cluster the warehouse
    (which is shared) serves.
    """
    global _local_dir
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        if _local_dir is None or not os.path.isdir(_local_dir):
            _local_dir = tempfile.mkdtemp(prefix="seqloom-")
        return f"file://{_local_dir}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: written to the shared folder as Parquet and read again (cuts lineage, survives lost executors)."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes tables that written() made and that nothing reads any more."""
    for df in frames:
        remove(df.sparkSession, df.written_at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder, whatever file system it is on."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(df: DataFrame, column: str = "text"):
    """The text as a string column, null as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def split_words(texts: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the words of all texts one after the other as places among them, bounds of each text's), split by Arrow."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    at, bounds, words = coded.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64), coded.dictionary
    empty = pc.index(words, pa.scalar("", words.type)).as_py() if len(words) else -1
    if empty >= 0:  # white space at an end of a text
        real = at != empty
        return words, at[real], np.concatenate(([0], np.cumsum(real)))[bounds]
    return words, at, bounds


def listed(words: pa.Array) -> list:
    """Words without ASCII white space as Python values (str or bytes)."""
    mark = "\n" if pa.types.is_string(words.type) else b"\n"
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), mark)[0].as_py().split(mark) if len(words) else []


def coded_words(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hashes of distinct words, the words of all texts as places among them, bounds of each text's); A-Z in lower case, if
    so asked. Only distinct words are hashed."""
    words, at, bounds = split_words(pc.ascii_lower(texts) if lower else texts)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, listed(words.cast(pa.binary()))), np.uint64, len(words)), at, bounds


def hashed_words(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words one after the other, and the bounds of each text's."""
    hashes, at, bounds = coded_words(texts, lower)
    return hashes[at], bounds


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), so that sums of hashes become hashes again."""
    with np.errstate(over="ignore"):
        x = np.bitwise_xor(x, np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1), dtype=np.uint64)
        for _ in range(2):
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        return x


def grams(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of n consecutive words, from the words' hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = mix(h[:m], salt + 1)
        for k in range(1, n):
            out *= np.uint64(0x9FB21C651E98DF25)
            out += h[k : k + m]
        return mix(out, salt)
