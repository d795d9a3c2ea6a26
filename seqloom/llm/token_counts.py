"""Token counts with a digest cache.

The cache is a Parquet folder with a row for each (content digest, tokenizer digest). Texts are normalised (null becomes
empty; byte-level tokens allow no more), digested, and joined to it; only distinct missing contents are encoded, and their
counts are appended. Digests are 128-bit MD5 of the UTF-8 bytes, the tokenizer's is SHA-256 of its file and library version,
so another tokenizer never meets old counts. An append is one Parquet write: it is committed whole or not at all, and a row
appended twice by two jobs counts once, since readers take one count a key.

The folder is the session's spark.seqloom.tokenCache; where that is unset, a folder of the shared one for each source. Texts move
once, those that are missing: equal ones meet before the shuffle. Counts come back to rows by digest, without the text unless it
is among the columns kept; a digest that a third of all rows share is split, since neither side of that join is aggregated.

Null and empty texts count 0; repeated rows count alike; an empty table gives an empty one and appends nothing.
"""

from __future__ import annotations

import hashlib
import os
from importlib.metadata import version

import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import documents, dropped, fresh, shared_dir, text_of, written

SCHEMA = "content string, tokenizer string, n_tokens long"
#: Digests that are sent to all tasks at most (32 characters each), to pick the texts that are missing where they lie.
FEW_MISSING = 200_000
#: Texts are encoded in batches of at most so many characters (one text at least).
BATCH_CHARS = 1_000_000
_loaded: dict[str, object] = {}


def load(path: str):
    """Encoder of a tokenizer file: list of texts -> list of token counts, by the file's own library."""
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            _loaded[path] = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    return _loaded[path]


def tokenizer_digest(path: str) -> str:
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{library} {version(library)}".encode()).hexdigest()


def _batches(texts: list[str]):
    part, chars = [], 0
    for x in texts:
        if part and chars + len(x) > BATCH_CHARS:
            yield part
            part, chars = [], 0
        part.append(x)
        chars += len(x)
    if part:
        yield part


def cache_path(spark: SparkSession, source: str) -> str:
    """The session's cache, or else one that belongs to where the texts are read from: runs over the same place share it."""
    return spark.conf.get("spark.seqloom.tokenCache", None) or f"{shared_dir(spark)}/token-counts-{hashlib.md5(source.encode()).hexdigest()}"


def count_tokens(df: DataFrame, cache: str, tokenizer: str, text: str = "text", n_tokens: str = "n_tokens", keep: list[Column] | None = None) -> DataFrame:
    """df, or its columns `keep`, with the token count of its text in column `n_tokens`; missing counts are appended to `cache`.

    `tokenizer` is a file that every executor has.
    """
    spark = df.sparkSession
    version_digest = tokenizer_digest(tokenizer)
    body = text_of(df, text)
    digest = F.md5(body.cast("binary"))

    def cached() -> DataFrame:
        try:
            found = spark.read.schema(SCHEMA).parquet(cache)
        except Exception as e:  # only: no such folder yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            found = spark.createDataFrame([], SCHEMA)
        own = found.where(F.col("tokenizer") == version_digest)
        return own.groupBy("content").agg(F.max("n_tokens").alias("n"))

    def encode(batches):
        counts = load(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [c for part in _batches(texts) for c in counts(part)]
            yield pa.record_batch([batch.column(0), pa.array([version_digest] * len(n), pa.string()), pa.array(n, pa.int64())], ["content", "tokenizer", "n_tokens"])

    def texts(rows: DataFrame) -> DataFrame:
        """(content, body) of distinct contents; equal ones meet before they move."""
        return rows.select(digest.alias("content"), body.alias("body")).groupBy("content").agg(F.first("body").alias("body"))

    known = cached()
    if known.isEmpty():
        todo = texts(df)
    else:
        missing = written(df.select(digest.alias("content")).distinct().join(known, "content", "left_anti"), "missing")
        if missing.count() <= FEW_MISSING:  # then no other text moves
            todo = texts(df.join(F.broadcast(missing), digest == missing["content"], "left_semi"))
        else:
            todo = texts(df).join(missing, "content", "left_semi")
    todo.mapInArrow(encode, SCHEMA).write.mode("append").parquet(cache)
    counts = written(cached(), "counts")
    own, content, n = fresh(df, "digest", "content", "n")
    rows = df.withColumn(own, digest) if keep is None else df.select(*keep, digest.alias(own))
    out = rows.join(counts.select(F.col("content").alias(content), F.col("n").alias(n)), F.col(own) == F.col(content), "left")
    return out.select(*[out[c] for c in rows.columns if c not in (own, n_tokens)], F.col(n).alias(n_tokens))


def op10_digest_cache(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    keep = [docs["doc_id"], F.octet_length(text_of(docs)).cast("long").alias("n_bytes")]
    counted = count_tokens(docs, cache_path(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), keep=keep)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
