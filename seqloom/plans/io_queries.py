"""Round trips: the given tables, written in the formats of sequences, signatures and results, and read back by splits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..operators import sketches
from ..sources import scans, sinks, split_sequences, tables
from ..sources.storage import folder
from .base import ALL, CFG, DNA, FLAT, KM, WBITS, WIN, dna, flat, query, table, windowed

#: Small splits, so that also small tables are read in many.
SPLIT = 1 << 18
_FASTA = "SELECT seq_id, length(seq)::BIGINT AS n_bases, md5(seq) AS digest FROM dna"


def _new(spark, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def _fasta(spark, sf_dir: str, width: int = 60) -> str:
    """All documents' bases as FASTA files: id and a '>' in the header, lines of `width` bases."""
    path = _new(spark, "fasta")
    lines = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    rows = dna(spark, sf_dir, "lang").select(F.concat(F.lit(">"), F.col("seq_id").cast("string"), F.lit(" >"), F.coalesce("lang", F.lit("")), F.lit("\n"), lines).alias("value"))
    rows.write.text(path)
    return path


@query(f"WITH {DNA} {_FASTA}")
def scan_fasta_splits(spark, sf_dir: str) -> DataFrame:
    """Sequence files read by byte ranges."""
    rows = split_sequences.records(spark, _fasta(spark, sf_dir), split=SPLIT)
    return rows.select(F.split("id", " ")[0].cast("long").alias("seq_id"), F.length("seq").cast("long").alias("n_bases"), F.md5("seq").alias("digest"))


@query(f"WITH {DNA} SELECT seq_id, min(length(seq))::BIGINT AS n_bases, count(*)::BIGINT AS n_pieces FROM (SELECT seq_id, seq, unnest(range(0, length(seq), 500)) FROM dna) GROUP BY seq_id")
def scan_fasta_pieces(spark, sf_dir: str) -> DataFrame:
    """Long sequences as rows of at most 500 bases; those that a split's border cuts are put together by their places."""
    rows = split_sequences.pieces(spark, _fasta(spark, sf_dir), piece=500, split=SPLIT)
    # a border makes one piece more: places tell how many there are without it
    whole = rows.groupBy("id").agg(F.sum("own").alias("n_bases"))
    return whole.select(F.split("id", " ")[0].cast("long").alias("seq_id"), "n_bases", F.ceil(F.col("n_bases") / 500).cast("long").alias("n_pieces"))


@query(f"WITH {DNA}, {KM}, s AS (SELECT h, count(*) AS n FROM km GROUP BY 1) SELECT n AS kmer_count, count(*)::BIGINT AS freq FROM s GROUP BY 1")
def kmer_spectrum_pieces(spark, sf_dir: str) -> DataFrame:
    """The spectrum of k-mers from sequences that come in overlapping pieces: none is lost or counted twice at their borders."""
    rows = split_sequences.pieces(spark, _fasta(spark, sf_dir), overlap=ALL.k - 1, piece=500, split=SPLIT)
    counts = split_sequences.piece_kmers(rows, ALL.k).groupBy("h").agg(F.count(F.lit(1)).alias("kmer_count"))
    return counts.groupBy("kmer_count").agg(F.count(F.lit(1)).alias("freq"))


@query(f"WITH {DNA} SELECT seq_id, length(seq)::BIGINT AS n_bases, md5(seq) AS digest FROM dna WHERE seq <> ''")
def scan_fastq_splits(spark, sf_dir: str) -> DataFrame:
    """FASTQ files, whose quality lines may look like headers."""
    path = _new(spark, "fastq")
    rows = dna(spark, sf_dir).where("seq <> ''")
    rows.select(F.concat_ws("\n", F.concat(F.lit("@"), "seq_id"), "seq", F.lit("+"), F.translate("seq", "ACGT", "@+>I")).alias("value")).write.text(path)
    found = split_sequences.records(spark, path, split=SPLIT)
    return found.select(F.col("id").cast("long").alias("seq_id"), F.length("seq").cast("long").alias("n_bases"), F.md5("seq").alias("digest"))


def _digests(rows: DataFrame, text) -> DataFrame:
    return rows.groupBy(F.md5(text).alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DNA}, {KM}, {FLAT}, l AS (SELECT seq_id, string_agg(bit::VARCHAR, ',' ORDER BY bit) AS t FROM bits GROUP BY 1) SELECT md5(coalesce(t, '')) AS digest, count(*)::BIGINT AS n FROM dna LEFT JOIN l USING (seq_id) GROUP BY 1")
def roundtrip_flat(spark, sf_dir: str) -> DataFrame:
    """Flat signatures, written as signature files and read by byte ranges; a sequence without k-mers is a record of zeros."""
    path = _new(spark, "flat")
    sinks.signatures(flat(spark, sf_dir), ALL.bits, path)
    return _digests(scans.flat(spark, path, split=SPLIT), sinks.as_list(F.col("bits")))


@query(f"WITH {DNA}, {KM}, {FLAT}, f AS (SELECT source, bit FROM bits JOIN dna USING (seq_id)) SELECT source, count(DISTINCT bit)::BIGINT AS n_bits FROM f GROUP BY 1")
def roundtrip_by_file(spark, sf_dir: str) -> DataFrame:
    """Signatures in a sub-folder a source, read back as one table that knows the folders."""
    path = _new(spark, "by-file")
    sinks.by_file(flat(spark, sf_dir, "source").withColumnRenamed("source", "file"), path)
    rows = spark.read.parquet(path).select(F.col("file").cast("string").alias("source"), F.explode("bits").alias("bit"))
    return rows.groupBy("source").agg(F.count_distinct("bit").alias("n_bits"))


_WLIST = "w AS (SELECT seq_id, window_id, string_agg(bit::VARCHAR, ',' ORDER BY bit) AS t FROM wbits GROUP BY 1, 2), s AS (SELECT seq_id, count(*) AS n_windows, string_agg(t, ';' ORDER BY window_id) AS t FROM w GROUP BY 1)"


@query(f"WITH {DNA}, {KM}, {WIN}, {WBITS}, {_WLIST} SELECT md5(t) AS digest, n_windows::BIGINT AS n_windows, count(*)::BIGINT AS n FROM s GROUP BY 1, 2")
def roundtrip_windowed(spark, sf_dir: str) -> DataFrame:
    """Windowed signatures: a record a window, sequences ended by zeros, put together again from the records' numbers."""
    path = _new(spark, "windowed")
    sinks.windowed_signatures(windowed(spark, sf_dir), CFG.bits, path)
    rows = scans.windowed(spark, path, split=SPLIT)
    text = F.transform(F.array_sort(F.collect_list(F.struct("window_id", sinks.as_list(F.col("bits")).alias("t")))), lambda x: x["t"])
    each = rows.groupBy("path", "seq_id").agg(F.array_join(text, ";").alias("t"), F.count(F.lit(1)).alias("n_windows"))
    return each.groupBy(F.md5("t").alias("digest"), "n_windows").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DNA}, {KM}, {FLAT}, l AS (SELECT seq_id, string_agg(bit::VARCHAR, ',' ORDER BY bit) AS t FROM bits GROUP BY 1) SELECT md5(coalesce(t, '')) AS digest, count(*)::BIGINT AS n FROM dna LEFT JOIN l USING (seq_id) GROUP BY 1")
def roundtrip_list_file(spark, sf_dir: str) -> DataFrame:
    """Signature files of both halves of the table, read by a list file that names them."""
    halves = []
    for rest in (0, 1):
        halves.append(_new(spark, "half"))
        sinks.signatures(flat(spark, sf_dir).where(F.pmod("seq_id", F.lit(2)) == rest), ALL.bits, halves[-1])
    names = _new(spark, "list")
    spark.createDataFrame([(h,) for h in halves], "value string").write.text(names)
    return _digests(scans.flat_list(spark, names), sinks.as_list(F.col("bits")))


@query(f"WITH {DNA}, {KM}, c AS (SELECT seq_id, count(*)::BIGINT AS kmers, count(DISTINCT h)::BIGINT AS distinct_kmers FROM km GROUP BY 1) SELECT seq_id AS i, kmers, distinct_kmers FROM c")
def roundtrip_counts(spark, sf_dir: str) -> DataFrame:
    """Count tables, written as CSV each, read and merged by id."""
    rows = sketches.kmer_rows(dna(spark, sf_dir), ALL).groupBy(F.col("seq_id").alias("i"))
    read = []
    for name, count in (("kmers", F.count("h")), ("distinct_kmers", F.count_distinct("h"))):
        path = _new(spark, name)
        tables.write_counts(rows.agg(count.alias("count")), path)
        read.append(tables.counts(spark, path).withColumnRenamed("count", name))
    return read[0].join(read[1], "i", "full")


@query(f"WITH {DNA}, {KM}, c AS (SELECT seq_id, count(*)::BIGINT AS kmers FROM km GROUP BY 1) SELECT c.seq_id AS i, kmers, n AS lang_length FROM c JOIN (SELECT seq_id, length(seq)::BIGINT AS n FROM dna) USING (seq_id) UNION ALL SELECT seq_id, NULL, length(seq)::BIGINT FROM dna WHERE seq_id NOT IN (SELECT seq_id FROM c)")
def roundtrip_merged(spark, sf_dir: str) -> DataFrame:
    """Count tables that a config file names, merged side by side, written and read again; ids that one lacks stay."""
    kmers = sketches.kmer_rows(dna(spark, sf_dir), ALL).groupBy(F.col("seq_id").alias("i")).agg(F.count("h").alias("count"))
    lengths = dna(spark, sf_dir).select(F.col("seq_id").alias("i"), F.length("seq").cast("long").alias("count"))
    paths = {"kmers": _new(spark, "kmers"), "lang_length": _new(spark, "lengths")}
    for rows, path in zip((kmers, lengths), paths.values(), strict=True):
        tables.write_counts(rows, path)
    config, out = _new(spark, "config"), _new(spark, "merged")
    spark.createDataFrame(list(paths.items()), "name string, path string").write.csv(config)
    sinks.merged(tables.merged(spark, config).select("i", "kmers", "lang_length"), out)
    return spark.read.csv(out, header=True, schema="i long, kmers long, lang_length long")


@query(f"WITH {DNA} SELECT (length(seq) // 100 * 100)::INT AS bin, count(*)::BIGINT AS count FROM dna GROUP BY 1")
def roundtrip_histogram(spark, sf_dir: str) -> DataFrame:
    """A histogram as CSV, in order of bins."""
    path = _new(spark, "histogram")
    bins = (F.floor(F.length("seq") / 100) * 100).cast("int").alias("bin")
    sinks.histogram(dna(spark, sf_dir).groupBy(bins).agg(F.count(F.lit(1)).alias("count")), path)
    return spark.read.csv(path, header=True, schema="bin int, count long")


@query(f"WITH {DNA} SELECT seq_id, dense_rank() OVER (ORDER BY source NULLS FIRST)::BIGINT AS cluster FROM dna")
def roundtrip_clusters(spark, sf_dir: str) -> DataFrame:
    """Cluster assignments as CSV without a header: sequences by their source, sources numbered in order of their names."""
    path = _new(spark, "clusters")
    rows = dna(spark, sf_dir, "source").select("seq_id", "source")
    names = rows.select("source").distinct()  # a row a source
    earlier = names.alias("a").join(names.alias("b"), F.coalesce(F.col("b.source"), F.lit("")) <= F.coalesce(F.col("a.source"), F.lit("")))
    numbers = earlier.groupBy(F.col("a.source").alias("source")).agg(F.count(F.lit(1)).alias("cluster"))
    tables.write_clusters(rows.join(numbers, rows["source"].eqNullSafe(numbers["source"])).select("seq_id", "cluster"), path)
    return tables.clusters(spark, path)


@query("SELECT doc_id AS node, doc_id // 2 AS parent, floor(log2(doc_id))::INT + 1 AS level, doc_id * 2 <= (SELECT max(doc_id) FROM documents) AS is_branch FROM documents WHERE doc_id > 0")
def roundtrip_node_table(spark, sf_dir: str) -> DataFrame:
    """A tree's node table as CSV: a binary tree over all ids, with levels."""
    path = _new(spark, "nodes")
    rows = table(spark, sf_dir, "documents").where("doc_id > 0")
    sinks.node_table(rows.select(F.col("doc_id").alias("node"), F.floor(F.col("doc_id") / 2).cast("long").alias("parent")), path)
    return spark.read.csv(path, header=True, schema="node long, parent long, level int, is_branch boolean")


_DRAWN = "SELECT seq_id FROM nwin WHERE n > 0 ORDER BY md5('7/' || seq_id), seq_id LIMIT 50"


@query(f"WITH {DNA}, {KM}, {WIN}, {WBITS}, pick AS ({_DRAWN}), {_WLIST} SELECT md5(t) AS digest, n_windows::BIGINT AS n_windows, count(*)::BIGINT AS n FROM s JOIN pick USING (seq_id) GROUP BY 1, 2")
def roundtrip_windowed_sample(spark, sf_dir: str) -> DataFrame:
    """All windows of 50 sequences that a hash draws, from files of a sub-folder a sequence."""
    path = _new(spark, "by-sequence")
    rows = windowed(spark, sf_dir)
    ids = rows.select("seq_id").distinct().orderBy(F.md5(F.concat(F.lit("7/"), F.col("seq_id").cast("string"))), "seq_id").limit(50)
    sinks.by_sequence(rows.join(ids, "seq_id").select("seq_id", "window_id", "bits"), path)
    text = F.transform(F.array_sort(F.collect_list(F.struct("window_id", sinks.as_list(F.col("bits")).alias("t")))), lambda x: x["t"])
    each = spark.read.parquet(path).groupBy("seq_id").agg(F.array_join(text, ";").alias("t"), F.count(F.lit(1)).alias("n_windows"))
    return each.groupBy(F.md5("t").alias("digest"), "n_windows").agg(F.count(F.lit(1)).alias("n"))
