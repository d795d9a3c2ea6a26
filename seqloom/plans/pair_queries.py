"""Similarity of pairs, and statistics over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import metrics
from ..operators import aggregates, block_pairs, pairs, sketches
from ..sources.storage import written
from .base import ALL, DNA, FLAT, FLAT_ALL, KM, WIN_ALL, bit_sql, dna, flat, kmer_sql, query, table, windowed

#: Common bits at which two windows match.
MATCH = 2
_SIX = lambda c: F.round(c, 6)


def _bits(spark, sf_dir: str) -> DataFrame:
    return sketches.bit_rows(flat(spark, sf_dir))


def _measured(signatures: DataFrame, *columns) -> DataFrame:
    """(i, j, columns) of all pairs with a common bit, by blocks of signatures."""
    return block_pairs.counted(signatures).select("i", "j", *columns)


def _window_bits(spark, sf_dir: str) -> DataFrame:
    """(seq_id, window_id, bit), of signatures that are computed once."""
    return sketches.bit_rows(written(windowed(spark, sf_dir), "signatures"))


def unions(spark, sf_dir: str) -> DataFrame:
    """(seq_id, bits): all windows' bits together."""
    return windowed(spark, sf_dir).groupBy("seq_id").agg(F.array_distinct(F.flatten(F.collect_list("bits"))).alias("bits"))


def _windows(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """((seq_id, window_id, bit), (seq_id, n windows)), of signatures that are computed once."""
    rows = written(windowed(spark, sf_dir), "signatures")
    return sketches.bit_rows(rows), rows.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"{FLAT_ALL}, s AS (SELECT i, j, c / (na + nb - c)::DOUBLE AS s FROM px) SELECT i, j, s AS similarity FROM s UNION ALL SELECT j, i, s FROM s UNION ALL SELECT seq_id, seq_id, 1.0 FROM cnt")
def sim_jaccard_all(spark, sf_dir: str) -> DataFrame:
    """Full matrix of flat Jaccard, without its zeros."""
    signatures = flat(spark, sf_dir)
    upper = _measured(signatures, metrics.jaccard(F.col("na"), F.col("nb"), F.col("inter")).alias("similarity"))
    return pairs.both_ways(upper, signatures.where(F.size("bits") > 0))


@query(f"{WIN_ALL}, bits AS (SELECT DISTINCT seq_id, bit FROM wbits), cnt AS (SELECT seq_id, count(*) AS n FROM bits GROUP BY 1), pr AS (SELECT a.seq_id AS i, b.seq_id AS j, count(*) AS c FROM bits a JOIN bits b ON a.bit = b.bit AND a.seq_id < b.seq_id GROUP BY 1, 2) SELECT i, j, c / (x.n + y.n - c)::DOUBLE AS similarity FROM pr JOIN cnt x ON x.seq_id = i JOIN cnt y ON y.seq_id = j")
def sim_global(spark, sf_dir: str) -> DataFrame:
    """Jaccard of all windows' bits together."""
    return _measured(unions(spark, sf_dir), metrics.jaccard(F.col("na"), F.col("nb"), F.col("inter")).alias("similarity"))


@query(f"{WIN_ALL} SELECT i, j, round(sum(c / (na + nb - c)::DOUBLE) / least(any_value(x.n), any_value(y.n)), 6) AS similarity FROM wpx JOIN nw x ON x.seq_id = i JOIN nw y ON y.seq_id = j GROUP BY i, j")
def sim_local(spark, sf_dir: str) -> DataFrame:
    """Mean Jaccard of the windows, over the shorter's."""
    return pairs.local_jaccard(*_windows(spark, sf_dir)).withColumn("similarity", _SIX(F.col("similarity")))


@query(f"{WIN_ALL}, f AS (SELECT i, j, min(window_id) AS first FROM wpx WHERE c >= 2 GROUP BY 1, 2) SELECT i, j, round(sum(c / (na + nb - c)::DOUBLE) / (least(any_value(x.n), any_value(y.n)) - any_value(first)), 6) AS similarity FROM wpx JOIN f USING (i, j) JOIN nw x ON x.seq_id = i JOIN nw y ON y.seq_id = j WHERE window_id >= first GROUP BY i, j")
def sim_local_anchored(spark, sf_dir: str) -> DataFrame:
    """The same from the first window with two common bits on."""
    return pairs.local_jaccard(*_windows(spark, sf_dir), 2).withColumn("similarity", _SIX(F.col("similarity")))


@query(f"{WIN_ALL} SELECT i, j, round(count(*) FILTER (WHERE c >= {MATCH} OR (c > 0 AND c = na + nb - c)) / greatest(any_value(x.n), any_value(y.n))::DOUBLE, 6) AS similarity FROM wpx JOIN nw x ON x.seq_id = i JOIN nw y ON y.seq_id = j GROUP BY i, j")
def sim_matching(spark, sf_dir: str) -> DataFrame:
    """Share of matching windows."""
    return pairs.matching_windows(*_windows(spark, sf_dir), MATCH).withColumn("similarity", _SIX(F.col("similarity")))


@query(f"{WIN_ALL} SELECT i, j, round(sum(c / (na + nb - c)::DOUBLE) / greatest(any_value(x.n), any_value(y.n)), 6) AS similarity FROM wpx JOIN nw x ON x.seq_id = i JOIN nw y ON y.seq_id = j GROUP BY i, j")
def sim_mean_window(spark, sf_dir: str) -> DataFrame:
    return pairs.mean_window_jaccard(*_windows(spark, sf_dir)).withColumn("similarity", _SIX(F.col("similarity")))


@query(f"{FLAT_ALL} SELECT i, j, c / nb::DOUBLE AS overlap, c / least(na, nb)::DOUBLE AS of_smaller FROM px")
def sim_overlap(spark, sf_dir: str) -> DataFrame:
    """Share of the second's bits, and of the smaller's, that are common."""
    a, b, i = F.col("na"), F.col("nb"), F.col("inter")
    return _measured(flat(spark, sf_dir), metrics.containment(b, i).alias("overlap"), metrics.smaller_share(a, b, i).alias("of_smaller"))


@query(f"{FLAT_ALL} SELECT i, j, (na + nb - 2 * c)::BIGINT AS hd FROM px")
def sim_hamming(spark, sf_dir: str) -> DataFrame:
    return _measured(flat(spark, sf_dir), metrics.hamming(F.col("na"), F.col("nb"), F.col("inter")).alias("hd"))


@query(f"{WIN_ALL}, t AS (SELECT seq_id, count(*) AS n FROM wbits GROUP BY 1), s AS (SELECT i, j, sum(c) AS c FROM wpr GROUP BY 1, 2) SELECT i, j, (x.n + y.n - 2 * c)::BIGINT AS hd FROM s JOIN t x ON x.seq_id = i JOIN t y ON y.seq_id = j")
def sim_hamming_windowed(spark, sf_dir: str) -> DataFrame:
    return pairs.windowed_hamming(_window_bits(spark, sf_dir))


@query(f"{FLAT_ALL} SELECT i, j, c / (na + nb - c)::DOUBLE AS similarity FROM px WHERE c / (na + nb - c)::DOUBLE >= 0.5")
def sim_filtered_inverted(spark, sf_dir: str) -> DataFrame:
    """Pairs with Jaccard 0.5 and more."""
    return block_pairs.similar(flat(spark, sf_dir), 0.5)


@query(f"{FLAT_ALL} SELECT i, j, c / (na + nb - c)::DOUBLE AS similarity FROM px WHERE c / (na + nb - c)::DOUBLE >= 0.9")
def sim_filtered_prefix(spark, sf_dir: str) -> DataFrame:
    """Pairs with Jaccard 0.9 and more: near copies, for which a few cells of folded bits tell most others apart."""
    return pairs.similar(flat(spark, sf_dir), 0.9)


_BENCH = "bdna AS (SELECT item_id AS seq_id, '' AS lang, '' AS source, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) AS seq FROM benchmark)"


@query(f"WITH {DNA}, {KM}, {FLAT}, {_BENCH}, {kmer_sql('bkm', 9, 'bdna')}, q AS (SELECT DISTINCT seq_id, {bit_sql('h')} AS bit FROM bkm), n AS (SELECT seq_id, count(*) AS n FROM q GROUP BY 1), hit AS (SELECT q.seq_id AS item_id, bits.seq_id AS doc_id, count(*) AS c FROM q JOIN bits USING (bit) GROUP BY 1, 2) SELECT item_id, doc_id, c / n.n::DOUBLE AS overlap FROM hit JOIN n ON n.seq_id = item_id WHERE c * 2 >= n.n")
def sim_vs_benchmark(spark, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item's bits."""
    items = sketches.bit_rows(sketches.flat(sketches.dna(table(spark, sf_dir, "benchmark"), "item_id", "text"), ALL))
    n = items.groupBy(F.col("seq_id").alias("i")).agg(F.count(F.lit(1)).alias("n"))
    hits = pairs.against(items, _bits(spark, sf_dir)).join(n, "i").where(2 * F.col("inter") >= F.col("n"))
    return hits.select(F.col("i").alias("item_id"), F.col("j").alias("doc_id"), metrics.containment(F.col("n"), F.col("inter")).alias("overlap"))


@query(f"{FLAT_ALL}, s AS (SELECT (floor(c * 10 / (na + nb - c)::DOUBLE + 1e-9) * 10)::INT AS bin, count(*) AS n FROM px GROUP BY 1), z AS (SELECT (SELECT count(*) * (count(*) - 1) / 2 FROM cnt) - (SELECT count(*) FROM px) AS n) SELECT b.bin::INT AS bin, (coalesce(s.n, 0) + CASE WHEN b.bin = 0 THEN z.n ELSE 0 END)::BIGINT AS count FROM (SELECT unnest(range(0, 101, 10)) AS bin) b LEFT JOIN s ON s.bin = b.bin, z")
def sim_histogram(spark, sf_dir: str) -> DataFrame:
    """Histogram of the flat Jaccard of all pairs of sequences that have a k-mer; pairs are counted, not formed."""
    return block_pairs.histogram(flat(spark, sf_dir))


def _runs_sql(runs: int, size: int) -> str:
    return f"""WITH {DNA}, {KM}, {FLAT}, r AS (SELECT run::INT AS run, seq_id, row_number() OVER (PARTITION BY run ORDER BY md5(run || '/' || seq_id), seq_id) AS rk FROM dna, (SELECT unnest(range({runs})) AS run)),
m AS (SELECT run, seq_id FROM r WHERE rk <= {size}), cnt AS (SELECT seq_id, count(bit) AS n FROM dna LEFT JOIN bits USING (seq_id) GROUP BY 1),
c AS (SELECT a.run, a.seq_id AS i, b.seq_id AS j, count(*) AS c FROM m a JOIN bits x ON x.seq_id = a.seq_id JOIN bits y ON y.bit = x.bit JOIN m b ON b.run = a.run AND b.seq_id = y.seq_id AND a.seq_id < b.seq_id GROUP BY 1, 2, 3),
p AS (SELECT a.run, a.seq_id AS i, b.seq_id AS j FROM m a JOIN m b ON a.run = b.run AND a.seq_id < b.seq_id),
s AS (SELECT p.run, 100 * coalesce(coalesce(c.c, 0) / nullif(x.n + y.n - coalesce(c.c, 0), 0)::DOUBLE, 0) AS s FROM p LEFT JOIN c USING (run, i, j) JOIN cnt x ON x.seq_id = p.i JOIN cnt y ON y.seq_id = p.j),
t AS (SELECT run, avg(s) AS mean, stddev_pop(s) AS stdev FROM s GROUP BY 1)"""


_FOUR = "round({0}(mean), 6) AS mean, round({0}(stdev), 6) AS stdev, round({0}(mean - 0.675 * stdev), 6) AS q1, round({0}(mean + 0.675 * stdev), 6) AS q3"


def _spread(spark, sf_dir: str, runs: int, size: int = 100) -> DataFrame:
    return aggregates.spread(aggregates.sampled_pairs(flat(spark, sf_dir), size, runs), "similarity", "run")


@query(f"{_runs_sql(1, 100)} SELECT {_FOUR.format('')} FROM t")
def pair_stats(spark, sf_dir: str) -> DataFrame:
    """Mean, deviation and normal quartiles of a sample's pairs."""
    return _spread(spark, sf_dir, 1).select(*[_SIX(F.col(c)).alias(c) for c in ("mean", "stdev", "q1", "q3")])


@query(f"{_runs_sql(10, 100)} SELECT run, {_FOUR.format('')} FROM t")
def pair_stats_runs(spark, sf_dir: str) -> DataFrame:
    return _spread(spark, sf_dir, 10).select("run", *[_SIX(F.col(c)).alias(c) for c in ("mean", "stdev", "q1", "q3")])


@query(f"{_runs_sql(10, 100)} SELECT {_FOUR.format('avg')} FROM t")
def pair_stats_mean(spark, sf_dir: str) -> DataFrame:
    """The runs' mean."""
    return _spread(spark, sf_dir, 10).agg(*[_SIX(F.avg(c)).alias(c) for c in ("mean", "stdev", "q1", "q3")])


@query(f"{_runs_sql(10, 100)} SELECT round(avg(mean + 0.675 * stdev) / 100, 6) AS split_threshold FROM t")
def split_threshold(spark, sf_dir: str) -> DataFrame:
    """Upper quartile of the sampled similarities, as a share."""
    return _spread(spark, sf_dir, 10).agg(_SIX(F.avg("q3") / 100).alias("split_threshold"))


@query("SELECT p_partkey, levenshtein(p_name, p_type)::INT AS distance FROM part")
def edit_distance(spark, sf_dir: str) -> DataFrame:
    """Global edit distance of each part's name and type."""
    return table(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"))
