"""Windowed signatures: set operations, full matrices, sampled statistics and means; and queries over whole clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import SketchConfig
from ..operators import aggregates, block_pairs, evaluate, pairs, sketches, windowed as by_window
from ..sources.storage import written
from .base import ALL, CFG, DNA, FLAT, KM, WBITS, WIN, WIN_ALL, bit_sql, dna, flat, kmer_sql, query, table, window_counts, windowed
from .cluster_queries import _EDGES, _MEAN, _signatures
from .pair_queries import _FOUR, _SIX, MATCH, _window_bits, _windows, sim_filtered_inverted, sim_global, sim_local, sim_matching, unions


@query(f"""{WIN_ALL}, up AS (SELECT seq_id, window_id, sum(n) OVER (PARTITION BY seq_id ORDER BY window_id) AS upto FROM wcnt),
t AS (SELECT seq_id, sum(n) AS n, max(window_id) AS last FROM wcnt GROUP BY 1), s AS (SELECT i, j, sum(c) AS c FROM wpr GROUP BY 1, 2)
SELECT i, j, c::BIGINT AS inter, (x.n + y.n - c)::BIGINT AS union_, (x.n + y.n - 2 * c)::BIGINT AS hd, (ux.upto + uy.upto - 2 * c)::BIGINT AS hd_common, c / y.n::DOUBLE AS overlap
FROM s JOIN t x ON x.seq_id = i JOIN t y ON y.seq_id = j JOIN up ux ON ux.seq_id = i AND ux.window_id = least(x.last, y.last) JOIN up uy ON uy.seq_id = j AND uy.window_id = least(x.last, y.last)""")
def sim_window_measures(spark, sf_dir: str) -> DataFrame:
    """Intersection, union, Hamming distance with and without the tail, and containment, window by window."""
    return by_window.measures(_window_bits(spark, sf_dir))


_TWO = f"WITH {DNA}, {KM}, {WIN}, {WBITS}, e AS (SELECT seq_id // 2 AS key, seq_id % 2 AS side, window_id, bit FROM wbits), l AS (SELECT key, side, max(window_id) AS last FROM e GROUP BY 1, 2), b AS (SELECT key, min(last) AS last FROM l GROUP BY 1 HAVING count(*) = 2)"


def _two(spark, sf_dir: str, how: str) -> DataFrame:
    """Each even sequence and the next odd one."""
    rows = _window_bits(spark, sf_dir).select(F.floor(F.col("seq_id") / 2).cast("long").alias("key"), F.pmod("seq_id", F.lit(2)).alias("side"), "window_id", "bit")
    return by_window.combined(*(rows.where(F.col("side") == s).drop("side") for s in (0, 1)), how)


@query(f"{_TWO} SELECT DISTINCT key, window_id, bit FROM e JOIN b USING (key)")
def windows_or(spark, sf_dir: str) -> DataFrame:
    return _two(spark, sf_dir, "or")


@query(f"{_TWO} SELECT key, window_id, bit FROM e JOIN b USING (key) GROUP BY key, window_id, bit, b.last HAVING count(DISTINCT side) = 2 OR window_id > b.last")
def windows_and(spark, sf_dir: str) -> DataFrame:
    return _two(spark, sf_dir, "and")


@query(f"{WIN_ALL}, b AS (SELECT DISTINCT seq_id, bit FROM wbits) SELECT x.seq_id AS i, y.seq_id AS j, count(*)::BIGINT AS inter FROM b x JOIN b y ON x.bit = y.bit AND x.seq_id < y.seq_id GROUP BY 1, 2")
def global_common_bits(spark, sf_dir: str) -> DataFrame:
    """Common bits of all windows' unions."""
    return block_pairs.counted(unions(spark, sf_dir)).select("i", "j", "inter")


_LOCAL = f"{WIN_ALL}, s AS (SELECT i, j, round(sum(c / (na + nb - c)::DOUBLE) / least(any_value(x.n), any_value(y.n)), 6) AS similarity FROM wpx JOIN nw x ON x.seq_id = i JOIN nw y ON y.seq_id = j GROUP BY i, j)"


@query(f"{_LOCAL} SELECT i, j, similarity FROM s UNION ALL SELECT seq_id, seq_id, 1.0 FROM nw")
def sim_local_diagonal(spark, sf_dir: str) -> DataFrame:
    """The upper triangle of the windows' mean Jaccard with its diagonal."""
    own = window_counts(spark, sf_dir).select(F.col("seq_id").alias("i"), F.col("seq_id").alias("j"), F.lit(1.0).alias("similarity"))
    return sim_local(spark, sf_dir).unionByName(own)


_GLOBAL = f"{WIN_ALL}, b AS (SELECT DISTINCT seq_id, bit FROM wbits), n AS (SELECT seq_id, count(*) AS n FROM b GROUP BY 1), p AS (SELECT x.seq_id AS i, y.seq_id AS j, count(*) AS c FROM b x JOIN b y ON x.bit = y.bit AND x.seq_id < y.seq_id GROUP BY 1, 2), s AS (SELECT i, j, c / (x.n + y.n - c)::DOUBLE AS similarity FROM p JOIN n x ON x.seq_id = i JOIN n y ON y.seq_id = j)"
_FULL = " SELECT i, j, similarity FROM s UNION ALL SELECT j, i, similarity FROM s UNION ALL SELECT seq_id, seq_id, 1.0 FROM nw"


@query(_GLOBAL + _FULL)
def sim_global_full(spark, sf_dir: str) -> DataFrame:
    """Full matrix without its zeros."""
    return pairs.both_ways(sim_global(spark, sf_dir), window_counts(spark, sf_dir))


_MATCHING = f"{WIN_ALL}, s AS (SELECT i, j, round(count(*) FILTER (WHERE c >= {MATCH} OR (c > 0 AND c = na + nb - c)) / greatest(any_value(x.n), any_value(y.n))::DOUBLE, 6) AS similarity FROM wpx JOIN nw x ON x.seq_id = i JOIN nw y ON y.seq_id = j GROUP BY i, j)"


@query(_MATCHING + _FULL)
def sim_matching_full(spark, sf_dir: str) -> DataFrame:
    """Full matrix without the pairs that have no common bit in a window."""
    return pairs.both_ways(sim_matching(spark, sf_dir), window_counts(spark, sf_dir))


def _stats_sql(method: str, runs: int) -> str:
    """t: (run, mean, stdev) of the sampled pairs' similarity in per cent."""
    found = {"matching": _MATCHING.replace("round(", "(").replace("::DOUBLE, 6)", "::DOUBLE)"), "local": _LOCAL.replace("round(", "(").replace(", 6) AS similarity", ") AS similarity"), "global": _GLOBAL}[method]
    rank = f"r AS (SELECT run::INT AS run, seq_id, row_number() OVER (PARTITION BY run ORDER BY md5(run || '/' || seq_id), seq_id) AS rk FROM dna, (SELECT unnest(range({runs})) AS run)), m AS (SELECT run, seq_id FROM r WHERE rk <= 100)"
    return f"{found}, {rank}, q AS (SELECT x.run, 100 * coalesce(similarity, 0) AS s FROM m x JOIN m y ON x.run = y.run AND x.seq_id < y.seq_id LEFT JOIN s ON s.i = x.seq_id AND s.j = y.seq_id), t AS (SELECT run, avg(s) AS mean, stddev_pop(s) AS stdev FROM q GROUP BY 1)"


def _stats(spark, sf_dir: str, method: str, runs: int) -> DataFrame:
    bits, counts = _windows(spark, sf_dir)
    found = by_window.sampled_similarity(bits, dna(spark, sf_dir).select("seq_id"), counts, 100, runs, method, MATCH)
    return aggregates.spread(found, "similarity", "run")


@query(f"{_stats_sql('matching', 10)} SELECT run, {_FOUR.format('')} FROM t")
def pair_stats_windowed(spark, sf_dir: str) -> DataFrame:
    """Ten runs of 100 sequences: how alike pairs are by matching windows."""
    return _stats(spark, sf_dir, "matching", 10).select("run", *[_SIX(F.col(c)).alias(c) for c in ("mean", "stdev", "q1", "q3")])


@query(f"{_stats_sql('matching', 10)} SELECT round(avg(mean + 0.675 * stdev) / 100, 6) AS split_threshold FROM t")
def split_threshold_windowed(spark, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir, "matching", 10).agg(_SIX(F.avg("q3") / 100).alias("split_threshold"))


def _single(method: str):
    @query(f"{_stats_sql(method, 1)} SELECT {_FOUR.format('')} FROM t", name=f"pair_stats_{method}")
    def stats(spark, sf_dir: str) -> DataFrame:
        return _stats(spark, sf_dir, method, 1).select(*[_SIX(F.col(c)).alias(c) for c in ("mean", "stdev", "q1", "q3")])


for _method in by_window.METHODS:
    _single(_method)


_FOURS = f"WITH {DNA}, {KM}, {WIN}, {WBITS}, m AS (SELECT seq_id // 4 AS grp, seq_id, window_id, bit FROM wbits), l AS (SELECT grp, seq_id, max(window_id) AS last FROM m GROUP BY 1, 2), le AS (SELECT grp, min(last) AS last, count(*) AS n FROM l GROUP BY 1)"


def _fours(spark, sf_dir: str) -> DataFrame:
    """Groups of four sequences, windowed."""
    return _window_bits(spark, sf_dir).withColumn("grp", F.floor(F.col("seq_id") / 4).cast("long"))


@query(f"{_FOURS}, v AS (SELECT grp, window_id, bit, count(*) AS votes FROM m JOIN le USING (grp) WHERE window_id <= le.last GROUP BY 1, 2, 3) SELECT grp, window_id, bit FROM v JOIN le USING (grp) WHERE votes >= (n + 1) // 2")
def majority_mean_windowed(spark, sf_dir: str) -> DataFrame:
    """Windowed means, as long as a group's shortest member."""
    rows = written(sketches.window_keys(dna(spark, sf_dir), CFG).withColumn("grp", F.floor(F.col("seq_id") / 4).cast("long")), "signatures")
    window = F.floor(F.col("bit") / sketches.WINDOW).cast("int").alias("window_id")
    return by_window.truncated_mean_keys(rows, "grp").select("grp", window, F.pmod("bit", F.lit(sketches.WINDOW)).cast("int").alias("bit"))


@query(f"{_FOURS}, w AS (SELECT grp, cluster::INT AS cluster, unnest(range(0, last + 1))::INT AS window_id FROM le, (SELECT unnest(range(2)) AS cluster)), p AS (SELECT w.grp, w.cluster, w.window_id, arg_min(l.seq_id, md5('7/' || w.cluster || '/' || w.window_id || '/' || l.seq_id)) AS seq_id FROM w JOIN l USING (grp) GROUP BY 1, 2, 3) SELECT p.grp, p.cluster, p.window_id, m.bit FROM p JOIN m ON m.grp = p.grp AND m.seq_id = p.seq_id AND m.window_id = p.window_id")
def mosaic_seeds(spark, sf_dir: str) -> DataFrame:
    """Two seeds a group, each window from a member drawn by hash."""
    return by_window.mosaic(_fours(spark, sf_dir), "grp", 2, 7)


_SPREAD = ", na AS (SELECT lang, seq_id, count(*) AS n FROM m GROUP BY 1, 2), nb AS (SELECT lang, count(*) AS n FROM mean GROUP BY 1), c AS (SELECT m.lang, seq_id, count(*) AS c FROM m JOIN mean USING (lang, bit) GROUP BY 1, 2), d AS (SELECT na.lang, seq_id, na.n + coalesce(nb.n, 0) - 2 * coalesce(c.c, 0) AS hd FROM na LEFT JOIN nb USING (lang) LEFT JOIN c USING (lang, seq_id))"


@query(_MEAN + _SPREAD + ", s AS (SELECT lang, sqrt(avg(hd::DOUBLE ** 2)) AS sd FROM d GROUP BY 1), x AS (SELECT a.lang AS i, b.lang AS j, count(*) AS c FROM mean a JOIN mean b ON a.bit = b.bit GROUP BY 1, 2), r AS (SELECT p.lang AS i, max((p.sd + q.sd) / (a.n + b.n - 2 * coalesce(x.c, 0))) AS worst FROM s p JOIN s q ON p.lang <> q.lang JOIN nb a ON a.lang = p.lang JOIN nb b ON b.lang = q.lang LEFT JOIN x ON x.i = p.lang AND x.j = q.lang GROUP BY 1) SELECT round(avg(worst), 6) AS davies_bouldin FROM r")
def davies_bouldin_hamming(spark, sf_dir: str) -> DataFrame:
    """The index over languages: deviations and centres by Hamming distance."""
    return aggregates.davies_bouldin_hamming(_signatures(spark, sf_dir), "lang").select(_SIX(F.col("davies_bouldin")).alias("davies_bouldin"))


@query(_MEAN + _SPREAD + " SELECT lang, max(hd)::BIGINT AS hd, arg_min(seq_id, -hd * 1000000000 + seq_id) AS seq_id FROM d GROUP BY 1")
def farthest_member(spark, sf_dir: str) -> DataFrame:
    """Each cluster's member at the greatest Hamming distance from its mean, ties to the smaller id."""
    return aggregates.farthest(_signatures(spark, sf_dir), "lang")


@query(f"WITH {DNA}, {KM}, m0 AS (SELECT DISTINCT lang, seq_id, {bit_sql('h')} AS bit FROM km), f AS (SELECT DISTINCT lang, seq_id FROM m0), o AS (SELECT a.lang, min(b.seq_id) AS seq_id FROM (SELECT DISTINCT lang FROM f) a JOIN f b ON a.lang <> b.lang GROUP BY 1), m AS (SELECT lang, seq_id, bit FROM m0 UNION ALL SELECT o.lang, m0.seq_id, m0.bit FROM o JOIN m0 ON m0.seq_id = o.seq_id), sz AS (SELECT lang, count(DISTINCT seq_id) AS n FROM m GROUP BY 1), v AS (SELECT lang, bit, count(*) AS votes FROM m GROUP BY 1, 2), mean AS (SELECT v.lang, bit FROM v JOIN sz USING (lang) WHERE votes >= (n + 1) // 2), na AS (SELECT lang, seq_id, count(*) AS n FROM m GROUP BY 1, 2), nb AS (SELECT lang, count(*) AS n FROM mean GROUP BY 1), c AS (SELECT m.lang, seq_id, count(*) AS c FROM m JOIN mean USING (lang, bit) GROUP BY 1, 2) SELECT na.lang, round(avg(coalesce(c.c, 0) / (na.n + coalesce(nb.n, 0) - coalesce(c.c, 0))::DOUBLE), 6) AS priority FROM na LEFT JOIN nb USING (lang) LEFT JOIN c USING (lang, seq_id) GROUP BY 1")
def what_if_priority(spark, sf_dir: str) -> DataFrame:
    """A language's priority if the first sequence of another language joined it."""
    m = _signatures(spark, sf_dir)
    firsts = m.groupBy("lang").agg(F.min("seq_id").alias("seq_id"))
    other = firsts.select(F.col("lang").alias("of"), F.col("seq_id").alias("first"))
    joining = firsts.select("lang").join(other, F.col("lang") != F.col("of")).groupBy("lang").agg(F.min("first").alias("seq_id"))
    added = joining.join(m.select("seq_id", "bits"), "seq_id").select("lang", "seq_id", "bits")
    return aggregates.priority(m.unionByName(added), "lang").select("lang", _SIX(F.col("priority")).alias("priority"))


@query(f"WITH {DNA}, {KM}, {FLAT} SELECT round(count(bit) / {ALL.bits}.0, 9) AS density FROM dna LEFT JOIN bits USING (seq_id) WHERE dna.seq_id = (SELECT min(seq_id) FROM dna)")
def first_density(spark, sf_dir: str) -> DataFrame:
    """Share of set bits of the first signature."""
    first = flat(spark, sf_dir).agg(F.min_by(F.size("bits"), "seq_id").alias("n"))
    return first.select(F.round(F.col("n") / ALL.bits, 9).alias("density"))


_CANON = f"WITH {DNA}, {kmer_sql('km0')}, km AS (SELECT seq_id, lang, source, pos, least(h, rc) AS h FROM km0), {WIN}"


@query(f"{_CANON} SELECT seq_id, window_id, string_agg(h::VARCHAR, ',' ORDER BY h) AS hashes FROM win GROUP BY 1, 2")
def window_bottom_s_canonical(spark, sf_dir: str) -> DataFrame:
    """The smallest hashes of each window, of both strands."""
    return sketches.window_rows(dna(spark, sf_dir), SketchConfig(canonical=True)).withColumn("hashes", F.array_join("hashes", ","))


def _single_minimiser_sql(head: str) -> str:
    return f"{head}, one AS (SELECT km.seq_id, pos // 50 AS window_id, h, pos FROM km JOIN nwin USING (seq_id) WHERE pos % 50 < 42 AND pos // 50 < nwin.n) SELECT seq_id, window_id::INT AS window_id, min(h) AS h, max(pos) FILTER (WHERE h = m)::INT AS pos FROM (SELECT *, min(h) OVER (PARTITION BY seq_id, window_id) AS m FROM one) GROUP BY 1, 2"


@query(_single_minimiser_sql(f"WITH {DNA}, {KM}, {WIN}"))
def disjoint_minimisers(spark, sf_dir: str) -> DataFrame:
    """One minimiser of each disjoint window, with its right-most place."""
    return sketches.disjoint(dna(spark, sf_dir), CFG)


@query(_single_minimiser_sql(_CANON))
def disjoint_minimisers_canonical(spark, sf_dir: str) -> DataFrame:
    return sketches.disjoint(dna(spark, sf_dir), SketchConfig(canonical=True))


_BENCH = "bdna AS (SELECT item_id AS seq_id, '' AS lang, '' AS source, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) AS seq FROM benchmark)"


@query(f"WITH {DNA}, {KM}, {_BENCH}, {kmer_sql('bkm', 9, 'bdna')}, src AS (SELECT DISTINCT source, {bit_sql('h')} AS bit FROM km), q AS (SELECT DISTINCT seq_id, {bit_sql('h')} AS bit FROM bkm), a AS (SELECT q.seq_id, s.source, q.bit, src.bit IS NOT NULL AS found FROM q CROSS JOIN (SELECT DISTINCT source FROM src) s LEFT JOIN src ON src.source = s.source AND src.bit = q.bit) SELECT seq_id AS item_id, source, bool_and(found) AS contains_all, NOT bool_or(found) AS contains_none, min(bit) FILTER (WHERE NOT found) AS first_missing, min(bit) FILTER (WHERE found) AS first_found FROM a GROUP BY 1, 2")
def bloom_contains_none(spark, sf_dir: str) -> DataFrame:
    """Whether a source's signature holds all, or none, of an item's bits, and the first bit against it."""
    sources = sketches.merged(flat(spark, sf_dir, "source"), "source")
    items = sketches.flat(sketches.dna(table(spark, sf_dir, "benchmark"), "item_id", "text"), ALL).where(F.size("bits") > 0)
    return sketches.membership(items, sources, "source").withColumnRenamed("seq_id", "item_id")


@query(f"WITH {DNA}, {KM}, {FLAT}, s AS (SELECT seq_id, list_sort(list(bit)) AS bits FROM bits GROUP BY 1) SELECT min(seq_id) AS first, count(*)::BIGINT AS n FROM s GROUP BY bits HAVING count(*) > 1")
def equal_signatures(spark, sf_dir: str) -> DataFrame:
    """Classes of sequences with one signature."""
    s = flat(spark, sf_dir).where(F.size("bits") > 0)
    return s.groupBy("bits").agg(F.min("seq_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("bits")


@query(f"WITH {DNA} SELECT seq_id, (rk - 1)::BIGINT AS place FROM (SELECT seq_id, row_number() OVER (ORDER BY md5('3/' || seq_id), seq_id) AS rk FROM dna) WHERE rk <= 100")
def shuffled_first(spark, sf_dir: str) -> DataFrame:
    """The first hundred sequences in an order that a seed gives."""
    return sketches.placed(sketches.capped(sketches.shuffled(dna(spark, sf_dir), 3), 100, "order", "seq_id"), "order", "seq_id")


@query(f"{_EDGES}, h AS (SELECT doc_id AS seq_id, lang AS cluster, source AS parent, (doc_id % 3)::INT AS rank FROM documents), w AS (SELECT i, j, similarity FROM e UNION ALL SELECT j, i, similarity FROM e) SELECT y.parent, round(avg(similarity), 6) AS avg_sim, (count(DISTINCT j) + 1)::BIGINT AS size, max(y.rank) AS rank FROM w JOIN h x ON x.seq_id = i JOIN h y ON y.seq_id = j WHERE x.parent = y.parent GROUP BY 1")
def cluster_quality_by_parent(spark, sf_dir: str) -> DataFrame:
    """Quality of the clusters' parents: mean similarity of different sequences below one parent, their number and greatest rank."""
    h = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.col("source").alias("parent"), F.pmod("doc_id", F.lit(3)).cast("int").alias("rank"))
    return evaluate.quality_by_parent(sim_filtered_inverted(spark, sf_dir), h)


@query(_MEAN + _SPREAD + " SELECT seq_id, lang AS cluster, hd::BIGINT AS hd FROM d")
def node_distance(spark, sf_dir: str) -> DataFrame:
    """Each sequence with its node and its Hamming distance to the node's mean."""
    return aggregates.node_distances(_signatures(spark, sf_dir).withColumnRenamed("lang", "cluster"))
