"""Centroids, clusterings, prefix search, and quality of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import metrics
from ..operators import aggregates, clustering, evaluate, leader, pairs, prefix, sketches
from ..sources.storage import written
from .base import ALL, CFG, DNA, FLAT, FLAT_ALL, KM, WBITS, WIN, bit_sql, dna, flat, query, table, windowed
from .pair_queries import _SIX, sim_filtered_inverted


def _signatures(spark, sf_dir: str) -> DataFrame:
    """(lang, seq_id, bits) of all signatures with bits, computed once: means, sizes and distances each read them."""
    return written(flat(spark, sf_dir, "lang").where(F.size("bits") > 0).select("lang", "seq_id", "bits"), "signatures")


def _members(spark, sf_dir: str) -> DataFrame:
    """(lang, seq_id, bit) of them."""
    return sketches.bit_rows(_signatures(spark, sf_dir))


_M = f"WITH {DNA}, {KM}, m AS (SELECT DISTINCT lang, seq_id, {bit_sql('h')} AS bit FROM km), sz AS (SELECT lang, count(DISTINCT seq_id) AS n FROM m GROUP BY 1), v AS (SELECT lang, bit, count(*) AS votes FROM m GROUP BY 1, 2)"
_MEAN = _M + ", mean AS (SELECT v.lang, bit FROM v JOIN sz USING (lang) WHERE votes >= (n + 1) // 2)"


@query(_MEAN + " SELECT lang, bit FROM mean")
def majority_mean(spark, sf_dir: str) -> DataFrame:
    return aggregates.mean_signature(_signatures(spark, sf_dir), "majority", "lang")


@query(_M + " SELECT v.lang, bit FROM v JOIN sz USING (lang) WHERE 2 * votes > n")
def majority_mean_strict(spark, sf_dir: str) -> DataFrame:
    return aggregates.mean_signature(_signatures(spark, sf_dir), "strict", "lang")


@query(_M + " SELECT lang, bit FROM v")
def or_mean(spark, sf_dir: str) -> DataFrame:
    return aggregates.mean_signature(_signatures(spark, sf_dir), "or", "lang")


_DUP = f"WITH {DNA}, {KM}, m AS (SELECT DISTINCT md5(seq) AS grp, seq_id, {bit_sql('h')} AS bit FROM km JOIN dna USING (seq_id)), sz AS (SELECT grp, count(DISTINCT seq_id) AS n FROM m GROUP BY 1), v AS (SELECT grp, bit, count(*) AS votes FROM m GROUP BY 1, 2)"


@query(_DUP + ", a AS (SELECT v.grp, bit FROM v JOIN sz USING (grp) WHERE votes = n) SELECT grp, count(*)::BIGINT AS n FROM a GROUP BY 1")
def and_mean(spark, sf_dir: str) -> DataFrame:
    """Bits common to all members, of groups of equal sequences."""
    rows = written(sketches.flat(dna(spark, sf_dir).withColumn("grp", F.md5("seq")), ALL, "grp"), "signatures")
    return aggregates.mean_signature(sketches.bit_rows(rows), "and", "grp").groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DNA}, {KM}, {WIN}, {WBITS}, sz AS (SELECT lang, count(DISTINCT seq_id) AS n FROM wbits GROUP BY 1), v AS (SELECT lang, window_id, bit, count(*) AS votes FROM wbits GROUP BY 1, 2, 3) SELECT v.lang, window_id, bit FROM v JOIN sz USING (lang) WHERE votes * 20 >= n")
def frequent_window_bits(spark, sf_dir: str) -> DataFrame:
    """Bits that a twentieth of a language's sequences have at a window."""
    rows = sketches.bit_rows(windowed(spark, sf_dir, "lang"))
    sizes = rows.groupBy("lang").agg(F.count_distinct("seq_id").alias("n"))
    votes = rows.groupBy("lang", "window_id", "bit").agg(F.count(F.lit(1)).alias("votes"))
    return votes.join(sizes, "lang").where(F.col("votes") * 20 >= F.col("n")).select("lang", "window_id", "bit")


@query(_MEAN + ", nb AS (SELECT lang, count(*) AS n FROM mean GROUP BY 1), na AS (SELECT lang, seq_id, count(*) AS n FROM m GROUP BY 1, 2), c AS (SELECT m.lang, seq_id, count(*) AS c FROM m JOIN mean USING (lang, bit) GROUP BY 1, 2) SELECT na.lang, round(avg(coalesce(c.c, 0) / (na.n + coalesce(nb.n, 0) - coalesce(c.c, 0))::DOUBLE), 6) AS priority FROM na LEFT JOIN nb USING (lang) LEFT JOIN c USING (lang, seq_id) GROUP BY 1")
def avg_sim_to_mean(spark, sf_dir: str) -> DataFrame:
    """A cluster's priority: its members' mean similarity to their majority mean."""
    return aggregates.priority(_signatures(spark, sf_dir), "lang").select("lang", _SIX(F.col("priority")).alias("priority"))


@query(_MEAN + ", na AS (SELECT lang, seq_id, count(*) AS n FROM m GROUP BY 1, 2), nb AS (SELECT lang, count(*) AS n FROM mean GROUP BY 1), c AS (SELECT m.lang, seq_id, count(*) AS c FROM m JOIN mean USING (lang, bit) GROUP BY 1, 2) SELECT na.lang, round(sqrt(avg((na.n + coalesce(nb.n, 0) - 2 * coalesce(c.c, 0))::DOUBLE ** 2)), 4) AS stdev FROM na LEFT JOIN nb USING (lang) LEFT JOIN c USING (lang, seq_id) GROUP BY 1")
def cluster_stdev(spark, sf_dir: str) -> DataFrame:
    """Root mean square Hamming distance to the majority mean."""
    m = _signatures(spark, sf_dir)
    d = aggregates.to_centroid(m, aggregates.mean_signature(m, "majority", "lang"), "lang")
    hd = metrics.hamming(F.col("na"), F.col("nb"), F.col("inter")).cast("double")
    return d.groupBy("lang").agg(F.round(F.sqrt(F.avg(hd * hd)), 4).alias("stdev"))


@query(_MEAN + ", na AS (SELECT seq_id, count(bit) AS n FROM dna LEFT JOIN m USING (seq_id) GROUP BY 1), nb AS (SELECT lang, count(*) AS n FROM mean GROUP BY 1), c AS (SELECT m.seq_id, mean.lang, count(*) AS c FROM m JOIN mean USING (bit) GROUP BY 1, 2), d AS (SELECT na.seq_id, nb.lang AS cluster, na.n + nb.n - 2 * coalesce(c.c, 0) AS hd FROM na CROSS JOIN nb LEFT JOIN c ON c.seq_id = na.seq_id AND c.lang = nb.lang) SELECT seq_id, arg_min(cluster, hd * 1000 + ascii(cluster) * 1.0 + ascii(cluster[2:]) / 1000.0) AS cluster, min(hd)::BIGINT AS hd FROM d GROUP BY 1")
def kmeans_assign_step(spark, sf_dir: str) -> DataFrame:
    """Each sequence's nearest language by Hamming distance to its majority mean."""
    m = _members(spark, sf_dir)
    centroids = aggregates.mean_signature(m, "majority", "lang").withColumnRenamed("lang", "cluster")
    return aggregates.nearest_cluster(aggregates.centroid_distances(dna(spark, sf_dir), m.select("seq_id", "bit"), centroids))


_POINTS = "p AS (SELECT vec_id, label, embedding FROM embeddings), l AS (SELECT vec_id, label, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x FROM p), ce AS (SELECT label, dim, avg(x) AS m FROM l GROUP BY 1, 2)"


@query(f"WITH {_POINTS}, d AS (SELECT l.vec_id, ce.label AS cluster, sqrt(sum((x - m) ** 2)) AS d FROM l JOIN ce USING (dim) GROUP BY 1, 2) SELECT vec_id, arg_min(cluster, round(d, 9)) AS cluster, round(min(round(d, 9)), 4) AS distance FROM d GROUP BY 1")
def nearest_centroid(spark, sf_dir: str) -> DataFrame:
    """Each vector's nearest label centre."""
    points = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    centres = aggregates.point_centroids(points, "label", "embedding").withColumnRenamed("label", "cluster")
    return aggregates.nearest_centre(points, centres, "vec_id", "embedding").select("vec_id", "cluster", F.round("d", 4).alias("distance"))


@query(f"WITH {_POINTS}, d AS (SELECT vec_id, label, sum((x - m) ** 2) AS d2 FROM l JOIN ce USING (label, dim) GROUP BY 1, 2) SELECT label, round(sqrt(avg(d2)), 6) AS rms, count(*)::BIGINT AS n FROM d GROUP BY 1")
def cluster_rms(spark, sf_dir: str) -> DataFrame:
    s = aggregates.point_spread(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return s.select("label", _SIX(F.col("rms")).alias("rms"), "n")


@query(f"WITH {_POINTS}, d AS (SELECT vec_id, label, sum((x - m) ** 2) AS d2 FROM l JOIN ce USING (label, dim) GROUP BY 1, 2), s AS (SELECT label, sqrt(avg(d2)) AS rms FROM d GROUP BY 1), c AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.m - b.m) ** 2)) AS dist FROM ce a JOIN ce b USING (dim) WHERE a.label <> b.label GROUP BY 1, 2), r AS (SELECT i, max((x.rms + y.rms) / dist) AS worst FROM c JOIN s x ON x.label = i JOIN s y ON y.label = j GROUP BY 1) SELECT round(avg(worst), 6) AS davies_bouldin FROM r")
def davies_bouldin(spark, sf_dir: str) -> DataFrame:
    s = aggregates.point_spread(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return aggregates.davies_bouldin(s, "label").select(_SIX(F.col("davies_bouldin")).alias("davies_bouldin"))


@query(f"WITH {DNA}, {KM}, b AS (SELECT DISTINCT source, lang, {bit_sql('h')} AS bit FROM km) SELECT lang, bit, count(DISTINCT source)::BIGINT AS n FROM b GROUP BY 1, 2 HAVING count(DISTINCT source) > 2")
def shared_child_bits(spark, sf_dir: str) -> DataFrame:
    """Bits set in more than two children (sources) of each node (a language)."""
    child = sketches.merged(flat(spark, sf_dir, "source", "lang"), "source", "lang")
    return child.groupBy("lang", "bit").agg(F.count_distinct("source").alias("n")).where("n > 2")


def _tree(spark, sf_dir: str) -> DataFrame:
    return leader.leader_tree(flat(spark, sf_dir), ALL.bits, 0.5, 0.1)


@query()
def leader_tree(spark, sf_dir: str) -> DataFrame:
    """Nodes of a STAY / NN / SPLIT tree with their numbers of bits."""
    return _tree(spark, sf_dir).select("node", "parent", F.size("bits").alias("n_bits"))


@query()
def reinsert(spark, sf_dir: str) -> DataFrame:
    """All sequences assigned to the tree's nodes, for two rounds."""
    return clustering.reinsert(flat(spark, sf_dir), _tree(spark, sf_dir).select("node", "bits"), 2)


@query()
def treap_classify(spark, sf_dir: str) -> DataFrame:
    return clustering.treap_classify(dna(spark, sf_dir), windowed(spark, sf_dir))


_LISTS = f"WITH {DNA}, {KM}, {WIN}, li AS (SELECT seq_id, string_agg(h::VARCHAR, ',' ORDER BY window_id) AS hashes FROM win WHERE rn = 1 GROUP BY 1)"


@query(_LISTS + " SELECT md5(hashes) AS leaf, count(*)::BIGINT AS n, min(seq_id) AS first FROM li GROUP BY hashes")
def prefix_index(spark, sf_dir: str) -> DataFrame:
    """Leaves of the tree of window minima: equal lists share one."""
    return prefix.index(prefix.lists(dna(spark, sf_dir), CFG)).select(F.md5(F.array_join("hashes", ",")).alias("leaf"), "n", "first")


@query(_LISTS + ", g AS (SELECT hashes, count(*) AS n, min(seq_id) AS first FROM li GROUP BY 1) SELECT seq_id, n::BIGINT AS n, first FROM li JOIN g USING (hashes)")
def prefix_search(spark, sf_dir: str) -> DataFrame:
    """For each sequence, how many have its whole list, and the first of them."""
    lists = written(prefix.lists(dna(spark, sf_dir), CFG), "lists")  # read by both sides
    return prefix.search(lists, prefix.index(lists)).select("seq_id", "n", "first")


def _by_source(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.col("source").alias("cluster"))


@query("WITH f AS (SELECT source, min(doc_id) AS first FROM documents GROUP BY 1), r AS (SELECT source, row_number() OVER (ORDER BY first) - 1 AS new FROM f) SELECT doc_id AS seq_id, new::BIGINT AS cluster FROM documents JOIN r USING (source)")
def dense_relabel(spark, sf_dir: str) -> DataFrame:
    return evaluate.relabelled(_by_source(spark, sf_dir))


@query("SELECT min(n)::BIGINT AS smallest, max(n)::BIGINT AS largest FROM (SELECT count(*) AS n FROM documents GROUP BY source)")
def smallest_cluster(spark, sf_dir: str) -> DataFrame:
    n = _by_source(spark, sf_dir).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.min("n").alias("smallest"), F.max("n").alias("largest"))


@query("SELECT source AS cluster, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS members FROM documents GROUP BY 1")
def cluster_members(spark, sf_dir: str) -> DataFrame:
    lists = _by_source(spark, sf_dir).groupBy("cluster").agg(F.array_sort(F.collect_list("seq_id")).alias("m"))
    return lists.select("cluster", F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("members"))


_EDGES = f"{FLAT_ALL}, e AS (SELECT i, j, c / (na + nb - c)::DOUBLE AS similarity FROM px WHERE c / (na + nb - c)::DOUBLE >= 0.5), cl AS (SELECT doc_id AS seq_id, lang AS cluster FROM documents)"


def _by_lang(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.col("lang").alias("cluster"))


@query(f"{_EDGES}, w AS (SELECT x.cluster, i, j, similarity FROM e JOIN cl x ON x.seq_id = i JOIN cl y ON y.seq_id = j WHERE x.cluster = y.cluster), s AS (SELECT cluster, count(DISTINCT v) AS size FROM (SELECT cluster, i AS v FROM w UNION ALL SELECT cluster, j FROM w) GROUP BY 1), a AS (SELECT cluster, round(avg(similarity), 6) AS avg_sim FROM w GROUP BY 1) SELECT (row_number() OVER (ORDER BY avg_sim DESC, size DESC, cluster) - 1)::BIGINT AS id, cluster, avg_sim, size::BIGINT AS size FROM a JOIN s USING (cluster)")
def cluster_quality(spark, sf_dir: str) -> DataFrame:
    return evaluate.quality(sim_filtered_inverted(spark, sf_dir), _by_lang(spark, sf_dir))


@query(f"{_EDGES}, w AS (SELECT x.cluster, min(similarity) AS least FROM e JOIN cl x ON x.seq_id = i JOIN cl y ON y.seq_id = j WHERE x.cluster = y.cluster GROUP BY 1) SELECT cluster, least FROM w")
def cluster_least_similarity(spark, sf_dir: str) -> DataFrame:
    """Least similarity of an edge inside each cluster."""
    c = _by_lang(spark, sf_dir)
    e = sim_filtered_inverted(spark, sf_dir).join(c.select(F.col("seq_id").alias("i"), "cluster"), "i").join(c.select(F.col("seq_id").alias("j"), F.col("cluster").alias("other")), "j")
    return e.where("cluster = other").groupBy("cluster").agg(F.min("similarity").alias("least"))


@query("WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), s AS (SELECT source, n / sum(n) OVER (PARTITION BY source)::DOUBLE AS p, n FROM n) SELECT source AS cluster, round(-sum(p * ln(p)), 6) AS entropy, sum(n)::BIGINT AS size FROM s GROUP BY 1")
def cluster_entropy(spark, sf_dir: str) -> DataFrame:
    e = evaluate.entropy(table(spark, sf_dir, "documents"), "source", "lang")
    return e.select(F.col("source").alias("cluster"), _SIX(F.col("entropy")).alias("entropy"), "size")


_TRUTH = "t AS (SELECT md5(coalesce(text, '')) AS cluster, lang FROM documents), n AS (SELECT cluster, lang, count(*) AS n FROM t GROUP BY 1, 2), s AS (SELECT cluster, n, n / sum(n) OVER (PARTITION BY cluster)::DOUBLE AS p FROM n), e AS (SELECT cluster, -sum(p * ln(p)) AS entropy, sum(n) AS size FROM s GROUP BY 1)"


@query(f"WITH {_TRUTH} SELECT cluster, size::BIGINT AS size FROM e WHERE abs(entropy) < 1e-12 AND size >= 3")
def pure_clusters(spark, sf_dir: str) -> DataFrame:
    """Clusters of equal texts, three and more, of one language."""
    rows = table(spark, sf_dir, "documents").select(F.md5(F.coalesce("text", F.lit(""))).alias("cluster"), "lang")
    return evaluate.entropy(rows, "cluster", "lang").where((F.abs("entropy") < 1e-12) & (F.col("size") >= 3)).select("cluster", "size")


@query("SELECT doc_id AS seq_id, quality, toxic, source, count(*) OVER (PARTITION BY source)::BIGINT AS size FROM documents JOIN labels USING (doc_id)")
def group_sizes(spark, sf_dir: str) -> DataFrame:
    """Labels joined to their documents, with the size of their group."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("size"))
    return rows.join(sizes, "source").select(F.col("doc_id").alias("seq_id"), "quality", "toxic", "source", "size")


@query(f"{_EDGES}, sc AS (SELECT doc_id AS seq_id, source AS cluster FROM documents), b AS (SELECT i, j, similarity FROM e UNION ALL SELECT j, i, similarity FROM e), tg AS (SELECT b.*, x.cluster AS ci, y.cluster AS cj FROM b JOIN sc x ON x.seq_id = i JOIN sc y ON y.seq_id = j), o AS (SELECT i, j, similarity, row_number() OVER (PARTITION BY i ORDER BY similarity DESC, j) AS rk FROM tg WHERE ci <> cj AND i NOT IN (SELECT i FROM tg WHERE ci = cj)) SELECT i AS seq_id, j AS neighbour, similarity FROM o WHERE rk = 1")
def outlier_neighbours(spark, sf_dir: str) -> DataFrame:
    return evaluate.outlier_neighbours(sim_filtered_inverted(spark, sf_dir), _by_source(spark, sf_dir))
