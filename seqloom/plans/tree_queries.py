"""Trees of clusters: nodes' signatures, descent, splitting, trimming, and the insertion driver."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions import metrics
from ..operators import balanced, clustering, radius, sketches, tour, treap, trees
from ..sources.storage import folder, written
from ..streaming import means as moving
from .base import ALL, CFG, DNA, FLAT, KM, WBITS, WIN, bit_sql, dna, flat, kmer_sql, query, table, windowed
from .cluster_queries import _M, _MEAN, _signatures
from .pair_queries import MATCH, _window_bits
from .window_queries import _BENCH


def _leaves(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Languages as branches of one root and their sources as leaves: ((node, parent), (node, seq_id, bit))."""
    nodes, members = _leaf_rows(spark, sf_dir)
    return nodes, sketches.bit_rows(members)


def _leaf_rows(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same of signatures that are computed once, a row each: ((node, parent), (node, seq_id, bits))."""
    leaf = F.concat_ws("/", "lang", "source")
    rows = written(flat(spark, sf_dir, "lang", "source").where(F.size("bits") > 0), "signatures")
    pairs = rows.select(leaf.alias("node"), F.col("lang").alias("parent")).distinct()
    tops = rows.select(F.col("lang").alias("node"), F.lit("all").alias("parent")).distinct()
    return pairs.unionByName(tops), rows.select(leaf.alias("node"), "seq_id", "bits")


_TREE = f"""WITH {DNA}, {KM}, m AS (SELECT DISTINCT lang, lang || '/' || source AS node, seq_id, {bit_sql('h')} AS bit FROM km),
sz AS (SELECT lang, node, count(DISTINCT seq_id) AS n FROM m GROUP BY 1, 2), v AS (SELECT node, bit, count(*) AS votes FROM m GROUP BY 1, 2),
lm AS (SELECT lang, node, bit, n FROM v JOIN sz USING (node) WHERE votes >= (n + 1) // 2), k AS (SELECT lang, count(*) AS n FROM sz WHERE n > 1 GROUP BY 1),
bm AS (SELECT lm.lang, bit FROM lm JOIN k USING (lang) WHERE lm.n > 1 GROUP BY lm.lang, bit, k.n HAVING count(*) >= (k.n + 1) // 2)"""


@query(f"{_TREE} SELECT node, bit FROM lm UNION ALL SELECT lang, bit FROM bm UNION ALL SELECT DISTINCT 'all', bit FROM bm")
def tree_centroids(spark, sf_dir: str) -> DataFrame:
    """Signatures of leaves (majority of members), branches (majority of leaves) and the root (union)."""
    return trees.centroids(*_leaf_rows(spark, sf_dir))


_NA = "na AS (SELECT dna.seq_id, count(bit) AS n FROM dna LEFT JOIN m USING (seq_id) GROUP BY 1)"


@query(f"""{_TREE}, {_NA}, nb AS (SELECT l.lang, count(bit) AS n FROM (SELECT DISTINCT lang FROM sz) l LEFT JOIN bm USING (lang) GROUP BY 1),
c AS (SELECT m.seq_id, bm.lang, count(*) AS c FROM m JOIN bm USING (bit) GROUP BY 1, 2),
t AS (SELECT seq_id, lang FROM (SELECT na.seq_id, nb.lang, row_number() OVER (PARTITION BY na.seq_id ORDER BY na.n + nb.n - 2 * coalesce(c, 0), nb.lang) AS rk FROM na CROSS JOIN nb LEFT JOIN c ON c.seq_id = na.seq_id AND c.lang = nb.lang) WHERE rk = 1),
nl AS (SELECT sz.lang, sz.node, count(bit) AS n FROM sz LEFT JOIN lm USING (node) GROUP BY 1, 2), cl AS (SELECT m.seq_id, lm.node, count(*) AS c FROM m JOIN t USING (seq_id) JOIN lm ON lm.lang = t.lang AND lm.bit = m.bit GROUP BY 1, 2)
SELECT seq_id, node, hd FROM (SELECT t.seq_id, nl.node, (na.n + nl.n - 2 * coalesce(c, 0))::BIGINT AS hd, row_number() OVER (PARTITION BY t.seq_id ORDER BY na.n + nl.n - 2 * coalesce(c, 0), nl.node) AS rk FROM t JOIN na USING (seq_id) JOIN nl ON nl.lang = t.lang LEFT JOIN cl ON cl.seq_id = t.seq_id AND cl.node = nl.node) WHERE rk = 1""")
def tree_descend(spark, sf_dir: str) -> DataFrame:
    """Every sequence's way down the tree, to the nearest child at each level."""
    nodes, members = _leaves(spark, sf_dir)
    return trees.descend(dna(spark, sf_dir), members.select("seq_id", "bit"), nodes, trees.centroids(nodes, members))


_GROUPS = f"""WITH {DNA}, {KM}, m AS (SELECT DISTINCT concat_ws('/', d.lang, d.source, coalesce(d.n_chars, 0) // 500) AS node, km.seq_id, {bit_sql('h')} AS bit FROM km JOIN documents d ON d.doc_id = km.seq_id),
sz AS (SELECT node, count(DISTINCT seq_id) AS n FROM m GROUP BY 1), v AS (SELECT node, bit, count(*) AS votes FROM m GROUP BY 1, 2), mean AS (SELECT v.node, bit FROM v JOIN sz USING (node) WHERE n > 1 AND votes >= (n + 1) // 2)"""


@query(f"""{_GROUPS}, f AS (SELECT m.* FROM m JOIN sz USING (node) WHERE n = 1), na AS (SELECT seq_id, count(*) AS n FROM f GROUP BY 1), nb AS (SELECT node, count(*) AS n FROM mean GROUP BY 1),
c AS (SELECT f.seq_id, mean.node, count(*) AS c FROM f JOIN mean USING (bit) GROUP BY 1, 2), b AS (SELECT seq_id, c.node, row_number() OVER (PARTITION BY seq_id ORDER BY c / (na.n + nb.n - c)::DOUBLE DESC, c.node) AS rk FROM c JOIN na USING (seq_id) JOIN nb ON nb.node = c.node)
SELECT DISTINCT seq_id, m.node FROM m JOIN sz USING (node) WHERE n > 1 UNION ALL SELECT na.seq_id, b.node FROM na LEFT JOIN b ON b.seq_id = na.seq_id AND rk = 1""")
def tree_without_singletons(spark, sf_dir: str) -> DataFrame:
    """Groups of one member are dissolved and their members assigned anew."""
    group = F.concat_ws("/", "lang", "source", F.floor(F.coalesce("n_chars", F.lit(0)) / 500).cast("string"))
    return trees.without_singletons(sketches.bit_rows(written(flat(spark, sf_dir, "lang", "source", "n_chars").select(group.alias("node"), "seq_id", "bits"), "signatures")))


def _far(of: str, to: str) -> str:
    """Hamming distances of members to a signature of their group."""
    return f"SELECT na.lang, na.seq_id, (na.n + coalesce(nb.n, 0) - 2 * coalesce(c, 0))::BIGINT AS hd FROM na LEFT JOIN (SELECT lang, count(*) AS n FROM {to} GROUP BY 1) nb USING (lang) LEFT JOIN (SELECT m.lang, seq_id, count(*) AS c FROM {of} m JOIN {to} USING (lang, bit) GROUP BY 1, 2) USING (lang, seq_id)"


def _farthest(rows: str) -> str:
    return f"SELECT m.lang, bit FROM m JOIN (SELECT lang, seq_id, row_number() OVER (PARTITION BY lang ORDER BY hd DESC, seq_id) AS rk FROM {rows}) f ON f.seq_id = m.seq_id AND f.lang = m.lang AND rk = 1"


@query(f"{_MEAN}, na AS (SELECT lang, seq_id, count(*) AS n FROM m GROUP BY 1, 2), d0 AS ({_far('m', 'mean')}), p AS ({_farthest('d0')}), d1 AS ({_far('m', 'p')}), q AS ({_farthest('d1')}), d2 AS ({_far('m', 'q')}) SELECT lang AS node, seq_id, (d2.hd < d1.hd)::INT AS side, least(d1.hd, d2.hd) AS hd FROM d1 JOIN d2 USING (lang, seq_id)")
def tree_poles(spark, sf_dir: str) -> DataFrame:
    """Each language in two, by its two poles."""
    return trees.poles(_signatures(spark, sf_dir).withColumnRenamed("lang", "node"))


_BWIN = WIN.replace("nwin", "bnum").replace("win AS (", "bwin AS (").replace("km", "bkm").replace("FROM dna", "FROM bdna")


@query(f"""WITH {DNA}, {KM}, {WIN}, {WBITS}, {_BENCH}, {kmer_sql('bkm', 9, 'bdna')}, {_BWIN}, q AS (SELECT DISTINCT seq_id, window_id, {bit_sql('h')} AS bit FROM bwin),
x AS (SELECT seq_id, window_id, count(*) AS n FROM q GROUP BY 1, 2), y AS (SELECT seq_id, window_id, count(*) AS n FROM wbits GROUP BY 1, 2), xn AS (SELECT seq_id, sum(n) AS n FROM x GROUP BY 1), yn AS (SELECT seq_id, sum(n) AS n FROM y GROUP BY 1),
c AS (SELECT q.seq_id, w.seq_id AS node, window_id, count(*) AS c FROM q JOIN wbits w USING (window_id, bit) GROUP BY 1, 2, 3),
p AS (SELECT c.seq_id, node, count(*) FILTER (WHERE c >= {MATCH} OR (c = x.n AND c = y.n)) AS matching, sum(c) AS c FROM c JOIN x ON x.seq_id = c.seq_id AND x.window_id = c.window_id JOIN y ON y.seq_id = node AND y.window_id = c.window_id GROUP BY 1, 2)
SELECT item_id, node, matching, hd FROM (SELECT p.seq_id AS item_id, node, matching::BIGINT AS matching, (xn.n + yn.n - 2 * c)::BIGINT AS hd, row_number() OVER (PARTITION BY p.seq_id ORDER BY matching DESC, xn.n + yn.n - 2 * c, node) AS rk FROM p JOIN xn ON xn.seq_id = p.seq_id JOIN yn ON yn.seq_id = node) WHERE rk = 1""")
def treap_best(spark, sf_dir: str) -> DataFrame:
    """For each benchmark item the document with most matching windows."""
    items = sketches.bit_rows(sketches.windowed(sketches.dna(table(spark, sf_dir, "benchmark"), "item_id", "text"), CFG))
    nodes = _window_bits(spark, sf_dir).select(F.col("seq_id").alias("node"), "window_id", "bit")
    return trees.best_match(items, nodes, MATCH).withColumnRenamed("seq_id", "item_id")


@query("""WITH RECURSIVE t AS (SELECT doc_id AS node, doc_id // 2 AS parent, coalesce(lang = 'de', false) AS filled FROM documents WHERE doc_id > 0),
up AS (SELECT node, parent FROM t WHERE filled UNION SELECT t.node, t.parent FROM up JOIN t ON t.node = up.parent),
k AS (SELECT up.node, up.parent, filled, (SELECT count(*) FROM up u WHERE u.parent = up.node) AS kids FROM up JOIN t USING (node)),
g AS (SELECT node, parent FROM k WHERE kids = 1 AND NOT filled), s AS (SELECT node, parent FROM k WHERE kids <> 1 OR filled),
w AS (SELECT node, parent FROM s UNION ALL SELECT w.node, g.parent FROM w JOIN g ON g.node = w.parent) SELECT node, min(parent) AS parent FROM w GROUP BY 1""")
def tree_trim(spark, sf_dir: str) -> DataFrame:
    """A binary tree over all ids, without what holds no German text and without empty links of chains."""
    rows = table(spark, sf_dir, "documents").where("doc_id > 0")
    nodes = rows.select(F.col("doc_id").alias("node"), F.floor(F.col("doc_id") / 2).cast("long").alias("parent"))
    return trees.trim(nodes, rows.where("lang = 'de'").select(F.col("doc_id").alias("node")))


@query("""WITH RECURSIVE t AS (SELECT doc_id AS node, doc_id // 2 AS parent FROM documents WHERE doc_id > 0),
w AS (SELECT node, NULL::BIGINT AS parent, 1 AS level, [node] AS path FROM t WHERE parent NOT IN (SELECT node FROM t) UNION ALL SELECT t.node, t.parent, level + 1, list_append(path, t.node) FROM w JOIN t ON t.parent = w.node),
p AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS before FROM w), s AS (SELECT node, count(*) AS size FROM (SELECT unnest(path) AS node FROM w) GROUP BY 1)
SELECT node, parent, level::INT AS level, (2 * before - level + 1)::BIGINT AS enters, (2 * before - level + 2 * size)::BIGINT AS leaves FROM p JOIN s USING (node)""")
def tree_tour(spark, sf_dir: str) -> DataFrame:
    """Where a walk around a binary tree over all ids enters and leaves each node, and levels."""
    rows = table(spark, sf_dir, "documents").where("doc_id > 0")
    return tour.tour(rows.select(F.col("doc_id").alias("node"), F.floor(F.col("doc_id") / 2).cast("long").alias("parent")))


@query("SELECT count(*)::BIGINT AS n_arrived, 0::BIGINT AS n_unlike FROM benchmark")
def tree_stream(spark, sf_dir: str) -> DataFrame:
    """The benchmark's texts arrive as a stream at the tree of all documents: how many stand at a leaf, and how many means differ from those of a tree that is built of all members."""
    nodes, members = _leaf_rows(spark, sf_dir)
    nodes = written(nodes, "nodes")
    base = f"{folder(spark)}/moving-{uuid.uuid4().hex}"
    items = sketches.dna(table(spark, sf_dir, "benchmark"), "item_id", "text")
    items.repartition(3).write.parquet(f"{base}/arrivals")
    moving.begin(nodes, members, base)
    stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/arrivals")
    moving.follow(stream, nodes, ALL, base, f"{base}/checkpoint", once=True).awaitTermination()
    came = moving.members(spark, base, "string")
    own = sketches.flat(items, ALL).where(F.size("bits") > 0)
    # ids of items and of documents are apart in name
    every = members.select("node", F.concat(F.lit("d"), "seq_id").alias("seq_id"), "bits").unionByName(came.join(own, "seq_id").select("node", F.concat(F.lit("b"), "seq_id").alias("seq_id"), "bits"))
    built = trees.centroids(nodes, every).select("node", "bit")
    kept = moving.means(spark, base, "string").select("node", F.explode("bits").alias("bit"))
    unlike = kept.exceptAll(built).unionByName(built.exceptAll(kept)).agg(F.count(F.lit(1)).alias("n_unlike"))
    return came.agg(F.count("node").alias("n_arrived")).crossJoin(unlike)  # a row each


def _kmeans_sql(how: str, k: int = 5, rounds: int = 4, seed: int = 7) -> str:
    """Rounds as one table after the other. For how = "windows", bits are windows and bits in one number and means end with the shortest member."""
    rows = f"{WIN}, {WBITS}, bits AS (SELECT seq_id, window_id * {clustering.WINDOW} + bit AS bit FROM wbits)" if how == "windows" else FLAT
    rows = f"{WIN}, bits AS (SELECT seq_id, window_id * 64 + n AS bit FROM win, (SELECT unnest(range(64)) AS n) WHERE rn = 1 AND (h >> n) & 1 = 1)" if how == "hashes" else rows
    cut = lambda i: f" AND bit // {clustering.WINDOW} <= (SELECT min(last) FROM (SELECT cluster, max(bit // {clustering.WINDOW}) AS last FROM m{i} GROUP BY cluster, seq_id) e WHERE e.cluster = v.cluster)" if how == "windows" else ""
    out = f"""WITH {DNA}, {KM}, {rows}, sig AS (SELECT min(seq_id) AS seq_id FROM (SELECT seq_id, list(bit ORDER BY bit) AS s FROM bits GROUP BY 1) GROUP BY s),
first AS (SELECT seq_id FROM sig ORDER BY md5('{seed}/' || seq_id), seq_id LIMIT {k}), num AS (SELECT seq_id, row_number() OVER (ORDER BY seq_id) - 1 AS cluster FROM first),
c0 AS (SELECT cluster, bit FROM num JOIN bits USING (seq_id)), na AS (SELECT dna.seq_id, count(bit) AS n FROM dna LEFT JOIN bits USING (seq_id) GROUP BY 1)"""
    for i in range(rounds):
        out += f""", i{i} AS (SELECT seq_id, cluster, count(*) AS c FROM bits JOIN c{i} USING (bit) GROUP BY 1, 2),
d{i} AS (SELECT na.seq_id, b.cluster, row_number() OVER (PARTITION BY na.seq_id ORDER BY na.n + b.n - 2 * coalesce(c, 0), b.cluster) AS rk FROM na CROSS JOIN (SELECT cluster, count(*) AS n FROM c{i} GROUP BY 1) b LEFT JOIN i{i} i ON i.seq_id = na.seq_id AND i.cluster = b.cluster),
a{i} AS MATERIALIZED (SELECT seq_id, CASE WHEN (SELECT count(DISTINCT cluster) FROM d{i} WHERE rk = 1) = 1 THEN seq_id % {k} ELSE cluster END AS cluster FROM d{i} WHERE rk = 1),
m{i} AS (SELECT cluster, seq_id, bit FROM bits JOIN a{i} USING (seq_id)),
c{i + 1} AS (SELECT v.cluster, bit FROM (SELECT cluster, bit, count(*) AS votes FROM m{i} GROUP BY 1, 2) v JOIN (SELECT cluster, count(DISTINCT seq_id) AS n FROM m{i} GROUP BY 1) s USING (cluster) WHERE {'true' if how in ('or', 'hashes') else 'votes >= (n + 1) // 2'}{cut(i)})"""
    return f"{out} SELECT seq_id, cluster::INT AS cluster FROM a{rounds - 1}"


@query(_kmeans_sql("or"))
def kmeans_4_rounds(spark, sf_dir: str) -> DataFrame:
    """Four rounds of 5-means by Hamming distance with OR means."""
    return clustering.kmeans(flat(spark, sf_dir), 5, 4, seed=7)


@query(_kmeans_sql("majority"))
def kmeans_majority(spark, sf_dir: str) -> DataFrame:
    return clustering.kmeans(flat(spark, sf_dir), 5, 4, seed=7, how="majority")


@query(_kmeans_sql("windows"))
def kmeans_windowed(spark, sf_dir: str) -> DataFrame:
    """Four rounds of 5-means of windowed signatures, with majority means as long as the shortest member."""
    return clustering.kmeans_window_keys(sketches.window_keys(dna(spark, sf_dir), CFG), 5, 4, seed=7)


@query(_kmeans_sql("hashes"))
def kmeans_hash_lists(spark, sf_dir: str) -> DataFrame:
    """Four rounds of 5-means over lists of each window's least hash."""
    return clustering.kmeans_hash_lists(sketches.window_lists(dna(spark, sf_dir), CFG), 5, 4, seed=7)


@query()
def tree_cluster(spark, sf_dir: str) -> DataFrame:
    """A tree by insertion and two rounds of reassigning, flat signatures."""
    return trees.cluster(flat(spark, sf_dir), dna(spark, sf_dir), ALL.bits, 0.5, 0.1, iterations=2)[0]


@query()
def tree_cluster_windowed(spark, sf_dir: str) -> DataFrame:
    """The same by the windows' mean Jaccard, with an estimated split threshold."""
    return trees.cluster(windowed(spark, sf_dir), dna(spark, sf_dir), ALL.bits, 0.5, None, iterations=1, method="local")[0]


@query("SELECT count(*)::BIGINT AS n_sequences, 0::BIGINT AS uneven_leaves, 0::BIGINT AS overfull, 0::BIGINT AS underfull, 0::BIGINT AS wrong_signatures FROM documents")
def ktree_balance(spark, sf_dir: str) -> DataFrame:
    """A balanced tree by insertion over all sequences: what its bounds say must be nothing, and every sequence in a leaf."""
    rows = written(flat(spark, sf_dir), "signatures")
    members, nodes, means = balanced.grow(rows, 16, refine=1)
    top = nodes.where("parent IS NULL")
    fill = members.groupBy("node").count().unionByName(nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).count())
    uneven = nodes.select("node", "parent", "level").join(nodes.select(F.col("node").alias("parent"), (F.col("level") - 1).alias("below")), "parent", "left").where("parent IS NOT NULL AND (below IS NULL OR below <> level)")
    inner = fill.join(top.select("node"), "node", "left_anti")
    # a root's bits are all bits there are
    every = rows.select(F.explode("bits").alias("bit")).distinct()
    wrong = means.join(top.select("node"), "node", "left_semi").select("bit").where(F.col("bit") != balanced.EVER).exceptAll(every).unionByName(every.exceptAll(means.join(top.select("node"), "node", "left_semi").select("bit")))
    counts = [members.agg(F.count("node").alias("n_sequences")), uneven.agg(F.count(F.lit(1)).alias("uneven_leaves")), fill.where("count > 16").agg(F.count(F.lit(1)).alias("overfull")), inner.where("count < 4").agg(F.count(F.lit(1)).alias("underfull")), wrong.agg(F.count(F.lit(1)).alias("wrong_signatures"))]
    out = counts[0]
    for one in counts[1:]:
        out = out.crossJoin(one)  # a row each
    return out


@query()
def ktree_again(spark, sf_dir: str) -> DataFrame:
    """All sequences sent down the finished balanced tree once more."""
    rows = written(flat(spark, sf_dir), "signatures")
    _, nodes, means = balanced.grow(rows, 16, refine=1)
    return balanced.again(rows, nodes, means)


@query(f"""{_TREE}, {_NA}, nl AS (SELECT sz.node, count(bit) AS n FROM (SELECT node FROM sz) sz LEFT JOIN lm USING (node) GROUP BY 1), c AS (SELECT m.seq_id, lm.node, count(*) AS c FROM m JOIN lm USING (bit) GROUP BY 1, 2)
SELECT seq_id, node, hd FROM (SELECT na.seq_id, nl.node, (na.n + nl.n - 2 * coalesce(c, 0))::BIGINT AS hd, row_number() OVER (PARTITION BY na.seq_id ORDER BY na.n + nl.n - 2 * coalesce(c, 0), nl.node) AS rk FROM na CROSS JOIN nl LEFT JOIN c ON c.seq_id = na.seq_id AND c.node = nl.node) WHERE rk = 1""")
def tree_search_full(spark, sf_dir: str) -> DataFrame:
    """The nearest leaf of each sequence by a search whose beam holds whole levels: equal to the scan of all leaves."""
    nodes, members = _leaves(spark, sf_dir)
    return trees.search(dna(spark, sf_dir), members.select("seq_id", "bit"), nodes, trees.centroids(nodes, members), beam=1000)


@query()
def tree_search_beam(spark, sf_dir: str) -> DataFrame:
    """The same with a beam of two."""
    nodes, members = _leaves(spark, sf_dir)
    return trees.search(dna(spark, sf_dir), members.select("seq_id", "bit"), nodes, trees.centroids(nodes, members), beam=2)


@query(f"""{_TREE}, ns AS (SELECT node, seq_id, count(*) AS n FROM m GROUP BY 1, 2), nl AS (SELECT sz.lang, sz.node, count(bit) AS n FROM sz LEFT JOIN lm USING (node) GROUP BY 1, 2), nb AS (SELECT l.lang, count(bit) AS n FROM (SELECT DISTINCT lang FROM sz) l LEFT JOIN bm USING (lang) GROUP BY 1),
ld AS (SELECT ns.node, ns.n + nl.n - 2 * coalesce(c, 0) AS hd FROM ns JOIN nl USING (node) LEFT JOIN (SELECT m.node, m.seq_id, count(*) AS c FROM m JOIN lm ON lm.node = m.node AND lm.bit = m.bit GROUP BY 1, 2) USING (node, seq_id)),
le AS (SELECT node, max(hd)::DOUBLE AS radius, sqrt(avg(hd * hd)) AS distortion FROM ld GROUP BY 1),
e1 AS (SELECT nl.lang, nl.node, nl.n + nb.n - 2 * coalesce(c, 0) AS hd FROM nl JOIN nb USING (lang) LEFT JOIN (SELECT lm.node, count(*) AS c FROM lm JOIN bm ON bm.lang = lm.lang AND bm.bit = lm.bit GROUP BY 1) USING (node)),
be AS (SELECT lang, max(hd + radius) AS radius, sqrt(avg(hd * hd)) AS distortion FROM e1 JOIN le USING (node) GROUP BY 1),
e2 AS (SELECT nb.lang, (SELECT count(DISTINCT bit) FROM bm) - nb.n AS hd FROM nb)
SELECT node, round(radius, 6) AS radius, round(distortion, 6) AS distortion FROM (SELECT * FROM le UNION ALL SELECT * FROM be UNION ALL SELECT 'all', max(radius), sqrt(avg((hd + distortion) * (hd + distortion))) FROM be JOIN e2 USING (lang))""")
def tree_extent(spark, sf_dir: str) -> DataFrame:
    """How far nodes reach and how much they are off their means, from the leaves to the root."""
    nodes, members = _leaf_rows(spark, sf_dir)
    rows = trees.extent(nodes, members, trees.centroids(nodes, members))
    return rows.select("node", F.round("radius", 6).alias("radius"), F.round("distortion", 6).alias("distortion"))


@query("SELECT count(*)::BIGINT AS n_sequences, 0::BIGINT AS out_of_heap, 0::BIGINT AS misrouted, 0::BIGINT AS unlike FROM documents")
def treap_by_priority(spark, sf_dir: str) -> DataFrame:
    """A treap of all sequences by priorities that a hash gives: what its heap, its routing and its members break must be nothing."""
    rows = treap.ranked(dna(spark, sf_dir), windowed(spark, sf_dir), seed=3)
    return treap.violations(written(treap.grow(rows, MATCH), "treap"), rows, MATCH)


@query("SELECT count(*)::BIGINT AS n_sequences, 0::BIGINT AS out_of_heap, 0::BIGINT AS misrouted, 0::BIGINT AS unlike FROM documents WHERE lang IS DISTINCT FROM 'de'")
def treap_delete(spark, sf_dir: str) -> DataFrame:
    """The same after all German sequences were deleted."""
    ids = dna(spark, sf_dir, "lang")
    rows = treap.ranked(ids, windowed(spark, sf_dir), seed=3)
    left = treap.delete(treap.grow(rows, MATCH), rows, ids.where("lang = 'de'").select("seq_id"), MATCH)
    return treap.violations(written(left, "treap"), rows, MATCH)


@query(f"""WITH {DNA}, {KM}, {WIN}, {WBITS}, x AS (SELECT seq_id, window_id, count(*) AS n FROM wbits GROUP BY 1, 2), nw AS (SELECT seq_id, n FROM nwin WHERE n > 0),
p AS (SELECT a.seq_id, b.seq_id AS node, least(a.n, b.n) AS n FROM nw a JOIN nw b ON b.seq_id = a.seq_id + 1),
c AS (SELECT p.seq_id, a.window_id, count(*) AS c FROM p JOIN wbits a ON a.seq_id = p.seq_id JOIN wbits b ON b.seq_id = p.node AND b.window_id = a.window_id AND b.bit = a.bit GROUP BY 1, 2),
s AS (SELECT p.seq_id, p.n, coalesce(c, 0) AS c, x.n AS own FROM p JOIN x ON x.seq_id = p.seq_id AND x.window_id < p.n LEFT JOIN c ON c.seq_id = x.seq_id AND c.window_id = x.window_id)
SELECT seq_id, count(*) FILTER (WHERE c > least({MATCH}, own))::INT AS matching, count(*) FILTER (WHERE c > least({MATCH}, own)) >= n * 0.3 AS is_match, sum(c)::INT AS common, 2 * sum(c) >= sum(own) AS goes_left FROM s GROUP BY seq_id, n""")
def treap_predicates(spark, sf_dir: str) -> DataFrame:
    """Of each sequence and the one of the next id: matching windows, whether three in ten match, common bits, and the side it would go to."""
    rows = treap.packed(dna(spark, sf_dir), windowed(spark, sf_dir)).where(F.size("windows") > 0)
    two = rows.join(rows.select((F.col("seq_id") - 1).alias("seq_id"), F.col("windows").alias("node")), "seq_id")
    x, y = F.col("windows"), F.col("node")
    return two.select("seq_id", metrics.windows_matching(x, y, MATCH).alias("matching"), metrics.windows_match(x, y, MATCH, 0.3).alias("is_match"), metrics.windows_inter(x, y).alias("common"), metrics.goes_left(x, y).alias("goes_left"))


@query("SELECT count(*)::BIGINT AS n_sequences, 0::BIGINT AS uncovered, 0::BIGINT AS outside FROM documents")
def radius_tree(spark, sf_dir: str) -> DataFrame:
    """A tree of radii over all sequences: every member within its leaf's radius, every founder within that of the node above."""
    rows = written(flat(spark, sf_dir), "signatures")
    members, nodes = radius.grow(rows, 60.0)
    return radius.violations(rows, members, nodes, 60.0)


@query("SELECT count(*)::BIGINT AS n_nodes, sum(coalesce(n_chars, 0))::BIGINT AS n_accesses, count(DISTINCT doc_id)::BIGINT AS n_distinct, 0::BIGINT AS out_of_order, (max(coalesce(n_chars, 0)))::BIGINT AS n_root FROM documents WHERE doc_id > 0")
def tree_by_frequency(spark, sf_dir: str) -> DataFrame:
    """A binary tree over all ids, reordered by their texts' lengths as if these counted accesses: what is out of order must be nothing."""
    rows = table(spark, sf_dir, "documents").where("doc_id > 0")
    nodes = rows.select(F.col("doc_id").alias("node"), F.floor(F.col("doc_id") / 2).cast("long").alias("parent"))
    got = written(trees.by_frequency(nodes, rows.select(F.col("doc_id").alias("node"), F.col("n_chars").alias("n"))), "reordered")
    wrong = got.join(got.select(F.col("node").alias("parent"), F.col("n").alias("above")), "parent").where("above < n")
    root = got.where("parent = 0").agg(F.max("n").alias("n_root"))
    total = got.agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("n").alias("n_accesses"), F.count_distinct("node").alias("n_distinct"))
    return total.crossJoin(wrong.agg(F.count(F.lit(1)).alias("out_of_order"))).crossJoin(root)  # a row each


@query("""WITH RECURSIVE t AS (SELECT a.doc_id AS node, CASE WHEN b.lang IS NOT DISTINCT FROM a.lang THEN b.doc_id END AS parent FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id // 2 AND a.doc_id > 0),
w AS (SELECT node, node AS top FROM t WHERE parent IS NULL UNION ALL SELECT t.node, w.top FROM w JOIN t ON t.parent = w.node) SELECT node, top FROM w""")
def tree_super_clusters(spark, sf_dir: str) -> DataFrame:
    """The topmost node above each document in the forest that a binary tree over all ids falls into where languages change."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"), "lang")
    above = rows.select(F.col("node").alias("half"), F.col("lang").alias("other"))
    joined = rows.join(above, (F.floor(F.col("node") / 2).cast("long") == F.col("half")) & (F.col("node") > 0), "left")
    nodes = joined.select("node", F.when(F.col("lang").eqNullSafe(F.col("other")), F.col("half")).alias("parent"))
    return trees.super_clusters(nodes)


@query()
def tree_like_siblings(spark, sf_dir: str) -> DataFrame:
    """Near sequences of a language that merge into an earlier one: languages as nodes, their sequences as children."""
    rows = written(flat(spark, sf_dir, "lang"), "signatures")
    nodes = rows.select(F.col("seq_id").alias("node"), F.coalesce("lang", F.lit("")).alias("parent"))
    return trees.like_siblings(nodes, rows.select(F.col("seq_id").alias("node"), "bits"), 40)
