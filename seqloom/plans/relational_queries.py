"""Joins, unions, windows and checks over result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .base import DNA, query, table
from .cluster_queries import _EDGES
from .pair_queries import sim_filtered_inverted
from ..operators import evaluate
from ..sources.storage import written


@query("SELECT source, lang, count(*)::BIGINT AS documents, count(l.doc_id)::BIGINT AS labelled, round(coalesce(avg(quality), 0), 6) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1, 2")
def join_truth_left(spark, sf_dir: str) -> DataFrame:
    """Documents joined to the truth about them, where there is any."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("of"), "quality")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(labels, F.col("doc_id") == F.col("of"), "left")
    return rows.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("documents"), F.count("of").alias("labelled"), F.round(F.coalesce(F.avg("quality"), F.lit(0.0)), 6).alias("quality"))


@query("WITH h AS (SELECT doc_id // 26 AS parent, doc_id AS child, (doc_id % 3)::INT AS rank FROM documents) SELECT parent, child, CASE WHEN rank = 0 AND parent = 0 AND child NOT IN (SELECT parent FROM h) THEN -1 ELSE rank END::INT AS rank FROM h")
def hierarchy_repair(spark, sf_dir: str) -> DataFrame:
    """Groups of 26 as parents, repaired where a root is no one's parent."""
    i = F.col("doc_id")
    return evaluate.repaired(table(spark, sf_dir, "documents").select(F.floor(i / 26).cast("long").alias("parent"), i.alias("child"), F.pmod(i, F.lit(3)).cast("int").alias("rank")))


@query("SELECT tag, count(*)::BIGINT AS n, count(DISTINCT id)::BIGINT AS ids FROM (SELECT 'document' AS tag, doc_id AS id FROM documents UNION ALL SELECT 'page', page_id FROM pages UNION ALL SELECT 'item', item_id FROM benchmark UNION ALL SELECT 'turn', conv_id FROM conversations) GROUP BY 1")
def tagged_union(spark, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.lit(tag).alias("tag"), F.col(c).alias("id")) for tag, t, c in (("document", "documents", "doc_id"), ("page", "pages", "page_id"), ("item", "benchmark", "item_id"), ("turn", "conversations", "conv_id"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount < 0.03")
def range_filters(spark, sf_dir: str) -> DataFrame:
    """Both ranges reach the scan."""
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_quantity").between(10, 12) & (F.col("l_discount") < 0.03))
    return rows.select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT doc_id AS i, (doc_id // 26)::BIGINT AS grp, doc_id % 26 = 0 AS is_seed FROM documents")
def group_index(spark, sf_dir: str) -> DataFrame:
    """Generated groups of 26, and their seeds."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(i.alias("i"), F.floor(i / 26).cast("long").alias("grp"), (F.pmod(i, F.lit(26)) == 0).alias("is_seed"))


@query("SELECT lang, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.75) AS q3, round(stddev_samp(n_chars), 6) AS sd, round(avg(n_chars), 6) AS mean FROM documents GROUP BY 1")
def summaries(spark, sf_dir: str) -> DataFrame:
    """Quantiles, sample deviation and mean by group."""
    q = lambda p: F.percentile("n_chars", F.lit(p))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.round(F.stddev_samp("n_chars"), 6).alias("sd"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query("SELECT round(avg(quality), 9) AS quality, round(avg(toxic), 9) AS toxic FROM labels")
def column_means(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("quality", "toxic")
    return rows.agg(*[F.round(F.avg(c), 9).alias(c) for c in rows.columns])


@query("SELECT event_type, round(avg(value), 6) AS mean, count(*)::BIGINT AS n FROM events GROUP BY 1")
def mean_by_run(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("SELECT max(s_acctbal) AS highest FROM supplier WHERE s_name NOT LIKE '%7%'")
def filtered_maximum(spark, sf_dir: str) -> DataFrame:
    """The maximum of rows whose name lacks a substring."""
    return table(spark, sf_dir, "supplier").where(~F.col("s_name").contains("7")).agg(F.max("s_acctbal").alias("highest"))


@query("WITH s AS (SELECT avg(n_chars) AS m, stddev_samp(n_chars) AS d, min(n_chars) AS lo, max(n_chars) AS hi, sum(n_chars) AS t FROM documents) SELECT doc_id, round((n_chars - m) / d, 6) AS z, round((n_chars - lo) / (hi - lo)::DOUBLE, 6) AS scaled, round(n_chars / t::DOUBLE, 9) AS share FROM documents, s")
def standardised(spark, sf_dir: str) -> DataFrame:
    """Column as z-scores, on 0..1, and as shares of its sum; the statistics are one row, joined to all."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    s = d.agg(F.avg("n_chars").alias("m"), F.stddev_samp("n_chars").alias("d"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"), F.sum("n_chars").alias("t"))
    x = F.col("n_chars")
    return d.join(F.broadcast(s)).select("doc_id", F.round((x - F.col("m")) / F.col("d"), 6).alias("z"), F.round((x - F.col("lo")) / (F.col("hi") - F.col("lo")), 6).alias("scaled"), F.round(x / F.col("t"), 9).alias("share"))


@query(f"{_EDGES} SELECT i, j, similarity FROM e UNION ALL SELECT j, i, similarity FROM e")
def mirrored_edges(spark, sf_dir: str) -> DataFrame:
    e = written(sim_filtered_inverted(spark, sf_dir), "edges")
    return e.unionByName(e.select(F.col("j").alias("i"), F.col("i").alias("j"), "similarity"))


@query(f"{_EDGES}, n AS (SELECT i, count(*) AS n FROM e GROUP BY 1) SELECT count(*)::BIGINT AS ids, sum(n)::BIGINT AS edges, (sum(n) = (SELECT count(*) FROM e)) AS complete FROM n")
def edge_checks(spark, sf_dir: str) -> DataFrame:
    """Edges by id add up to all edges."""
    e = written(sim_filtered_inverted(spark, sf_dir), "edges")
    n = e.groupBy("i").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("ids"), F.sum("n").alias("edges"))
    return n.join(e.agg(F.count(F.lit(1)).alias("total"))).select("ids", "edges", (F.col("edges") == F.col("total")).alias("complete"))


@query("SELECT doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)")
def unlabelled(spark, sf_dir: str) -> DataFrame:
    """Ids of one set that another lacks."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").distinct()


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rk FROM documents) WHERE rk = 1")
def best_of_group(spark, sf_dir: str) -> DataFrame:
    """The longest of each group, ties to the smaller id."""
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("least"), "doc_id")).alias("b")
    return table(spark, sf_dir, "documents").groupBy("source").agg(best).select("source", "b.doc_id", "b.n_chars")


@query("SELECT doc_id, (row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1)::BIGINT AS id FROM documents")
def ranked(spark, sf_dir: str) -> DataFrame:
    """All rows numbered by a total order: a range sort, then numbers by partition start, so no task sees all rows."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    n = rows.rdd.getNumPartitions()
    bounded = rows.repartitionByRange(max(2, n), F.desc("n_chars"), "doc_id").withColumn("part", F.spark_partition_id())
    bounded = written(bounded, "ranked")
    sizes = bounded.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("n_chars"), "doc_id")) - 1
    return bounded.withColumn("at", within).join(sizes.select("part", before.alias("start")), "part").select("doc_id", (F.col("start") + F.col("at")).cast("long").alias("id"))


@query(f"WITH {DNA} SELECT regexp_extract(source, '([0-9]+)', 1)::INT AS k, count(*)::BIGINT AS n, sum(length(seq))::BIGINT AS bases FROM dna GROUP BY 1")
def number_from_name(spark, sf_dir: str) -> DataFrame:
    """A parameter read out of a name."""
    from .base import dna

    rows = dna(spark, sf_dir, "source").select(F.regexp_extract("source", "([0-9]+)", 1).cast("int").alias("k"), F.length("seq").alias("bases"))
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("bases").cast("long").alias("bases"))
