"""Statistics of similarities, centroids of signatures, and quality of clusters of points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import metrics
from ..sources.storage import written

#: Fixed value: half the width of a normal distribution's middle half, in deviations.
QUARTILE = 0.675


def histogram(spark, pairs: DataFrame, n_zero=None) -> DataFrame:
    """(bin, count) of similarities 0..1 in tenths of 100; 100 is a bin of its own, empty bins are 0. n_zero: pairs not in the table."""
    tenth = F.floor(F.col("similarity") * 100 / 10 + 1e-9).cast("int") * 10
    found = pairs.groupBy(tenth.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    if n_zero is not None:
        found = found.unionByName(n_zero.select(F.lit(0).alias("bin"), F.col("n").alias("count"))).groupBy("bin").agg(F.sum("count").alias("count"))
    bins = spark.range(11).select((F.col("id") * 10).cast("int").alias("bin"))
    return bins.join(found, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def spread(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """mean, stdev (population), q1 and q3 (mean less and plus 0.675 deviations: a normal's, not order statistics)."""
    out = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("stdev"))
    return out.withColumns({"q1": F.col("mean") - QUARTILE * F.col("stdev"), "q3": F.col("mean") + QUARTILE * F.col("stdev")})


def sampled(ids: DataFrame, size: int, runs: int) -> DataFrame:
    """(run, seq_id): for each run the `size` ids that come first by a hash of run and id."""
    runs_ = ids.select(F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), "seq_id")
    first = F.row_number().over(Window.partitionBy("run").orderBy(F.md5(F.concat_ws("/", "run", "seq_id")), "seq_id"))
    return runs_.withColumn("rank", first).where(F.col("rank") <= size).drop("rank")


def sampled_pairs(signatures: DataFrame, size: int, runs: int) -> DataFrame:
    """(run, i, j, similarity in per cent) of all pairs of each run's sample; at most size squared a run."""
    chosen = sampled(signatures.select("seq_id"), size, runs).join(signatures, "seq_id")
    a = chosen.select("run", F.col("seq_id").alias("i"), F.col("bits").alias("x"))
    b = chosen.select("run", F.col("seq_id").alias("j"), F.col("bits").alias("y"))
    return a.join(b, "run").where("i < j").select("run", "i", "j", (100 * F.coalesce(metrics.array_jaccard(F.col("x"), F.col("y")), F.lit(0.0))).alias("similarity"))


def mean_signature(members: DataFrame, how: str = "majority", *by: str) -> DataFrame:
    """(group, bit). members: (group, seq_id, bit), and window_id among `by` for windowed ones; all of a group's members count.

    majority: at least (n + 1) div 2 members have the bit; strict: more than half; or: any; and: all.
    Members may be (group, seq_id, bits), a row each, too; then nothing but votes and sizes is shuffled.
    """
    groups = [c for c in by if c != "window_id"]
    if "bits" in members.columns:
        sizes = members.where(F.size("bits") > 0).groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
        members = members.select(*by, F.explode("bits").alias("bit"))
    else:
        sizes = members.select(*groups, "seq_id").distinct().groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    votes = members.groupBy(*by, "bit").agg(F.count(F.lit(1)).alias("votes")).join(sizes, groups)
    rule = {
        "majority": F.col("votes") >= F.floor((F.col("n") + 1) / 2),
        "strict": 2 * F.col("votes") > F.col("n"),
        "or": F.lit(True),
        "and": F.col("votes") == F.col("n"),
    }[how]
    return votes.where(rule).select(*by, "bit")


def to_centroid(members: DataFrame, centroids: DataFrame, group: str) -> DataFrame:
    """(group, seq_id, inter, na, nb): each member against its group's mean. Members: (group, seq_id, bit), or (group, seq_id, bits), a row each.

    In arrays a member meets its group's mean in one row, instead of one a bit; those without bits are left out in both forms.
    """
    if "bits" in members.columns:
        means = written(centroids.groupBy(group).agg(F.collect_list("bit").alias("mean")), "mean-lists")
        met = members.where(F.size("bits") > 0).join(means, group, "left").withColumn("mean", F.coalesce("mean", F.array().cast(dict(means.dtypes)["mean"])))
        count = lambda c: F.size(c).cast("long")
        return met.select(group, "seq_id", count(F.array_intersect("bits", "mean")).alias("inter"), count("bits").alias("na"), count("mean").alias("nb"))
    na = members.groupBy(group, "seq_id").agg(F.count(F.lit(1)).alias("na"))
    nb = centroids.groupBy(group).agg(F.count(F.lit(1)).alias("nb"))
    inter = members.join(centroids, [group, "bit"]).groupBy(group, "seq_id").agg(F.count(F.lit(1)).alias("inter"))
    return na.join(nb, group, "left").join(inter, [group, "seq_id"], "left").fillna(0, ["nb", "inter"])


def priority(members: DataFrame, group: str) -> DataFrame:
    """(group, priority): members' mean Jaccard to the majority mean; 0 where there is one member or none."""
    rows = to_centroid(members, mean_signature(members, "majority", group), group)
    out = rows.groupBy(group).agg(F.avg(metrics.jaccard(F.col("na"), F.col("nb"), F.col("inter"))).alias("p"), F.count(F.lit(1)).alias("n"))
    return out.select(group, F.when(F.col("n") > 1, F.coalesce("p", F.lit(0.0))).otherwise(0.0).alias("priority"))


def centroid_distances(ids: DataFrame, members: DataFrame, centroids: DataFrame) -> DataFrame:
    """(seq_id, cluster, hd) of every sequence to each centroid that it shares a bit with, and to the one of fewest bits.

    ids: (seq_id), sequences without bits too; members: (seq_id, bit); centroids: (cluster, bit). A distance is na + nb - 2 * inter, so
    of centroids without a common bit only that of fewest bits (ties to the smaller) can be nearest: no product is formed.
    """
    na = members.groupBy("seq_id").agg(F.count(F.lit(1)).alias("na"))
    na = ids.select("seq_id").join(na, "seq_id", "left").fillna(0, ["na"])
    nb = centroids.groupBy("cluster").agg(F.count(F.lit(1)).alias("nb"))
    inter = members.join(centroids, "bit").groupBy("seq_id", "cluster").agg(F.count(F.lit(1)).alias("inter"))
    met = inter.join(na, "seq_id").join(nb, "cluster").select("seq_id", "cluster", metrics.hamming(F.col("na"), F.col("nb"), F.col("inter")).alias("hd"))
    least = nb.agg(F.min(F.struct("nb", "cluster")).alias("x")).select("x.cluster", "x.nb")
    apart = na.join(F.broadcast(least)).join(inter.select("seq_id", "cluster"), ["seq_id", "cluster"], "left_anti")
    return met.unionByName(apart.select("seq_id", "cluster", (F.col("na") + F.col("nb")).alias("hd")))


def nearest_cluster(distances: DataFrame, value: str = "hd") -> DataFrame:
    """(seq_id, cluster, value): the least distance, ties to the smaller cluster."""
    best = F.min(F.struct(value, "cluster")).alias("best")
    return distances.groupBy("seq_id").agg(best).select("seq_id", "best.cluster", f"best.{value}")


def point_centroids(points: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centre): mean of each component."""
    long = points.select(group, F.posexplode(vector).alias("at", "x"))
    means = long.groupBy(group, "at").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda s: s["m"]).alias("centre"))


def nearest_centre(points: DataFrame, centres: DataFrame, key: str, vector: str, digits: int = 9) -> DataFrame:
    """(key, cluster, d): each point's nearest centre (Euclidean, rounded to `digits`), ties to the smaller cluster. centres: (cluster, centre), any number.

    A point meets centres a block at a time, as an array in its row, and hands on the best of each block. Points without a vector
    have distance null and the smallest cluster; where there are no centres, there are no rows.
    """
    from .facing import facing

    met = facing(points.select(key, vector), F.col(key), centres.select("cluster", "centre"), "cluster")
    far = lambda c: F.round(metrics.euclidean(F.col(vector), c), digits)
    best = F.array_min(F.transform("block", lambda c: F.struct(far(c["centre"]).alias("d"), c["cluster"].alias("cluster"))))
    return met.select(key, best.alias("x")).groupBy(key).agg(F.min("x").alias("x")).select(key, "x.cluster", "x.d")


def point_spread(points: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centre, rms, n): root mean square distance to the centre, 0 for one point."""
    joined = points.join(point_centroids(points, group, vector), group)
    d = metrics.euclidean(F.col(vector), F.col("centre"))
    out = joined.withColumn("d", d).groupBy(group).agg(F.first("centre").alias("centre"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("rms", F.when(F.col("n") > 1, F.col("rms")).otherwise(0.0))


def davies_bouldin(spread_: DataFrame, group: str) -> DataFrame:
    """One number: the mean over clusters of the worst (rms_i + rms_j) / distance of centres. Few clusters."""
    a = spread_.select(F.col(group).alias("i"), F.col("centre").alias("ci"), F.col("rms").alias("ri"))
    b = spread_.select(F.col(group).alias("j"), F.col("centre").alias("cj"), F.col("rms").alias("rj"))
    pairs = a.join(b, F.col("i") != F.col("j")).select("i", F.try_divide(F.col("ri") + F.col("rj"), metrics.euclidean(F.col("ci"), F.col("cj"))).alias("r"))
    return pairs.groupBy("i").agg(F.max("r").alias("worst")).agg(F.avg("worst").alias("davies_bouldin"))


def node_distances(members: DataFrame) -> DataFrame:
    """(seq_id, cluster, hd): each member's Hamming distance to its cluster's majority mean. Members: (cluster, seq_id, bit)."""
    rows = to_centroid(members, mean_signature(members, "majority", "cluster"), "cluster")
    return rows.select("seq_id", "cluster", metrics.hamming(F.col("na"), F.col("nb"), F.col("inter")).alias("hd"))


def farthest(members: DataFrame, group: str) -> DataFrame:
    """(group, hd, seq_id): the member at the greatest Hamming distance from the mean, ties to the smaller id."""
    rows = node_distances(members.withColumnRenamed(group, "cluster"))
    best = F.min(F.struct((-F.col("hd")).alias("near"), "seq_id")).alias("x")
    return rows.groupBy(F.col("cluster").alias(group)).agg(best).select(group, (-F.col("x.near")).alias("hd"), "x.seq_id")


def davies_bouldin_hamming(members: DataFrame, group: str) -> DataFrame:
    """One number: the mean over clusters of the worst (deviation_i + deviation_j) / Hamming distance of their majority means."""
    means = mean_signature(members, "majority", group)
    sizes = means.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    rows = to_centroid(members, means, group)
    hd = metrics.hamming(F.col("na"), F.col("nb"), F.col("inter")).cast("double")
    deviation = rows.groupBy(group).agg(F.sqrt(F.avg(hd * hd)).alias("deviation")).join(sizes, group)
    a, b = (deviation.select(F.col(group).alias(x), F.col("deviation").alias(f"d{x}"), F.col("n").alias(f"n{x}")) for x in ("i", "j"))
    inter = means.select(F.col(group).alias("i"), "bit").join(means.select(F.col(group).alias("j"), "bit"), "bit").groupBy("i", "j").agg(F.count(F.lit(1)).alias("inter"))
    both = a.join(b, F.col("i") != F.col("j")).join(inter, ["i", "j"], "left").fillna(0, ["inter"])
    worst = both.groupBy("i").agg(F.max(F.try_divide(F.col("di") + F.col("dj"), metrics.hamming(F.col("ni"), F.col("nj"), F.col("inter")).cast("double"))).alias("worst"))
    return worst.agg(F.avg("worst").alias("davies_bouldin"))
