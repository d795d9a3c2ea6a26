"""Trees of clusters as tables: nodes (node, parent), members (node, seq_id, bit) and signatures of nodes (node, bit).

A node is a leaf if no other names it as its parent; a root's own parent isn't a node. Everything goes level by level, by
joins, and each level is written, so a tree may have any number of nodes. `cluster` grows its tree in batches (leader.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import metrics
from ..sources.sinks import tree_levels
from ..sources.storage import written
from . import aggregates, block_pairs, leader, windowed


def leaves(nodes: DataFrame) -> DataFrame:
    """(node) of nodes that are no other's parent."""
    return nodes.select("node").join(nodes.select(F.col("parent").alias("node")), "node", "left_anti")


def ambiguous(nodes: DataFrame, members: DataFrame, singleton: int = 1) -> DataFrame:
    """(node) of leaves of `singleton` members at most. members: (node, seq_id)."""
    sizes = members.groupBy("node").agg(F.count_distinct("seq_id").alias("n"))
    return leaves(nodes).join(sizes, "node", "left").where(F.coalesce("n", F.lit(0)) <= singleton).select("node")


def centroids(nodes: DataFrame, members: DataFrame, singleton: int = 1) -> DataFrame:
    """(node, bit): a leaf's is the majority of its members, a branch's the majority of its children that aren't ambiguous, and a root's parent's the union of its children.

    A branch whose children are all ambiguous has no bits.
    """
    levels = written(tree_levels(nodes), "levels")
    at_ends = members.join(leaves(nodes), "node", "left_semi")
    found = written(aggregates.mean_signature(at_ends, "majority", "node"), "means")
    unsure = written(ambiguous(nodes, members, singleton), "ambiguous")
    deepest = levels.agg(F.max("level")).first()[0] or 0
    for level in range(deepest, 0, -1):
        children = levels.where(F.col("level") == level).select("node", "parent")
        if level > 1:
            children = children.join(unsure, "node", "left_anti")
        n = children.groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
        votes = children.join(found, "node").groupBy("parent", "bit").agg(F.count(F.lit(1)).alias("votes")).join(n, "parent")
        rule = F.col("votes") >= F.floor((F.col("n") + 1) / 2) if level > 1 else F.lit(True)
        found = found.unionByName(written(votes.where(rule).select(F.col("parent").alias("node"), "bit"), "means"))
    return found


def descend(ids: DataFrame, bits: DataFrame, nodes: DataFrame, means: DataFrame) -> DataFrame:
    """(seq_id, node, hd): from the roots down, always to the child at the least Hamming distance (ties to the smaller), as far as a leaf.

    Of children that share no bit with a sequence only the one of fewest bits can be nearest, so no product is formed.
    """
    nb = means.groupBy("node").agg(F.count(F.lit(1)).alias("nb"))
    inner = nodes.select(F.col("parent"), F.lit(True).alias("branch")).distinct()
    # roots hang from null
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    kids = nodes.join(nb, "node", "left").fillna(0, ["nb"]).join(known, "parent", "left")
    kids = written(kids.select("node", F.when(F.col("known"), F.col("parent")).alias("parent"), "nb"), "children")
    least = kids.groupBy("parent").agg(F.min(F.struct("nb", "node")).alias("x")).select("parent", "x.node", "x.nb")
    by_bit = kids.join(means, "node").select("parent", "node", "nb", "bit")
    na = bits.groupBy("seq_id").agg(F.count(F.lit(1)).alias("na"))
    state = ids.select("seq_id").join(na, "seq_id", "left").fillna(0, ["na"])
    state = state.withColumn("at", F.lit(None).cast(dict(nodes.dtypes)["node"]))
    out = None
    while True:
        own = state.join(bits, "seq_id")
        inter = own.join(by_bit, own["at"].eqNullSafe(by_bit["parent"]) & (own["bit"] == by_bit["bit"])).groupBy("seq_id", "na", "node", "nb").agg(F.count(F.lit(1)).alias("c"))
        met = inter.select("seq_id", "na", "node", metrics.hamming(F.col("na"), F.col("nb"), F.col("c")).alias("hd"))
        apart = state.join(least, state["at"].eqNullSafe(least["parent"])).join(inter.select("seq_id", "node"), ["seq_id", "node"], "left_anti")
        every = met.unionByName(apart.select("seq_id", "na", "node", (F.col("na") + F.col("nb")).alias("hd")))
        best = every.groupBy("seq_id", "na").agg(F.min(F.struct("hd", "node")).alias("x")).select("seq_id", "na", "x.node", "x.hd")
        best = written(best.join(inner.withColumnRenamed("parent", "node"), "node", "left"), "descent")
        done = best.where("branch IS NULL").select("seq_id", "node", "hd")
        out = done if out is None else out.unionByName(done)
        state = best.where("branch").select("seq_id", "na", F.col("node").alias("at"))
        if state.isEmpty():
            return out


def search(ids: DataFrame, bits: DataFrame, nodes: DataFrame, means: DataFrame, beam: int = 4) -> DataFrame:
    """(seq_id, node, hd): the nearest leaf (Hamming, ties to the smaller) that a search with look-ahead finds.

    At each level a sequence keeps the `beam` nearest of all children of the nodes it stands at. With a beam of all nodes of a level
    the search is exhaustive; with one it is `descend`.
    """
    nb = means.groupBy("node").agg(F.count(F.lit(1)).alias("nb"))
    inner = nodes.select(F.col("parent").alias("node"), F.lit(True).alias("branch")).distinct()
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    kids = nodes.join(nb, "node", "left").fillna(0, ["nb"]).join(known, "parent", "left").join(inner, "node", "left")
    kids = written(kids.select("node", F.when(F.col("known"), F.col("parent")).alias("parent"), "nb", F.coalesce("branch", F.lit(False)).alias("branch")), "children")
    # signatures as arrays, so that a sequence and a node meet in one row instead of one a bit
    own = written(bits.groupBy("seq_id").agg(F.collect_list("bit").alias("own")), "own")
    theirs = written(means.groupBy("node").agg(F.collect_list("bit").alias("theirs")), "theirs")
    state = ids.select("seq_id").join(own.select("seq_id", F.size("own").cast("long").alias("na")), "seq_id", "left").fillna(0, ["na"]).withColumn("at", F.lit(None).cast(dict(nodes.dtypes)["node"]))
    best = None
    while True:
        ahead = written(state.join(kids, state["at"].eqNullSafe(kids["parent"])).select("seq_id", "na", "node", "nb", "branch"), "ahead")
        met = ahead.join(own, "seq_id", "left").join(theirs, "node", "left")
        near = met.select(*ahead.columns, F.coalesce(F.size(F.array_intersect("own", "theirs")), F.lit(0)).cast("long").alias("c")).withColumn("hd", metrics.hamming(F.col("na"), F.col("nb"), F.greatest("c", F.lit(0))))
        rank = F.row_number().over(Window.partitionBy("seq_id").orderBy("hd", "node"))
        kept = written(near.withColumn("rank", rank).where(F.col("rank") <= beam).select("seq_id", "na", "node", "hd", "branch"), "beam")
        ends = kept.where("NOT branch").select("seq_id", "node", "hd")
        best = ends if best is None else best.unionByName(ends)
        state = kept.where("branch").select("seq_id", "na", F.col("node").alias("at"))
        if state.isEmpty():
            return best.groupBy("seq_id").agg(F.min(F.struct("hd", "node")).alias("x")).select("seq_id", "x.node", "x.hd")


def extent(nodes: DataFrame, members: DataFrame, means: DataFrame) -> DataFrame:
    """(node, radius, distortion) of all nodes and of what roots hang from, by Hamming distances, from the leaves upwards.

    A leaf's radius is its farthest member's distance from its mean; a branch's the greatest of its branches' radii and of its leaves'
    radii and distances from its mean. Distortion is the root of the mean square of distances from a node's mean: of a leaf's members,
    of a branch's children, to which a child that is a branch adds its own distortion. Only sums of the children move upwards.
    """
    hd = metrics.hamming(F.col("na"), F.col("nb"), F.col("inter")).alias("hd")
    rows = aggregates.to_centroid(members.join(leaves(nodes), "node", "left_semi"), means, "node").select("node", hd)
    at = written(rows.groupBy("node").agg(F.max("hd").cast("double").alias("radius"), F.sqrt(F.avg(F.col("hd") * F.col("hd"))).alias("distortion"), F.lit(False).alias("branch")), "extent")
    n = means.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    edges = nodes.select("node", "parent")
    common = edges.join(means, "node").join(means.withColumnRenamed("node", "parent"), ["parent", "bit"]).groupBy("node").agg(F.count(F.lit(1)).alias("inter"))
    sized = edges.join(n.withColumnRenamed("n", "na"), "node", "left").join(n.select(F.col("node").alias("parent"), F.col("n").alias("nb")), "parent", "left").join(common, "node", "left").fillna(0, ["na", "nb", "inter"])
    levels = written(sized.select("node", hd).join(tree_levels(nodes).select("node", "parent", "level"), "node"), "levels")
    out = at
    for level in range(levels.agg(F.max("level")).first()[0] or 0, 0, -1):
        below = levels.where(F.col("level") == level).join(at, "node")
        far = F.when(F.col("branch"), F.col("radius")).otherwise(F.col("hd") + F.col("radius"))
        off = F.col("hd") + F.when(F.col("branch"), F.col("distortion")).otherwise(0)
        up = below.groupBy(F.col("parent").alias("node")).agg(F.max(far).alias("radius"), F.sqrt(F.avg(off * off)).alias("distortion"), F.lit(True).alias("branch"))
        at = written(at.join(levels.where(F.col("level") < level).select("node"), "node", "left_semi").unionByName(up), "extent")
        out = out.unionByName(up)
    return out.select("node", "radius", "distortion")


def without_singletons(members: DataFrame, singleton: int = 1) -> DataFrame:
    """(seq_id, node): groups of `singleton` members at most are dissolved, their members go to the remaining group whose majority is most alike by Jaccard (ties to the smaller), or to none (null)."""
    sizes = members.groupBy("node").agg(F.count_distinct("seq_id").alias("size"))
    rows = written(members.join(sizes, "node").select("node", "seq_id", "bit", (F.col("size") <= singleton).alias("freed")), "members")
    kept, freed = (rows.where(c).drop("freed") for c in ("NOT freed", "freed"))
    means = aggregates.mean_signature(kept, "majority", "node")
    moved = most_alike(freed.select("seq_id").distinct(), freed.select("seq_id", "bit"), means)
    return kept.select("seq_id", "node").distinct().unionByName(moved.select("seq_id", "node"))


def most_alike(ids: DataFrame, bits: DataFrame, means: DataFrame) -> DataFrame:
    """(seq_id, node, similarity): the node of the greatest Jaccard, ties to the smaller; null where no bit is shared."""
    lists = lambda df, key: df.groupBy(key).agg(F.collect_list("bit").alias("bits"))
    names = means.select("node").distinct()
    # names that are no numbers are numbered in order, so that ties go to the smaller one
    names = names.withColumn("no", F.col("node").cast("long")) if dict(means.dtypes)["node"] in ("int", "bigint") else leader.ordered(names, F.col("node")).withColumnRenamed("rank", "no")
    near = block_pairs.nearest(lists(bits, "seq_id"), lists(means.join(names, "node").select(F.col("no").alias("node"), "bit"), "node"))
    found = near.withColumnRenamed("node", "no").join(names, "no").select("seq_id", "node", "similarity")
    return ids.select("seq_id").join(found, "seq_id", "left")


def _best(ids: DataFrame, like: DataFrame) -> DataFrame:
    best = like.groupBy("seq_id").agg(F.min(F.struct((-F.col("similarity")).alias("far"), "node")).alias("x"))
    return ids.select("seq_id").join(best, "seq_id", "left").select("seq_id", "x.node", (-F.col("x.far")).alias("similarity"))


def most_alike_windowed(ids: DataFrame, bits: DataFrame, means: DataFrame, method: str = "matching", threshold: int = 2) -> DataFrame:
    """(seq_id, node, similarity) as most_alike, for windowed signatures (seq_id, window_id, bit) and means (node, window_id, bit), by one of windowed.METHODS."""
    if method == "global":
        return most_alike(ids, bits.select("seq_id", "bit").distinct(), means.select("node", "bit").distinct())
    return _best(ids, similarities(bits, means, method, threshold))


def similarities(bits: DataFrame, means: DataFrame, method: str, threshold: int = 2) -> DataFrame:
    """(seq_id, node, similarity) of windowed signatures and means that share a bit in a window (or at all, for the global method)."""
    if method == "global":
        bits, means = bits.select("seq_id", "bit").distinct(), means.select("node", "bit").distinct()
        na, nb = (x.groupBy(k).agg(F.count(F.lit(1)).alias(n)) for x, k, n in ((bits, "seq_id", "na"), (means, "node", "nb")))
        inter = bits.join(means, "bit").groupBy("seq_id", "node").agg(F.count(F.lit(1)).alias("c")).join(na, "seq_id").join(nb, "node")
        return inter.select("seq_id", "node", metrics.jaccard(F.col("na"), F.col("nb"), F.col("c")).alias("similarity"))
    if method not in windowed.METHODS:
        raise ValueError(f"{method!r} is none of {windowed.METHODS}")
    counted = window_counts(bits, means)
    c, na, nb = F.col("c"), F.col("na"), F.col("nb")
    per = F.sum(metrics.jaccard(na, nb, c)) if method == "local" else F.count_if((c >= threshold) | ((c == na) & (c == nb)))
    out = counted.groupBy("seq_id", "node", "wa", "wb").agg(per.alias("v"))
    of = F.least("wa", "wb") if method == "local" else F.greatest("wa", "wb")
    return out.select("seq_id", "node", (F.col("v") / of).alias("similarity"))


def window_counts(bits: DataFrame, means: DataFrame) -> DataFrame:
    """(seq_id, node, window_id, c, na, nb, wa, wb): common bits of windows, the windows' own, and numbers of windows."""
    na = bits.groupBy("seq_id", "window_id").agg(F.count(F.lit(1)).alias("na"))
    nb = means.groupBy("node", "window_id").agg(F.count(F.lit(1)).alias("nb"))
    wa = na.groupBy("seq_id").agg((F.max("window_id") + 1).alias("wa"))
    wb = nb.groupBy("node").agg((F.max("window_id") + 1).alias("wb"))
    c = bits.join(means, ["window_id", "bit"]).groupBy("seq_id", "node", "window_id").agg(F.count(F.lit(1)).alias("c"))
    return c.join(na, ["seq_id", "window_id"]).join(nb, ["node", "window_id"]).join(wa, "seq_id").join(wb, "node")


def best_match(bits: DataFrame, nodes: DataFrame, threshold: int = 2) -> DataFrame:
    """(seq_id, node, matching, hd): the node with most matching windows, of those the one at the least Hamming distance over all windows, then the smaller.

    bits: (seq_id, window_id, bit); nodes: (node, window_id, bit). Sequences that share no bit with any node have no row.
    """
    c, na, nb = F.col("c"), F.col("na"), F.col("nb")
    matching = F.count_if((c >= threshold) | ((c == na) & (c == nb)))
    pairs = window_counts(bits, nodes).groupBy("seq_id", "node").agg(matching.alias("matching"), F.sum("c").alias("c"))
    a, b = bits.groupBy("seq_id").agg(F.count(F.lit(1)).alias("a")), nodes.groupBy("node").agg(F.count(F.lit(1)).alias("b"))
    rows = pairs.join(a, "seq_id").join(b, "node").withColumn("hd", metrics.hamming(F.col("a"), F.col("b"), c))
    best = rows.groupBy("seq_id").agg(F.min(F.struct((-F.col("matching")).alias("less"), "hd", "node")).alias("x"))
    return best.select("seq_id", "x.node", (-F.col("x.less")).alias("matching"), "x.hd")


def poles(members: DataFrame) -> DataFrame:
    """(node, seq_id, side, hd): each group in two. The first pole is the member farthest from the mean, the second the one farthest from the first (Hamming, ties to smaller ids); a member goes to the nearer pole, ties to the first. hd: its distance to that pole."""
    members = written(members.select("node", "seq_id", "bits" if "bits" in members.columns else "bit"), "members")
    first = aggregates.farthest(members, "node").select("node", F.col("seq_id").alias("pole"))
    one = written(_to_pole(members, first), "first-pole")
    second = one.groupBy("node").agg(F.min(F.struct((-F.col("hd")).alias("near"), "seq_id")).alias("x")).select("node", F.col("x.seq_id").alias("pole"))
    both = one.join(_to_pole(members, second).withColumnRenamed("hd", "other"), ["node", "seq_id"])
    return both.select("node", "seq_id", (F.col("other") < F.col("hd")).cast("int").alias("side"), F.least("hd", "other").alias("hd"))


def _to_pole(members: DataFrame, pole: DataFrame) -> DataFrame:
    """(node, seq_id, hd) to the group's pole, a member."""
    mean = members.join(pole, "node").where("seq_id = pole").select("node", F.explode("bits").alias("bit") if "bits" in members.columns else "bit")
    rows = aggregates.to_centroid(members, mean, "node")
    return rows.select("node", "seq_id", metrics.hamming(F.col("na"), F.col("nb"), F.col("inter")).alias("hd"))


def ktree(members: DataFrame, capacity: int, refine: int = 2) -> tuple[DataFrame, DataFrame]:
    """((seq_id, node), (node, parent)): a tree whose leaves hold `capacity` members at most, built downwards.

    members: (seq_id, bit). All groups above the capacity are split at once: two poles, then `refine` rounds of 2-means by Hamming distance
    with OR means. Names of nodes are paths of 0 and 1 below "r". A group of equal signatures can't be split and stays.
    """
    state = written(members.select(F.lit("r").alias("node"), "seq_id", "bit"), "ktree")
    nodes = state.limit(1).select("node", F.lit(None).cast("string").alias("parent"))
    done = None
    while True:
        n = state.groupBy("node").agg(F.count_distinct("seq_id").alias("n"))
        state = written(state.join(n, "node"), "ktree")
        small = state.where(F.col("n") <= capacity).select("seq_id", "node").distinct()
        done = small if done is None else done.unionByName(small)
        big = state.where(F.col("n") > capacity).drop("n")
        if big.isEmpty():
            return done, nodes
        side = poles(big).select("node", "seq_id", "side")
        for _ in range(refine):
            halves = big.join(side, ["node", "seq_id"])
            means = aggregates.mean_signature(halves, "or", "node", "side")
            side = written(_nearer(big, means, side), "sides")
        parts = side.groupBy("node").agg(F.count_distinct("side").alias("parts"))
        side = written(side.join(parts, "node"), "sides")
        # refining may have emptied a side: poles part unequal signatures, so those are kept then
        plain = poles(big.join(side.where("parts = 1").select("node").distinct(), "node", "left_semi"))
        again = plain.groupBy("node").agg(F.count_distinct("side").alias("parts"))
        side = written(side.where("parts = 2").unionByName(plain.join(again, "node").select("node", "seq_id", "side", "parts")), "sides")
        equal = side.where("parts = 1").select("seq_id", "node")
        done = done.unionByName(equal)
        child = F.concat("node", F.col("side").cast("string"))
        moved = side.where("parts = 2").select("node", "seq_id", child.alias("child"))
        nodes = nodes.unionByName(written(moved.select(F.col("child").alias("node"), F.col("node").alias("parent")).distinct(), "nodes"))
        state = written(big.join(moved, ["node", "seq_id"]).select(F.col("child").alias("node"), "seq_id", "bit"), "ktree")


def _nearer(members: DataFrame, means: DataFrame, side: DataFrame) -> DataFrame:
    """(node, seq_id, side): the nearer of the group's two means; ties stay on side 0."""
    na = members.groupBy("node", "seq_id").agg(F.count(F.lit(1)).alias("na"))
    nb = means.groupBy("node", "side").agg(F.count(F.lit(1)).alias("nb"))
    inter = members.join(means, ["node", "bit"]).groupBy("node", "seq_id", "side").agg(F.count(F.lit(1)).alias("c"))
    each = na.join(nb, "node").join(inter, ["node", "seq_id", "side"], "left").fillna(0, ["c"])
    hd = metrics.hamming(F.col("na"), F.col("nb"), F.col("c"))
    return each.groupBy("node", "seq_id").agg(F.min(F.struct(hd.alias("hd"), "side")).alias("x")).select("node", "seq_id", "x.side")


def trim(nodes: DataFrame, filled: DataFrame) -> DataFrame:
    """(node, parent) without nodes that have no filled one below them, and without empty ones that have a single child.

    nodes: trees, without a cycle; filled: (node) that hold members. A node hangs from its nearest ancestor that stays, or else from what the top one hung from.
    """
    nodes = written(nodes.select("node", "parent"), "nodes")
    filled = written(filled.select("node").distinct().join(nodes, "node", "left_semi"), "filled")
    # each round doubles the steps upwards, so their number is the logarithm of the depth
    kept, jump = filled, nodes.join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", F.col("parent").alias("to"))
    while not (jump := written(jump, "jumps")).isEmpty():
        kept = written(kept.unionByName(kept.join(jump, "node").select(F.col("to").alias("node"))).distinct(), "kept")
        jump = jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("further")), "to").select("node", F.col("further").alias("to"))
    edges = written(nodes.join(kept, "node", "left_semi"), "edges")
    children = edges.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    gone = edges.join(children, "node").where("n = 1").join(filled, "node", "left_anti").select(F.col("node").alias("parent"), F.col("parent").alias("to"))
    gone = written(gone, "gone")
    while True:
        next_ = gone.select(F.col("parent").alias("to"), F.col("to").alias("further"))
        if gone.join(next_, "to", "left_semi").isEmpty():
            break
        gone = written(gone.join(next_, "to", "left").select("parent", F.coalesce("further", "to").alias("to")), "gone")
    stays = edges.join(gone.select(F.col("parent").alias("node")), "node", "left_anti")
    return stays.join(gone, "parent", "left").select("node", F.coalesce("to", "parent").alias("parent"))


def super_clusters(nodes: DataFrame) -> DataFrame:
    """(node, top): the ancestor of each node, or itself, that hangs from no node. Steps upwards double, so rounds are the logarithm of the depth."""
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    state = nodes.join(known, "parent", "left").select("node", F.when(F.col("known"), F.col("parent")).alias("up"))
    state = written(state.select("node", "up", F.coalesce("up", "node").alias("top")), "tops")
    while not state.where("up IS NOT NULL").isEmpty():
        above = state.select(F.col("node").alias("up"), F.col("up").alias("further"), F.col("top").alias("higher"))
        state = written(state.join(above, "up", "left").select("node", F.col("further").alias("up"), F.coalesce("higher", "top").alias("top")), "tops")
    return state.select("node", "top")


def like_siblings(nodes: DataFrame, means: DataFrame, within: int) -> DataFrame:
    """(node, into): children that merge into an earlier one of the same parent, which stays.

    In order of their numbers, a child merges into the first sibling that stays and whose mean (node, bit), or (node, bits), a row each, is less than `within` away
    (Hamming); else it stays. A child is settled as soon as all earlier siblings near it are, so rounds are as many as the
    longest chain of near siblings; only near pairs leave the comparison of blocks. Siblings of equal means fare alike, so only the
    first of them is compared.
    """
    own = means if "bits" in means.columns else means.groupBy("node").agg(F.collect_list("bit").alias("bits"))
    bits = F.concat(F.array(F.lit(0)), F.transform(F.array_sort(F.coalesce("bits", F.array().cast(dict(own.dtypes)["bits"]))), lambda b: b.cast("int") + 1))
    each = nodes.join(own, "node", "left").select("node", "parent", bits.alias("bits"))
    each = written(each.withColumn("first", F.min("node").over(Window.partitionBy("parent", "bits"))), "alike")
    copies = each.where("node <> first AND parent IS NOT NULL").select("node", "first")
    near = block_pairs.apart(each.where("node = first").select(F.col("node").alias("seq_id"), "bits"), within - 1)
    parent = nodes.select("node", "parent")
    pairs = near.select(F.col("j").alias("later"), F.col("i").alias("earlier"))
    pairs = pairs.join(parent.select(F.col("node").alias("later"), F.col("parent").alias("p")), "later").join(parent.select(F.col("node").alias("earlier"), F.col("parent").alias("q")), "earlier")
    open_ = written(pairs.where("p = q").select("later", "earlier"), "near")
    out = nodes.sparkSession.createDataFrame([], "node long, into long")
    kept = written(nodes.select("node").join(copies, "node", "left_anti").join(open_.select(F.col("later").alias("node")), "node", "left_anti"), "kept")
    while not open_.isEmpty():
        known = kept.select(F.col("node").alias("earlier"), F.lit(True).alias("stays")).unionByName(out.select(F.col("node").alias("earlier"), F.lit(False).alias("stays")))
        seen = open_.join(known, "earlier", "left")
        # the first near sibling that stays, if all before it are settled
        each = seen.groupBy("later").agg(F.min(F.when(F.col("stays"), F.col("earlier"))).alias("into"), F.min(F.when(F.col("stays").isNull(), F.col("earlier"))).alias("unknown"))
        done = written(each.where("unknown IS NULL OR into < unknown").select(F.col("later").alias("node"), "into"), "settled")
        kept = written(kept.unionByName(done.where("into IS NULL").select("node")), "kept")
        out = written(out.unionByName(done.where("into IS NOT NULL")), "merged")
        open_ = written(open_.join(done.select(F.col("node").alias("later")), "later", "left_anti"), "near")
    return out.unionByName(copies.join(out.select(F.col("node").alias("first"), "into"), "first", "left").select("node", F.coalesce("into", "first").alias("into")))


def contracted(nodes: DataFrame, members: DataFrame, merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, parent), (seq_id, node)) with merged nodes' (node, into) members and children taken over."""
    to = merged.select(F.col("node").alias("gone"), "into")
    left = nodes.join(merged, "node", "left_anti").join(to, F.col("parent") == F.col("gone"), "left").select("node", F.coalesce("into", "parent").alias("parent"))
    return left, members.join(to, F.col("node") == F.col("gone"), "left").select("seq_id", F.coalesce("into", "node").alias("node"))


def by_frequency(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """(node, parent, n): the tree with its nodes moved so that no child was accessed more often than its parent.

    nodes: (node, parent); counts: (node, n), 0 where there is none. The shape stays: a node changes places with its parent where it is the
    parent's most accessed child (ties to the smaller) and more accessed than it, parents of even and of odd levels in turn, all at
    once, until nothing moves. What a node holds goes with it. Roots hang from what they hung from.
    """
    rows = tree_levels(nodes).select(F.col("node").alias("slot"), F.col("parent").alias("above"), "level")
    state = written(rows.join(nodes.select(F.col("node").alias("slot"), "node"), "slot").join(counts.select("node", "n"), "node", "left").select("slot", "above", "level", "node", F.coalesce("n", F.lit(0)).cast("long").alias("n")), "slots")
    still, turn = 0, 0
    while still < 2:
        up = state.where(F.pmod("level", F.lit(2)) == turn % 2).select(F.col("slot").alias("above"), F.col("node").alias("upper"), F.col("n").alias("most"))
        best = state.join(up, "above").groupBy("above", "upper", "most").agg(F.min(F.struct((-F.col("n")).alias("less"), "node", "slot")).alias("x"))
        swaps = written(best.where(-F.col("x.less") > F.col("most")).select("above", "upper", "most", F.col("x.slot").alias("below"), F.col("x.node").alias("lower"), (-F.col("x.less")).alias("least")), "swaps")
        if swaps.isEmpty():
            still += 1
        else:
            still = 0
            moved = swaps.select(F.col("above").alias("slot"), F.col("lower").alias("new"), F.col("least").alias("of")).unionByName(swaps.select(F.col("below").alias("slot"), F.col("upper").alias("new"), F.col("most").alias("of")))
            state = written(state.join(moved, "slot", "left").select("slot", "above", "level", F.coalesce("new", "node").alias("node"), F.coalesce("of", "n").alias("n")), "slots")
        turn += 1
    names = state.select(F.col("slot").alias("above"), F.col("node").alias("parent"))
    return state.join(names, "above", "left").select("node", F.coalesce("parent", "above").alias("parent"), "n")


def estimated_split(signatures: DataFrame, ids: DataFrame, method: str | None = None, threshold: int = 2) -> float:
    """The upper quartile of similarities of sampled pairs: 10 runs of 100 sequences."""
    if method is None:
        pairs = aggregates.sampled_pairs(signatures, 100, 10)
    else:
        bits = signatures.select("seq_id", "window_id", F.explode("bits").alias("bit"))
        counts = signatures.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))
        pairs = windowed.sampled_similarity(bits, ids, counts, 100, 10, method, threshold)
    return (aggregates.spread(pairs, "similarity", "run").agg(F.avg("q3")).first()[0] or 0.0) / 100


def cluster(signatures: DataFrame, ids: DataFrame, bits: int, stay: float = 0.8, split: float | None = 0.5, iterations: int = 0, first: int | None = None, seed: int | None = None, singleton: int = 1, method: str | None = None, threshold: int = 2, loosen: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """((seq_id, node), (node, parent)): a tree by insertion, and rounds of reassigning all sequences to its leaves.

    signatures: (seq_id, bits), compared by Jaccard; or with a method of windowed.METHODS (seq_id, window_id, bits). ids: (seq_id) of all
    sequences. Without a split it is estimated from sampled pairs. They are inserted by id, or in an order that a seed gives; with `first`
    only so many, and the others have no node (null) before the first round. At each level deeper, `stay` is less by `loosen`.
    A round dissolves ambiguous leaves (`singleton` members at most; none, if all are), takes leaves' majorities, gives every
    sequence to the most alike leaf (ties, and sequences like none, to the smallest), and trims the tree.
    """
    if split is None:
        split = estimated_split(signatures, ids, method, threshold)
    if method is None:
        packed = signatures.select("seq_id", "bits")
    else:
        own = signatures.groupBy("seq_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("window_id", "bits"))), lambda s: s["bits"]).alias("bits"))
        packed = ids.select("seq_id").join(own, "seq_id", "left").withColumn("bits", F.coalesce("bits", F.array().cast("array<array<int>>")))

    order = [F.xxhash64("seq_id", F.lit(seed))] if seed is not None else []
    some = packed
    if first is not None:
        some = leader.ordered(packed, *order, F.col("seq_id")).where(F.col("rank") < first)
    kind = leader.Flat(bits) if method is None else leader.Windowed(method, threshold)
    built, nodes, _ = leader.grow(some, kind, stay, split, loosen, order)
    nodes = nodes.select("node", "parent")
    members = ids.select("seq_id").join(built, "seq_id", "left")
    rows = written(signatures.select(*[c for c in signatures.columns if c in ("seq_id", "window_id")], F.explode("bits").alias("bit")), "bits")
    for _ in range(iterations):
        ends = leaves(nodes)
        clear = written(ends.join(ambiguous(nodes, members, singleton), "node", "left_anti"), "clear")
        clear = ends if clear.isEmpty() else clear
        inside = rows.join(members.join(clear, "node", "left_semi"), "seq_id")
        if method is None:
            like = most_alike(ids, rows, aggregates.mean_signature(inside, "majority", "node"))
        else:
            like = most_alike_windowed(ids, rows, windowed.truncated_mean(inside, "node"), method, threshold)
        smallest = clear.agg(F.min("node").alias("least"))
        members = written(like.crossJoin(F.broadcast(smallest)).select("seq_id", F.coalesce("node", "least").alias("node")), "members")
        nodes = written(trim(nodes, members.select("node")), "nodes")
    return members, nodes
