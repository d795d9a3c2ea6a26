"""Trees that a stream moves: arriving sequences join their nearest leaves, whose means and whose ancestors' means follow.

State is a folder of tables, each with a part a batch: members (seq_id, node, hd), votes (node, bit, votes) and sizes (node, n) that a
batch adds to leaves, and means (node, bits) of the nodes that it moved. A batch reads only parts of earlier batches and writes its
own parts over, so one that is repeated after a failure adds nothing. Every `FOLD` batches a batch sums up all earlier ones, and
later batches read from there on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import SketchConfig
from ..operators import sketches, trees
from ..sources.sinks import tree_levels
from ..sources.storage import written

#: Batches between two sums; a parameter of reading, not of results.
FOLD = 32


def _schema(name: str, node: str) -> str:
    return {"votes": f"node {node}, bit int, votes long", "sizes": f"node {node}, n long", "means": f"node {node}, bits array<int>", "members": f"seq_id long, node {node}, hd long"}[name]


def _added(spark: SparkSession, path: str, name: str, node: str, before: int) -> DataFrame:
    """Rows of a state table as of a batch, with the column `batch`: the last sum and what came after it."""
    fold = (before - 1) // FOLD * FOLD if before > 0 else -1
    rows = spark.read.schema(f"{_schema(name, node)}, batch long").parquet(f"{path}/{name}")
    return rows.where((F.col("batch") >= fold) & (F.col("batch") < before))


def means(spark: SparkSession, path: str, node: str = "long", before: int | None = None) -> DataFrame:
    """(node, bits): all nodes' means as they were before batch `before`, or as they are after the last one."""
    if before is None:  # parts are named by batch, so no rows are read
        before = spark.read.schema(f"{_schema('means', node)}, batch long").parquet(f"{path}/means").agg(F.max("batch")).first()[0] + 1
    return _added(spark, path, "means", node, before).groupBy("node").agg(F.max_by("bits", "batch").alias("bits"))


def members(spark: SparkSession, path: str, node: str = "long") -> DataFrame:
    """(seq_id, node, hd): where arrived sequences stand, and how far from its mean at that time."""
    return spark.read.schema(f"{_schema('members', node)}, batch long").parquet(f"{path}/members").drop("batch")


def _put(rows: DataFrame, path: str, name: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")


def _majority(votes: DataFrame, n: str = "n") -> DataFrame:
    return votes.where(F.col("votes") >= F.floor((F.col(n) + 1) / 2))


def _packed(rows: DataFrame, of: DataFrame) -> DataFrame:
    """(node, bits) of all nodes `of`, from (node, bit); a node without bits has an empty array. A signature's bits are bounded by its length."""
    bits = rows.groupBy("node").agg(F.array_sort(F.collect_list("bit")).alias("bits"))
    return of.select("node").join(bits, "node", "left").select("node", F.coalesce("bits", F.array().cast("array<int>")).alias("bits"))


def begin(nodes: DataFrame, members: DataFrame, path: str, singleton: int = 1) -> None:
    """The state before the first batch, of a built tree: nodes (node, parent), members (node, seq_id, bit) of leaves, or (node, seq_id, bits), a row each."""
    at_ends = members.join(trees.leaves(nodes), "node", "left_semi")
    votes = at_ends
    if "bits" in members.columns:
        at_ends = at_ends.where(F.size("bits") > 0)
        votes = at_ends.select("node", F.explode("bits").alias("bit"))
    _put(votes.groupBy("node", F.col("bit").cast("int").alias("bit")).agg(F.count(F.lit(1)).alias("votes")), path, "votes", -1)
    _put(at_ends.groupBy("node").agg(F.count_distinct("seq_id").alias("n")), path, "sizes", -1)
    tops = nodes.select("node").union(nodes.select("parent").where("parent IS NOT NULL")).distinct()
    _put(_packed(trees.centroids(nodes, members, singleton).select("node", F.col("bit").cast("int").alias("bit")), tops), path, "means", -1)
    spark, node = nodes.sparkSession, dict(nodes.dtypes)["node"]
    _put(spark.createDataFrame([], _schema("members", node)), path, "members", -1)


def advance(rows: DataFrame, nodes: DataFrame, path: str, number: int, singleton: int = 1) -> None:
    """One batch: signatures (seq_id, bits) go down the tree by the means before it, and the nodes on their ways get new means.

    Sequences without bits stand at a leaf like others and vote for nothing, but count for no node's size, as in a tree that is built. A sequence
    that arrives twice is two members. An empty batch leaves an empty part. Only ancestors of leaves that got members are computed anew.
    """
    spark, node = nodes.sparkSession, dict(nodes.dtypes)["node"]
    old = written(means(spark, path, node, number), "means")
    # equal ids of one batch are told apart by a number of their own
    rows = written(rows.select("seq_id", "bits").withColumn("arrival", F.monotonically_increasing_id()), "arrivals")
    bits = rows.select(F.col("arrival").alias("seq_id"), F.explode(F.array_distinct("bits")).alias("bit"))
    at = trees.descend(rows.select(F.col("arrival").alias("seq_id")), bits, nodes, old.select("node", F.explode("bits").alias("bit")))
    at = written(at, "at")
    new_votes = at.join(bits, "seq_id").groupBy("node", F.col("bit").cast("int").alias("bit")).agg(F.count(F.lit(1)).alias("votes"))
    new_sizes = at.join(bits.select("seq_id").distinct(), "seq_id", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    new_votes, new_sizes = written(new_votes, "votes"), written(new_sizes, "sizes")
    past = {name: _added(spark, path, name, node, number).drop("batch") for name in ("votes", "sizes")}
    votes = written(past["votes"].unionByName(new_votes).groupBy("node", "bit").agg(F.sum("votes").alias("votes")), "votes")
    sizes = written(past["sizes"].unionByName(new_sizes).groupBy("node").agg(F.sum("n").alias("n")), "sizes")

    # leaves that got members, then level by level what stands above them
    moved = new_sizes.select("node")
    fresh = _packed(_majority(votes.join(moved, "node", "left_semi").join(sizes, "node")).select("node", "bit"), moved)
    found = written(fresh, "moved")
    levels = written(tree_levels(nodes), "levels")
    small = F.coalesce("n", F.lit(0)) <= singleton
    unsure = written(trees.leaves(nodes).join(sizes, "node", "left").where(small).select("node"), "ambiguous")
    for level in range(levels.agg(F.max("level")).first()[0] or 0, 0, -1):
        here = levels.where(F.col("level") == level).select("node", "parent")
        touched = here.join(found, "node", "left_semi").select("parent").distinct()
        children = here.join(touched, "parent", "left_semi")
        if level > 1:
            children = children.join(unsure, "node", "left_anti")
        children = written(children, "children")
        now = found.unionByName(old.join(found, "node", "left_anti"))
        n = children.groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
        above = children.join(now, "node").select("parent", F.explode("bits").alias("bit")).groupBy("parent", "bit").agg(F.count(F.lit(1)).alias("votes")).join(n, "parent")
        above = _majority(above) if level > 1 else above
        top = touched.where("parent IS NOT NULL").select(F.col("parent").alias("node"))
        found = found.unionByName(written(_packed(above.select(F.col("parent").alias("node"), "bit"), top), "moved"))

    whole = number % FOLD == 0
    _put(votes if whole else new_votes, path, "votes", number)
    _put(sizes if whole else new_sizes, path, "sizes", number)
    _put(found.unionByName(old.join(found, "node", "left_anti")) if whole else found, path, "means", number)
    own = rows.withColumnRenamed("seq_id", "id").join(at, F.col("arrival") == F.col("seq_id"))
    _put(own.select(F.col("id").cast("long").alias("seq_id"), "node", F.col("hd").cast("long").alias("hd")), path, "members", number)


def follow(seqs: DataFrame, nodes: DataFrame, cfg: SketchConfig, path: str, checkpoint: str, singleton: int = 1, once: bool = False) -> StreamingQuery:
    """Moves the tree whose state `begin` wrote to `path` by each micro-batch of a streaming (seq_id, seq) table; with `once`, by what is there now."""
    nodes = written(nodes.select("node", "parent"), "nodes")

    def batch(df: DataFrame, number: int) -> None:
        advance(sketches.flat(df, cfg), nodes, path, number, singleton)

    out = seqs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
