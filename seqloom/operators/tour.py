"""Tours around trees of any depth: where a walk enters and leaves each node, by list ranking instead of level by level.

A node is two events, entering and leaving; each names the next one, and every round doubles the steps that an event looks ahead,
so rounds are the logarithm of the number of nodes, whatever the depth, and siblings may be as many as there are nodes. Joins of
events with events are merges: small ones would be broadcast, and every round would pass its table through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.storage import written
from .leader import ordered


def tour(nodes: DataFrame) -> DataFrame:
    """(node, parent, level, enters, leaves): places from 0 in one walk over all trees, siblings and roots by node; roots have level 1.

    nodes: (node, parent), a row a node; a root's parent is null or isn't a node, and comes back as null. Nodes on a cycle, or below
    one, are reached by no walk and have no row. What lies between a node's two places is its subtree, of (leaves - enters - 1) / 2 nodes.
    """
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    rows = nodes.select("node", "parent").join(known.hint("merge"), "parent", "left").select("node", F.when(F.col("known"), F.col("parent")).alias("parent"))
    rows = written(ordered(rows, F.col("parent"), F.col("node")), "siblings")  # siblings lie side by side
    after = rows.select((F.col("rank") - 1).alias("rank"), F.col("parent").alias("beside"), F.lit(True).alias("more"))
    first = rows.groupBy("parent").agg(F.min("rank").alias("first")).where("parent IS NOT NULL").withColumnRenamed("parent", "node")
    above = rows.select(F.col("node").alias("parent"), F.col("rank").alias("up"))
    joined = rows.join(after.hint("merge"), "rank", "left").join(first.hint("merge"), "node", "left").join(above.hint("merge"), "parent", "left")
    onward = F.when(F.col("more") & F.col("parent").eqNullSafe(F.col("beside")), 2 * (F.col("rank") + 1)).otherwise(2 * F.col("up") + 1)
    enter = F.struct((2 * F.col("rank")).alias("at"), F.coalesce(2 * F.col("first"), 2 * F.col("rank") + 1).alias("to"), F.lit(1).alias("net"))
    leave = F.struct((2 * F.col("rank") + 1).alias("at"), onward.alias("to"), F.lit(-1).alias("net"))
    state = written(joined.select(F.inline(F.array(enter, leave))).withColumn("steps", F.lit(1).cast("long")), "tour")
    for _ in range(state.count().bit_length()):  # events on a cycle never end
        if state.where("to IS NOT NULL").isEmpty():
            break
        ahead = state.select(F.col("at").alias("to"), F.col("to").alias("further"), F.col("net").alias("more_net"), F.col("steps").alias("more_steps"))
        total = lambda x: (F.col(x) + F.coalesce(f"more_{x}", F.lit(0))).alias(x)
        state = written(state.join(ahead.hint("merge"), "to", "left").select("at", F.col("further").alias("to"), total("net"), total("steps")), "tour")
    ended = state.where("to IS NULL")
    length = ended.agg(F.coalesce(F.max("steps"), F.lit(0)).alias("length"))  # a row
    place = lambda side: ended.where(F.col("at") % 2 == side).join(F.broadcast(length)).select(F.floor(F.col("at") / 2).alias("rank"), (F.col("length") - F.col("steps")).alias(("enters", "leaves")[side]), *([] if side else [(1 - F.col("net")).cast("int").alias("level")]))
    return rows.join(place(0).hint("merge"), "rank").join(place(1).hint("merge"), "rank").select("node", "parent", "level", "enters", "leaves")
