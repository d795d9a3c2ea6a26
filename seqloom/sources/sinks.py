"""Writers of results: signatures by file and by sequence, histograms, merged counts, distances, node tables, dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .splits import SignatureSource
from .storage import written


def signatures(rows: DataFrame, bits: int, folder: str, mode: str = "append") -> None:
    """Flat signatures in order of id, as files of the signature format; a failed or repeated task leaves no file."""
    rows.sparkSession.dataSource.register(SignatureSource)
    rows = written(rows.select("seq_id", "bits"), "signatures")  # ranges are drawn from a read of their own
    ordered = rows.repartitionByRange("seq_id").sortWithinPartitions("seq_id").select("bits")
    ordered.write.format("signatures").option("bits", bits).mode(mode).save(folder)


def windowed_signatures(rows: DataFrame, bits: int, folder: str, mode: str = "append") -> None:
    """Windowed signatures (seq_id, window_id, bits), each sequence ended by a record of zeros."""
    rows.sparkSession.dataSource.register(SignatureSource)
    rows = written(rows.select("seq_id", "window_id", "bits"), "windows")  # read three times
    last = rows.groupBy("seq_id").agg((F.max("window_id") + 1).alias("window_id")).withColumn("bits", F.array().cast("array<int>"))
    every = rows.select("seq_id", "window_id", "bits").unionByName(last.select("seq_id", F.col("window_id").cast("int"), "bits"))
    ordered = every.repartitionByRange("seq_id").sortWithinPartitions("seq_id", "window_id").select("bits")
    ordered.write.format("signatures").option("bits", bits).mode(mode).save(folder)


def by_file(rows: DataFrame, folder: str) -> None:
    """A folder's signatures (file, ...) with a sub-folder a file."""
    rows.write.partitionBy("file").parquet(folder)


def by_sequence(rows: DataFrame, folder: str) -> None:
    """A sub-folder a sequence; rows of a sequence go to one task, so each gets one file."""
    rows.repartition("seq_id").write.partitionBy("seq_id").parquet(folder)


def histogram(bins: DataFrame, path: str) -> None:
    """bin,count in order of bins."""
    bins.select("bin", "count").coalesce(1).sortWithinPartitions("bin").write.csv(path, header=True)


def merged(counts: DataFrame, path: str) -> None:
    """Count tables side by side, by id; ids that a table lacks are empty."""
    counts.write.csv(path, header=True)


def node_distances(rows: DataFrame, path: str) -> None:
    """seq_id,clu,HD of (seq_id, cluster, hd)."""
    rows.select("seq_id", F.col("cluster").alias("clu"), F.col("hd").alias("HD")).write.csv(path, header=True)


def nodes(rows: DataFrame, path: str) -> None:
    """(node, bits), and what else a node table has."""
    rows.write.parquet(path)


def node_table(nodes_: DataFrame, path: str) -> None:
    """node,parent,level,isBranch of (node, parent)."""
    tree_levels(nodes_).select("node", "parent", "level", "isBranch").write.csv(path, header=True)


def tree_levels(nodes_: DataFrame) -> DataFrame:
    """(node, parent, level, isBranch) of (node, parent), roots being those whose parent isn't a node: level by level, a join each."""

    edges = nodes_.select("node", "parent")
    branches = edges.select(F.col("parent").alias("node")).distinct().withColumn("isBranch", F.lit(True))
    at = written(edges.join(edges.select(F.col("node").alias("parent")), "parent", "left_anti").withColumn("level", F.lit(1)).select("node", "parent", "level"), "levels")
    out = at
    while not at.isEmpty():
        at = written(edges.join(at.select(F.col("node").alias("parent"), (F.col("level") + 1).alias("level")), "parent").select("node", "parent", "level"), "levels")
        out = out.unionByName(at)
    return out.join(branches, "node", "left").withColumn("isBranch", F.coalesce("isBranch", F.lit(False)))


def tree_json(nodes_: DataFrame, members: DataFrame, path: str, most: int = 1000) -> None:
    """Nested JSON of (node, parent, priority) and (node, seq_id): `path` holds parts of one text, in the order of their names, to be read one after the other.

    The outermost node is 0, with priority 0 and no members; all roots hang from it, siblings by node. The text has a space between two nodes and
    after each `most` members of a node, nowhere else, so no row is longer than that many members. Nodes on a cycle have no place.
    """
    from ..operators.leader import ordered
    from ..operators.tour import tour

    places = written(tour(nodes_), "places")
    rows = written(ordered(members.select("node", "seq_id").distinct(), F.col("node"), F.col("seq_id")), "members")
    begins = rows.groupBy("node").agg(F.min("rank").alias("begin"), F.count(F.lit(1)).alias("n"))
    part = F.floor((F.col("rank") - F.col("begin")) / most)
    lists = rows.join(begins, "node").groupBy("node", part.alias("part")).agg(F.array_sort(F.collect_list("seq_id")).alias("ids"))
    # the first list stands in the row that opens the node, each further one in a row of its own
    listed = F.concat(F.when(F.col("part") > 0, F.lit(",")).otherwise(F.lit("")), F.array_join("ids", ","))
    lists = lists.select("node", "part", listed.alias("listed"))
    quoted = lambda c: F.to_json(F.struct(c.cast("string").alias("x")))
    name = F.replace(F.regexp_extract(quoted(F.col("node")), r'(?s)^\{"x":(.*)\}$', 1), F.lit(" "), F.lit("\\u0020"))
    head = F.concat(F.when(F.col("comma"), F.lit(",")).otherwise(F.lit("")), F.lit('{"node":'), name, F.lit(',"priority":"'), F.format_string("%.2f", F.coalesce(F.col("priority").cast("double"), F.lit(0.0))), F.lit('","childCount":"'), F.coalesce("n", F.lit(0)).cast("string"), F.lit('","content":"*'))
    ended = F.lit('","children":[')
    # a node that isn't entered right after its parent has an elder sibling
    parents = places.select(F.col("node").alias("parent"), F.col("enters").alias("above"))
    opened = places.join(nodes_.select("node", "priority"), "node").join(begins, "node", "left").join(parents, "parent", "left").withColumn("comma", F.col("enters") > F.coalesce(F.col("above") + 1, F.lit(0)))
    last = F.greatest(F.ceil(F.coalesce("n", F.lit(0)) / most) - 1, F.lit(0))
    opened = opened.join(lists.where("part = 0"), "node", "left").select(F.col("enters").alias("at"), F.lit(0).cast("long").alias("part"), F.concat(head, F.coalesce("listed", F.lit("")), F.when(last == 0, ended).otherwise(F.lit(""))).alias("value"))
    further = lists.where("part > 0").join(places.select("node", "enters"), "node").join(begins.select("node", last.alias("last")), "node")
    further = further.select(F.col("enters").alias("at"), "part", F.concat("listed", F.when(F.col("part") == F.col("last"), ended).otherwise(F.lit(""))).alias("value"))
    closed = places.select(F.col("leaves").alias("at"), F.lit(0).cast("long").alias("part"), F.lit("]}").alias("value"))
    top = 'var treeData = {"node":"0","priority":"0.00","childCount":"0","content":"*","children":['
    ends = nodes_.sparkSession.createDataFrame([(-1, 0, top), (2**62, 0, "]}")], "at long, part long, value string")
    every = opened.unionByName(further).unionByName(closed).unionByName(ends)
    every.repartitionByRange("at", "part").sortWithinPartitions("at", "part").select("value").write.option("lineSep", " ").text(path)


def tree_text(nodes_: DataFrame, path: str) -> None:
    """A line a node in level order: as many spaces as its level, its number and its parent's."""
    rows = tree_levels(nodes_)
    line = F.concat(F.repeat(F.lit(" "), F.col("level")), F.col("node").cast("string"), F.lit(" < "), F.col("parent").cast("string"))
    rows.orderBy("level", "parent", "node").select(line.alias("value")).write.text(path)


def nearest(rows: DataFrame, path: str) -> None:
    """node,dist of (node, dist), nearest first."""
    rows.select("node", "dist").orderBy("dist", "node").write.csv(path, header=True)


def stats(rows: DataFrame, path: str) -> None:
    """A statistics table as tab-separated text."""
    rows.write.csv(path, header=True, sep="\t")


def column(rows: DataFrame, name: str, path: str) -> None:
    """One column as lines of text."""
    rows.select(F.col(name).cast("string").alias("value")).write.text(path)


def as_zeros_and_ones(bits: Column, size: int) -> Column:
    """A signature as a string of its bits, the first first."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_contains(bits, i).cast("int").cast("string")), "")


def as_bytes(bits: Column, size: int) -> Column:
    """A signature's bytes as numbers."""
    byte = lambda i: F.aggregate(F.filter(bits, lambda b: F.floor(b / 8) == i), F.lit(0), lambda a, b: a + F.pow(F.lit(2), F.pmod(b, F.lit(8))).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(size // 8 - 1)), byte)


def as_list(bits: Column) -> Column:
    """Numbers of the set bits, separated by commas."""
    return F.array_join(F.transform(bits, lambda b: b.cast("string")), ",")
