"""CSV results and tree files, in and out."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, functions as F

EDGES, COUNTS, CLUSTERS, HIERARCHY = "i long, j long, similarity double", "i long, count long", "seq_id long, cluster long", "parent long, child long, rank int"


def edges(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, similarity in per cent)."""
    return spark.read.csv(path, schema=EDGES, header=True)


def counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=COUNTS, header=True)


def clusters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=CLUSTERS)


def merge_config(spark: SparkSession, path: str) -> dict[str, str]:
    """Column name -> path."""
    return {r["name"]: r["path"] for r in spark.read.csv(path, schema="name string, path string").collect()}


def merged(spark: SparkSession, config: str) -> DataFrame:
    """Count tables named by a config file, side by side."""
    from ..operators.evaluate import merge_counts

    return merge_counts({name: counts(spark, path) for name, path in merge_config(spark, config).items()})


def skipping(spark: SparkSession, path: str, skip: int, header: bool = True, sep: str = ",") -> DataFrame:
    """A CSV file after `skip` lines, columns by its header as strings; lines keep the order of the file."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    first = lines.orderBy("at").limit(skip + int(header)).collect()
    start = first[-1]["at"] if first else -1
    cells = lambda line: next(csv.reader([line], delimiter=sep), [])
    body = lines.where(F.col("at") > start)
    names = [x.strip() for x in cells(first[-1]["value"])] if header and len(first) > skip else None
    names = names or [f"_c{i}" for i in range(len(cells((body.first() or {"value": ""})["value"])))]
    if not names:
        return body.select()
    parts = F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(names))), {"sep": sep})
    return body.select(parts.alias("x")).select(*[F.trim(f"x.c{i}").alias(name) for i, name in enumerate(names)])


def write_edges(pairs: DataFrame, path: str) -> None:
    """Per cent with two decimals, as the format has it."""
    pairs.select("i", "j", F.format_string("%.2f", 100 * F.col("similarity")).alias("similarity")).write.csv(path, header=True)


def write_counts(df: DataFrame, path: str) -> None:
    df.select("i", "count").write.csv(path, header=True)


def write_clusters(df: DataFrame, path: str) -> None:
    df.select("seq_id", "cluster").write.csv(path)


def write_mers(df: DataFrame, path: str) -> None:
    """A '>' line before each mer."""
    df.select(F.concat(F.lit(">\n"), F.col("mer"))).write.text(path)


def tree(spark: SparkSession, path: str) -> DataFrame:
    """(parent, child, priority, type) of a topology file: width, last node, then parent(priority)type>child,child,"""
    lines = spark.read.text(path).where(F.col("value").contains(">"))
    r = lambda i: F.regexp_extract("value", r"^(\d+)\(([^)]*)\)([^>]*)>(.*)$", i)
    rows = lines.select(r(1).cast("long").alias("parent"), r(2).cast("double").alias("priority"), r(3).alias("type"), F.explode(F.split(r(4), ",")).alias("child"))
    return rows.where("child <> ''").select("parent", F.col("child").cast("long").alias("child"), "priority", "type")


def write_tree(nodes: list[tuple[int, int, float, str]], width: int) -> str:
    """Text of a topology file from (node, parent, priority, type)."""
    below: dict[int, list[int]] = {}
    for node, parent, _, _ in nodes:
        below.setdefault(parent, []).append(node)
    about = {n: (p, t) for n, _, p, t in nodes}
    lines = [str(width), str(max((n for n, *_ in nodes), default=0))]
    for parent in sorted(below):
        priority, kind = about.get(parent, (0.0, "r"))
        lines.append(f"{parent}({priority:g}){kind}>" + "".join(f"{c}," for c in below[parent]))
    return "\n".join(lines) + "\n"


def sbt(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, depth, name, parent line) of a tree in which leading stars give the depth. A file comes whole to a task."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows, last = [], {}
                for i, line in enumerate(content.decode("utf-8", "replace").splitlines()):
                    if line:
                        name = line.lstrip("*")
                        depth = len(line) - len(name)
                        last[depth] = i
                        rows.append((i, depth, name, last.get(depth - 1)))
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int32()), strict=True)], ["line_no", "depth", "name", "parent"]) if rows else pa.record_batch([pa.array([], t) for t in (pa.int32(), pa.int32(), pa.string(), pa.int32())], ["line_no", "depth", "name", "parent"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "line_no int, depth int, name string, parent int")
