"""Incremental assignment: new sequences of a stream against the nodes of a built tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import SketchConfig
from ..operators import clustering, sketches


def assign_stream(seqs: DataFrame, nodes: DataFrame, cfg: SketchConfig, path: str, checkpoint: str) -> StreamingQuery:
    """Appends (seq_id, cluster, similarity) of each micro-batch of a streaming (seq_id, seq) table to `path`.

    A batch replayed after a failure writes its own folder again, so it is stored once.
    """

    def batch(df: DataFrame, number: int) -> None:
        clustering.assign_to_nodes(sketches.flat(df, cfg), nodes).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return seqs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
