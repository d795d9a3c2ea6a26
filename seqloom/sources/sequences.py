"""Readers of sequence files. Ids are the record's place in its file, which the format itself gives."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, seq_id long, id string, seq string"


def records(lines: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(header, sequence) of FASTA ('>'), FASTQ ('@', qualities left out), EMBL and GenBank lines."""
    header, parts, kind, seq_done = None, [], "", False
    for line in lines:
        line = line.rstrip("\r\n")
        if kind in ("embl", "genbank"):
            if line.startswith("//"):
                yield header or "", "".join(parts)
                header, parts, kind, seq_done = None, [], "", False
            elif (kind == "embl" and line.startswith("SQ")) or (kind == "genbank" and line.startswith("ORIGIN")):
                seq_done = True
            elif seq_done:
                parts.append("".join(c for c in line if c.isalpha()))
        elif kind == "fastq":
            if line.startswith("+") and not seq_done:
                seq_done = True
                left = sum(map(len, parts))
                if not left:
                    yield header or "", ""
                    header, parts, kind, seq_done = None, [], "", False
            elif seq_done:
                left -= len(line)
                if left <= 0:
                    yield header or "", "".join(parts)
                    header, parts, kind, seq_done = None, [], "", False
            else:
                parts.append(line.strip())
        elif line.startswith(">"):
            if kind == "fasta":
                yield header or "", "".join(parts)
            header, parts, kind = line[1:].strip(), [], "fasta"
        elif kind == "fasta":
            parts.append("".join(line.split()))
        elif line.startswith("@"):
            header, parts, kind, seq_done = line[1:].strip(), [], "fastq", False
        elif line.startswith("ID "):
            header, parts, kind, seq_done = line[3:].split(";")[0].strip(), [], "embl", False
        elif line.startswith("LOCUS"):
            header, parts, kind, seq_done = (line.split() + ["", ""])[1], [], "genbank", False
    if kind == "fasta":
        yield header or "", "".join(parts)


def read(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(file, seq_id, id, seq) of a file or folder, through Spark's own readers, so any store they reach will do.

    A file is one record for its task; split_sequences reads large files by byte ranges.
    """
    import pyarrow as pa

    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "content")

    def parse(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(records(iter(content.decode("utf-8", "replace").split("\n"))))
                yield pa.record_batch([pa.array([file] * len(rows)), pa.array(range(len(rows)), pa.int64()), pa.array([h for h, _ in rows], pa.string()), pa.array([s for _, s in rows], pa.string())], ["file", "seq_id", "id", "seq"])

    return files.mapInArrow(parse, SCHEMA)


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq) of FASTA files, by byte ranges; only a '>' that begins a line begins a record."""
    from . import split_sequences

    return split_sequences.records(spark, path).select("id", "seq")


class FileList(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class SequenceSource(DataSource):
    """spark.read.format("sequences").option("paths", "a,b").load(): files of a shared file system, one task each."""

    @classmethod
    def name(cls) -> str:
        return "sequences"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        paths = [p for p in self.options.get("paths", self.options.get("path", "")).split(",") if p]

        class Reader(DataSourceReader):
            def partitions(self):
                return [FileList(p) for p in paths]

            def read(self, partition):
                with open(partition.path, encoding="utf-8", errors="replace") as f:
                    for i, (header, seq) in enumerate(records(f)):
                        yield partition.path, i, header, seq

        return Reader()


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files of a folder: (path, length)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")
