"""Signature files by byte ranges: a splittable reader, and a writer that commits.

A file is a 64-bit little-endian width in bytes and then records of that width, so a task can start at any record. Files are
reached by pyarrow's file systems (local and shared folders, HDFS, object stores). A writer's task makes a file of its own under
a hidden name; only those of successful tasks are renamed when the job commits, so a retried or speculative task leaves nothing.
"""

from __future__ import annotations

import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of one split; so many splits at least are made of files before small splits grow (to SPLIT at most).
SPLIT, MANY = 64 << 20, 256
ROWS = "path string, record long, bits array<int>"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def files(paths: list[str]) -> list[tuple[str, int]]:
    """(path, bytes) of files, and of those in folders; hidden ones are left out."""
    out = []
    for path in paths:
        store, own = opened(path)
        info = store.get_file_info(own)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = store.get_file_info(fs.FileSelector(own)) if info.type == fs.FileType.Directory else [info]
        scheme = path.split("://")[0] + "://" if "://" in path else ""
        out += [(scheme + x.path, x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith((".", "_"))]
    return sorted(out)


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


def bit_lists(data: np.ndarray) -> pa.Array:
    """Set bits of each row of bytes, as lists."""
    # few bytes hold bits, so only these are unpacked
    at, byte = np.nonzero(data)
    which, low = np.nonzero(np.unpackbits(data[at, byte][:, None], axis=1, bitorder="little"))
    row, bit = at[which], byte[which] * 8 + low
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(data))))).astype(np.int32), pa.array(bit.astype(np.int32)))


class SignatureSource(DataSource):
    """spark.read.format("signatures").option("paths", "a,b").load(): (path, record, bits) of every record, zeros too.

    spark.write.format("signatures").option("bits", n).save(folder) of (bits): each task's rows as one flat file.
    """

    @classmethod
    def name(cls) -> str:
        return "signatures"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return Reader([p for p in self.options.get("paths", self.options.get("path", "")).split(",") if p], int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite) -> DataSourceArrowWriter:
        return Writer(self.options["path"], int(self.options["bits"]), overwrite)


def grown(split: int, total: int) -> int:
    """Bytes of a split: what was asked for, or more where files would fall into more than MANY, so that tasks don't outgrow the machines."""
    return max(split, min(SPLIT, -(-total // MANY)))


class Reader(DataSourceReader):
    def __init__(self, paths: list[str], split: int):
        self.paths, self.split = paths, split

    def partitions(self) -> list[Split]:
        found = files(self.paths)
        split = grown(self.split, sum(size for _, size in found))
        return [Split(path, at, min(at + split, size)) for path, size in found for at in range(8, max(size, 9), split)]

    def read(self, partition: Split):
        store, path = opened(partition.path)
        with store.open_input_file(path) as f:
            head = f.read(8)
            width = struct.unpack("<Q", head)[0] if len(head) == 8 else 0
            if not width:
                return
            # records that begin in the split; one cut short at the file's end is left out
            first, last = (max(0, -(-(x - 8) // width)) for x in (partition.start, partition.end))
            whole = (f.size() - 8) // width
            step = max(1, (4 << 20) // width)
            for at in range(first, min(last, whole), step):
                n = min(step, min(last, whole) - at)
                data = np.frombuffer(f.read_at(n * width, 8 + at * width), np.uint8).reshape(n, width)
                yield pa.record_batch([pa.array([partition.path] * n, pa.string()), pa.array(np.arange(at, at + n)), bit_lists(data)], ["path", "record", "bits"])


@dataclass
class Made(WriterCommitMessage):
    path: str | None


class Writer(DataSourceArrowWriter):
    """Rows with a column of bits; null bits are a record of zeros."""

    def __init__(self, folder: str, bits: int, overwrite: bool):
        self.folder, self.width, self.overwrite, self.job = folder, bits // 8, overwrite, uuid.uuid4().hex

    def write(self, batches) -> Made:
        from pyspark import TaskContext

        store, folder = opened(self.folder)
        context = TaskContext.get()
        made, out = None, None
        for batch in batches:
            if not len(batch):
                continue
            if out is None:
                store.create_dir(folder, recursive=True)
                made = f"{folder}/.{self.job}-{context.partitionId():06d}-{context.taskAttemptId()}"
                out = store.open_output_stream(made)
                out.write(struct.pack("<Q", self.width))
            rows = np.zeros((len(batch), self.width), np.uint8)
            lists = batch.column(batch.schema.get_field_index("bits"))
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            bits = lists.flatten().to_numpy()
            if len(wrong := bits[(bits < 0) | (bits >= 8 * self.width)]):
                raise IndexError(f"index {wrong[0]} is out of {8 * self.width} bits")
            np.bitwise_or.at(rows, (np.repeat(np.arange(len(batch)), lengths), bits >> 3), (1 << (bits & 7)).astype(np.uint8))
            out.write(rows.tobytes())
        if out is not None:
            out.close()
        return Made(made)

    def commit(self, messages) -> None:
        store, folder = opened(self.folder)
        store.create_dir(folder, recursive=True)
        if self.overwrite:
            for path, _ in files([self.folder]):
                store.delete_file(opened(path)[1])
        for m in messages:
            if m is not None and m.path:
                part = m.path.rpartition("/")[2].split("-")
                store.move(m.path, f"{folder}/part-{part[1]}-{part[0].lstrip('.')}.bin")
        self._swept(store, folder)

    def abort(self, messages) -> None:
        store, folder = opened(self.folder)
        self._swept(store, folder)

    def _swept(self, store, folder: str) -> None:
        """What this job's other attempts left."""
        for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if x.base_name.startswith(f".{self.job}-"):
                store.delete_file(x.path)
