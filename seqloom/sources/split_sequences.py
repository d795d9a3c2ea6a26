"""Sequence files and hash lists by byte ranges.

A split owns the records that begin in it. FASTA records begin at a '>' that begins a line, FASTQ records at an '@' line whose next but one
begins with '+' (four lines a record; no line of bases begins so), EMBL and GenBank records after a '//' line, and hash lists after
a value of ones. A split numbers what it owns; the counts of a file's splits, a row each, are summed up, and give each
record its number in its file. Files whose names end in .gz can't be cut and are one split.

`records` gives whole records. `pieces` cuts long sequences: every split gives the bases it holds, whosever record they belong to,
in rows of at most `piece` bases with `overlap` more of the same record after them, so that each run of overlap + 1 bases lies
in exactly one row; places are carried over from split to split by the same sums. A chromosome is many rows then.
"""

from __future__ import annotations

import io
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from .sequences import records as parsed
from .splits import SPLIT, Split, files, opened

#: Bytes that are read at once, and splits whose sums are sent to all tasks at most (some 60 bytes each).
CHUNK, FEW_SPLITS = 1 << 20, 200_000
RECORDS = "file string, split int, part long, id string, seq string"
PIECES = "file string, split int, part long, record int, id string, at long, own int, bases string"
LISTS = "file string, split int, part long, hashes array<long>"
COUNTS = "file string, split int, started long, tail long, last_id string"
_blank = re.compile(r"\s+")


class Lines:
    """Lines of a file from a byte on, with the byte each begins at; the file is read in chunks.

    With `partial`, long lines other than headers come in parts of a chunk or two; `continued` says whether the last one goes on from the one before.
    """

    def __init__(self, f, start: int = 0, partial: bool = False):
        self.f, self.at, self.partial, self.continued = f, start, partial, False
        f.seek(start)

    def __iter__(self):
        parts: list[bytes] = []  # of a line longer than a chunk
        goes_on = False
        while chunk := self.f.read(CHUNK):
            cut = chunk.split(b"\n")
            for x in cut[:-1]:
                line = b"".join([*parts, x])
                parts, self.continued, goes_on = [], goes_on, False
                yield self.at, line
                self.at += len(line) + 1
            if cut[-1]:
                parts.append(cut[-1])
            if self.partial and parts and (goes_on or parts[0][:1] != b">"):
                line = b"".join(parts)
                parts, self.continued, goes_on = [], goes_on, True
                yield self.at, line
                self.at += len(line)
        if parts:
            self.continued = goes_on
            yield self.at, b"".join(parts)


def kind_of(f) -> str:
    """The format by the first line that isn't empty."""
    for _, line in Lines(f):
        if line.strip():
            return {b">": "fasta", b"@": "fastq"}.get(line[:1], "entry" if line.startswith((b"ID ", b"LOCUS")) else "")
    return ""


def from_start(f, kind: str, start: int):
    """(place, line) from the first record on that begins at `start` or later."""
    if start == 0:
        yield from Lines(f)
        return
    back = max(0, start - 65)
    f.seek(back)
    before = f.read(start - back)
    lines = iter(Lines(f, start - 1))
    cut = next(lines, (0, b""))[1]  # the rest of a line that begins before `start`; nothing but its end, if one begins there
    if kind == "fastq":
        ahead: list[tuple[int, bytes]] = []
        for x in lines:
            ahead.append(x)
            if len(ahead) > 2:
                if ahead[0][1][:1] == b"@" and ahead[2][1][:1] == b"+":
                    yield from ahead
                    yield from lines
                    return
                ahead.pop(0)
    elif kind == "fasta":
        for x in lines:
            if x[1][:1] == b">":
                yield x
                yield from lines
                return
    else:  # an entry begins after the end of one, which may be the last line before `start`
        last = before.rstrip(b"\r\n") if before.endswith(b"\n") else before[:-1] + cut
        begun = last.rpartition(b"\n")[2].rstrip() == b"//"
        for x in lines:
            if begun and x[1].strip():
                yield x
                yield from lines
                return
            begun = begun or x[1].rstrip() == b"//"


def owned(f, kind: str, start: int, end: int):
    """Text lines of the records that begin in [start, end)."""
    open_, number = kind == "entry", 0
    inside = not open_
    for at, line in from_start(f, kind, start):
        if kind == "fasta" and line[:1] == b">" and at >= end:
            return
        if kind == "fastq":
            if number % 4 == 0 and at >= end:
                return
            number += bool(line.strip()) or number % 4 != 0
        if kind == "entry":
            if not inside and line.strip():
                if at >= end:
                    return
                inside = True
            if line.rstrip() == b"//":
                inside = False
        yield line.decode("utf-8", "replace")


class Bases:
    """Pieces of FASTA and FASTQ sequences whose bases lie in [start, end), each with the bases of its record that follow it.

    `record` counts the records that begin in the split: 0 is the one that goes on from before it.
    """

    def __init__(self, piece: int, overlap: int):
        self.piece, self.overlap = piece, overlap

    def fasta(self, f, start: int, end: int):
        """(record, id of one that begins here, place within the split, own bases, bases)."""
        record, name, at, held, own_end = 0, None, 0, "", None
        own = start
        lines = Lines(f, 0 if start == 0 else start - 1, partial=True)
        first, skipping = start > 0, False

        def cut(final: bool):
            nonlocal held, at, own_end
            while held:
                limit = len(held) if own_end is None else own_end
                if limit <= 0:
                    held = ""
                    return
                n = min(self.piece, limit)
                if not final and len(held) < n + self.overlap:
                    return
                if not final and n < self.piece and own_end is None:
                    return
                yield record, name, at, n, held[: n + self.overlap]
                held, at = held[n:], at + n
                if own_end is not None:
                    own_end -= n

        for place, line in lines:
            begins = not first and not lines.continued
            if first:  # a line cut by the split: the part from `start` on, or nothing
                first = False
                line, place = line[start - place :], start
                skipping = self._in_header(f, start)
            skipping = skipping and not begins
            if skipping:
                continue
            if begins and line[:1] == b">":
                if place >= end:
                    break
                yield from cut(True)
                record, name, at, held, own_end = record + 1, line[1:].strip().decode("utf-8", "replace"), 0, "", None
                yield record, name, 0, 0, ""
                continue
            text = _blank.sub("", line.decode("utf-8", "replace"))
            if own_end is None and place + len(line) >= end:  # the last own bases lie in this line
                own_end = len(held) + len(_blank.sub("", line[: max(0, end - place)].decode("utf-8", "replace")))
            held += text
            yield from cut(False)
            if own_end is not None and (own_end <= 0 or len(held) >= own_end + self.overlap):
                break
        yield from cut(True)

    @staticmethod
    def _in_header(f, start: int) -> bool:
        """Whether byte `start` lies within (not at the begin of) a header line."""
        at, seen = start, f.tell()
        try:
            while at > 0:
                back = max(0, at - 4096)
                f.seek(back)
                data = f.read(at - back)
                cut = data.rfind(b"\n")
                if cut >= 0:
                    f.seek(back + cut + 1)
                    return back + cut + 1 < start and f.read(1) == b">"
                at = back
            f.seek(0)
            return start > 0 and f.read(1) == b">"
        finally:
            f.seek(seen)


def _lists(f, start: int, end: int):
    """Hash lists that begin in [start, end): arrays; values are 8 bytes and one of ones ends a list."""
    start, end = -(-start // 8) * 8, -(-end // 8) * 8
    at = start - 8 if start else 0
    f.seek(at)
    skipping, parts = start > 0, []
    begun = start  # where the list that is read begins
    while begun < end:
        raw = f.read(CHUNK)
        values = np.frombuffer(raw[: len(raw) // 8 * 8], np.uint64)
        if not len(values):
            return
        ends = np.flatnonzero(values == np.uint64(0xFFFFFFFFFFFFFFFF))
        low = 0
        for e in ends.tolist():
            if not skipping:
                yield np.concatenate([*parts, values[low:e]]) if parts else values[low:e]
            skipping, parts, low = False, [], e + 1
            begun = at + 8 * low
            if begun >= end:
                return
        if not skipping and low < len(values):
            parts.append(values[low:].copy())
        at += 8 * len(values)


def _unpacked(path: str):
    """A file, to be read from any byte on; a packed one as a whole."""
    store, own = opened(path)
    return io.BytesIO(store.open_input_stream(own, compression="gzip").read()) if path.endswith(".gz") else store.open_input_file(own)


class SplitSource(DataSource):
    """spark.read.format("split-sequences").option("paths", "a,b").option("mode", "records" | "pieces" | "lists" | "counts").load()"""

    @classmethod
    def name(cls) -> str:
        return "split-sequences"

    def schema(self) -> str:
        return {"records": RECORDS, "pieces": PIECES, "lists": LISTS}.get(self.options.get("mode", "records"), COUNTS)

    def reader(self, schema) -> DataSourceReader:
        return SplitReader(dict(self.options))


class SplitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.mode, self.of = options.get("mode", "records"), options.get("of", "records")
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.size = int(options.get("split", SPLIT))
        self.bases = Bases(int(options.get("piece", CHUNK)), int(options.get("overlap", 0)))

    def partitions(self) -> list[Split]:
        return [Split(path, at, size if path.endswith(".gz") else min(at + self.size, size)) for path, size in files(self.paths) for at in range(0, max(1, 1 if path.endswith(".gz") else size), self.size)]

    def _rows(self, what: str, s: Split):
        """What the split holds, in order."""
        with _unpacked(s.path) as f:
            end = s.end if not s.path.endswith(".gz") else 1 << 62
            if what == "lists":
                yield from _lists(f, s.start, end)
                return
            kind = kind_of(f)
            f.seek(0)
            if what == "pieces" and kind == "fasta":
                yield from self.bases.fasta(f, s.start, end)
                return
            whole = parsed(owned(f, kind, s.start, end)) if kind else iter(())
            if what == "records":
                yield from whole
                return
            for i, (name, seq) in enumerate(whole):  # formats of short records: a record's pieces come from its own split
                yield i + 1, name, 0, 0, ""
                for at in range(0, len(seq), self.bases.piece):
                    yield i + 1, name, at, min(self.bases.piece, len(seq) - at), seq[at : at + self.bases.piece + self.bases.overlap]

    def read(self, s: Split):
        number = s.start // self.size
        if self.mode == "counts":
            started, tail, last = 0, 0, None
            for x in self._rows(self.of, s):
                if self.of != "pieces":
                    started += 1
                elif not x[3]:  # a record begins
                    started, tail, last = started + 1, 0, x[1]
                else:
                    tail += x[3]
            yield s.path, number, started, tail, last
            return
        for i, x in enumerate(self._rows(self.mode, s)):
            if self.mode == "records":
                yield s.path, number, i, *x
            elif self.mode == "lists":
                yield s.path, number, i, x.astype(np.int64).tolist()
            else:
                yield s.path, number, i, *x


def _loaded(spark: SparkSession, paths: tuple[str, ...], **options) -> DataFrame:
    spark.dataSource.register(SplitSource)
    return spark.read.format("split-sequences").options(paths=",".join(paths), **options).load()


def _sums(spark: SparkSession, paths: tuple[str, ...], of: str, **options) -> DataFrame:
    """(file, split, before, carried, from_id): records of the file's splits before, bases of the record that goes on, and its id."""
    counts = _loaded(spark, paths, mode="counts", of=of, **options)
    order = Window.partitionBy("file").orderBy("split")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.withColumn("before", F.coalesce(F.sum("started").over(before), F.lit(0))).withColumn("from_id", F.last("last_id", True).over(before))
    # splits since one in which a record began
    rows = rows.withColumn("run", F.sum((F.col("started") > 0).cast("int")).over(order))
    rows = rows.withColumn("upto", F.sum("tail").over(Window.partitionBy("file", "run").orderBy("split")))
    out = rows.withColumn("carried", F.coalesce(F.lag("upto").over(order), F.lit(0))).select(F.col("file").alias("of"), F.col("split").alias("no"), "before", "carried", "from_id")
    return out


def _numbered(rows: DataFrame, sums: DataFrame) -> DataFrame:
    from .storage import written

    sums = written(sums, "splits")
    few = sums.count() <= FEW_SPLITS
    return rows.join(F.broadcast(sums) if few else sums, (F.col("file") == F.col("of")) & (F.col("split") == F.col("no")))


def records(spark: SparkSession, *paths: str, split: int = SPLIT) -> DataFrame:
    """(file, seq_id, id, seq) of files and folders, one task a split; seq_id is the record's number in its file."""
    rows = _numbered(_loaded(spark, paths, mode="records", split=split), _sums(spark, paths, "records", split=split))
    return rows.select("file", (F.col("before") + F.col("part")).alias("seq_id"), "id", "seq")


def pieces(spark: SparkSession, *paths: str, overlap: int = 0, piece: int = CHUNK, split: int = SPLIT) -> DataFrame:
    """(file, seq_id, id, at, own, bases): `own` bases of a record from its place `at` on, followed by up to `overlap` more of it.

    A record without bases has no rows.
    """
    options = {"split": split, "piece": piece, "overlap": overlap}
    rows = _numbered(_loaded(spark, paths, mode="pieces", **options), _sums(spark, paths, "pieces", **options)).where("own > 0")
    goes_on = F.col("record") == 0
    return rows.select("file", (F.col("before") + F.col("record") - 1).alias("seq_id"), F.when(goes_on, F.col("from_id")).otherwise(F.col("id")).alias("id"), (F.col("at") + F.when(goes_on, F.col("carried")).otherwise(0)).alias("at"), "own", "bases")


def hash_lists(spark: SparkSession, *paths: str, split: int = SPLIT) -> DataFrame:
    """(file, seq_id, hashes) of hash-list files and folders, by byte ranges."""
    rows = _numbered(_loaded(spark, paths, mode="lists", split=split), _sums(spark, paths, "lists", split=split))
    return rows.select("file", (F.col("before") + F.col("part")).alias("seq_id"), "hashes")


def piece_kmers(rows: DataFrame, k: int) -> DataFrame:
    """(file, seq_id, pos, h): all k-mers of sequences in pieces that overlap by k - 1 at least, with their places in the sequence."""
    from ..functions import kmers

    bases = kmers.coerce_dna(F.substring("bases", 1, F.col("own") + F.lit(k - 1)))
    found = rows.select("file", "seq_id", "at", F.posexplode(kmers.kmers(bases, k)).alias("i", "h"))
    return found.select("file", "seq_id", (F.col("at") + F.col("i")).alias("pos"), "h")
