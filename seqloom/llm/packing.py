"""Retrieval packing: sequences of one length, filled with lexical neighbours of a seed document.

1. Texts are tokenised; each ends with one end id. Whole windows of long documents become sequences at once, the rest (the
   tail, shorter than a window) goes on with a min-hash signature of its bigrams.
2. Tails are range-partitioned by (signature, row number), so lexically close tails meet, and one signature that a third of
   all rows share is split. Statistics (document frequencies, mean length) are counted over all tails.
3. Each partition is read as a stream and cut into index shards of SHARD_TAILS tails. A shard has a BM25 inverted index.
   The first unused tail seeds a window; its best unused neighbours fill it in order of score, then, while there is room,
   the next unused tails; the last one is cut at the window's end and its rest seeds the next window. What is left at a
   partition's end is cut into sequences of powers of two, which need no padding.

Null and empty texts are a lone end id. Repeated rows are packed each on their own. Ties in score go to the tail that comes
first in its shard. Rows' other columns aren't read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import documents, listed, text_of, written

WINDOW, END = 2048, 1
#: Tails of one index shard; tails of one partition.
SHARD_TAILS, PARTITION_TAILS = 4096, 24_000
K1, B = 1.2, 0.75
#: Neighbours that are sorted at once.
FEW = 32
#: Frequent terms of a shard are those that one tail in RARE holds, so many at most; seeds that are scored at once.
FREQUENT, RARE, SEEDS = 4096, 64, 32
#: Words that a worker remembers the ids of before it forgets rare ones; characters that it splits at once.
REMEMBERED, BATCH_CHARS = 400_000, 8_000_000

_encoders: dict[str, Encoder] = {}


#: The pre-tokenizer's pieces in lower-case ASCII, where letters and digits are these alone.
_plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\r\x0b\x0ca-z0-9]+")
#: The same below U+0250, where NFC changes nothing and lower case is a matter of single characters.
_beyond = re.compile("[^\\x00-\\x84\\x86-\u024f]")
_LETTERS, _NUMBERS = "a-zªµºÀ-ÖØ-öø-\u02af\u2c65\u2c66", "0-9²³¹¼-¾"
_latin = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^ \t\n\r\x0b\x0c\xa0{_LETTERS}{_NUMBERS}]+")
PRE_TOKENIZER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def picked(sizes: np.ndarray, flat: np.ndarray, numbers: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of lists that lie one after the other: the sizes of those numbered, and their items one after the other."""
    starts = np.cumsum(sizes) - sizes if starts is None else starts
    own = sizes[numbers]
    ends = np.cumsum(own)
    return own, flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[numbers] - (ends - own), own)]


class Remembered(dict):
    """Keys by number, in order of first sight, and the list of ids behind each number; seldom used keys are forgotten."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.fresh = most, []
        self._empty()
        # white space at an end leaves an empty word
        self[""] = 0
        self.learn(np.zeros(1, np.int64), self.flat)
        self.uses[0] = 1 << 60

    def _empty(self) -> None:
        self.sizes = self.starts = self.uses = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def __missing__(self, key) -> int:
        n = self[key] = len(self)
        self.fresh.append(key)
        return n

    def numbers(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))

    def learn(self, sizes: np.ndarray, flat: np.ndarray) -> None:
        """The ids of the fresh keys, in their order."""
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
        self.sizes, self.flat = np.concatenate((self.sizes, sizes)), np.concatenate((self.flat, flat))
        self.uses = np.concatenate((self.uses, np.zeros(len(sizes), np.int64)))
        self.fresh = []

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return picked(self.sizes, self.flat, numbers, self.starts)

    def forget(self, numbers: np.ndarray, times: np.ndarray | int = 1) -> None:
        """Counts the uses of distinct numbers; beyond `most` keys, the half that was used less goes."""
        self.uses[numbers] += times
        if len(self) <= self.most:
            return
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: self.most // 2])
        keys = list(self)
        sizes, flat = self.gather(kept)
        uses = self.uses[kept] // 2
        uses[0] = 1 << 60
        self.clear()
        self.update((keys[i], n) for n, i in enumerate(kept.tolist()))
        self._empty()
        self.learn(sizes, flat)
        self.uses = uses


class Encoder:
    """Ids by a word-level BPE file, each distinct word encoded once while remembered.

    A text is normalised and split at ASCII white space, which the file's pre-tokenizer drops and no merge reaches over. A new word
    is split into the pieces that the pre-tokenizer gives; new pieces are encoded many to a call: an id that ends a word ends
    a piece. Texts that hold a special token's string, files of another make, and files whose pieces don't add up go to the
    library as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        with open(path) as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.pieces = Tokenizer.from_file(path)
        self.pieces.normalizer = normalizers.Sequence([])
        for t in (self.whole, self.pieces):
            t.no_truncation()
            t.no_padding()
        self.special = [x["content"] for x in spec["added_tokens"]]
        suffix = spec["model"].get("end_of_word_suffix")
        first = next((x for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"), None)
        later = [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])[1:]]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        self.ends = None
        if suffix and first and first["behavior"] == "Removed" and first["invert"] and first["pattern"].get("Regex") == PRE_TOKENIZER and kinds == ["NFC", "Replace", "Lowercase"] and later == [("ByteLevel", False, False)]:
            self.pattern = regex.compile(PRE_TOKENIZER)
            # pieces come one by one between spaces
            self.pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(self.whole.get_vocab_size(), bool)
            for token, i in self.whole.get_vocab().items():
                self.ends[i] = token.endswith(suffix)
        self.words = Remembered(REMEMBERED)

    def _normal(self, text: str) -> str:
        return self.whole.normalizer.normalize_str(text) if not text.isascii() and _beyond.search(text) else text.lower()

    def _split(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The pieces of all words, and where each word's begin and end among them."""
        joined = " ".join(words)
        pattern = _plain if joined.isascii() else self.pattern if _beyond.search(joined) else _latin
        pieces = pattern.findall(joined)
        upto = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        if len(pieces) and upto[-1] == ends[-1]:  # nothing is left out within words
            return pieces, np.concatenate(([0], np.searchsorted(upto, ends) + 1))
        each = [pattern.findall(w) for w in words]
        return list(chain.from_iterable(each)), np.cumsum([0, *map(len, each)])

    def _learn(self) -> bool:
        """Encodes the fresh words; whether the ids of all pieces could be told apart."""
        split, bounds = self._split(self.words.fresh)
        coded = pa.array(split, pa.string()).dictionary_encode()
        distinct, each, flat = listed(coded.dictionary), [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for at in range(0, len(distinct), 50_000):
            part = distinct[at : at + 50_000]
            ids = np.concatenate([np.asarray(x.ids, np.uint32) for x in self.pieces.encode_batch_fast([" ".join(part[i : i + 1000]) for i in range(0, len(part), 1000)], add_special_tokens=False)])
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part) or cuts[-1] != len(ids):
                return False
            each.append(np.diff(cuts, prepend=0))
            flat.append(ids)
        sizes, flat = picked(np.concatenate(each), np.concatenate(flat), coded.indices.to_numpy())
        upto = np.concatenate(([0], np.cumsum(sizes)))
        self.words.learn(np.diff(upto[bounds]), flat)
        return True

    def _direct(self, text: str) -> np.ndarray:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def _batch(self, part: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = [i for i, x in enumerate(part) if "<" in x and any(s in x for s in self.special)]
        if self.ends is not None:
            plain = list(part)
            for i in whole:
                plain[i] = ""
            split = pc.ascii_split_whitespace(pa.array(map(self._normal, plain), pa.string()))
            coded = split.flatten().dictionary_encode()
            distinct = self.words.numbers(listed(coded.dictionary))
            if self.words.fresh and not self._learn():
                self.ends = None
        if self.ends is None:
            each = [self._direct(x) for x in part]
            return np.concatenate(each), np.cumsum([0, *map(len, each)])
        at = coded.indices.to_numpy()
        sizes, flat = self.words.gather(distinct[at])
        self.words.forget(distinct, np.bincount(at, minlength=len(distinct)))
        bounds = np.concatenate(([0], np.cumsum(sizes)))[split.offsets.to_numpy()]
        if whole:
            each = np.split(flat, bounds[1:-1])
            for i in whole:
                each[i] = self._direct(part[i])
            return np.concatenate(each), np.cumsum([0, *map(len, each)])
        return flat, bounds

    def batches(self, texts: list[str]):
        """(ids one after the other, bounds of each text's) of some texts at a time."""
        at = 0
        while at < len(texts):
            end, chars = at + 1, len(texts[at])
            while end < len(texts) and chars + len(texts[end]) <= BATCH_CHARS:
                chars += len(texts[end])
                end += 1
            yield self._batch(texts[at:end])
            at = end

    def encode(self, texts: list[str]):
        """Each text's ids as little-endian 32-bit numbers."""
        for flat, bounds in self.batches(texts):
            data = flat.astype("<u4").tobytes()
            yield from (data[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))


def encoder(path: str) -> Encoder:
    """A worker's one encoder of a file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def signatures(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of each range: the least hash of its bigrams (of its id, where there is one only), the same for texts that share most of them."""
    with np.errstate(over="ignore"):
        x = flat.astype(np.uint64)
        pairs = np.append(x[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[1:], np.zeros(1, np.uint64))
        alone = end - start == 1
        pairs[start[alone]] = x[start[alone]]
        pairs = (pairs ^ (pairs >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        pairs = np.append(pairs ^ (pairs >> np.uint64(32)), np.zeros(1, np.uint64))
    around = np.stack((start, np.where(alone, end, end - 1)), 1).ravel()
    return (np.minimum.reduceat(pairs, around)[::2] >> np.uint64(1)).astype(np.int64) if len(start) else np.zeros(0, np.int64)


TAILS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, signature long, row long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _arrow(rows: list[tuple], schema: str):
    types = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), types[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _cut(path: str, window: int):
    def run(batches):
        base = TaskContext.get().partitionId() << 40
        row = sequence = base
        seen, own = Frequencies(), encoder(path)
        for batch in batches:
            keys, at = batch.column(0).to_pylist(), 0
            for flat, bounds in own.batches(batch.column(1).to_pylist()):
                # each text's ids and the end
                flat, bounds = np.insert(flat, bounds[1:], END).astype("<u4"), bounds + np.arange(len(bounds))
                n = np.diff(bounds)
                start = bounds[:-1] + n // window * window
                tailed = start < bounds[1:]
                seen.add(flat, start[tailed], bounds[1:][tailed])
                signature = iter(signatures(flat, start[tailed], bounds[1:][tailed]).tolist())
                data, rows = flat.tobytes(), []
                for doc, a, s, b in zip(keys[at : at + len(n)], bounds[:-1].tolist(), start.tolist(), bounds[1:].tolist(), strict=True):
                    for i in range(a, s, window):
                        rows.append((doc, i - a, window, zlib.crc32(data[4 * i : 4 * (i + window)]), b - a, sequence, None, None, None))
                        sequence += 1
                    if s < b:
                        rows.append((doc, s - a, b - s, None, b - a, None, next(signature), row, data[4 * s : 4 * b]))
                    row += 1
                at += len(n)
                yield _arrow(rows, TAILS)
        yield _arrow([seen.row()], TAILS)

    return run


class Frequencies:
    """Of a task's tails: how many hold each id, their number and their length."""

    def __init__(self):
        self.df, self.n, self.length = np.zeros(1 << 16, np.int64), 0, 0

    def add(self, flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """The tails that lie in these ranges."""
        sizes = end - start
        at = np.arange(sizes.sum()) + np.repeat(start - (np.cumsum(sizes) - sizes), sizes)
        keys = np.sort((np.repeat(np.arange(len(sizes)), sizes) << 32) | flat[at].astype(np.int64))
        ids = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] & 0xFFFFFFFF if len(keys) else keys
        found = np.bincount(ids, minlength=len(self.df))
        self.df = found + np.pad(self.df, (0, len(found) - len(self.df)))
        self.n, self.length = self.n + len(sizes), self.length + int(sizes.sum())

    def row(self) -> tuple:
        """As a row of the cut table, without a document: terms and counts packed."""
        terms = np.flatnonzero(self.df)
        return (None, -1, self.n, None, self.length, None, None, None, terms.astype("<u4").tobytes() + self.df[terms].astype("<i8").tobytes())


def _unpacked(batches):
    """(term, n) of tasks' frequency rows; their numbers of tails and of ids as terms -1 and -2."""
    for batch in batches:
        for n, length, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            k = len(data) // 12
            terms = np.concatenate((np.frombuffer(data, "<u4", k).astype(np.int64), [-1, -2]))
            yield pa.record_batch([pa.array(terms), pa.array(np.concatenate((np.frombuffer(data, "<i8", k, 4 * k), [n, length])))], ["term", "n"])


class Shard:
    """A BM25 inverted index over some tails, in which each tail is used once.

    Posting lists of frequent terms are rows of a matrix, by which some seeds are multiplied at once; the others are walked
    for each seed. Scores are of single precision.
    """

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float):
        self.lengths = np.array([len(x) for x in tails])
        n = len(tails)
        doc = np.repeat(np.arange(n), self.lengths)
        keys, tf = np.unique(np.concatenate(tails).astype(np.int64) * n + doc, return_counts=True)
        terms, docs = keys // n, keys % n
        norm = K1 * (1 - B + B * self.lengths / mean)
        weights = (idf[terms] * tf * (K1 + 1) / (tf + norm[docs])).astype(np.float32)
        _, term, df = np.unique(terms, return_inverse=True, return_counts=True)
        order = np.argsort(-df, kind="stable")[:FREQUENT]
        frequent = order[df[order] * RARE >= n]
        column = np.full(len(df), -1)
        column[frequent] = np.arange(len(frequent))
        often = column[term] >= 0
        self.dense = np.zeros((n, len(frequent)), np.float32)
        self.dense[docs[often], column[term[often]]] = weights[often]
        self.docs, self.weights, rare = docs[~often], weights[~often], term[~often]
        self.starts = np.searchsorted(rare, np.arange(len(df) + 1))
        own = np.argsort(self.docs, kind="stable")
        self.cuts = np.concatenate(([0], np.cumsum(np.bincount(self.docs, minlength=n))))
        self.own = rare[own]  # each tail's terms that aren't frequent
        self.free = np.ones(n, bool)
        self.next, self.unused = 0, n
        self.live, self.place = np.arange(n), np.arange(n)
        self.block: dict[int, np.ndarray] = {}

    def _compact(self, seed: int) -> None:
        """Takes used tails out of the index: none is returned again."""
        kept = self.free.copy()
        kept[seed] = True
        self.dense, self.live = self.dense[kept[self.live]], self.live[kept[self.live]]
        self.place[self.live] = np.arange(len(self.live))
        still = kept[self.docs]
        self.starts = np.concatenate(([0], np.cumsum(still)))[self.starts]
        self.docs, self.weights = self.docs[still], self.weights[still]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of the live tails against all of the seed's terms."""
        if seed not in self.block:
            if 4 * self.unused < 3 * len(self.live):
                self._compact(seed)
            # with the tails that are likely to be the next seeds
            seeds = np.append(seed, self.next + np.flatnonzero(self.free[self.next : self.next + 4 * SEEDS])[:SEEDS])
            some = (self.dense[self.place[seeds]] != 0).astype(np.float32) @ self.dense.T
            self.block = dict(zip(seeds.tolist(), some, strict=True))
        score = self.block[seed]
        mine = self.own[self.cuts[seed] : self.cuts[seed + 1]]
        if len(mine):
            spans = list(zip(self.starts[mine].tolist(), self.starts[mine + 1].tolist(), strict=True))
            docs, weights = (np.concatenate([x[a:b] for a, b in spans]) for x in (self.docs, self.weights))
            score = score + np.bincount(self.place[docs], weights, len(self.live))
        return score

    def neighbours(self, seed: int):
        """Unused tails by falling score against all of the seed's terms."""
        score = self.scores(seed)
        live = self.live
        score = np.where(self.free[live], score, 0)
        found = np.flatnonzero(score)
        if len(found) > 4 * FEW:  # the best few first; the rest is sorted only if they don't fill the window
            cut = np.partition(score[found], len(found) - FEW)[len(found) - FEW]
            best = found[score[found] >= cut]
            yield from live[best[np.argsort(-score[best], kind="stable")]].tolist()
            found = found[score[found] < cut]
        yield from live[found[np.argsort(-score[found], kind="stable")]].tolist()

    def first_free(self) -> int | None:
        while self.next < len(self.free) and not self.free[self.next]:
            self.next += 1
        return self.next if self.next < len(self.free) else None

    def use(self, tail: int) -> None:
        self.unused -= int(self.free[tail])
        self.free[tail] = False


def _pack(idf: np.ndarray, mean: float, window: int, shard_tails: int):
    def pack(parts, state, rows):
        """Adds the pieces of a shard to rows; state: [sequence, pieces of the open window, its fill]."""
        shard = Shard([np.frombuffer(x[6], "<u4") for x in parts], idf, mean)

        def put(i: int) -> None:
            doc, start, length, n, _, _, ids = parts[i]
            at = 0
            while at < length:
                take = min(length - at, window - state[2])
                state[1].append((doc, start + at, take, n, ids[4 * at : 4 * (at + take)]))
                state[2] += take
                at += take
                if state[2] == window:
                    offset = 0
                    for d, s, k, total, own in state[1]:
                        rows.append((d, s, k, zlib.crc32(own), total, state[0], offset))
                        offset += k
                    state[0], state[1], state[2] = state[0] + 1, [], 0
            shard.use(i)

        while (seed := shard.first_free()) is not None:
            put(seed)
            before = state[0]
            for i in shard.neighbours(seed):
                if state[0] != before or not state[2]:
                    break
                put(i)

    def run(batches):
        # above the whole windows' numbers, which start at partition * 2^40
        state = [(1 << 62) + (TaskContext.get().partitionId() << 36), [], 0]
        parts: list = []
        for batch in batches:
            parts += zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True)
            while len(parts) >= shard_tails:
                rows: list = []
                pack(parts[:shard_tails], state, rows)
                parts = parts[shard_tails:]
                yield _arrow(rows, PIECES)
        rows = []
        if parts:
            pack(parts, state, rows)
        left = state[2]  # cut by its binary digits: sequences of powers of two, unpadded
        open_pieces = list(state[1])[::-1]
        for bit in range(window.bit_length(), -1, -1):
            room, offset = left & 1 << bit, 0
            while room:
                d, s, k, total, own = open_pieces.pop()
                take = min(k, room)
                rows.append((d, s, take, zlib.crc32(own[: 4 * take]), total, state[0], offset))
                if take < k:
                    open_pieces.append((d, s + take, k - take, total, own[4 * take :]))
                offset, room = offset + take, room - take
            state[0] += bool(left & 1 << bit)
        yield _arrow(rows, PIECES)

    return run


def pack(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The pieces of all texts: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = df.sparkSession
    cut = df.select(df[key].cast("long").alias("doc_id"), text_of(df, text).alias("text")).mapInArrow(_cut(tokenizer, window), TAILS)
    cut = written(cut, "tails")
    whole = cut.where(F.col("ids").isNull()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))
    tails = cut.where(F.col("ids").isNotNull() & (F.col("start") >= 0))
    # a row a task, added up by term; one row for each id of the vocabulary at most comes to the driver
    counted = cut.where("start = -1").select("length", "doc_tokens", "ids").mapInArrow(_unpacked, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    stats = {r["term"]: r["n"] for r in counted.collect()}
    n, total = stats.pop(-1, 0), stats.pop(-2, 0)
    idf = np.zeros(max(stats, default=0) + 1)
    for term, df_ in stats.items():
        idf[term] = np.log1p((n - df_ + 0.5) / (df_ + 0.5))
    parts = max(1, -(-n // PARTITION_TAILS))
    near = tails.repartitionByRange(parts, "signature", "row").sortWithinPartitions("signature", "row")
    rest = near.select("doc_id", "start", "length", "doc_tokens", "signature", "row", "ids").mapInArrow(_pack(idf, total / max(n, 1), window, SHARD_TAILS), PIECES)
    return whole.unionByName(rest)


def op2_bm25_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
