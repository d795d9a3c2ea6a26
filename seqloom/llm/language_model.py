"""Scores by a hierarchical Pitman-Yor bigram model.

Every context (the word before; before a text's first word, an end) is a restaurant whose customers are the words that follow
it in the training texts. All contexts share one parent, the unigram restaurant, whose customers are their tables; its own
parent is uniform over the V known words and one unknown. A customer sits at a table of its word by (size - discount) or at a new
one by (concentration + discount * tables) * parent's probability. Tables are sampled by Gibbs, a word's at a time: all of its
customers, however many, get up, and the number of tables they take again is drawn given the other words' tables. From settled
expectations on, sweeps go over all words at once. Table counts are averaged over the sweeps after burn-in, and the predictive
probability is that of the averages: an approximation of the average of the sweeps' own probabilities, equal to it only while
the parent's stay the same.

Counts are exchanged in blocks and buckets (see blocks): a context's words all meet in one bucket, as one entry a block, so a
frequent word costs no more than its distinct followers. While contexts are seated, the parent's probability is taken from
the words' training frequencies, to an eighth of an octave; the parent is seated after them, from their tables.

Nulls and empty texts are one end. Texts of rows without an id belong to training (their id's text is empty). Repeated rows
are scored alike, and each counts in training.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from .blocks import Blocks, bucket_of, buckets_for, in_buckets, release
from .common import coded_words, documents, new_path
from .substring_dedup import schema_table

END = np.uint64(0x5EED5EED5EED5EED)
#: Concentrations of contexts and of their parent; the parent's discount (contexts' is estimated from their counts).
STRENGTH, ROOT_STRENGTH, ROOT_DISCOUNT = 1.0, 1.0, 0.7
#: Sweeps, each of which seats all customers anew, and those that aren't averaged.
SWEEPS, BURN_IN = 4, 1
#: Before them, expected tables count as settled when a context's change by less than this share; rounds until then at most.
SETTLED, ROUNDS = 1e-3, 200
#: Customers of a word up to which its tables are drawn by their exact law; of more, their expectation is taken.
EXACT = 64
BLOCK = 16_000_000
SENT = "kind int, bucket int, block long, n long, data binary"
#: Kinds of rows: counts asked and answered, followers asked and answered, tables for the parent, the parent asked and
#: answered, and sums for the driver.
WORDS, FOLLOWERS, TABLES, PARENT, SUMS = range(5)

def held_out(key) -> bool:
    return zlib.crc32(("" if key is None else str(key)).encode()) % 5 == 1


class Tokens:
    """A block's tokens, by the words' order of hash."""

    def __init__(self, table: pa.Table):
        order = np.argsort(table["place"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        self.keys = table["c0"].to_pylist()
        self.block = table["block"][0].as_py()
        hashes, at, bounds = coded_words(table["t"], lower=True)
        self.lengths = np.diff(bounds) + 1
        self.words, place = np.unique(np.append(hashes, END), return_inverse=True)
        # each text's words and the end
        self.at = np.insert(place[at], bounds[1:], place[-1])
        used = np.bincount(self.at, minlength=len(self.words)) > 0
        self.words, self.at = self.words[used], (np.cumsum(used) - 1)[self.at]
        self.held = np.array([held_out(k) for k in self.keys])
        self.train = np.repeat(~self.held, self.lengths)
        before = np.concatenate((np.searchsorted(self.words, [END]), self.at[:-1]))
        pairs, which = np.unique(before * len(self.words) + self.at, return_inverse=True)
        self.before, self.after, self.which = pairs // len(self.words), pairs % len(self.words), which

    def counts(self) -> np.ndarray:
        return np.bincount(self.at, weights=self.train, minlength=len(self.words)).astype(np.int64)

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.which, weights=self.train, minlength=len(self.before)).astype(np.int64)


def _rows(rows: list[tuple]) -> pa.Table:
    k, b, x, n, data = zip(*rows, strict=True) if rows else ((), (), (), (), ())
    return pa.table({"kind": pa.array(k, pa.int32()), "bucket": pa.array(b, pa.int32()), "block": pa.array(x, pa.int64()), "n": pa.array(n, pa.int64()), "data": pa.array(data, pa.binary())})


def _small(x: np.ndarray) -> bytes:
    """Counts in a byte each; those of 255 and more follow in whole."""
    big = np.flatnonzero(x >= 255)
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[big].astype(np.int64).tobytes()


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, dtype, n: int) -> np.ndarray:
        out = np.frombuffer(self.data, dtype, n, self.at)
        self.at += out.nbytes
        return out

    def small(self, n: int) -> np.ndarray:
        out = self.take(np.uint8, n).astype(np.int64)
        big = np.flatnonzero(out == 255)
        out[big] = self.take(np.int64, len(big))
        return out


def _slices(bucket: np.ndarray, buckets: int):
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    return [(b, int(cuts[b]), int(cuts[b + 1])) for b in range(buckets) if cuts[b + 1] > cuts[b]]


def _words_six(h: np.ndarray) -> bytes:
    """48 bits of each hash."""
    return (h >> np.uint64(32)).astype(np.uint32).tobytes() + (h >> np.uint64(16)).astype(np.uint16).tobytes()


def _read_six(r: Reader, n: int) -> np.ndarray:
    return (r.take(np.uint32, n).astype(np.uint64) << np.uint64(32)) | (r.take(np.uint16, n).astype(np.uint64) << np.uint64(16))


def _answers(rows: pa.Table, kind: int) -> list[bytes]:
    """A block's answers of one kind, by bucket."""
    some = rows.filter(pa.array(rows["kind"].to_numpy() == kind))
    data = some["data"].to_pylist()
    return [data[i] for i in np.argsort(some["bucket"].to_numpy(), kind="stable")]


# ---- words


def _ask_words(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        t = Tokens(table)
        c = t.counts()
        return _rows([(WORDS, b, t.block, j - i, t.words[i:j].tobytes() + _small(c[i:j])) for b, i, j in _slices(bucket_of(t.words, buckets), buckets)])

    return run


def _count_words(rows: pa.Table) -> pa.Table:
    asked = list(zip(rows["bucket"].to_pylist(), rows["block"].to_pylist(), rows["n"].to_pylist(), rows["data"].to_pylist(), strict=True))
    keys, counts = [], []
    for _, _, n, data in asked:
        r = Reader(data)
        keys.append(r.take(np.uint64, n))
        counts.append(r.small(n))
    _, group = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(group, weights=np.concatenate(counts)).astype(np.int64)
    out, at = [], 0
    for bucket, block, n, _ in asked:
        out.append((WORDS, bucket, block, n, _small(total[group[at : at + n]])))
        at += n
    out.append((SUMS, asked[0][0], -1, int((total > 0).sum()), np.array([total.sum()], np.float64).tobytes()))
    return _rows(out)


def _word_counts(rows: pa.Table, n: int) -> np.ndarray:
    data = _answers(rows, WORDS)
    out = []
    ns = rows.filter(pa.array(rows["kind"].to_numpy() == WORDS))
    for x, k in zip(data, np.sort(ns["bucket"].to_numpy()), strict=True):
        size = int(ns["n"].to_numpy()[ns["bucket"].to_numpy() == k][0])
        out.append(Reader(x).small(size))
    return np.concatenate(out) if out else np.zeros(n, np.int64)


# ---- seating


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, by Stirling's series six places further on."""
    y = x + 6
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))


def ways(d: float) -> list[np.ndarray]:
    """By customers c up to EXACT: at t - 1, the ways to seat them at t + 1 tables over those at t (weights of joining a table included)."""
    out, logs = [np.zeros(0), np.zeros(0)], np.zeros(1)
    for c in range(1, EXACT):
        join = np.append(logs + np.log(c - d * np.arange(1, c + 1)), -np.inf)
        logs = np.logaddexp(join, np.concatenate(([-np.inf], logs)))
        out.append(np.exp(np.diff(logs)))
    return out


def many_tables(c: np.ndarray, new: np.ndarray, d: float) -> np.ndarray:
    """Expected tables of many customers, where a new table has weight new and an old one its size - d.

    t tables have weight new^t times the ways to seat c customers, which is c! times the coefficient of x^c in
    exp(new * (1 - (1 - x)^d) / d). It is taken from its series where tables are few for so many customers, else by its saddle point.
    """
    out = new / d
    few = out < c**d
    if few.any():
        n, w, up, down = c[few], out[few], 0.0, 0.0
        for j in range(1, 31):
            a = -np.sin(np.pi * d * j) * (-1) ** j * np.exp(j * np.log(w) - math.lgamma(j + 1) + math.lgamma(1 + d * j) + _log_gamma(n - d * j) - _log_gamma(n - d))
            up, down = up + j * a, down + a
        out[few] = w + up / down
    n, w = c[~few], new[~few]
    low, high = -np.log1p(n / w) / (1 - d) - 1, np.zeros(len(n))
    for _ in range(60):  # log of 1 - x
        at = (low + high) / 2
        less = np.log(-np.expm1(at)) - (1 - d) * at > np.log(n / w)
        low, high = np.where(less, at, low), np.where(less, high, at)
    x, rest = -np.expm1(low), np.exp(low)
    out[~few] = w * -np.expm1(d * low) / d + x * (1 - d) / (2 * (rest + (1 - d) * x) ** 2)
    return np.clip(out, 1, c)


class Seating:
    """Tables of words with c customers, two at least, in their contexts."""

    def __init__(self, c: np.ndarray, parent: np.ndarray, strength: float, d: float):
        self.c, self.parent, self.strength, self.d = c, parent, strength, d
        self.ways = ways(d)
        order = np.argsort(c, kind="stable")
        cuts = np.searchsorted(c[order], np.arange(2, EXACT + 2))
        self.groups = []
        for n, start, end in zip(range(2, EXACT + 1), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            self.groups += [(n, order[i : min(end, i + 500_000 // n)]) for i in range(start, end, 500_000 // n)]
        self.large = order[cuts[-1] :]

    def seat(self, others: np.ndarray, tables: np.ndarray, rng=None) -> np.ndarray:
        """All customers seated anew, beside so many tables of other words: drawn, or expected without rng; expected for more than EXACT."""
        out = np.ones(len(self.c))
        for n, rows in self.groups:
            weight = np.ones((len(rows), n))
            weight[:, 1:] = (self.parent[rows, None] * (self.strength + self.d * (others[rows, None] + np.arange(1, n)))) * self.ways[n]
            weight = np.cumprod(weight, 1)
            if rng is None:
                out[rows] = weight @ np.arange(1.0, n + 1) / weight.sum(1)
            else:
                weight = np.cumsum(weight, 1)
                out[rows] = 1 + (weight[:, :-1] <= rng.random(len(rows))[:, None] * weight[:, -1:]).sum(1)
        at = self.large
        if len(at):
            out[at] = many_tables(self.c[at].astype(float), self.parent[at] * (self.strength + self.d * (others[at] + tables[at])), self.d)
        return out


def mean_tables(c: np.ndarray, context: np.ndarray, contexts: int, parent: np.ndarray, strength: float, d: float, rng, spread: float = 1.0) -> np.ndarray:
    """Mean tables of each word in its context. c: customers, at least 1; parent: the words' probabilities there.

    spread: how many times the tables seen here the restaurant has in all (1 where it is here as a whole).
    """
    t = np.ones(len(c))
    many = np.flatnonzero(c > 1)
    if not len(many):
        return t
    alone, place = np.bincount(context[c == 1], minlength=contexts), context[many]
    seating = Seating(c[many], parent[many], strength, d)
    tables = t[many]
    others = lambda: np.maximum(spread * (alone + np.bincount(place, weights=tables, minlength=contexts))[place] - tables, 0)
    # as expected, until no context's tables change: the sweeps start there
    seen = others()
    for _ in range(ROUNDS):
        tables = seating.seat(seen, tables)
        before, seen = seen, others()
        if (np.abs(seen - before) <= SETTLED * (1 + before)).all():
            break
    total, taken = np.zeros(len(many)), 0
    for sweep in range(SWEEPS):
        tables = seating.seat(others(), tables, rng)
        if sweep >= BURN_IN:
            total += tables
            taken += 1
    t[many] = total / taken
    return t


# ---- followers


def _ask_followers(word_buckets: int, buckets: int):
    def run(table: pa.Table, rows: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows([])
        t = Tokens(table)
        count = _word_counts(rows, len(t.words))
        level = np.minimum(np.rint(8 * np.log2(count + 1.0)), 255).astype(np.uint8)
        c = t.pair_counts()
        contexts = t.words[t.before]
        out = []
        for b, i, j in _slices(bucket_of(contexts, buckets), buckets):
            own, n = np.unique(t.before[i:j], return_counts=True)
            data = np.array([len(own), j - i], np.int64).tobytes() + _words_six(t.words[own]) + _small(n) + _words_six(t.words[t.after[i:j]]) + level[t.after[i:j]].tobytes() + _small(c[i:j])
            out.append((FOLLOWERS, b, t.block, j - i, data))
        out += [(PARENT, b, t.block, j - i, _words_six(t.words[i:j])) for b, i, j in _slices(bucket_of(t.words, word_buckets), word_buckets)]
        return _rows(out)

    return run


def _seat_followers(word_buckets: int, n_tokens: float, n_types: float):
    def run(rows: pa.Table) -> pa.Table:
        if rows["kind"][0].as_py() == PARENT:  # asked already, and answered later
            return rows
        asked = list(zip(rows["bucket"].to_pylist(), rows["block"].to_pylist(), rows["data"].to_pylist(), strict=True))
        sizes, ctx, word, level, c = [], [], [], [], []
        for _, _, data in asked:
            r = Reader(data)
            k, n = r.take(np.int64, 2).tolist()
            own, per = _read_six(r, k), r.small(k)
            sizes.append((k, n))
            ctx.append(np.repeat(own, per))
            word.append(_read_six(r, n))
            level.append(r.take(np.uint8, n))
            c.append(r.small(n))
        ctx, word, level, c = map(np.concatenate, (ctx, word, level, c))
        order = np.lexsort((word, ctx))
        a, w = ctx[order], word[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (w[1:] != w[:-1])))
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        total = np.bincount(group, weights=c).astype(np.int64)
        a, w, q = a[new], w[new], level[order][new]
        place = np.cumsum(np.concatenate(([False], a[1:] != a[:-1])))
        contexts = int(place[-1]) + 1
        seen = np.flatnonzero(total)
        ones, twos = (total == 1).sum(), (total == 2).sum()
        d = float(np.clip(ones / max(1, ones + 2 * twos), 0.2, 0.95))
        # the parent while contexts are seated: smoothed frequencies
        parent = (np.exp2(q / 8.0) - 0.5) / (n_tokens + 0.5 * (n_types + 1))
        t = np.zeros(len(total))
        if len(seen):
            t[seen] = mean_tables(total[seen], place[seen], contexts, parent[seen], STRENGTH, d, np.random.default_rng(asked[0][0]))
        guests = np.bincount(place, weights=total, minlength=contexts)
        tables = np.bincount(place, weights=t, minlength=contexts)
        out, at = [], 0
        for (bucket, block, _), (_, n) in zip(asked, sizes, strict=True):
            g = group[at : at + n]
            p = place[g]
            own = p[np.concatenate(([True], p[1:] != p[:-1]))]  # its contexts, in its order
            big = np.flatnonzero(t[g] > 1000)
            data = np.array([len(own), n], np.int64).tobytes() + np.array([d], np.float64).tobytes() + guests[own].astype(np.float64).tobytes() + tables[own].astype(np.float32).tobytes() + _small(total[g]) + np.minimum(t[g], 1001).astype(np.float16).tobytes() + t[g][big].astype(np.float32).tobytes()
            out.append((FOLLOWERS, bucket, block, n, data))
            at += n
        words, which = np.unique(w[seen], return_inverse=True)
        sums = np.bincount(which, weights=t[seen], minlength=len(words))
        out += [(TABLES, b, -1, j - i, _words_six(words[i:j]) + sums[i:j].astype(np.float32).tobytes()) for b, i, j in _slices(bucket_of(words, word_buckets), word_buckets)]
        return _rows(out)

    return run


def _seat_parent(n_types: float):
    def run(rows: pa.Table) -> pa.Table:
        asked = list(zip(rows["kind"].to_pylist(), rows["bucket"].to_pylist(), rows["block"].to_pylist(), rows["n"].to_pylist(), rows["data"].to_pylist(), strict=True))
        keys, sums = [np.zeros(0, np.uint64)], [np.zeros(0)]
        for kind, _, _, n, data in asked:
            if kind == TABLES:
                r = Reader(data)
                keys.append(_read_six(r, n))
                sums.append(r.take(np.float32, n).astype(np.float64))
        words, group = np.unique(np.concatenate(keys), return_inverse=True)
        guests = np.bincount(group, weights=np.concatenate(sums), minlength=len(words))
        c = np.maximum(np.rint(guests), 1).astype(np.int64)
        t = mean_tables(c, np.zeros(len(c), np.int64), 1, np.full(len(c), 1 / (n_types + 1)), ROOT_STRENGTH, ROOT_DISCOUNT, np.random.default_rng(asked[0][1]), n_types / max(1, len(c))) if len(c) else np.zeros(0)
        share = np.append(np.maximum(guests - ROOT_DISCOUNT * np.minimum(t, guests), 0), 0.0).astype(np.float32)
        out = []
        for kind, bucket, block, n, data in asked:
            if kind == PARENT:
                w = _read_six(Reader(data), n)
                at = np.searchsorted(words, w)
                at = np.where((at < len(words)) & (words[np.minimum(at, len(words) - 1)] == w), at, len(words)) if len(words) else np.zeros(n, np.int64)
                out.append((PARENT, bucket, block, n, share[at].tobytes()))
        out.append((SUMS, asked[0][1], -1, 0, np.array([guests.sum(), np.minimum(t, guests).sum()]).tobytes()))
        return _rows(out)

    return run


SCORES = StructType([StructField(n, t) for n, t in (("doc_id", LongType()), ("held_out", BooleanType()), ("n_tokens", LongType()), ("n_known", LongType()), ("train_tokens", LongType()), ("base_score", DoubleType()), ("score", DoubleType()))])


def _score(n_tokens: int, n_types: int, guests: float, tables: float):
    def run(table: pa.Table, rows: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema_table([], SCORES)
        t = Tokens(table)
        count = _word_counts(rows, len(t.words))
        share = np.concatenate([np.frombuffer(x, np.float32) for x in _answers(rows, PARENT)]).astype(np.float64)
        parent = (share + (ROOT_STRENGTH + ROOT_DISCOUNT * tables) / (n_types + 1)) / (ROOT_STRENGTH + guests)
        own, backed = [], []
        for data in _answers(rows, FOLLOWERS):
            r = Reader(data)
            k, n = r.take(np.int64, 2).tolist()
            d = float(r.take(np.float64, 1)[0])
            c_u, t_u = r.take(np.float64, k), r.take(np.float32, k).astype(np.float64)
            c = r.small(n)
            t_uw = r.take(np.float16, n).astype(np.float64)
            big = np.flatnonzero(t_uw > 1000)
            t_uw[big] = r.take(np.float32, len(big))
            at = sum(map(len, own))
            before = t.before[at : at + n]
            p = np.cumsum(np.concatenate(([False], before[1:] != before[:-1])))
            bottom = STRENGTH + c_u[p]
            own.append(np.maximum(c - d * t_uw, 0) / bottom)
            backed.append((STRENGTH + d * t_u[p]) / bottom)
        pair = np.concatenate(own) + np.concatenate(backed) * parent[t.after]
        logs = np.log10(pair)[t.which]
        base = np.log10((count + 0.5) / (n_tokens + 0.5 * (n_types + 1)))[t.at]
        cuts = np.concatenate(([0], np.cumsum(t.lengths)))[:-1]
        columns = [t.keys, t.held.tolist(), t.lengths.tolist(), np.add.reduceat((count > 0)[t.at].astype(np.int64), cuts).tolist(), [n_tokens] * len(t.keys), np.add.reduceat(base, cuts).tolist(), np.add.reduceat(logs, cuts).tolist()]
        return schema_table(list(zip(*columns, strict=True)), SCORES)

    return run


def score(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of df."""
    spark = df.sparkSession

    def kept(answers: DataFrame, name: str) -> DataFrame:
        path = new_path(spark, name)
        answers.write.option("compression", "zstd").parquet(path)
        release(spark)
        return spark.read.schema(SENT).parquet(path)

    def sums(answers: DataFrame) -> tuple[int, list[float]]:
        """Of the one row that each bucket gives."""
        got = [(r["n"], np.frombuffer(r["data"], np.float64)) for r in answers.where(F.col("kind") == SUMS).select("n", "data").toLocalIterator()]
        return sum(n for n, _ in got), np.sum([x for _, x in got], 0).tolist() if got else [0.0, 0.0]

    blocks = Blocks(df.select(df[key].cast("long").alias("id"), df[text].alias("text")), size=BLOCK)
    word_buckets, buckets = buckets_for(blocks.bytes // 40), buckets_for(blocks.bytes // 10)
    words = kept(in_buckets(blocks.ask(_ask_words(word_buckets), SENT), _count_words, SENT), "words")
    n_types, (n_tokens, *_) = sums(words)
    words = words.where(F.col("kind") == WORDS)
    asked = blocks.ask_with(words, _ask_followers(word_buckets, buckets), SENT)
    seated = kept(in_buckets(asked, _seat_followers(word_buckets, n_tokens, n_types), SENT, "kind", "bucket"), "followers")
    above = seated.where(F.col("kind").isin(PARENT, TABLES))
    parent = kept(in_buckets(above, _seat_parent(n_types), SENT), "parent")
    _, (guests, tables) = sums(parent)
    answers = words.unionByName(seated.where(F.col("kind") == FOLLOWERS)).unionByName(parent.where(F.col("kind") == PARENT))
    return blocks.ask_with(answers, _score(int(n_tokens), n_types, guests, tables), SCORES)


def perplexity(scores: DataFrame) -> DataFrame:
    """(held_out, n_documents, n_tokens, perplexity, base_perplexity) of `score`'s rows: 10 to minus the mean log probability a token, ends counted; two rows at most."""
    mean = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("n_tokens"), mean("score").alias("perplexity"), mean("base_score").alias("base_perplexity"))


def op4_pitman_yor(spark, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
