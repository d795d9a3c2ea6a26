"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes for what they miss.

The field is trained from a small labelled table (labelled_rows(), or any rows of tokens and tags) by gradient ascent on
the exact log-likelihood, and decoded over each whole text by Viterbi, many texts to a numpy batch. Words are described once
while they are remembered, by the shape of the whole word. A decoded span becomes a finding if it doesn't touch a pattern's finding
and passes the check of its kind. Findings are (kind, start, end) in code points, end exclusive. Null and empty texts have none. A
row depends on its own text only.

The patterns are matched in linear time, also over very long runs of digits or letters.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from .common import documents, listed, split_words, text_of

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Characters of the texts that are decoded at once (one text at least), words of one Viterbi batch (one run at least), and
#: descriptions of words that a worker remembers.
BATCH_CHARS, BATCH_WORDS, REMEMBERED = 2_000_000, 250_000, 100_000

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local_end = re.compile(r"[A-Za-z0-9._%+-]")
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")
_nondigit = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of the fixed patterns, by kind and start."""
    out = []
    if "@" in text:
        # a match starts where a run of local characters that ends at an at-sign starts, or where the last match ended
        last = 0
        at = text.find("@")
        while at >= 0:
            start = at
            while start > last and _local_end.match(text, start - 1):
                start -= 1
            floor = at + 1
            if start < at and (m := _domain.match(text, at + 1)):
                out.append((0, start, m.end()))
                last = floor = m.end()
            last = max(last, at + 1)  # an at-sign is no local character, so nothing reaches back over it
            at = text.find("@", floor)
    if _digit.search(text):
        if "." in text:
            out += [(1, m.start(), m.end()) for m in _ip.finditer(text) if all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in m[0].split(".")))]
        for m in _card.finditer(text):
            if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := _nondigit.sub("", m[0])) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _phone.finditer(text) if 9 <= len(_nondigit.sub("", m[0])) <= 15]
    return out


#: Words that stand for the marks of an address.
LINKS = ("at", "dot", "AT", "DOT", "punkt", "punto", "arobase")


# ---- the labelled table


def labelled_rows(n: int = 600, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """A small labelled table, made by rule: (tokens, tags) with personal data in forms the patterns miss and miss not, and look-alikes without."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: r.choice(["at", "dot", "com", "Mail"]) if r.random() < 0.05 else "".join(r.choice(["an", "er", "the", "on", "in", "st", "ou", "re", "de", "la"]) for _ in range(r.randint(1, 3)))
    tail = lambda x: x + r.choice(["", "", "", ".", ",", "!!", "%%%"])

    def card() -> str:
        d = "4" + num(14)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def email() -> list[str]:
        user = r.choice([lambda: f"{word()}.{num(2)}", word, lambda: f"{word()}.{word()}", lambda: f"{word()}{num(2)}", lambda: word().capitalize()])()
        host, end = r.choice([lambda: f"mail{num(1)}", word, lambda: f"{word()}{num(1)}", lambda: f"{word()}-{word()}"])(), r.choice(["com", "org", "net", "de"])
        at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), ("at", "dot")])
        forms = [[f"{user}@{host}.example.{end}"], [user, at, host, dot, end], [user, at, host, dot, end]]
        if at != "at":
            forms += [[user, at, f"{host}.{end}"], [user, at, f"{host}.example.{end}"], [f"{user}{at}{host}{dot}{end}"], [f"{user}{at}{host}.{end}"]]
        return r.choice(forms)

    def ip() -> list[str]:
        p = [str(r.randint(1, 255)) for _ in range(4)]
        return r.choice([[".".join(p)], ["[.]".join(p)], ["(.)".join(p)]])

    def cards() -> list[str]:
        d = card()
        parts = [d[i : i + 4] for i in range(0, 16, 4)]
        return r.choice([parts, ["-".join(parts)], [d], [".".join(parts)], ["_".join(parts)]])

    def phone() -> list[str]:
        a, b, c = num(3), num(3), num(4)
        return r.choice([["+1", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], [f"+1-{a}-{b}-{c}"]])

    def other() -> list[str]:
        return r.choice([[f"20{num(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}"], [f"{r.randint(1, 23)}:{num(2)}"], [f"v{num(1)}.{num(1)}.{num(2)}"], [f"{num(1)}.{num(1)}.{num(2)}"], [num(r.randint(1, 12))], [f"{num(3)}-{num(3)}"], ["$" + num(3)], ["|", num(2), "|", num(3)], [f"{num(4)}-{num(4)}"], ["@", word()], [f"@{word()}"], [f"{num(2)}%"], ["".join(r.choice("0123456789abcdef") for _ in range(32)) + '"'], [f"({num(4)})"], ["978-3-16-148410-" + num(1)], [num(4), num(4)], [num(3), num(3), num(4), num(3)], [f"{word()}{num(2)}"], [f"{num(1)}.{num(2)}"]])

    made = {"email": email, "ip": ip, "card": cards, "phone": phone}
    rows = []
    for _ in range(n):
        tokens, tags = [], []
        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(1, 4)):
                tokens.append(tail(word()))
                tags.append("O")
            kind = r.choice([*KINDS, None, None, None, None])
            found = made[kind]() if kind else other()
            tags += [f"{'I' if i else 'B'}-{kind}" if kind else "O" for i in range(len(found))]
            tokens += [*found[:-1], tail(found[-1])]
        for _ in range(r.randint(0, 3)):
            tokens.append(tail(word()))
            tags.append("O")
        rows.append((tokens, tags))
    return rows


# ---- the field

class _Kinds(dict):
    """Each character's kind, for str.translate: a, A, d, u beyond ASCII (a mark there: \\x7f), and ASCII marks as they are."""

    def __missing__(self, c: int) -> str:
        x = chr(c)
        if c < 128:
            kind = "a" if "a" <= x <= "z" else "A" if "A" <= x <= "Z" else "d" if "0" <= x <= "9" else x
        else:
            kind = "u" if x.isalnum() else "\x7f"
        self[c] = kind
        return kind


_kinds = _Kinds()
_edge = re.compile(r"^[^aAud_+(\[@]+|[^aAud_)\]]+$")
_repeated = re.compile(r"([aAu])\1+")
_digits = re.compile(r"d+")


def described(word: str) -> tuple[str, str, bool]:
    """All that a word's features say: the kinds of its characters, whether it stands for a mark, and whether it holds a bracketed at."""
    kinds = word.translate(_kinds)
    link = word.strip(MARKS) if len(word) < 16 else ""
    return kinds, link if link in LINKS else "", "at]" in word or "at)" in word


def features(kinds: str, link: str, bracketed: bool) -> list[str]:
    """Of the word without surrounding marks: its shape with and without lengths of digit runs (17 stands for more), digits, dots and at-sign."""
    core = _repeated.sub(r"\1", _edge.sub("", kinds))
    digits = core.count("d")
    sized = _digits.sub(lambda m: f"d{min(len(m[0]), 17)}", core) if digits else core
    plain = _digits.sub("d", core) if digits else core
    return [f"s:{sized}", f"c:{plain}", f"n:{digits}", f"p:{min(core.count('.'), 4)}", f"a:{'@' in core}:{bracketed}", f"w:{link}", f"+:{core[:1] in '+(['}", "bias"]


class Field:
    """Weights of a linear-chain CRF: by offset (-1, 0, +1), feature and tag; and by tag and next tag.

    Decoding gives a best path of the whole text. It runs Viterbi only where that can leave tag O: a span's words are worth, against
    O in all their places, at most the sum of a bound for each of them, so a word that is in no run of words with a positive
    sum is O, and what lies between such words is decoded by itself, from O to O.
    """

    def __init__(self, index: dict[str, int], w: np.ndarray, trans: np.ndarray):
        self.index, self.w, self.trans = index, w, trans
        self._classes: dict[tuple, int] = {}
        self._parts = np.zeros((0, 3, len(TAGS)))

    def __getstate__(self):
        return self.index, self.w, self.trans

    def __setstate__(self, state):
        self.__init__(*state)

    def classes(self, words: list[str]) -> np.ndarray:
        """The number of each word's description. The worker forgets descriptions beyond REMEMBERED."""
        if len(self._classes) > REMEMBERED:
            self.__init__(self.index, self.w, self.trans)
        known, new, out = self._classes, [], []
        for word in words:
            key = described(word)
            n = known.get(key)
            if n is None:
                n = known[key] = len(known)
                new.append(self.w[:, [self.index[f] for f in features(*key) if f in self.index]].sum(1))
            out.append(n)
        if new:
            self._parts = np.concatenate((self._parts, np.stack(new)))
        return np.array(out, np.int64)

    def scores(self, c: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Each word's scores of the tags, from its own description, the last word's and the next one's."""
        before, own, after = (np.ascontiguousarray(self._parts[:, i], np.float32) for i in range(3))
        out = own[c]
        out[1:] += before[c[:-1]]
        out[:-1] += after[c[1:]]
        first = bounds[1:-1][np.diff(bounds)[1:] > 0]  # a text's first word has none before it, nor the last text's end one after it
        first = first[first > 0]
        out[first] -= before[c[first - 1]]
        out[first - 1] -= after[c[first]]
        return out

    def open_words(self, em: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Whether a best path may have another tag than O at each word."""
        out, starts = np.zeros(len(em), bool), bounds[:-1][np.diff(bounds) > 0]
        words = np.ones(len(em) + len(starts), bool)
        words[starts + np.arange(len(starts))] = False  # a place before each text, which no run is worth going over
        for i in range(1, len(TAGS), 2):
            begin = max(0.0, (self.trans[:, i] - self.trans[:, 0]).max()) + max(0.0, (self.trans[i : i + 2] - self.trans[0])[:, [0, *range(1, len(TAGS), 2)]].max())
            inside = max(self.trans[i, i + 1], self.trans[i + 1, i + 1]) - self.trans[0, 0]
            worth = np.maximum(em[:, i] + begin, em[:, i + 1] + inside) - em[:, 0]
            apart = np.full(len(words), -1.0 - np.add.reduceat(np.maximum(worth, 0), starts).max())
            apart[words] = worth
            # the best sum of a run that ends at each word, and that begins there: sums up to it less the least sum before
            left, right = ((up := np.cumsum(x)) - np.minimum.accumulate(np.concatenate(([0.0], up[:-1]))) for x in (apart, apart[::-1]))
            out |= left[words] + right[::-1][words] - worth > -1e-4
        return out

    def decode(self, c: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The best tag of every word. c: the words' classes, text by text; bounds: each text's."""
        out = np.zeros(len(c), np.int8)
        if not len(c):
            return out
        em = self.scores(c, bounds)
        edge = np.zeros(len(c) + 1, bool)
        edge[bounds] = True
        inside = np.concatenate(([False], self.open_words(em, bounds), [False]))
        start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        n = end - start
        by_length = np.argsort(-n, kind="stable")
        done = 0
        while done < len(by_length):  # runs of like length, the longest first
            some = by_length[done : done + max(1, BATCH_WORDS // int(n[by_length[done]]))]
            done += len(some)
            self._viterbi(em, start[some], n[some], edge[start[some]], edge[end[some]], out)
        return out

    def _viterbi(self, em: np.ndarray, start: np.ndarray, n: np.ndarray, opens: np.ndarray, closes: np.ndarray, out: np.ndarray) -> None:
        """Best tags of runs of n words (longest first), which lie between O's where they don't begin (opens) or end (closes) a text."""
        longest, rows = int(n[0]), np.arange(len(n))
        back = np.zeros((longest, len(n), len(TAGS)), np.int8)
        best = em[start] + np.where(opens[:, None], START, START + self.trans[0])
        final = best.copy()
        for step in range(1, longest):
            m = int(np.searchsorted(-n, -step, "left"))  # runs that reach this step
            options = best[:m, :, None] + self.trans
            back[step, :m] = options.argmax(1)
            best = final[:m] = options.max(1) + em[start[:m] + step]
        tag = (final + np.where(closes[:, None], 0.0, self.trans[:, 0])).argmax(1)
        for step in range(longest - 1, -1, -1):
            m = int(np.searchsorted(-n, -step, "left"))
            out[start[:m] + step] = tag[:m]
            if step:
                tag[:m] = back[step, rows[:m], tag[:m]]

    def tags(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The best tags of each word list."""
        bounds = np.cumsum([0, *map(len, texts)])
        tags = self.decode(self.classes([w for x in texts for w in x]), bounds)
        return [tags[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _allowed() -> np.ndarray:
    ok = np.zeros((len(TAGS), len(TAGS)))
    for j, tag in enumerate(TAGS):
        if tag[0] == "I":
            ok[:, j] = [0.0 if before[1:] == tag[1:] and before != "O" else -1e4 for before in TAGS]
    return ok


LEGAL = _allowed()
START = np.array([-1e4 if t[0] == "I" else 0.0 for t in TAGS])
BEGINS = np.array([t[0] == "B" for t in TAGS])
#: Marks that don't belong to a span's ends.
MARKS = ".,;:!?\"'|%$#*&<>=-"


def train(rows: list[tuple[list[str], list[str]]], steps: int = 60, rate: float = 0.25, decay: float = 1e-3) -> Field:
    """Adam on the mean log-likelihood with an L2 penalty; the gradient by forward and backward sums over the padded batch."""
    index = {f: i for i, f in enumerate(sorted({f for ws, _ in rows for w in ws for f in features(*described(w))}))}
    n, t, s = len(rows), max(len(ws) for ws, _ in rows), len(TAGS)
    width = len(features(*described("x")))
    feats = np.full((n, t + 2, width), len(index))  # the last row of the weights stays 0
    gold, mask = np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, (ws, tags) in enumerate(rows):
        mask[i, : len(ws)] = True
        for k, (w, tag) in enumerate(zip(ws, tags, strict=True)):
            feats[i, k + 1] = [index[f] for f in features(*described(w))]
            gold[i, k] = TAGS.index(tag)
    w, trans = np.zeros((3, len(index) + 1, s)), np.zeros((s, s))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)]
    lengths, rows_ = mask.sum(1), np.arange(n)
    lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    for step in range(1, steps + 1):
        em = sum(w[o][feats[:, o : o + t]].sum(2) for o in range(3))
        full = trans + LEGAL
        alpha, beta = np.zeros((n, t, s)), np.zeros((n, t, s))
        alpha[:, 0] = em[:, 0] + START
        for k in range(1, t):
            alpha[:, k] = np.where(mask[:, k, None], lse(alpha[:, k - 1, :, None] + full, 1) + em[:, k], alpha[:, k - 1])
        z = lse(alpha[rows_, lengths - 1], 1)
        for k in range(t - 2, -1, -1):
            beta[:, k] = np.where(mask[:, k + 1, None], lse(full + (em[:, k + 1] + beta[:, k + 1])[:, None, :], 2), 0)
        node = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        delta = -node
        delta[rows_[:, None], np.arange(t), gold] += mask
        gw, gt = np.zeros_like(w), np.zeros_like(trans)
        for o in range(3):
            np.add.at(gw[o], feats[:, o : o + t], delta[:, :, None, :])
        for k in range(1, t):
            edge = np.exp(alpha[:, k - 1, :, None] + full + (em[:, k] + beta[:, k])[:, None, :] - z[:, None, None]) * mask[:, k, None, None]
            gt -= edge.sum(0)
            np.add.at(gt, (gold[mask[:, k], k - 1], gold[mask[:, k], k]), 1.0)
        for x, g, i in ((w, gw / n - decay * w, 0), (trans, gt / n - decay * trans, 2)):
            state[i] = 0.9 * state[i] + 0.1 * g
            state[i + 1] = 0.99 * state[i + 1] + 0.01 * g * g
            x += rate * (state[i] / (1 - 0.9**step)) / (np.sqrt(state[i + 1] / (1 - 0.99**step)) + 1e-8)
        w[:, -1] = 0
    return Field(index, w[:, :-1].copy(), trans + LEGAL)


def _valid(kind: str, text: str) -> bool:
    digits = _nondigit.sub("", text)
    if kind == "email":
        return bool(re.search(r"[A-Za-z0-9]\s*(@|[\[(]at[\])]|\sat\s)\s*[A-Za-z0-9]", text) and re.search(r"\.|[\[(]dot[\])]|\sdot\s", text))
    if kind == "ip":
        parts = re.split(r"[^0-9]+", text.strip(".()[]"))
        return len(parts) == 4 and all(x and len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and not re.search(r"[A-Za-z]", text)


_word = re.compile(r"[^\x20\x09-\x0D]+")


def find(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """For each text, the patterns' findings, and all findings; both by kind and start."""
    out, at = [], 0
    while at < len(texts):
        end, chars = at + 1, len(texts[at] or "")
        while end < len(texts) and chars + len(texts[end] or "") <= BATCH_CHARS:
            chars += len(texts[end] or "")
            end += 1
        out += _found(texts[at:end], field)
        at = end
    return out


def _found(texts: list[str], field: Field) -> list[tuple[list, list]]:
    base = [patterns(x) if x else [] for x in texts]
    words, at, bounds = split_words(pa.array([x or "" for x in texts], pa.string()))
    tags = field.decode(field.classes(listed(words))[at], bounds)
    out = []
    for i in range(len(texts)):
        own, added = tags[bounds[i] : bounds[i + 1]], []
        begins = np.flatnonzero(BEGINS[own])
        if len(begins):
            places = [m.span() for m in _word.finditer(texts[i])]
            for k in begins.tolist():
                kind, end = TAGS[own[k]][2:], k + 1
                while end < len(own) and TAGS[own[end]] == f"I-{kind}":
                    end += 1
                a, b = places[k][0], places[end - 1][1]
                span = texts[i][a:b]
                lead = len(span) - len(span.lstrip(MARKS))
                a, b = a + lead, a + len(span.rstrip(MARKS))
                if a < b and _valid(kind, texts[i][a:b]) and not any(x < b and a < y for _, x, y in base[i]):
                    added.append((KINDS.index(kind), a, b))
        out.append((base[i], sorted(base[i] + added)))
    return out


def written_out(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def redact(df: DataFrame, field: Field | None = None, text: str = "text") -> DataFrame:
    """df with every finding in its text replaced by its kind in brackets; texts without any stay as they are, null too."""
    field = field or train(labelled_rows())

    def clean(x: str | None, spans) -> str | None:
        if not spans:
            return x
        out, last = [], 0
        for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= last:
                out += [x[last:a], f"[{KINDS[k].upper()}]"]
            last = max(last, b)
        return "".join([*out, x[last:]])

    schema = df.schema
    at = schema.names.index(text)

    def run(batches):
        for batch in batches:
            raw = batch.column(at).to_pylist()
            found = find([x or "" for x in raw], field)
            new = pa.array([clean(x, spans) for x, (_, spans) in zip(raw, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    assert isinstance(schema[at].dataType, StringType), f"{text} isn't a string column"
    return df.mapInArrow(run, schema)


def op3_crf(spark, sf_dir: str) -> DataFrame:
    field = train(labelled_rows())
    docs = documents(spark, sf_dir)

    def run(batches):
        for batch in batches:
            found = find(batch.column(1).to_pylist(), field)
            counts = np.zeros((4, len(found)), np.int64)
            for i, (base, _) in enumerate(found):
                for k, _, _ in base:
                    counts[k, i] += 1
            sha = [hashlib.sha256(written_out(base).encode()).hexdigest() for base, _ in found]
            yield pa.record_batch([batch.column(0), *(pa.array(c) for c in counts), pa.array(sha, pa.string()), pa.array([written_out(s) for _, s in found], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, schema)
