"""Importance resampling, token alignment and secret scans: plain versions, odd rows, planted strings."""

import base64
import collections
import hashlib
import math
import random
import re
import string
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_edges import TEXTS, table

from seqloom.llm import alignment, importance, keyed_blocks, secret_scan

BYTE, PIECE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(keyed_blocks, "BLOCK_BYTES", 20_000)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeghiéñü") for _ in range(r.randint(1, 7))) for _ in range(300)]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", ", ", "  ", "\n", "\n  ", "　", "'s "]) for _ in range(n))
    texts = [text(r.randint(1, 120)) for _ in range(150)] + [text(60)] * 40 + [" ", "a", "A-B_c 9", "x▁y", "<|endoftext|> is <s>", " a b  c", "tab\t\t x", "\x00 a\x01"]
    return list(enumerate(texts)) + [(1000, None), (1001, ""), (1000, None)]


def test_weights_and_ranks(spark, corpus):
    words = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w]
    target = [t for _, t in corpus[:20]]
    for n, buckets in ((1, 50), (3, 2000)):
        grams = lambda t, n=n: [" ".join(w[i : i + k]) for w in [words(t)] for k in range(1, n + 1) for i in range(len(w) - k + 1)]
        bucket = lambda g, b=buckets: zlib.crc32(g.encode()) % b
        s = collections.Counter(bucket(g) for _, t in corpus for g in grams(t))
        t = collections.Counter(bucket(g) for x in target for g in grams(x))
        all_s, all_t = s.total(), t.total()
        gain = lambda b, q=buckets, s=s, t=t: math.floor(1000 * math.log((t[b] + 1) * (s.total() + q) / ((s[b] + 1) * (t.total() + q))))
        assert all_s > all_t > 0
        want = sorted((i, len(words(x)), len(grams(x)), sum(gain(bucket(g)) for g in grams(x))) for i, x in corpus)
        df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
        got = importance.weights(df, spark.createDataFrame([(x,) for x in target], "text string"), n=n, buckets=buckets)
        assert got.columns == ["doc_id", "text", "n_words", "n_features", "weight"]
        rows = importance.drawn(got, 30, 20, seed=7).collect()
        assert sorted((r["doc_id"], r["n_words"], r["n_features"], r["weight"]) for r in rows) == want
        noise = lambda i: math.floor(-1000 * math.log(-math.log((int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296)))
        scores = sorted(((-w - noise(i), i) for i, k, _, w in want if k >= 20))
        ranked = [i for _, i in scores[: 30 * len(scores) // 100]]
        assert [r["doc_id"] for r in sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])] == ranked
        assert [r["rank"] for r in sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])] == list(range(1, len(ranked) + 1))


def test_ranks_of_equal_rows(spark):
    """Ties by key, and wholly equal rows have ranks of their own."""
    rows = [(1, 30, 5)] * 5 + [(i, 30, 5) for i in range(2, 6)] + [(9, 3, 99), (None, 30, 5)]
    got = importance.drawn(spark.createDataFrame(rows, "doc_id long, n_words long, weight long").withColumn("part", F.lit(1)), 100, 20, seed=1).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 11)) and [r["rank"] for r in got if r["doc_id"] == 9] == [None]
    by = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["score"] for r in by] == sorted((r["score"] for r in by), reverse=True)


def test_bytes_that_end_words():
    every = "".join(map(chr, range(256))) + "日本 aİ"
    want = [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in every)) if w]
    keyed = importance.features(pa.array([every, "", "x"]), 1)
    assert sorted(keyed.keys.to_pylist()) == sorted({*want, "x"}) and keyed.figures[0].to_pylist() == [len(want), 0, 1]


def test_alignment(spark, corpus):
    a, b = alignment.side(BYTE), alignment.side(PIECE)
    assert a.units and b.units
    plain, counts = [], collections.Counter()
    for i, text in corpus:
        full = (" " + (text or "")).encode()
        ids = [s.encode([full.decode()])[0] for s in (a, b)]
        parts = [[s.bytes[x] for x in y] for s, y in zip((a, b), ids, strict=True)]
        if not text or any(b"".join(p) != full for p in parts):
            plain.append((i, None))
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, links = [], []
        for before, cut in zip([0, *cuts[:-1]], cuts, strict=True):
            inside = [[x for x, e in zip(y, z, strict=True) if before < e <= cut] for y, z in zip(ids, ends, strict=True)]
            groups.append("|".join(",".join(map(str, x)) for x in inside))
            links.append((inside[0][-1], inside[1][-1]))
        owners = [np.repeat(np.arange(len(p)), [len(x) for x in p]) for p in parts]
        overlaps = len(set(zip(*[o.tolist() for o in owners], strict=True)))
        counts.update(links)
        plain.append((i, (len(ids[0]), len(ids[1]), links, ";".join(groups), overlaps)))
    most = collections.defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    want = sorted(
        (i, x[0], x[1], len(x[2]), len(x[2]), x[4], sum(counts[k] == most[k[1]] for k in x[2]), sum(counts[k] for k in x[2]), hashlib.sha256(x[3].encode()).hexdigest()) if x else (i, 0, 0, 0, 0, 0, 0, 0, "")
        for i, x in plain
    )
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_best", "count_sum", "groups_sha256"]
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, alignment.align(df, BYTE, PIECE, keep=["doc_id"]).select(names).collect())) == want
    assert sum(x is None for _, x in plain) == 4  # the model's mark within a text; no text


def test_units_change_nothing(corpus):
    """Whole texts at once give the tokens that units give."""
    texts = pa.array([t or "" for _, t in corpus])
    a, b = alignment.Side(BYTE), alignment.Side(PIECE)
    by_units = alignment.aligned(texts, a, b)
    a.units = False
    whole = alignment.aligned(texts, a, b)
    assert [f.to_pylist() for f in by_units.figures] == [f.to_pylist() for f in whole.figures]
    assert by_units.keys.to_pylist() == whole.keys.to_pylist() and by_units.totals().tolist() == whole.totals().tolist()


FIXED = [
    re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww](?:[Oo][Rr])?[Dd])|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    re.compile("AKIA[A-Z0-9]+"),
    re.compile("[0-9a-f]+"),
]


@pytest.fixture(scope="module")
def secrets():
    """(documents, random strings planted in them)."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdeghilmnoprstu") for _ in range(r.randint(1, 8))) for _ in range(400)]
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    docs, planted = [], []
    for i in range(300):
        w = [r.choice(words) for _ in range(r.randint(0, 100))]
        if i % 4 == 0:
            w.insert(len(w) // 2, r.choice(["password=", 'Token : "', "API_KEY=", "secret=token=", "ﬁ passwd='", "toKen="]) + some("0123456789abcdefXYZ_.", r.randint(5, 30)))
        if i % 5 == 0:
            w.append("AKIA" + some(string.ascii_uppercase + string.digits, r.randint(8, 20)))
        if i % 6 == 0:
            w.append("é🙂 " + some("0123456789abcdef", r.randint(8, 40)) + " deadbeef")
        if i % 3 == 0:
            w.append("".join(r.choice(words) for _ in range(10)))  # long and ordinary
        if i % 7 == 0:
            w.append("some/path/to_" + "/".join(r.choice(words) for _ in range(8)))
        for every, make in ((10, lambda: base64.b64encode(r.randbytes(36)).decode()), (11, lambda: some(string.ascii_letters + string.digits, 44)), (13, lambda: some(string.ascii_uppercase + "234567", 52))):
            if i % every == 0:
                planted.append((i, make()))
                w.insert(0, planted[-1][1])
        docs.append((i, " ".join(w)))
    docs += [(900, None), (901, ""), (902, "a" * 60), (903, "z" * 3000), (904, "token=abcdefabcdef0123456789 " * 300), (904, "token=abcdefabcdef0123456789 " * 300), (905, "A0" * 30)]
    return docs, planted


def test_base_spans(spark, secrets):
    rows = secret_scan.find(spark.createDataFrame(secrets[0], "doc_id long, text string").repartition(3)).collect()
    assert len(rows) == len(secrets[0])
    for r in rows:
        want = sorted((m.start(), rank, m.end()) for rank, p in enumerate(FIXED) for m in p.finditer(r["text"] or "") if len(m[2 if rank == 0 else 0]) >= (12, 18, 16)[rank])
        assert [tuple(s) for s in r["base"]] == want
        assert set(r["base"]) <= set(r["secrets"])


def test_random_strings(spark, secrets):
    """The battery finds planted random strings and leaves words, paths and repetitions alone."""
    docs, planted = secrets
    rows = secret_scan.find(spark.createDataFrame(docs, "doc_id long, text string"), keep=["doc_id"]).collect()
    texts = dict(docs)
    added = {(r["doc_id"], (texts[r["doc_id"]])[s["start"] : s["end"]]) for r in rows for s in r["secrets"] if s["rank"] == 3}
    assert len(added & set(planted)) >= 0.95 * len(planted) and len(added - set(planted)) <= 0.05 * len(added)


def test_false_discoveries_of_ordinary_strings(spark):
    """Where all strings are ordinary, next to nothing is found, at any length."""
    r = random.Random(9)
    words = ["".join(r.choices("etaoinshrdlu", (12, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 3), k=r.randint(2, 7))) for _ in range(900)]
    docs = [(i, "".join(w.capitalize() if j % 3 == 0 else w for j, w in enumerate(r.choice(words) for _ in range(r.randint(5, 16)))) + " " + " ".join(r.choice(words) for _ in range(30))) for i in range(600)]
    rows = secret_scan.find(spark.createDataFrame(docs, "doc_id long, text string"), keep=["doc_id"]).collect()
    assert sum(len(x["secrets"]) for x in rows) <= 3


def test_secrets_same_as_sql(spark, secrets, tmp_path):
    import duckdb
    from test_oracles import plain

    unique = list({i: (i, t) for i, t in secrets[0]}.values())
    spark.createDataFrame(unique, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    import pandas as pd

    got = secret_scan.op13_randomness_tests(spark, str(tmp_path)).toPandas()
    pd.testing.assert_frame_equal(plain(got), plain(con.execute(secret_scan.oracle()).df()), check_dtype=False)
    assert got["n_random"].sum() > 0


OPERATORS = {
    "weights": lambda df: importance.drawn(importance.weights(df, df.limit(3)), 50, 1, seed=1),
    "alignment": lambda df: alignment.align(df, BYTE, PIECE),
    "secrets": secret_scan.find,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    df = table(spark, TEXTS)
    out = OPERATORS[name](df)
    assert len(out.collect()) == len(TEXTS) and out.columns[: len(df.columns)] == df.columns
    assert OPERATORS[name](table(spark, [])).count() == 0
    again = OPERATORS[name](out)  # columns that it adds replace the older ones
    assert sorted(again.columns) == sorted(out.columns) and again.count() == len(TEXTS)
