"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from seqloom.llm import jaccard_join, language_model, packing, permutation_index, pii, quality, sentencepiece_codec, sharding, substring_dedup, token_counts
from seqloom.llm.common import new_path

SCHEMA = "doc_id long, text string, block long, place string, n long, bucket int, kind int, shard string, node long, t string, data binary, _bucket int, id int"
LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(30_000))
COPY = "the same short text again and again, mail to a.b@c.org or call +1 (555) 555-0100 now " * 3
TEXTS = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, LONG), (6, COPY), (7, COPY), (7, COPY), (None, "a row without an id " * 9), (8, "é ñ ü 日本 \U0001f600   x"), (9, "Is " * 3000), (10, "1" * 5000), (11, "a@" * 2000)]


def table(spark, rows):
    return spark.createDataFrame([(i, x, 1, "p", None, 3, 4, "s", 5, "t", b"d", 6, 7) for i, x in rows], SCHEMA)


OPERATORS = {
    "sentencepiece": lambda df: sentencepiece_codec.encode_column(df, public_tokenizers.path("piece_bpe_32k.model"), ids="ids_", parity="parity_"),
    "packing": lambda df: packing.pack(df, public_tokenizers.path("word_bpe_49k.json")),
    "pii": pii.redact,
    "language_model": language_model.score,
    "sharding": lambda df: sharding.slots(sharding.place(df, sharding.topology(24), shard="to"), "to", ["doc_id", "text"]),
    "quality": lambda df: quality.judge(df),
    "quality_keep": quality.keep,
    "substring_dedup": substring_dedup.strip_repeats,
    "jaccard": jaccard_join.clusters,
    "jaccard_first": jaccard_join.first_of_each,
    "token_counts": lambda df: token_counts.count_tokens(df, new_path(df.sparkSession, "counts"), public_tokenizers.path("byte_bpe_50k.json"), n_tokens="tokens_"),
}
EACH_ROW = ("sentencepiece", "pii", "language_model", "sharding", "quality", "substring_dedup", "jaccard", "token_counts")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    df = table(spark, TEXTS)
    out = OPERATORS[name](df)
    rows = out.collect()
    if name in EACH_ROW:
        assert len(rows) == len(TEXTS)
    if name not in ("packing", "language_model", "jaccard"):
        assert out.columns[: len(df.columns)] == df.columns  # nothing renamed or lost


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](table(spark, [])).count() == 0


def test_defined_results(spark):
    df = table(spark, TEXTS)
    by = lambda rows: {(r["doc_id"], i): r for i, r in enumerate(sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"])))}
    assert {r["rejected_by"] for r in quality.judge(df).where("doc_id < 4").collect()} <= {"few_words", "word_length"}
    clusters = jaccard_join.clusters(df).collect()
    assert {r["component_id"] for r in clusters if r["doc_id"] in (6, 7)} == {6}
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in clusters if r["doc_id"] in (1, 2, 3)} == {(1, 0, 1), (2, 0, 2), (3, 0, 3)}
    assert next(r for r in clusters if r["doc_id"] is None)["n_shingles"] == 5
    scored = by(language_model.score(df).collect())
    assert [r["n_tokens"] for (d, _), r in scored.items() if d in (1, 2, 3)] == [1, 1, 1]
    packed = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"))
    assert packed.where("doc_id IN (1, 2, 3)").agg(F.sum("length"), F.count("*")).first()[0:2] == (3, 3)
    cleaned = {r["doc_id"]: r["text"] for r in pii.redact(df).where("doc_id IN (1, 2, 6)").collect()}
    assert cleaned[1] is None and cleaned[2] == "" and "[EMAIL]" in cleaned[6] and "[PHONE]" in cleaned[6] and "555-0100" not in cleaned[6]
    stripped = {r["doc_id"]: r["text"] for r in substring_dedup.strip_repeats(df).collect()}
    assert stripped[6] == "" == stripped[9] and stripped[5] == LONG


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [0.0, 2.0]), (9, [1.0]), (None, [1.0, 1.0])] + [(10 + i, [1.0, 0.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("v", F.lit("x"))
    got = permutation_index.nearest(df, F.col("vec_id") == 0, k=3).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 1, 1.0), (2, 2, 1.0), (3, 10, 1.0)]
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = permutation_index.nearest(twice, F.col("vec_id") == 0, k=2).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 0), (0, 1, 0), (0, 2, 1), (0, 2, 1)]  # each is the other's neighbour
    assert permutation_index.nearest(df.limit(0), F.lit(True)).count() == 0
    assert permutation_index.nearest(df.where("vec_id = 8"), F.lit(True)).count() == 0


def test_vectors_of_any_length(spark):
    """Cosines of vectors whose squares leave the range of doubles."""
    rows = [(0, [1e-200, 0.0]), (1, [1e200, 1e200]), (2, [3e-320, 0.0]), (3, [0.0, 5e300])]
    got = permutation_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=3).orderBy("rank").collect()
    assert [(r["vec_id"], round(r["score"], 12)) for r in got] == [(2, 1.0), (1, round(0.5**0.5, 12)), (3, 0.0)]


def test_addresses_with_zeros():
    """Parts of an address are compared as numbers, however many zeros lead them."""
    zeros = "0" * 5000
    found = lambda text: [x for x in pii.patterns(text) if x[0] == 1]
    assert not found(f"{zeros}999.1.2.3") and found(f"{zeros}255.1.{zeros}.3") == [(1, 0, 5000 + 3 + 3 + 5000 + 2)] and found("x 1.2.3.4") == [(1, 2, 9)]
