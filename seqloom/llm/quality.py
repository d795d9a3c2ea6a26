"""Quality rules: a short-circuit cascade, ordered by rejection per cost as estimated on a sample.

Everything is built from DataFrame functions. A rule is a lazily evaluated condition; the cascade is one CASE
expression, so the first rule that rejects a document ends its evaluation. A text is split into words once, which all rules
read. Rules are timed as they will run: on the sample's words, or on the columns that hold measures already. The verdict is
the same in any order, only the work differs.

Nulls, empty texts and texts without words have no words and fail `few_words`. A row is judged by its text alone, so
ties and repeated rows get equal verdicts. All columns of the input are kept; the columns added are named by the caller.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, documents, fresh, text_of

#: Rows that cost and selectivity are estimated on, the share of rows that the scan for them keeps, and the UTF-8 bytes of the
#: longest text among them (they come to the driver, so at most some 60 MB do).
SAMPLE_ROWS, SAMPLE_SHARE, SAMPLE_BYTES = 1000, 0.2, 60_000
GRAM = 5


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once (a lambda's variable isn't inlined)."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "")
    return _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(words_: Column) -> Column:
    """Of a text's words, those that lie in a 5-word window found twice or more in the text. Linear but for one sort of the texts that repeat any."""

    def marked(places: Column) -> Column:
        # places: (window, start), by window; then the starts of repeated windows in order; then the words they cover
        around = F.transform(places, lambda x, i: F.when((F.get(places, i - 1)["w"] == x["w"]) | (F.get(places, i + 1)["w"] == x["w"]), x["at"]))
        return _let(F.sort_array(F.filter(around, lambda x: x.isNotNull())), covered)

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda x, i: F.least(F.lit(GRAM), F.coalesce(F.get(starts, i + 1) - x, F.lit(GRAM))).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(windows: Column) -> Column:
        found = _let(F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("at")))), marked)
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(found)

    def of_words(ws: Column) -> Column:
        window = lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(GRAM)])
        windows = F.transform(F.sequence(F.lit(0), F.size(ws) - GRAM), window)
        return F.when(F.size(ws) <= GRAM, F.lit(0).cast("long")).otherwise(_let(windows, repeated))

    return _let(words_, of_words)


class Measures:
    """What the rules measure of a text, each an expression of it and of its words, or a column where it has been computed already."""

    def __init__(self, text: Column, words_: Column | None = None, **known: Column):
        self.text, self.words, self.known = text, words(text) if words_ is None else words_, known

    def __getattr__(self, name: str) -> Column:
        known = self.__dict__["known"]
        return known[name] if name in known else MEASURES[name](self)


MEASURES: dict[str, Callable[[Measures], Column]] = {
    "n_words": lambda m: F.size(m.words).cast("long"),
    "word_chars": lambda m: word_chars(m.text),
    "n_symbols": lambda m: n_symbols(m.text),
    "n_dup_lines": lambda m: n_dup_lines(m.text),
    "n_repeat_words": lambda m: n_repeat_words(m.words),
    "n_lines": lambda m: F.size(F.split(m.text, "\n")),
    "marks": lambda m: F.regexp_count(m.text, F.lit(f"!!(?=[{SPACE}]|$)")),
}


@dataclass(frozen=True)
class Rule:
    """Rejects the rows for which `rejects` holds of the text's measures."""

    name: str
    rejects: Callable[[Measures], Column]


#: Thresholds lie far from what clean prose shows.
RULES = (
    Rule("few_words", lambda m: m.n_words < 10),
    Rule("symbols", lambda m: m.n_symbols * 5 > m.word_chars),
    Rule("shouting_marks", lambda m: m.marks * 2 > m.n_words),
    Rule("word_length", lambda m: _let(m.n_words, lambda n: ~F.coalesce(F.try_divide(m.word_chars, n).between(1.5, 40.0), F.lit(False)))),
    Rule("dup_lines", lambda m: _let(m.n_lines, lambda n: (n >= 4) & (m.n_dup_lines * 2 > n))),
    Rule("repeated_words", lambda m: _let(m.n_words, lambda n: (n >= GRAM) & (100 * m.n_repeat_words > 20 * n))),
)


def _taken(df: DataFrame, n: int) -> DataFrame | None:
    """n rows of the first partitions that have so many, as a local table; all within the JVM. None if there are none."""
    rows = df._jdf.takeAsList(n)
    return DataFrame(df.sparkSession._jsparkSession.createDataFrame(rows, df._jdf.schema()), df.sparkSession).coalesce(1) if rows.size() else None


def order(df: DataFrame, rules=RULES, text: str = "text", prepare: Callable[[DataFrame], DataFrame] = lambda df: df, known: dict[str, str] | None = None, rows: int = SAMPLE_ROWS, share: float = SAMPLE_SHARE) -> list[tuple[Rule, float, float]]:
    """The rules by falling rejection per second, as (rule, seconds a row, share rejected).

    `known` names columns of prepare(df) that hold measures already (measure -> column).
    The sample is at most `rows` rows of the first partitions that have so many, drawn at random until there are enough, so its
    cost doesn't grow with the table. It decides the order only; a poor estimate makes the cascade slower, never different.
    """
    texts = df.select(text_of(df, text).alias(text)).where(F.octet_length(text) <= SAMPLE_BYTES)
    sample = prepare(_taken(texts.sample(False, share, 7), rows) or _taken(texts, rows) or texts.limit(0))
    (ws,) = fresh(sample, "ws")
    sample = sample.withColumn(ws, words(F.col(text))).cache()
    try:
        n = max(1, sample.count())
        measures = Measures(F.col(text), F.col(ws), **{k: F.col(c) for k, c in (known or {}).items()})
        rated = []
        for rule in rules:
            took = []
            for _ in range(2):  # the first run compiles
                began = time.perf_counter()
                bad = sample.agg(F.sum(rule.rejects(measures).cast("long"))).first()[0] or 0
                took.append(time.perf_counter() - began)
            rated.append((rule, min(took) / n, bad / n))
    finally:
        sample.unpersist()
    return sorted(rated, key=lambda x: (-x[2] / max(x[1], 1e-9), x[0].name))


def cascade(measures: Measures, rules) -> Column:
    """Name of the first rule that rejects, else null. CASE evaluates no rule after that."""
    out = F.lit(None).cast("string")
    for rule in reversed(list(rules)):
        out = F.when(rule.rejects(measures), F.lit(rule.name)).otherwise(out)
    return out


def judge(df: DataFrame, rules=RULES, text: str = "text", verdict: str = "rejected_by") -> DataFrame:
    """df with the first rejecting rule, in estimated order, as column `verdict` (null: kept)."""
    return df.withColumn(verdict, _verdict(df, rules, text))


def _verdict(df: DataFrame, rules, text: str) -> Column:
    """The cascade in estimated order, over words that are bound once."""
    ranked, t = [r for r, _, _ in order(df, rules, text)], text_of(df, text)
    return _let(words(t), lambda ws: cascade(Measures(t, ws), ranked))


def keep(df: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The rows that no rule rejects, with the columns of df."""
    return df.where(_verdict(df, rules, text).isNull())


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of its text; the text is split into words once."""
    t = text_of(df, text)
    (split_words,) = fresh(df, "words")
    split = df.withColumn(split_words, words(t))
    return split.withColumns({"n_words": F.size(split_words).cast("long"), "word_chars": word_chars(t), "n_symbols": n_symbols(t), "n_dup_lines": n_dup_lines(t), "n_repeat_words": n_repeat_words(F.col(split_words))}).drop(split_words)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """All measures are part of the result, so the cascade reads them, and its rules are timed on them."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    known = {n: n for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    ranked = [r for r, _, _ in order(docs, prepare=measured, known=known)]
    rows = measured(docs)
    rejected = cascade(Measures(text_of(rows), **{k: rows[c] for k, c in known.items()}), ranked)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select("doc_id", *known, failed.alias("base_failed"), (~failed & rejected.isNull()).alias("kept"))


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL = {
    "op6_quality_rules": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: translate(x, {_WS}, '') <> '') AS ls FROM d),
pos AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS p, ws FROM w WHERE len(ws) >= 5),
win AS (SELECT doc_id, p, array_to_string(ws[p:p+4], ' ') AS g FROM pos),
rep AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win),
cov AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM rep, (SELECT unnest(range(5)) AS k) WHERE c >= 2 GROUP BY doc_id),
s AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(translate(t, {_WS}, ''))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
             len(regexp_extract_all(t, '!!([\\x20\\x09-\\x0D]|$)')) AS marks, len(string_split(t, chr(10))) AS n_lines
      FROM w LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 5 > word_chars OR marks * 2 > n_words
            OR NOT coalesce(word_chars * 1.0 / nullif(n_words, 0) BETWEEN 1.5 AND 40.0, false)
            OR (n_lines >= 4 AND n_dup_lines * 2 > n_lines)) AS kept
FROM f""",
}
