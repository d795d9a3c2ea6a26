"""Secrets in texts: fixed patterns, and strings that a battery of randomness tests tells from ordinary ones.

The patterns find assignments, access keys and runs of hexadecimal digits. Candidates of the battery are runs of the letters of an
encoding that no pattern's match overlaps. The encoding is the smallest one whose alphabet holds the whole run. Its symbols' numbers
are tested for uniformity (chi-squared over bins of the alphabet), for runs below and above the alphabet's middle, and for serial
correlation; Fisher's method combines the three. A candidate is a secret if it passes as random, and if an ordinary string of its
length would hardly have been that uniform: the chi-squared statistic of ordinary strings is noncentral, by the symbol shares of
the whole table times the length, so short strings can't be told apart and long ones can. Those p-values go through
Benjamini and Hochberg's procedure within classes of length, each distinct string being one hypothesis, so of the strings added in a
class at most `q` are expected to be ordinary.

Only DataFrame functions are used. Matches get their places from what split() leaves between them. Texts are read twice, for
symbols' counts (64 rows at most) and for spans; spans and candidates are written without the text. P-values are counted in
tenths of a decade, so a class has `BINS` counts; the limits, one a class, come to the driver.

Null, empty and spanless texts have no spans, counts of 0 and the digest of nothing. Repeated rows have equal spans; equal starts are
ordered by kind. An empty table gives an empty one. A run of one symbol is never random. Columns added replace equally named ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import pi

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import documents, fresh, text_of, written

#: Patterns of the base, by kind in order of rank, as the operator's definition states them: (pattern, group whose length counts, least length).
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": ("AKIA[A-Z0-9]+", 0, 18),
    "hex": ("[0-9a-f]+", 0, 16),
}
#: The same matches, without those whose length fails at every start: the runs of one class of letters.
_FASTER = {"access": "AKIA[A-Z0-9]{14,}", "hex": "[0-9a-f]{16,}"}
RANDOM = "random"
CANDIDATE = "[A-Za-z0-9+/]{20,}={0,2}|[A-Za-z0-9_-]{20,}"
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


@dataclass(frozen=True)
class Encoding:
    """An alphabet in order of its symbols' numbers, in bins of `width` symbols; `fits` is the pattern of whole strings."""

    fits: str
    alphabet: str
    width: int
    lower: bool = False

    def bins(self) -> list[str]:
        return [self.alphabet[i : i + self.width] for i in range(0, len(self.alphabet), self.width)]


#: From the smallest alphabet to the largest; the first that fits is taken.
ENCODINGS = (
    Encoding("[0-9A-F]+", _DIGITS + "ABCDEF", 2),
    Encoding("[A-Z2-7]+", _UPPER + "234567", 4),
    Encoding("[a-z0-9]+|[A-Z0-9]+", _DIGITS + _LOWER, 4, True),
    Encoding("[A-Za-z0-9]+", _UPPER + _LOWER + _DIGITS, 8),
    Encoding("[A-Za-z0-9+/]+", _UPPER + _LOWER + _DIGITS + "+/", 8),
    Encoding("[A-Za-z0-9_-]+", _UPPER + _LOWER + _DIGITS + "-_", 8),
)
#: Lower ends of the classes of length; counts of p-values in a class; least combined p-value of what passes as random.
LENGTHS, BINS, PASSES = (20, 24, 32, 48, 64), 301, 0.001


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column) -> Column:
    """Running sums of an array of longs, in log2 of its size passes."""
    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    step = lambda sums, k: _let(F.pow(F.lit(2), k).cast("int"), lambda back: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - back), F.lit(0))))
    return F.aggregate(passes, values, step)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """(start, end, text of the group) of each match, leftmost first, in code points; the pattern matches nothing empty."""

    def placed(gaps: Column, found: Column, own: Column) -> Column:
        sums = running(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("long")))
        return _let(sums, lambda ends: F.transform(found, lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), F.get(own, i).alias("what"))))

    whole, own = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    found = _let(whole, lambda m: placed(F.split(text, pattern, -1), m, own if group else m))
    return F.when(text.rlike(pattern), found).otherwise(F.lit([]).cast("array<struct<start:bigint,end:bigint,what:string>>"))


def base_spans(text: Column) -> Column:
    """(start, rank, end) of the fixed patterns' matches, by start, then rank."""

    def of(rank: int, kind: str) -> Column:
        pattern, group, least = BASE[kind]
        good = F.filter(matches(text, _FASTER.get(kind, pattern), group), lambda m: F.length(m["what"]) >= least)
        return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))

    return F.array_sort(F.concat(*[of(rank, kind) for rank, kind in enumerate(BASE)]))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal Z, for z >= 0 by a polynomial in 1 / (1 + 0.2316419 z)."""
    # fixed values: coefficients of formula 26.2.17 of Abramowitz and Stegun
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / (2 * pi) ** 0.5 * poly
    return F.when(z < 0, 1 - tail).otherwise(tail)


def cube_root_z(x: Column, mean: Column | float, df: Column | float) -> Column:
    """Wilson and Hilferty's normal deviate of x, a multiple of a chi-squared with df degrees and the given mean."""
    c = F.lit(2.0) / (F.lit(9.0) * df)
    return (F.pow(x / mean, F.lit(1 / 3)) - (1 - c)) / F.sqrt(c)


def battery(token: Column, e: Encoding, share: float) -> Column:
    """(n, random, ordinary): symbols, combined p-value of the three tests, and p-value of an ordinary string being as uniform.

    `share` is the noncentrality of ordinary strings a symbol.
    """
    bins, k = e.bins(), len(e.alphabet)
    body = F.regexp_replace(F.lower(token) if e.lower else token, "=+$", "")
    numbers = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.instr(F.lit(e.alphabet), c) - 1)
    clear = lambda p: F.greatest(p, F.lit(1e-300))
    both = lambda z: 2 * upper_tail(F.abs(z))

    def uniform(v: Column, n: Column) -> Column:
        seen = lambda j: F.size(F.filter(v, lambda x: F.floor(x / e.width) == j)).cast("double")
        parts = [F.pow(seen(j), F.lit(2.0)) * k / len(b) for j, b in enumerate(bins)]
        return sum(parts[1:], parts[0]) / n - n

    def runs(v: Column, n: Column) -> Column:
        low = F.transform(v, lambda x: x < k // 2)
        changes = _let(low, lambda s: F.size(F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.get(s, i) != F.get(s, i - 1))))
        below = F.size(F.filter(v, lambda x: x < k // 2)).cast("double")
        mean = 2 * below * (n - below) / n
        spread = F.sqrt(mean * (mean - 1) / (n - 1))
        return F.when((below == 0) | (below == n), F.lit(0.0)).otherwise(both((changes - mean) / F.greatest(spread, F.lit(1e-9))))

    def serial(v: Column, n: Column) -> Column:
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
        off = _let(mean, lambda m: F.transform(v, lambda x: x - m))
        squares = lambda d: F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x)
        lagged = lambda d: F.aggregate(F.sequence(F.lit(1), F.size(d) - 1), F.lit(0.0), lambda a, i: a + F.get(d, i) * F.get(d, i - 1))
        z = lambda d: (lagged(d) / squares(d) + 1 / n) * F.sqrt(n)
        return _let(off, lambda d: F.when(squares(d) == 0, F.lit(0.0)).otherwise(both(z(d))))

    def judged(v: Column, n: Column, x: Column) -> Column:
        df = len(bins) - 1
        tests = [upper_tail(cube_root_z(x, float(df), float(df))), runs(v, n), serial(v, n)]
        fisher = -sum((F.log(clear(p)) for p in tests[1:]), F.log(clear(tests[0])))  # half of Fisher's statistic, which has 6 degrees
        combined = _let(fisher, lambda h: F.exp(-h) * (1 + h + h * h / 2))
        noncentral = n * share
        mean = df + noncentral
        z = cube_root_z(x, mean, mean * mean / (df + 2 * noncentral))
        return F.struct(n.cast("long").alias("n"), combined.alias("random"), clear(upper_tail(-z)).alias("ordinary"))

    return _let(numbers, lambda v: _let(F.size(v).cast("double"), lambda n: _let(uniform(v, n), lambda x: judged(v, n, x))))


def symbol_counts(df: DataFrame, text: str = "text") -> dict[str, int]:
    """How often each symbol of the encodings occurs in all texts."""
    runs = df.select(F.explode(F.regexp_extract_all(text_of(df, text), F.lit("[A-Za-z0-9+/_-]{1,1000}"), F.lit(0))).alias("run"))
    symbols = runs.select(F.explode(F.split("run", "")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return {r["c"]: r["n"] for r in symbols.collect() if r["c"]}


def shares(counts: dict[str, int]) -> list[float]:
    """For each encoding, the noncentrality a symbol of strings drawn by the counts: sum of share squared over expected share, less 1."""
    out = []
    for e in ENCODINGS:
        n = [sum(counts.get(c, 0) for c in b) for b in e.bins()]
        total = sum(n)
        out.append(sum(x * x / total / total * len(e.alphabet) / len(b) for x, b in zip(n, e.bins(), strict=True)) - 1 if total else 0.0)
    return out


def _tested(token: Column, by: list[float]) -> Column:
    out = F.lit(None).cast("struct<n:bigint,random:double,ordinary:double>")
    for e, share in reversed(list(zip(ENCODINGS, by, strict=True))):
        out = F.when(token.rlike(f"^({e.fits})=*$"), battery(token, e, share)).otherwise(out)
    return out


def _class(n: Column) -> Column:
    """The class of a length."""
    return sum(((n >= x).cast("int") for x in LENGTHS[1:]), F.lit(0))


def scanned(df: DataFrame, keep: list[str], text: str, base: str, candidates: str, by: list[float]) -> DataFrame:
    """The columns `keep` of df with the base's spans and the tested candidates (start, end, class, bin, passes, token)."""

    def tested(spans: Column, found: Column) -> Column:
        free = F.filter(found, lambda m: ~F.exists(spans, lambda s: (s["start"] < m["end"]) & (s["end"] > m["start"])))
        one = lambda m: _let(_tested(m["what"], by), lambda t: F.struct(m["start"].alias("start"), m["end"].alias("end"), _class(t["n"]).alias("class"), F.least(F.floor(-10 * F.log10(t["ordinary"])).cast("int"), F.lit(BINS - 1)).alias("bin"), (t["random"] >= PASSES).alias("passes"), F.md5(m["what"].cast("binary")).alias("token")))
        return F.transform(free, one)

    rows = df.select(*[F.col(f"`{c}`") for c in keep], base_spans(text_of(df, text)).alias(base), matches(text_of(df, text), CANDIDATE).alias(candidates))
    return rows.withColumn(candidates, tested(F.col(base), F.col(candidates)))


def limits(rows: DataFrame, candidates: str, q: float) -> dict[int, int]:
    """For each class of length, the least bin of -10 log10 of the p-value that Benjamini and Hochberg's procedure accepts, if any.

    A bin is judged by its largest p-value; each distinct string counts once.
    """
    each = rows.select(F.explode(candidates).alias("c")).select("c.class", "c.bin", "c.token").distinct()
    counts = each.groupBy("class", "bin").agg(F.count(F.lit(1)).alias("n"))  # at most len(LENGTHS) * BINS rows
    down, all_ = Window.partitionBy("class").orderBy(F.col("bin").desc()), Window.partitionBy("class")
    good = counts.withColumns({"k": F.sum("n").over(down), "m": F.sum("n").over(all_)}).where(F.pow(F.lit(10.0), -F.col("bin") / 10) <= q * F.col("k") / F.col("m"))
    return {r["class"]: r["bin"] for r in good.groupBy("class").agg(F.min("bin").alias("bin")).collect()}


def find(df: DataFrame, text: str = "text", keep: list[str] | None = None, secrets: str = "secrets", base: str = "base", q: float = 0.05) -> DataFrame:
    """df, or its columns `keep`, with all spans and the base's spans: arrays of (start, rank, end), in code points, end exclusive.

    Rank is the kind's place in BASE; the battery's spans have the next one.
    """
    keep = df.columns if keep is None else keep
    keep = [c for c in keep if c not in (secrets, base)]
    (candidates,) = fresh(df.select(*[F.col(f"`{c}`") for c in keep]), "candidates")
    rows = written(scanned(df, keep, text, base, candidates, shares(symbol_counts(df, text))), "secrets")
    least = limits(rows, candidates, q)
    accepted = lambda c: F.coalesce(F.get(F.array(*[F.lit(least.get(i)).cast("int") for i in range(len(LENGTHS))]), c["class"]) <= c["bin"], F.lit(False))
    added = F.transform(F.filter(candidates, lambda c: c["passes"] & accepted(c)), lambda c: F.struct(c["start"].alias("start"), F.lit(len(BASE)).alias("rank"), c["end"].alias("end")))
    return rows.withColumn(secrets, F.array_sort(F.concat(base, added))).drop(candidates)


def named(spans: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in (*BASE, RANDOM)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_randomness_tests(spark, sf_dir: str) -> DataFrame:
    rows = find(documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])
    n = lambda spans, rank: F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")
    counts, n_random = [n("base", r).alias(f"n_{k}") for r, k in enumerate(BASE)], n("secrets", len(BASE)).alias("n_random")
    return rows.select("doc_id", *counts, F.sha2(named("base").cast("binary"), 256).alias("base_sha256"), named("secrets").alias("spans"), n_random)


def _sql_tail(z: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    tail = f"(exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"(CASE WHEN {z} < 0 THEN 1 - {tail} ELSE {tail} END)"


def oracle(q: float = 0.05) -> str:
    """DuckDB twin of op13_randomness_tests: places by window sums, tests by groups of (string, symbol) rows."""
    patterns = [(k, r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""" if k == "assign" else p, g, n) for k, (p, g, n) in BASE.items()]
    lit = lambda x: "'" + x.replace("'", "''") + "'"
    found = " UNION ALL ".join(
        f"SELECT doc_id, {r} AS rank, what, doc_end - length(what) AS s, doc_end AS e FROM (SELECT doc_id, i, what, sum(length(gap) + coalesce(length(what), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS doc_end"
        f" FROM (SELECT doc_id, unnest(range(len(gaps))) AS i, unnest(gaps) AS gap, unnest(list_append(ms, NULL)) AS what FROM (SELECT doc_id, string_split_regex(t, {lit(p)}) AS gaps, regexp_extract_all(t, {lit(p)}) AS ms FROM d)))"
        f" WHERE what IS NOT NULL AND length({f'regexp_extract(what, {lit(p)}, {g})' if g else 'what'}) >= {n}"
        for r, (_, p, g, n) in enumerate([*patterns, (RANDOM, CANDIDATE, 0, 0)])
    )
    codes = ", ".join(f"({i}, {lit(e.alphabet)}, {len(e.alphabet)}, {e.width}, {len(e.bins()) - 1})" for i, e in enumerate(ENCODINGS))
    which = " ".join(f"WHEN regexp_full_match(what, {lit(f'({e.fits})=*')}) THEN {i}" for i, e in enumerate(ENCODINGS))
    lowered = " OR ".join(f"enc = {i}" for i, e in enumerate(ENCODINGS) if e.lower)
    cube = lambda x, mean, df: f"((pow({x} / ({mean}), 1.0 / 3) - (1 - 2.0 / (9.0 * ({df})))) / sqrt(2.0 / (9.0 * ({df}))))"
    kinds = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate([*BASE, RANDOM]))
    text = f"string_agg((CASE rank {kinds} END) || ':' || s || ':' || e, ',' ORDER BY s, rank)"
    classes = " + ".join(f"(n >= {x})::INT" for x in LENGTHS[1:])
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
c AS (SELECT *, CASE {which} END AS enc FROM f WHERE rank = {len(BASE)} AND NOT EXISTS (SELECT 1 FROM f AS b WHERE b.rank < {len(BASE)} AND b.doc_id = f.doc_id AND b.s < f.e AND b.e > f.s)),
codes(enc, alphabet, k, width, df) AS (VALUES {codes}),
symbols AS (SELECT enc, k, width, df, unnest(range(k)) AS v, substr(alphabet, unnest(range(k))::INT + 1, 1) AS c FROM codes),
bins AS (SELECT enc, k, v // width AS bin, count(*) AS size FROM symbols GROUP BY ALL),
seen AS (SELECT c, count(*) AS n FROM (SELECT unnest(regexp_extract_all(t, '[A-Za-z0-9+/_-]')) AS c FROM d) GROUP BY c),
shares AS (SELECT enc, sum(n * n / total / total * k / size) - 1 AS share FROM (SELECT enc, bin, k, size, coalesce(n, 0)::DOUBLE AS n, sum(coalesce(n, 0)) OVER (PARTITION BY enc)::DOUBLE AS total
             FROM bins LEFT JOIN (SELECT enc, v // width AS bin, sum(n) AS n FROM symbols JOIN seen USING (c) GROUP BY ALL) USING (enc, bin)) WHERE total > 0 GROUP BY enc),
chars AS (SELECT doc_id, s, enc, unnest(range(length(body))) AS i, substr(body, unnest(range(length(body)))::INT + 1, 1) AS c
          FROM (SELECT doc_id, s, enc, rtrim(CASE WHEN {lowered} THEN lower(what) ELSE what END, '=') AS body FROM c)),
vs AS (SELECT doc_id, s, enc, i, v, k, df, v // width AS bin, v < k // 2 AS low, lag(v) OVER w AS before, lag(v < k // 2) OVER w AS low_before, avg(v) OVER (PARTITION BY doc_id, s) AS mean
       FROM chars JOIN symbols USING (enc, c) WINDOW w AS (PARTITION BY doc_id, s ORDER BY i)),
chi AS (SELECT doc_id, s, sum(o * o * k / size) / sum(o) - sum(o) AS x FROM (SELECT doc_id, s, enc, bin, count(*)::DOUBLE AS o FROM vs GROUP BY ALL) JOIN bins USING (enc, bin) GROUP BY ALL),
st AS (SELECT doc_id, s, enc, df, count(*)::DOUBLE AS n, count(*) FILTER (low)::DOUBLE AS below, count(*) FILTER (low <> low_before) AS changes,
              sum((v - mean) * (before - mean)) AS lagged, sum((v - mean) * (v - mean)) AS squares FROM vs GROUP BY ALL),
zs AS (SELECT *, 2 * below * (n - below) / n AS expected FROM st JOIN chi USING (doc_id, s) LEFT JOIN shares USING (enc)),
zz AS (SELECT *, {cube('x', 'df', 'df')} AS z1, (changes - expected) / greatest(sqrt(greatest(expected * (expected - 1), 0) / (n - 1)), 1e-9) AS z2, (lagged / nullif(squares, 0) + 1 / n) * sqrt(n) AS z3,
              {cube('x', 'df + n * share', '(df + n * share) * (df + n * share) / (df + 2 * n * share)')} AS z4 FROM zs),
ps AS (SELECT *, -ln(greatest({_sql_tail('z1')}, 1e-300)) - ln(greatest(CASE WHEN below = 0 OR below = n THEN 0.0 ELSE 2 * {_sql_tail('abs(z2)')} END, 1e-300))
                 - ln(greatest(CASE WHEN squares = 0 THEN 0.0 ELSE 2 * {_sql_tail('abs(z3)')} END, 1e-300)) AS h, greatest({_sql_tail('-z4')}, 1e-300) AS ordinary FROM zz),
t AS (SELECT doc_id, s, {classes} AS class, least(floor(-10 * log10(ordinary))::INT, {BINS - 1}) AS bin, exp(-h) * (1 + h + h * h / 2) >= {PASSES} AS passes FROM ps),
ks AS (SELECT class, bin, sum(count(*)) OVER (PARTITION BY class ORDER BY bin DESC) AS k, sum(count(*)) OVER (PARTITION BY class) AS m FROM (SELECT DISTINCT class, bin, what FROM t JOIN c USING (doc_id, s)) GROUP BY class, bin),
least_bin AS (SELECT class, min(bin) AS least FROM ks WHERE pow(10.0, -bin / 10.0) <= {q} * k / m GROUP BY class),
added AS (SELECT c.doc_id, c.rank, c.s, c.e FROM c JOIN t USING (doc_id, s) JOIN least_bin USING (class) WHERE passes AND bin >= least),
spans AS (SELECT doc_id, rank, s, e FROM f WHERE rank < {len(BASE)} UNION ALL SELECT * FROM added),
b AS (SELECT doc_id, {text} AS base FROM spans WHERE rank < {len(BASE)} GROUP BY doc_id),
a AS (SELECT doc_id, {text} AS spans, {', '.join(f"count(*) FILTER (rank = {i}) AS n_{k}" for i, k in enumerate([*BASE, RANDOM]))} FROM spans GROUP BY doc_id)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in [*BASE, RANDOM])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)"""


SQL = {"op13_randomness_tests": oracle()}
