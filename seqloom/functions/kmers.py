"""k-mers, minimisers and windows as column expressions.

Arrays are bound once by a lambda's variable, so nothing is evaluated anew for each element, and a k-mer's hash comes from
log2(k) passes over the array rather than from k characters each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: IUPAC letters and what they are read as; all others are A.
IUPAC_FROM, IUPAC_TO = "URYSWKMBDHVN", "TACCAGACAAAA"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value being evaluated once."""
    return F.transform(F.array(value), body)[0]


def text_as_dna(text: Column) -> Column:
    """The bases in a text, in upper case; other characters are left out, a whole run of them at once."""
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^ACGTacgt]+", ""))


def coerce_dna(seq: Column) -> Column:
    """A sequence over the IUPAC letters as one over ACGT. What isn't ASCII is A before letters get their upper case."""
    return F.regexp_replace(F.translate(F.upper(F.regexp_replace(seq, "[^\\x00-\\x7F]", "A")), IUPAC_FROM, IUPAC_TO), "[^ACGT]", "A")


def codes(seq: Column) -> Column:
    """A 0, C 1, G 2, T 3."""
    return F.transform(F.filter(F.split(F.translate(seq, "ACGT", "0123"), ""), lambda c: c != ""), lambda c: c.cast("long"))


def rolled(c: Column, k: int) -> Column:
    """Base-4 values of all runs of k codes; empty if there are fewer."""

    def joined(left: Column, right: Column, a: int, b: int) -> Column:
        # runs of a + b from runs of a and of b
        n = F.greatest(F.size(right) - a, F.lit(0))
        return F.transform(F.slice(left, 1, n), lambda x, i: x * (4**b) + F.get(right, i + a))

    def of(j: int) -> Callable[[Column], Column]:
        """Function of the codes that gives their runs of j."""
        if j == 1:
            return lambda x: x
        half = j // 2
        if j % 2 == 0:
            return lambda x: let(of(half)(x), lambda h: joined(h, h, half, half))
        return lambda x: let(of(j - 1)(x), lambda h: joined(h, x, j - 1, 1))

    return let(c, of(k))


def kmers(seq: Column, k: int) -> Column:
    """Hashes of all k-mers of the forward strand, in order."""
    return rolled(codes(seq), k)


def canonical_kmers(seq: Column, k: int, seed: int = 0) -> Column:
    """At each position the lesser of both strands' hashes."""
    other = kmers(F.reverse(F.translate(seq, "ACGT", "TGCA")), k)
    return let(F.reverse(other), lambda r: F.transform(kmers(seq, k), lambda h, i: F.least(seeded(h, seed), seeded(F.get(r, i), seed))))


def seeded(h: Column, seed: int) -> Column:
    """The hash in another order."""
    return h.bitwiseXOR(F.lit(seed).cast("long")) if seed else h


def hashes(seq: Column, k: int, canonical: bool = False, seed: int = 0) -> Column:
    if canonical:
        return canonical_kmers(seq, k, seed)
    return F.transform(kmers(seq, k), lambda h: seeded(h, seed)) if seed else kmers(seq, k)


def minimiser_set(h: Column, width: int) -> Column:
    """Distinct minima of all windows of `width` hashes (one window where there are fewer), ascending.

    Minima of runs of 2, 4, 8 ... are combined, so a window costs log2(width) steps.
    """

    def mins(x: Column, j: int, k: int) -> Column:
        # minima of runs of j + k, from x of runs of j, k <= j
        n = F.greatest(F.size(x) - k, F.lit(0))
        return F.transform(F.slice(x, 1, n), lambda a, i: F.least(a, F.get(x, i + k)))

    def sliding(x: Column) -> Column:
        out, have = (lambda y: y), 1
        while have < width:
            step = min(have, width - have)
            out = (lambda f, j, s: lambda y: let(f(y), lambda z: mins(z, j, s)))(out, have, step)
            have += step
        return out(x)

    single = lambda x: F.filter(F.array(F.array_min(x)), lambda v: v.isNotNull())
    return let(h, lambda x: F.array_sort(F.array_distinct(F.when(F.size(x) < width, single(x)).otherwise(sliding(x)))))


def n_windows(n: Column, width: int, step: int) -> Column:
    """Windows that start before the last one that ends on the last k-mer: 0 where n <= width."""
    return F.greatest(F.lit(0), F.ceil((n - F.lit(width)) / F.lit(step))).cast("int")


def windows(h: Column, width: int, step: int, s: int) -> Column:
    """For each window its s smallest hashes, equal ones kept."""
    starts = lambda x: F.when(F.size(x) > width, F.sequence(F.lit(0), n_windows(F.size(x), width, step) - 1)).otherwise(F.array().cast("array<int>"))
    return let(h, lambda x: F.transform(starts(x), lambda j: F.slice(F.sort_array(F.slice(x, j * step + 1, width)), 1, s)))


def window_minima(h: Column, width: int, step: int) -> Column:
    """For each window its least hash and the right-most place that has it."""
    starts = lambda x: F.when(F.size(x) > width, F.sequence(F.lit(0), n_windows(F.size(x), width, step) - 1)).otherwise(F.array().cast("array<int>"))
    least = lambda x, j: let(F.slice(x, j * step + 1, width), lambda w: F.struct(F.array_min(w).alias("h"), (j * step + F.size(w) - F.array_position(F.reverse(w), F.array_min(w))).cast("int").alias("pos")))
    return let(h, lambda x: F.transform(starts(x), lambda j: least(x, j)))


def mer(h: Column, k: int) -> Column:
    """The k-mer of a hash."""
    return F.translate(F.lpad(F.conv(h.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def gapped(h_codes: Column, shape: str) -> Column:
    """Hashes of a gapped shape such as 1101: only positions marked 1 count."""
    offsets = [i for i, x in enumerate(shape) if x == "1"]
    n = len(shape)
    value = lambda x, i: sum((F.get(x, i + o) * (4 ** (len(offsets) - 1 - p)) for p, o in enumerate(offsets)), F.lit(0).cast("long"))
    return let(h_codes, lambda x: F.transform(F.slice(x, 1, F.greatest(F.size(x) - n + 1, F.lit(0))), lambda _, i: value(x, i)))
