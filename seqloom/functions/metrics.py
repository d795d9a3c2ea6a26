"""Similarities of signatures, from counts of bits or from bit arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def union_size(a: Column, b: Column, inter: Column) -> Column:
    return a + b - inter


def jaccard(a: Column, b: Column, inter: Column) -> Column:
    """Null where both are empty."""
    return F.try_divide(inter.cast("double"), (a + b - inter).cast("double"))


def hamming(a: Column, b: Column, inter: Column) -> Column:
    return a + b - 2 * inter


def containment(b: Column, inter: Column) -> Column:
    """Share of the second (the reference) that the first holds."""
    return F.try_divide(inter.cast("double"), b.cast("double"))


def smaller_share(a: Column, b: Column, inter: Column) -> Column:
    """Share of the smaller that is common."""
    return F.try_divide(inter.cast("double"), F.least(a, b).cast("double"))


def window_matches(a: Column, b: Column, inter: Column, threshold: int) -> Column:
    """A window matches with `threshold` common bits, or if both are equal and not empty."""
    return (inter >= threshold) | ((inter > 0) & (inter == a + b - inter))


def array_jaccard(a: Column, b: Column) -> Column:
    return jaccard(F.size(a), F.size(b), F.size(F.array_intersect(a, b)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda s, x: s + x))


def _windows(x: Column, y: Column, each) -> Column:
    """Sum of each(window of x, window of y) over the windows that both have."""
    n = F.least(F.size(x), F.size(y))
    return F.aggregate(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), each), F.lit(0), lambda a, v: a + v)


def windows_matching(x: Column, y: Column, threshold: int) -> Column:
    """Common windows that have more common bits than the lesser of threshold and x's own (arrays of windows, a window being an array of bits)."""
    return _windows(x, y, lambda a, b: (F.size(F.array_intersect(a, b)) > F.least(F.lit(threshold), F.size(a))).cast("int"))


def windows_match(x: Column, y: Column, threshold: int, share: float) -> Column:
    """Whether `share` of the common windows match; false where there is none."""
    n = F.least(F.size(x), F.size(y))
    return (n > 0) & (windows_matching(x, y, threshold) >= n * F.lit(share))


def windows_inter(x: Column, y: Column) -> Column:
    """Common bits of common windows."""
    return _windows(x, y, lambda a, b: F.size(F.array_intersect(a, b)))


def goes_left(own: Column, node: Column) -> Column:
    """Whether a signature has half of its bits, over the windows that a node has too, in common with the node."""
    return 2 * windows_inter(own, node) >= _windows(own, node, lambda a, b: F.size(a))
