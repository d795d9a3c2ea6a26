"""Signature bits of a hash, and what a signature's counts say."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import MASK32, SALT


def _mask(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MASK32).cast("long"))


def _product(a: Column, factor: int) -> Column:
    """Low 32 bits of a 32-bit number times a constant below 2^31, without overflow."""
    return _mask(a * F.lit(factor).cast("long"))


def bloom_hash(h: Column, k: int = 16) -> Column:
    """32-bit hash of an 8-byte key. Up to k = 16 the key's upper half is zero and only one product is left."""
    third, fifth, low = SALT >> 3, SALT >> 5, SALT << 11 & MASK32
    top = SALT ^ (SALT << 7 & MASK32)
    i1 = _mask(h)
    first = F.lit(top).cast("long").bitwiseXOR(_product(i1, third))
    if k <= 16:
        rest = F.lit(~(low + fifth) & MASK32).cast("long")
    else:
        i2 = F.shiftrightunsigned(h, 32)
        rest = F.lit(MASK32).cast("long") - _mask(F.lit(low).cast("long") + i2.bitwiseXOR(F.lit(fifth).cast("long")))
    return first.bitwiseXOR(rest)


def bloom_bit(h: Column, bits: int, k: int = 16) -> Column:
    return F.pmod(bloom_hash(h, k), F.lit(bits).cast("long")).cast("int")


def bits_of(hashes: Column, bits: int, k: int = 16) -> Column:
    """Distinct bits of an array of hashes, ascending."""
    return F.array_sort(F.array_distinct(F.transform(hashes, lambda h: bloom_bit(h, bits, k))))


def effective_rate(n: Column, bits: int, n_hashes: int = 1) -> Column:
    """False-positive rate after n insertions."""
    return F.pow(1 - F.exp(-n_hashes * n / F.lit(float(bits))), F.lit(float(n_hashes)))


def compressed_bit(bit: Column, sizes: list[int]) -> Column:
    """The bit after folding the table to each of the sizes in turn."""
    for size in sizes:
        bit = F.pmod(bit, F.lit(size))
    return bit
