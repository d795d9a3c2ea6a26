"""Parameters of sketches, validated once and immutable."""

from __future__ import annotations

import math
from dataclasses import dataclass

#: Fixed values of the signature format: false-positive rate and the salt of its single hash.
FALSE_POSITIVES = 0.001
SALT = 0x876E553E
MASK32 = (1 << 32) - 1


def optimal_bits(n_elements: int, p: float = FALSE_POSITIVES) -> int:
    """Bits of a table for n elements: the least -k n / ln(1 - p^(1/k)) over hash counts k, cut down, then up to whole bytes."""
    if n_elements < 1 or not 0 < p < 1:
        raise ValueError("a sketch needs at least one element and a rate between 0 and 1")
    least = min(-k * n_elements / math.log(1 - p ** (1 / k)) for k in range(1, 1000) if p ** (1 / k) < 1)
    return (int(least) + 7) // 8 * 8


@dataclass(frozen=True)
class SketchConfig:
    """k: k-mer length; w: window in bases; s: smallest hashes kept of a window; step: k-mers between windows (default w)."""

    k: int = 9
    w: int = 50
    s: int = 3
    step: int | None = None
    canonical: bool = False
    seed: int = 0
    n_elements: int = 1000

    def __post_init__(self):
        if not 1 <= self.k <= 31:
            raise ValueError("k must lie between 1 and 31, so that hashes stay positive")
        if self.k > self.w:
            raise ValueError("k must not be larger than the window")
        if self.s > self.w - self.k + 1 or self.s < 1:
            raise ValueError("a window has w - k + 1 hashes, so s can't be larger")
        if self.step is not None and self.step < 1:
            raise ValueError("step must be positive")

    @property
    def width(self) -> int:
        """k-mers of a window."""
        return self.w - self.k + 1

    @property
    def hop(self) -> int:
        return self.step or self.w

    @property
    def bits(self) -> int:
        return optimal_bits(self.n_elements)
