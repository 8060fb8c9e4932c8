"""Transforms of values to bins and back: signed bins of a monotone transform, logarithmic by default."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

Made = Callable[[Column], Column]


def approx_ln(x: Column) -> Column:
    """ln of a magnitude, finite at zero: the least positive normal float stands for what is smaller."""
    return F.ln(F.greatest(F.abs(x), F.lit(2.0**-126)))


@dataclass(frozen=True)
class Bins:
    """2n+1 bins of equal width in the transformed magnitude, from ``a`` to ``b``, for either sign.

    Bin n holds magnitudes below ``a``, bin 0 those below -b, bin 2n those from ``b`` up. NaN and null have no bin.
    """

    a: float
    b: float
    n: int
    transform: Made = field(default=F.ln)
    inverse: Made = field(default=F.exp)
    at: Callable[[float], float] = field(default=math.log)

    @property
    def low(self) -> float:
        return self.at(self.a)

    @property
    def width(self) -> float:
        return (self.at(self.b) - self.at(self.a)) / (self.n - 1)

    def index(self, x: Column) -> Column:
        x = x.cast("double")
        size = F.abs(x)
        step = F.floor((self.transform(size) - F.lit(self.low)) / F.lit(self.width)).cast("int")
        # rounding can put what is just below b a bin too high, and what is at a a bin too low
        step = F.when(size >= F.lit(float(self.b)), self.n - 1).otherwise(F.greatest(F.lit(0), F.least(F.lit(self.n - 2), step)))
        sign = F.when(x < 0, -1).otherwise(1)
        bin_ = F.when(size < F.lit(float(self.a)), self.n).otherwise(F.lit(self.n) + sign * (step + 1))
        return F.when(x.isNotNull() & ~F.isnan(x), bin_)

    def value(self, index: Column, offset: float = 0.5) -> Column:
        """The value at a place within a bin, its centre by default; 0 for the middle bin."""
        steps = F.abs(index - F.lit(self.n)).cast("double") - 1 + F.lit(offset)
        size = self.inverse(F.lit(self.low) + F.lit(self.width) * steps)
        return F.when(index == self.n, F.lit(0.0)).when(index > self.n, size).otherwise(-size)

    def edges(self, index: Column) -> tuple[Column, Column]:
        """The bin's lower and upper value."""
        inner, outer = self.value(index, 0.0), self.value(index, 1.0)
        low = F.when(index == self.n, F.lit(-float(self.a))).when(index > self.n, inner).otherwise(outer)
        high = F.when(index == self.n, F.lit(float(self.a))).when(index > self.n, outer).otherwise(inner)
        return low, high

    def same(self, other: Bins) -> bool:
        return (self.a, self.b, self.n, self.at(self.a), self.at(self.b)) == (other.a, other.b, other.n, other.at(other.a), other.at(other.b))


def logarithmic(a: float = 1e-16, b: float = 1e20, n: int = 8300) -> Bins:
    return Bins(a, b, n)


def square_root(a: float, b: float, n: int) -> Bins:
    return Bins(a, b, n, F.sqrt, lambda x: x * x, math.sqrt)


def linear(a: float, b: float, n: int) -> Bins:
    return Bins(a, b, n, lambda x: x, lambda x: x, float)
