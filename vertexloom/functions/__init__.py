"""Scalar functions: geometry of the plane and of the hyperbolic disk, triangular numbers, bit lengths, root finding."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(a: list[Column], b: list[Column]) -> Column:
    out = F.lit(0.0)
    for x, y in zip(a, b, strict=True):
        out = out + (x - y) * (x - y)
    return out


def hyperbolic_distance(r1: Column, phi1: Column, r2: Column, phi2: Column) -> Column:
    """In polar coordinates; 0 where rounding leaves the cosh below 1."""
    return F.acosh(F.greatest(F.lit(1.0), F.cosh(r1) * F.cosh(r2) - F.sinh(r1) * F.sinh(r2) * F.cos(phi1 - phi2)))


def to_cartesian(r: Column, phi: Column) -> tuple[Column, Column]:
    return r * F.cos(phi), r * F.sin(phi)


def to_polar(x: Column, y: Column) -> tuple[Column, Column]:
    return F.sqrt(x * x + y * y), F.pmod(F.atan2(y, x), F.lit(2 * math.pi))


def to_euclidean_radius(r: Column) -> Column:
    """Of a hyperbolic radius, in the Poincaré disk."""
    return F.tanh(r / 2)


def to_hyperbolic_radius(r: Column) -> Column:
    return 2 * F.atanh(r)


def bit_length(x: Column) -> Column:
    """floor(log2 x) + 1 for x > 0, 0 for 0; exact, unlike a floating logarithm."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def divided(a: Column, b: Column, default: float) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def div(a: Column, k: int | Column) -> Column:
    """a div k in longs, exact where a floating quotient is not (from 2^53)."""
    return F.call_function("div", a.cast("long"), (k if isinstance(k, Column) else F.lit(k)).cast("long"))


def below(row: Column) -> Column:
    """How many cells below the diagonal stand before a row: row (row - 1) / 2, without a product that overflows."""
    return F.shiftright(row, 1) * (row - 1 + row.bitwiseAND(F.lit(1)))


def from_triangle(k: Column) -> tuple[Column, Column]:
    """(row, column), column < row, of the k-th cell below the diagonal, k below 2^62. The floating root is off by one at
    most and corrected in longs."""
    guess = F.floor((F.sqrt(8.0 * k + 1) + 1) / 2).cast("long")
    row = F.when(below(guess) > k, guess - 1).when(below(guess + 1) <= k, guess + 1).otherwise(guess)
    return row, k - below(row)


def newton(f: Callable[[float], float], df: Callable[[float], float], x: float, steps: int = 100, tolerance: float = 1e-12) -> float:
    for _ in range(steps):
        slope = df(x)
        if not slope:
            break
        nxt = x - f(x) / slope
        if abs(nxt - x) < tolerance:
            return nxt
        x = nxt
    return x


def hyperbolic_radius(n: int, degree: float, gamma: float) -> float:
    """The disk's radius at which n vertices have an expected degree, by bisection on the closed form of Krioukov et al.,
    "Hyperbolic geometry of complex networks" (2010)."""
    alpha = (gamma - 1) / 2
    xi = alpha / (alpha - 0.5)

    def expected(r: float) -> float:
        far = math.exp(-alpha * r) * (alpha * (r / 2) * ((math.pi / 4) / alpha**2 - (math.pi - 1) / alpha + (math.pi - 2)) - 1)
        return (2 / math.pi) * n * xi * xi * (math.exp(-r / 2) + far)

    low, high = 0.0, 2 * math.log(max(2, n)) + 50
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if expected(mid) > degree else (low, mid)
    return (low + high) / 2
