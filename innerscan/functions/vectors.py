"""Column functions over dense vectors, bit sets and sign hashes.

Everything here is a JVM expression, summed as DOUBLE in array order, so
results do not depend on partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-30
HASH_BITS = 16


def _fold(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def inner_product(a: Column, b: Column) -> Column:
    """Sum of products; arrays of different lengths give null."""
    return _fold(as_double(a), as_double(b), lambda x, y: x * y)


def negative_inner_product(a: Column, b: Column) -> Column:
    """Inner product as a distance: smaller is better."""
    return -inner_product(a, b)


def l2_squared(a: Column, b: Column) -> Column:
    return _fold(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))


def l1(a: Column, b: Column) -> Column:
    return _fold(as_double(a), as_double(b), lambda x, y: F.abs(x - y))


def linf(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(as_double(a), as_double(b), lambda x, y: F.abs(x - y)))


def squared_norm(v: Column) -> Column:
    return inner_product(v, v)


def norm(v: Column) -> Column:
    return F.sqrt(squared_norm(v))


def normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    n = norm(v)
    return F.transform(as_double(v), lambda x: x / (n + F.lit(EPS)))


def scale(v: Column, by: Column) -> Column:
    return F.transform(as_double(v), lambda x: x * by)


def bit_count_of(a: Column) -> Column:
    """Set bits in an array of non-negative integers."""
    return F.aggregate(a, F.lit(0), lambda s, x: s + F.bit_count(x))


def _bits(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(f(x, y))), F.lit(0), lambda s, x: s + x)


def hamming(a: Column, b: Column) -> Column:
    return _bits(a, b, lambda x, y: x.bitwiseXOR(y))


def union_bits(a: Column, b: Column) -> Column:
    return _bits(a, b, lambda x, y: x.bitwiseOR(y))


def common_bits(a: Column, b: Column) -> Column:
    return _bits(a, b, lambda x, y: x.bitwiseAND(y))


def jaccard_distance(a: Column, b: Column) -> Column:
    """(union - intersection) / union of two bit sets; two empty sets: 1."""
    n = union_bits(a, b)
    return F.when(n == 0, F.lit(1.0)).otherwise((n - common_bits(a, b)) / n)


def hash_distance(a: Column, b: Column, tables: int = 4) -> Column:
    """Differing bits of two sign hashes given as arrays; only the first ``tables`` words count."""
    return hamming(F.slice(a, 1, tables), F.slice(b, 1, tables))


def cosine_table(bits: int = 64, z: float | None = 3.0) -> list[float]:
    """For each number of differing bits, a bound on the cosine, ``z`` deviations of the angle's estimate away."""
    out = []
    for i in range(bits + 1):
        theta = i * math.pi / bits
        if z is not None:
            theta = max(0.0, theta - z * math.sqrt(theta * (math.pi - theta) / bits))
        out.append(math.cos(theta))
    return out


def estimated_ip(diff: Column, norm_: Column, z: float | None = 3.0, bits: int = 64) -> Column:
    """Estimate (for a positive ``z``: a likely upper bound) of a unit query's inner product."""
    return norm_ * F.element_at(F.array(*[F.lit(x) for x in cosine_table(bits, z)]), diff + 1)


def may_reach(norm_: Column, threshold: Column) -> Column:
    """Norm predicate: a unit query's inner product can't exceed the norm."""
    return norm_ >= threshold


def angle_may_reach(diff: Column, norm_: Column, threshold: Column, z: float | None = 3.0, bits: int = 64) -> Column:
    """Angle predicate: the estimate reaches the threshold."""
    return estimated_ip(diff, norm_, z, bits) >= threshold


def same_elements(a: Column) -> Column:
    """Whether an array has no repeated element."""
    return F.size(a) == F.size(F.array_distinct(a))


def to_binary(v: Column) -> Column:
    """An integer's binary digits, for reading hashes."""
    return F.lpad(F.bin(v), HASH_BITS, "0")


def ends_with(name: Column, suffix: str) -> Column:
    return F.endswith(name, F.lit(suffix))
