"""Column expressions on vectors (arrays of numbers). Everything stays in the JVM.

For bulk distances against a codebook use `tessera.operators.knn`, which multiplies matrices.
"""

from __future__ import annotations

from functools import reduce
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    """Null where b is 0."""
    return F.zip_with(a, b, lambda x, y: F.try_divide(x, y))


def norm(v: Column, p: float) -> Column:
    if p == 1:
        return total(F.transform(v, F.abs))
    if p == 2:
        return F.sqrt(total(F.transform(v, lambda x: x * x)))
    return F.pow(total(F.transform(v, lambda x: F.pow(F.abs(x), F.lit(float(p))))), F.lit(1.0 / p))


def normalized(v: Column, p: float = 2) -> Column:
    """The vector over its norm; unchanged if that is 0."""
    n = norm(v, p)
    return F.transform(v, lambda x: F.when(n != 0, x / n).otherwise(x))


def without_nans(v: Column, value: float) -> Column:
    return F.transform(v, lambda x: F.nanvl(x, F.lit(value)))


def inner_product(a: Column, b: Column) -> Column:
    return total(multiply(a, b))


def distance_l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def distance_l2_squared(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance_chi2(a: Column, b: Column) -> Column:
    """Symmetric: the sum of (x - y)^2 / (x + y); a term of sum 0 counts as 0."""
    return total(F.zip_with(a, b, lambda x, y: F.coalesce(F.try_divide((x - y) * (x - y), x + y), F.lit(0.0))))


def entropy(v: Column) -> Column:
    """In bits; entries that are not positive do not count."""
    return -total(F.transform(F.filter(v, lambda x: x > 0), lambda x: x * F.log2(x)))


def hadamard_sign(i: Column, j: Column) -> Column:
    return 1.0 - 2.0 * (F.bit_count(i.bitwiseAND(j)) % 2)


def quantized_scale(scale: Column) -> Column:
    """Logarithmic steps of 1.2, clamped to 0..31."""
    return F.greatest(F.lit(0), F.least(F.lit(31), (F.ln(scale) / F.ln(F.lit(1.2)) + 0.5).cast("int")))


def quantized_angle(angle: Column) -> Column:
    """64 steps of a turn from -pi on, clamped to 0..63."""
    return F.greatest(F.lit(0), F.least(F.lit(63), F.floor((angle + pi) * 64 / (2 * pi)).cast("int")))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def inside_half_planes(x: Column, y: Column, planes: list[tuple[float, float, float]]) -> Column:
    """a x + b y + c > 0 for every (a, b, c): a convex polygon."""
    return reduce(lambda p, q: p & q, [a * x + b * y + c > 0 for a, b, c in planes], F.lit(True))


def inverse_affine(m: Column) -> Column:
    """The inverse of (x, y) -> (m0 x + m1 y + m2, m3 x + m4 y + m5); null where there is none."""
    e = [m[i] for i in range(6)]
    det = e[0] * e[4] - e[1] * e[3]
    inverse = F.array(e[4] / det, -e[1] / det, (e[1] * e[5] - e[4] * e[2]) / det, -e[3] / det, e[0] / det, (e[3] * e[2] - e[0] * e[5]) / det)
    return F.when(det != 0, inverse)


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def constant(value: Column, n: int) -> Column:
    return F.array_repeat(value, n)


def numbered(n: int, first: int = 0) -> Column:
    """first, first + 1, .. of n entries."""
    return F.sequence(F.lit(first).cast("long"), F.lit(first + n - 1).cast("long"))


def permutation(key: Column, n: int) -> Column:
    """A random order of 0 .. n - 1 that depends on the key alone."""
    drawn = F.transform(numbered(n), lambda i: F.struct(F.md5(F.concat(key.cast("string"), F.lit("-"), i.cast("string"))).alias("h"), i.alias("i")))
    return F.transform(F.array_sort(drawn), lambda z: z["i"])


def shuffled(values: Column, key: Column, n: int) -> Column:
    """The n entries of an array in the order of `permutation`."""
    return F.transform(permutation(key, n), lambda i: F.element_at(values, (i + 1).cast("int")))


def histogram_distance(a: Column, b: Column) -> Column:
    """Sum of the whole parts of the differences."""
    return total(F.zip_with(a, b, lambda x, y: F.floor(F.abs(x - y)).cast("double")))


def chi_distance(a: Column, b: Column) -> Column:
    """Sum of ((x - y) / (x + y)) ** 2, 0 where x + y is 0."""
    return total(F.zip_with(a, b, lambda x, y: F.when(x + y == 0, 0.0).otherwise((x - y) * (x - y) / ((x + y) * (x + y)))))


def mahalanobis_diagonal(a: Column, b: Column, weights: Column) -> Column:
    """Sum of squared differences under a weight for each entry."""
    return total(F.zip_with(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), weights, lambda d, w: d * w))


def mahalanobis(a: Column, b: Column, inverse: Column) -> Column:
    """(a - b)' M (a - b) with the rows of the matrix M."""
    d = subtract(a, b)
    return inner_product(d, F.transform(inverse, lambda row: inner_product(row, d)))


def polar_distance(lengths_a: Column, angles_a: Column, lengths_b: Column, angles_b: Column, cut: float | None = None) -> Column:
    """Distance of vectors of (length, angle) pairs: lengths are compared after each is scaled by how near the angles are (1 the same, 0 opposite).

    With `cut`, the lengths of pairs nearer than that are compared as they are, those of others with nothing.
    """
    near = F.zip_with(angles_a, angles_b, lambda s, t: F.when(F.abs(s - t) < pi, 1 - F.abs(s - t) / pi).otherwise(1 - (2 * pi - F.abs(s - t)) / pi))
    both = F.zip_with(F.zip_with(lengths_a, lengths_b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), near, lambda p, k: F.struct(p["x"].alias("x"), p["y"].alias("y"), k.alias("k")))

    def term(p: Column) -> Column:
        x, y, k = p["x"], p["y"], p["k"]
        if cut is not None:
            return F.when(k > cut, (x - y) * (x - y)).otherwise(x * x + y * y)
        return ((x - k * y) * (x - k * y) + (k * x - y) * (k * x - y)) / (1 + k * k)

    return total(F.transform(both, term))
