"""Statistics of array columns, without exploding them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def quantile(a: Column, q: float) -> Column:
    """Linear interpolation between the sorted values at q * (n - 1)."""
    s = F.array_sort(a)
    place = F.lit(q) * (F.size(a) - 1)
    low = F.floor(place).cast("int")
    at = lambda i: F.get(s, i)
    return F.when(F.size(a) > 0, at(low) + (place - low) * (F.coalesce(at(low + 1), at(low)) - at(low)))


def median(a: Column) -> Column:
    return quantile(a, 0.5)


def absolute_deviation(a: Column) -> Column:
    """Median distance from the median."""
    return F.element_at(F.transform(F.array(median(a)), lambda m: median(F.transform(a, lambda x: F.abs(x - m)))), 1)


def masked(a: Column, mask: Column) -> Column:
    return F.filter(a, lambda x, i: F.coalesce(F.get(mask, i), F.lit(False)))


def every(a: Column, step: int, first: int = 0) -> Column:
    return F.filter(a, lambda x, i: i % step == first)


def rotated(a: Column, start: Column) -> Column:
    """The array from 0-based ``start`` on, then its beginning."""
    return F.concat(F.slice(a, start + 1, F.size(a)), F.slice(a, F.lit(1), start))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    grown = F.transform(a, lambda x: F.exp(x - top))
    return F.transform(grown, lambda x: x / F.aggregate(grown, F.lit(0.0), lambda s, y: s + y))


def argmax(a: Column) -> Column:
    """0-based place of the largest value; the first of equal ones."""
    return F.array_position(a, F.array_max(a)).cast("int") - 1


def one_hot(label: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == label).cast("int"))


def fourier_amplitude(a: Column, k: int) -> Column:
    """Length of the k-th discrete Fourier coefficient, over the square root of the number of values."""
    n = F.size(a)
    angle = lambda i: -2 * F.pi() * k * i / n
    pairs = F.transform(a, lambda x, i: F.struct((x * F.cos(angle(i))).alias("c"), (x * F.sin(angle(i))).alias("s")))
    c = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["c"])
    d = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["s"])
    return F.sqrt(c * c + d * d) / F.sqrt(n)


def padded(a: Column, n: int, fill: Column) -> Column:
    """The first ``n`` elements, filled up to ``n`` where there are fewer; null stays null."""
    return F.slice(F.concat(a, F.array_repeat(fill, n)), 1, n)


def trimmed(a: Column, least: int = 20) -> Column:
    """The array without its trailing zeros and nulls, but not shorter than ``least`` elements if it has as many."""
    last = F.array_max(F.transform(a, lambda v, i: F.when(v != 0, i + 1).otherwise(0)))
    return F.when(F.size(a) == 0, a).otherwise(F.slice(a, F.lit(1), F.greatest(last, F.lit(least))))


def repeated(a: Column, times: int) -> Column:
    """Each element ``times`` times, in place."""
    return F.flatten(F.transform(a, lambda v: F.array_repeat(v, times)))
