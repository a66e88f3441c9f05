"""Column expressions for cash losses, scores, order statistics and small linear systems."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.books import BOOKS, REPORTS


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that the input does not have, whatever its columns are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def r6(x: Column) -> Column:
    """Six decimals, never a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def cash_loss(weights: Sequence[float], base_weight: float, r1: Sequence[Column], r2: Sequence[Column], report: int) -> Column:
    """Loss of a book over the second path increment, set up after the first, in units of a reported series.

    weights: of the four series; base_weight: of the numeraire, whose increments
    are zero. r1, r2: log increments of the four series. report: 0 for the
    numeraire, else the number of the series in which the loss is told.
    """
    start = F.lit(float(base_weight))
    hold = F.lit(0.0)
    for w, a, b in zip(weights, r1, r2, strict=True):
        start = start + F.lit(float(w)) * F.exp(a)
        hold = hold + F.lit(float(w)) * (F.exp(a) - F.exp(a + b))
    a, b = (r1[report - 1], r2[report - 1]) if report else (F.lit(0.0), F.lit(0.0))
    return start * F.exp(-a) - (start - hold) * F.exp(-a - b)


def tasks(books: Mapping[str, tuple[float, Sequence[float]]] = BOOKS, reports: Mapping[str, int] = REPORTS) -> list[tuple[str, str, float, Sequence[float], int]]:
    """(book, report, numeraire weight, weights, number of the reporting series) of every task."""
    return [(book, report, base, w, n) for book, (base, w) in books.items() for report, n in reports.items()]


def task_losses(r1: Sequence[Column], r2: Sequence[Column], books: Mapping[str, tuple[float, Sequence[float]]] = BOOKS, reports: Mapping[str, int] = REPORTS) -> Column:
    """array<struct<book, report, loss>> of every book in every reporting unit."""
    return F.array(*[F.struct(F.lit(book).alias("book"), F.lit(report).alias("report"), cash_loss(w, base, r1, r2, n).alias("loss")) for book, report, base, w, n in tasks(books, reports)])


def tail_place(ordered: Column, tau: Column) -> Column:
    """ceil(tau * n), at least 1; tau a decimal, so that the product is exact."""
    return F.greatest(F.ceil(tau * F.size(ordered)).cast("int"), F.lit(1))


def inverse_cdf(ordered: Column, tau: Column) -> Column:
    """Order statistic number ceil(tau * n) of an ascending array."""
    return F.element_at(ordered, tail_place(ordered, tau))


def expected_shortfall(ordered: Column, var: Column, tau: Column) -> Column:
    """var plus the mean excess over it, divided by 1 - tau: the fractional tail mean. Only the tail of the array is walked."""
    excess = F.aggregate(F.slice(ordered, tail_place(ordered, tau), F.size(ordered)), F.lit(0.0), lambda s, x: s + (x - var))
    return var + excess / F.size(ordered) / (1 - tau.cast("double"))


def array_mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def fz0(y: Column, var: Column, es: Column, tau: Column) -> Column:
    """Joint score of VaR and ES, lower is better; null outside its domain (es positive and not below var)."""
    score = F.greatest(y - var, F.lit(0.0)) / ((1 - tau.cast("double")) * es) + var / es + F.log(es) - 1
    return F.when((es > 0) & (es >= var - 1e-10), score)


def tail_residual(y: Column, var: Column, es: Column, tau: Column) -> Column:
    return es - var - F.greatest(y - var, F.lit(0.0)) / (1 - tau.cast("double"))


def erfc(z: Column) -> Column:
    """Complementary error function of z >= 0: below 2 by the series in exp(-z^2), above by its continued fraction, 60 terms each."""
    square, terms = z * z, F.sequence(F.lit(60), F.lit(1), F.lit(-1))
    series = F.aggregate(terms, F.lit(1.0), lambda s, k: 1 + 2 * square / (2 * k + 1) * s)
    fraction = F.aggregate(terms, z, lambda s, k: z + k / 2 / s)
    tail = F.exp(-square) / math.sqrt(math.pi)
    return F.when(z < 2, 1 - 2 * tail * z * series).otherwise(tail / fraction)


def chi2_tail(x: Column, k: int) -> Column:
    """Probability that a chi-square variable of k degrees of freedom exceeds x >= 0: a finite sum, after erfc where k is odd."""
    half, odd = x / 2, k % 2
    out = erfc(F.sqrt(half)) if odd else F.exp(-half)
    for m in range(1, (k - 1) // 2 + 1):
        power = m - 0.5 if odd else float(m)
        out = out + F.exp(-half) * F.pow(half, power) / math.gamma(power + 1)
    return out


#: A pivot of a matrix with ones on its diagonal counts from here on, and a variance from this part of the squared mean on.
PIVOT, CONSTANT = 1e-10, 1e-24


def quadratic_form(means: Sequence[Column], cov: Mapping[tuple[int, int], Column]) -> tuple[Column, Column]:
    """(rank, m' C^-1 m) of a mean vector m and a symmetric, positive semidefinite matrix C, given by its entries (i, j), i <= j; the form is null where the rank is deficient.

    C is scaled to ones on its diagonal and eliminated row by row with m beside it;
    each pivot adds the square of what is left of m over the pivot. A row whose pivot is
    not above PIVOT depends on those before it and is passed over, as is one whose
    variance is nothing but rounding of its mean.
    """
    k = len(means)
    size = [F.when(cov[i, i] > CONSTANT * m * m, F.sqrt(cov[i, i])) for i, m in enumerate(means)]
    entry = lambda i, j: F.coalesce(cov[min(i, j), max(i, j)] / (size[i] * size[j]), F.lit(0.0))
    rows = F.array(*[F.array(*[entry(i, j) for j in range(k)], F.coalesce(m / size[i], F.lit(0.0))) for i, m in enumerate(means)])

    def eliminated(m: Column, at: Column) -> Column:
        lead = m[at]
        return F.transform(m, lambda row, i: F.when((i > at) & (lead[at] > PIVOT), F.zip_with(row, lead, lambda x, y: x - row[at] / lead[at] * y)).otherwise(row))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), rows, eliminated)
    pivots = F.transform(done, lambda row, i: F.struct(row[i].alias("d"), row[k].alias("y")))
    rank = F.size(F.filter(pivots, lambda p: p["d"] > PIVOT))
    return rank, F.when(rank == k, F.aggregate(pivots, F.lit(0.0), lambda s, p: s + p["y"] * p["y"] / p["d"]))


def place_among(cuts: Column, value: Column, most: int) -> Column:
    """How many of the ascending array ``cuts``, of at most ``most`` entries, are not above the value, by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(most, 1).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size(cuts)) & (F.try_element_at(cuts, at + step) <= value), at + step).otherwise(at))
