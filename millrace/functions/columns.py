"""Column expressions. All are built-in JVM expressions."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Unicode has it (fixed values; Java and RE2 read the same pattern).
WHITE = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: Characters that are cut out of texts before words are counted (fixed values): ( [ , . ! ? : ; } )
MARKS = r"[(\[,.!?:;})]"


def in_year(df: DataFrame, date: str, year: int) -> Column:
    """Whether a date, timestamp or `YYYY-...` string column lies in a year, as a range that reaches the scan as a pushed filter."""
    if dict(df.dtypes)[date] == "string":
        return (F.col(date) >= f"{year:04d}") & (F.col(date) < f"{year + 1:04d}")
    return (F.col(date) >= F.lit(datetime.date(year, 1, 1))) & (F.col(date) < F.lit(datetime.date(year + 1, 1, 1)))


def words(text: str | Column) -> Column:
    """Lower-cased words without the marks; null and blank texts give an empty or null array."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, MARKS, "")), WHITE), lambda w: w != "")


def categories(column: str | Column) -> Column:
    """Parts between commas, trimmed; empty and repeated ones stay."""
    return F.transform(F.split(column, ","), lambda c: F.btrim(c, F.lit(" \t\n\r")))


def linear_hash(x: Column, p: int, i: int, universe: Column | int) -> Column:
    """(p * x + i) mod universe."""
    return F.pmod(x * F.lit(p) + F.lit(i), universe if isinstance(universe, Column) else F.lit(universe))


def primes(n: int) -> list[int]:
    """The first n primes."""
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found if p * p <= k):
            found.append(k)
        k += 1
    return found


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def euclidean(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def deviation(n: str | Column, sums: str | Column, squares: str | Column) -> Column:
    """Standard deviation of each dimension from N, SUM and SUMSQ; a variance that rounding made negative counts as 0."""
    n = F.col(n) if isinstance(n, str) else n
    return F.zip_with(sums, squares, lambda s, q: F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))))


def mahalanobis(x: str | Column, mean: str | Column, sd: str | Column, softening: float = 0.001) -> Column:
    """Distance scaled by the deviation of each dimension (plus a softening term)."""
    gap = F.zip_with(F.zip_with(x, mean, lambda a, b: a - b), sd, lambda d, s: d / (s + F.lit(softening)))
    return F.sqrt(total(F.transform(gap, lambda g: g * g)))


def subsets(items: str | Column, size: int) -> Column:
    """All subsets of so many elements of an array, in its order."""
    items = F.col(items) if isinstance(items, str) else items
    if size == 1:
        return F.transform(items, lambda x: F.array(x))
    rest = F.transform(items, lambda x, i: F.transform(subsets(F.slice(items, i + 2, F.size(items)), size - 1), lambda s: F.concat(F.array(x), s)))
    return F.flatten(rest)


def clamped(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """value within the limits; null stays null."""
    out = F.greatest(value, F.lit(low)) if low is not None else value
    out = F.least(out, F.lit(high)) if high is not None else out
    return F.when(value.isNotNull(), out)
