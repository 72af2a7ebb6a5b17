"""Sums and moments of arrays of numbers, where they stand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    """null where the array is empty."""
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def deviation(a: Column) -> Column:
    """The population's standard deviation, about the mean; null where the array is empty."""
    both = F.aggregate(a, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s")), _step)
    return F.when(F.size(a) > 0, F.sqrt(both["s"] / both["n"]))


def _step(a: Column, x: Column) -> Column:
    """Welford's recurrence: the count, the mean so far, and the sum of squares about it."""
    n = a["n"] + 1
    d = x - a["m"]
    return F.struct(n.alias("n"), (a["m"] + d / n).alias("m"), (a["s"] + d * (x - (a["m"] + d / n))).alias("s"))


def variation(a: Column) -> Column:
    """Deviation over mean; 0 where the mean is 0 or nothing is there."""
    return F.when(mean(a) > 0, deviation(a) / mean(a)).otherwise(0.0)


def largest(a: Column) -> Column:
    """0 where the array is empty."""
    return F.coalesce(F.array_max(a), F.lit(0))


def counts(a: Column, good) -> Column:
    """How many of each inner array's members are good, as doubles."""
    return F.transform(a, lambda x: F.size(F.filter(x, good)).cast("double"))


def running(numbers: Column) -> Column:
    """Running sums of an array: each round adds what stands twice as far back, so n numbers take log n rounds."""
    add = lambda a, d: F.when(F.size(a) > d, F.transform(a, lambda x, i: F.when(i >= d, x + F.get(a, i - d)).otherwise(x))).otherwise(a)
    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(30)]), numbers, add)


def once(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
