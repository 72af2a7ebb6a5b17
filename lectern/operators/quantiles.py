"""Exact quantiles of all groups at once, by histograms that are refined until they hold the wanted value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources.tables import checkpointed

#: Bins of a range in one pass, and the rows that a range may hold when its values are counted one by one.
BINS, SMALL = 256, 2048
#: Ranges that are told to every task, so that the rows stay where they lie; more of them meet their rows by a shuffle.
TOLD = 10_000


def _meet(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on columns of equal names in which nulls are equal; the right ones are dropped."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(r, on, how).drop(*[f"_r_{k}" for k in keys])


def _scale(x: Column, log: bool) -> Column:
    """x, or a logarithm of its size that keeps its sign: neither reverses the order of two values."""
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log(F.abs(x)) + 750.0)) if log else x  # the least logarithm is -744.4


def _spread(rows: DataFrame, targets: DataFrame, by: Sequence[str], out: Sequence[str], cell: Column, some: bool) -> DataFrame:
    """targets with the cell (x: its place, mn, mx, c, total) in which each one's rank lies, and the rows below it.

    Rows are counted by group, range, cell and the part they belong to, within tasks first; what a target leaves out is
    taken off the counts of all, so no row is copied for it. With `some` (at most TOLD targets) rows are not dealt out by
    their groups, of which a few would hold them all.
    """
    ranges = targets.select(*by, "lo", "hi").distinct()
    inside = _meet(rows, F.broadcast(ranges) if some else ranges, by).where("x between lo and hi").withColumn("_cell", cell)
    own = inside.groupBy(*by, "lo", "hi", *out, "_cell").agg(F.count("*").alias("c"), F.min("x").alias("mn"), F.max("x").alias("mx"))
    own = checkpointed(own)
    key = [*by, "lo", "hi"]
    every = own.groupBy(*key, "_cell").agg(F.sum("c").alias("total"), F.min("mn").alias("mn"), F.max("mx").alias("mx"))
    j = _meet(targets.drop("n", "total"), every, key)
    if out:
        less = own.select(*key, *[F.col(c).alias(f"_held_{c}") for c in out], "_cell", F.col("c").alias("_less"))
        t = j.withColumnsRenamed({c: f"_held_{c}" for c in out})
        j = _meet(t, less, [*key, *[f"_held_{c}" for c in out], "_cell"], "left").withColumnsRenamed({f"_held_{c}": c for c in out})
        j = j.withColumn("n", F.col("total") - F.coalesce("_less", F.lit(0))).drop("_less")
    else:
        j = j.withColumn("n", F.col("total"))
    w = Window.partitionBy(*by, *out, "k").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    j = j.withColumn("_under", F.col("off") + F.coalesce(F.sum("n").over(w), F.lit(0)))
    j = j.where((F.col("_under") <= F.col("k")) & (F.col("k") < F.col("_under") + F.col("n")))
    return j.select(*by, *out, "k", F.col("mn").alias("lo"), F.col("mx").alias("hi"), "n", "total", F.col("_under").alias("off"))


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], without: str | None = None) -> DataFrame:
    """(by, and a column for each name of probs): the interpolated quantiles of `value` in each group, exactly.

    With `without`, (by, without, ...): for each value of that column, such as a fold, the quantiles of the group's rows that
    have another one.

    A first pass counts each group and takes its range; every further pass counts rows in BINS bins of each range that
    still holds a wanted rank and goes on with that bin alone, from its least to its greatest value, bins of equal
    width and bins of equal ratio in turn. Where a range holds at most SMALL rows its values are counted one by one. Counts
    add up within tasks, so a group with a third of all rows, or with all of them, costs no more than another, and no task
    holds more than the bins of a range.

    Null, NaN and infinite values take no part; a group without others has nulls (with `without`, a part which is all
    of a group's finite rows likewise). Null keys are a group. No rows give no rows.
    """
    group = [c for c in by] or ["_all"]
    out = [without] if without else []
    x = F.col(value).cast("double")
    df = df.select(*by, *([F.lit(0).alias("_all")] if not by else []), *out, F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x).alias("x"))
    rows = df.where("x is not null")
    ends = df.groupBy(*group, *out).agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    ends = checkpointed(ends)
    whole = ends.groupBy(*group).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    if without:
        whole = _meet(ends.select(*group, *out, F.col("n").alias("_own")), whole, group)
        whole = whole.withColumn("total", F.col("n")).withColumn("n", F.col("n") - F.col("_own")).drop("_own")
    else:
        whole = whole.withColumn("total", F.col("n"))
    whole = whole.withColumn("h", F.create_map(*[y for k, p in probs.items() for y in (F.lit(k), F.lit(float(p)) * (F.col("n") - 1))]))
    ranks = F.array_distinct(F.flatten(F.transform(F.map_values("h"), lambda h: F.array(F.floor(h), F.ceil(h)))))
    targets = checkpointed(whole.where("n > 0").select(*group, *out, F.explode(ranks).alias("k"), "lo", "hi", "n", "total", F.lit(0).cast("long").alias("off")))

    log = False
    while True:
        open_ = targets.where((F.col("lo") < F.col("hi")) & (F.col("total") > SMALL))
        left = open_.count()
        if not left:
            break
        lo, hi = _scale(F.col("lo"), log), _scale(F.col("hi"), log)
        cell = F.coalesce(F.least(F.lit(BINS - 1), F.floor(F.try_divide(_scale(F.col("x"), log) / 2 - lo / 2, hi / 2 - lo / 2) * BINS)), F.lit(0)).cast("double")
        shut = targets.where((F.col("lo") == F.col("hi")) | (F.col("total") <= SMALL))
        targets = checkpointed(shut.unionByName(_spread(rows, open_, group, out, cell, left <= TOLD)))
        log = not log
    few = targets.where(F.col("lo") < F.col("hi"))
    found = targets.where(F.col("lo") == F.col("hi")).unionByName(_spread(rows, few, group, out, F.col("x"), few.count() <= TOLD))

    at = checkpointed(found.select(*group, *out, "k", F.col("lo").alias("v"))).groupBy(*group, *out).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("v"))
    j = _meet(whole.select(*group, *out, "h"), at, [*group, *out], "left")

    def read(name: str) -> Column:
        h = F.col("h")[name]
        one, two = F.col("v")[F.floor(h)], F.col("v")[F.ceil(h)]
        return (one + (two - one) * (h - F.floor(h))).alias(name)

    return j.select(*by, *out, *[read(k) for k in probs])
