"""Ranks, weights, correlations, thresholds and confusion, by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges that the values of a group are split into, so that no window holds a whole group.
RANGES = 64


def _same(by: Sequence[str], left: DataFrame, right: DataFrame, more: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """A join on columns of equal names in which nulls are equal; the right ones are dropped."""
    keys = [*by, *more]
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(r, on, how).drop(*[f"_r_{k}" for k in keys])


def _ranged(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """df with _range: which of RANGES ranges of its group's values a row falls into; nulls come first."""
    cuts = F.percentile_approx(value, F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), F.lit(1000))
    j = _same(by, df, df.groupBy(*by).agg(cuts.alias("_cuts")))
    v = F.col(value)
    return j.withColumn("_range", F.when(v.isNull(), -1).otherwise(F.coalesce(F.size(F.filter("_cuts", lambda c: c < v)), F.lit(0)))).drop("_cuts")


def _before(counts: DataFrame, by: Sequence[str], n: str) -> DataFrame:
    """(by, _range, _lower, _all): rows of the ranges below each, and of the whole group."""
    t = counts.groupBy(*by, "_range").agg(F.sum(n).alias("_own"))
    w = Window.partitionBy(*by)
    t = t.withColumn("_lower", F.coalesce(F.sum("_own").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return t.withColumn("_all", F.sum("_own").over(w)).drop("_own")


def standing(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """df with _below, _equal and _all: the rows of its group with a smaller value, with the same, and altogether.

    Rows are counted by distinct value first; values are split into ranges, running counts over ranges and within each are
    added up. So neither a tie nor a group with most of the rows meets in one task.
    """
    d = _ranged(df.groupBy(*by, value).agg(F.count("*").alias("_equal")), by, value)
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("_equal").over(inside), F.lit(0)))
    d = _same(by, d, _before(d, by, "_equal"), ["_range"]).withColumn("_below", F.col("_lower") + F.col("_in"))
    return _same(by, df, d.select(*by, value, "_below", "_equal", "_all"), [value])


def average_rank(df: DataFrame, by: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """df with ranks from 1, equal values sharing the mean of theirs."""
    return standing(df, by, value).withColumn(name, F.col("_below") + (F.col("_equal") + 1) / 2).drop("_below", "_equal", "_all")


def positions(df: DataFrame, by: Sequence[str], value: str, tie: Sequence[str]) -> DataFrame:
    """df with _place, from 1, in the order of value and tie, and _all, the rows of the group: in ranges of values."""
    d = _ranged(df, by, value)
    d = d.withColumn("_in", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(value, *tie)))
    d = _same(by, d, _before(d.withColumn("_one", F.lit(1)), by, "_one"), ["_range"])
    return d.withColumn("_place", F.col("_lower") + F.col("_in")).drop("_range", "_in", "_lower")


def following(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """df with the next greater `value` of its group (values are distinct), the greatest taking the least."""
    d = _ranged(df, by, value)
    d = d.withColumn("_next", F.lead(value).over(Window.partitionBy(*by, "_range").orderBy(value)))
    edge = d.groupBy(*by, "_range").agg(F.min(value).alias("_least"))
    w = Window.partitionBy(*by).orderBy("_range")
    edge = edge.withColumn("_after", F.coalesce(F.lead("_least").over(w), F.first("_least").over(w))).drop("_least")
    return _same(by, d, edge, ["_range"]).withColumn(name, F.coalesce("_next", "_after")).drop("_range", "_next", "_after")


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """(by, n, spearman): the correlation of average ranks; null for fewer than two rows or a constant side."""
    r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count("*").alias("_c"))
    each = lambda v, name: _rank_of(r.groupBy(*by, v).agg(F.sum("_c").alias("_equal")), by, v, name)
    j = _same(by, _same(by, r, each(x, "_x"), [x]), each(y, "_y"), [y])
    s = lambda c: F.sum(F.col("_c") * c)
    g = j.groupBy(*by).agg(F.sum("_c").alias("n"), (s(F.col("_x")) / F.sum("_c")).alias("mx"), (s(F.col("_y")) / F.sum("_c")).alias("my"), *[s(F.col(a) * F.col(b)).alias(k) for a, b, k in (("_x", "_x", "xx"), ("_y", "_y", "yy"), ("_x", "_y", "xy"))])
    c = lambda k, a, b: F.col(k) / F.col("n") - F.col(a) * F.col(b)
    vx, vy = c("xx", "mx", "mx"), c("yy", "my", "my")
    return g.select(*by, "n", F.when((F.col("n") >= 2) & (vx > 1e-9) & (vy > 1e-9), c("xy", "mx", "my") / F.sqrt(vx * vy)).alias("spearman"))


def _rank_of(counts: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """(by, value, name): average ranks from (by, value, _equal)."""
    d = _ranged(counts, by, value)
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("_equal").over(inside), F.lit(0)))
    d = _same(by, d, _before(d, by, "_equal"), ["_range"])
    return d.select(*by, value, (F.col("_lower") + F.col("_in") + (F.col("_equal") + 1) / 2).alias(name))


def rank_target(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """df with `target`: the rank percentile in its group; binary labels pass through."""
    binary = df.groupBy(*by).agg(F.min(F.col(value).isin(0, 1)).alias("_binary"))
    r = _same(by, standing(df, by, value), binary)
    place = F.col("_below") + (F.col("_equal") - 1) / 2
    return r.withColumn("target", F.when(F.col("_binary"), F.col(value)).otherwise(place / F.greatest(F.col("_all") - 1, F.lit(1)))).drop("_below", "_equal", "_all", "_binary")


def balanced_weight(df: DataFrame, by: Sequence[str], name: str = "weight") -> DataFrame:
    """df with weights that give every group the same sum, and all rows together their number: two grouped counts."""
    n = df.groupBy(*by).agg(F.count("*").alias("_n"))
    whole = n.agg(F.sum("_n").alias("_rows"), F.count("*").alias("_groups"))
    return _same(by, df, n.crossJoin(whole)).withColumn(name, F.col("_rows") / (F.col("_groups") * F.col("_n"))).drop("_n", "_rows", "_groups")


def confusion(df: DataFrame, by: Sequence[str], positive: Column, label: Column, weight: Column | None = None) -> DataFrame:
    """(by, tp, fp, fn, tn): weighted, or counted."""
    w = F.lit(1.0) if weight is None else weight
    cell = lambda a, b: F.sum(F.when((positive == a) & (label == b), w).otherwise(0.0))
    return df.groupBy(*by).agg(cell(True, True).alias("tp"), cell(True, False).alias("fp"), cell(False, True).alias("fn"), cell(False, False).alias("tn"))


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Matthews correlation of a confusion; 0 where a margin is empty."""
    d = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.when(d > 0, (tp * tn - fp * fn) / d).otherwise(0.0)


def threshold_curve(df: DataFrame, by: Sequence[str], score: str, label: Column, weight: Column | None = None) -> DataFrame:
    """For each distinct score of a group, the confusion when it and all above are positive.

    Scores are grouped first, so that ties are one step and a window sees one row for each distinct score.
    """
    w = F.lit(1.0) if weight is None else weight
    s = df.groupBy(*by, score).agg(F.sum(F.when(label, w).otherwise(0.0)).alias("p"), F.sum(F.when(label, 0.0).otherwise(w)).alias("q"))
    down = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    s = s.withColumn("tp", F.sum("p").over(down)).withColumn("fp", F.sum("q").over(down))
    return s.withColumn("fn", F.sum("p").over(whole) - F.col("tp")).withColumn("tn", F.sum("q").over(whole) - F.col("fp")).drop("p", "q")


def best_mcc(df: DataFrame, by: Sequence[str], score: str, label: Column, weight: Column | None = None) -> DataFrame:
    """(by, threshold, mcc): the best Matthews correlation of `score >= threshold`, the lowest threshold of equals."""
    c = threshold_curve(df, by, score, label, weight).withColumn("mcc", F.round(mcc(*[F.col(x) for x in ("tp", "fp", "fn", "tn")]), 6))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("mcc"), score))
    return c.withColumn("_first", first).where("_first = 1").select(*by, F.col(score).alias("threshold"), "mcc")


def best_mcc_either(df: DataFrame, by: Sequence[str], score: str, label: Column) -> DataFrame:
    """(by, direction, threshold, mcc): the better of `score >= threshold` and `score <= threshold`, the first of equals."""
    up = best_mcc(df, by, score, label).withColumn("direction", F.lit(">="))
    down = best_mcc(df.withColumn(score, -F.col(score)), by, score, label).withColumn("threshold", -F.col("threshold")).withColumn("direction", F.lit("<="))
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("mcc"), F.desc("direction")))
    return up.unionByName(down).withColumn("_first", best).where("_first = 1").select(*by, "direction", "threshold", "mcc")


def balanced_mcc(df: DataFrame, dataset: str, score: str, label: Column) -> DataFrame:
    """(threshold, mcc): the best Matthews correlation where every dataset weighs the same; of equals that nearest to a
    half, then the lower."""
    w = balanced_weight(df, [dataset], "_w")
    c = threshold_curve(w, [], score, label, F.col("_w")).withColumn("mcc", F.round(mcc(*[F.col(x) for x in ("tp", "fp", "fn", "tn")]), 6))
    return c.orderBy(F.desc("mcc"), F.abs(F.col(score) - 0.5), score).limit(1).select(F.col(score).alias("threshold"), "mcc")


def fold(df: DataFrame, by: Sequence[str], key: Sequence[str], folds: int, name: str = "fold") -> DataFrame:
    """df with a fold for each row, even within its group: turns in the order of the keys' SHA-256, counted in the ranges
    of its first two digits. Stratify by putting the label into `by`."""
    d = df.withColumn("_sha", F.sha2(F.concat_ws(":", *[F.col(k).cast("string") for k in key]).cast("binary"), 256)).withColumn("_range", F.left("_sha", F.lit(2)))
    d = d.withColumn("_in", F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_sha", *key)))
    d = _same(by, d, _before(d.withColumn("_one", F.lit(1)), by, "_one"), ["_range"])
    return d.withColumn(name, ((F.col("_lower") + F.col("_in") - 1) % folds).cast("int")).drop("_sha", "_range", "_in", "_lower", "_all")


def top(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: Column | int, at: str = "place") -> DataFrame:
    """The first k rows of each group, with their place."""
    return df.withColumn(at, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(at) <= k)


def capped_views(rows: DataFrame, by: Sequence[str], kind: str, views: dict[str, Sequence], weight: str, tie: Sequence[str], k: int = 512) -> DataFrame:
    """(by, view, row's columns): for each group and view the k rows of greatest weight, ties in the order of `tie`.

    A view is some values of `kind`, all where it names none; a row counts in every view that has its kind. Each task keeps
    its own first k rows of a group before anything is shuffled (Spark's limit of groups by rank, which k up to 1000 gets),
    so a group with a third of all rows sends k rows from each task, and the final rank is over those alone.
    """
    own = [F.when(F.lit(True) if not kinds else F.col(kind).isin(*kinds), F.lit(name)) for name, kinds in views.items()]
    d = rows.withColumn("view", F.explode(F.array_compact(F.array(*own))))
    place = F.row_number().over(Window.partitionBy(*by, "view").orderBy(F.desc(weight), *tie))
    return d.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def macro_f1(df: DataFrame, by: Sequence[str], predicted: str, label: str) -> DataFrame:
    """(by, macro_f1): the unweighted mean over the classes that a group has, of either side."""
    pairs = df.groupBy(*by, predicted, label).count()
    one = pairs.select(*by, F.col(predicted).alias("k"), F.when(F.col(predicted) == F.col(label), F.col("count")).otherwise(0).alias("tp"), F.col("count").alias("n"), F.lit(0).alias("m"))
    two = pairs.select(*by, F.col(label).alias("k"), F.lit(0).alias("tp"), F.lit(0).alias("n"), F.col("count").alias("m"))
    f = one.unionByName(two).groupBy(*by, "k").agg((2 * F.sum("tp") / (F.sum("n") + F.sum("m"))).alias("f1"))
    return f.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))
