"""Joins, groupings, selections and audits over keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.quantiles import quantiles
from lectern.operators.statistics import _same, following
from lectern.sources.tables import checkpointed


def occurrence(by: Sequence[str], order: Sequence[str]) -> Column:
    """A row's place, from 0, among those of its key."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], order_left: Sequence[str], order_right: Sequence[str]) -> DataFrame:
    """An inner join in which repeated keys meet in turn, so that no row meets two."""
    a = left.withColumn("_occ", occurrence(keys, order_left))
    b = right.withColumn("_occ", occurrence(keys, order_right))
    return a.join(b, [*keys, "_occ"]).drop("_occ")


def coverage(sources: DataFrame, store: DataFrame, by: Sequence[str], key: str, weight: str) -> DataFrame:
    """(by, total, available, coverage): the weight whose key the store has."""
    have = store.select(key).distinct().withColumn("_have", F.lit(True))
    g = sources.join(have, key, "left").groupBy(*by).agg(F.sum(weight).alias("total"), F.sum(F.when(F.col("_have"), F.col(weight)).otherwise(0)).alias("available"))
    return g.withColumn("coverage", F.round(F.col("available") / F.greatest("total", F.lit(1)), 6))


def reuse_plan(current: DataFrame, cached: DataFrame, version: int) -> DataFrame:
    """current (task_id, sha) with `plan`: kept by task and hash, kept by hash alone, or to be computed.

    cached is (task_id, sha, version); rows of another version don't count. Of several of one hash the first counts.
    """
    good = cached.where(F.col("version") == version)
    exact = good.select("task_id", "sha").distinct().withColumn("_exact", F.lit(True))
    by_hash = good.select("sha").distinct().withColumn("_hash", F.lit(True))
    out = current.join(exact, ["task_id", "sha"], "left").join(by_hash, "sha", "left")
    return out.withColumn("plan", F.when(F.col("_exact"), "exact").when(F.col("_hash"), "by_hash").otherwise("compute")).drop("_exact", "_hash")


def paired(variants: DataFrame, group: str, base: Column, score: str) -> DataFrame:
    """Variants with `change`: their score less that of their group's one baseline; groups without exactly one drop out."""
    b = variants.where(base).groupBy(group).agg(F.count("*").alias("_n"), F.first(score).alias("base_score"), F.first("content_sha256").alias("base_sha")).where("_n = 1").drop("_n")
    return variants.where(~base).join(b, group).withColumn("change", F.col(score) - F.col("base_score")).withColumn("content_changed", F.col("content_sha256") != F.col("base_sha"))


def paired_summary(pairs: DataFrame, label: str, category: str, eps: float = 1e-12) -> DataFrame:
    """Over all, by label and by category: number, mean and median change, and rates of decrease, over changed texts too."""
    rate = lambda c, of: F.round(F.count_if(c & of) / F.greatest(F.count_if(of), F.lit(1)), 6)
    down, up, all_ = F.col("change") < -eps, F.col("change") > eps, F.lit(True)
    nothing = lambda c: F.lit(None).cast(pairs.schema[c].dataType).alias(c)
    sets = [(nothing(label), nothing(category)), (F.col(label), nothing(category)), (nothing(label), F.col(category))]
    rows = pairs.select("change", "content_changed", F.explode(F.array(*[F.struct(F.lit(i).alias("_set"), a.alias(label), b.alias(category)) for i, (a, b) in enumerate(sets)])).alias("s")).select("s.*", "change", "content_changed")
    rows, key = checkpointed(rows), ["_set", label, category]
    counts = rows.groupBy(*key).agg(
        F.count("*").alias("n"),
        F.round(F.avg("change"), 6).alias("mean_change"),
        rate(down, all_).alias("decrease_rate"),
        rate(up, all_).alias("increase_rate"),
        F.count_if("content_changed").alias("n_changed"),
        rate(down, F.col("content_changed")).alias("changed_decrease_rate"),
    )
    medians = quantiles(rows, key, "change", {"median_change": 0.5}).withColumn("median_change", F.round("median_change", 6))
    return _same(key, counts, medians).select(label, category, "n", "mean_change", "median_change", "decrease_rate", "increase_rate", "n_changed", "changed_decrease_rate")


def column_coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, missing, zero): shares of nulls, and of zeros among the rest."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("s")).select("s.*")
    return long.groupBy("feature").agg(F.round(F.avg(F.col("x").isNull().cast("double")), 6).alias("missing"), F.round(F.avg(F.when(F.col("x").isNotNull(), (F.col("x") == 0).cast("double"))), 6).alias("zero"))


def complete_groups(df: DataFrame, group: str, position: str) -> DataFrame:
    """(group, n, missing, repeated, complete): whether a group has each position from 0 up once."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.sort_array(F.collect_set(position)).alias("own"))
    missing = F.size(F.array_except(F.sequence(F.lit(0).cast("long"), F.array_max("own").cast("long")), F.col("own").cast("array<bigint>")))
    return g.select(group, "n", missing.alias("missing"), (F.col("n") - F.size("own")).alias("repeated")).withColumn("complete", (F.col("missing") == 0) & (F.col("repeated") == 0))


def set_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only, with the side."""
    left = a.select(*keys).distinct().withColumn("_l", F.lit(True))
    right = b.select(*keys).distinct().withColumn("_r", F.lit(True))
    side = F.when(F.col("_r").isNull(), "left").otherwise("right")
    return left.join(right, list(keys), "full_outer").where("_l is null or _r is null").select(*keys, side.alias("side"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def negatives(df: DataFrame, by: str, order: str) -> DataFrame:
    """Each row with `borrowed`: the next row's key in its group, the last taking the first's."""
    return following(df, [by], order, "borrowed")


def attach(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """A left join that neither loses nor repeats a row of `left`: repeated keys on the right are an error, found before
    anything is returned."""
    twice = right.groupBy(*key).count().where("count > 1")
    if twice.take(1):
        raise ValueError(f"the key {list(key)} is not unique on the right")
    return left.join(right, list(key), "left")


def join_audit(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: rows and repeated keys on either side, keys without a partner, and rows of the inner join."""
    l = left.groupBy(*key).agg(F.count("*").alias("l"))
    r = right.groupBy(*key).agg(F.count("*").alias("r"))
    j = l.join(r, list(key), "full_outer").na.fill(0, ["l", "r"])
    return j.agg(
        F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows"), F.count_if(F.col("l") > 1).alias("left_repeated"), F.count_if(F.col("r") > 1).alias("right_repeated"),
        F.count_if(F.col("r") == 0).alias("left_only"), F.count_if(F.col("l") == 0).alias("right_only"), F.sum(F.col("l") * F.col("r")).alias("joined"),
    )


def failed_groups(rows: DataFrame, group: str, reasons: dict[str, Column]) -> DataFrame:
    """(group, reasons): groups in which any row meets a reason, with the sorted names of all that are met."""
    met = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in reasons.items()]))
    return rows.select(group, F.explode(met).alias("reason")).groupBy(group).agg(F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))


def set_print(df: DataFrame, by: Sequence[str], key: Sequence[str]) -> DataFrame:
    """(by, n, print): the number of distinct keys of each group and a sum of their hashes, equal where the sets are."""
    d = df.select(*by, *key).distinct()
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*key).cast("decimal(38,0)")).alias("print"))


def replace_scope(store: DataFrame, new: DataFrame, scope: str) -> DataFrame:
    """The store with the rows of every scope that `new` has replaced by its rows."""
    return store.join(new.select(scope).distinct(), scope, "left_anti").unionByName(new.select(store.columns))
