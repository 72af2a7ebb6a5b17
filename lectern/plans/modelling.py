"""Queries over ranks, thresholds and models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import scalar as S
from lectern.operators import models as J
from lectern.operators import statistics as G
from lectern.operators.features import line_stats, token_density
from lectern.operators.fitted import Ridge, cross_fitted
from lectern.operators.quantiles import quantiles
from lectern.plans.registry import query, table
from lectern.plans.text import items
from lectern.sources.tables import checkpointed

SCORES_SQL = "s as (select l_orderkey, l_linenumber, l_returnflag, l_linestatus, round(l_discount * 10 + l_tax, 6) as score, l_quantity > 25 as label, l_quantity, l_extendedprice from lineitem)"


def scores(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("score", F.round(F.col("l_discount") * 10 + F.col("l_tax"), 6)).withColumn("label", F.col("l_quantity") > 25)


@query("select o_orderkey, o_orderpriority, rank() over (partition by o_orderpriority order by o_totalprice) + (count(*) over (partition by o_orderpriority, o_totalprice) - 1) / 2.0 as rank from orders")
def average_rank(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return G.average_rank(o, ["o_orderpriority"], "o_totalprice").select("o_orderkey", "o_orderpriority", "rank")


@query("""
with r as (select c_custkey, c_mktsegment, rank() over (partition by c_mktsegment order by c_acctbal) + (count(*) over (partition by c_mktsegment, c_acctbal) - 1) / 2.0 as r, count(*) over (partition by c_mktsegment) as n,
  min(case when c_acctbal in (0, 1) then 1 else 0 end) over (partition by c_mktsegment) as b, c_acctbal from customer)
select c_custkey, c_mktsegment, round(case when b = 1 then c_acctbal else (r - 1) / greatest(n - 1, 1) end, 6) as target from r
""")
def rank_target(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return G.rank_target(c, ["c_mktsegment"], "c_acctbal").select("c_custkey", "c_mktsegment", F.round("target", 6).alias("target"))


@query("with i as (select c_custkey, 1.0 / count(*) over (partition by c_nationkey) as i from customer) select c_custkey, round(i * count(*) over () / sum(i) over (), 6) as weight from i")
def balanced_weights(spark, sf_dir):
    c = G.balanced_weight(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey"])
    return c.select("c_custkey", F.round("weight", 6).alias("weight"))


@query(f"""
with {SCORES_SQL}, r as (select l_returnflag, rank() over (partition by l_returnflag order by score) + (count(*) over (partition by l_returnflag, score) - 1) / 2.0 as a, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0 as b from s)
select l_returnflag, count(*) as n, round(corr(a, b), 6) as spearman from r group by l_returnflag
""")
def spearman_by_group(spark, sf_dir):
    return G.spearman(scores(spark, sf_dir), ["l_returnflag"], "score", "l_quantity").withColumn("spearman", F.round("spearman", 6))


@query(f"""
with {SCORES_SQL}, r as (select l_returnflag, rank() over (partition by l_returnflag order by score) + (count(*) over (partition by l_returnflag, score) - 1) / 2.0 as a, rank() over (partition by l_returnflag order by l_extendedprice) + (count(*) over (partition by l_returnflag, l_extendedprice) - 1) / 2.0 as b from s)
select count(*) as groups, round(avg(c), 6) as mean from (select l_returnflag, corr(a, b) as c from r group by l_returnflag)
""")
def unweighted_mean_spearman(spark, sf_dir):
    g = G.spearman(scores(spark, sf_dir), ["l_returnflag"], "score", "l_extendedprice")
    return g.agg(F.count("*").alias("groups"), F.round(F.avg("spearman"), 6).alias("mean"))


CURVE_SQL = f"""
{SCORES_SQL}, g as (select l_returnflag, score, sum(case when label then 1.0 else 0.0 end) as p, sum(case when label then 0.0 else 1.0 end) as q from s group by 1, 2),
c as (select *, sum(p) over w as tp, sum(q) over w as fp, sum(p) over (partition by l_returnflag) - sum(p) over w as fn, sum(q) over (partition by l_returnflag) - sum(q) over w as tn from g window w as (partition by l_returnflag order by score desc))
"""


@query(f"""
with {CURVE_SQL}, m as (select *, round(case when (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 then (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) else 0 end, 6) as mcc from c),
o as (select *, row_number() over (partition by l_returnflag order by mcc desc, score) as place from m)
select l_returnflag, score as threshold, mcc from o where place = 1
""")
def best_mcc(spark, sf_dir):
    return G.best_mcc(scores(spark, sf_dir), ["l_returnflag"], "score", F.col("label"))


@query(f"""
with {CURVE_SQL}, b as (select l_returnflag, score, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) as accuracy, lead(score) over (partition by l_returnflag order by score desc) as below from c),
t as (select *, max(accuracy) over (partition by l_returnflag) as best from b)
select l_returnflag, round(quantile_cont(case when below is null then score else (score + below) / 2 end, 0.5), 6) as threshold, max(best) as accuracy from t where accuracy = best group by l_returnflag
""")
def balanced_threshold(spark, sf_dir):
    """The median of the midpoints below the scores with the best balanced accuracy."""
    c = G.threshold_curve(scores(spark, sf_dir), ["l_returnflag"], "score", F.col("label"))
    own = Window.partitionBy("l_returnflag")
    accuracy = F.round((F.col("tp") / (F.col("tp") + F.col("fn")) + F.col("tn") / (F.col("tn") + F.col("fp"))) / 2, 6)
    c = c.withColumn("accuracy", accuracy).withColumn("below", F.lead("score").over(own.orderBy(F.desc("score")))).withColumn("best", F.max("accuracy").over(own))
    middle = F.when(F.col("below").isNull(), F.col("score")).otherwise((F.col("score") + F.col("below")) / 2)
    best = checkpointed(c.where("accuracy = best").select("l_returnflag", middle.alias("middle"), "best"))
    at = quantiles(best, ["l_returnflag"], "middle", {"threshold": 0.5})
    return best.groupBy("l_returnflag").agg(F.max("best").alias("accuracy")).join(at, "l_returnflag").select("l_returnflag", F.round("threshold", 6).alias("threshold"), "accuracy")


@query(f"""
with {SCORES_SQL}, w as (select *, 1.0 / count(*) over (partition by l_linestatus) as w from s)
select l_linestatus, round(sum(case when score >= 0.5 and label then w else 0 end), 6) as tp, round(sum(case when score >= 0.5 and not label then w else 0 end), 6) as fp,
  round(sum(case when score < 0.5 and label then w else 0 end), 6) as fn, round(sum(case when score < 0.5 and not label then w else 0 end), 6) as tn from w group by l_linestatus
""")
def weighted_confusion(spark, sf_dir):
    s = scores(spark, sf_dir)
    n = s.groupBy("l_linestatus").agg((1.0 / F.count("*")).alias("w"))
    s = s.join(n, "l_linestatus")
    c = G.confusion(s, ["l_linestatus"], F.col("score") >= 0.5, F.col("label"), F.col("w"))
    return c.select("l_linestatus", *[F.round(x, 6).alias(x) for x in ("tp", "fp", "fn", "tn")])


@query("""
with p as (select l_linestatus, l_returnflag as label, case when l_discount < 0.03 then 'A' when l_discount < 0.07 then 'N' else 'R' end as predicted from lineitem),
c as (select l_linestatus, k, 2.0 * count(*) filter (where label = k and predicted = k) / (count(*) filter (where label = k) + count(*) filter (where predicted = k)) as f1 from p, (select unnest(['A', 'N', 'R']) as k) group by 1, 2 having count(*) filter (where label = k or predicted = k) > 0)
select l_linestatus, round(avg(f1), 6) as macro_f1 from c group by l_linestatus
""")
def macro_f1(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select("l_linestatus", F.col("l_returnflag").alias("label"), F.when(F.col("l_discount") < 0.03, "A").when(F.col("l_discount") < 0.07, "N").otherwise("R").alias("predicted"))
    return G.macro_f1(p, ["l_linestatus"], "predicted", "label").withColumn("macro_f1", F.round("macro_f1", 6))


@query("select doc_id, source, (row_number() over (partition by source order by sha256('5:' || doc_id), '5', doc_id) - 1) % 10 as fold from documents")
def fold_assignment(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.lit("5").alias("seed"))
    return G.fold(d, ["source"], ["seed", "doc_id"], 10).select("doc_id", "source", F.col("fold").cast("long").alias("fold"))


@query("select doc_id, quality, (row_number() over (partition by quality order by sha256('9:' || doc_id), doc_id) - 1) % 10 as fold from labels")
def stratified_folds(spark, sf_dir):
    """Folds even within each label."""
    l = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit("9").alias("seed"))
    return G.fold(l, ["quality"], ["seed", "doc_id"], 10).select("doc_id", "quality", F.col("fold").cast("long").alias("fold"))


_DOWN = CURVE_SQL.replace("order by score desc", "order by score")


def _mcc_sql(curve: str, sign: str, order: str) -> str:
    return f"select l_returnflag, score, '{sign}' as direction, round(case when (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 then (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) else 0 end, 6) as mcc, score * {order} as tie from {curve}"


@query(f"""
with {CURVE_SQL}, lower_c as (select *, sum(p) over w as tp2, sum(q) over w as fp2 from g window w as (partition by l_returnflag order by score)),
lower_d as (select l_returnflag, score, tp2 as tp, fp2 as fp, sum(p) over (partition by l_returnflag) - tp2 as fn, sum(q) over (partition by l_returnflag) - fp2 as tn from lower_c),
m as ({_mcc_sql("c", ">=", "1")} union all {_mcc_sql("lower_d", "<=", "-1")}),
o as (select *, row_number() over (partition by l_returnflag order by mcc desc, direction desc, tie) as place from m)
select l_returnflag, direction, score as threshold, mcc from o where place = 1
""")
def best_mcc_direction(spark, sf_dir):
    """The best threshold of either direction."""
    return G.best_mcc_either(scores(spark, sf_dir), ["l_returnflag"], "score", F.col("label"))


@query(f"""
with {SCORES_SQL}, w as (select score, label, count(*) over () * 1.0 / (count(*) over (partition by l_returnflag) * (select count(distinct l_returnflag) from s)) as w from s),
g as (select score, sum(case when label then w else 0 end) as p, sum(case when label then 0 else w end) as q from w group by 1),
c as (select score, sum(p) over d as tp, sum(q) over d as fp, sum(p) over () - sum(p) over d as fn, sum(q) over () - sum(q) over d as tn from g window d as (order by score desc)),
m as (select score as threshold, round(case when (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 1e-9 then (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) else 0 end, 6) as mcc from c)
select * from m order by mcc desc, abs(threshold - 0.5), threshold limit 1
""")
def dataset_balanced_threshold(spark, sf_dir):
    """One threshold for all groups, each of the same weight; of equals that nearest to a half."""
    return G.balanced_mcc(scores(spark, sf_dir), "l_returnflag", "score", F.col("label"))


@query("""
with m as (select c_custkey, c_mktsegment, c_acctbal >= quantile_cont(c_acctbal, 0.5) over (partition by c_mktsegment) as target from customer)
select c_custkey, c_mktsegment, target from m
""")
def median_target(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    median = quantiles(c, ["c_mktsegment"], "c_acctbal", {"m": 0.5})
    return c.join(median, "c_mktsegment").select("c_custkey", "c_mktsegment", (F.col("c_acctbal") >= F.col("m")).alias("target"))


FEATURES = ("l_discount", "l_tax", "l_extendedprice")


@query(f"""
select {", ".join(f"round(quantile_cont({c}, 0.5), 6) as {c}_median, round(avg({c}), 4) as {c}_mean, round(stddev_pop({c}), 4) as {c}_scale" for c in FEATURES)} from lineitem
""")
def preprocessing(spark, sf_dir):
    stats = J.preprocess(table(spark, sf_dir, "lineitem"), FEATURES)
    pick = lambda f, c, n: F.round(F.max(F.when(F.col("feature") == f, F.col(c))), n).alias(f"{f}_{c}")
    return stats.agg(*[x for f in FEATURES for x in (pick(f, "median", 6), pick(f, "mean", 4), pick(f, "scale", 4))])


@query("select round(sum(l_discount * l_tax), 4) as xy, round(sum(l_discount * l_discount), 4) as xx, round(sum(l_discount * l_quantity), 2) as xq, count(*) as n from lineitem")
def ridge_gram(spark, sf_dir):
    g = J.gram(table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"], "l_quantity", F.lit(1.0))
    return g.select(F.round(F.get("wxx", 1), 4).alias("xy"), F.round(F.get("wxx", 0), 4).alias("xx"), F.round(F.get("wxy", 0), 2).alias("xq"), F.col("w").cast("long").alias("n"))


NAMES = ("mean_length", "std_length", "mean_indent", "commas_per_line", "periods_per_line", "max_names")


def feature_table(spark, sf_dir):
    """documents with labels and a handful of measures: what the models below are fitted on."""
    d = items(spark, sf_dir)
    f = line_stats(d).join(token_density(d), "doc_id").select("doc_id", *NAMES)
    l = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("y"))
    j = checkpointed(d.select("doc_id", F.col("dataset").alias("source")).join(l, "doc_id").join(f, "doc_id"))
    return checkpointed(G.balanced_weight(G.fold(j, ["source"], ["doc_id"], 5), ["source"], "w"))


def _scored(df, by):
    return G.spearman(checkpointed(df.select(*by, "prediction", "y")), by, "prediction", "y").withColumn("spearman", F.round("spearman", 4))


#: A table that SQL can fit too: two features of lineitem, a target and folds, one row for each line.
LINE_SQL = """
t as (select l_orderkey, l_linenumber, l_returnflag, l_orderkey % 3 as fold, l_discount as x1, l_tax as x2, l_quantity / 50.0 as y from lineitem),
h as (select distinct fold as held from t), r as (select t.*, h.held from t join h on t.fold <> h.held)
"""


def _fit_sql(rows: str, by: str, alpha: float = 200.0) -> str:
    """The ridge of two standardised features in closed form, for each group of `rows`."""
    return f"""
st as (select {by}, avg(x1) as m1, stddev_pop(x1) as s1, avg(x2) as m2, stddev_pop(x2) as s2, avg(y) as my from {rows} group by {by}),
gm as (select {by}, sum(((x1 - m1) / s1) * ((x1 - m1) / s1)) as a, sum(((x1 - m1) / s1) * ((x2 - m2) / s2)) as b, sum(((x2 - m2) / s2) * ((x2 - m2) / s2)) as c, sum(((x1 - m1) / s1) * (y - my)) as u, sum(((x2 - m2) / s2) * (y - my)) as v from {rows} join st using ({by}) group by {by}),
co as (select st.*, (u * (c + {alpha}) - v * b) / ((a + {alpha}) * (c + {alpha}) - b * b) as b1, (v * (a + {alpha}) - u * b) / ((a + {alpha}) * (c + {alpha}) - b * b) as b2 from gm join st using ({by}))
"""


def line_table(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_orderkey") % 3).alias("fold"), F.col("l_discount").alias("x1"), F.col("l_tax").alias("x2"), (F.col("l_quantity") / 50.0).alias("y"))


@query(f"with {LINE_SQL}, {_fit_sql('r', 'held')} select l_returnflag, fold, count(*) as n, round(sum(greatest(0, least(1, my + b1 * (x1 - m1) / s1 + b2 * (x2 - m2) / s2))), 4) as total from t join co on held = fold group by all")
def cv_predictions(spark, sf_dir):
    """Sums of the predictions that a ridge fitted without a row's fold gives it."""
    out = J.out_of_fold(line_table(spark, sf_dir), ["x1", "x2"], "y", F.lit(1.0), "fold")
    return out.groupBy("l_returnflag", "fold").agg(F.count("*").alias("n"), F.round(F.sum("prediction"), 4).alias("total"))


@query(f"""
with t as (select l_orderkey, l_returnflag as fold, l_discount as x1, l_tax as x2, l_quantity / 50.0 as y from lineitem), h as (select distinct fold as held from t), r as (select t.*, held from t join h on t.fold <> h.held),
{_fit_sql('r', 'held')}
select fold as l_returnflag, count(*) as n, round(sum(greatest(0, least(1, my + b1 * (x1 - m1) / s1 + b2 * (x2 - m2) / s2))), 4) as total from t join co on held = fold group by fold
""")
def leave_one_group_out(spark, sf_dir):
    out = J.out_of_fold(line_table(spark, sf_dir), ["x1", "x2"], "y", F.lit(1.0), "l_returnflag")
    return out.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("prediction"), 4).alias("total"))


@query(f"with {LINE_SQL}, {_fit_sql('t', 'l_returnflag')} select l_returnflag, round(b1, 7) as b1, round(b2, 7) as b2, round(my, 6) as intercept from co")
def ridge_coefficients(spark, sf_dir):
    """A ridge for each group, in full."""
    _, fits = J.full_fit(line_table(spark, sf_dir), ["x1", "x2"], "y", F.lit(1.0), by=["l_returnflag"])
    return spark.createDataFrame([(*k, round(float(b[0]), 7), round(float(b[1]), 7), round(b0, 6)) for k, b, b0 in fits], "l_returnflag string, b1 double, b2 double, intercept double")


@query(f"with {LINE_SQL}, one as (select 1 as g, * from t), {_fit_sql('one', 'g')} select l_returnflag, count(*) as n, round(sum(my + b1 * (x1 - m1) / s1 + b2 * (x2 - m2) / s2), 4) as total, round(min(my + b1 * (x1 - m1) / s1 + b2 * (x2 - m2) / s2), 6) as least from one join co using (g) group by l_returnflag")
def full_fit_unbounded(spark, sf_dir):
    """In-sample predictions of one ridge, not cut to 0 and 1."""
    p, _ = J.full_fit(line_table(spark, sf_dir), ["x1", "x2"], "y", F.lit(1.0), bounded=False)
    return p.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("prediction"), 4).alias("total"), F.round(F.min("prediction"), 6).alias("least"))


@query(f"""
with {LINE_SQL}, p as (select l_returnflag, unnest(['x1', 'x2']) as feature, unnest([1, -1]) as expected from t),
{_fit_sql('t', 'l_returnflag')},
b as (select l_returnflag, unnest(['x1', 'x2']) as feature, unnest([b1, b2]) as b from co), e as (select distinct feature, expected from p)
select feature, count(*) as fits, count(*) filter (where sign(b) = expected) as agree from b join e using (feature) group by feature
""")
def sign_agreement(spark, sf_dir):
    """How many groups' fits have a feature's coefficient with the sign that is expected of it."""
    _, fits = J.full_fit(line_table(spark, sf_dir), ["x1", "x2"], "y", F.lit(1.0), by=["l_returnflag"])
    b = spark.createDataFrame([(k[0], f, float(x)) for k, beta, _ in fits for f, x in zip(("x1", "x2"), beta, strict=True)], "l_returnflag string, feature string, b double")
    e = spark.createDataFrame([("x1", 1), ("x2", -1)], "feature string, expected int")
    return b.join(e, "feature").groupBy("feature").agg(F.count("*").alias("fits"), F.count_if(F.signum("b") == F.col("expected")).alias("agree"))


@query(f"""
with {LINE_SQL}, one as (select 1 as g, * from t ), {_fit_sql('one', 'g')},
z as (select l_orderkey, unnest(['x1', 'x2']) as feature, unnest([x1, x2]) as value, unnest([(x1 - m1) / s1, (x2 - m2) / s2]) as z, unnest([b1, b2]) as b from one join co using (g))
select feature, count(*) as n, round(sum(value), 4) as value, round(sum(abs(z)), 2) as z, round(sum(abs(z * b)), 4) as contribution, 0 as imputed, 0 as clipped from z group by feature
""")
def score_contributions(spark, sf_dir):
    """Scores of all lines taken apart, summed by feature."""
    t = checkpointed(line_table(spark, sf_dir))
    stats = J._stats(t, ["x1", "x2"])
    beta, _ = J.solve(J.gram(t.select("y", *J.standardised(t, ["x1", "x2"], stats)), ["x1", "x2"], "y", F.lit(1.0)).first(), 200.0)
    c = J.contributions(t, "l_orderkey", ["x1", "x2"], stats, beta)
    return c.groupBy("feature").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"), F.round(F.sum(F.abs("z")), 2).alias("z"), F.round(F.sum(F.abs("contribution")), 4).alias("contribution"), F.count_if("imputed").cast("int").alias("imputed"), F.count_if("clipped").cast("int").alias("clipped"))


@query("select event_type, count(*) as n, round(sum(1 / (1 + exp(-(0.3 + 0.02 * coalesce(case when isfinite(value) then value end, 0) - 0.5 * (user_id % 3))))), 4) as total from events group by event_type")
def frozen_logistic(spark, sf_dir):
    """Scores of a frozen logistic model whose names map to other columns."""
    names = {"metric_value": F.coalesce(S.finite(F.col("value")), F.lit(0.0)), "metric_user": F.col("user_id") % 3}
    weights = {"metric_value": 0.02, "metric_user": -0.5}
    z = F.lit(0.3)
    for k, w in weights.items():
        z = z + w * names[k]
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(S.sigmoid(z)), 4).alias("total"))


@query()
def leave_one_source_out(spark, sf_dir):
    return _scored(J.out_of_fold(feature_table(spark, sf_dir), NAMES, "y", F.col("w"), "source"), ["source"])


FAMILIES = {"none": [], "length": [0, 1], "indent": [2], "tokens": [3, 4, 5]}


@query()
def family_ablation(spark, sf_dir):
    """Cross-validated correlation with all features, and without each family of them: sub-models of the same sums."""
    use = {name: [i for i in range(len(NAMES)) if i not in gone] for name, gone in FAMILIES.items()}
    out = J.out_of_fold(feature_table(spark, sf_dir), NAMES, "y", F.col("w"), "fold", configurations=use)
    return _scored(out, ["configuration"]).withColumnRenamed("configuration", "without")


@query("""
with f as (select unnest(['mean_length', 'std_length', 'mean_indent', 'commas_per_line', 'periods_per_line', 'max_names']) as feature, unnest(['length', 'length', 'indent', 'tokens', 'tokens', 'tokens']) as family)
select family, count(*) as features, (select count(*) from documents) as rows from f group by family
""")
def family_counts(spark, sf_dir):
    """How many columns of the feature table belong to each family."""
    d = items(spark, sf_dir)
    f = line_stats(d).join(token_density(d), "doc_id").select("doc_id", *NAMES)
    family = {NAMES[i]: k for k, own in FAMILIES.items() for i in own}
    long = f.unpivot(["doc_id"], list(NAMES), "feature", "x").withColumn("family", F.create_map(*[F.lit(x) for kv in family.items() for x in kv])[F.col("feature")])
    return long.groupBy("family").agg(F.countDistinct("feature").alias("features"), F.countDistinct("doc_id").alias("rows"))


@query()
def feature_count_curve(spark, sf_dir):
    """Cross-validated correlation of the first K features, for each K, with the row of none: leading parts of one Gram
    matrix a fold."""
    use = {str(k): list(range(k)) for k in range(1, len(NAMES) + 1)}
    out = _scored(J.out_of_fold(feature_table(spark, sf_dir), NAMES, "y", F.col("w"), "fold", configurations=use), ["configuration"])
    origin = spark.createDataFrame([(0, None, None)], "k int, n long, spearman double")
    return out.select(F.col("configuration").cast("int").alias("k"), "n", "spearman").unionByName(origin)


@query()
def selected_evaluation(spark, sf_dir):
    """The features that the correlation filter keeps, evaluated out of fold, out of source, and in sample."""
    t = feature_table(spark, sf_dir).withColumn("all_rows", F.lit(1))
    kept = J.correlation_filter(t, NAMES)
    full, _ = J.full_fit(t, kept, "y", F.col("w"))
    parts = {"cross_validation": J.out_of_fold(t, kept, "y", F.col("w"), "fold"), "leave_one_out": J.out_of_fold(t, kept, "y", F.col("w"), "source"), "in_sample": full}
    rows = [_scored(p, ["all_rows"]).select(F.lit(k).alias("evaluation"), F.lit(len(kept)).alias("features"), "n", "spearman") for k, p in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query()
def instantiation_comparison(spark, sf_dir):
    """The same model refitted for each instantiation, here thirds of the documents: coefficients and in-sample correlation."""
    t = feature_table(spark, sf_dir).withColumn("instantiation", F.col("doc_id") % 3)
    p, fits = J.full_fit(t, NAMES, "y", F.col("w"), by=["instantiation"])
    c = spark.createDataFrame([(int(k[0]), [float(x) for x in beta]) for k, beta, _ in fits], "instantiation long, beta array<double>")
    return _scored(p, ["instantiation"]).join(c, "instantiation").select("instantiation", "n", "spearman", *[F.round(F.get("beta", F.lit(i)), 6).alias(f) for i, f in enumerate(NAMES)])


@query()
def bootstrap_interval(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("n"))
    return J.bootstrap(c, "c_mktsegment", "c_custkey", "c_acctbal", "n")


@query()
def correlation_selection(spark, sf_dir):
    kept = J.correlation_filter(feature_table(spark, sf_dir), NAMES)
    return spark.createDataFrame([(i + 1, f) for i, f in enumerate(kept)], "rank int, feature string")


@query()
def joint_selection(spark, sf_dir):
    """The filter over instantiations together: a pair counts as correlated if any of them shows it."""
    kept = J.joint_filter(feature_table(spark, sf_dir).withColumn("instantiation", F.col("doc_id") % 3), "instantiation", NAMES)
    return spark.createDataFrame([(i + 1, f) for i, f in enumerate(kept)], "rank int, feature string")


@query()
def stability_ranking(spark, sf_dir):
    return J.stability(feature_table(spark, sf_dir), NAMES, "y", "doc_id")


@query()
def candidate_extension(spark, sf_dir):
    """Whether further candidates change which three features come first: both rankings side by side."""
    t = feature_table(spark, sf_dir)
    one = J.stability(t, NAMES[:4], "y", "doc_id").where("rank <= 3").select("feature", F.col("rank").alias("before"))
    two = J.stability(t, NAMES, "y", "doc_id").where("rank <= 3").select("feature", F.col("rank").alias("after"))
    j = one.join(two, "feature", "full_outer")
    return j.select("feature", "before", "after", F.when(F.col("after").isNull(), "left").when(F.col("before").isNull(), "entered").otherwise("stayed").alias("change"))


@query()
def forward_features(spark, sf_dir):
    """Greedy forward selection by the cross-validated accuracy of a logistic model."""
    found = J.forward_selection(feature_table(spark, sf_dir), list(NAMES), "y", "doc_id", "fold", 5, len(NAMES))
    return spark.createDataFrame([(i + 1, f, float(a)) for i, (f, a) in enumerate(found)], "step int, feature string, accuracy double")


@query()
def logistic_model(spark, sf_dir):
    """A logistic fit that is hardly penalised, with the statistics that it freezes."""
    t = feature_table(spark, sf_dir)
    stats = J._stats(t, NAMES)
    beta = J.logistic(J.prepared(t, NAMES, "y", "doc_id"), NAMES, "_y", "_w", l2=1e-6)[0]
    return spark.createDataFrame([(f, float(b), *map(float, stats[f])) for f, b in zip(NAMES, beta, strict=False)] + [("intercept", float(beta[-1]), *[None] * 5)], "feature string, coefficient double, median double, low double, high double, mean double, scale double")


@query("""
select source, count(*) as rows, count(quality) as labelled from documents left join labels using (doc_id) group by source
""")
def model_rows(spark, sf_dir):
    """A model card's counts by dataset."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("rows"), F.count("quality").alias("labelled"))


@query()
def model_card(spark, sf_dir):
    """A fitted model's parameters, its features and rows, and a hash of the rows' identities."""
    t = feature_table(spark, sf_dir)
    _, fits = J.full_fit(t, NAMES, "y", F.col("w"))
    beta, b0 = fits[0][1], fits[0][2]
    rows = t.agg(F.count("*").alias("rows"), F.countDistinct("source").alias("datasets"), F.sum(F.xxhash64("source", "doc_id").cast("decimal(38,0)")).alias("identities"))
    card = spark.createDataFrame([("ridge", 200.0, float(b0), list(NAMES), [float(x) for x in beta])], "method string, alpha double, intercept double, features array<string>, coefficients array<double>")
    return card.crossJoin(rows)


@query("""
with r as (select l_partkey % 20 as f, l_linenumber as m, avg(l_discount) * 10 as freq, avg(l_tax) as coef from lineitem group by 1, 2),
k as (select *, row_number() over (partition by m order by freq desc, f) as rank from r),
g as (select 'f' || f as feature, count(*) filter (where freq >= 0.5) as active, round(avg(freq), 6) as mean_frequency, round(avg(abs(coef)), 6) as mean_coefficient, round(avg(1.0 / rank), 6) as mrr, min(rank) as best from k group by f)
select *, row_number() over (order by active desc, mean_frequency desc, mean_coefficient desc, mrr desc, best, feature) as rank from g
""")
def consensus_rank(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 20).alias("f"), F.col("l_linenumber").alias("model")).agg((F.avg("l_discount") * 10).alias("frequency"), F.avg("l_tax").alias("coefficient"))
    r = r.withColumn("rank", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("frequency"), "f")))
    return J.consensus(r.withColumn("feature", F.concat(F.lit("f"), F.col("f").cast("string"))))


@query("""
select l_returnflag, count(*) as count, count(*) filter (where l_discount >= 0.01) as valid, count(*) filter (where l_discount < 0.01) as errors, round(avg(l_discount), 6) as mean_score from lineitem group by l_returnflag
""")
def method_summary(spark, sf_dir):
    bad = F.col("l_discount") < 0.01
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("count"), F.count_if(~bad).alias("valid"), F.count_if(bad).alias("errors"), F.round(F.avg("l_discount"), 6).alias("mean_score"))


@query(f"with {LINE_SQL}, {_fit_sql('r', 'held')} select l_returnflag, fold, count(*) as n, round(sum(greatest(0, least(1, my + b1 * (x1 - m1) / s1 + b2 * (x2 - m2) / s2))), 4) as total from t join co on held = fold group by all")
def fitted_stages(spark, sf_dir):
    """The same sums of predictions from a stage that is fitted again for each fold."""
    out = cross_fitted(Ridge(features=["x1", "x2"], target="y"), line_table(spark, sf_dir), "fold")
    return out.groupBy("l_returnflag", "fold").agg(F.count("*").alias("n"), F.round(F.sum("prediction"), 4).alias("total"))


WIDE = 150


def wide_table(spark, sf_dir):
    """documents with labels and WIDE features: the shares of a text's words that a hash deals to each."""
    word = F.regexp_extract_all(F.lower("content"), F.lit("[a-z]+"), F.lit(0))
    d = items(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id")
    at = d.select("doc_id", "y", F.col("dataset").alias("source"), F.transform(word, lambda w: F.pmod(F.xxhash64(w), F.lit(WIDE)).cast("int")).alias("at"))

    def dealt(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            own, n = batch.column("at"), len(batch)
            size = own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            cell = np.repeat(np.arange(n), size) * WIDE + own.flatten().to_numpy(zero_copy_only=False)
            x = np.bincount(cell, minlength=n * WIDE).reshape(n, WIDE) / np.maximum(size, 1)[:, None]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "y", "source")], *[pa.array(x[:, k]) for k in range(WIDE)]], names=["doc_id", "y", "source", *[f"h{k}" for k in range(WIDE)]])

    fields = [f"doc_id {at.schema['doc_id'].dataType.simpleString()}", "y double", "source string", *[f"h{k} double" for k in range(WIDE)]]
    return checkpointed(G.fold(at.mapInArrow(dealt, ", ".join(fields)), ["source"], ["doc_id"], 5))


@query()
def wide_curve(spark, sf_dir):
    """Cross-validated correlation of the first K of 150 features, for each K: sub-models of one matrix of sums a fold."""
    names = [f"h{k}" for k in range(WIDE)]
    use = {str(k): range(k) for k in range(1, WIDE + 1)}
    out = J.out_of_fold(wide_table(spark, sf_dir), names, "y", F.lit(1.0), "fold", configurations=use)
    g = out.groupBy("configuration").agg(F.count("*").alias("n"), F.round(F.corr("prediction", "y"), 4).alias("correlation"))
    return g.select(F.col("configuration").cast("int").alias("k"), "n", "correlation")
