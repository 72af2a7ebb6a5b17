"""Queries over weighted vectors: embeddings with a type (vec_id % 4), a weight (1 + vec_id % 3) and a cluster label."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import scalar as S
from lectern.operators import vectors as I
from lectern.operators import relations as E
from lectern.plans.registry import query, table

BASE_SQL = """
e as (select vec_id as id, label, vec_id % 4 as kind, 1 + vec_id % 3 as w, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
n as (select id, label, kind, w, [x / greatest(sqrt(list_dot_product(v, v)), 1e-12) for x in v] as u from e),
d as (select label, unnest(range(1, len(u) + 1)) as dim, unnest(u) as x, w from n),
c as (select label, list(x order by dim) as centroid from (select label, dim, sum(w * x) / sum(w) as x from d group by 1, 2) group by label)
"""


def vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", (F.col("vec_id") % 4).alias("kind"), (1 + F.col("vec_id") % 3).alias("w"), F.col("embedding").cast("array<double>").alias("v"))


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"with {BASE_SQL} select id, round(sqrt(list_dot_product(v, v)), 6) as norm, round(sqrt(list_dot_product(u, u)), 6) as unit_norm from e join n using (id)")
def vector_norms(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", F.round(S.norm(F.col("v")), 6).alias("norm"), F.round(S.norm(S.unit(F.col("v"))), 6).alias("unit_norm"))


@query(f"""
with {BASE_SQL}
select n.label, count(*) as n, round(sum(w * (1 - list_dot_product(u, centroid) / greatest(sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(centroid, centroid)), 1e-12))) / sum(w), 6) as distance from n join c using (label) group by n.label
""")
def centroid_distance(spark, sf_dir):
    return rounded(I.centroid_distance(vectors(spark, sf_dir), ["label"]), "distance")


@query(f"""
with {BASE_SQL}, p as (select a.label, a.w * b.w as w, 1 - list_dot_product(a.u, b.u) as d from n a join n b on a.label = b.label and a.id < b.id)
select label, round(sum(w * d) / sum(w), 6) as mean, round(sqrt(greatest(0, sum(w * d * d) / sum(w) - (sum(w * d) / sum(w)) * (sum(w * d) / sum(w)))), 6) as std from p group by label
""")
def pairwise_cosine(spark, sf_dir):
    return rounded(I.pairwise(vectors(spark, sf_dir), ["label"]), "mean", "std")


@query(f"""
with {BASE_SQL}, b as (select a.label, a.id, a.w, max(list_dot_product(a.u, r.u)) as best from n a join n r on a.label = r.label and r.kind <> 0 where a.kind = 0 group by 1, 2, 3)
select label, round(sum(w * best) / sum(w), 6) as mean, round(min(best), 6) as min, round(sum(case when best < 0.3 then w else 0 end) / sum(w), 6) as below, round(sum(w * greatest(0, 0.3 - best)) / sum(w), 6) as deficit from b group by label
""")
def best_match(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(I.best_match(v.where("kind = 0"), v.where("kind <> 0"), ["label"], 0.3), "mean", "min", "below", "deficit")


@query("""
with c as (select vec_id % 4 as kind, case when label = 9 then -1 else label end as c, sum(1 + vec_id % 3) as s from embeddings group by 1, 2)
select kind, count(*) filter (where c >= 0) as clusters, round(max(s) filter (where c >= 0) / sum(s) filter (where c >= 0), 6) as largest, round(stddev_pop(s) filter (where c >= 0) / avg(s) filter (where c >= 0), 6) as size_cv, round(coalesce(sum(s) filter (where c < 0), 0) / sum(s), 6) as noise from c group by kind
""")
def cluster_summary(spark, sf_dir):
    """Clusters of each kind; vectors of the last label stand for noise."""
    v = vectors(spark, sf_dir).withColumn("label", F.when(F.col("label") == 9, -1).otherwise(F.col("label")))
    return rounded(I.cluster_summary(v, ["kind"], "label"), "largest", "size_cv", "noise")


@query(f"""
with {BASE_SQL}, b as (select a.label, a.id, a.w, max(list_dot_product(a.u, r.u)) as best from n a join n r on a.label = r.label and r.kind <> 0 where a.kind = 0 group by 1, 2, 3),
x as (select label, kind = 0 as side, i, sum(w * x) / sum(w) as x from (select label, kind, w, unnest(range(len(u))) as i, unnest(v) as x from n join e using (id)) group by all),
m as (select a.label, sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)) as c from x a join x b on a.label = b.label and a.i = b.i and a.side and not b.side group by a.label)
select label, round(sum(w * best) / sum(w), 6) as mean, round(max(best), 6) as most, round(any_value(c), 6) as centroids from b join m using (label) group by label
""".replace("select label, kind, w, unnest(range(len(u))) as i, unnest(v) as x from n join e using (id)", "select n.label, n.kind, n.w, unnest(range(len(n.u))) as i, unnest(n.u) as x from n"))
def typed_alignment(spark, sf_dir):
    """Vectors of one kind against all others of their label: best matches, and the cosine of both centroids."""
    v = vectors(spark, sf_dir)
    return rounded(I.alignment(v.where("kind = 0"), v.where("kind <> 0"), ["label"]), "mean", "most", "centroids")


@query(f"""
with {BASE_SQL}, dd as (select a.kind, a.label, greatest(0, max(case when a.id < b.id then 1 - list_dot_product(a.u, b.u) end)) as d from n a join n b on a.label = b.label and a.kind = b.kind and a.id <= b.id group by 1, 2),
s as (select kind, label, sum(w) as s from n group by 1, 2)
select kind, round(max(coalesce(d, 0)), 6) as greatest, round(sum(coalesce(d, 0) * s) / sum(s), 6) as mean from dd join s using (kind, label) group by kind
""")
def diameter_summary(spark, sf_dir):
    return rounded(I.diameter_summary(vectors(spark, sf_dir), ["kind"], "label"), "greatest", "mean")


@query("""
with c as (select vec_id % 2 as part, label, sum(1 + vec_id % 3) as s, sum(case when vec_id % 8 = 0 then 1 + vec_id % 3 else 0 end) as k from embeddings group by 1, 2)
select part, round(count(*) filter (where k > 0) / count(*), 6) as clusters, round(coalesce(sum(s) filter (where k > 0), 0) / sum(s), 6) as weight, round(avg(k / s) filter (where k > 0), 6) as kind_share from c group by part
""")
def control_cluster_share(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("part", F.col("id") % 2).withColumn("eighth", F.col("id") % 8)
    return rounded(I.control_share(v, ["part"], "label", "eighth", 0), "clusters", "weight", "kind_share")


@query("""
with s as (select l_linenumber as anchor, round(l_discount * 10 + l_tax, 6) as score, l_quantity > 25 as label from lineitem), h as (select distinct anchor as held from s),
g as (select held, score, sum(case when label then 1.0 else 0.0 end) as p, sum(case when label then 0.0 else 1.0 end) as q from s join h on anchor <> held group by 1, 2),
c as (select held, score, sum(p) over w as tp, sum(q) over w as fp, sum(p) over (partition by held) as pp, sum(q) over (partition by held) as qq, lead(score) over w as below from g window w as (partition by held order by score desc)),
b as (select *, round((tp / pp + (qq - fp) / qq) / 2, 9) as accuracy from c), m as (select *, max(accuracy) over (partition by held) as best from b),
t as (select held, quantile_cont(case when below is null then score else (score + below) / 2 end, 0.5) as threshold, max(best) as accuracy from m where accuracy = best group by held),
o as (select anchor, threshold, accuracy, avg(case when label then case when score >= threshold then 1.0 else 0.0 end end) as a, avg(case when not label then case when score < threshold then 1.0 else 0.0 end end) as b from s join t on anchor = held group by 1, 2, 3)
select anchor, round(threshold, 6) as threshold, round(accuracy, 6) as accuracy, round((coalesce(a, b) + coalesce(b, a)) / 2, 6) as held_out from o
""")
def leave_one_anchor_out(spark, sf_dir):
    """A threshold for each anchor from all others' scores, and how it does on the anchor's own."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("anchor"), F.round(F.col("l_discount") * 10 + F.col("l_tax"), 6).alias("score"), (F.col("l_quantity") > 25).alias("label"))
    return rounded(I.anchor_calibration(s, "label", "score", "anchor"), "threshold", "accuracy", "held_out")


@query("select case when label = 3 then 103 else label end as label, count(*) as n from embeddings where label <> 4 group by 1")
def scoped_replacement(spark, sf_dir):
    """A store after one scope is replaced and another deleted."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("label").alias("scope"))
    new = e.where("scope = 3").withColumn("label", F.col("label") + 100)
    left = E.replace_scope(e.where("scope <> 4"), new, "scope")
    return left.groupBy("label").agg(F.count("*").alias("n"))


@query("""
with k as (select label, vec_id % 4 as kind, sum(1 + vec_id % 3) as s from embeddings group by 1, 2), p as (select *, s / sum(s) over (partition by label) as p from k),
c as (select label, sum(s) as s, max(p) as purity, case when count(*) > 1 then sum(-p * ln(p)) / ln(count(*)) else 0 end as mix, count(*) as k from p group by label)
select 1 as part, round(sum(s * purity) / sum(s), 6) as purity, round(sum(s * mix) / sum(s), 6) as mixing, round(sum(case when k > 1 then s else 0 end) / sum(s), 6) as mixed from c
""")
def cluster_mixing(spark, sf_dir):
    return rounded(I.cluster_mixing(vectors(spark, sf_dir).withColumn("part", F.lit(1)), ["part"], "label", "kind"), "purity", "mixing", "mixed")


@query(f"with {BASE_SQL} select a.label, round(greatest(0, max(case when a.id < b.id then 1 - list_dot_product(a.u, b.u) end)), 6) as diameter from n a join n b on a.label = b.label and a.id <= b.id group by a.label")
def cluster_diameters(spark, sf_dir):
    return rounded(I.diameters(vectors(spark, sf_dir), ["label"]), "diameter")


@query()
def spectral_dispersion(spark, sf_dir):
    return rounded(I.spectrum(vectors(spark, sf_dir), ["label"]), "dispersion", "effective_rank")


@query(f"""
with {BASE_SQL}, a as (select centroid as c1 from c where label = 0), b as (select centroid as c2 from c where label = 1)
select id, round(list_dot_product(u, c1) / sqrt(list_dot_product(c1, c1)) - list_dot_product(u, c2) / sqrt(list_dot_product(c2, c2)), 6) as margin from n, a, b
""")
def two_centroid_margin(spark, sf_dir):
    v = vectors(spark, sf_dir)
    c = I.centroids(v, ["label"])
    return rounded(I.margins(v.select("id", "v"), c.where("label = 0"), c.where("label = 1")).select("id", "margin"), "margin")


@query("""
with r as (select vec_id as id, label, 1 as version from embeddings union all select vec_id, label + 100, 2 from embeddings where vec_id % 5 = 0),
p as (select *, row_number() over (partition by id order by version desc) as p from r) select id, label, version from p where p = 1
""")
def upsert_latest(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"))
    rows = e.withColumn("version", F.lit(1)).unionByName(e.where("id % 5 = 0").select("id", (F.col("label") + 100).alias("label"), F.lit(2).alias("version")))
    return I.latest(rows, ["id"], "version")


@query()
def kmeans_autok(spark, sf_dir):
    return I.auto_kmeans(vectors(spark, sf_dir))
