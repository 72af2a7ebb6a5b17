"""Queries over scores, prompts, catalogs and the remaining audits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lectern.functions import scalar as S
from lectern.operators import vectors as V
from lectern.operators import sweeps as W
from lectern.plans.losses import LOSS_SQL, losses, texts, trace_arrays
from lectern.operators import relations as E
from lectern.operators import statistics as G
from lectern.plans.registry import query, table
from lectern.plans.text import items
from lectern.plans.vectors import BASE_SQL, vectors


@query("""select doc_id, sha256(concat('Rate the readability of this text from 0 to 20.', chr(10), 'Language: ', coalesce(lang, 'unknown'), chr(10), '---', chr(10), text, chr(10), '---')) as prompt_sha from documents""")
def prompt_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    prompt = F.concat(F.lit("Rate the readability of this text from 0 to 20.\nLanguage: "), F.coalesce("lang", F.lit("unknown")), F.lit("\n---\n"), F.col("text"), F.lit("\n---"))
    return d.select("doc_id", S.fingerprint(prompt).alias("prompt_sha"))


@query("""
select event_id, round(1 / (1 + exp(-value / 100)), 6) as probability, case when not isfinite(value) or value is null then '' when value / 100 <= 0.4 then 'LOW' when value / 100 <= 0.6 then 'MEDIUM' else 'HIGH' end as level from events
""")
def score_levels(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(S.sigmoid(v / 100), 6).alias("probability"), S.level(v / 100).alias("level"))


@query("select page_id, url from pages where contains(lower(concat_ws(' ', page_id, url, html)), 'example.org')")
def catalog_search(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.where(F.contains(F.lower(F.concat_ws(" ", F.col("page_id").cast("string"), "url", "html")), F.lit("example.org"))).select("page_id", "url")


@query("select p_partkey, p_brand, round(percent_rank() over (partition by p_brand order by p_retailprice), 6) as percent_rank, round(cume_dist() over (partition by p_brand order by p_retailprice), 6) as cume_dist from part")
def percentile_position(spark, sf_dir):
    p = G.standing(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice"), ["p_brand"], "p_retailprice")
    below = F.when(F.col("_all") > 1, F.col("_below") / (F.col("_all") - 1)).otherwise(0.0)
    return p.select("p_partkey", "p_brand", F.round(below, 6).alias("percent_rank"), F.round((F.col("_below") + F.col("_equal")) / F.col("_all"), 6).alias("cume_dist"))


@query("""
with n as (select doc_id, 1 - quality as quality from labels where doc_id % 2 = 0)
select l.doc_id, coalesce(n.quality, l.quality) as quality, n.quality is not null as synced, l.toxic from labels l left join n using (doc_id)
""")
def label_sync(spark, sf_dir):
    l = table(spark, sf_dir, "labels")
    new = l.where("doc_id % 2 = 0").select("doc_id", (1 - F.col("quality")).alias("new"))
    return E.attach(l, new, ["doc_id"]).select("doc_id", F.coalesce("new", "quality").alias("quality"), F.col("new").isNotNull().alias("synced"), "toxic")


@query("""
with r as (select l_returnflag as model, l_linenumber as run, l_suppkey as task from lineitem), g as (select model, run, count(distinct task) as tasks, sha256(string_agg(distinct task || '', ',' order by task || '')) as ids from r group by 1, 2),
o as (select *, row_number() over (order by model, run) as p from g)
select model, run, tasks, ids = (select ids from o where p = 1) as aligned from o
""")
def archive_alignment(spark, sf_dir):
    """Whether each model's runs cover the same tasks: a count and a sum of hashes of each set, against the first run's."""
    r = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("run"), F.col("l_suppkey").alias("task"))
    g = E.set_print(r, ["model", "run"], ["task"])
    first = g.agg(F.min_by(F.struct("n", "print"), F.struct("model", "run")).alias("first"))
    return g.crossJoin(first).select("model", "run", F.col("n").alias("tasks"), (F.struct("n", "print") == F.col("first")).alias("aligned"))


@query(f"""
with {LOSS_SQL}, o as (select doc_id, sum(bits) as bits, sum(bytes) as bytes from loss where tok in ('a','b','c','d','e','i','j','k','m','n','x','y','z') group by doc_id)
select doc_id, round(bits / bytes + 1e-9, 6) as bpb from o
""")
def short_name_loss(spark, sf_dir):
    t = losses(spark, sf_dir).where(F.col("tok").isin(*"abcdeijkmnxyz"))
    return t.groupBy("doc_id").agg(F.round(F.sum("bits") / F.sum("bytes") + 1e-9, 6).alias("bpb"))


@query(f"""
with {LOSS_SQL}, w as (select doc_id, min(start) as s_start, max("end") as s_end, i // 4 as span from loss group by doc_id, i // 4),
j as (select l.*, w.span, row_number() over (partition by l.doc_id, w.span order by l.i) as k from loss l join w on w.doc_id = l.doc_id and l.start < w.s_end and l."end" > w.s_start)
select doc_id, round(sum(bits) filter (where k = 1) / sum(bytes) filter (where k = 1) + 1e-9, 6) as onset, round(sum(bits) filter (where k > 1) / sum(bytes) filter (where k > 1) + 1e-9, 6) as continuation from j group by doc_id
""")
def onset_loss(spark, sf_dir):
    """Loss of the first piece of a span against that of its later pieces; spans of four tokens stand in."""
    trace = trace_arrays(every=True)

    def build(batch):
        import pyarrow as pa

        b = trace(batch)
        n = np.nan_to_num(b.column("index").value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        first, spans = np.cumsum(n) - n, (n + 3) // 4
        k = 4 * (np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans))
        own, most = np.repeat(first, spans), np.repeat(n, spans)
        at = pa.array(np.concatenate([[0], np.cumsum(spans)]), pa.int32())
        place = lambda c, i: pa.ListArray.from_arrays(at, b.column(c).flatten().take(pa.array(own + i)))
        return b.append_column("span_start", place("starts", k)).append_column("span_end", place("ends", np.minimum(k + 4, most) - 1))

    return W.onset_losses(texts(spark, sf_dir), build=build).select("doc_id", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("onset", "continuation")])


@query("""
with v as (select vec_id as id, label, vec_id % 4 as kind, 1 + vec_id % 3 as w from embeddings), c as (select distinct label from v where kind = 0)
select round(sum(case when c.label is not null then w else 0 end) / sum(w), 6) as weight_share, count(distinct c.label) as clusters_with, count(distinct v.label) as clusters from v left join c using (label)
""")
def control_type_share(spark, sf_dir):
    """Share of the weight in clusters that hold a vector of the control type."""
    v = vectors(spark, sf_dir)
    c = v.where("kind = 0").select("label", F.col("label").alias("own")).distinct()
    return v.join(c, "label", "left").agg(F.round(F.sum(F.when(F.col("own").isNotNull(), F.col("w")).otherwise(0)) / F.sum("w"), 6).alias("weight_share"), F.countDistinct("own").alias("clusters_with"), F.countDistinct("label").alias("clusters"))


@query("""
with v as (select vec_id % 4 as kind, 1 + vec_id % 3 as w from embeddings), m as (select unnest(['all', 'all', 'all', 'all', 'names', 'core', 'core']) as view, unnest([0, 1, 2, 3, 1, 0, 2]) as kind)
select view, cast(sum(w) as bigint) as own, round(sum(w) / greatest((select sum(w) from v), 1), 6) as coverage from v join m using (kind) group by view
""")
def view_coverage(spark, sf_dir):
    v = vectors(spark, sf_dir).select("kind", "w")
    views = spark.createDataFrame([("all", k) for k in range(4)] + [("names", 1), ("core", 0), ("core", 2)], "view string, kind long")
    total = v.agg(F.sum("w").alias("total"))
    g = v.join(views, "kind").groupBy("view").agg(F.sum("w").alias("own"))
    return g.crossJoin(total).select("view", "own", F.round(F.col("own") / F.greatest("total", F.lit(1)), 6).alias("coverage"))


@query(f"""
with {BASE_SQL}, p as (select a.label, 1 - list_dot_product(a.u, b.u) as d from n a join n b on a.label = b.label and a.id < b.id) select label, round(quantile_cont(d, 0.5), 6) as median from p where d > 0 group by label
""")
def median_pair_distance(spark, sf_dir):
    return V.median_distance(vectors(spark, sf_dir), ["label"]).select("label", F.round("median", 6).alias("median"))


@query("""
with k as (select unnest(['src0', 'src1', 'src2']) as dataset, unnest(['java', 'python', 'java']) as language, unnest(['ridge', 'mcc', 'ridge']) as metric)
select d.doc_id, coalesce(k.language, 'java') as language, coalesce(k.metric, 'none') as metric, k.dataset is not null as supported from documents d left join k on k.dataset = d.source
""")
def registry_support(spark, sf_dir):
    k = spark.createDataFrame([("src0", "java", "ridge"), ("src1", "python", "mcc"), ("src2", "java", "ridge")], "dataset string, language string, metric string").withColumn("known", F.lit(True))
    d = items(spark, sf_dir).join(k, "dataset", "left")
    return d.select("doc_id", F.coalesce("language", F.lit("java")).alias("language"), F.coalesce("metric", F.lit("none")).alias("metric"), F.col("known").isNotNull().alias("supported"))
