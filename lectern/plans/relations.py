"""Queries over joins, groupings, selections and audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import scalar as S
from lectern.operators import relations as E
from lectern.operators import statistics as G
from lectern.plans.registry import query, table
from lectern.plans.text import items

# Perturbed copies of documents: digits taken out, and runs of line ends made one.
VARIANTS_SQL = """
variants as (
  select doc_id, source, 'base' as kind, text as content from documents
  union all select doc_id, source, 'digits', regexp_replace(text, '[0-9]', '', 'g') from documents
  union all select doc_id, source, 'lines', regexp_replace(text, '\\n+', chr(10), 'g') from documents),
scored as (select doc_id, source, kind, sha256(content) as sha, length(content) / 1000.0 as score from variants),
pairs as (select v.doc_id, v.source, v.kind, v.score - b.score as change, v.sha <> b.sha as changed from scored v join scored b on v.doc_id = b.doc_id and b.kind = 'base' where v.kind <> 'base')
"""


def variants(spark, sf_dir):
    d = items(spark, sf_dir)
    v = d.select("doc_id", "dataset", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("content")) for k, c in (("base", F.col("content")), ("digits", F.regexp_replace("content", "[0-9]", "")), ("lines", F.regexp_replace("content", "\n+", "\n")))])).alias("v"))
    return v.select("doc_id", F.col("dataset").alias("source"), "v.kind", S.fingerprint(F.col("v.content")).alias("content_sha256"), (F.length("v.content") / 1000.0).alias("score"))


@query(f"""
with {VARIANTS_SQL}
select source, kind, count(*) as n, round(avg(change), 6) as mean_change, round(quantile_cont(change, 0.5), 6) as median_change,
  round(count(*) filter (where change < -1e-12) / count(*), 6) as decrease_rate, round(count(*) filter (where change > 1e-12) / count(*), 6) as increase_rate,
  count(*) filter (where changed) as n_changed, round(count(*) filter (where change < -1e-12 and changed) / greatest(count(*) filter (where changed), 1), 6) as changed_decrease_rate
from pairs group by grouping sets ((), (source), (kind))
""")
def paired_summary(spark, sf_dir):
    pairs = E.paired(variants(spark, sf_dir), "doc_id", F.col("kind") == "base", "score")
    return E.paired_summary(pairs, "source", "kind")


@query(f"with {VARIANTS_SQL}, h as (select sha, min(doc_id) as doc_id, count(*) as n from scored group by sha) select count(*) as texts, count(*) filter (where n > 1) as shared, cast(sum(n) as bigint) as rows from h")
def distinct_texts(spark, sf_dir):
    h = variants(spark, sf_dir).groupBy("content_sha256").agg(F.min("doc_id"), F.count("*").alias("n"))
    return h.agg(F.count("*").alias("texts"), F.count_if(F.col("n") > 1).alias("shared"), F.sum("n").alias("rows"))


@query("""
with q as (select doc_id, n_chars, row_number() over (partition by source order by doc_id) - 1 as occ, source from documents),
l as (select o_orderkey, o_totalprice, row_number() over (partition by 'src' || (o_custkey % 20) order by o_orderkey) - 1 as occ, 'src' || (o_custkey % 20) as source from orders)
select q.source, q.doc_id, l.o_orderkey as other from q join l using (source, occ)
""")
def one_to_one_join(spark, sf_dir):
    q = table(spark, sf_dir, "documents").select("doc_id", "source")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("other"), F.concat(F.lit("src"), (F.col("o_custkey") % 20).cast("string")).alias("source"))
    return E.one_to_one(q, o, ["source"], ["doc_id"], ["other"])


@query("""
with w as (select source, doc_id, 1 + doc_id % 3 as w from documents)
select source, cast(sum(w) as bigint) as total, cast(sum(case when l.doc_id is not null then w else 0 end) as bigint) as available, round(sum(case when l.doc_id is not null then w else 0 end) / greatest(sum(w), 1), 6) as coverage
from w left join (select distinct doc_id from labels) l using (doc_id) group by source
""")
def label_coverage(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("source", "doc_id", (1 + F.col("doc_id") % 3).alias("w"))
    return E.coverage(w, table(spark, sf_dir, "labels"), ["source"], "doc_id", "w")


@query("select d.doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def missing_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("""
with c as (select doc_id as task_id, sha256(text) as sha from documents),
k as (select task_id, sha from c where task_id % 3 <> 0)
select c.task_id, c.sha, case when e.task_id is not null then 'exact' when h.sha is not null then 'by_hash' else 'compute' end as plan
from c left join k e on e.task_id = c.task_id and e.sha = c.sha left join (select distinct sha from k) h on h.sha = c.sha
""")
def reuse_plan(spark, sf_dir):
    """What a rerun would keep if the cache held two thirds of the documents."""
    c = items(spark, sf_dir).select(F.col("doc_id").alias("task_id"), S.fingerprint(F.col("content")).alias("sha"))
    return E.reuse_plan(c, c.where("task_id % 3 <> 0").withColumn("version", F.lit(6)), 6)


@query("""
select feature, round(avg(case when x is null then 1.0 else 0.0 end), 6) as missing, round(avg(case when x = 0 then 1.0 when x is not null then 0.0 end), 6) as zero from (
  select unnest(['quality', 'toxic']) as feature, unnest([quality, toxic]) as x from documents left join labels using (doc_id)) group by feature
""")
def column_coverage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return E.column_coverage(d, ["quality", "toxic"])


@query("""
with g as (select conv_id, count(*) as n, count(distinct turn) as d, max(turn) as top from conversations group by conv_id)
select conv_id, n, cast(top + 1 - d as int) as missing, n - d as repeated, top + 1 = d and n = d as complete from g
""")
def complete_conversations(spark, sf_dir):
    return E.complete_groups(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("""
with l as (select distinct doc_id from labels where quality = 1), r as (select distinct doc_id from labels where toxic = 1)
select doc_id, case when r.doc_id is null then 'left' else 'right' end as side from l full outer join r using (doc_id) where l.doc_id is null or r.doc_id is null
""")
def identity_difference(spark, sf_dir):
    l = table(spark, sf_dir, "labels")
    return E.set_difference(l.where("quality = 1"), l.where("toxic = 1"), ["doc_id"])


@query("select sha256(text) as sha, count(*) as count from documents group by 1 having count(*) > 1")
def duplicate_contents(spark, sf_dir):
    return E.duplicates(items(spark, sf_dir).select(S.fingerprint(F.col("content")).alias("sha")), ["sha"])


@query("select doc_id, lang, coalesce(lead(doc_id) over w, first_value(doc_id) over w) as borrowed from documents window w as (partition by lang order by doc_id)")
def borrowed_negatives(spark, sf_dir):
    return E.negatives(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query("""
select l_returnflag, l_shipmonth, cast(count(*) as bigint) as n, round(avg(l_discount) + 1e-9, 6) as mean, count(distinct l_linenumber) as runs, bool_and(l_quantity > 0) as valid
from (select l_returnflag, month(l_shipdate) as l_shipmonth, l_discount, l_linenumber, l_quantity from lineitem) group by 1, 2 having count(distinct l_linenumber) >= 3
""")
def complete_run_means(spark, sf_dir):
    """Means over runs, of groups that have at least three runs."""
    l = table(spark, sf_dir, "lineitem").withColumn("l_shipmonth", F.month("l_shipdate").cast("long"))
    g = l.groupBy("l_returnflag", "l_shipmonth").agg(F.count("*").alias("n"), F.round(F.avg("l_discount") + 1e-9, 6).alias("mean"), F.countDistinct("l_linenumber").alias("runs"), F.bool_and(F.col("l_quantity") > 0).alias("valid"))
    return g.where("runs >= 3")


@query("""
with r as (select *, row_number() over (partition by o_orderpriority order by o_totalprice, o_orderkey) as lo, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey desc) as hi, count(*) over (partition by o_orderpriority) as n from orders)
select o_orderpriority, o_orderkey, case when lo <= floor(0.25 * n) then 'low' else 'high' end as part from r where lo <= floor(0.25 * n) or hi <= floor(0.25 * n)
""")
def extreme_quartiles(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    o = G.positions(o, ["o_orderpriority"], "o_totalprice", ["o_orderkey"])
    quarter = F.floor(0.25 * F.col("_all"))
    low, high = F.col("_place") <= quarter, F.col("_place") > F.col("_all") - quarter
    return o.where(low | high).select("o_orderpriority", "o_orderkey", F.when(low, "low").otherwise("high").alias("part"))


@query("""
select source, doc_id, place from (select source, doc_id, row_number() over (partition by source order by sha256('17:' || doc_id), doc_id) as place from documents) where place <= 12
""")
def hash_ordered_sample(spark, sf_dir):
    """Twelve documents of each source, in the order of a seeded hash."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    return G.top(d, ["source"], [F.sha2(F.concat(F.lit("17:"), F.col("doc_id").cast("string")).cast("binary"), 256), "doc_id"], 12)


@query("select c_custkey, cast(row_number() over (order by c_acctbal desc nulls last, c_custkey) as bigint) as position from customer order by c_acctbal desc nulls last, c_custkey limit 50 offset 50")
def sorted_page(spark, sf_dir):
    c = table(spark, sf_dir, "customer").orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").offset(50).limit(50)
    return c.select("c_custkey", (50 + F.row_number().over(Window.orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey"))).cast("long").alias("position"))


@query("""
with g as (select l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_quantity > 25 as hot from lineitem),
r as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice, l_quantity) - row_number() over (partition by l_orderkey, hot order by l_linenumber, l_partkey, l_extendedprice, l_quantity) as island from g),
c as (select l_orderkey, island, count(*) as n from r where hot group by 1, 2)
select l_orderkey, max(n) as longest from c group by 1
""")
def longest_hot_run(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("hot", F.col("l_quantity") > 25)
    order = ("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    island = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)) - F.row_number().over(Window.partitionBy("l_orderkey", "hot").orderBy(*order))
    return l.withColumn("island", island).where("hot").groupBy("l_orderkey", "island").agg(F.count("*").alias("n")).groupBy("l_orderkey").agg(F.max("n").alias("longest"))


@query("""
with j as (select l_suppkey, abs(l_extendedprice - lag(l_extendedprice) over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice)) as jump from lineitem)
select l_suppkey, round(quantile_cont(jump, 0.9), 6) as q90, round(max(jump), 6) as most from j where jump is not null group by l_suppkey
""")
def jump_quantile(spark, sf_dir):
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    l = table(spark, sf_dir, "lineitem").withColumn("jump", F.abs(F.col("l_extendedprice") - F.lag("l_extendedprice").over(w)))
    return l.where("jump is not null").groupBy("l_suppkey").agg(F.round(F.percentile("jump", F.lit(0.9)), 6).alias("q90"), F.round(F.max("jump"), 6).alias("most"))


@query("""
with r as (select l_suppkey, l_extendedprice, row_number() over (partition by l_suppkey order by l_extendedprice desc) as place, count(*) over (partition by l_suppkey) as n from lineitem)
select l_suppkey, round(avg(l_extendedprice), 4) as tail from r where place <= greatest(1, ceil(n * 0.1)) group by l_suppkey
""")
def tail_mean(spark, sf_dir):
    w = Window.partitionBy("l_suppkey")
    l = table(spark, sf_dir, "lineitem").withColumn("n", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("l_extendedprice"))))
    return l.where(F.col("place") <= F.greatest(F.lit(1), F.ceil(F.col("n") * 0.1))).groupBy("l_suppkey").agg(F.round(F.avg("l_extendedprice"), 4).alias("tail"))


@query("""
select source, count(*) as docs, count(*) filter (where text is null) as null_texts, count(*) filter (where n_chars <> length(text)) as wrong_lengths, count(*) filter (where sha256(text) is null) as unhashed,
  count(*) - count(distinct doc_id) as repeated_ids from documents group by source
""")
def audit_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.count("*").alias("docs"), F.count_if(F.col("text").isNull()).alias("null_texts"), F.count_if(F.col("n_chars") != F.length("text")).alias("wrong_lengths"), F.count_if(F.sha2(F.col("text").cast("binary"), 256).isNull()).alias("unhashed"), (F.count("*") - F.countDistinct("doc_id")).alias("repeated_ids"))


@query("""
select role, count(*) as turns, count(distinct conv_id) as conversations, count(*) filter (where turn < 0) as negative, count(*) filter (where role not in ('system', 'user', 'assistant')) as unknown, count(*) filter (where trim(text) = '') as blank from conversations group by role
""")
def audit_conversations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.count_if(F.col("turn") < 0).alias("negative"), F.count_if(~F.col("role").isin("system", "user", "assistant")).alias("unknown"), F.count_if(F.trim("text") == "").alias("blank"))


@query("""
select event_type, count(*) as n, count(*) filter (where isnan(value) or isinf(value)) as infinite, count(*) filter (where value is null) as missing, count(*) filter (where value = 0) as zero, round(avg(case when isfinite(value) then value end), 6) as mean from events group by event_type
""")
def audit_finite(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.isnan(v) | (F.abs(v) == float("inf"))).alias("infinite"), F.count_if(v.isNull()).alias("missing"), F.count_if(v == 0).alias("zero"), F.round(F.avg(S.finite(v)), 6).alias("mean"))
