"""Queries over names, result records, sinks that are written and read back, and the audits around them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.functions import scalar as S
from lectern.operators import perturb as K
from lectern.operators import relations as E
from lectern.operators import statistics as G
from lectern.plans.registry import query, table
from lectern.plans.text import items
from lectern.sources import rated as R
from lectern.sources import readers as A
from lectern.sources import sinks as W
from lectern.sources.tables import shared_folder


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/lectern-{name}-{uuid.uuid4().hex}"


@query(r"""
select doc_id, 'llm__' || source || '__n_chars' as name, source as family, n_chars as value from documents
union all select doc_id, 'visual_' || source, 'visual', length(text) - n_chars from documents
""")
def namespaced_columns(spark, sf_dir):
    """Measures in a long table, their names put in a namespace and their families read back from it."""
    d = table(spark, sf_dir, "documents")
    own = d.select("doc_id", S.namespaced(F.lit("llm"), F.col("source"), F.lit("n_chars")).alias("name"), F.col("n_chars").alias("value"))
    more = d.select("doc_id", F.concat(F.lit("visual_"), "source").alias("name"), (F.length("text") - F.col("n_chars")).cast("long").alias("value"))
    return own.unionByName(more).withColumn("family", S.family(F.col("name")))


@query("""select doc_id, length(text) as n_chars, 0 as replaced from documents""")
def surrogate_audit(spark, sf_dir):
    """Texts with what can't stand in UTF-8 replaced: scans already have none of it."""
    clean = S.without_surrogates(F.col("content"))
    return items(spark, sf_dir).select("doc_id", F.length(clean).cast("long").alias("n_chars"), (F.length("content") - F.length(F.replace(clean, F.lit("\ufffd"), F.lit("")))).cast("int").alias("replaced"))


@query(r"""
with r as (select event_id, value, case event_id % 4 when 0 then null when 1 then '' else 'why' end as reasoning, case event_id % 3 when 0 then 'error' end as error from events)
select event_id, value is not null and isfinite(value) and error is null and coalesce(length(trim(reasoning)), 0) > 0 as reusable from r
""")
def reusable_records(spark, sf_dir):
    """Whether a nested result record may be kept: a finite score, a reason, and no error."""
    e = table(spark, sf_dir, "events")
    why = F.when(F.col("event_id") % 4 == 1, "").when(F.col("event_id") % 4 > 1, "why")
    record = F.struct(F.struct(F.col("value").alias("score"), why.alias("reasoning")).alias("result"), F.when(F.col("event_id") % 3 == 0, "error").alias("error"))
    return e.withColumn("record", record).select("event_id", S.reusable(F.col("record")).alias("reusable"))


@query("select event_id, case when isfinite(value) then round(value, 6) end as value from events")
def finite_scores(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(S.finite(F.col("value")), 6).alias("value"))


@query(r"""
with c as (select page_id, regexp_replace(regexp_replace(html, '"[^"\n]*"|''[^''\n]*''', '""', 'g'), '//[^\n]*', '', 'g') as bare, html from pages)
select page_id, regexp_matches(bare, '(^|[^A-Za-z0-9_])(class|interface|enum|record)\s+[A-Za-z_]') as complete, length(case when regexp_matches(bare, '(^|[^A-Za-z0-9_])(class|interface|enum|record)\s+[A-Za-z_]') then html else 'class Snippet {' || chr(10) || html || chr(10) || '}' end) as n_chars from c
""")
def complete_types(spark, sf_dir):
    """Whether a text declares a type outside strings and line comments; others are wrapped in one."""
    p = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("content"))
    return p.select("page_id", S.complete_type(F.col("content")).alias("complete"), F.length(S.wrapped(F.col("content"))).cast("long").alias("n_chars"))


@query(r"""
with l as (select p_partkey, 'size: ' || p_size || chr(10) || 'price: ' || p_retailprice || chr(10) || 'odd: NaN' || chr(10) || 'no value here' as text, p_size, p_retailprice from part)
select p_partkey, cast(p_size as double) as size, p_retailprice as price, cast('nan' as double) as odd, 3 as n from l
""")
def parsed_metrics(spark, sf_dir):
    """Lines of `name: value` as a map of numbers; NaN is a number, other lines are passed over."""
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit("size: "), F.col("p_size").cast("string"), F.lit("\nprice: "), F.col("p_retailprice").cast("string"), F.lit("\nodd: NaN\nno value here"))
    m = p.select("p_partkey", S.metrics(text).alias("m"))
    return m.select("p_partkey", F.col("m")["size"].alias("size"), F.col("m")["price"].alias("price"), F.col("m")["odd"].alias("odd"), F.size("m").alias("n"))


@query("select user_id, count(*) as n, round(sum(value), 4) as total from events where event_type <> 'click' group by user_id")
def without_excluded(spark, sf_dir):
    """A wide table after names that are excluded, or come from a model, are dropped; what is left is summed."""
    e = table(spark, sf_dir, "events").where("event_type <> 'click'")
    wide = e.select("user_id", F.col("value").alias("kept__value"), F.col("event_id").alias("legacy_id"), F.lit(0.5).alias("llm__output"))
    left = W.without(wide, prefixes=("legacy_", "llm__"), names=())
    return left.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("kept__value"), 4).alias("total"))


@query("""
with m as (select l_orderkey as id, l_returnflag as model, avg(l_discount) as x from lineitem group by 1, 2)
select o_orderkey as id, model, round(x, 6) as x, round(o_totalprice, 2) as shared from m join orders on o_orderkey = id
""")
def per_model_tables(spark, sf_dir):
    """What all models share joined once to the long table of what each model has."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("model")).agg(F.round(F.avg("l_discount"), 6).alias("x"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.round("o_totalprice", 2).alias("shared"))
    return m.join(o, "id")


@query("select c_custkey, n_name, count(*) over () as rows from customer left join nation on n_nationkey = c_nationkey")
def attached_statistics(spark, sf_dir):
    """A left join that keeps every row once."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    j = E.attach(c, table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])
    return j.crossJoin(c.agg(F.count("*").alias("rows"))).select("c_custkey", "n_name", "rows")


@query("""
with s as (select doc_id, sha256(cast(doc_id % 300 as varchar)) as h, doc_id % 4 as kind, 1 + doc_id % 3 as n from documents), v as (select sha256(cast(vec_id as varchar)) as h, vec_id from embeddings)
select s.doc_id, v.vec_id, s.kind, s.n from s join v using (h) where kind <> 2
""")
def vectors_by_hash(spark, sf_dir):
    """Sources with their vectors by the hash of their text; one type is left out."""
    s = table(spark, sf_dir, "documents").select("doc_id", S.fingerprint((F.col("doc_id") % 300).cast("string")).alias("h"), (F.col("doc_id") % 4).alias("kind"), (1 + F.col("doc_id") % 3).alias("n"))
    v = table(spark, sf_dir, "embeddings").select(S.fingerprint(F.col("vec_id").cast("string")).alias("h"), "vec_id")
    return s.where("kind <> 2").join(v, "h").select("doc_id", "vec_id", "kind", "n")


@query("""
with p as (select doc_id, quality * 0.5 as score from labels), a as (select count(*) filter (where l.doc_id is null) as missing, count(*) filter (where d.doc_id is null) as unknown from documents d full outer join labels l using (doc_id))
select p.doc_id, d.source, d.lang, p.score, a.missing, a.unknown from p join documents d using (doc_id), a
""")
def prediction_identity(spark, sf_dir):
    """Predictions with their items' metadata, and how many identities either side lacks."""
    p = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 0.5).alias("score"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    audit = E.set_difference(d, p, ["doc_id"]).agg(F.count_if(F.col("side") == "left").alias("missing"), F.count_if(F.col("side") == "right").alias("unknown"))
    return p.join(d, "doc_id").crossJoin(audit).select("doc_id", "source", "lang", "score", "missing", "unknown")


@query("""
select conv_id, array_to_string(list_sort(list_distinct(list(reason))), ',') as reasons from (
  select conv_id, 'blank' as reason from conversations where trim(text) = '' or length(text) < 20 union all select conv_id, 'late' from conversations where turn > 5) group by conv_id
""")
def failed_conversations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return E.failed_groups(c, "conv_id", {"blank": (F.trim("text") == "") | (F.length("text") < 20), "late": F.col("turn") > 5})


@query("""
select source, doc_id, place from (select source, doc_id, row_number() over (partition by source order by length(text) >= 500 desc, n_chars <= 5000 desc, sha256('3:' || doc_id), doc_id) as place from documents) where place <= 5
""")
def balanced_sample(spark, sf_dir):
    """Five documents of each source: long ones first, then those not too long, then in the order of a seeded hash."""
    d = table(spark, sf_dir, "documents")
    order = [F.desc(F.length("text") >= 500), F.desc(F.col("n_chars") <= 5000), F.sha2(F.concat(F.lit("3:"), F.col("doc_id").cast("string")).cast("binary"), 256), "doc_id"]
    return G.top(d.select("source", "doc_id", "text", "n_chars"), ["source"], order, 5).select("source", "doc_id", "place")


@query("select doc_id, source from documents order by sha256('30:' || doc_id), doc_id limit 30")
def fixed_sample(spark, sf_dir):
    """Thirty documents in the order of a seeded hash."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return d.orderBy(F.sha2(F.concat(F.lit("30:"), F.col("doc_id").cast("string")).cast("binary"), 256), "doc_id").limit(30)


@query("select 'documents' as part, cast(doc_id as varchar) as id, n_chars as size, source from documents union all select 'pages', cast(page_id as varchar), length(html), null from pages")
def concatenated(spark, sf_dir):
    """Tables with unlike columns as one."""
    d = table(spark, sf_dir, "documents").select(F.lit("documents").alias("part"), F.col("doc_id").cast("string").alias("id"), F.col("n_chars").alias("size"), "source")
    p = table(spark, sf_dir, "pages").select(F.lit("pages").alias("part"), F.col("page_id").cast("string").alias("id"), F.length("html").cast("long").alias("size"))
    return d.unionByName(p, allowMissingColumns=True)


@query("select count(*) as stored, count(l.doc_id) as kept, count(*) - count(l.doc_id) as retired from documents d left join (select distinct doc_id from labels) l using (doc_id)")
def retired_rows(spark, sf_dir):
    """How many stored rows a prune keeps and retires when only labelled documents are left in the corpus."""
    d, l = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id").distinct()
    kept = d.join(l, "doc_id", "left_semi").agg(F.count("*").alias("kept"))
    return d.agg(F.count("*").alias("stored")).crossJoin(kept).select("stored", "kept", (F.col("stored") - F.col("kept")).alias("retired"))


@query("""
with t as (select * from (values ('documents', 'doc_id', 'bigint'), ('documents', 'text', 'string'), ('documents', 'score', 'double'), ('labels', 'doc_id', 'string'), ('labels', 'quality', 'int')) t("table", "column", expected))
select "table", "column", expected, case when "column" = 'score' then 'missing' when "table" = 'labels' and "column" = 'doc_id' then 'bigint' else expected end as found, case when "column" = 'score' then 'missing' when "table" = 'labels' and "column" = 'doc_id' then 'type' else 'ok' end as state, case "table" when 'documents' then (select count(*) from documents) else (select count(*) from labels) end as rows from t
""")
def schema_audit(spark, sf_dir):
    """Tables against what is expected of their columns."""
    expected = {"documents": {"doc_id": "bigint", "text": "string", "score": "double"}, "labels": {"doc_id": "string", "quality": "int"}}
    parts = [W.schema_audit(table(spark, sf_dir, name), name, own) for name, own in expected.items()]
    return parts[0].unionByName(parts[1])


@query("""
with l as (select doc_id from documents where doc_id % 3 <> 0), r as (select doc_id from labels union all select doc_id from labels where doc_id % 10 = 0),
j as (select coalesce(a.doc_id, b.doc_id) as id, coalesce(a.n, 0) as l, coalesce(b.n, 0) as r from (select doc_id, count(*) as n from l group by 1) a full outer join (select doc_id, count(*) as n from r group by 1) b using (doc_id))
select cast(sum(l) as bigint) as left_rows, cast(sum(r) as bigint) as right_rows, count(*) filter (where l > 1) as left_repeated, count(*) filter (where r > 1) as right_repeated, count(*) filter (where r = 0) as left_only, count(*) filter (where l = 0) as right_only, cast(sum(l * r) as bigint) as joined from j
""")
def join_audit(spark, sf_dir):
    """Rows, repeated keys and partners of both sides of a join that should be one to one."""
    l = table(spark, sf_dir, "labels").select("doc_id")
    return E.join_audit(table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select("doc_id"), l.unionByName(l.where("doc_id % 10 = 0")), ["doc_id"])


@query("""
with m as (select doc_id, 'v' || doc_id || '/' || case doc_id % 9 when 0 then '../up' when 1 then '' else 'f.txt' end as path, case doc_id % 7 when 0 then -1 else doc_id % 5 end as position, case doc_id % 6 when 0 then 'odd' else 'names' end as module from documents),
p as (select doc_id, 'outside the root' as problem from m where contains(path, '..') union all select doc_id, 'no file' from m where ends_with(path, '/') union all select doc_id, 'negative position' from m where position < 0 union all select doc_id, 'unknown module' from m where module = 'odd')
select problem, count(*) as n, min(doc_id) as first from p group by problem
""")
def manifest_audit(spark, sf_dir):
    """Rows of a manifest that break a rule, by problem."""
    i = F.col("doc_id")
    m = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("v"), i.cast("string"), F.lit("/"), F.when(i % 9 == 0, "../up").when(i % 9 == 1, "").otherwise("f.txt")).alias("path"), F.when(i % 7 == 0, -1).otherwise(i % 5).alias("position"), F.when(i % 6 == 0, "odd").otherwise("names").alias("module"))
    return A.manifest_problems(m, ["names", "comments", "layout"]).groupBy("problem").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


# ---- sinks, written and read back


@query("select source as dataset, count(*) as n, round(cast(sum(n_chars) as double), 1) as chars, cast(sum(length(text)) as bigint) as length, 2 as definitions from documents group by source")
def feature_store(spark, sf_dir):
    """A feature table written by dataset with its definitions and metadata beside it, and loaded under its contract."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("dataset"), F.col("doc_id").cast("string").alias("task_id"), S.fingerprint(F.col("text")).alias("sha"), F.col("n_chars").cast("double").alias("chars"), F.length("text").cast("double").alias("length"))
    path = _place(spark, "features")
    W.write_features(d, path, ["task_id", "sha", "chars", "length"], {"chars": "stored length", "length": "code points"}, {"version": 6})
    f = W.load_features(spark, path, ["chars", "length"], d.select("dataset", "task_id", "sha"))
    n = W.definitions(spark, path).agg(F.count("*").cast("int").alias("definitions"))
    return f.groupBy("dataset").agg(F.count("*").alias("n"), F.round(F.sum("chars"), 1).alias("chars"), F.sum("length").cast("long").alias("length")).crossJoin(n)


@query("select label, count(*) as n, 64 as width from embeddings group by label")
def vector_store(spark, sf_dir):
    """Vectors written with their parameters as metadata, replaced for one scope, and read back."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    path = _place(spark, "vectors")
    W.write_vectors(E.replace_scope(e.where("label <> 3 or vec_id % 2 = 0"), e.where("label = 3"), "label"), path, {"model": "synthetic", "cap": "512"})
    v = spark.read.parquet(f"{path}/vectors")
    return v.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width"))


@query("select count(*) as rows, (select count(*) from documents where doc_id % 11 = 0) as failures, count(*) + (select count(*) from documents where doc_id % 11 = 0) = (select count(*) from documents) as complete from documents where doc_id % 11 <> 0")
def loss_store(spark, sf_dir):
    """Measures of losses written with the failures appended beside them, and whether both make up the corpus."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("bpb"))
    path = _place(spark, "losses")
    W.write_losses(d.where("doc_id % 11 <> 0"), d.where("doc_id % 11 = 0 and doc_id % 2 = 0").select("doc_id", F.lit("no trace").alias("reason")), path)
    W.write_losses(None, d.where("doc_id % 11 = 0 and doc_id % 2 = 1").select("doc_id", F.lit("late").alias("reason")), path)
    return W.loss_state(spark, path, d.select("doc_id"))


@query("select source as dataset, count(*) as n, round(avg(n_chars / 1000.0), 6) as mean_score, count(*) filter (where n_chars > 2000) as errors from documents group by source")
def result_store(spark, sf_dir):
    """Results as one JSON object for each item and a summary for each dataset, both read back."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("dataset"), "doc_id", (F.col("n_chars") / 1000.0).alias("score"), F.when(F.col("n_chars") > 2000, "long").alias("error"))
    path = _place(spark, "results")
    W.write_results(d, path)
    return spark.read.schema("dataset string, n long, mean_score double, errors long").json(f"{path}/summary").select("dataset", "n", F.round("mean_score", 6).alias("mean_score"), "errors")


@query("""
with r as (select 'm' || (l_suppkey % 3) as model, l_linenumber as run, l_returnflag as dataset, l_orderkey as task, l_discount as score from lineitem)
select model, run, count(*) as n, count(distinct task) as tasks, round(avg(score), 6) as mean from r group by 1, 2
""")
def archived_runs(spark, sf_dir):
    """Records of several models and runs written as compressed JSON and read under their schema."""
    l = table(spark, sf_dir, "lineitem")
    r = l.select(F.lit(1).alias("schema_version"), F.concat(F.lit("m"), (F.col("l_suppkey") % 3).cast("string")).alias("model"), F.col("l_linenumber").alias("run"), F.col("l_returnflag").alias("dataset"), F.col("l_orderkey").cast("string").alias("task_id"), F.lit("sha").alias("source_sha256"), F.lit(0.5).alias("human_readability_score"), F.col("l_discount").alias("llm_readability_score"), F.lit("so").alias("explanation"), F.struct(F.lit(7).alias("input")).alias("token_usage"))
    path = _place(spark, "archive")
    r.write.option("compression", "gzip").json(path)
    a = A.archived_runs(spark, path)
    return a.groupBy("model", "run").agg(F.count("*").alias("n"), F.countDistinct("task_id").alias("tasks"), F.round(F.avg("llm_readability_score"), 6).alias("mean"))


@query("select c_mktsegment as class, count(*) as n, round(sum(c_acctbal), 2) as total from customer group by 1")
def arff_columns(spark, sf_dir):
    """A file with a commented header: columns by prefix and the class, decoded."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.round("c_acctbal", 2).cast("string").alias("f_acct"), F.col("c_nationkey").cast("string").alias("other"), F.col("c_mktsegment").alias("class"))
    path = _place(spark, "arff")
    head = ["% a comment", "@relation r", *[f"@attribute {n} x" for n in c.columns], "@data"]
    spark.createDataFrame([(x,) for x in head], "value string").coalesce(1).write.text(path)
    c.select(F.concat_ws(",", *c.columns).alias("value")).write.mode("append").text(path)
    a = A.arff(spark, path, c.columns, "f_", "class")
    return a.groupBy("class").agg(F.count("*").alias("n"), F.round(F.sum("f_acct"), 2).alias("total"))


@query("select count(*) as n, count(case when doc_id % 3 <> 0 then l.quality end) as labelled, cast(sum(length(text)) as bigint) as chars from documents left join labels l using (doc_id)")
def catalog_export(spark, sf_dir):
    """Samples as JSON, labels left out of controlled sets, read back."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    path = _place(spark, "catalog")
    W.export_catalog(d.select("doc_id", "text", F.col("quality").alias("label"), (F.col("doc_id") % 3 == 0).alias("controlled")), path)
    r = spark.read.schema("doc_id long, text string, label int").json(path)
    return r.agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.sum(F.length("text")).alias("chars"))


@query("select source, count(*) as n, cast(sum(n_chars) as bigint) as chars, cast(max(length(text)) as bigint) as longest from documents group by source")
def snapshot_export(spark, sf_dir):
    """Samples as nested JSON of features, regions and scores by method, read back."""
    d = table(spark, sf_dir, "documents")
    path = _place(spark, "snapshot")
    W.export_snapshot(d, ["source", "doc_id"], {"chars": F.col("n_chars").cast("double"), "length": F.length("text").cast("double")}, F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"))), {"plain": F.lit(0.5)}, path)
    s = spark.read.schema("source string, doc_id long, features map<string, double>, regions array<struct<start: int, end: int>>, scores map<string, double>").json(path)
    return s.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("features")["chars"]).cast("long").alias("chars"), F.max(F.get("regions", F.lit(0))["end"]).cast("long").alias("longest"))


@query("""
with c as (select l_linenumber as k, l_returnflag as dataset, avg(l_discount) as v from lineitem group by 1, 2)
select k, round(max(v) filter (where dataset = 'A'), 6) as "A", round(max(v) filter (where dataset = 'N'), 6) as "N", round(max(v) filter (where dataset = 'R'), 6) as "R" from c group by k union all select 0, 0, 0, 0
""")
def curve_table(spark, sf_dir):
    """A curve written long, read with the row of K = 0 that it must have, a column for each dataset."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("k"), F.col("l_returnflag").alias("dataset")).agg(F.round(F.avg("l_discount"), 6).alias("value"))
    path = _place(spark, "curve")
    c.write.parquet(path)
    return W.curve(spark.read.parquet(path), ["A", "N", "R"])


# ---- names


@query(r"""
with n as (select distinct doc_id, name from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) as name from documents)),
s as (select *, left(name, 3) as short from n), p as (select *, row_number() over (partition by doc_id, short order by sha256(name), name) as k from s)
select doc_id, name, case when k = 1 then short else short || '_' || k end as renamed from p
""")
def rename_short(spark, sf_dir):
    """Names cut to three characters; those that would become one get a number."""
    return K.renamed_short(items(spark, sf_dir))


@query(r"""
with w as (select unnest(['rowbuffer', 'cat', 'stream', 'of', 'total', 'page', 'x', 'listener', 'queue', 'kernel', 'tableaux', 'go', 'heap']) as word), s as (select word, length(word) as n, row_number() over (partition by length(word) order by word) - 1 as k, count(*) over (partition by length(word)) as m from w),
t as (select distinct doc_id, name from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) as name from documents)),
e as (select length(name) as own, arg_min(n, abs(n - length(name)) * 1000 + n) as n from (select distinct length(name) as l, name from t) x, (select distinct n from s) group by length(name)),
i as (select t.doc_id, t.name, s.word from t join e on e.own = length(t.name) join s on s.n = e.n and s.k = cast(concat('0x', left(sha256(t.doc_id || ':' || t.name), 8)) as bigint) % s.m),
k as (select *, row_number() over (partition by doc_id, word order by sha256(name), name) as k from i)
select doc_id, name, case when k = 1 then word else word || '_' || k end as misleading from k
""")
def rename_misleading(spark, sf_dir):
    """Names exchanged for words about other things of about the same length, no two of a document for one."""
    words = ("rowbuffer", "cat", "stream", "of", "total", "page", "x", "listener", "queue", "kernel", "tableaux", "go", "heap")
    return K.renamed_misleading(items(spark, sf_dir), words)


@query(r"""
with f as (select page_id, 'src/' || case page_id % 4 when 0 then 'test/' when 1 then 'gen/' else 'main/' end || page_id || case page_id % 5 when 0 then '.md' else '.java' end as path, html from pages),
k as (select *, page_id % 7 as project, contains(html, '(') as method, length(html) between 1000 and 20000 as fits from f where ends_with(path, '.java') and not contains(path, '/test/') and not contains(path, '/gen/')),
r as (select project, page_id, path, row_number() over (partition by project order by method desc, fits desc, sha256('5:' || path), path) as place from k)
select project, page_id, path, place from r where place <= 3
""")
def class_corpus(spark, sf_dir):
    """Files of the wanted kind outside excluded folders, three of each project."""
    i = F.col("page_id")
    path = F.concat(F.lit("src/"), F.when(i % 4 == 0, "test/").when(i % 4 == 1, "gen/").otherwise("main/"), i.cast("string"), F.when(i % 5 == 0, ".md").otherwise(".java"))
    f = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), (i % 7).alias("project"), F.col("html").alias("content"))
    return K.class_corpus(f, (".java",), ("/test/", "/gen/"), 3).select("project", "page_id", "path", "place")


@query("select 'g' || (doc_id % 40) as group_id, count(*) as files, count(l.doc_id) as known from documents left join (select distinct doc_id from labels) l using (doc_id) group by 1")
def discovered_groups(spark, sf_dir):
    """Files found on disk joined to their manifest by name: groups, and how many of their files it knows."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = _place(spark, "files")
    d.withColumn("group_id", F.concat(F.lit("g"), (F.col("doc_id") % 40).cast("string"))).write.partitionBy("group_id").parquet(path)
    manifest = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("known", F.lit(1))
    return A.groups(spark, path, manifest, "doc_id")


@query("select doc_id, cast(quality as double) as score, sha256(text) as sha from documents join labels using (doc_id)")
def rated_corpus(spark, sf_dir):
    """Labelled texts written as JSON lines and read again through the data source of rated corpora."""
    d = items(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    path = _place(spark, "rated")
    d.select(F.col("doc_id").cast("string").alias("name"), F.col("content").alias("code_snippet"), F.col("quality").cast("double").alias("score")).write.json(path)
    R.register(spark)
    r = spark.read.format("rated").options(layout="json_lines", dataset="labelled").load(path)
    return r.select(F.col("task_id").cast("long").alias("doc_id"), F.col("readability_score").alias("score"), S.fingerprint(F.col("content")).alias("sha"))

