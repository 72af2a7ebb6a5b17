"""Queries over per-document measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import features as D
from lectern.operators.lexing import python_halstead
from lectern.operators import statistics as G
from lectern.operators import text as X
from lectern.plans.registry import query, table
from lectern.plans.text import COMMENTS_SQL, LINES_SQL, PAGE_DOCS, PAGES, code, code_sql, items, languages, vocabulary_sql
from lectern.sources.tables import checkpointed

_ALL = "select doc_id from src"


@query(f"""
with {LINES_SQL},
l as (select doc_id, line, length(text) as len, length(text) - length(ltrim(text, ' ')) as indent from lines where trim(text, ' ') <> ''),
s as (select *, abs(indent - lag(indent) over (partition by doc_id order by line)) as step from l),
g as (select doc_id, count(*) as loc, avg(len) as ml, stddev_pop(len) as sl, max(len) as xl, avg(case when len > 80 then 1.0 else 0.0 end) as o80, avg(case when len > 100 then 1.0 else 0.0 end) as o100,
  avg(indent) as mi, stddev_pop(indent) as si, max(indent) as xi, avg(step) as ms, stddev_pop(step) as ss, max(step) as xs from s group by doc_id)
select d.doc_id, coalesce(loc, 0) as loc, round(ln(1 + coalesce(loc, 0)), 6) as log_loc, round(coalesce(ml, 0), 6) as mean_length, round(coalesce(sl, 0), 6) as std_length, coalesce(xl, 0) as max_length,
  round(coalesce(o80, 0), 6) as over_80, round(coalesce(o100, 0), 6) as over_100, round(coalesce(mi, 0), 6) as mean_indent, round(coalesce(si, 0), 6) as std_indent, coalesce(xi, 0) as max_indent,
  round(case when mi > 0 then si / mi else 0 end, 6) as indent_cv, round(coalesce(ms, 0), 6) as mean_step, round(coalesce(ss, 0), 6) as std_step, coalesce(xs, 0) as max_step
from documents d left join g using (doc_id)
""")
def line_stats(spark, sf_dir):
    return D.line_stats(items(spark, sf_dir))


_WORD_PARTS = r"len([x for x in str_split(regexp_replace(lower(regexp_replace(regexp_replace(lexeme, '[^A-Za-z0-9]+', ' ', 'g'), '([A-Z][a-z]+|[a-z]+|[0-9]+)', ' \1 ', 'g')), ' +', ' ', 'g'), ' ') if x <> ''])"


@query(f"""
with {code_sql()},
b as (select doc_id, avg(n) as pl, stddev_pop(n) as ps from (select doc_id, line, count(*) as n from chunks group by doc_id, line) group by doc_id),
p as (select *, length(lexeme) as size, greatest(1, {_WORD_PARTS}) as parts, {_WORD_PARTS} as own, chunk_type = 'IDENTIFIER' as name from chunks),
c as (select doc_id, count(*) as n, count(distinct lexeme) as u, avg(size) as ms, stddev_pop(size) as ss, max(size) as xs, avg(parts) as mp, stddev_pop(parts) as sp,
  count(*) filter (where chunk_type in ('ARITHMETIC', 'COMPARISON', 'LOGICAL', 'BITWISE', 'ASSIGNMENT', 'CALL')) as e, count(*) filter (where chunk_type = 'LITERAL') as l,
  avg(size) filter (where name) as nm, stddev_pop(size) filter (where name) as ns, max(size) filter (where name) as nx, count(*) filter (where name) as nn, count(*) filter (where name and size = 1) as n1,
  sum(length(regexp_replace(lexeme, '[^0-9]+', '', 'g'))) filter (where name) as nd, sum(size) filter (where name) as nc, avg(own) filter (where name) as np from p group by doc_id)
select d.doc_id, coalesce(n, 0) as n_chunks, round(coalesce(pl, 0), 6) as per_line, round(coalesce(ps, 0), 6) as per_line_std, round(coalesce(u, 0) / greatest(coalesce(n, 0), 1), 6) as unique_ratio,
  round(ln(1 + coalesce(ms, 0)), 6) as log_mean_chars, round(case when ms > 0 then ss / ms else 0 end, 6) as chars_cv, round(ln(1 + coalesce(xs, 0)), 6) as log_max_chars, round(case when mp > 0 then sp / mp else 0 end, 6) as parts_cv,
  round(ln(1 + coalesce(e, 0)) - ln(1 + coalesce(l, 0)), 6) as expression_literal, round(coalesce(nm, 0), 6) as name_mean, round(coalesce(ns, 0), 6) as name_std, coalesce(nx, 0) as name_max,
  round(case when nm > 0 then ns / nm else 0 end, 6) as name_cv, round(coalesce(n1, 0) / greatest(coalesce(nn, 0), 1), 6) as single_letter, round(coalesce(nd, 0) / greatest(coalesce(nc, 0), 1), 6) as digit_share, round(coalesce(np, 0), 6) as name_parts
from documents d left join c using (doc_id) left join b using (doc_id)
""")
def chunk_stats(spark, sf_dir):
    return D.chunk_stats(items(spark, sf_dir))


_LEXICAL = [t for t in X.CHUNK_TYPES if t not in ("COMMENT", "IMPORT", "UNUSED_IMPORT")]
_N = [f"n_{t.lower()}" for t in X.CHUNK_TYPES]


@query(rf"""
with {code_sql(PAGE_DOCS)},
x as (select doc_id, {", ".join(f"count(*) filter (where chunk_type = '{t}') as n_{t.lower()}" for t in _LEXICAL)} from chunks group by doc_id),
{COMMENTS_SQL},
b as (select doc_id, unnest(str_split(regexp_replace(regexp_replace(comment, '^/\*+|\*+/$', '', 'g'), '^//+', ''), chr(10))) as text from comments),
m as (select doc_id, count(*) as n_comment from b where regexp_replace(regexp_replace(text, '^[ \t]*\*+', ''), '^[ \t]+|[ \t]+$', '', 'g') <> '' group by doc_id),
a as (select doc_id, {", ".join(f"coalesce({c}, 0) as {c}" for c in _N if "import" not in c)}, 0 as n_import, 0 as n_unused_import from src left join x using (doc_id) left join m using (doc_id))
select doc_id, {", ".join(_N)}, {", ".join(f"round({c} / greatest({' + '.join(_N)}, 1), 6) as share_{c[2:]}" for c in _N)} from a
""")
def chunk_inventory(spark, sf_dir):
    """Over pages, which import nothing."""
    return D.chunk_inventory(code(spark, sf_dir))


@query(f"""
with {code_sql()}, {vocabulary_sql()},
w as (select doc_id, count(*) as loc from lines where trim(text, ' ') <> '' group by doc_id),
l as (select doc_id, line, count(*) filter (where identifier) as names, count(*) filter (where number) as numbers from vocabulary group by doc_id, line),
x as (select doc_id, max(names) as names, max(numbers) as numbers from l group by doc_id),
v as (select doc_id, count(*) filter (where keyword) as k, count(*) filter (where operator) as o, count(*) filter (where comparison) as c, count(*) filter (where token = '.') as p, count(*) filter (where token = ',') as m,
  count(*) filter (where token in ('(', ')')) as b, sum(length(token)) filter (where keyword) as ka, sum(length(token)) filter (where operator) as oa, sum(length(token)) filter (where identifier) as ia from vocabulary group by doc_id),
d as (select src.doc_id, greatest(coalesce(loc, 0), 1) as loc, greatest(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')), 1) as ink from src left join w using (doc_id))
select d.doc_id, {", ".join(f"round(coalesce({c}, 0) / loc, 6) as {n}_per_line" for c, n in (("k", "keywords"), ("o", "operators"), ("c", "comparisons"), ("p", "periods"), ("m", "commas"), ("b", "parens")))},
  coalesce(names, 0) as max_names, coalesce(numbers, 0) as max_numbers, round(coalesce(ka, 0) / ink, 6) as keyword_area, round(coalesce(oa, 0) / ink, 6) as operator_area, round(coalesce(ka, 0) / greatest(coalesce(ia, 0), 1), 6) as keyword_name_area
from d left join v using (doc_id) left join x using (doc_id)
""")
def token_density(spark, sf_dir):
    return D.token_density(items(spark, sf_dir))


@query(f"""
with {code_sql(PAGE_DOCS)}, {vocabulary_sql()},
n as (select doc_id, greatest(max(line) - 1, 1) as last from lines group by doc_id),
{COMMENTS_SQL},
pieces as (select doc_id, unnest(range(len(a))) as k, unnest(a) as x from (select doc_id, regexp_extract_all(text, '(?s)' || $p${X.STRING}|{X.COMMENT}$p$ || '|\r\n|[\r\n]') as a from src)),
ends as (select doc_id, x, sum(length(regexp_replace(regexp_replace(x, '\r\n', chr(10), 'g'), '[^\r\n]', '', 'g'))) over (partition by doc_id order by k) - length(regexp_replace(regexp_replace(x, '\r\n', chr(10), 'g'), '[^\r\n]', '', 'g')) as l from pieces where regexp_matches(x, '^(?://|/[*]|[\r\n])')),
k as (select doc_id, line - 1 as i, 'identifier' as kind from vocabulary where identifier union all select doc_id, line - 1, 'keyword' from vocabulary where keyword union all select doc_id, line - 1, 'operator' from vocabulary where operator
  union all select doc_id, line - 1, 'period' from vocabulary where token = '.' union all select doc_id, line - 1, 'number' from vocabulary where number union all select doc_id, line - 1, 'chunk' from chunks union all select doc_id, l, 'comment' from ends where starts_with(x, '/'))
select doc_id, kind, round(avg(i / last), 6) as mean_y, round(stddev_pop(i / last), 6) as std_y, cast(max(i) - min(i) + 1 as bigint) as line_span from k join n using (doc_id) group by doc_id, kind
""")
def vertical_position(spark, sf_dir):
    return D.vertical_position(code(spark, sf_dir))


_OPERATORS = ", ".join(f"'{w}'" for w in (*X.LANGUAGES["java"][0], *X.LANGUAGES["java"][1]))
HALSTEAD_SQL = f"""
halstead as (select doc_id, count(*) as length, count(distinct token) filter (where token in ({_OPERATORS})) + count(distinct token) filter (where token not in ({_OPERATORS})) as vocabulary from tokens group by doc_id),
volumes as (select src.doc_id, coalesce(length, 0) as length, coalesce(vocabulary, 0) as vocabulary, case when vocabulary > 1 then length * log2(vocabulary) else 0.0 end as volume from src left join halstead using (doc_id))
"""
ENTROPY_SQL = """
bytes as (select doc_id, b, count(*) as n from (select doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) as b from documents) group by doc_id, b),
probs as (select doc_id, n, n / sum(n) over (partition by doc_id) as p from bytes),
found as (select doc_id, -sum(p * log2(p)) as entropy, cast(sum(n) as bigint) as n_bytes from probs group by doc_id),
entropies as (select documents.doc_id, coalesce(entropy, 0) as entropy, coalesce(n_bytes, 0) as n_bytes from documents left join found using (doc_id))
"""


@query(f"with {code_sql()}, {HALSTEAD_SQL} select doc_id, length, vocabulary, round(volume, 6) as volume from volumes")
def halstead(spark, sf_dir):
    return D.halstead(items(spark, sf_dir)).select("doc_id", "length", "vocabulary", F.round("volume", 6).alias("volume"))


@query(f"with {ENTROPY_SQL} select doc_id, round(entropy, 6) as entropy, n_bytes from entropies")
def byte_entropy(spark, sf_dir):
    return D.byte_entropy(items(spark, sf_dir)).withColumn("entropy", F.round("entropy", 6))


def posnett_scores(spark, sf_dir):
    """(doc_id, dataset, score): volume, lines and entropy of each text, where it is read."""
    d = D.halstead(items(spark, sf_dir)).withColumn("entropy", D.entropy("content"))
    return d.select("doc_id", "dataset", D.posnett(F.col("volume"), F.col("n_lines"), F.col("entropy")).alias("score"))


POSNETT_SQL = f"""
{code_sql()}, {HALSTEAD_SQL}, {ENTROPY_SQL}, counts as (select doc_id, count(*) as n from lines group by doc_id),
scores as (select d.doc_id, d.source as dataset, 1 / (1 + exp(-(8.87 - 0.033 * volume + 0.40 * coalesce(n, 0) - 1.5 * entropy))) as score
  from documents d join volumes using (doc_id) left join counts using (doc_id) join entropies using (doc_id))
"""


@query(f"with {POSNETT_SQL} select doc_id, dataset, round(score, 6) as score from scores")
def posnett(spark, sf_dir):
    return posnett_scores(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"""
with {POSNETT_SQL},
j as (select dataset, round(score, 6) as score, cast(quality as double) as quality from scores join labels using (doc_id)),
r as (select *, rank() over (partition by dataset order by score) + (count(*) over (partition by dataset, score) - 1) / 2.0 as rs, rank() over (partition by dataset order by quality) + (count(*) over (partition by dataset, quality) - 1) / 2.0 as rq from j),
g as (select dataset, count(*) as n, round(avg(score), 6) as mean_score, stddev_pop(rs) as sx, stddev_pop(rq) as sy, corr(rs, rq) as c from r group by dataset)
select dataset, n, mean_score, case when n >= 2 and sx > 0 and sy > 0 then round(c, 6) end as spearman from g
""")
def readability_by_source(spark, sf_dir):
    """The flagship: readability of each source, and how its ranks go with the quality labels."""
    s = checkpointed(posnett_scores(spark, sf_dir)).withColumn("score", F.round("score", 6))
    j = s.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("quality")), "doc_id")
    mean = j.groupBy("dataset").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))
    return mean.join(G.spearman(j, ["dataset"], "score", "quality").withColumn("spearman", F.round("spearman", 6)).select("dataset", "spearman"), "dataset")


@query(f"""
with {LINES_SQL},
s as (select doc_id, line, length(text) as v from lines),
c as (select *, count(*) over (partition by doc_id) as n, v - avg(v) over (partition by doc_id) as c, row_number() over (partition by doc_id order by line) - 1 as t from s),
g as (select doc_id, max(n) as n, sum(c * c) as ss, sum(c * case when t % 2 = 0 then 1 else -1 end) as mid, {", ".join(f"sum(c * cos(2 * pi() * {k} * t / n)) as a{k}, sum(c * sin(2 * pi() * {k} * t / n)) as b{k}" for k in (1, 2, 3, 4))} from c group by doc_id),
w as (select *, (n * ss + case when n % 2 = 0 then mid * mid else 0 end) / 2 as whole, {" + ".join(f"case when {2 * k} <= n then a{k} * a{k} + b{k} * b{k} else 0 end" for k in (1, 2, 3, 4))} as low from g)
select doc_id, round(case when whole > 1e-9 then low / whole else 0 end, 5) as low_energy from w
""")
def spectral_energy(spark, sf_dir):
    d = items(spark, sf_dir).withColumn("v", F.transform(X.line_array(F.col("content")), lambda l: F.length(l).cast("double"))).where(F.size("v") > 0)
    return d.select("doc_id", F.round(D.spectral_energy(F.col("v")), 5).alias("low_energy"))


def _spectrum_sql(name: str, count: str) -> str:
    ab = ", ".join(f"sum(c * cos(2 * pi() * {k} * t / n)) as a{k}, sum(c * sin(2 * pi() * {k} * t / n)) as b{k}" for k in (1, 2, 3, 4))
    low = " + ".join(f"case when {2 * k} <= n then a{k} * a{k} + b{k} * b{k} else 0 end" for k in (1, 2, 3, 4))
    return f"""
{name}_v as (select doc_id, line, {count} as v from lines left join per_line using (doc_id, line)),
{name}_c as (select doc_id, count(*) over (partition by doc_id) as n, v - avg(v) over (partition by doc_id) as c, line - 1 as t from {name}_v),
{name}_g as (select doc_id, max(n) as n, sum(c * c) as ss, sum(c * case when t % 2 = 0 then 1 else -1 end) as mid, {ab} from {name}_c group by doc_id),
{name} as (select doc_id, round(case when whole > 1e-9 then low / whole else 0 end, 5) as low_{name} from (select *, (n * ss + case when n % 2 = 0 then mid * mid else 0 end) / 2 as whole, {low} as low from {name}_g))"""


_SERIES = {"length": "length(text)", "identifiers": "coalesce(i, 0)", "keywords": "coalesce(k, 0)", "periods": "coalesce(p, 0)", "commas": "coalesce(m, 0)", "comparisons": "coalesce(c, 0)"}


@query(f"""
with {code_sql()}, {vocabulary_sql()},
per_line as (select doc_id, line, count(*) filter (where identifier) as i, count(*) filter (where keyword) as k, count(*) filter (where token = '.') as p, count(*) filter (where token = ',') as m, count(*) filter (where comparison) as c from vocabulary group by doc_id, line),
{", ".join(_spectrum_sql(k, v) for k, v in _SERIES.items())}
select * from length {" ".join(f"join {k} using (doc_id)" for k in list(_SERIES)[1:])}
""")
def spectra(spark, sf_dir):
    """Low-frequency shares of six series by line."""
    d = D.spectra(items(spark, sf_dir).where(F.length("content") > 0))
    return d.select("doc_id", *[F.round(c, 5).alias(c) for c in d.columns[1:]])


@query(f"""
with {LINES_SQL},
h as (select doc_id, line, unnest(range(length(text))) as col, unnest(str_split(text, '')) as ch from lines where text <> ''),
s as (select *, coalesce(lag(ch) over w = ch and lag(line) over w = line - 1 and ch <> ' ', false) as same from h window w as (partition by doc_id, col order by line)),
z as (select *, same and not coalesce(lag(same) over (partition by doc_id, col order by line), false) as second from s)
select doc_id, count(*) filter (where second) as runs from z group by doc_id
""")
def aligned_runs(spark, sf_dir):
    return D.aligned_runs(items(spark, sf_dir))


@query(f"""
with {code_sql()},
c as (select doc_id, line, lower(token) as word, count(*) as n from tokens where regexp_matches(token, '^[A-Za-z_$]') group by all),
w as (select *, n / sum(n) over (partition by doc_id, word) as w from c),
m as (select doc_id, line, sqrt(sum(w * w)) as norm from w group by doc_id, line),
d as (select a.doc_id, a.line as x, b.line as y, sum(a.w * b.w) as dot from w a join w b on a.doc_id = b.doc_id and a.word = b.word and a.line < b.line group by all)
select d.doc_id, round(max(dot / (p.norm * q.norm)), 6) as coherence from d join m p on p.doc_id = d.doc_id and p.line = d.x join m q on q.doc_id = d.doc_id and q.line = d.y group by d.doc_id
""")
def line_coherence(spark, sf_dir):
    return D.line_coherence(items(spark, sf_dir)).withColumn("coherence", F.round("coherence", 6))


@query(f"""
with {code_sql()}, n_short as (select doc_id, count(*) as n, count(*) filter (where lexeme in ('a', 'b', 'c', 'd', 'e', 'i', 'j', 'k', 'm', 'n', 'x', 'y', 'z')) as s from chunks where chunk_type = 'IDENTIFIER' group by doc_id)
select src.doc_id, round(coalesce(s, 0) / greatest(coalesce(n, 0), 1), 6) as share from src left join n_short using (doc_id)
""")
def short_name_share(spark, sf_dir):
    return D.short_name_share(items(spark, sf_dir))


@query(f"""
with {code_sql()},
n as (select distinct doc_id, lower(token) as word from tokens where line = 1 and regexp_matches(token, '^[A-Za-z]+$')),
c as (select doc_id, lower(token) as word, count(*) as n from tokens where line > 1 group by all)
select n.doc_id, coalesce(max(c.n), 0) as most, round(count(c.n) / count(*), 6) as coverage from n left join c using (doc_id, word) group by n.doc_id
""")
def title_word_overlap(spark, sf_dir):
    """The words of the first line, as a comment's, among those of the rest."""
    t = X.tokens(items(spark, sf_dir)).withColumn("word", F.lower("token"))
    return D.word_overlap(t.where((F.col("line") == 1) & F.col("token").rlike("^[A-Za-z]+$")).select("doc_id", "word"), t.where("line > 1").select("doc_id", "word"))


@query(f"""
with {LINES_SQL}, r as (select *, sum(length(text) + 1) over (partition by doc_id order by line) - length(text) - 1 as start, row_number() over (partition by doc_id order by length(text) desc, line) as place from lines)
select doc_id, line, cast(start as bigint) as start, cast(start + length(text) as bigint) as "end" from r where place = 1
""")
def longest_line(spark, sf_dir):
    """The longest line and its place in the text, the first of equals."""
    from pyspark.sql import Window

    own = Window.partitionBy("doc_id")
    start = F.coalesce(F.sum(F.length("text") + 1).over(own.orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    l = X.lines(items(spark, sf_dir)).withColumn("start", start).withColumn("place", F.row_number().over(own.orderBy(F.desc(F.length("text")), "line")))
    return l.where("place = 1").select("doc_id", "line", F.col("start").cast("long").alias("start"), (F.col("start") + F.length("text")).cast("long").alias("end"))


@query()
def posnett_by_language(spark, sf_dir):
    """Scores of texts of every language that can be read, each by its own tokens; those of Python by its lexer."""
    d = languages(spark, sf_dir).withColumn("vocabulary_of", X.routed(F.col("language"))).where("vocabulary_of is not null")
    brace = D.halstead(d.where("vocabulary_of = 'java'")).unionByName(D.halstead(d.where("vocabulary_of = 'c'"), "c")).select("doc_id", "content", "vocabulary_of", "length", "vocabulary", "volume", F.lit(True).alias("strict"))
    python = d.where("vocabulary_of = 'python'").withColumn("h", python_halstead(F.col("content"))).select("doc_id", "content", "vocabulary_of", "h.length", "h.vocabulary", "h.volume", "h.strict")
    all_ = checkpointed(brace.unionByName(python).withColumn("entropy", D.entropy("content")).withColumn("lines", F.size(X.line_array(F.col("content")))).drop("content"))
    return all_.select("doc_id", F.col("vocabulary_of").alias("language"), "strict", "length", "vocabulary", F.round(D.posnett(F.col("volume"), F.col("lines"), F.col("entropy")), 6).alias("score"))
