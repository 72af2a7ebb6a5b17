"""Queries over texts, lines, tokens, comments and accesses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import scalar as S
from lectern.operators import counted
from lectern.operators import lexing as Z
from lectern.operators import text as X
from lectern.operators.statistics import capped_views as capped
from lectern.plans.registry import query, table
from lectern.sources.tables import checkpointed, spread


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as items: doc_id, dataset, content."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return d.select("doc_id", F.col("source").alias("dataset"), F.coalesce("text", F.lit("")).alias("content"))


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as code-like items, their comments as block comments: doc_id, content."""
    html = F.replace(F.replace(F.coalesce("html", F.lit("")), F.lit("<!--"), F.lit("/*")), F.lit("-->"), F.lit("*/"))
    return spread(table(spark, sf_dir, "pages").select("page_id", "html")).select(F.col("page_id").alias("doc_id"), html.alias("content"))


PAGES = "(select page_id, replace(replace(html, '<!--', '/*'), '-->', '*/') as html from pages)"


LINES_SQL = r"""
lines as (select doc_id, cast(unnest(range(1, len(a) + 1)) as int) as line, unnest(a) as text from (
  select doc_id, str_split(regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '\n\z', ''), chr(10)) as a from documents where length(text) > 0))
"""
DOCS = "select doc_id, text from documents"
PAGE_DOCS = "select page_id as doc_id, replace(replace(html, '<!--', '/*'), '-->', '*/') as text from pages"


def quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def among(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_BROKEN = r"str_split(regexp_replace(regexp_replace({0}, '\r\n|\r', chr(10), 'g'), '\n\z', ''), chr(10))"


def code_sql(source: str = DOCS) -> str:
    """Tables for oracles: src; code without comments; lines and code_lines; tokens; chunk tokens with the next one, and
    chunks, each by its first letters and place in the tables of signs."""
    pieces = quoted(rf"{X.STRING}|{X.COMMENT}|[^\"'/]+|[\"'/]")
    broken = lambda name, of: f"{name} as (select doc_id, cast(unnest(range(1, len(a) + 1)) as int) as line, unnest(a) as text from (select doc_id, {_BROKEN.format('text')} as a from {of} where length(text) > 0))"
    taken = lambda name, pattern: f"{name} as (select doc_id, line, cast(unnest(range(len(a))) as int) as pos, unnest(a) as token from (select doc_id, line, regexp_extract_all(text, '{quoted(pattern)}') as a from code_lines))"
    inner = "regexp_replace(token, '^[\"'']|[\"'']$', '', 'g')"
    m = lambda pattern: f"regexp_matches({inner}, '{pattern}')"
    regex = " or ".join((m(r"\\[dDsSwWbBAZzG]"), m(r"\\[.^$*+?{}\[\]|()]"), m(r"\[[^\]]*[\^\\-][^\]]*\]"), f"({m(r'[.][*+]')} and {m(r'[\^$|\\()]')})", f"({m(r'^\^|[$]$')} and length({inner}) > 2)", f"({m(r'[|]')} and not {m(r'[|][|]')})"))
    signs = " ".join(f"when token in ({among(v)}) then '{k}'" for k, v in X.CHUNK_SIGNS.items())
    kind = f"case when token in ('(', ')') or token in ({among(X.MODIFIERS)}) then null when token in ({among(X.CONTROL)}) then 'CONTROL_FLOW' when token in ({among(X.DECLARE)}) then 'DECLARATION' {signs} when regexp_matches(token, '^[\"'']') and ({regex}) then 'REGEX' when regexp_matches(token, '^[\"''0-9]') then 'LITERAL' when following = '(' then 'CALL' else 'IDENTIFIER' end"
    return f"""
src as ({source}),
{broken("lines", "src")},
code as (select doc_id, array_to_string([case when starts_with(x, '//') then '' when starts_with(x, '/*') then regexp_replace(x, '[^\n]', '', 'g') else x end for x in regexp_extract_all(text, '{pieces}')], '') as text from src),
{broken("code_lines", "code")},
{taken("tokens", S.TOKEN)},
{taken("chunk_tokens", S.CHUNK_TOKEN)},
followed as (select *, lead(token) over (partition by doc_id, line order by pos) as following from chunk_tokens),
kinds as (select *, {kind} as kind, regexp_replace(token, '\\s+', '', 'g') as bare from followed),
named as (select doc_id, line, pos, token, kind as chunk_type, case when kind in ('LITERAL', 'REGEX') then 'literal_' || bare when kind = 'CALL' then 'call_' || bare else bare end as lexeme from kinds where kind is not null and bare <> ''),
chunks as (select * from named where length(lexeme) <= 256)
"""


def vocabulary_sql(language: str = "java") -> str:
    """tokens with what they are in a language: word, keyword, operator, comparison, number, identifier."""
    keywords, operators, comparisons, words = X.LANGUAGES[language]
    return f"""
told as (select *, token in ({among(words)}) as word, token in ({among(keywords)}) as k, token in ({among(operators)}) as o, token in ({among(comparisons)}) as c from tokens),
vocabulary as (select doc_id, line, pos, token, not word and k as keyword, not word and o as operator, not word and c as comparison,
  not word and not k and not o and regexp_matches(token, '^[0-9]') as number, not word and not k and not o and regexp_matches(token, '^[A-Za-z_$]') as identifier from told)
"""


@query("select doc_id, sha256(text) as content_sha256, length(text) as n_chars, strlen(text) as n_bytes from documents")
def content_hash(spark, sf_dir):
    d = items(spark, sf_dir)
    return d.select("doc_id", S.fingerprint(F.col("content")).alias("content_sha256"), F.length("content").cast("long").alias("n_chars"), F.octet_length("content").cast("long").alias("n_bytes"))


@query(f"with {LINES_SQL} select doc_id, line, text from lines")
def line_explode(spark, sf_dir):
    return X.lines(items(spark, sf_dir))


@query(r"""select page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g') as slug from pages""")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.slug(F.col("url")).alias("slug"))


@query(r"""
with w as (select distinct unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*')) as word from documents)
select word, len([x for x in str_split(regexp_replace(lower(regexp_replace(regexp_replace(word, '[^A-Za-z0-9]+', ' ', 'g'), '([A-Z][a-z]+|[a-z]+|[0-9]+)', ' \1 ', 'g')), ' +', ' ', 'g'), ' ') if x <> '']) as n_parts from w
""")
def identifier_parts(spark, sf_dir):
    w = items(spark, sf_dir).select(F.explode(F.regexp_extract_all("content", F.lit("[A-Za-z][A-Za-z0-9]*"), F.lit(0))).alias("word")).distinct()
    return w.select("word", F.size(S.subtokens(F.col("word"))).cast("long").alias("n_parts"))


@query("""select doc_id, case when length(text) > 600 then concat(substring(text, 1, 298), chr(10), '...', chr(10), right(text, 297)) else text end as content from documents""")
def middle_cut(spark, sf_dir):
    return items(spark, sf_dir).select("doc_id", S.middle_cut(F.col("content"), 600).alias("content"))


@query("""
with s as (select doc_id, text, unnest(range(0, cast(ceil(greatest(0, length(text) - 3000) / 2700.0) as bigint) + 1)) as i from documents)
select doc_id, cast(i as int) as segment, substring(text, i * 2700 + 1, 3000) as content from s
""")
def overlapping_segments(spark, sf_dir):
    d = items(spark, sf_dir)
    return d.select("doc_id", F.posexplode(S.segments(F.col("content"))).alias("segment", "content"))


@query(r"""select doc_id, regexp_matches(text, '(^|[^A-Za-z0-9_$])[abcdeijkmnxyz]([^A-Za-z0-9_$]|$)') as has_short_name from documents""")
def short_name_candidates(spark, sf_dir):
    return items(spark, sf_dir).select("doc_id", F.col("content").rlike(r"(^|[^A-Za-z0-9_$])[abcdeijkmnxyz]([^A-Za-z0-9_$]|\z)").alias("has_short_name"))


@query(f"with {code_sql()} select doc_id, count(*) as n_tokens, count(distinct token) as n_distinct, max(line) as last_line from tokens group by doc_id")
def token_counts(spark, sf_dir):
    d = items(spark, sf_dir).withColumn("t", X.token_lines(X.line_array(X.strip_comments(F.col("content")))))
    flat = F.flatten("t")
    last = F.array_max(F.transform("t", lambda x, i: F.when(F.size(x) > 0, i + 1).otherwise(0)))
    return d.where(F.size(flat) > 0).select("doc_id", F.size(flat).cast("long").alias("n_tokens"), F.size(F.array_distinct(flat)).cast("long").alias("n_distinct"), last.cast("int").alias("last_line"))


def languages(spark, sf_dir):
    """items with the name of a language, one of them unknown, by their id."""
    names = F.array(*map(F.lit, ("java", " Python", "C++", "cobol", "cuda", "")))
    return items(spark, sf_dir).withColumn("language", F.get(names, (F.col("doc_id") % 6).cast("int")))


_ROUTED = "case doc_id % 6 when 0 then 'java' when 1 then 'python' when 2 then 'c' when 4 then 'c' when 5 then 'java' end"


@query(f"select doc_id, {_ROUTED} as vocabulary, case when {_ROUTED} is null then 'unknown language' else 'lexical' end as mode from documents")
def language_routing(spark, sf_dir):
    """The vocabulary that each text is read with; unknown languages are set apart with the reason."""
    d = languages(spark, sf_dir).withColumn("vocabulary", X.routed(F.col("language")))
    return d.select("doc_id", "vocabulary", F.when(F.col("vocabulary").isNull(), "unknown language").otherwise("lexical").alias("mode"))


_COUNTED = ", ".join(f"count(*) filter (where {k}) as {k}s" for k in ("keyword", "operator", "comparison", "literal_word", "number", "identifier"))
_PER_LANGUAGE = " union all ".join(
    f"select doc_id, token in ({among(w)}) as literal_word, token not in ({among(w)}) and token in ({among(k)}) as keyword, token not in ({among(w)}) and token in ({among(o)}) as operator, token not in ({among(w)}) and token in ({among(c)}) as comparison, token not in ({among([*w, *k, *o])}) and regexp_matches(token, '^[0-9]') as number, token not in ({among([*w, *k, *o])}) and regexp_matches(token, '^[A-Za-z_$]') as identifier from tokens where {_ROUTED} = '{name}'"
    for name, (k, o, c, w) in X.LANGUAGES.items()
)


@query(f"with {code_sql()}, told as ({_PER_LANGUAGE}) select doc_id, {_COUNTED} from told group by doc_id")
def token_categories(spark, sf_dir):
    """Tokens of each text by what they are in its own language."""
    d = languages(spark, sf_dir).withColumn("v", X.routed(F.col("language"))).where("v is not null")
    d = d.withColumn("t", F.flatten(X.token_lines(X.line_array(X.strip_comments(F.col("content")))))).where(F.size("t") > 0)

    def many(kind):
        own = lambda name: F.when(F.col("v") == name, F.size(F.filter("t", lambda x: X.vocabulary(x, name)[kind])))
        return F.coalesce(*map(own, X.LANGUAGES)).cast("long").alias(f"{kind}s")

    return d.select("doc_id", *map(many, ("keyword", "operator", "comparison", "literal_word", "number", "identifier")))


@query(f"with {code_sql()} select chunk_type, count(*) as n, count(distinct doc_id) as docs, count(distinct lexeme) as lexemes from chunks group by chunk_type")
def chunk_types(spark, sf_dir):
    c = X.chunks(items(spark, sf_dir))
    return c.groupBy("chunk_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.countDistinct("lexeme").alias("lexemes"))


@query(f"with {code_sql(PAGE_DOCS)} select doc_id, chunk_type, lexeme, count(*) as n from chunks group by all")
def chunk_multiset(spark, sf_dir):
    """How often each lexeme of each type stands in each page."""
    return X.chunks(code(spark, sf_dir)).groupBy("doc_id", "chunk_type", "lexeme").agg(F.count("*").alias("n"))


#: documents with lines that import names, some of which stand elsewhere in the text.
IMPORTING = """select doc_id, 'import java.util.List;' || chr(10) || 'import org.x.' || regexp_extract(text, '[A-Za-z]{4,}') || ';' || chr(10) || 'import static a.b.Zq' || doc_id || ';' || chr(10) || 'import java.lang.*;' || chr(10) || text as text from documents"""


def importing(spark, sf_dir):
    d = items(spark, sf_dir)
    head = F.concat(F.lit("import java.util.List;\nimport org.x."), F.regexp_extract("content", "[A-Za-z]{4,}", 0), F.lit(";\nimport static a.b.Zq"), F.col("doc_id").cast("string"), F.lit(";\nimport java.lang.*;\n"))
    return d.withColumn("content", F.concat(head, "content"))


@query(rf"""
with {code_sql(IMPORTING)},
i as (select doc_id, line, regexp_extract(text, '{X.IMPORT}', 1) as imported from lines where regexp_matches(text, '{X.IMPORT}')),
w as (select distinct doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) as word from code_lines where not regexp_matches(text, '{X.IMPORT}')),
p as (select *, str_split(imported, '.') as p from i)
select p.doc_id, line, imported, case when regexp_matches(imported, '^javax?[.]') then 'stdlib' else 'external' end as category,
  case when len(p) >= 2 then p[-2] || '_' || p[-1] else imported end as base, case when ends_with(imported, '.*') then imported = 'java.lang.*' else w.word is not null end as used
from p left join w on w.doc_id = p.doc_id and w.word = p.p[-1]
""")
def import_lines(spark, sf_dir):
    return X.imports(importing(spark, sf_dir))


@query(rf"""
with {code_sql(PAGE_DOCS)},
l as (select distinct regexp_replace(token, '^["'']|["'']$', '', 'g') as v from tokens where regexp_matches(token, '^["'']')),
t as (select v, regexp_extract_all(v, '\[(?:\\.|[^\]\\])*\]?|\(\?[^:)]*[:)]?|\{{[^}}]*\}}?\??|\\.|[()*+?|^$]|[^\[({{*+?|^$\\]+|\\') as a from l)
select v as literal, len(a) as parts, array_to_string(a, ' ') as joined from t
""")
def regex_parts(spark, sf_dir):
    """String literals of pages, taken apart as regular expressions are."""
    t = F.flatten(X.token_lines(X.line_array(X.strip_comments(F.col("content")))))
    l = code(spark, sf_dir).select(F.explode(F.filter(t, lambda x: x.rlike("^[\"']"))).alias("x")).select(F.regexp_replace("x", "^[\"']|[\"']$", "").alias("literal")).distinct()
    parts = X.regex_tokens(F.col("literal"))
    return l.select("literal", F.size(parts).cast("long").alias("parts"), F.array_join(parts, " ").alias("joined"))


_PIECES = rf"{X.STRING}|{X.COMMENT}|[^\"'/]+|[\"'/]".replace("'", "''")
COMMENTS_SQL = rf"""
found as (select page_id as doc_id, [x for x in regexp_extract_all(html, '{rf"{X.STRING}|{X.COMMENT}".replace("'", "''")}') if starts_with(x, '//') or starts_with(x, '/*')] as a from {PAGES}),
comments as (select doc_id, cast(unnest(range(len(a))) as int) as i, unnest(a) as comment from found)
"""


@query(f"with {code_sql(PAGE_DOCS)} select doc_id, sha256(text) as sha, length(text) as n_chars from code")
def comment_stripping(spark, sf_dir):
    d = code(spark, sf_dir).withColumn("content", X.strip_comments(F.col("content")))
    return d.select("doc_id", S.fingerprint(F.col("content")).alias("sha"), F.length("content").cast("long").alias("n_chars"))


@query(f"""with {COMMENTS_SQL} select doc_id, i, comment, case when starts_with(comment, '//') then 'line' when starts_with(comment, '/**') then 'documentation' else 'block' end as form from comments""")
def comment_forms(spark, sf_dir):
    return X.comments(code(spark, sf_dir))


@query(rf"""
with {COMMENTS_SQL},
b as (select doc_id, i, str_split(regexp_replace(regexp_replace(comment, '^/\*+|\*+/$', '', 'g'), '^//+', ''), chr(10)) as parts from comments),
p as (select doc_id, i, cast(unnest(range(len(parts))) as int) as part, unnest(parts) as text from b),
t as (select doc_id, i, part, regexp_replace(regexp_replace(text, '^[ \t]*\*+', ''), '^[ \t]+|[ \t]+$', '', 'g') as text from p)
select * from t where text <> ''
""")
def comment_parts(spark, sf_dir):
    """Comments line by line, without their marks."""
    return X.comment_lines(X.comments(code(spark, sf_dir)))


#: Bodies of comments: those of pages, and texts of other kinds made from documents.
BODIES = rf"""
{COMMENTS_SQL},
bodies as (select doc_id * 100 + i as id, regexp_replace(regexp_replace(comment, '^/\*+|\*+/$', '', 'g'), '^//+', '') as body from comments
  union all select -1 - doc_id, case doc_id % 6 when 0 then left(text, 80) when 1 then 'x = ' || doc_id || ';' || chr(10) || 'run(y);' when 2 then 'x = 1;' || chr(10) || left(text, 60) || ' words' when 3 then 'Copyright (c) ' || doc_id
    when 4 then '@author a' || chr(10) || '@version 2' else '@param x the value' || chr(10) || 'Licensed under y' end from documents)
"""


def bodies(spark, sf_dir):
    bare = F.regexp_replace(F.regexp_replace("comment", r"^/\*+|\*+/$", ""), "^//+", "")
    pages = X.comments(code(spark, sf_dir)).select((F.col("doc_id") * 100 + F.col("i")).alias("id"), bare.alias("body"))
    k, t, n = F.col("doc_id") % 6, F.col("content"), F.col("doc_id").cast("string")
    made = F.when(k == 0, F.left(t, F.lit(80))).when(k == 1, F.concat(F.lit("x = "), n, F.lit(";\nrun(y);"))).when(k == 2, F.concat(F.lit("x = 1;\n"), F.left(t, F.lit(60)), F.lit(" words")))
    made = made.when(k == 3, F.concat(F.lit("Copyright (c) "), n)).when(k == 4, F.lit("@author a\n@version 2")).otherwise(F.lit("@param x the value\nLicensed under y"))
    return pages.unionByName(items(spark, sf_dir).select((-1 - F.col("doc_id")).alias("id"), made.alias("body")))


@query(rf"""
with {BODIES},
l as (select id, body, unnest(str_split(body, chr(10))) as line from bodies),
k as (select id, any_value(body) as body, count(*) filter (where trim(line, ' ') <> '') as n, count(*) filter (where trim(line, ' ') <> '' and c) as code, count(*) filter (where trim(line, ' ') <> '' and p) as told,
  coalesce(bool_or(w >= 3) filter (where trim(line, ' ') <> '' and not c), false) as prose_rest, coalesce(bool_or(w >= 3) filter (where trim(line, ' ') <> '' and not p), false) as prose_other, coalesce(bool_or(f) filter (where trim(line, ' ') <> ''), false) as functional
  from (select *, regexp_matches(line, '{X.CODE_LINE}') as c, regexp_matches(line, '{X.PROVENANCE}') as p, regexp_matches(line, '{X.FUNCTIONAL}') as f, len(regexp_extract_all(line, '[A-Za-z]+')) as w from l) group by id),
m as (select *, regexp_replace(body, '\s+', '', 'g') as compact, len(regexp_extract_all(body, '[A-Za-z]+')) as words, regexp_matches(body, '{X.LICENSE}') as license from k),
g as (select id, case when n = 0 then 'unknown:empty' when length(compact) >= 3 and 10 * length(regexp_replace(compact, '[A-Za-z0-9]+', '', 'g')) >= 9 * length(compact) and words = 0 then 'separator:signs without words'
  when code = n then 'code_like:every line has the form of code' when code > 0 and prose_rest then 'mixed_unknown:code and words' when told > 0 and told < n and prose_other then 'mixed_unknown:provenance and words'
  when license and functional then 'mixed_unknown:license and documentation' when license then 'metadata:license' when told = n then 'metadata:provenance fields' when words >= 3 then 'prose:words' else 'unknown:nothing that tells' end as g from m)
select id, split_part(g, ':', 1) as content_group, split_part(g, ':', 2) as reason from g
""")
def comment_groups(spark, sf_dir):
    b = bodies(spark, sf_dir).withColumn("g", X.comment_group(F.col("body")))
    return b.select("id", F.col("g.group").alias("content_group"), "g.reason")


ACCESS_SQL = rf"""
{code_sql(PAGE_DOCS)},
plain as (select doc_id, line, case when regexp_matches(text, '{X.DECLARATION_LINE}') then '' else text end as text from code_lines),
taken as (select doc_id, line, unnest(range(len(a))) as k, unnest(a) as token from (select doc_id, line, regexp_extract_all(text, '{quoted(S.ACCESS_TOKEN)}') as a from plain)),
access_tokens as (select doc_id, line, token, row_number() over (partition by doc_id order by line, k) as pos from taken where not regexp_matches(token, '^["''`#]'))
"""
_NAME, _SIGN = "regexp_matches({0}, '^[A-Za-z_$]')", "{0} in ('.', '?.', '::', '->')"


@query(f"""
with {ACCESS_SQL},
n as (select *, lag(token) over w as before, lead(token) over w as after from access_tokens window w as (partition by doc_id order by pos)),
e as (select doc_id, count(*) as n_accesses, count(distinct line) as lines, count(*) filter (where token <> '.') as others from n where {_SIGN.format("token")} and ({_NAME.format("before")} or before in (')', ']')) and {_NAME.format("after")} group by doc_id),
l as (select doc_id, count(*) as loc from lines where trim(text, ' ') <> '' group by doc_id)
select e.*, round(n_accesses / loc, 6) as density from e join l using (doc_id)
""")
def access_edges(spark, sf_dir):
    d = code(spark, sf_dir)
    a = X.accesses(X.access_tokens(d))
    loc = d.select("doc_id", F.size(F.filter(X.line_array(F.col("content")), lambda l: F.trim(l) != "")).alias("loc"))
    a = a.groupBy("doc_id").agg(F.count("*").alias("n_accesses"), F.countDistinct("line").alias("lines"), F.count_if(F.col("token") != ".").alias("others"))
    return a.join(loc, "doc_id").select("doc_id", "n_accesses", "lines", "others", F.round(F.col("n_accesses") / F.col("loc"), 6).alias("density"))


@query(f"""
with {ACCESS_SQL},
d as (select *, sum(case when token in ('(', '[') then 1 when token in (')', ']') then -1 else 0 end) over (partition by doc_id order by pos) - case when token in ('(', '[') then 1 else 0 end as depth from access_tokens),
n as (select *, lag(token) over (partition by doc_id, depth order by pos) as near from d),
b as (select *, sum(case when not ({_NAME.format("token")} or {_SIGN.format("token")} or token in ('(', ')', '[', ']')) or near is null or ({_NAME.format("token")} and not {_SIGN.format("near")}) then 1 else 0 end) over (partition by doc_id, depth order by pos) as chain from n),
c as (select doc_id, depth, chain, count(*) filter (where {_SIGN.format("token")}) as dots from b group by doc_id, depth, chain)
select doc_id, count(*) as chains, max(dots) as deepest, round(avg(dots), 6) as mean_depth from c where dots > 0 group by doc_id
""")
def access_depth(spark, sf_dir):
    c = counted.measured(code(spark, sf_dir), "chains deepest depths", counted.access_counts).where("chains > 0")
    return c.select("doc_id", "chains", "deepest", F.round(F.col("depths") / F.col("chains"), 6).alias("mean_depth"))


@query(f"""
with {code_sql(PAGE_DOCS)}, t as (select doc_id, count(*) filter (where token in (';', 'if', 'for', 'while', 'switch', 'do', 'class', 'interface', 'enum')) as n from tokens group by doc_id)
select src.doc_id, greatest(coalesce(n, 0), 1) as lloc from src left join t using (doc_id)
""")
def logical_lines(spark, sf_dir):
    """Statement terminators, control statements and declarations; at least one."""
    t = F.flatten(X.token_lines(X.line_array(X.strip_comments(F.col("content")))))
    n = F.size(F.filter(t, lambda x: x.isin(";", "if", "for", "while", "switch", "do", "class", "interface", "enum")))
    return code(spark, sf_dir).select("doc_id", F.greatest(n, F.lit(1)).cast("long").alias("lloc"))


@query(r"""
with i as (select page_id, line from (select page_id, unnest(str_split(html, '<')) as line from (select page_id, replace(replace(html, '<!--', '/*'), '-->', '*/') as html from pages))),
t as (select page_id, lower(regexp_extract(line, '^(/?[A-Za-z][A-Za-z0-9]*)', 1)) as tag from i)
select tag, count(*) as n, count(distinct page_id) as pages from t where tag <> '' group by tag
""")
def tag_inventory(spark, sf_dir):
    t = code(spark, sf_dir).select("doc_id", F.explode(F.split("content", "<")).alias("line"))
    t = t.select("doc_id", F.lower(F.regexp_extract("line", "^(/?[A-Za-z][A-Za-z0-9]*)", 1)).alias("tag")).where("tag <> ''")
    return t.groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("pages"))


@query("""
with l as (select doc_id, unnest(range(len(a))) as r, unnest(a) as line from (select doc_id, str_split(text, chr(10)) as a from documents)),
c as (select doc_id, r, unnest(range(length(line))) as k, unnest(str_split(line, '')) as ch from l where line <> ''),
v as (select doc_id, r, k, case when unicode(ch) > 255 then 1.0 else unicode(ch) / 256.0 end as v from c where r < 20 and k < 40),
g as (select doc_id, count(*) as filled, sum(v) as total, sum(v * (r * 40 + k)) as weighed from v group by doc_id)
select d.doc_id, coalesce(filled, 0) as filled, 800 - coalesce(filled, 0) as padded, round(coalesce(total, 0) - (800 - coalesce(filled, 0)), 6) as total, round(coalesce(weighed, 0), 4) as weighed from documents d left join g using (doc_id)
""")
def character_matrix(spark, sf_dir):
    """A text as a matrix of 20 lines by 40 columns: code point / 256, larger ones 1, cells without a character -1; given by
    its sums, and the sum of its characters weighed by their places."""
    d = items(spark, sf_dir)
    m = X.character_matrix(F.col("content"), 20, 40)
    d = d.select("doc_id", m.alias("m"))
    plus = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    filled = F.size(F.filter("m", lambda x: x >= 0)).cast("long")
    return d.select("doc_id", filled.alias("filled"), (800 - filled).alias("padded"), F.round(plus("m"), 6).alias("total"), F.round(plus(F.transform("m", lambda x, i: F.greatest(x, F.lit(0.0)) * i)), 4).alias("weighed"))


_ROLE_WORDS = among([*X.JAVA_KEYWORDS, *Z.BRACE_WORDS])
_ROLE_PIECES = quoted(
    r"(?s)//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|(?:u8|[LuU])?\"(?:\\.|[^\"\\])*\"|[LuU]?'(?:\\.|[^'\\])*'|\b(?:0[xX][0-9a-fA-F]+|0[bB][01]+|[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?)[uUlLfFdD]*\b|[\pL\p{Nl}_][\pL\pN_$]*|[$][\pL\pN_$]+|/\*|."
)


@query(rf"""
with p as (select doc_id, unnest(range(len(a))) as k, unnest(a) as x from (select doc_id, regexp_extract_all(coalesce(text, ''), '{_ROLE_PIECES}') as a from documents)),
n as (select *, lag(x) over w as before, lead(x) over w as after, cast(sum(length(x)) over w as bigint) as stop, cast(sum(strlen(x)) over w as bigint) as byte_stop from p window w as (partition by doc_id order by k)),
r as (select *, case when x in ('"', chr(39), '/*') then 'broken' when starts_with(x, '//') or starts_with(x, '/*') then 'comment' when length(x) > 1 and (x[-1] in ('"', chr(39)) or regexp_matches(x, '^[0-9]')) then 'literal'
  when regexp_matches(x, '^[0-9]$') then case when regexp_matches(coalesce(before, ''), '[\pL\pN_]$') or regexp_matches(coalesce(after, ''), '^[\pL\pN_]') then 'other' else 'literal' end
  when x in ({among(Z.LITERAL_WORDS)}) then 'literal' when x in ({_ROLE_WORDS}) then 'keyword' when regexp_matches(x, '^[\pL\p{{Nl}}_]') or length(x) > 1 and x[1] = '$' then 'identifier' else 'other' end as role from n),
b as (select doc_id, min(k) as b from r where role = 'broken' group by doc_id),
t as (select r.*, b.b from r left join b using (doc_id) where role not in ('broken', 'other') and (b.b is null or k < b.b)),
c as (select doc_id, count(*) filter (where role = 'identifier') as identifiers, count(*) filter (where role = 'literal') as literals, count(*) filter (where role = 'comment') as comments,
  coalesce(cast(sum(length(x)) filter (where role <> 'keyword') as bigint), 0) as chars, coalesce(cast(sum(byte_stop) filter (where role <> 'keyword') as bigint), 0) as byte_ends, max(stop) as last from t group by doc_id)
select d.doc_id, coalesce(identifiers, 0) as identifiers, coalesce(literals, 0) as literals, coalesce(comments, 0) as comments, coalesce(chars, 0) as chars, coalesce(byte_ends, 0) as byte_ends,
  case when b.b is not null then coalesce(last, 0) end as unterminated from documents d left join c using (doc_id) left join b using (doc_id)
""")
def lexical_roles(spark, sf_dir):
    """Identifiers, literals and comments that the lexer alone tells, their lengths and places, and where reading ends."""
    return Z.role_counts(items(spark, sf_dir).select("doc_id", "content"))


def python_texts(spark, sf_dir):
    return languages(spark, sf_dir).where(X.routed(F.col("language")) == "python")


@query()
def python_lexing(spark, sf_dir):
    """Tokens of each text that is read as Python, by what they are, and whether it is well formed."""
    d = python_texts(spark, sf_dir).select("doc_id", Z.python_tokens(F.col("content")).alias("t"))
    of = lambda kind: F.size(F.filter("t.tokens", lambda x: x["kind"] == kind)).cast("long").alias(f"{kind}s")
    last = F.coalesce(F.array_max(F.transform("t.tokens", lambda x: x["line"])), F.lit(0)).alias("last_line")
    return d.select("doc_id", "t.strict", F.size("t.tokens").cast("long").alias("tokens"), *map(of, ("keyword", "name", "number", "string", "operator")), last)


VIEWS = {"all": (), "names": ("IDENTIFIER", "CALL"), "values": ("LITERAL", "REGEX"), "signs": ("ARITHMETIC", "ASSIGNMENT", "BITWISE", "COMPARISON", "LOGICAL")}
_VIEW_ROWS = " union all ".join(f"select '{v}' as view, {f"'{k}'" if k else 'null'} as kind" for v, own in VIEWS.items() for k in (own or (None,)))


@query(f"""
with {code_sql(PAGE_DOCS)}, m as (select doc_id, chunk_type, lexeme, count(*) as n from chunks group by all), w as ({_VIEW_ROWS}),
r as (select w.view, m.*, row_number() over (partition by doc_id, w.view order by n desc, chunk_type, lexeme) as place from m join w on w.kind is null or w.kind = m.chunk_type)
select doc_id, view, count(*) filter (where place <= 32) as kept, cast(sum(n) filter (where place <= 32) as bigint) as weight, min(n) filter (where place <= 32) as least, max(lexeme) filter (where place <= 32) as last, cast(sum(n) as bigint) as total from r group by doc_id, view
""")
def capped_views(spark, sf_dir):
    """The heaviest lexemes of each page in several views, at most 32 of each, and what share of the weight they have."""
    m = checkpointed(X.chunks(code(spark, sf_dir)).groupBy("doc_id", "chunk_type", "lexeme").agg(F.count("*").alias("n")))
    kept = capped(m, ["doc_id"], "chunk_type", VIEWS, "n", ["chunk_type", "lexeme"], 32)
    kept = kept.groupBy("doc_id", "view").agg(F.count("*").alias("kept"), F.sum("n").alias("weight"), F.min("n").alias("least"), F.max("lexeme").alias("last"))
    in_view = F.explode(F.array_compact(F.array(*[F.when(F.col("chunk_type").isin(*own) if own else F.lit(True), F.lit(v)) for v, own in VIEWS.items()])))
    total = m.select("doc_id", in_view.alias("view"), "n").groupBy("doc_id", "view").agg(F.sum("n").alias("total"))
    return kept.join(total, ["doc_id", "view"])
