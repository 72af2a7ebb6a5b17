"""Work done where a document lies: nothing is shuffled for it, and long texts take time in proportion."""

import time

import pytest
from pyspark.sql import functions as F

from lectern.operators import counted
from lectern.operators import perturb as K
from lectern.operators import text as X
from lectern.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_garbled(spark, data):
    """Names exchanged in place are those of the table of names, and no row is shuffled by its document."""
    d = spark.createDataFrame([(1, "ab = cd(ab, 1ef) é + _g2"), (2, ""), (3, " ".join(f"n{i}" for i in range(3000)))], "doc_id long, content string")
    one = {r["doc_id"]: r["c"] for r in d.select("doc_id", K.garbled("content").alias("c")).collect()}
    two = {r["doc_id"]: r["content"] for r in K.rewritten(d, K.garbled_names(d), "garbled").collect()}
    assert one == two and len(set(one[3].split())) == 3000
    assert "hashpartitioning" not in plan(registry.queries()["rewrite_garbled"](spark, data))


def test_misleading_in_place(spark, data):
    d = spark.createDataFrame([(1, "abc abd x abc"), (2, "")], "doc_id long, content string")
    r = {x["name"]: x["misleading"] for x in K.renamed_misleading(d, ["one", "z"]).collect()}
    assert sorted(r.values()) == ["one", "one_2", "z"] and r["x"] == "z"
    assert "hashpartitioning" not in plan(registry.queries()["rename_misleading"](spark, data))


def test_layout_of_many_lines(spark):
    """A text of 100 000 line ends: 40 percent of them go, in time that grows with their number."""
    d = spark.createDataFrame([(1, "a\nb1 12 007 // c\n" * 50000 + "end")], "doc_id long, content string")
    begun = time.monotonic()
    r = d.select(F.regexp_count(K.compact_layout(F.col("content"), F.lit("k")), F.lit("\n")).alias("n"), F.substring(K.hexadecimal("content"), 1, 17).alias("h"), F.substring(K.short_names(F.lit("abcd 1abcd a")), 1, 20).alias("s")).first()
    assert r["n"] == 100000 - 20000 and r["h"] == "a\nb1 0xc 007 // c" and r["s"] == "abc 1abc a"  # a comment's own line ends stay
    assert time.monotonic() - begun < 20


CODE = 'import a.b;\nint x = f(a.b(c.d[1].e)).g + "a.*$" /* no\n x.y */; // z\nfooBar1(0x1F, \'\\d\', "p|q", "")\n\nreturn x_y2 == "" && this.m::n -> o;\n\x85 "a\\\x85b" ' + "q" * 300


def test_chunk_counts(spark, data):
    """Counts of one walk against the relation of chunks; no array of chunks is built."""
    d = spark.createDataFrame([(1, CODE), (2, ""), (3, "( )"), (4, CODE * 3)], "doc_id long, content string")
    r = {x["doc_id"]: x for x in X.chunks(d).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("lexeme").alias("distinct"), F.sum(F.length("lexeme")).alias("chars"), F.count_if(F.col("chunk_type") == "LITERAL").alias("literals"), F.count_if(F.col("chunk_type") == "IDENTIFIER").alias("names"), F.countDistinct("line").alias("lines")).collect()}
    got = {x["doc_id"]: x for x in counted.measured(d, counted.CHUNK_FIELDS, counted.chunk_counts).collect()}
    assert len(got) == 4 and len(r) == 2
    for k, own in got.items():
        assert all(own[c] == (r[k][c] if k in r else 0) for c in ("n", "distinct", "chars", "literals", "names", "lines"))
    assert "lambdafunction" not in plan(registry.queries()["chunk_stats"](spark, data))


def test_access_counts(spark, data):
    """Chains of one walk against the relation of chains; tokens are not shuffled by document."""
    d = spark.createDataFrame([(1, CODE), (2, ""), (3, "a.b a.b.c) d.e ( f.g"), (4, CODE * 3)], "doc_id long, content string")
    r = {x["doc_id"]: (x["n"], x["m"], x["s"]) for x in X.access_chains(X.access_tokens(d)).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("depth").alias("m"), F.sum("depth").alias("s")).collect()}
    got = {x["doc_id"]: tuple(x)[1:] for x in counted.measured(d, "chains deepest depths", counted.access_counts).collect()}
    assert all(got[k] == r.get(k, (0, 0, 0)) for k in got) and len(r) == 3
    assert "hashpartitioning" not in plan(registry.queries()["access_depth"](spark, data))


def test_density_counts(spark, data):
    """Counts of one walk against the relation of tokens; no array of tokens is built."""
    d = spark.createDataFrame([(1, CODE), (2, ""), (3, " \n\t\n"), (4, CODE * 3)], "doc_id long, content string")
    is_ = X.vocabulary(F.col("token"))
    r = {x["doc_id"]: x for x in X.tokens(d).groupBy("doc_id").agg(*[F.count_if(is_[k]).alias(f"n_{k}") for k in ("keyword", "operator", "comparison", "number", "identifier")], F.sum(F.when(is_["identifier"], F.length("token")).otherwise(0)).alias("c_identifier"), F.count_if(F.col("token") == ",").alias("n_comma")).collect()}
    got = {x["doc_id"]: x for x in counted.measured(d, counted.DENSITY_FIELDS, counted.density_counts("java")).collect()}
    for k, own in got.items():
        assert all(own[c] == (r[k][c] if k in r else 0) for c in ("n_keyword", "n_operator", "n_comparison", "n_number", "n_identifier", "c_identifier", "n_comma"))
    assert got[3]["loc"] == 1 and got[3]["ink"] == 0 and got[1]["max_names"] == 8
    assert "lambdafunction" not in plan(registry.queries()["token_density"](spark, data))


@pytest.mark.parametrize("name", ["perturb_garbled_names", "rename_short"])
def test_names_stay(spark, data, name):
    """Tables of names are made without a shuffle by document."""
    assert "hashpartitioning" not in plan(registry.queries()[name](spark, data))
