"""Operators on small tables with results worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import scalar as S
from lectern.operators import features as D
from lectern.operators import losses as H
from lectern.operators import models as J
from lectern.operators import perturb as K
from lectern.operators import relations as E
from lectern.operators import statistics as G
from lectern.operators import text as X
from lectern.operators import vectors as V
from lectern.sources import readers as A
from lectern.streaming import incremental as L


def one(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_lines_and_tokens(spark):
    d = spark.createDataFrame([(1, "a = b1;\r\n\nc"), (2, "")], "doc_id long, content string")
    assert sorted(one(X.lines(d), "doc_id", "line", "text")) == [(1, 1, "a = b1;"), (1, 2, ""), (1, 3, "c")]
    assert sorted(one(X.tokens(d), "line", "token")) == [(1, ";"), (1, "="), (1, "a"), (1, "b1"), (3, "c")]
    d = spark.createDataFrame([(1, "a == b && c >= 1.5e3 ? $x : 'p q' // z")], "doc_id long, content string")
    assert [t for _, t in sorted(one(X.tokens(d), "pos", "token"))] == ["a", "==", "b", "&&", "c", ">=", "1.5e3", "?", "$x", ":", "'p q'"]


def test_chunks(spark):
    d = spark.createDataFrame([(1, "if (a == b && c >= d) x = f(1); // no\npublic int y = ~z << 2;\nString r = \"^[a-z]+\\\\d$\";")], "doc_id long, content string")
    got = [(r["line"], r["chunk_type"], r["lexeme"]) for r in sorted(X.chunks(d).collect(), key=lambda r: (r["line"], r["pos"]))]
    assert got[:9] == [(1, "CONTROL_FLOW", "if"), (1, "IDENTIFIER", "a"), (1, "COMPARISON", "=="), (1, "IDENTIFIER", "b"), (1, "LOGICAL", "&&"), (1, "IDENTIFIER", "c"), (1, "COMPARISON", ">="), (1, "IDENTIFIER", "d"), (1, "IDENTIFIER", "x")]
    assert got[9:12] == [(1, "ASSIGNMENT", "="), (1, "CALL", "call_f"), (1, "LITERAL", "literal_1")]
    assert [k for line, k, _ in got if line == 2] == ["DECLARATION", "IDENTIFIER", "ASSIGNMENT", "BITWISE", "IDENTIFIER", "BITWISE", "LITERAL"]
    assert [k for line, k, _ in got if line == 3] == ["DECLARATION", "IDENTIFIER", "ASSIGNMENT", "REGEX"]


def test_languages(spark):
    d = spark.createDataFrame([("java",), ("Py ",), ("CUDA",), ("cobol",), ("",), (None,)], "l string")
    assert [r[0] for r in d.select(X.routed(F.col("l"))).collect()] == ["java", "python", "c", None, "java", "java"]


def test_imports(spark):
    d = spark.createDataFrame([(1, "import java.util.List;\nimport a.b.C;\n// C\nList x;")], "doc_id long, content string")
    assert sorted(one(X.imports(d), "line", "category", "base", "used")) == [(1, "stdlib", "util_List", True), (2, "external", "b_C", False)]


def test_comments_respect_strings(spark):
    d = spark.createDataFrame([(1, 'x = "// no"; // yes\n/* a\nb */ y')], "doc_id long, content string")
    assert sorted(one(X.comments(d), "comment", "form")) == [("/* a\nb */", "block"), ("// yes", "line")]
    assert d.select(X.strip_comments(F.col("content")).alias("c")).first()["c"] == 'x = "// no"; \n\n y'


def test_comment_groups(spark):
    d = spark.createDataFrame([("-----",), ("@author x\nversion: 2",), (" foo(bar);",), (" some words of prose",), ("x",), ("some words of prose\nfoo(bar);",), ("Copyright by us",), ("@param x\nCopyright by us",)], "t string")
    assert [r[0]["group"] for r in d.select(X.comment_group(F.col("t"))).collect()] == ["separator", "metadata", "code_like", "prose", "unknown", "mixed_unknown", "metadata", "mixed_unknown"]


def test_access_chains(spark):
    d = spark.createDataFrame([(1, "import x.y;\na.b(c.d)?.e; f->g; P::q 's.t' # u.v")], "doc_id long, content string")
    t = X.access_tokens(d)
    assert X.accesses(t).count() == 5
    assert sorted(one(X.access_chains(t), "depth")) == [(1,), (1,), (1,), (2,)]


def test_entropy_halstead_posnett(spark):
    d = spark.createDataFrame([(1, "abab")], "doc_id long, content string")
    assert D.byte_entropy(d).first()["entropy"] == 1.0
    assert D.halstead(d).first()["volume"] == 0.0
    assert spark.range(1).select(D.posnett(F.lit(0.0), F.lit(1.0), F.lit(0.0))).first()[0] == pytest.approx(1 / (1 + np.exp(-9.27)))


def test_spectrum_of_a_slow_wave(spark):
    d = spark.createDataFrame([([float(np.cos(2 * np.pi * t / 16)) for t in range(16)],)], "v array<double>")
    assert d.select(D.spectral_energy(F.col("v"))).first()[0] == pytest.approx(1.0)


def test_loss_measures(spark):
    """The text a+a with 1, 2 and 3 bits: every measure worked out by hand."""
    t = spark.createDataFrame([(1, 0, 0, 1, 1.0, 1, "a"), (1, 1, 1, 2, 2.0, 1, "+"), (1, 2, 2, 3, 3.0, 1, "a")], "doc_id long, i int, start int, end int, bits double, bytes long, text string")
    s = spark.createDataFrame([(1, "identifier", 0, 1), (1, "identifier", 2, 3), (1, "expression", 0, 3)], "doc_id long, role string, start int, end int")
    a = H.allocation(t)
    assert dict(one(H.interval_loss(a, s, ["role"]), "role", "bpb")) == {"identifier": 2.0, "expression": 2.0}
    r = {x["role"]: x for x in H.role_difficulty(a, s).collect()}["identifier"]
    assert (r["mean"], r["tail"], r["std"]) == (2.0, 3.0, 1.0)
    assert {(x["role"], x["occurrences"], x["scored"], x["covered_bytes"]) for x in H.coverage(a, s).collect()} == {("identifier", 2, 2, 2), ("expression", 1, 1, 3)}
    b = H.block_measures(H.blocks(t, 1), spark.createDataFrame([(1, 2.0)], "doc_id long, bpb double")).first()
    assert (b["tail"], b["tail_ratio"], b["jump_mean"]) == (3.0, 1.5, 1.0) and b["gini"] == pytest.approx(2 / 9, abs=1e-6) and b["run_ratio"] == pytest.approx(1 / 3, abs=1e-6)
    o = spark.createDataFrame([(1, "a", 0, 1), (1, "a", 2, 3)], "doc_id long, binding string, start int, end int")
    u = H.reuse_difficulty(a, o).first()
    assert (u["first"], u["later"], u["later_tail"], u["increase"], u["within_std"]) == (1.0, 3.0, 3.0, 2.0, 1.0)
    g = {x["role"]: x for x in H.context_difficulty(t.withColumn("bits", F.col("bits") + 1), t, s, size=1).collect()}
    assert (g["identifier"]["gain"], g["identifier"]["scored"], g["identifier"]["eligible"], g["identifier"]["skipped"]) == (1.0, 1, 1, 1)
    assert g["expression"]["gain"] is None and g["expression"]["skipped"] == 1
    c = H.comment_gain(t, t.withColumn("bits", F.col("bits") + 0.5)).first()
    assert (c["gain"], c["tokens"], c["bytes"]) == (0.5, 3, 3)


def test_bytes_are_shared_by_tokens_that_overlap(spark):
    t = spark.createDataFrame([(1, 0, 0, 2, 6.0, "éa"), (1, 1, 1, 3, 2.0, "ab")], "doc_id long, i int, start int, end int, bits double, text string")
    got = sorted((r["start"], r["bits"], r["bytes"], r["k"]) for r in H.allocation(t).collect())
    assert got == [(0, 4.0, 2, 1), (1, 3.0, 1, 2), (2, 1.0, 1, 1)]
    s = spark.createDataFrame([(1, "x", 0, 1), (1, "x", 0, 2)], "doc_id long, role string, start int, end int")
    assert one(H.interval_loss(H.allocation(t), s, ["role"]), "bits", "bytes") == [(7.0, 3)]


def test_broken_traces(spark):
    rows = [(1, 0, 0, 1, 1.0), (1, 0, 1, 2, -1.0), (1, 1, 5, 4, float("nan")), (1, 2, 2, 3, 1.0)]
    t = spark.createDataFrame(rows, "doc_id long, i int, start int, end int, bits double")
    assert sorted(one(H.invalid_tokens(t), "problem", "n")) == [("loss", 2), ("order", 1), ("repeated", 1), ("reversed", 1)]


def test_intervals(spark):
    i = spark.createDataFrame([(1, 0, 2), (1, 2, 4), (1, 6, 8)], "doc_id long, start int, end int")
    u = H.union(i, ["doc_id"])
    assert sorted(one(u, "start", "end")) == [(0, 4), (6, 8)]
    n = spark.createDataFrame([(1, 10), (2, 3)], "doc_id long, length int")
    assert sorted(one(H.complement(u, n, ["doc_id"]), "doc_id", "start", "end")) == [(1, 4, 6), (1, 8, 10), (2, 0, 3)]


def test_long_spans_meet_once(spark):
    t = spark.createDataFrame([(1, 0, 2000)], "doc_id long, start int, end int")
    s = spark.createDataFrame([(1, "r", 100, 1900)], "doc_id long, role string, start int, end int")
    assert H.overlap(t, s).count() == 1


def test_paired_summary(spark):
    v = spark.createDataFrame([("g", "base", "x", 0.8), ("g", "v1", "y", 0.5), ("g", "v2", "z", 0.9)], "g string, kind string, content_sha256 string, score double")
    r = E.paired_summary(E.paired(v.withColumn("cat", F.lit("c")), "g", F.col("kind") == "base", "score"), "kind", "cat").where("kind is null and cat is null").first()
    assert r["decrease_rate"] == 0.5 and r["n"] == 2


def test_best_match_and_default(spark):
    rows = [(1, 1, 1, [1.0, 0.0]), (1, 2, 1, [0.0, 1.0])]
    left = spark.createDataFrame(rows, "g long, id long, w int, v array<double>")
    right = spark.createDataFrame([(1, [1.0, 0.0])], "g long, v array<double>")
    r = V.best_match(left, right, ["g"], 0.5).first()
    assert (r["mean"], r["min"], r["below"], r["deficit"]) == (0.5, 0.0, 0.5, 0.25)
    r = V.best_match(left, right.where("g = 9"), ["g"], 0.42).first()
    assert (r["mean"], r["min"], r["below"], r["deficit"]) == (0.42, 0.42, 0.0, 0.0)


def test_large_labels_are_taken_whole(spark, tmp_path, monkeypatch):
    """A label of 700 vectors and one of one: pairs, best matches, diameter and median over all of them."""
    from lectern.plans import scoring
    from lectern.plans import vectors as P

    monkeypatch.setattr(V, "BLOCK", 128, raising=False)
    x = np.random.default_rng(5).normal(size=(701, 4)) + 0.5
    rows = [(i, int(i == 700), v.tolist()) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    u = x[:700] / np.linalg.norm(x[:700], axis=1)[:, None]
    w, kind, c = 1 + np.arange(700) % 3, np.arange(700) % 4, u @ u.T
    a, b = np.triu_indices(700, 1)
    d, ww = 1 - c[a, b], w[a] * w[b]
    mean = np.average(d, weights=ww)
    got = P.pairwise_cosine(spark, str(tmp_path)).collect()
    assert [r["label"] for r in got] == [0]
    assert np.allclose([got[0]["mean"], got[0]["std"]], [mean, np.average((d - mean) ** 2, weights=ww) ** 0.5], atol=2e-6)
    best = c[kind == 0][:, kind != 0].max(axis=1)
    r = P.best_match(spark, str(tmp_path)).where("label = 0").first()
    assert np.allclose([r["mean"], r["min"]], [np.average(best, weights=w[kind == 0]), best.min()], atol=2e-6)
    assert {r["label"]: r["diameter"] for r in P.cluster_diameters(spark, str(tmp_path)).collect()} == pytest.approx({0: d.max(), 1: 0.0}, abs=2e-6)
    assert {r["label"]: r["median"] for r in scoring.median_pair_distance(spark, str(tmp_path)).collect()} == pytest.approx({0: np.median(d)}, abs=2e-6)


def test_spectrum_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 5))
    df = spark.createDataFrame([(1, float(1 + i % 3), v.tolist()) for i, v in enumerate(x)], "g long, w double, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    w = 1.0 + np.arange(40) % 3
    e = np.linalg.eigvalsh(np.cov(u.T, aweights=w, ddof=0))
    p = e / e.sum()
    r = V.spectrum(df, ["g"]).first()
    assert r["dispersion"] == pytest.approx(1 - p.max()) and r["effective_rank"] == pytest.approx(np.exp(-(p * np.log(p)).sum()))


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(5)
    x, w = rng.normal(size=(60, 3)), rng.uniform(1, 2, 60)
    y = x @ [1, 2, 0] + rng.normal(size=60) * 0.1
    df = spark.createDataFrame([(*map(float, r), float(a), float(b)) for r, a, b in zip(x, y, w, strict=True)], "a double, b double, c double, y double, w double")
    beta, b0 = J.solve(J.gram(df, ["a", "b", "c"], "y", F.col("w")).first(), 2.0)
    mx, my = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    xc = x - mx
    want = np.linalg.solve(xc.T @ (w[:, None] * xc) + 2 * np.eye(3), xc.T @ (w * (y - my)))
    assert beta == pytest.approx(want) and b0 == pytest.approx(my - want @ mx)


def test_thresholds(spark):
    d = spark.createDataFrame([(0.1, False), (0.2, False), (0.8, True), (0.9, True)], "s double, l boolean").withColumn("g", F.lit(1))
    r = G.best_mcc(d, ["g"], "s", F.col("l")).first()
    assert r["threshold"] == 0.8 and r["mcc"] == 1.0
    assert G.spearman(d.withColumn("c", F.lit(1.0)), ["g"], "s", "c").first()["spearman"] is None


def test_scalars(spark):
    d = spark.createDataFrame([("getHTTPName_2x",)], "t string")
    assert d.select(S.subtokens(F.col("t"))).first()[0] == ["get", "http", "name", "2", "x"]
    assert d.select(S.expected_rating(F.lit("{1, 0, 0, 0}"))).first()[0] == 4.0
    assert [d.select(S.level(F.lit(x))).first()[0] for x in (0.4, 0.5, 0.7, float("nan"))] == ["LOW", "MEDIUM", "HIGH", ""]


def test_readers(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text('{"name":"a","code_snippet":"x","score":0.3}\n{"dataset":"d","source_id":"s","code":"y","readability":"High"}\n')
    got = A.json_lines(spark, f"file://{tmp_path}/rows.jsonl", "j")
    assert sorted(one(got, "task_id", "content", "readability_score")) == [("a", "x", 0.3), ("d__s", "y", 1.0)]
    (tmp_path / "votes.csv").write_text("r1,c,1,5\nr2,c,,3\n")
    assert sorted(one(A.vote_matrix(spark, f"file://{tmp_path}/votes.csv", 2, False), "item", "score", "votes")) == [("1", 1.0, 1), ("2", 4.0, 2)]
    with pytest.raises(ValueError):
        A.scored_texts(got.select("task_id", "readability_score"), got.where("task_id = 'a'").select("task_id", "content"))


def test_first_json_object(spark):
    said = ['no {"a": "}", "b": {"c": 1}} and {"d": 2}', "none", '{"open": 1', "} {}", '"{" {"x": 1}']
    got = [r[0] for r in spark.createDataFrame([(x,) for x in said], "t string").select(S.first_object(F.col("t"))).collect()]
    assert got == ['{"a": "}", "b": {"c": 1}}', None, None, "{}", '{"x": 1}']


def test_names_of_letters(spark):
    got = [r[0] for r in spark.range(52 + 52**2 + 52**3 + 3).orderBy("id").select(K.letters(F.col("id"))).collect()]
    assert got[:2] == ["a", "b"] and got[51:54] == ["Z", "aa", "ab"] and got[52 + 52**2 - 1 : 52 + 52**2 + 1] == ["ZZ", "aaa"] and got[-3] == "aaaa"
    assert len(set(got)) == len(got)


def test_renamed_texts(spark):
    d = spark.createDataFrame([(1, "counter = count + county; // counts")], "doc_id long, content string")
    r = K.renamed_short(d)
    assert len({x["renamed"] for x in r.collect()}) == r.count() == 4
    text = K.rewritten(d, r, "renamed").first()["content"]
    assert text.startswith("cou") and " = cou" in text and text.endswith(tuple("0123456789u"))
    wrong = {x["name"]: x["misleading"].split("_")[0] for x in K.renamed_misleading(d, ["abc", "sixsix", "sevenss"]).collect()}
    assert wrong == {"counter": "sevenss", "count": "sixsix", "county": "sixsix", "counts": "sixsix"}


def test_places_within_ranges(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), float(v), i) for i, (g, v) in enumerate(zip(rng.integers(0, 2, 3000), rng.integers(0, 400, 3000), strict=True))] + [(7, 1.0, 9000), (None, 2.0, 9001)]
    d = spark.createDataFrame(rows, "g int, v double, id long")
    place = {r["id"]: (r["_place"], r["_all"]) for r in G.positions(d, ["g"], "v", ["id"]).collect()}
    rank = {r["id"]: r["rank"] for r in G.average_rank(d, ["g"], "v").collect()}
    fold = {r["id"]: r["fold"] for r in G.fold(d, ["g"], ["id"], 4).collect()}
    for g in (0, 1, 7, None):
        own = sorted((v, i) for h, v, i in rows if h == g)
        assert [place[i] for _, i in own] == [(k + 1, len(own)) for k in range(len(own))]
        values = [v for v, _ in own]
        assert all(rank[i] == values.index(v) + (values.count(v) + 1) / 2 for v, i in own)
        sizes = np.bincount([fold[i] for _, i in own], minlength=4)
        assert sizes.max() - sizes.min() <= 1
    ids = d.select("g", "id")
    nxt = {r["id"]: r["n"] for r in G.following(ids, ["g"], "id", "n").collect()}
    own = sorted(i for h, _, i in rows if h == 0)
    assert [nxt[i] for i in own] == [*own[1:], own[0]]


def test_logistic_models(spark):
    """Newton steps over sums: the gradient vanishes, and L1 leaves out what has no part in the label."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 3))
    y = (rng.random(600) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 1.0 * x[:, 1] + 0.3)))).astype(float)
    d = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, y double").withColumn("w", F.lit(1.0)).withColumn("_h", F.xxhash64("id"))
    beta = J.logistic(d, ["a", "b", "c"], "y", "w", l2=1.0)[0]
    p = 1 / (1 + np.exp(-(x @ beta[:3] + beta[3])))
    assert np.abs(x.T @ (p - y) + beta[:3]).max() < 1e-3 and abs((p - y).sum()) < 1e-3
    r = {q["feature"]: q for q in J.stability(d, ["a", "b", "c"], "y", "id", rounds=40, c=0.03).collect()}
    assert r["a"]["rank"] == 1 and r["a"]["frequency"] == 1.0 and r["b"]["frequency"] > 0.9 > 0.5 > r["c"]["frequency"] and r["a"]["coefficient"] > 0 > r["b"]["coefficient"]
    chosen = J.forward_selection(d.withColumn("fold", F.col("id") % 4), ["c", "b", "a"], "y", "id", "fold", 4, 2)
    assert [f for f, _ in chosen] == ["a", "b"] and chosen[1][1] > chosen[0][1] > 0.6


def test_bootstrap_interval(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    rows = [("g", i, float(a), float(a + b)) for i, (a, b) in enumerate(zip(x, rng.normal(size=300), strict=True))] + [("one", 1000, 1.0, 1.0)]
    r = {q["g"]: q for q in J.bootstrap(spark.createDataFrame(rows, "g string, id long, x double, y double"), "g", "id", "x", "y", rounds=1000).collect()}
    ranks = lambda v: np.argsort(np.argsort(v))
    draws = rng.integers(0, 300, (400, 300))
    a, b = np.array([q[2] for q in rows[:300]]), np.array([q[3] for q in rows[:300]])
    own = [np.corrcoef(ranks(a[k]), ranks(b[k]))[0, 1] for k in draws]
    assert r["g"]["valid"] == 1000 and r["g"]["low"] == pytest.approx(np.quantile(own, 0.025), abs=0.03) and r["g"]["high"] == pytest.approx(np.quantile(own, 0.975), abs=0.03)
    assert r["one"]["low"] is None if "one" in r else True


def test_folds_fit_apart(spark):
    """Out-of-fold predictions against a ridge fitted by numpy for each fold."""
    rng = np.random.default_rng(4)
    x, fold = rng.normal(size=(90, 2)), np.arange(90) % 3
    y = x @ [0.1, -0.05] + 0.5 + rng.normal(size=90) * 0.05
    d = spark.createDataFrame([(i, *map(float, r), float(t), int(k)) for i, (r, t, k) in enumerate(zip(x, y, fold, strict=True))], "id long, a double, b double, y double, fold int")
    got = {r["id"]: r["prediction"] for r in J.out_of_fold(d, ["a", "b"], "y", F.lit(1.0), "fold", alpha=3.0).collect()}
    for k in range(3):
        tr, te = fold != k, fold == k
        lo, hi = x[tr].min(axis=0), x[tr].max(axis=0)
        m, s = x[tr].mean(axis=0), x[tr].std(axis=0)
        z, zt = (x[tr] - m) / s, (np.clip(x[te], lo, hi) - m) / s
        beta = np.linalg.solve(z.T @ z + 3 * np.eye(2), z.T @ (y[tr] - y[tr].mean()))
        want = np.clip(zt @ beta + y[tr].mean(), 0, 1)
        assert [got[i] for i in np.flatnonzero(te)] == pytest.approx(want.tolist())


def test_contracts(spark, tmp_path):
    """A feature table is loaded only if it is what its corpus says."""
    from lectern.sources import sinks as W

    f = spark.createDataFrame([("d", "1", "h1", 0.5), ("d", "2", "h2", None)], "dataset string, task_id string, sha string, x double")
    W.write_features(f, f"file://{tmp_path}/t", ["task_id", "sha", "x"], {"x": "a measure"}, {"version": 1})
    assert W.load_features(spark, f"file://{tmp_path}/t", ["x"], f.select("dataset", "task_id", "sha")).count() == 2
    for bad in (f.where("task_id = '1'"), f.withColumn("sha", F.lit("other"))):
        with pytest.raises(ValueError):
            W.load_features(spark, f"file://{tmp_path}/t", ["x"], bad.select("dataset", "task_id", "sha"))
    with pytest.raises(ValueError):
        W.load_features(spark, f"file://{tmp_path}/t", ["y"], f)
    with pytest.raises(ValueError):
        E.attach(f, f.unionByName(f).select("task_id"), ["task_id"])


def test_corpora_by_layout(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.json").write_text('[{"task_id": "t", "code": "x\\\\ny", "readability_score": 1.5}]')
    assert A.layout(["a.jsonl.gz"]) == "json_lines" and A.layout(["a.java"]) == "text_files"
    assert one(A.load(spark, f"file://{tmp_path}/c", "d"), "task_id", "content") == [("t", "x\ny")]
    m = spark.createDataFrame([("v", "b", "p", "0" * 64)], "variant_id string, base_sample_id string, local_path string, content_sha256 string")
    with pytest.raises(ValueError):
        A.manifest_corpus(spark.createDataFrame([("p", "text")], "path string, content string"), m, "d")


def test_perturbations(spark):
    d = spark.createDataFrame([(1, "total = 255 + 007 // sum\n\n\nnext")], "doc_id long, content string")
    assert d.select(K.hexadecimal(F.col("content"))).first()[0] == "total = 0xff + 007 // sum\n\n\nnext"
    assert d.select(K.short_names(F.col("content"))).first()[0] == "tot = 255 + 007 // sum\n\n\nnex"
    assert K.variants(d).count() == 5


def test_stream_follows_incrementally(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    schema = "task_id long, content string"
    build = lambda t: t.select("sha", F.length("content").alias("n"))

    def run():
        q = L.follow(spark.readStream.schema(schema).parquet(f"file://{src}"), f"file://{out}", build, f"file://{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()

    spark.createDataFrame([(1, "a"), (2, "bb")], schema).write.parquet(f"file://{src}")
    run()
    spark.createDataFrame([(3, "a"), (4, "ccc")], schema).write.mode("append").parquet(f"file://{src}")
    run()
    assert sorted(r["n"] for r in spark.read.parquet(f"file://{out}").collect()) == [1, 2, 3]


def test_bootstrap_draws(spark):
    """A round's correlation is that of its Poisson draws, told here row by row; a group's rounds are dealt out over many tasks."""
    rng = np.random.default_rng(6)

    def ranks(v):
        _, at, n = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(n) - (n - 1) / 2)[at]

    rows = [("g", i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.integers(0, 9, 40), rng.integers(0, 5, 40), strict=True))]
    d = spark.createDataFrame(rows, "g string, id long, x double, y double")
    h = np.array([r[0] for r in d.select(F.xxhash64(F.lit(20260923), "g", "id")).collect()], np.int64).view(np.uint64)
    found = []
    for k in range(60):
        n = J._drawn(h, k)
        x, y = (np.repeat([q[i] for q in rows], n) for i in (2, 3))
        found.append(np.corrcoef(ranks(x), ranks(y))[0, 1])
    r = J.bootstrap(d, "g", "id", "x", "y", rounds=60).first()
    assert r["valid"] == 60 and r["low"] == pytest.approx(np.quantile(found, 0.025)) and r["high"] == pytest.approx(np.quantile(found, 0.975))
    many = np.concatenate([J._drawn(np.arange(5000, dtype=np.uint64) * np.uint64(2**40 + 9), k) for k in range(20)])
    assert abs(many.mean() - 1) < 0.02 and abs((many == 0).mean() - np.exp(-1)) < 0.01
