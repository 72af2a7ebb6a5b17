"""Exact quantiles, sums without a group, matrix sums and sweeps over boundaries, against numpy and by hand."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.operators import losses as H
from lectern.operators import models as J
from lectern.operators import quantiles as Q
from lectern.operators import sweeps
from lectern.operators.statistics import balanced_weight


@pytest.fixture(scope="module")
def values(spark):
    """Groups of normal, widely spread, tied and constant values, nulls and values that aren't finite among them."""
    rng, n = np.random.default_rng(3), 6000
    g = rng.integers(0, 4, n)
    x = np.choose(g, [rng.normal(size=n), np.exp(rng.normal(size=n) * 150), rng.integers(0, 3, n).astype(float), np.full(n, 5.0)])
    d = pd.DataFrame({"g": g, "fold": rng.integers(0, 3, n), "x": x})
    d.loc[::97, "x"] = None
    d.loc[1::301, "x"] = np.inf
    rows = [(int(a), int(b), None if pd.isna(c) else float(c)) for a, b, c in d.itertuples(index=False)] + [(None, 0, 1.0), (None, 1, 3.0), (9, 0, None), (9, 1, float("nan"))]
    good = d[np.isfinite(d.x)]
    return spark.createDataFrame(rows, "g int, fold int, x double").repartition(5).cache(), good


def test_quantiles_of_groups(values, monkeypatch):
    monkeypatch.setattr(Q, "SMALL", 20)
    monkeypatch.setattr(Q, "BINS", 16)
    df, good = values
    got = {r["g"]: (r["a"], r["b"]) for r in Q.quantiles(df, ["g"], "x", {"a": 0.5, "b": 0.07}).collect()}
    want = {g: tuple(v.x.quantile(p) for p in (0.5, 0.07)) for g, v in good.groupby("g")}
    assert got.pop(None) == pytest.approx((2.0, 1.14)) and got.pop(9) == (None, None)
    assert got == {g: pytest.approx(v, rel=1e-12) for g, v in want.items()}


def test_quantiles_without_a_part(values, monkeypatch):
    monkeypatch.setattr(Q, "SMALL", 50)
    df, good = values
    got = {(r["g"], r["fold"]): r["m"] for r in Q.quantiles(df, ["g"], "x", {"m": 0.3}, without="fold").collect()}
    assert (got.pop((None, 0)), got.pop((None, 1))) == (3.0, 1.0) and got.pop((9, 0)) is got.pop((9, 1)) is None
    assert got == {(g, f): pytest.approx(v[v.fold != f].x.quantile(0.3), rel=1e-12) for g, v in good.groupby("g") for f in range(3)}


def test_quantiles_of_all_rows_and_of_none(values):
    df, good = values
    assert Q.quantiles(df.where("g < 4"), [], "x", {"m": 0.9}).first()["m"] == pytest.approx(good.x.quantile(0.9))
    assert Q.quantiles(df.where("false"), ["g"], "x", {"m": 0.9}).count() == 0
    assert Q.quantiles(df.where("g = 9"), [], "x", {"m": 0.9}).first()["m"] is None


@pytest.fixture(scope="module")
def table(spark):
    """Five features with gaps, outliers and a constant; four folds, one of which has the extremes of a feature."""
    rng, n = np.random.default_rng(8), 240
    x = rng.normal(size=(n, 5)) * [1, 1e3, 1, 1e-3, 0] + [0, 5e4, 2, 0, 7]
    x[rng.random((n, 5)) < 0.08] = np.nan
    fold = rng.integers(0, 4, n)
    x[np.flatnonzero(fold == 2)[:2], 2] = [90, -90]
    y = np.clip(0.5 + 0.2 * np.nan_to_num(x[:, 0]) + rng.normal(size=n) * 0.1, 0, 1)
    w = rng.random(n) + 0.5
    rows = [(i, int(f), float(t), float(v), *[None if np.isnan(z) else float(z) for z in r]) for i, (f, t, v, r) in enumerate(zip(fold, y, w, x, strict=True))]
    return spark.createDataFrame(rows, "id int, fold int, y double, w double, a double, b double, c double, d double, e double").repartition(3).cache(), (x, fold, y, w)


def numpy_ridge(x, y, w, alpha, at):
    """Median imputation, range, scale, weighted ridge: what a copy of the training rows gives, applied to rows `at`."""
    med, low, high = np.nanmedian(x, 0), np.nanmin(x, 0), np.nanmax(x, 0)
    fill = lambda v: np.clip(np.where(np.isnan(v), med, v), low, high)
    t = fill(x)
    mean, scale = t.mean(0), t.std(0)
    scale[scale < 1e-9] = 1.0
    z = (t - mean) / scale
    mz, my = np.average(z, axis=0, weights=w), np.average(y, weights=w)
    c = z - mz
    beta = np.linalg.solve(c.T @ (c * w[:, None]) + alpha * np.eye(z.shape[1]), c.T @ (w * (y - my)))
    return np.clip(my - beta @ mz + ((fill(at) - mean) / scale) @ beta, 0, 1)


def test_out_of_fold_equals_fits_on_copies(table):
    df, (x, fold, y, w) = table
    got = {r["id"]: r["prediction"] for r in J.out_of_fold(df, list("abcde"), "y", F.col("w"), "fold", alpha=3.0).collect()}
    assert len(got) == len(y)
    for f in range(4):
        own = np.flatnonzero(fold == f)
        want = numpy_ridge(x[fold != f], y[fold != f], w[fold != f], 3.0, x[own])
        assert [got[i] for i in own] == pytest.approx(want, abs=1e-9)


def test_full_fit_of_groups(table):
    df, (x, fold, y, w) = table
    p, fits = J.full_fit(df, list("abcde"), "y", F.col("w"), alpha=3.0, by=["fold"])
    got = {r["id"]: r["prediction"] for r in p.collect()}
    for f in range(4):
        own = np.flatnonzero(fold == f)
        assert [got[i] for i in own] == pytest.approx(numpy_ridge(x[own], y[own], w[own], 3.0, x[own]), abs=1e-9)
    assert sorted(k[0] for k, _, _ in fits) == [0, 1, 2, 3]


def test_summaries_of_no_rows(table):
    assert J.summaries(table[0].where("false"), ["a", "b"], "y", F.col("w"), ["fold"], held=True) == []


def test_wide_cross_products(spark):
    """230 columns: one short plan, and the same sums as numpy."""
    rng = np.random.default_rng(1)
    x, w, g = rng.normal(size=(300, 230)), rng.random(300), rng.integers(0, 2, 300)
    names = [f"f{i}" for i in range(230)]
    df = spark.createDataFrame([(int(k), float(v), *map(float, r)) for k, v, r in zip(g, w, x, strict=True)], ", ".join(["g int", "w double", *[f"{c} double" for c in names]])).repartition(3)
    got = {r["g"]: np.array(r["s"]).reshape(230, 230) for r in J.cross_products(df, names, F.col("w"), ["g"]).collect()}
    for k in (0, 1):
        assert np.allclose(got[k], x[g == k].T @ (x[g == k] * w[g == k][:, None]))


def test_curve_over_150_features(spark):
    """Every leading part of 150 features from one set of sums; all but the first three are noise."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 150))
    y = np.clip(0.5 + x[:, :3] @ [0.1, 0.1, 0.1] + rng.normal(size=400) * 0.05, 0, 1)
    names = [f"f{i}" for i in range(150)]
    df = spark.createDataFrame([(i, i % 5, float(t), *map(float, r)) for i, (t, r) in enumerate(zip(y, x, strict=True))], ", ".join(["id int", "fold int", "y double", *[f"{c} double" for c in names]]))
    use = {str(k): list(range(k)) for k in range(1, 151)}
    out = J.out_of_fold(df, names, "y", F.lit(1.0), "fold", alpha=1.0, configurations=use)
    r = {int(row["configuration"]): row["r"] for row in out.groupBy("configuration").agg(F.corr("prediction", "y").alias("r")).collect()}
    assert sorted(r) == list(range(1, 151)) and r[1] < r[2] < r[3] and max(r.values()) > 0.9 and r[150] < r[3]
    held = [i for i in range(400) if i % 5 == 1]
    want = numpy_ridge(x[[i for i in range(400) if i % 5 != 1]], y[[i for i in range(400) if i % 5 != 1]], np.ones(320), 1.0, x[held])
    got = {row["id"]: row["prediction"] for row in out.where("configuration = '150' and fold = 1").collect()}
    assert [got[i] for i in held] == pytest.approx(want, abs=1e-8)


# ---- sweeps


def brute(tokens, text, spans):
    """Bits and covered bytes of code-point spans, byte by byte."""
    at = np.cumsum([0, *[len(c.encode()) for c in text]])
    bits, over = np.zeros(at[-1]), np.zeros(at[-1], int)
    for s, e, b in tokens:
        bits[at[s] : at[e]] += b / (at[e] - at[s])
        over[at[s] : at[e]] += 1
    return [(bits[at[s] : at[e]].sum(), int((over[at[s] : at[e]] > 0).sum())) for s, e in spans]


@pytest.fixture(scope="module")
def traces():
    rng, out = np.random.default_rng(6), []
    for d in range(12):
        text = "".join(rng.choice(list("ab é中😀."), rng.integers(5, 90)))
        starts = np.sort(rng.integers(0, len(text), rng.integers(0, 30)))
        tokens = [(int(s), int(min(len(text), s + 1 + rng.integers(0, 4))), float(rng.random() * 5)) for s in starts]
        spans = {(int(r), int(s), int(min(len(text), s + 1 + rng.integers(0, 9)))) for r, s in zip(rng.integers(0, 3, 14), rng.integers(0, len(text), 14), strict=True)}
        out.append((d, text, tokens, sorted(spans)))
    return out


def test_role_losses_in_the_row(spark, traces):
    rows = [(d, t, [x[0] for x in k], [x[1] for x in k], [x[2] for x in k], [x[0] for x in s], [x[1] for x in s], [x[2] for x in s]) for d, t, k, s in traces]
    rows += [(50, None, None, None, None, None, None, None), (51, "", [], [], [], [0], [0], [0]), (52, "ab", [0], [2], [3.0], [1, 1], [0, 1], [9, 2])]
    kinds = "doc_id int, text string, starts array<long>, ends array<long>, bits array<double>, span_role array<long>, span_start array<long>, span_end array<long>"
    got = {(r["doc_id"], r["role"]): r for r in sweeps.role_losses(spark.createDataFrame(rows, kinds).repartition(2), ["p", "q", "r"]).collect()}
    for d, text, tokens, spans in traces:
        for role in range(3):
            own = [x[1:] for x in spans if x[0] == role]
            if not own:
                assert (d, "pqr"[role]) not in got
                continue
            r, inside = got[d, "pqr"[role]], np.zeros(len(text), bool)
            for s, e in own:
                inside[s:e] = True
            edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(int), [0]])))
            parts = brute(tokens, text, list(zip(edges[::2], edges[1::2], strict=True)))
            each = sorted((b / n for b, n in brute(tokens, text, own) if n), reverse=True)
            assert (r["occurrences"], r["scored"], r["bytes"]) == (len(own), len(each), sum(n for _, n in parts))
            assert r["bits"] == pytest.approx(sum(b for b, _ in parts))
            if each:
                top = each[: max(1, -(-len(each) // 10))]
                assert (r["mean"], r["tail"], r["std"]) == pytest.approx((r["bits"] / r["bytes"], np.mean(top), np.std(each)))
            else:
                assert r["mean"] is r["tail"] is r["std"] is None
    assert (got[51, "p"]["occurrences"], got[51, "p"]["scored"], got[51, "p"]["mean"]) == (1, 0, None)
    assert (got[52, "q"]["bits"], got[52, "q"]["bytes"], got[52, "q"]["scored"]) == (3.0, 2, 2) and not any(k[0] == 50 for k in got)


def test_relational_sweep_equals_the_rows(spark, traces):
    tokens = [(d, i, s, e, b, t[s:e]) for d, t, k, _ in traces for i, (s, e, b) in enumerate(k)]
    spans = [(d, str(r), s, e) for d, _, _, own in traces for r, s, e in own]
    t = spark.createDataFrame(tokens, "doc_id int, i int, start int, end int, bits double, text string")
    s = spark.createDataFrame(spans, "doc_id int, role string, start int, end int")
    want = {(d, str(r), a, b): n[0] / n[1] for d, text, k, own in traces for (r, a, b), n in zip(own, brute(k, text, [x[1:] for x in own]), strict=True) if n[1]}
    got = {(r["doc_id"], r["role"], r["start"], r["end"]): r["bpb"] for r in H.occurrence_loss(t, s, ["role"]).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    cut = H.occurrence_loss(H.allocation(t), s, ["role"])
    assert {(r["doc_id"], r["role"], r["start"], r["end"]): r["bpb"] for r in cut.collect()} == {k: pytest.approx(v) for k, v in want.items()}


def test_losses_in_the_row_equal_the_relations(spark, traces):
    """Every measure whose arrays are made slice by slice, against the same measure by joins; gaps, overlaps, wide characters."""
    rows = [(d, t, list(range(len(k))), *zip(*k)) if k else (d, t, [], [], [], []) for d, t, k, _ in traces]
    rows = [(d, t, i, list(s), list(e), list(b), [x + n % 3 for n, x in enumerate(b)], [x[0] for x in own], [x[1] for x in own], [x[2] for x in own], [x[0] for x in own]) for (d, t, i, s, e, b), (*_, own) in zip(rows, traces, strict=True)]
    kinds = "doc_id int, text string, index array<long>, starts array<long>, ends array<long>, bits array<double>, after array<double>, span_role array<long>, span_start array<long>, span_end array<long>, span_binding array<long>"
    docs = spark.createDataFrame([*rows, (60, None, *[None] * 9), (61, "", *[[]] * 9)], kinds).repartition(2)
    tokens = [(d, i, s, e, b, b + i % 3, t[s:e]) for d, t, k, _ in traces for i, (s, e, b) in enumerate(k)]
    t = spark.createDataFrame(tokens, "doc_id int, i int, start int, end int, bits double, after double, text string")
    s = spark.createDataFrame([(d, "pqr"[r], str(r), a, b) for d, _, _, own in traces for r, a, b in own], "doc_id int, role string, binding string, start int, end int")
    plain = lambda df, cols: sorted(tuple(None if r[c] is None else r[c] if isinstance(r[c], str) else round(float(r[c]), 9) + 0.0 for c in cols) for r in df.collect())
    after = t.withColumn("bits", F.col("after"))

    a = H.allocation(t).groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("covered_chars"), F.sum("bytes").alias("covered_bytes"), F.round(F.sum("bits"), 9).alias("bits"), F.sum(F.when(F.col("k") > 1, F.col("end") - F.col("start")).otherwise(0)).alias("shared_chars"))
    cols = ["doc_id", "covered_chars", "covered_bytes", "bits", "shared_chars"]
    got = sweeps.allocations(docs)
    assert plain(got, cols) == plain(a, cols)
    gain = got.withColumn("gain", F.col("saved") / F.col("covered_bytes")).withColumnRenamed("covered_bytes", "bytes")
    assert plain(gain, ["doc_id", "gain", "tokens", "bytes"]) == plain(H.comment_gain(t.drop("after"), after.drop("after")), ["doc_id", "gain", "tokens", "bytes"])
    cols = ["doc_id", "first", "later", "later_tail", "increase", "within_std"]
    assert plain(sweeps.reuse_losses(docs), cols) == plain(H.reuse_difficulty(t, s), cols)
    cols = ["doc_id", "role", "gain", "q10", "scored", "eligible", "skipped"]
    assert str(plain(sweeps.context_losses(docs, ["p", "q", "r"], size=2), cols)) == str(plain(H.context_difficulty(after, t, s, size=2), cols))


def test_slices_hold_no_more_text_than_they_may(spark):
    """The arrays of a batch of many documents are made a slice at a time."""
    def build(batch):
        import pyarrow as pa
        import pyarrow.compute as pc

        assert pc.sum(pc.binary_length(batch.column("text"))).as_py() <= 2 * sweeps.TOGETHER
        n = len(batch)
        one = lambda v, k: pa.array([[v]] * n, pa.list_(k))
        return pa.RecordBatch.from_arrays([*batch.columns, one(0, pa.int64()), one(3, pa.int64()), one(6.0, pa.float64()), one(7.0, pa.float64())], names=["doc_id", "text", "starts", "ends", "bits", "after"])

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1000).alias("text")).coalesce(1)
    got = sweeps.allocations(docs, build=build).agg(F.count("*"), F.sum("covered_bytes"), F.sum("saved")).first()
    assert tuple(got) == (3000, 9000, 3000.0)


def test_onsets_of_spans(spark):
    d = spark.createDataFrame([(1, "abcdé", [0, 1, 3], [1, 3, 5], [1.0, 4.0, 6.0], [0, 2, 4], [3, 5, 4]), (2, "", [], [], [], [], [])], "doc_id int, text string, starts array<long>, ends array<long>, bits array<double>, span_start array<long>, span_end array<long>")
    r = sweeps.onset_losses(d).collect()
    # the first span meets a and bc, the second bc and dé; the third is empty
    assert [(x["doc_id"], x["onset"], x["continuation"]) for x in r] == [(1, pytest.approx(5 / 3), pytest.approx(10 / 5))]


def test_overlaps_are_no_more_than_they_are(spark, traces):
    tokens = [(d, i, s, e) for d, _, k, _ in traces for i, (s, e, _) in enumerate(k)] + [(99, 0, 0, 100), (99, 1, 5, 6), (99, 2, 50, 51)]
    spans = [(d, r, s, e) for d, _, _, own in traces for r, s, e in own] + [(99, 0, 20, 30), (99, 0, 20, 30), (99, 1, 4, 60)]
    got = H.overlap(spark.createDataFrame(tokens, "doc_id int, i int, start int, end int"), spark.createDataFrame(spans, "doc_id int, role int, start int, end int"))
    want = sorted((d, i, r, a, b) for d, i, s, e in tokens for d2, r, a, b in spans if d == d2 and s < b and e > a)
    assert sorted((r["doc_id"], r["i"], r["role"], r["s_start"], r["s_end"]) for r in got.collect()) == want


def test_anchor_thresholds_equal_fits_on_the_others(spark):
    from lectern.operators.vectors import anchor_calibration

    rng = np.random.default_rng(2)
    a, s = rng.integers(0, 3, 200), np.round(rng.random(200), 2)
    y = s + rng.normal(size=200) * 0.3 > 0.5
    got = {r["a"]: (r["threshold"], r["accuracy"]) for r in anchor_calibration(spark.createDataFrame([(int(i), float(v), bool(t)) for i, v, t in zip(a, s, y, strict=True)], "a int, s double, y boolean"), "y", "s", "a").collect()}
    for h in range(3):
        v, t = s[a != h], y[a != h]
        cuts = np.unique(v)[::-1]
        acc = [round((np.mean(v[t] >= c) + np.mean(v[~t] < c)) / 2, 9) for c in cuts]
        mid = [(c + n) / 2 if n is not None else c for c, n in zip(cuts, [*cuts[1:], None], strict=True)]
        assert got[h] == (pytest.approx(np.median([m for m, x in zip(mid, acc, strict=True) if x == max(acc)])), max(acc))


def test_weights_of_groups_balance(spark):
    d = spark.createDataFrame([(1,), (1,), (1,), (2,)], "g int")
    assert sorted(r["weight"] for r in balanced_weight(d, ["g"]).collect()) == pytest.approx([2 / 3] * 3 + [2.0])


def test_steps_under_one_bound_end_where_newton_steps_do(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 5))
    y = (x[:, 0] - 0.7 * x[:, 1] + rng.normal(size=300) > 0).astype(float)
    df = spark.createDataFrame([(i, float(t), *map(float, r)) for i, (t, r) in enumerate(zip(y, x, strict=True))], "id int, y double, a double, b double, c double, d double, e double").cache()
    one = {r["feature"]: r for r in J.stability(df, list("abcde"), "y", "id", rounds=12, c=0.05).collect()}
    monkeypatch.setattr(J, "NEWTON", 0)
    two = {r["feature"]: r for r in J.stability(df, list("abcde"), "y", "id", rounds=12, c=0.05).collect()}
    for f in "abcde":
        assert two[f]["coefficient"] == pytest.approx(one[f]["coefficient"], abs=1e-3) and two[f]["frequency"] == one[f]["frequency"]
    assert one["a"]["frequency"] == one["b"]["frequency"] == 1.0


def test_correlation_filter_by_either_correlation(spark):
    """b follows a by ranks alone, c by value alone but for one outlier; d is constant, e has gaps."""
    rng = np.random.default_rng(3)
    a = rng.normal(size=200)
    cols = {"a": a, "b": np.exp(3 * a), "c": rng.normal(size=200), "d": np.full(200, 3.0), "e": rng.normal(size=200)}
    rows = [(i, i % 2, *[float(v[i]) if not (k == "e" and i % 9 == 0) else None for k, v in cols.items()]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id int, g int, a double, b double, c double, d double, e double")
    assert J.correlation_filter(df, list("abcde")) == ["a", "c", "e"]
    assert J.joint_filter(df, "g", list("dbace")) == ["b", "c", "e"]
    one = J.correlations(df, ["a", "b", "c"])[0]
    assert one["a", "b"] == pytest.approx(abs(np.corrcoef(cols["a"], cols["b"])[0, 1])) and one["c", "c"] == pytest.approx(1.0)


def test_forward_selection_of_all_candidates(spark):
    """Two features tell the label, four are noise; a seventh has too many gaps. The first step equals fits one by one."""
    rng = np.random.default_rng(21)
    x = rng.normal(size=(240, 7))
    y = (1.5 * x[:, 2] - x[:, 4] + 0.3 * rng.normal(size=240) > 0).astype(float)
    x[::2, 6] = np.nan
    names = list("abcdefg")
    rows = [(i, i % 4, float(t), *[None if np.isnan(v) else float(v) for v in r]) for i, (t, r) in enumerate(zip(y, x, strict=True))]
    df = spark.createDataFrame(rows, ", ".join(["id int", "fold int", "y double", *[f"{c} double" for c in names]])).cache()
    found = J.forward_selection(df, names, "y", "id", "fold", 4, 7)
    assert [f for f, _ in found[:2]] == ["c", "e"] and "g" not in dict(found)
    assert all(a < b for (_, a), (_, b) in zip(found, found[1:], strict=False)) and found[1][1] > 0.9
    alone = {f: J.forward_selection(df, [f], "y", "id", "fold", 4, 1)[0][1] for f in ("c", "a")}
    assert alone["c"] == pytest.approx(found[0][1]) and alone["a"] < alone["c"]


def test_runs_of_columns_in_slices(spark, monkeypatch):
    from lectern.operators import features

    monkeypatch.setattr(features, "TOGETHER", 8)
    rows = [(1, "ab\nab\nab"), (2, ""), (3, "a\nb\nb\n\nb\nb"), (4, "aé\nxé"), (5, "a")]
    got = features.aligned_runs(spark.createDataFrame(rows, "doc_id int, content string").coalesce(1)).collect()
    assert sorted(map(tuple, got)) == [(1, 2), (3, 2), (4, 1), (5, 0)]


def test_pieces_of_comments(spark):
    from lectern.operators import text as X

    d = spark.createDataFrame([("a/*é*/b//c\n/**d*/'/*'",)], "t string").select(*X.comment_pieces(F.col("t"))).first()
    assert (list(d["sizes"]), list(d["forms"])) == ([1, 5, 1, 3, 1, 6, 4], [-1, 2, -1, 0, -1, 1, -1])


def test_character_matrix_cells(spark):
    from lectern.operators import text as X

    texts = ["", "a😀é\n\nxyz123\nq", "\n".join("abcdef"), None]
    for t, m in spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.character_matrix(F.col("t"), 3, 4)).collect():
        lines = (t or "").split("\n")
        want = [min(ord(lines[r][k]) / 256, 1.0) if r < len(lines) and k < len(lines[r]) else -1.0 for r in range(3) for k in range(4)]
        assert m == want
    plan = spark.range(1).select(X.character_matrix(F.lit("a").substr(F.lit(1), F.col("id").cast("int")), 20, 40).alias("m"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(substr") == 1


def test_rows_stay_where_they_lie_for_few_ranges(spark, monkeypatch):
    """Three groups' rows must not be dealt out by their three keys."""
    from lectern.operators import quantiles as Q

    plans, real = [], Q.checkpointed
    monkeypatch.setattr(Q, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    d = spark.range(9000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 9001).cast("double").alias("x"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["g"]: r["m"] for r in Q.quantiles(d, ["g"], "x", {"m": 0.5}).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    x = np.arange(9000) * 7919 % 9001
    assert got == {g: float(np.median(x[g::3])) for g in range(3)}
    bins = [p for p in plans if "HashAggregate" in p.splitlines()[1] and "_cell" in p.splitlines()[1]]
    assert bins and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in bins)


def test_preprocessing_without_joining_rows(spark):
    from lectern.operators import models as J

    x = [1.0, 2.0, None, 10.0, float("nan"), 4.0, float("inf")]
    r = J.preprocess(spark.createDataFrame([(v, 5.0) for v in x], "a double, b double"), ["a", "b"]).collect()
    a, b = sorted(r, key=lambda r: r["feature"])
    full = [1.0, 2.0, 3.0, 10.0, 3.0, 4.0, 3.0]
    assert (a["median"], a["low"], a["high"]) == (3.0, 1.0, 10.0)
    assert (a["mean"], a["scale"]) == (pytest.approx(np.mean(full)), pytest.approx(np.std(full)))
    assert (b["mean"], b["scale"]) == (5.0, 1.0)
