"""Linear models from one pass of sums: preprocessing, weighted ridge, cross-validation, selection, bootstrap."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.quantiles import quantiles
from lectern.operators.statistics import _same, average_rank
from lectern.sources.tables import checkpointed


def _finite(c: str | Column) -> Column:
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _long(df: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), _finite(f).alias("x")) for f in features])).alias("s")).select(*keys, "s.*")


def preprocess(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, median, low, high, mean, scale): what imputes, clips and standardises each feature of a group.

    Values that are null, NaN or infinite are missing: the exact median stands in for them. Mean and deviation follow from
    those of the values that are there and the number of the others, so rows never meet the medians.
    """
    key = [*by, "feature"]
    long = _long(df, features, by)
    own = long.groupBy(*key).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"), (F.count("x") / F.count("*")).alias("_there"))
    g = _same(key, quantiles(long, key, "x", {"median": 0.5}), own)
    there, off = F.col("_there"), F.col("median") - F.col("_m")
    g = g.withColumn("mean", F.col("_m") + (1 - there) * off).withColumn("scale", F.when(there < 1, F.sqrt(there * F.col("_s") ** 2 + there * (1 - there) * off**2)).otherwise(F.col("_s")))
    return g.select(*key, "median", "low", "high", "mean", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0).alias("scale"))


def standardised(df: DataFrame, features: Sequence[str], stats: dict[str, tuple]) -> list[Column]:
    """Each feature imputed, clipped to its range and standardised, by (median, low, high, mean, scale) of it."""
    out = []
    for f in features:
        median, low, high, mean, scale = stats[f]
        x = F.least(F.greatest(F.coalesce(_finite(f), F.lit(median)), F.lit(low)), F.lit(high))
        out.append(((x - mean) / scale).alias(f))
    return out


#: Partial sums that one task adds up at most before they are added up again.
FAN_IN = 32


def cross_products(df: DataFrame, columns: Sequence[str], weight: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, s): the weighted sums of products of every two of the columns, row by row of the symmetric matrix.

    A task multiplies its rows as matrices, a batch at a time, and emits one matrix for each group; those are added up as a
    tree, FAN_IN at a time. So a plan for 228 columns is as short as for two, and only matrices are shuffled. Columns
    must not be null; `by` names groups of which there are few, such as datasets or folds.
    """
    k = len(columns)
    rows = df.select(*by, weight.cast("double").alias("_weight"), F.array(*[F.col(c).cast("double") for c in columns]).alias("_v"))
    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in by], "_part long, s array<double>"])

    def multiply(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, sums, keys = TaskContext.get().partitionId(), {}, {}
        for batch in batches:
            v = batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            w = batch.column("_weight").to_numpy(zero_copy_only=False)
            own = list(zip(*[batch.column(c).to_pylist() for c in by], strict=True)) if by else [()] * len(w)
            code = {key: i for i, key in enumerate(dict.fromkeys(own))}
            at = np.fromiter((code[key] for key in own), np.int64, len(own))
            for key, i in code.items():
                x = v[at == i]
                sums[key] = sums.get(key, 0) + x.T @ (x * w[at == i][:, None])
                keys[key] = key
        names = [f.name for f in arrow]
        for key, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([x], arrow.field(n).type) for n, x in zip(names, [*key, part, m.ravel().tolist()], strict=True)], names=names)

    def add(key, table):
        import pyarrow as pa

        total = table.column("s").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k * k).sum(axis=0)
        first = table.slice(0, 1)
        return pa.table([*[first.column(c).cast(arrow.field(c).type) for c in by], pa.array([0], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=[f.name for f in arrow])

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(rows.select(*by, F.lit(0).cast("long").alias("_part"), F.col("_v").alias("s")).schema)
    parts = rows.mapInArrow(multiply, fields)
    halfway = parts.groupBy(*by, F.floor(F.col("_part") / FAN_IN).alias("_bundle")).applyInArrow(add, fields)
    return halfway.withColumn("_whole", F.lit(0)).groupBy(*(by or ["_whole"])).applyInArrow(add, fields).drop("_part")


def gram(df: DataFrame, x: Sequence[str], y: str, w: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, w, wx, wxx, wy, wxy): weighted sums from which any sub-model of x solves; p(p+3)/2 + 2 numbers a group."""
    p, k = len(x), len(x) + 2
    m = cross_products(df.withColumn("_one", F.lit(1.0)), ["_one", *x, y], w, by)
    row = lambda i, a, n: F.slice("s", i * k + a + 1, n)
    upper = F.flatten(F.array(*[row(i, i, p - i + 1) for i in range(1, p + 1)]))
    return m.select(*by, F.get("s", F.lit(0)).alias("w"), row(0, 1, p).alias("wx"), upper.alias("wxx"), F.get("s", F.lit(p + 1)).alias("wy"), row(p + 1, 1, p).alias("wxy"), F.lit(p).alias("p"))


def solve(row, alpha: float, use: Sequence[int] | None = None) -> tuple[np.ndarray, float]:
    """Ridge coefficients and the unpenalised intercept from one row of gram(), for the features `use`."""
    p = row["p"]
    a = np.zeros((p, p))
    a[np.triu_indices(p)] = row["wxx"]
    a = a + np.triu(a, 1).T
    mx, my = np.array(row["wx"]) / row["w"], row["wy"] / row["w"]
    a -= row["w"] * np.outer(mx, mx)
    b = np.array(row["wxy"]) - row["w"] * mx * my
    own = list(range(p)) if use is None else list(use)
    beta = np.zeros(p)
    beta[own] = np.linalg.solve(a[np.ix_(own, own)] + alpha * np.eye(len(own)), b[own])
    return beta, float(my - beta @ mx)


def predict(df: DataFrame, features: Sequence[str], stats: dict[str, tuple], beta: Sequence[float], intercept: float) -> Column:
    """Scores within 0 and 1 by a frozen model: a constant expression of the plan."""
    total = F.lit(float(intercept))
    for c, b in zip(standardised(df, features, stats), beta, strict=True):
        total = total + c * float(b)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def _stats(df: DataFrame, features: Sequence[str]) -> dict[str, tuple]:
    return {r["feature"]: (r["median"], r["low"], r["high"], r["mean"], r["scale"]) for r in preprocess(df, features).collect()}


def summaries(df: DataFrame, features: Sequence[str], target: str, weight: Column, by: Sequence[str] = (), held: bool = False) -> list[dict]:
    """For each group of `by`, or with `held` for each group the rows of all others: what preprocesses these rows (`stats`,
    by feature: median, low, high, mean, scale) and the weighted sums of the standardised features (as a row of gram()).

    Everything comes from summaries of the groups that add up: counts, sums, least and greatest values, and products of the
    features, which are centred, with zero and a mark where a value is missing. What a group's absence leaves is the total
    less its own share, so no row is copied; medians without a group come from quantiles(). The driver gets a matrix and a
    few numbers a feature for each group, never rows.
    """
    p, key = len(features), ["feature", *by]
    df = checkpointed(df.select(*by, F.col(target).cast("double").alias("_y"), weight.cast("double").alias("_w"), *[_finite(f).alias(f) for f in features]))
    long = _long(df, features, by)
    centre = {r["feature"]: r["c"] or 0.0 for r in long.groupBy("feature").agg(F.avg("x").alias("c")).collect()}
    c = F.element_at(F.create_map(*[y for f in features for y in (F.lit(f), F.lit(centre.get(f, 0.0)))]), F.col("feature"))
    each = long.withColumn("d", F.col("x") - c).groupBy(*key).agg(F.count("*").alias("rows"), F.count("x").alias("n"), F.sum("d").alias("s1"), F.sum(F.col("d") * F.col("d")).alias("s2"), F.min("x").alias("low"), F.max("x").alias("high"))
    medians = quantiles(long, ["feature"], "x", {"median": 0.5}, without=by[0]) if held else quantiles(long, key, "x", {"median": 0.5})
    median = {(tuple(r[b] for b in by), r["feature"]): r["median"] for r in medians.collect()}
    told = {}
    for r in each.collect():
        told.setdefault(tuple(r[b] for b in by), {})[r["feature"]] = (r["rows"], r["n"], r["s1"] or 0.0, r["s2"] or 0.0, r["low"], r["high"])
    if not told:
        return []
    gaps = [f for f in features if any(t[f][0] > t[f][1] for t in told.values())]
    columns = ["_one", *features, *[f"_gap{i}" for i in range(len(gaps))], "_y"]
    wide = df.select(*by, "_w", "_y", F.lit(1.0).alias("_one"), *[F.coalesce(F.col(f) - F.lit(centre[f]), F.lit(0.0)).alias(f) for f in features], *[F.col(f).isNull().cast("double").alias(f"_gap{i}") for i, f in enumerate(gaps)])
    k = len(columns)
    matrix = {tuple(r[b] for b in by): np.array(r["s"]).reshape(k, k) for r in cross_products(wide, columns, F.col("_w"), by).collect()}
    whole = sum(matrix.values())
    ends = {f: (sorted((t[f][4], g) for g, t in told.items() if t[f][4] is not None), sorted(((t[f][5], g) for g, t in told.items() if t[f][5] is not None), reverse=True)) for f in features} if held else {}

    out = []
    for g, own in told.items():
        stats, turn = {}, np.zeros((p + 2, k))
        turn[0, 0] = turn[p + 1, k - 1] = 1.0
        for i, f in enumerate(features):
            rows, n, s1, s2, low, high = own[f]
            if held:  # all less own; of least and greatest values the first of another group
                rows, n, s1, s2 = (sum(t[f][x] for t in told.values()) - own[f][x] for x in range(4))
                low, high = (next((v for v, of in side[:2] if of != g), None) for side in ends[f])
            m = median.get((g, f))
            shift = 0.0 if m is None else m - centre[f]
            mean, square = ((s1 + (rows - n) * shift) / rows, (s2 + (rows - n) * shift**2) / rows) if rows else (0.0, 0.0)
            var = square - mean**2
            scale = float(np.sqrt(var)) if var > 1e-14 * max(square, 1e-300) else 1.0
            at = [centre[f] if x is None else x for x in (m, low, high)]
            stats[f] = (*map(float, at), float(mean + centre[f]), scale)
            turn[i + 1, 0], turn[i + 1, i + 1] = -mean / scale, 1 / scale
            if f in gaps:
                turn[i + 1, 1 + p + gaps.index(f)] = shift / scale
        e = turn @ (whole - matrix[g] if held else matrix[g]) @ turn.T
        out.append({"key": g, "stats": stats, "p": p, "w": e[0, 0], "wx": e[0, 1 : p + 1], "wxx": e[1 : p + 1, 1 : p + 1][np.triu_indices(p)], "wy": e[0, p + 1], "wxy": e[1 : p + 1, p + 1]})
    return out


def _applied(df: DataFrame, features: Sequence[str], bounded: bool) -> DataFrame:
    """df with `prediction` from its row's arrays s (what preprocesses each feature), beta, and b0."""
    values = F.array(*[_finite(f) for f in features])
    z = F.zip_with(values, "s", lambda x, s: (F.least(F.greatest(F.coalesce(x, s["median"]), s["low"]), s["high"]) - s["mean"]) / s["scale"])
    total = F.col("b0") + F.aggregate(F.zip_with(z, "beta", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("prediction", F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)) if bounded else total).drop("s", "beta", "b0")


_MODEL = "s array<struct<median: double, low: double, high: double, mean: double, scale: double>>, beta array<double>, b0 double"


def out_of_fold(df: DataFrame, features: Sequence[str], target: str, weight: Column, fold: str, alpha: float = 200.0, configurations: dict[str, Sequence[int]] | None = None, bounded: bool = True) -> DataFrame:
    """df with `prediction`: each row's by the ridge fitted without its fold, cut to 0 and 1 if bounded.

    folds are the values of the column, numbers of folds or held-out datasets alike. With configurations (name to places
    of the features used), a row for each of them, named in `configuration`: all are sub-models of the same sums, and a
    task predicts its rows for all of them by one matrix product.
    """
    use = configurations or {"": range(len(features))}
    found = summaries(df, features, target, weight, [fold], held=True)
    if not configurations:
        fits = []
        for r in found:
            beta, b0 = solve(r, alpha)
            fits.append((*r["key"], [r["stats"][f] for f in features], [float(b) for b in beta], float(b0)))
        kind = df.schema[fold].dataType.simpleString()
        models = df.sparkSession.createDataFrame(fits, f"_held {kind}, {_MODEL}")
        return _applied(df.join(models, F.col(fold).eqNullSafe(F.col("_held"))), features, bounded).drop("_held")
    models = {}
    for r in found:
        each = [solve(r, alpha, own) for own in use.values()]
        models[r["key"][0]] = (np.array([r["stats"][f] for f in features]), np.array([beta for beta, _ in each]), np.array([b0 for _, b0 in each]))

    kept = list(df.columns)

    def predict_all(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(features))
            keys = batch.column(fold).to_pylist()
            out = np.empty((len(x), len(use)))
            for key in set(keys):
                at = np.flatnonzero([k == key for k in keys])
                (median, low, high, mean, scale), beta, b0 = models[key][0].T, *models[key][1:]
                v = x[at]
                z = (np.clip(np.where(np.isnan(v), median, v), low, high) - mean) / scale
                out[at] = z @ beta.T + b0
            out = np.clip(out, 0.0, 1.0) if bounded else out
            told = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(use), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], told], names=[*kept, "_p"])

    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], "_p array<double>"])
    nan = float("nan")
    p = df.withColumn("_x", F.array(*[F.coalesce(_finite(f), F.lit(nan)) for f in features])).mapInArrow(predict_all, fields)
    names = F.array(*map(F.lit, use))
    p = p.select(*df.columns, F.posexplode("_p").alias("_i", "prediction"))
    return p.withColumn("configuration", F.get(names, F.col("_i"))).drop("_i")


def full_fit(df: DataFrame, features: Sequence[str], target: str, weight: Column, alpha: float = 200.0, by: Sequence[str] = (), bounded: bool = True) -> tuple[DataFrame, list[tuple]]:
    """df with in-sample predictions of one ridge for each group of `by`, and (group, beta, intercept) of each."""
    found = summaries(df, features, target, weight, list(by))
    fits = [(list(r["key"]), *solve(r, alpha)) for r in found]
    fields = "".join(f"_k{i} {df.schema[c].dataType.simpleString()}, " for i, c in enumerate(by))
    rows = [(*r["key"], [r["stats"][f] for f in features], [float(x) for x in beta], float(b0)) for r, (_, beta, b0) in zip(found, fits, strict=True)]
    models = df.sparkSession.createDataFrame(rows, f"{fields}{_MODEL}")
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return _applied(df.join(models, on), features, bounded).drop(*[f"_k{i}" for i in range(len(by))]), fits


def contributions(df: DataFrame, key: str, features: Sequence[str], stats: dict[str, tuple], beta: Sequence[float]) -> DataFrame:
    """(key, feature, value, z, contribution, imputed, clipped): a score taken apart."""
    rows = []
    for f, b, z in zip(features, beta, standardised(df, features, stats), strict=True):
        _, low, high, _, _ = stats[f]
        x = _finite(f)
        rows.append(F.struct(F.lit(f).alias("feature"), x.alias("value"), z.alias("z"), (z * float(b)).alias("contribution"), x.isNull().alias("imputed"), F.coalesce((x < low) | (x > high), F.lit(False)).alias("clipped")))
    return df.select(key, F.explode(F.array(*rows)).alias("s")).select(key, "s.*")


#: Parts that the rounds of a bootstrap are dealt out in.
BUNDLES = 20


def bootstrap(df: DataFrame, by: str, order: str, x: str, y: str, rounds: int = 10_000, seed: int = 20260923) -> DataFrame:
    """(by, low, high, valid): a percentile interval of the rank correlation over resampled rows of each group; no interval
    where fewer than 95 % of the rounds have a correlation.

    How often a round draws a row is a Poisson number of the hash of (seed, round, row), which stands in for drawing with
    replacement and needs no places; rounds are worked on in bundles, one task for each of a group's. The draws of equal
    pairs of x and y add up first, so a round's ranks are sums over the distinct pairs of its group.
    """
    bundle = max(1, -(-rounds // BUNDLES))
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.xxhash64(F.lit(seed), by, order).alias("_h"))
    # a bundle of a group is much work on few bytes: their number of tasks is told, as sizes would join them into one
    each = pairs.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit((rounds - 1) // bundle)))).repartition(10 * BUNDLES, by, "_b")
    fields = f"{by} {df.schema[by].dataType.simpleString()}"

    def correlated(key, pdf):
        import pandas as pd

        xs, ix = np.unique(pdf["_x"].to_numpy(), return_inverse=True)
        ys, iy = np.unique(pdf["_y"].to_numpy(), return_inverse=True)
        pair = ix * len(ys) + iy
        rows = np.argsort(pair, kind="stable")
        own, first = np.unique(pair[rows], return_index=True)
        ix, iy, hashes = own // len(ys), own % len(ys), pdf["_h"].to_numpy(np.int64).view(np.uint64)[rows]

        def ranks(n, at, size):
            c = np.bincount(at, n, size)
            return (np.cumsum(c) - c + (c + 1) / 2)[at]

        mine = range(int(key[1]) * bundle, min(rounds, (int(key[1]) + 1) * bundle))
        r = np.full(len(mine), np.nan)
        for k, i in enumerate(mine):  # a round at a time: memory is some numbers a row, whatever the number of rounds
            n = np.add.reduceat(_drawn(hashes, i), first).astype(float)
            a, b, total = ranks(n, ix, len(xs)), ranks(n, iy, len(ys)), n.sum()
            if total >= 2:
                da, db = a - n @ a / total, b - n @ b / total
                na = n * da
                spread = np.sqrt((na @ da) * (n @ (db * db)))
                r[k] = na @ db / spread if spread > 0 else np.nan
        return pd.DataFrame({by: [key[0]] * len(mine), "r": r})

    s = each.groupBy(by, "_b").applyInPandas(correlated, f"{fields}, r double").where(F.col("r").isNotNull() & ~F.isnan("r"))
    g = s.groupBy(by).agg(F.percentile("r", F.lit(0.025)).alias("low"), F.percentile("r", F.lit(0.975)).alias("high"), F.count("r").alias("valid"))
    good = F.col("valid") >= 0.95 * rounds
    return g.select(by, F.when(good, F.col("low")).alias("low"), F.when(good, F.col("high")).alias("high"), "valid")


#: Cumulated probabilities of a Poisson number with mean 1.
_POISSON = np.cumsum(np.exp(-1) / np.cumprod(np.concatenate([[1.0], np.arange(1, 16)])))
#: The same number by the first 16 bits of a uniform one; -1 where the other bits decide.
_SHORT = np.searchsorted(_POISSON, np.arange(1 << 16) / (1 << 16), side="right").astype(np.int16)
_SHORT[np.searchsorted(_POISSON, (np.arange(1 << 16) + 1) / (1 << 16), side="right") != _SHORT] = -1


def _drawn(hashes: np.ndarray, round_: int) -> np.ndarray:
    """How often a round draws each row: Poisson numbers of the hash of row and round."""
    with np.errstate(over="ignore"):
        key = hashes + np.uint64(round_) * np.uint64(0x9E3779B97F4A7C15)
        key = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        key = (key ^ (key >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    key ^= key >> np.uint64(31)
    n = _SHORT[key >> np.uint64(48)]
    open_ = np.flatnonzero(n < 0)
    n[open_] = np.searchsorted(_POISSON, (key[open_] >> np.uint64(11)).astype(float) / 2**53, side="right")
    return n


def _correlation(m: np.ndarray) -> np.ndarray:
    """|Pearson| of every two columns from the sums of products of a one and the columns; constants have 0 with all."""
    n, sums = max(m[0, 0], 1.0), m[0, 1:]
    c = m[1:, 1:] / n - np.outer(sums / n, sums / n)
    size = np.sqrt(np.maximum(np.diag(c), 0.0))
    size[size < 1e-12 * np.maximum(1.0, np.abs(sums / n))] = 0.0
    d = np.outer(size, size)
    return np.where(d > 0, np.abs(c) / np.where(d > 0, d, 1.0), 0.0)


def correlations(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> list[dict[tuple[str, str], float]]:
    """|Pearson| of every two features in each group, from one pass of matrix sums over values less their means; missing
    values count as the mean, and a constant feature has 0 with all, itself too."""
    centre = df.agg(*[F.avg(_finite(f)).alias(f"c{i}") for i, f in enumerate(features)]).first()
    moved = df.select(*by, F.lit(1.0).alias("_one"), *[F.coalesce(_finite(f) - F.lit(centre[f"c{i}"] or 0.0), F.lit(0.0)).alias(f) for i, f in enumerate(features)])
    out = []
    for r in cross_products(moved, ["_one", *features], F.lit(1.0), by).collect():
        c = _correlation(np.array(r["s"]).reshape(len(features) + 1, -1))
        out.append({(a, b): float(c[i, j]) for i, a in enumerate(features) for j, b in enumerate(features)})
    return out


def ranked_columns(df: DataFrame, key: str, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, key, features): every feature's average ranks in its group, all features in one pass over long rows; missing
    values stay missing."""
    long = df.select(*by, key, F.posexplode(F.array(*[_finite(f) for f in features])).alias("_i", "_v"))
    ranks = average_rank(long.where("_v is not null"), [*by, "_i"], "_v", "_r")
    wide = ranks.groupBy(*by, key).agg(F.map_from_entries(F.collect_list(F.struct("_i", "_r"))).alias("_m"))
    return wide.select(*by, key, *[F.try_element_at("_m", F.lit(i)).alias(f) for i, f in enumerate(features)])


def greedy_filter(ranked: Sequence[str], corr: dict[tuple[str, str], float], most: float = 0.9) -> list[str]:
    """Features in their order, each kept unless its correlation with a kept one exceeds `most`; constants go."""
    kept: list[str] = []
    for a in ranked:
        if corr[a, a] > 0 and all(corr[a, b] <= most for b in kept):
            kept.append(a)
    return kept


def correlation_filter(df: DataFrame, ranked: Sequence[str], most: float = 0.9, key: str = "doc_id") -> list[str]:
    """The greedy filter by the greater of |Pearson| and |Spearman|; the walk over the p x p numbers is the driver's."""
    return joint_filter(df, None, ranked, most, key)


def joint_filter(df: DataFrame, by: str | None, ranked: Sequence[str], most: float = 0.9, key: str = "doc_id") -> list[str]:
    """The greedy filter by the greatest |Pearson| or |Spearman| that any group shows: two passes for all groups together."""
    group = [by] if by else []
    each = correlations(df, ranked, group) + correlations(ranked_columns(df, key, ranked, group), ranked, group)
    return greedy_filter(ranked, {p: max(c[p] for c in each) for p in each[0]}, most) if each else []


def logistic_sums(df: DataFrame, features: Sequence[str], label: str, weight: str, betas: np.ndarray, member=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients, Hessians and losses of weighted logistic models, one for each row of betas (the last is the intercept).

    One pass: a task sums its own rows for all models as matrix products, and only those p x p sums are shuffled. member
    (ids of rows, models) says which rows a model is fitted on; all, unless given. df has an id column `_h`.
    """
    sent, m, p = betas, len(betas), len(features) + 1

    def run(batches):
        import pandas as pd

        g, h, loss = np.zeros((m, p)), np.zeros((m, p, p)), np.zeros(m)
        for pdf in batches:
            x = np.column_stack([pdf[list(features)].to_numpy(float), np.ones(len(pdf))])
            y, w = pdf[label].to_numpy(float)[:, None], pdf[weight].to_numpy(float)[:, None]
            own = w * (np.ones((len(pdf), m)) if member is None else member(pdf["_h"].to_numpy(), m))
            z = x @ sent.T
            q = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            g += (own * (q - y)).T @ x
            loss += (own * np.logaddexp(0, np.where(y > 0, -z, z))).sum(axis=0)
            c = own * q * (1 - q)
            for k in range(m):
                h[k] += x.T @ (x * c[:, k : k + 1])
        yield pd.DataFrame({"model": np.arange(m), "s": list(np.column_stack([g, h.reshape(m, -1), loss]))})

    parts = df.select("_h", label, weight, *features).mapInPandas(run, "model int, s array<double>")
    rows = parts.select("model", F.posexplode("s").alias("i", "x")).groupBy("model", "i").agg(F.sum("x").alias("x")).groupBy("model").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s")).collect()
    s = np.zeros((m, p + p * p + 1))
    for r in rows:
        s[r["model"]] = [v["x"] for v in r["s"]]
    return s[:, :p], s[:, p : p + p * p].reshape(m, p, p), s[:, -1]


def logistic(df: DataFrame, features: Sequence[str], label: str, weight: str, l1: float = 0.0, l2: float = 0.0, models: int = 1, member=None, rounds: int = 15, allowed: np.ndarray | None = None) -> np.ndarray:
    """Coefficients of logistic models, (models, p + 1), by Newton steps over sums; l1 and l2 penalise all but the intercept.
    allowed (models, p + 1) says which coefficients a model has; all, unless given.

    With l1 a step minimises the quadratic model plus the penalty, coordinate by coordinate; steps halve while they fail.
    """
    p = len(features) + 1
    beta = np.zeros((models, p))
    before = None
    for _ in range(rounds):
        g, h, loss = logistic_sums(df, features, label, weight, beta, member)
        now = loss + l1 * np.abs(beta[:, :-1]).sum(axis=1) + l2 / 2 * (beta[:, :-1] ** 2).sum(axis=1)
        if before is not None:
            worse = now > before[0] + 1e-9
            if not worse.any() and np.max(before[0] - now) < 1e-8:
                break
            beta[worse] = (beta[worse] + before[1][worse]) / 2
            if worse.any():
                g, h, loss = logistic_sums(df, features, label, weight, beta, member)
                now = loss + l1 * np.abs(beta[:, :-1]).sum(axis=1) + l2 / 2 * (beta[:, :-1] ** 2).sum(axis=1)
        before = (now, beta.copy())
        new = beta.copy()
        for k in range(models):
            a = h[k] + np.diag([l2] * (p - 1) + [0.0]) + 1e-9 * np.eye(p)
            d = g[k] + np.append(l2 * beta[k, :-1], 0.0)
            v, own = beta[k].copy(), range(p) if allowed is None else np.flatnonzero(allowed[k])
            for _ in range(200):
                last = v.copy()
                for j in own:
                    r = v[j] - (d[j] + a[j] @ (v - beta[k])) / a[j, j]
                    v[j] = np.sign(r) * max(0.0, abs(r) - (l1 if j < p - 1 else 0.0) / a[j, j])
                if np.max(np.abs(v - last)) < 1e-10:
                    break
            new[k] = v
        beta = new
    return beta


def prepared(df: DataFrame, features: Sequence[str], label: str, key: str, seed: int = 11) -> DataFrame:
    """(_h, label, balanced weight, features standardised): what logistic models read; classes weigh the same."""
    stats = _stats(df, features)
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    whole = n.agg(F.sum("_n").alias("_rows"), F.count("*").alias("_classes"))
    d = df.join(n.crossJoin(whole), label)
    return d.select(F.xxhash64(F.lit(seed), key).alias("_h"), F.col(label).cast("double").alias("_y"), (F.col("_rows") / (F.col("_classes") * F.col("_n"))).alias("_w"), *standardised(df, features, stats))


#: Features up to which a Hessian for each model is summed.
NEWTON = 32


def lasso_rounds(x: DataFrame, features: Sequence[str], l1: float, models: int, member, rounds: int = 200, close: float = 1e-5) -> np.ndarray:
    """Coefficients of L1 logistic models of parts of x (_h, _y, _w, features), (models, p + 1); the last is the intercept.

    The logistic loss curves nowhere more than a quarter of the weighted products of the features, and a part's less than
    the whole's: that one matrix bounds all models. Each pass sums only the models' gradients, m (p + 1) numbers a task;
    the driver then minimises the bound plus the penalty, coordinate by coordinate for all models at once. So 228
    features and 201 models need neither a Hessian a model nor a plan that grows with them.
    """
    p = len(features) + 1
    wide = x.select("_h", "_y", F.col("_w").cast("double").alias("_w"), F.array(*[F.col(f).cast("double") for f in features], F.lit(1.0)).alias("_x"))
    wide = checkpointed(wide)
    columns = [f"_c{i}" for i in range(p)]
    bound = cross_products(wide.select("_w", *[F.get("_x", F.lit(i)).alias(c) for i, c in enumerate(columns)]), columns, F.col("_w")).first()
    if bound is None:
        return np.zeros((models, p))
    h = np.array(bound["s"]).reshape(p, p) / 4 + 1e-9 * np.eye(p)
    beta = np.zeros((models, p))
    penalty = np.append(np.full(p - 1, l1), 0.0)

    def gradients(sent: np.ndarray):
        def run(batches):
            import pyarrow as pa

            total = np.zeros((models, p))
            for batch in batches:
                v = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
                y, w, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_y", "_w", "_h"))
                q = 1 / (1 + np.exp(-np.clip(v @ sent.T, -35, 35)))
                total += (member(ids, models) * w[:, None] * (q - y[:, None])).T @ v
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["s"])

        return run

    def add(key, table):
        import pyarrow as pa

        return pa.table([pa.array([table.column("s").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, models * p).sum(axis=0).tolist()], pa.list_(pa.float64()))], names=["s"])

    for _ in range(rounds):
        parts = wide.mapInArrow(gradients(beta), "s array<double>")
        some = parts.groupBy(F.floor(F.spark_partition_id() / FAN_IN).alias("_bundle")).applyInArrow(add, "s array<double>")
        g = sum(np.array(r["s"]) for r in some.collect()).reshape(models, p)
        new, moved = beta.copy(), np.zeros((models, p))
        for _ in range(500):
            most = 0.0
            for j in range(p):
                r = new[:, j] - (g[:, j] + moved[:, j]) / h[j, j]
                d = np.sign(r) * np.maximum(0.0, np.abs(r) - penalty[j] / h[j, j]) - new[:, j]
                if d.any():  # most coefficients are and stay zero
                    moved += np.outer(d, h[j])
                    new[:, j] += d
                    most = max(most, float(np.abs(d).max()))
            if most < close / 10:
                break
        step, beta = np.max(np.abs(new - beta)), new
        if step < close:
            break
    return beta


def stability(df: DataFrame, features: Sequence[str], label: str, key: str, rounds: int = 200, share: float = 0.7, c: float = 0.08, seed: int = 11) -> DataFrame:
    """(feature, frequency, coefficient, rank): how often an L1 logistic model of a subsample keeps each feature, and its
    coefficient in the full fit; ranked by frequency, then |coefficient|, then mean |coefficient| of the rounds, then name.

    Classes weigh the same. A round's subsample holds each row with probability `share`, by a hash; all rounds and the full
    fit are models of the same passes (see lasso_rounds), for any number of features.
    """
    x = prepared(df, features, label, key, seed)

    def member(ids: np.ndarray, m: int) -> np.ndarray:
        k = ids.astype(np.int64).view(np.uint64)[:, None] ^ (np.arange(m, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        k = (k ^ (k >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        u = ((k ^ (k >> np.uint64(32))) >> np.uint64(11)).astype(float) / 2**53
        u[:, 0] = 0.0  # the first model is the full fit
        return (u < share).astype(float)

    if len(features) <= NEWTON:  # few passes, each with a Hessian for every model
        beta = logistic(x, features, "_y", "_w", l1=1 / c, models=rounds + 1, member=member)[:, :-1]
    else:
        beta = lasso_rounds(x, features, 1 / c, rounds + 1, member)[:, :-1]
    kept = np.abs(beta[1:]) > 1e-9
    rows = [(f, float(kept[:, i].mean()), float(beta[0, i]), float(np.abs(beta[1:, i]).mean())) for i, f in enumerate(features)]
    rows.sort(key=lambda r: (-r[1], -abs(r[2]), -r[3], r[0]))
    return df.sparkSession.createDataFrame([(f, k, b, i + 1) for i, (f, k, b, _) in enumerate(rows)], "feature string, frequency double, coefficient double, rank int")


def held_accuracy(x: DataFrame, features: Sequence[str], beta: np.ndarray, folds: int) -> np.ndarray:
    """Right answers of each model on the fold that it is to be judged on (its number modulo folds), and that fold's rows,
    as (models, 2): one pass for all of them. x has the fold in `_h`."""
    m = len(beta)

    def run(batches):
        import pandas as pd

        total = np.zeros((m, 2))
        for pdf in batches:
            v = np.column_stack([pdf[list(features)].to_numpy(float), np.ones(len(pdf))])
            own = pdf["_h"].to_numpy()[:, None] == np.arange(m)[None, :] % folds
            right = (v @ beta.T > 0) == (pdf["_y"].to_numpy()[:, None] > 0.5)
            total += np.column_stack([(own & right).sum(axis=0), own.sum(axis=0)])
        yield pd.DataFrame({"model": np.arange(m), "right": total[:, 0], "rows": total[:, 1]})

    out = np.zeros((m, 2))
    for r in x.select("_h", "_y", *features).mapInPandas(run, "model int, right double, rows double").groupBy("model").agg(F.sum("right").alias("right"), F.sum("rows").alias("rows")).collect():
        out[r["model"]] = r["right"], r["rows"]
    return out


def forward_selection(df: DataFrame, features: Sequence[str], label: str, key: str, fold: str, folds: int, most: int) -> list[tuple[str, float]]:
    """Greedy: the feature that raises the cross-validated accuracy most, of equals the last by name, until none does;
    features with fewer than 80 % finite values don't take part.

    A step's candidates and folds are models of the same passes, each with its own coefficients: eight passes a step at
    most, however many candidates there are.
    """
    finite = df.agg(*[F.avg(_finite(f).isNotNull().cast("double")).alias(f) for f in features]).first()
    names = [f for f in features if (finite[f] or 0) >= 0.8]
    if not names:
        return []
    folded = df.select(F.xxhash64(F.lit(11), key).alias("_h"), F.col(fold).cast("long").alias("_fold"))
    x = checkpointed(prepared(df, names, label, key).join(folded, "_h").withColumn("_h", F.col("_fold")).drop("_fold"))
    left, chosen, best = list(names), [], 0.0
    while left and len(chosen) < most:
        allowed = np.zeros((len(left) * folds, len(names) + 1), bool)
        allowed[:, [names.index(f) for f, _ in chosen] + [len(names)]] = True
        for c, f in enumerate(left):
            allowed[c * folds : (c + 1) * folds, names.index(f)] = True
        beta = logistic(x, names, "_y", "_w", l2=1e-6, models=len(allowed), member=lambda ids, m: (ids[:, None] != np.arange(m)[None, :] % folds).astype(float), rounds=8, allowed=allowed)
        right = held_accuracy(x, names, beta, folds).reshape(len(left), folds, 2).sum(axis=1)
        found = max((float(r / n) if n else 0.0, f) for (r, n), f in zip(right, left, strict=True))
        if found[0] <= best + 1e-12:
            break
        best = found[0]
        chosen.append((found[1], best))
        left.remove(found[1])
    return chosen


def consensus(rankings: DataFrame, active: float = 0.5) -> DataFrame:
    """Rankings (model, feature, frequency, coefficient, rank) as one: by models that keep a feature, mean frequency,
    mean |coefficient|, mean reciprocal rank, best rank, name."""
    g = rankings.groupBy("feature").agg(
        F.count_if(F.col("frequency") >= active).alias("active"),
        F.round(F.avg("frequency"), 6).alias("mean_frequency"),
        F.round(F.avg(F.abs("coefficient")), 6).alias("mean_coefficient"),
        F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"),
        F.min("rank").alias("best"),
    )
    order = Window.orderBy(F.desc("active"), F.desc("mean_frequency"), F.desc("mean_coefficient"), F.desc("mrr"), "best", "feature")
    return g.withColumn("rank", F.row_number().over(order))
