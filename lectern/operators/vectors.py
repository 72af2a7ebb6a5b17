"""Geometry of weighted vectors by group: centroids, distances, matches, clusters.

Dimensions are exploded for means, so sums combine before the shuffle; what needs every pair of a group meets block by
block in tasks, and only maxima or counts are shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.scalar import cosine, dot, unit
from lectern.operators.quantiles import quantiles
from lectern.sources.tables import checkpointed


#: Vectors of a group that meet as many others in one task.
BLOCK = 2048
#: Bins of the histogram by which a median is looked for.
BINS = 1 << 16


def _dealt(vectors: DataFrame, by: list[str], key: str) -> DataFrame:
    """vectors with _b, the hash block of the row among the _n blocks of its group."""
    n = vectors.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_n"))
    return vectors.join(n, by).withColumn("_b", F.pmod(F.xxhash64(key), F.col("_n")).cast("int"))


def _self_blocks(vectors: DataFrame, by: list[str], *more: str):
    """vectors (by, id, u, more) grouped so that every two of a group's blocks meet in one task."""
    d = _dealt(vectors.select(*by, "id", "u", *more), by, "id").withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    d = d.select(*by, "id", "u", *more, "_b", F.least("_b", "_x").alias("_i"), F.greatest("_b", "_x").alias("_j"))
    return d.groupBy(*by, "_i", "_j")


def _distances(pdf) -> np.ndarray:
    """1 - dot of the pairs of two blocks, or of one block's own, each pair once and summed in the order of dimensions."""
    one = pdf["_i"].iloc[0] == pdf["_j"].iloc[0]
    first = np.ones(len(pdf), bool) if one else (pdf["_b"] == pdf["_i"]).to_numpy()
    u, ids = np.array(pdf["u"].tolist(), float).reshape(len(pdf), -1), pdf["id"].to_numpy()
    a, b = u[first], u if one else u[~first]
    dot = np.zeros((len(a), len(b)))
    for k in range(u.shape[1]):
        dot += a[:, k, None] * b[None, :, k]
    pairs = ids[first][:, None] < ids[None, :] if one else np.ones(dot.shape, bool)
    return 1 - dot[pairs]


def _fields(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)


def centroids(vectors: DataFrame, by: list[str]) -> DataFrame:
    """(by, centroid): weighted means of unit vectors."""
    d = vectors.select(*by, "w", F.posexplode(unit(F.col("v"))).alias("dim", "x"))
    m = d.groupBy(*by, "dim").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    return m.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("centroid"))


def centroid_distance(vectors: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, distance): weighted mean of 1 - cosine to the centroid."""
    j = vectors.join(centroids(vectors, by), by)
    return j.groupBy(*by).agg(F.count("*").alias("n"), (F.sum(F.col("w") * (1 - cosine(F.col("v"), F.col("centroid")))) / F.sum("w")).alias("distance"))


def pairwise(vectors: DataFrame, by: list[str]) -> DataFrame:
    """(by, mean, std): of 1 - cosine over pairs of a group, weighed by both weights; ids are distinct.

    No pair is formed: with c the cosine of unit vectors, the sums of w w' c and w w' c^2 over pairs follow from the
    sums of w u and w u u^T, less the diagonal. Each task sums its own rows before the shuffle.
    """
    u = vectors.select(*by, F.col("w").cast("double").alias("w"), unit(F.col("v")).alias("u"))

    def partial(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for key, g in pdf.groupby(by, dropna=True):
                x, w = np.array(g["u"].tolist(), float), g["w"].to_numpy()
                n2 = (x * x).sum(axis=1)
                rows.append([*key, len(w), w.sum(), (w * w).sum(), (w * w * n2).sum(), (w * w * n2 * n2).sum(), w @ x, ((x * w[:, None]).T @ x).ravel()])
            yield pd.DataFrame(rows, columns=[*by, "n", "w", "ww", "one", "two", "first", "second"])

    sums = u.mapInPandas(partial, f"{_fields(vectors, by)}, n long, w double, ww double, one double, two double, first array<double>, second array<double>")

    def squared(c: str) -> DataFrame:
        e = sums.select(*by, F.posexplode(c).alias("_i", "x")).groupBy(*by, "_i").agg(F.sum("x").alias("x"))
        return e.groupBy(*by).agg(F.sum(F.col("x") * F.col("x")).alias(c))

    g = sums.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "w", "ww", "one", "two")]).where("n > 1")
    g = g.join(squared("first"), by).join(squared("second"), by)
    s = F.col("w") * F.col("w") - F.col("ww")
    c, q = (F.col("first") - F.col("one")) / s, (F.col("second") - F.col("two")) / s
    return g.select(*by, (1 - c).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), q - c * c)).alias("std"))


def best_match(left: DataFrame, right: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """(by, mean, min, below, deficit): each left vector's best cosine among its group's right ones, weighed.

    A group without right vectors has the threshold itself, as does an empty left side that a caller fills in. Blocks
    of both sides meet as matrix products, whose maxima are taken before the shuffle.
    """
    x = _dealt(left.select(*by, "id", "w", unit(F.col("v")).alias("u")), by, "id")
    y = _dealt(right.select(*by, unit(F.col("v")).alias("u")).distinct(), by, "u")
    counts = [d.select(*by, F.col("_n").alias("_m")).distinct() for d in (y, x)]
    x = x.join(counts[0], by).select(*by, "id", "w", "u", F.lit(True).alias("_left"), F.col("_b").alias("_i"), F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("_j"))
    none = [F.lit(0).cast(left.schema[c].dataType).alias(c) for c in ("id", "w")]  # no nulls, which would turn ids into floats
    y = y.join(counts[1], by).select(*by, *none, "u", F.lit(False).alias("_left"), F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("_i"), F.col("_b").alias("_j"))

    def most(pdf):
        a, b = pdf[pdf["_left"]], pdf[~pdf["_left"]]
        own = a[[*by, "id", "w"]] if len(b) else a[[*by, "id", "w"]][:0]
        dot = np.array(a["u"].tolist(), float) @ np.array(b["u"].tolist(), float).T if len(own) else np.zeros((0, 1))
        return own.assign(best=dot.max(axis=1))

    found = x.unionByName(y).groupBy(*by, "_i", "_j").applyInPandas(most, f"{_fields(left, [*by, 'id', 'w'])}, best double")
    every = left.select(*by, "id", "w", F.lit(None).cast("double").alias("best"))
    best = found.unionByName(every).groupBy(*by, "id", "w").agg(F.coalesce(F.max("best"), F.lit(threshold)).alias("best"))
    low = F.greatest(F.lit(0.0), threshold - F.col("best"))
    whole = F.sum("w")
    return best.groupBy(*by).agg((F.sum(F.col("w") * F.col("best")) / whole).alias("mean"), F.min("best").alias("min"), (F.sum(F.when(F.col("best") < threshold, F.col("w")).otherwise(0)) / whole).alias("below"), (F.sum(F.col("w") * low) / whole).alias("deficit"))


def alignment(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """(by, mean, most, centroids): each left vector's best cosine among its group's right ones, weighed, the greatest of
    all, and the cosine of both sides' weighted centroids; groups that lack a side have no row."""
    best = best_match(left, right, by, 0.0).select(*by, "mean")
    far = best_match_extreme(left, right, by)
    c = centroids(left, by).withColumnRenamed("centroid", "c1").join(centroids(right, by).withColumnRenamed("centroid", "c2"), by)
    return best.join(far, by).join(c, by).select(*by, "mean", "most", cosine(F.col("c1"), F.col("c2")).alias("centroids"))


def best_match_extreme(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """(by, most): the greatest cosine between a left and a right vector of a group, block by block."""
    x, y = (_dealt(d.select(*by, unit(F.col("v")).alias("u")), by, "u") for d in (left, right))
    n = [d.select(*by, F.col("_n").alias("_m")).distinct() for d in (y, x)]
    every = F.explode(F.sequence(F.lit(0), F.col("_m") - 1))
    x = x.join(n[0], by).select(*by, "u", F.lit(True).alias("_left"), F.col("_b").alias("_i"), every.alias("_j"))
    y = y.join(n[1], by).select(*by, "u", F.lit(False).alias("_left"), every.alias("_i"), F.col("_b").alias("_j"))

    def most(key, pdf):
        import pandas as pd

        a, b = (np.array(pdf["u"][pdf["_left"] == side].tolist(), float) for side in (True, False))
        return pd.DataFrame([[*key[: len(by)], float((a @ b.T).max())]] if len(a) and len(b) else [], columns=[*by, "m"])

    return x.unionByName(y).groupBy(*by, "_i", "_j").applyInPandas(most, f"{_fields(left, by)}, m double").groupBy(*by).agg(F.max("m").alias("most"))


def cluster_summary(vectors: DataFrame, by: list[str], cluster: str, noise: int = -1) -> DataFrame:
    """(by, clusters, largest, size_cv, noise): weights of clusters, and the share of the weight in none of them."""
    c = vectors.groupBy(*by, cluster).agg(F.sum("w").alias("s"))
    own = F.when(F.col(cluster) != noise, F.col("s"))
    return c.groupBy(*by).agg(F.count(own).alias("clusters"), (F.max(own) / F.sum(own)).alias("largest"), (F.stddev_pop(own) / F.avg(own)).alias("size_cv"), (F.sum(F.when(F.col(cluster) == noise, F.col("s")).otherwise(0)) / F.sum("s")).alias("noise"))


def cluster_mixing(vectors: DataFrame, by: list[str], cluster: str, kind: str) -> DataFrame:
    """(by, purity, mixing, mixed): share of the commonest kind, normalised entropy of kinds, share of mixed clusters."""
    k = vectors.groupBy(*by, cluster, kind).agg(F.sum("w").alias("s"))
    p = F.col("s") / F.sum("s").over(Window.partitionBy(*by, cluster))
    c = k.withColumn("p", p).groupBy(*by, cluster).agg(F.sum("s").alias("s"), F.max("p").alias("purity"), F.sum(-F.col("p") * F.ln("p")).alias("h"), F.count("*").alias("k"))
    c = c.withColumn("mix", F.when(F.col("k") > 1, F.col("h") / F.ln("k")).otherwise(0.0))
    mean = lambda x: F.sum(F.col("s") * x) / F.sum("s")
    return c.groupBy(*by).agg(mean(F.col("purity")).alias("purity"), mean(F.col("mix")).alias("mixing"), mean((F.col("k") > 1).cast("double")).alias("mixed"))


def diameters(vectors: DataFrame, by: list[str]) -> DataFrame:
    """(by, diameter): greatest 1 - cosine within a group, 0 for a single vector."""

    def most(key, pdf):
        import pandas as pd

        return pd.DataFrame([[*key[: len(by)], float(_distances(pdf).max(initial=0.0))]])

    u = vectors.select(*by, "id", unit(F.col("v")).alias("u"))
    return _self_blocks(u, by).applyInPandas(most, f"{_fields(vectors, by)}, d double").groupBy(*by).agg(F.max("d").alias("diameter"))


def diameter_summary(vectors: DataFrame, by: list[str], cluster: str) -> DataFrame:
    """(by, greatest, mean): of the clusters' diameters, the mean weighed by the clusters' weights."""
    d = diameters(vectors, [*by, cluster]).join(vectors.groupBy(*by, cluster).agg(F.sum("w").alias("s")), [*by, cluster])
    return d.groupBy(*by).agg(F.max("diameter").alias("greatest"), (F.sum(F.col("diameter") * F.col("s")) / F.sum("s")).alias("mean"))


def control_share(vectors: DataFrame, by: list[str], cluster: str, kind: str, control: int) -> DataFrame:
    """(by, clusters, weight, kind_share): shares of the clusters, and of their weight, that hold a vector of the control
    kind, and the mean share of that kind in them."""
    c = vectors.groupBy(*by, cluster).agg(F.sum("w").alias("s"), F.sum(F.when(F.col(kind) == control, F.col("w")).otherwise(0)).alias("k"))
    has = F.col("k") > 0
    return c.groupBy(*by).agg((F.count_if(has) / F.count("*")).alias("clusters"), (F.sum(F.when(has, F.col("s")).otherwise(0)) / F.sum("s")).alias("weight"), F.avg(F.when(has, F.col("k") / F.col("s"))).alias("kind_share"))


def anchor_calibration(scores: DataFrame, label: str, score: str, anchor: str) -> DataFrame:
    """(anchor, threshold, accuracy, held_out): for each anchor the balanced threshold of all other anchors' scores, and its
    balanced accuracy on the anchor's own.

    Scores are counted by value and anchor first; the others' counts at a value are those of all less the anchor's own, so
    rows are never copied: an anchor adds a row for each distinct score.
    """
    counts = checkpointed(scores.groupBy(F.col(anchor).alias("_held"), F.col(score).alias("_s")).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("q")))
    all_ = counts.groupBy("_s").agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"), F.map_from_entries(F.collect_list(F.struct("_held", F.struct("p", "q")))).alias("own"))
    held = [r[0] for r in counts.select("_held").distinct().collect()]  # anchors are few
    each = all_.select("_s", F.explode(F.array(*map(F.lit, held))).alias("_held"), "all_p", "all_q", "own")
    own = lambda c: F.coalesce(F.element_at("own", F.col("_held"))[c], F.lit(0))
    rest = each.select("_held", "_s", (F.col("all_p") - own("p")).alias("p"), (F.col("all_q") - own("q")).alias("q")).where("p + q > 0")
    up = Window.partitionBy("_held").orderBy(F.desc("_s"))
    whole = Window.partitionBy("_held")
    share = lambda c: F.try_divide(F.sum(c).over(up.rowsBetween(Window.unboundedPreceding, 0)), F.sum(c).over(whole))
    accuracy = F.round((share("p") + 1 - share("q")) / 2, 9)
    c = rest.withColumn("accuracy", accuracy).withColumn("below", F.lead("_s").over(up)).withColumn("best", F.max("accuracy").over(whole))
    middle = F.when(F.col("below").isNull(), F.col("_s")).otherwise((F.col("_s") + F.col("below")) / 2)
    c = checkpointed(c.where("accuracy = best").select("_held", middle.alias("middle"), "best"))
    t = c.groupBy("_held").agg(F.max("best").alias("accuracy")).join(quantiles(c, ["_held"], "middle", {"threshold": 0.5}), "_held")
    hits = counts.join(t, "_held").withColumn("above", F.col("_s") >= F.col("threshold"))
    part = lambda c, side: F.try_divide(F.sum(F.when(F.col("above") == side, F.col(c)).otherwise(0)), F.sum(c))
    right = (part("p", True), part("q", False))
    return hits.groupBy(F.col("_held").alias(anchor), "threshold", "accuracy").agg(((F.coalesce(*right) + F.coalesce(*right[::-1])) / 2).alias("held_out"))


def median_distance(vectors: DataFrame, by: list[str]) -> DataFrame:
    """(by, median): of 1 - cosine over the pairs of a group that are apart at all.

    A first pass counts distances in BINS bins, a second returns those in the bins that hold the middle.
    """
    u = vectors.select(*by, "id", unit(F.col("v")).alias("u"))
    fields = _fields(vectors, by)

    def bins(d):
        return np.minimum((d * (BINS / 2)).astype(np.int64), BINS - 1)

    def count(key, pdf):
        import pandas as pd

        d = _distances(pdf)
        b, n = np.unique(bins(d[d > 0]), return_counts=True)
        return pd.DataFrame({**{c: [k] * len(b) for c, k in zip(by, key, strict=False)}, "bin": b, "c": n})

    h = _self_blocks(u, by).applyInPandas(count, f"{fields}, bin long, c long").groupBy(*by, "bin").agg(F.sum("c").alias("c"))
    w = Window.partitionBy(*by)
    h = h.withColumn("n", F.sum("c").over(w)).withColumn("to", F.sum("c").over(w.orderBy("bin")))
    middle = [F.expr("(n - 1) div 2"), F.expr("n div 2")]
    h = h.where((F.col("to") > middle[0]) & (F.col("to") - F.col("c") <= middle[1]))
    h = h.groupBy(*by).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"), F.max("n").alias("n"), F.min(F.col("to") - F.col("c")).alias("under"))

    def inside(key, pdf):
        import pandas as pd

        d = _distances(pdf)
        d = d[d > 0]
        at = bins(d)
        d, n = np.unique(d[(at >= pdf["lo"].iloc[0]) & (at <= pdf["hi"].iloc[0])], return_counts=True)
        return pd.DataFrame({**{c: [k] * len(d) for c, k in zip(by, key, strict=False)}, "d": d, "c": n})

    v = _self_blocks(u.join(h.select(*by, "lo", "hi"), by), by, "lo", "hi").applyInPandas(inside, f"{fields}, d double, c long")
    v = v.groupBy(*by, "d").agg(F.sum("c").alias("c")).withColumn("to", F.sum("c").over(w.orderBy("d"))).join(h, by).withColumn("to", F.col("to") + F.col("under"))
    return v.groupBy(*by).agg(((F.min(F.when(F.col("to") > middle[0], F.col("d"))) + F.min(F.when(F.col("to") > middle[1], F.col("d")))) / 2).alias("median"))


def spectrum(vectors: DataFrame, by: list[str]) -> DataFrame:
    """(by, dispersion, effective_rank): 1 - the first component's share, and exp of the spectrum's entropy.

    Each task sums its own rows' weighted products as one matrix; only a group's dim x dim sums, however large the group,
    are shuffled and meet the eigenvalue solver.
    """
    u = vectors.select(*by, F.col("w").cast("double").alias("w"), unit(F.col("v")).alias("u"))

    def partial(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for key, g in pdf.groupby(by, dropna=True):
                x, w = np.array(g["u"].tolist(), float), g["w"].to_numpy()
                i, j = np.triu_indices(x.shape[1])
                rows.append([*key, np.concatenate([[w.sum()], w @ x, ((x * w[:, None]).T @ x)[i, j]])])
            yield pd.DataFrame(rows, columns=[*by, "s"])

    sums = u.mapInPandas(partial, f"{_fields(vectors, by)}, s array<double>").select(*by, F.posexplode("s").alias("i", "x")).groupBy(*by, "i").agg(F.sum("x").alias("x"))

    def solve(key, pdf):
        s = pdf.sort_values("i")["x"].to_numpy()
        n = int((np.sqrt(9 + 8 * (len(s) - 1)) - 3) / 2 + 0.5)  # 1 + n + n (n + 1) / 2 numbers
        a = np.zeros((n, n))
        a[np.triu_indices(n)] = s[1 + n :] / s[0]
        a = a + np.triu(a, 1).T
        m = s[1 : 1 + n] / s[0]
        a -= np.outer(m, m)
        e = np.clip(np.linalg.eigvalsh(a), 0, None)
        p = e / max(e.sum(), 1e-300)
        own = p[p > 1e-12]
        import pandas as pd

        return pd.DataFrame([[*key, 1 - p.max() if e.sum() > 0 else 0.0, float(np.exp(-(own * np.log(own)).sum())) if e.sum() > 0 else 0.0]])

    fields = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in by)
    return sums.groupBy(*by).applyInPandas(solve, f"{fields}, dispersion double, effective_rank double")


def margins(vectors: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    """vectors with `margin`: cosine to the first centroid less that to the second; both are one row and broadcast."""
    both = one.select(F.col("centroid").alias("c1")).limit(1).crossJoin(two.select(F.col("centroid").alias("c2")).limit(1))
    return vectors.crossJoin(both).withColumn("margin", cosine(F.col("v"), F.col("c1")) - cosine(F.col("v"), F.col("c2"))).drop("c1", "c2")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """An upsert: of the rows of a key the latest."""
    return rows.withColumn("_p", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_p = 1").drop("_p")


def auto_kmeans(vectors: DataFrame, ks: tuple[int, ...] = (2, 3, 4, 6, 8, 12, 16), seed: int = 7) -> DataFrame:
    """(id, k, cluster): weighted k-means on unit vectors for the k with the best cosine silhouette; a k is valid if it is
    below the number of distinct vectors and every cluster has a member. Without a valid k all are one cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    from lectern.sources.tables import checkpointed

    u = checkpointed(vectors.select("id", F.col("w").cast("double").alias("w"), unit(F.col("v")).alias("u")))
    x = u.select("id", "w", array_to_vector("u").alias("features"))
    n, best = u.select("u").distinct().count(), None
    for k in ks:
        if 2 <= k < n:
            out = KMeans(k=k, seed=seed, weightCol="w", distanceMeasure="cosine", maxIter=10).fit(x).transform(x)
            if out.select("prediction").distinct().count() < k:
                continue
            score = ClusteringEvaluator(distanceMeasure="cosine").evaluate(out)
            if best is None or score > best[0]:
                best = (score, k, out)
    if best is None:
        return u.select("id", F.lit(1).alias("k"), F.lit(0).alias("cluster"))
    return best[2].select("id", F.lit(best[1]).alias("k"), F.col("prediction").alias("cluster"))


__all__ = ["alignment", "anchor_calibration", "auto_kmeans", "best_match", "centroid_distance", "centroids", "cluster_mixing", "cluster_summary", "control_share", "diameter_summary", "diameters", "latest", "margins", "median_distance", "pairwise", "spectrum"]
