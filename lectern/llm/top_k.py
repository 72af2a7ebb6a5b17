"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import keep

#: Queries and candidates that are scored at once, and those that meet in one task at most.
QUERIES, CANDIDATES, MOST = 512, 8192, 65_536
#: Bins of a query's histogram in one pass.
BINS = 1024


def _matrix(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    return col.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if len(col) else np.zeros((0, dim), np.int64)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; by floats where all of them are exact."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if bound < 2**53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return q @ c.T


def _each(fn, schema: dict[str, pa.DataType]):
    """What fn makes of every block of a cell's queries and candidates, one block at a time."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        dim, out = key[0].as_py(), []
        ids, q = left.column("q_id").to_numpy(), _matrix(left.column("q"), dim)
        own, c = right.column("vec_id").to_numpy(), _matrix(right.column("v"), dim)
        state = {n: left.column(n).to_numpy() for n in ("lo", "hi", "need") if n in left.column_names}
        for x in range(0, len(ids) if len(own) else 0, QUERIES):
            part = slice(x, x + QUERIES)
            for y in range(0, len(own), CANDIDATES):
                near = own[y : y + CANDIDATES]
                cols = fn(ids[part], near, _scores(q[part], c[y : y + CANDIDATES]), ids[part][:, None] != near[None, :], **{n: v[part] for n, v in state.items()})
                out.append(pa.table([pa.array(v, t) for v, t in zip(cols, schema.values(), strict=True)], names=list(schema)))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in schema.values()], names=list(schema))

    return run


def _range(ids, own, s, other):
    """Least and greatest score of each query."""
    big = np.iinfo(np.int64)
    some = other.any(axis=1)
    return ids[some], np.where(other, s, big.max).min(axis=1)[some], np.where(other, s, big.min).max(axis=1)[some]


def _widths(lo, hi):
    return np.maximum(1, (hi - lo) // BINS + 1)


def _histogram(ids, own, s, other, lo, hi, need):
    """Counts by bin, from the top down as far as this block alone would need to go."""
    at = np.where(other & (s >= lo[:, None]) & (s <= hi[:, None]), (s - lo[:, None]) // _widths(lo, hi)[:, None], -1)
    q, b = np.nonzero(at >= 0)
    key, n = np.unique(q * (BINS + 1) + (BINS - at[q, b]), return_counts=True)
    q, down = key // (BINS + 1), key % (BINS + 1)
    run = np.cumsum(n) - n
    first = np.searchsorted(q, q)
    some = run - run[first] < need[q] if len(q) else np.zeros(0, bool)
    return ids[q[some]], (BINS - down[some]).astype(np.int64), n[some].astype(np.int64)


def _winners(ids, own, s, other, lo, hi, need):
    """What scores above a query's kth value, and of what equals it the smallest ids, as many as are needed."""
    q, c = np.nonzero(other & (s > lo[:, None]))
    out = [(ids[q], own[c], s[q, c])]
    q, c = np.nonzero(other & (s == lo[:, None]))
    order = np.lexsort((own[c], q))
    q, c = q[order], c[order]
    some = np.arange(len(q)) - np.searchsorted(q, q) < need[q] if len(q) else np.zeros(0, bool)
    out.append((ids[q[some]], own[c[some]], s[q[some], c[some]]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries the k rows of vectors (vec_id, embedding) with the
    greatest integer inner product of floor(1024 x), the query's own vec_id left out, ties to the smaller vec_id.

    Everything is scored: candidates and queries are dealt at random into groups of at most about MOST vectors, smaller
    ones where that gives the cluster more tasks, and every two groups of a dimension meet in one task. A first pass
    takes each query's range of scores; passes over ever narrower bins then sum histograms over all groups and keep the
    bin that holds the kth value, until a bin is one value wide. A last pass keeps what lies above it and the smallest
    ids at it, at most k from each block at the value itself. Candidates are written once; only their shuffles repeat
    them, once for each group of queries.

    Vectors that are null, empty or hold a null or non-finite component, and null ids, take no part. A query id that
    several rows share is searched once, with the least of their vectors; candidates that share an id count each.
    Components are 64-bit integers, larger ones the greatest of those, and scores wrap like them. Other columns are
    ignored; no queries give no rows.
    """
    fine = lambda c: F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = lambda d: d.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(1024 * x)).alias("v"))
    dealt = lambda d: d.withColumn("dim", F.size("v")).withColumn("_at", F.xxhash64(F.monotonically_increasing_id()))
    asked = keep(dealt(usable(queries).groupBy("vec_id").agg(F.min("v").alias("v"))).withColumnsRenamed({"vec_id": "q_id", "v": "q"}), "queries")
    cand = keep(dealt(usable(vectors)), "candidates")
    few = vectors.sparkSession.sparkContext.defaultParallelism * 4
    n = cand.count()
    parts, groups = max(1, -(-n // MOST), min(few, n // 2048)), max(1, -(-asked.count() // MOST))
    part = lambda m: F.pmod("_at", F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    right = cand.withColumn("c", part(parts)).withColumn("g", every(groups)).drop("_at").groupBy("dim", "g", "c")

    def scored(fn, state: DataFrame | None, **schema: pa.DataType) -> DataFrame:
        q = asked if state is None else asked.join(state, "q_id")
        left = q.withColumn("g", part(groups)).withColumn("c", every(parts)).drop("_at").groupBy("dim", "g", "c")
        return left.cogroup(right).applyInArrow(_each(fn, schema), ", ".join(f"{c} long" for c in schema))

    long = pa.int64()
    state = scored(_range, None, q_id=long, lo=long, hi=long).groupBy("q_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    state = keep(state.withColumn("need", F.lit(k).cast("long")), "ranges")
    while (state.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 0) > 0:
        hist = scored(_histogram, state, q_id=long, bin=long, n=long).groupBy("q_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q_id").orderBy(F.desc("bin"))
        hist = hist.withColumn("above", F.coalesce(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).join(state, "q_id")
        # the first bin from the top that reaches the count, or the lowest of all where there are fewer
        hist = hist.where("above < need").groupBy("q_id").agg(F.min_by(F.struct("bin", "above", "lo", "hi", "need"), "bin").alias("s")).select("q_id", "s.*")
        width = F.greatest(F.lit(1), F.floor((F.col("hi") - F.col("lo")) / BINS) + 1).cast("long")
        low = F.col("lo") + F.col("bin") * width
        state = keep(hist.select("q_id", low.alias("lo"), F.least("hi", low + width - 1).alias("hi"), (F.col("need") - F.col("above")).alias("need")), "ranges")
    won = scored(_winners, state, query_id=long, vec_id=long, score=long)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return won.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
