"""Mixing sources to target weights, by histograms of hash thresholds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import textbytes as tb
from lectern.llm.common import keep

#: A document's hash has LEVELS groups of BITS bits; a level's histogram has at most 2**BITS buckets for a source.
BITS, LEVELS = 12, 5


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = np.zeros(len(batch), np.int64)
        for first, stop, b, off in tb.chunks(batch.column("text")):
            n[first:stop] = np.diff(tb.word_bounds(b, off)[2])
        keep_ = [c for c in batch.schema.names if c != "text"]
        yield batch.select(keep_).append_column("size", pa.array(n))


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size): share of the whole, by weight, at most `most` times a size.

    Sources in code-point order, null last, have the weights in turn. What a full source can't take goes to the
    others by weight until none is above its bound: one level for all the rest, found by running sums.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * float(most)).withColumn("full_at", F.col("cap") / F.col("w"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("total", F.sum("source_size").over(everything) * share)
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    t = t.withColumn("level", F.min_by(F.when(F.col("full_at") > F.col("level"), F.col("level")), F.when(F.col("full_at") > F.col("level"), F.col("full_at"))).over(everything))
    return t.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w"))).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Each row of docs (source, text and the columns `carry`) with size, source_size, target, copies, taken.

    A document is taken floor(target / source_size) times, and once more if its hash lies below its source's
    threshold. Thresholds come from histograms of summed sizes by source and hash bucket: only the bucket in which
    the rest of the budget ends is looked at more closely, level by level, until it holds one document, which is
    taken if that brings the source nearer to its target. Nothing is sorted; sums combine before the shuffle, so a
    source with a third of all rows costs no more than another; reruns agree because the hash is of the row.

    Null texts have size 0 and count for nothing; a null source is a source of its own, the last. Rows repeated whole
    share a hash: where the budget ends among them, further levels go by a hash of the rows' places, so that as many
    are taken as it allows (which of them is all one, as they are alike). A source without words has target 0. Columns
    of docs that are not carried are ignored, whatever their names; `carry` may not name a result. No rows give no rows.
    """
    whole_hash = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - BITS * LEVELS)
    place = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - BITS * LEVELS)
    names = list(dict.fromkeys(["source", *carry]))
    rows = docs.select(*names, whole_hash.alias("_h"), place.alias("_p"), "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    rows = keep(rows.mapInArrow(_sizes, f"{fields}, size long"), "sizes")
    goal = keep(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))

    # the edge of each source: the bucket of its rows' hashes, and of their places, where the rest of its budget ends
    edge = goal.select(F.col("source").alias("_s"), F.lit(0).cast("long").alias("at_h"), F.lit(0).cast("long").alias("at_p"), "rest")
    for level in range(1, 2 * LEVELS + 1):
        first = level <= LEVELS
        shift = BITS * (LEVELS - level if first else 2 * LEVELS - level)
        h, p = (F.shiftright("_h", shift), F.lit(0).cast("long")) if first else (F.col("_h"), F.shiftright("_p", shift))
        within = F.shiftright("_h", shift + BITS) == F.col("at_h") if first else (F.col("_h") == F.col("at_h")) & (F.shiftright("_p", shift + BITS) == F.col("at_p"))
        inside = rows.join(edge, F.col("source").eqNullSafe(F.col("_s"))).where(within)
        hist = inside.groupBy("_s", h.alias("at_h"), p.alias("at_p"), "rest").agg(F.sum("size").alias("sum"), F.count("*").alias("n"))
        run = Window.partitionBy("_s").orderBy("at_h", "at_p").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("below", F.coalesce(F.sum("sum").over(run), F.lit(0)))
        hist = hist.where("below <= rest and rest < below + sum")
        edge = keep(hist.select("_s", "at_h", "at_p", (F.col("rest") - F.col("below")).alias("rest"), "sum", "n"), "edges")
        if (edge.agg(F.max("n")).first()[0] or 0) <= 1:
            break
    edge = edge.select("_s", "at_h", "at_p", (2 * F.col("rest") >= F.col("sum")).alias("also"))
    out = rows.join(goal.withColumnRenamed("source", "_g"), F.col("source").eqNullSafe(F.col("_g"))).join(edge, F.col("source").eqNullSafe(F.col("_s")), "left")
    same = (h == F.col("at_h")) & (p == F.col("at_p"))
    more = F.coalesce((h < F.col("at_h")) | ((h == F.col("at_h")) & (p < F.col("at_p"))) | (same & F.col("also")), F.lit(False))
    copies = F.col("whole") + more.cast("long")
    return out.select(*names, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
