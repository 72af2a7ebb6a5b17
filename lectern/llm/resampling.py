"""Importance resampling towards a target: bucket gains as an array, then quickselect on perturbed weights."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from lectern.llm import textbytes as tb
from lectern.llm.common import keep

#: Pivots of a round of the selection, and the bytes of a word that are hashed together with those of other words.
PIVOTS, TOGETHER = 15, 32
NULL_ID = -(2**63)

#: Bytes of words: digits, letters (A-Z as a-z) and whatever isn't ASCII; all others divide words.
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[48:58] = np.arange(48, 58)
_PLAIN[97:123] = _PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)

#: The table of the reflected CRC-32 polynomial, from its rule.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & np.uint32(1), np.uint32(0xEDB88320) ^ (_CRC >> np.uint32(1)), _CRC >> np.uint32(1))
_ONES = np.uint32(0xFFFFFFFF)


def crc_after(state: np.ndarray, b: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """CRC-32 registers once the bytes b[start:stop] of each have followed: all words byte by byte together, the rest
    of those longer than TOGETHER one by one."""
    n = stops - starts
    order = np.argsort(-n, kind="stable")
    s, at, n = state[order], starts[order], n[order]
    active = np.searchsorted(-n, -np.arange(min(TOGETHER, int(n.max(initial=0)))), "left")
    for k, m in enumerate(active):
        s[:m] = _CRC[(s[:m] ^ b[at[:m] + k]) & np.uint32(255)] ^ (s[:m] >> np.uint32(8))
    for i in range(int(np.searchsorted(-n, -TOGETHER, "left"))):
        s[i] = zlib.crc32(b[at[i] + TOGETHER : at[i] + n[i]].tobytes(), int(s[i] ^ _ONES)) ^ int(_ONES)
    out = np.empty_like(s)
    out[order] = s
    return out


def features(b: np.ndarray, off: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and documents of all words and pairs of neighbouring words, and each document's number of words."""
    b = _PLAIN[b]
    starts, stops, first = tb.word_bounds(b, off)
    doc = tb.doc_of(first, len(starts))
    one = crc_after(np.full(len(starts), _ONES), b, starts, stops)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    joint = _CRC[(one[pair] ^ np.uint32(32)) & np.uint32(255)] ^ (one[pair] >> np.uint32(8))
    two = crc_after(joint, b, starts[pair + 1], stops[pair + 1])
    return (np.concatenate([one, two]) ^ _ONES).astype(np.int64) % buckets, np.concatenate([doc, doc[pair]]), np.diff(first)


def _histogram(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, b, off in tb.chunks(batch.column("text")):
                n += np.bincount(features(b, off, buckets)[0], minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(some), pa.array(n[some])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket: summed within partitions, then over them."""
    sums = texts.select("text").mapInArrow(_histogram(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():  # one row for each bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier a bucket is in the target, each bucket counted once more than seen."""
    s_all, t_all, m = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((float(t + 1) * (s_all + m)) / (float(s + 1) * (t_all + m)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weights(gain: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, total = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for lo, hi, b, off in tb.chunks(batch.column("text")):
                bucket, doc, words[lo:hi] = features(b, off, len(gain))
                total[lo:hi] = np.bincount(doc, weights=gain[bucket], minlength=hi - lo)
            n = words + np.maximum(words - 1, 0)
            out = batch.select([c for c in batch.schema.names if c != "text"])
            yield out.append_column("_words", pa.array(words)).append_column("n_features", pa.array(n)).append_column("weight", pa.array(total // np.maximum(n, 1)))

    return run


KEY = ("_down", "_id", "_at")


def _key(values: Sequence | None = None) -> Column:
    return F.struct(*(KEY if values is None else [F.lit(v).cast("long").alias(c) for c, v in zip(KEY, values, strict=True)]))


def kth_key(rows: DataFrame, k: int) -> Row | None:
    """The k-th smallest of the distinct composite keys of rows, by quickselect; None where k is 0.

    Each round draws PIVOTS keys at random (the least hashes) from what is left, counts exactly how many keys lie before,
    at and behind each pivot, and goes on with the keys between two of them, or ends at a pivot. What is left is written
    anew whenever it has shrunk to a quarter, so all rounds together read little more than the first.
    """
    left, need, size, written, turn = rows.select(*KEY), k, None, None, 0
    while k > 0:
        turn += 1
        pivots = sorted(left.orderBy(F.xxhash64(*KEY, F.lit(turn)), *KEY).limit(PIVOTS).collect())
        slot = sum(((_key() > _key(p)).cast("int") + (_key() >= _key(p)).cast("int") for p in pivots), F.lit(0))
        counts = {r["slot"]: r["count"] for r in left.groupBy(slot.alias("slot")).count().collect()}
        for at in range(2 * len(pivots) + 1):
            if need <= counts.get(at, 0):
                break
            need -= counts.get(at, 0)
        if at % 2:
            return pivots[at // 2]
        size = counts[at]
        if at > 0:
            left = left.where(_key() > _key(pivots[at // 2 - 1]))
        if at // 2 < len(pivots):
            left = left.where(_key() < _key(pivots[at // 2]))
        if written is None or size * 4 <= written:
            left, written = keep(left, "between"), size
    return None


def ranked(rows: DataFrame) -> DataFrame:
    """rows with rank, from 1, in the order of their keys: ranges of keys are sorted and numbered apart."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keep(rows.repartitionByRange(parts, *KEY).withColumn("_part", F.spark_partition_id()), "winners")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    places = rows.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*KEY))
    return rows.join(F.broadcast(places), "_part").withColumn("rank", (F.col("_before") + own).cast("long")).drop("_part", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, buckets: int = 10_000, seed: int = 7, least: int = 20, carry: Sequence[str] = ()) -> DataFrame:
    """Each row of docs (doc_id, text and the columns `carry`) with n_features, weight, score and rank among those drawn.

    Words are runs of letters, digits and characters beyond ASCII, A-Z as a-z; features are all words and all pairs of
    neighbours, hashed to buckets. A bucket's gain says how much likelier it is in the texts of target (text) than in docs;
    the gains are one array that every task holds, and a document's weight is the floored mean over its features. Its score
    adds Gumbel noise from a hash of seed and doc_id, so that the highest scores are a draw without replacement in
    proportion to exp(weight / 1000). Of the N documents with at least `least` words, floor(percent N / 100) are drawn:
    quickselect finds the last of them, and only those before it are sorted and numbered.

    Ties go to the smaller doc_id. Null texts have no features and weight 0; a null doc_id hashes as the empty string
    and is the smallest. Of rows that share doc_id and text each has a rank of its own. No rows give no rows; a target without
    texts leaves every bucket at its smoothed count. Columns of docs that are not carried are ignored, whatever their
    names; `carry` may not name a result.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    names = list(dict.fromkeys(["doc_id", *carry]))
    rows = docs.select(*names, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), F.monotonically_increasing_id().alias("_at"), "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    rows = rows.mapInArrow(_weights(gain), f"{fields}, _words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = keep(rows.withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("_down", -F.col("score")), "scores")
    fit = F.col("_words") >= least
    last = kth_key(rows.where(fit), rows.where(fit).count() * percent // 100)
    drawn = fit & (_key() <= _key(last)) if last else F.lit(False)
    out = ranked(rows.where(drawn)).unionByName(rows.where(~drawn).withColumn("rank", F.lit(None).cast("long")))
    return out.select(*names, "n_features", "weight", "score", "rank")
