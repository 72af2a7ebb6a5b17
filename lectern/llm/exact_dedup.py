"""Exact duplicates: counting quotient filters find fingerprints that repeat, and bytes decide which texts are equal."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import keep

#: Fingerprints that one merge holds at most on average, and those that a partition gathers before it merges them.
MOST, PENDING = 1 << 20, 1 << 20
#: A fingerprint with 1 / HOT of all rows is hot: there are at most HOT of them, so their table can be broadcast.
HOT = 2048

NULL_ID = -(2**63)


def encode(prints: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """A counting quotient filter of sorted, distinct fingerprints of `bits` bits and how often each occurs.

    The quotient, a fingerprint's upper bits, is held as one bit for each value it can take (occupied or not) and one bit
    for each remainder (the last of its quotient or not); of the lower bits, only whole bytes are held. Counts of one take
    a bit, larger ones eight bytes beside it.
    """
    q = min(bits, max(1, len(prints).bit_length()))
    r = bits - q
    quotient = (prints >> np.uint64(r)).astype(np.int64) if r < 64 else np.zeros(len(prints), np.int64)
    remainder = prints & np.uint64((1 << r) - 1)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient] = True
    last = np.append(quotient[1:] != quotient[:-1], True)[: len(prints)]
    slots = np.ascontiguousarray(remainder.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, : -(-r // 8)]
    several = counts > 1
    parts = [np.packbits(occupied), np.packbits(last), slots, np.packbits(several), counts[several].astype("<i8")]
    return np.array([len(prints), q], "<i8").tobytes() + b"".join(p.tobytes() for p in parts)


def decode(blob: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of a filter, in order, and their counts: the inverse of encode()."""
    n, q = (int(x) for x in np.frombuffer(blob, "<i8", 2))
    r, at = bits - q, 16

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return np.frombuffer(blob, np.uint8, size, at - size)

    occupied = np.flatnonzero(np.unpackbits(take(-(-(1 << q) // 8)), count=1 << q))
    last = np.unpackbits(take(-(-n // 8)), count=n).astype(bool)
    width = -(-r // 8)
    slots = np.zeros((n, 8), np.uint8)
    slots[:, :width] = take(n * width).reshape(n, width)
    several = np.unpackbits(take(-(-n // 8)), count=n).astype(bool)
    counts = np.ones(n, np.int64)
    counts[several] = np.frombuffer(blob, "<i8", int(several.sum()), at)
    run = np.cumsum(last) - last
    return (occupied[run].astype(np.uint64) << np.uint64(r)) | slots.view("<u8").ravel(), counts


def merge(prints: Sequence[np.ndarray], counts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted run of distinct fingerprints out of several; counts of equal ones are added, so nothing is lost."""
    p, c = np.concatenate([*prints, np.zeros(0, np.uint64)]), np.concatenate([*counts, np.zeros(0, np.int64)])
    order = np.argsort(p, kind="stable")  # a merge sort, which takes runs that are sorted as they are
    p, c = p[order], c[order]
    first = np.flatnonzero(np.append(True, p[1:] != p[:-1])[: len(p)])
    return p[first], np.add.reduceat(c, first) if len(p) else c


def _built(bits: int, range_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The filters of a partition's fingerprints, one for each range of their upper bits."""
    low = bits - range_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, counts, waiting = [], [], 0
        for batch in batches:
            p, c = np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True)
            prints.append(p)
            counts.append(c.astype(np.int64))
            waiting += len(p)
            if waiting > PENDING:
                p, c = merge(prints, counts)
                prints, counts, waiting = [p], [c], 0
        p, c = merge(prints, counts)
        part = (p >> np.uint64(low)).astype(np.int64)
        edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)]), len(part))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = p[a:b] & np.uint64((1 << low) - 1)
            yield pa.record_batch([pa.array([part[a]]), pa.array([encode(own, c[a:b], low)], pa.binary())], ["range", "filter"])

    return run


def repeated_prints(rows: DataFrame, n: int, bits: int = 64) -> DataFrame:
    """(_fp, n): the fingerprints that occur more than once among the n rows of column _fp, of `bits` bits, and how often.

    Every partition builds its own filters; those of a range of fingerprints are merged in one task. A fingerprint that
    a third of the rows share is one entry of each partition's filter.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    range_bits = min(bits - 1, max(tasks - 1, n // MOST).bit_length())
    low = bits - range_bits

    def merged(key, table):
        p, c = merge(*zip(*(decode(x, low) for x in table.column("filter").to_pylist()), strict=True))
        p = (p | np.uint64(key[0].as_py() << low))[c > 1]
        return pa.table({"_fp": p.view(np.int64), "n": c[c > 1]})

    filters = rows.select("_fp").mapInArrow(_built(bits, range_bits), "range long, filter binary")
    return filters.groupBy("range").applyInArrow(merged, "_fp long, n long")


def exact_groups(docs: DataFrame, carry: Sequence[str] = (), bits: int = 64) -> DataFrame:
    """Each row of docs (doc_id, text and the columns `carry`) with first_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are. Of equal texts the row with the largest doc_id stays: keep_id is its doc_id,
    kept tells the row, first_id is the smallest doc_id of the group and group_size its rows.

    Counting quotient filters (repeated_prints) tell which fingerprints occur more than once. Only documents with such a
    one are read again, with their texts: grouped by fingerprint and whole text, they show whether all texts of a
    fingerprint are equal. Where they are, and nearly always they are, the group is the fingerprint's and rows without
    texts suffice; where unlike texts share a fingerprint, groups are made by the texts themselves. Fingerprints that
    many rows share (at most HOT of them) are joined by broadcast and combined before they are shuffled.

    A null text is the empty text. A null doc_id is smaller than all others. Of rows that share doc_id and text, as
    rows repeated whole do, one is kept. No rows give no rows. Columns of docs that are not carried are ignored,
    whatever their names; `carry` may not name a result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    fp = F.shiftrightunsigned(F.xxhash64(text), 64 - bits) if bits < 64 else F.xxhash64(text)
    names = list(dict.fromkeys(["doc_id", *carry]))
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id")
    rows = docs.select(*names, ident, fp.alias("_fp"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("_sha"), F.monotonically_increasing_id().alias("_at"))
    rows = keep(rows, "prints")
    n = rows.count()
    repeated = keep(repeated_prints(rows, n, bits), "repeated")
    hot = F.col("n") * HOT >= n
    often, others = F.broadcast(repeated.where(hot)), repeated.where(~hot)

    # bytes: the unlike texts of each fingerprint
    full = docs.select(fp.alias("_fp"), text.alias("text"))
    unlike = lambda some: full.join(some, "_fp", "left_semi").groupBy("_fp", "text").agg(F.lit(1).alias("one")).groupBy("_fp").agg(F.count("*").alias("texts"))
    mixed = keep(unlike(often).unionByName(unlike(others)).where("texts > 1").select("_fp"), "mixed")

    # rows without texts, where one fingerprint has one text
    best = (F.max(F.struct("_id", -F.col("_at"))).alias("best"), F.min("_id").alias("least"))
    alone = rows.join(mixed, "_fp", "left_anti")
    group = lambda some: alone.join(some, "_fp").groupBy("_fp").agg(*best, F.first("n").alias("n"))
    known = alone.join(F.broadcast(group(often)), "_fp")
    rest = alone.join(often, "_fp", "left_anti").join(group(others), "_fp", "left")

    # rows with texts, where unlike texts share a fingerprint
    texts = docs.select(*names, ident, fp.alias("_fp"), text.alias("_text")).join(mixed, "_fp", "left_semi")
    texts = keep(texts.withColumn("_at", F.monotonically_increasing_id()), "collisions")
    by_text = texts.groupBy("_fp", "_text").agg(*best, F.count("*").alias("n"))
    apart = texts.join(by_text, ["_fp", "_text"]).withColumn("_sha", F.unhex(F.sha2(F.col("_text").cast("binary"), 256))).drop("_text")

    out = known.unionByName(rest).unionByName(apart)
    single = F.col("n").isNull()
    last = F.when(single, F.col("_id")).otherwise(F.col("best._id"))
    least = F.when(single, F.col("_id")).otherwise(F.col("least"))
    back = lambda c: F.when(c != NULL_ID, c)
    return out.select(
        *names, back(least).alias("first_id"), back(last).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("best.col2") == -F.col("_at"))).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"),
    )
