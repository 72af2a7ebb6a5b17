"""Byte passages that already stand earlier in the corpus, by two-stage suffix sorting of the pieces that may repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import textbytes as tb
from lectern.llm.common import keep, text_key
from lectern.llm.word_repeats import packed, unpacked

#: Bytes of an anchor. Every window holds at least one: the k-gram with the least fingerprint in it.
ANCHOR_BYTES = 32
#: Pieces of one anchor that one task sorts together; more are compared by fingerprints of their windows instead.
SORT_PIECES = 20_000
#: Bytes of pieces that are sorted at once.
SORT_BYTES = 1 << 21


def _spans_of(mask: np.ndarray) -> np.ndarray:
    """Maximal runs of True as rows of (start, end)."""
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).reshape(-1, 2)


def _runs(b: np.ndarray, off: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: its fingerprint, the run's bytes' fingerprint, document, first window, windows."""
    values = b.astype(np.uint64) + np.uint64(1)
    k = min(ANCHOR_BYTES, window)
    grams = tb.kgram_hashes(values, k, 0)
    win, at = tb.minimizers(grams, off, k, window)
    if not len(win):
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    first, last = win[new], win[np.concatenate([new[1:], [len(win)]]) - 1]
    at = at[new]
    piece = tb.spans_hash(tb.prefix(values, 1), first, last + window, 1) ^ tb.mix((at - first).astype(np.uint64))
    doc = np.searchsorted(off, first, "right") - 1
    return grams[at], piece, doc, first - off[:-1][doc], last - first + 1


_OCC = "anchor long, piece long, _id long, _th long, at int, n int, gone boolean"
_NAMES = ["anchor", "piece", "_id", "_th", "at", "n", "gone"]


def _occ(anchor, piece, id_, th, at, n, gone) -> pa.RecordBatch:
    as_long = lambda x: pa.array(x.view(np.int64))
    return pa.RecordBatch.from_arrays(
        [as_long(anchor), as_long(piece), pa.array(id_), pa.array(th), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(np.broadcast_to(np.bool_(gone), len(at)) if np.isscalar(gone) else gone)],
        _NAMES,
    )


def _pieces(window: int):
    """A row for each run of windows; what a batch already shows to repeat an earlier row of it is marked gone.

    This combines before the shuffle: of a run that many documents of a batch share, one row travels on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = batch.column("_id").to_numpy(), batch.column("_th").to_numpy()
            parts = []
            for first, _, b, off in tb.chunks(batch.column("text")):
                anchor, piece, doc, at, n = _runs(b, off, window)
                parts.append((anchor, piece, doc + first, at, n))
            if not parts:
                continue
            anchor, piece, doc, at, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            rank = np.empty(len(ids), np.int64)
            rank[np.lexsort((ths, ids))] = np.arange(len(ids))
            order = np.lexsort((at, rank[doc], piece, anchor))
            same = np.zeros(len(order), bool)
            a, p, s = anchor[order], piece[order], at[order]
            same[1:] = (a[1:] == a[:-1]) & (p[1:] == p[:-1])
            whole = same.copy()  # the same document once more
            whole[1:] &= (ids[doc][order][1:] == ids[doc][order][:-1]) & (ths[doc][order][1:] == ths[doc][order][:-1]) & (s[1:] == s[:-1])
            gone = np.empty(len(order), bool)
            gone[order] = same
            keep_ = np.flatnonzero(~gone)
            gone[order[whole]] = False
            yield _occ(anchor[keep_], piece[keep_], ids[doc[keep_]], ths[doc[keep_]], at[keep_], n[keep_], False)
            # neighbouring runs that are gone join into one; they come document by document, in order
            lost = np.flatnonzero(gone)
            if len(lost):
                d, s, m = doc[lost], at[lost], n[lost]
                new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1] + m[:-1])]))
                size = np.add.reduceat(m, new)
                d, s = d[new], s[new]
                spread = tb.mix(ids[d].astype(np.uint64) + s.astype(np.uint64))
                yield _occ(spread, spread, ids[d], ths[d], s, size, True)

    return run


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor and piece: later rows of a piece are gone; first rows of an anchor with several stay.

    One row is held back between batches, whatever the size of an anchor's group.
    """
    cols = [x for x in _NAMES if x != "gone"]
    before = None  # the row before
    held, held_prev = None, None  # the last first row, and the anchor of the first row before that
    for batch in batches:
        x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _NAMES}
        passed = x["gone"].astype(bool)
        own = {c: v[~passed] for c, v in x.items()}
        out = [{c: x[c][passed] for c in cols} | {"gone": np.ones(int(passed.sum()), bool)}]
        if len(own["at"]):
            same = np.zeros(len(own["at"]), bool)
            same[1:] = (own["anchor"][1:] == own["anchor"][:-1]) & (own["piece"][1:] == own["piece"][:-1])
            again = same.copy()  # the same document once more
            for c in ("_id", "_th", "at"):
                again[1:] &= own[c][1:] == own[c][:-1]
            top = tuple(own[c][0] for c in cols[:5])
            same[0], again[0] = before is not None and before[:2] == top[:2], before == top
            before = tuple(own[c][-1] for c in cols[:5])
            lost = same & ~again
            out.append({c: own[c][lost] for c in cols} | {"gone": np.ones(int(lost.sum()), bool)})
            f = {c: own[c][~same] for c in cols}
            if held is not None:
                f = {c: np.concatenate([held[c], f[c]]) for c in cols}
            a = f["anchor"]
            if len(a):
                several = np.zeros(len(a), bool)
                several[1:] = a[1:] == a[:-1]
                several[0] = held_prev is not None and held_prev == a[0]
                several[:-1] |= a[:-1] == a[1:]
                ready = several[:-1]
                out.append({c: f[c][:-1][ready] for c in cols} | {"gone": np.zeros(int(ready.sum()), bool)})
                held_prev = a[-2] if len(a) > 1 else held_prev
                held = {c: f[c][-1:] for c in cols}
        for o in out:
            if len(o["at"]):
                yield _occ(*(o[c] for c in _NAMES))
    if held is not None and held_prev is not None and held_prev == held["anchor"][0]:
        yield _occ(*(held[c] for c in cols), False)


def two_stage_order(b: np.ndarray, off: np.ndarray, count: np.ndarray, depth: int) -> np.ndarray:
    """The first count[j] suffixes of each piece j in the order of their first `depth` bytes, as flat positions.

    b holds the pieces, each followed by a 0 at off[j + 1] - 1, as values from 1 up. Suffixes smaller than their
    successors are sorted directly; the others are induced by one scan of the order: whoever is met puts the suffix
    one place to its left, if that is larger than its successor, at the front of its first byte's bucket.
    """
    n = len(b)
    i = np.arange(n)
    end = np.zeros(n, bool)
    end[off[1:] - 1] = True
    ahead = np.append(b[1:], 0).astype(np.int64) - b
    turn = np.where((ahead != 0) | end, i, n)
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    small = ahead[np.minimum(turn, n - 1)] > 0  # smaller than its successor
    small[end] = False
    stop = np.where(small | end, i, n)
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    step = np.zeros(n + 1, np.int64)
    step[off[:-1]] += 1
    np.add.at(step, stop[off[:-1] + count] + 1, -1)
    wanted = np.cumsum(step)[:-1] > 0
    direct = np.flatnonzero(wanted & small)
    padded = np.concatenate([b, np.zeros(depth, b.dtype)])
    raw = np.where(padded > 0, padded - 1, 0).astype(np.uint8)
    # bytes after a piece's end are of no account: they count as 0
    rows = np.lib.stride_tricks.sliding_window_view(raw, depth)[direct]
    left = off[1:][np.searchsorted(off, direct, "right") - 1] - 1 - direct
    short = np.flatnonzero(left < depth)
    if len(short):
        part = rows[short]
        part[np.arange(depth)[None, :] >= left[short][:, None]] = 0
        rows[short] = part
    direct = direct[np.argsort(np.ascontiguousarray(rows).view(f"S{depth}").ravel(), kind="stable")]

    big = wanted & ~small & ~end
    heads = np.bincount(b[big], minlength=258)
    tails = np.bincount(b[direct], minlength=258)
    seeds = np.flatnonzero(wanted & end)
    begin = len(seeds) + np.concatenate([[0], np.cumsum(heads + tails)[:-1]])
    order = np.empty(len(seeds) + int(heads.sum() + tails.sum()), np.int64)
    order[: len(seeds)] = seeds
    c = b[direct]
    c_sorted = np.sort(c, kind="stable")
    assert np.array_equal(c, c_sorted) or len(c) == 0
    place = np.arange(len(direct)) - np.concatenate([[0], np.cumsum(tails)[:-1]])[c] + (begin + heads)[c]
    order[place] = direct
    before = np.zeros(n + 1, bool)
    before[1:] = big
    order, before, head, text = order.tolist(), before.tolist(), begin.tolist(), b.tolist()
    for j in range(len(order)):
        p = order[j]
        if before[p]:
            c = text[p - 1]
            order[head[c]] = p - 1
            head[c] += 1
    order = np.asarray(order, np.int64)
    own = off[np.searchsorted(off, order, "right") - 1]
    return order[order - own < count[np.searchsorted(off, order, "right") - 1]]


def earlier_copies(blobs: list[bytes], count: np.ndarray, rank: np.ndarray, window: int) -> np.ndarray:
    """For each window of each piece (count[j] of them, flat): whether an equal one has a smaller rank.

    rank: a number for each window, in the order of the corpus.
    """
    size = np.array([len(x) for x in blobs], np.int64)
    off = np.concatenate([[0], np.cumsum(size + 1)])
    b = np.zeros(off[-1], np.int64)
    flat = np.frombuffer(b"".join(blobs), np.uint8)
    at = np.arange(len(flat)) + np.repeat(np.arange(len(blobs)), size)
    b[at] = flat.astype(np.int64) + 1
    order = two_stage_order(b, off, count, window)
    raw = np.zeros(off[-1], np.uint8)
    raw[at] = flat
    view = np.lib.stride_tricks.sliding_window_view(raw, window)
    equal = np.zeros(len(order), bool)
    for x in range(1, len(order), 1 << 16):  # adjacent common prefixes of at least a window
        y = min(x + (1 << 16), len(order))
        equal[x:y] = (view[order[x:y]] == view[order[x - 1 : y - 1]]).all(axis=1)
    piece = np.searchsorted(off, order, "right") - 1
    flat_window = (np.cumsum(count) - count)[piece] + order - off[piece]
    starts = np.flatnonzero(~equal)
    least = np.minimum.reduceat(rank[flat_window], starts) if len(order) else rank[:0]
    gone = np.zeros(int(count.sum()), bool)
    gone[flat_window] = rank[flat_window] > np.repeat(least, np.diff(np.append(starts, len(order))))
    return gone


def _contents(window: int, hot: bool):
    """The bytes of the pieces to compare; of hot anchors, each window's fingerprints instead."""

    def run(batches):
        for batch in batches:
            for part, texts in unpacked(batch):
                for j, (text, need) in enumerate(zip(texts, part.column("need").to_pylist(), strict=True)):
                    need = [x for x in need or () if x["hot"] == hot]
                    if not need:
                        continue
                    m = len(need)
                    id_, th = part.column("_id")[j].as_py(), part.column("_th")[j].as_py()
                    if not hot:
                        own = [text[x["at"] : x["at"] + x["n"] + window - 1] for x in need]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([x["anchor"] for x in need], pa.int64()), pa.array([id_] * m, pa.int64()), pa.array([th] * m, pa.int64()), pa.array([x["at"] for x in need], pa.int32()), pa.array([x["n"] for x in need], pa.int32()), pa.array(own, pa.binary())],
                            ["anchor", "_id", "_th", "at", "n", "content"],
                        )
                        continue
                    values = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
                    at = np.concatenate([np.arange(x["at"], x["at"] + x["n"]) for x in need])
                    h = [tb.spans_hash(tb.prefix(values, w), at, at + window, w).view(np.int64) for w in (0, 1)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[0]), pa.array(h[1]), pa.array([id_] * len(at), pa.int64()), pa.array([th] * len(at), pa.int64()), pa.array(at.astype(np.int32))],
                        ["h1", "h2", "_id", "_th", "at"],
                    )

    return run


_GONE = "_id long, _th long, at int, n int"


def _sorted(window: int):
    """Two-stage sorting of the pieces of whole anchors; gives the windows that stand earlier too."""

    def flush(rows):
        blobs = [x for r in rows for x in r[5]]
        anchor, id_, th, at, n = (np.concatenate([r[c] for r in rows]) for c in range(5))
        doc = np.empty(len(id_), np.int64)
        order = np.lexsort((th, id_))
        new = np.concatenate([[True], (id_[order][1:] != id_[order][:-1]) | (th[order][1:] != th[order][:-1])])
        doc[order] = np.cumsum(new)
        n64 = n.astype(np.int64)
        piece = np.repeat(np.arange(len(n64)), n64)
        place = np.arange(len(piece)) - np.repeat(np.cumsum(n64) - n64, n64) + at[piece]
        gone = earlier_copies(blobs, n64, (doc[piece] << 32) | place, window)
        edge = np.concatenate([[True], piece[1:] != piece[:-1]])
        begins = np.flatnonzero(gone & (edge | ~np.concatenate([[False], gone[:-1]])))
        ends = np.flatnonzero(gone & (np.concatenate([edge[1:], [True]]) | ~np.concatenate([gone[1:], [False]])))
        own = piece[begins]
        return pa.RecordBatch.from_arrays([pa.array(id_[own]), pa.array(th[own]), pa.array(place[begins].astype(np.int32)), pa.array((ends - begins + 1).astype(np.int32))], ["_id", "_th", "at", "n"])

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("anchor", "_id", "_th", "at", "n")]
            blobs = batch.column("content").to_pylist()
            if not blobs:
                continue
            cuts = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]])).tolist() + [len(blobs)]
            for x, y in zip(cuts, cuts[1:]):
                if held >= SORT_BYTES and rows[-1][0][-1] != cols[0][x]:
                    yield flush(rows)
                    rows, held = [], 0
                rows.append([c[x:y] for c in cols] + [blobs[x:y]])
                held += sum(map(len, blobs[x:y]))
        if rows:
            yield flush(rows)

    return run


def _removed(window: int):
    def run(batches):
        for batch in batches:
            for part, texts in unpacked(batch):
                n, spans, sha = [], [], []
                for text, one, two in zip(texts, part.column("gone").to_pylist(), part.column("more").to_pylist(), strict=True):
                    step = np.zeros(len(text) + 1, np.int64)
                    for x in (*(one or ()), *(two or ())):
                        step[x["at"]] += 1
                        step[x["at"] + x["n"] + window - 1] -= 1
                    mask = np.cumsum(step)[:-1] > 0
                    n.append(int(mask.sum()))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in _spans_of(mask)])
                    sha.append(hashlib.sha256(np.frombuffer(text, np.uint8)[~mask].tobytes()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_th"), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(sha, pa.string())],
                    ["_id", "_th", "n_removed", "spans", "left_sha256"],
                )

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        b, off = tb.flat(batch.column("text"))
        sha = [hashlib.sha256(b[off[i] : off[i + 1]]).hexdigest() for i in range(len(batch))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "_id", "_th")), pa.array(np.diff(off)), pa.array(sha, pa.string())], ["doc_id", "_id", "_th", "n_bytes", "whole_sha256"])


def earlier_passages(docs: DataFrame, window: int = 100) -> DataFrame:
    """Each row of docs (doc_id, text) with n_bytes, n_removed, n_spans, spans (byte ranges) and kept_sha256.

    A byte is removed when a string of `window` bytes over it also starts earlier: in a smaller doc_id, or earlier in
    the same document. Windows are grouped by their anchor (the k-gram with the least fingerprint), and equal windows
    have equal anchors. Runs of windows with one anchor are pieces; of equal pieces all but the first are gone, and
    batches combine them before the shuffle. Only anchors with several unlike pieces are suffix-sorted, whole anchors
    to a task, with the two-stage method and adjacent common prefixes; an anchor with more than SORT_PIECES pieces is
    spread over the cluster by its windows' fingerprints instead. Work beyond the first pass follows what repeats.

    Null texts are empty. Rows alike in doc_id and text are one document; a null doc_id counts as smaller than any
    other, and documents that share a doc_id go by a hash of their text. Other columns are ignored; no rows give none.
    """
    base = docs.select(F.col("doc_id"), *text_key(), "text")
    occ = base.select("_id", "_th", "text").mapInArrow(_pieces(window), _OCC).repartition("anchor").sortWithinPartitions("anchor", "piece", "_id", "_th", "at")
    found = keep(occ.mapInArrow(_firsts, _OCC), "pieces")
    needed = found.where("not gone").select("anchor", "_id", "_th", "at", "n").distinct()
    hot = needed.groupBy("anchor").count().where(F.col("count") > SORT_PIECES).select("anchor", F.lit(True).alias("hot"))
    needed = needed.join(hot, "anchor", "left").select("_id", "_th", F.struct("anchor", "at", "n", F.coalesce("hot", F.lit(False)).alias("hot")).alias("need"), F.lit(None).cast("struct<at: int, n: int>").alias("gone"))
    lost = found.where("gone").select("_id", "_th", F.lit(None).cast("struct<anchor: long, at: int, n: int, hot: boolean>").alias("need"), F.struct("at", "n").alias("gone"))
    each = needed.unionByName(lost).groupBy("_id", "_th").agg(F.collect_list("need").alias("need"), F.collect_list("gone").alias("gone"))
    texts = base.select("_id", "_th", "text").mapInArrow(packed, "_id long, _th long, ztext binary")
    texts = keep(texts.join(each.hint("merge"), ["_id", "_th"]).dropDuplicates(["_id", "_th"]), "repeating-texts")

    pieces = texts.mapInArrow(_contents(window, False), "anchor long, _id long, _th long, at int, n int, content binary")
    more = pieces.repartition("anchor").sortWithinPartitions("anchor", "_id", "_th", "at").mapInArrow(_sorted(window), _GONE)
    windows = texts.mapInArrow(_contents(window, True), "h1 long, h2 long, _id long, _th long, at int")
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("_id", "_th", "at")).alias("first"), F.count("*").alias("c")).where("c > 1")
    late = windows.join(first, ["h1", "h2"]).where("struct(_id, _th, at) > first").select("_id", "_th", "at", F.lit(1).alias("n"))
    more = more.unionByName(late).groupBy("_id", "_th").agg(F.collect_list(F.struct("at", "n")).alias("more"))
    cut = texts.join(more, ["_id", "_th"], "left").select("_id", "_th", "ztext", "gone", "more")
    cut = cut.mapInArrow(_removed(window), "_id long, _th long, n_removed long, spans array<struct<start: long, end: long>>, left_sha256 string")
    whole = base.mapInArrow(_whole, "doc_id long, _id long, _th long, n_bytes long, whole_sha256 string")
    zero = F.lit(0).cast("long")
    return whole.join(cut, ["_id", "_th"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce(F.size("spans").cast("long"), zero).alias("n_spans"),
        F.coalesce("left_sha256", "whole_sha256").alias("kept_sha256"),
        "spans",
    )
