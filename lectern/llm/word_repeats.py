"""Long passages repeated across documents, by compaction of a de Bruijn graph over sampled word k-mers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import textbytes as tb
from lectern.llm.common import keep, text_key

#: Words of a node. Every window holds at least one node: the k-mer with the least fingerprint in it.
NODE_WORDS = 8

_START, _END = np.uint64(0x1B873593CC9E2D51), np.uint64(0x38B34AE5E6546B64)


class _Graph:
    """The nodes of a chunk of documents, in order, with the word positions and windows they stand for."""

    def __init__(self, b: np.ndarray, off: np.ndarray, window: int):
        self.s, self.e, self.wo = tb.word_bounds(b, off)
        self.words = tb.word_hashes(b, self.s, self.e)
        self.pre = tb.prefix(self.words, 1)
        k = self.k = min(NODE_WORDS, window)
        i = np.arange(len(self.words))
        self.grams = tb.spans_hash(self.pre, i, np.minimum(i + k, len(i)), 1)
        self.win, at = tb.minimizers(self.grams, self.wo, k, window)
        self.nodes, self.node_of = np.unique(at, return_inverse=True)
        doc = self.doc = np.searchsorted(self.wo, self.nodes, "right") - 1
        n = len(self.nodes)
        self.first = np.ones(n, bool)
        self.first[1:] = doc[1:] != doc[:-1]
        self.last = np.ones(n, bool)
        self.last[:-1] = self.first[1:]
        lo, hi = self.wo[:-1][doc], self.wo[1:][doc]
        #: Where the path to the previous node (or the document's start) begins, and the one to the next node ends.
        self.left = np.where(self.first, lo, np.roll(self.nodes, 1))
        self.right = np.where(self.last, hi, np.roll(self.nodes, -1) + k)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of the edges into and out of each node: the words from node to node, both included."""
        into = tb.spans_hash(self.pre, self.left, self.nodes + self.k, 1) ^ np.where(self.first, _START, np.uint64(0))
        out = tb.spans_hash(self.pre, self.nodes, self.right, 1) ^ np.where(self.last, _END, np.uint64(0))
        return into, out

    def paths(self, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each node, the words that its compacted path covers: along plain nodes and the edges at both ends."""
        n = np.arange(len(self.nodes))
        begins = ~plain | self.first | ~np.roll(plain, 1)
        x = np.maximum.accumulate(np.where(begins, n, 0)) if len(n) else n
        ends = ~plain | self.last | ~np.roll(plain, -1)
        y = np.minimum.accumulate(np.where(ends, n, len(n))[::-1])[::-1] if len(n) else n
        return self.left[x], self.right[y]


def _nodes(window: int, edges: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, b, off in tb.chunks(batch.column("text")):
                g = _Graph(b, off, window)
                node = pa.array(g.grams[g.nodes].view(np.int64))
                if edges:
                    into, out = g.edges()
                    yield pa.RecordBatch.from_arrays([node, pa.array(into.view(np.int64)), pa.array(out.view(np.int64))], ["node", "into", "out"])
                else:
                    rows = pa.array(g.doc)
                    part = batch.slice(first, stop - first)
                    at = pa.array((g.nodes - g.wo[:-1][g.doc]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([node, part.column("_id").take(rows), part.column("_th").take(rows), at], ["node", "_id", "_th", "at"])

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words and the digest of all of them, for every document."""
    for batch in batches:
        b, off = tb.flat(batch.column("text"))
        n, sha = [], []
        for i in range(len(batch)):
            words = b[off[i] : off[i + 1]].tobytes().split()
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "_id", "_th")), pa.array(n, pa.int64()), pa.array(sha, pa.string())],
            ["doc_id", "_id", "_th", "n_words", "whole_sha256"],
        )


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for their one shuffle."""
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        b, off = tb.flat(batch.column("text"))
        own = [z.compress(b[off[i] : off[i + 1]].tobytes()) for i in range(len(batch))]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_th"), pa.array(own, pa.binary())], ["_id", "_th", "ztext"])


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    z = zstandard.ZstdDecompressor()
    for at in range(0, len(batch), 64):
        part = batch.slice(at, 64)
        yield part, [z.decompress(x) for x in part.column("ztext").to_pylist()]


def _decided(window: int, part: pa.RecordBatch, texts: list[bytes]):
    """Chunks of a batch with, for each window: whether its path already shows it repeated, and whether it may be."""
    marks = part.column("marks")
    at, flags = marks.offsets.to_numpy(), marks.values.to_numpy(zero_copy_only=False)
    for first, stop, b, off in tb.chunks(pa.array(texts, pa.large_binary())):
        g = _Graph(b, off, window)
        mark = np.zeros(len(g.words) + 1, np.int8)
        for j in range(first, stop):
            own = flags[at[j] : at[j + 1]]
            mark[g.wo[j - first] + (own >> 1)] = 1 + (own & 1)
        seen = mark[g.nodes]
        left, right = g.paths(seen == 2)
        n = g.node_of
        sure = (seen[n] == 2) & (g.win >= left[n]) & (g.win + window <= right[n])
        yield first, stop, g, sure, (seen[n] > 0) & ~sure


def _open_windows(window: int):
    """Fingerprints of the windows that no compacted path decides."""

    def run(batches):
        for batch in batches:
            for part, texts in unpacked(batch):
                blob = pa.array(texts, pa.large_binary())
                for first, stop, g, _, maybe in _decided(window, part, texts):
                    i = g.win[maybe]
                    data, off = tb.flat(blob.slice(first, stop - first))
                    other = tb.prefix(tb.word_hashes(data[off[0] : off[-1]], g.s, g.e, which=1), 0)
                    doc = np.searchsorted(g.wo, i, "right") - 1
                    rows = pa.array(doc + first)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(tb.spans_hash(g.pre, i, i + window, 1).view(np.int64)), pa.array(tb.spans_hash(other, i, i + window, 0).view(np.int64)), part.column("_id").take(rows), part.column("_th").take(rows), pa.array((i - g.wo[:-1][doc]).astype(np.int32))],
                        ["h1", "h2", "_id", "_th", "at"],
                    )

    return run


def _removed(window: int):
    """The spans to remove from each document that shares something, and the digest of what is left."""

    def run(batches):
        for batch in batches:
            for part, texts in unpacked(batch):
                starts = part.column("starts").to_pylist()
                n, spans, sha = [], [], []
                for first, stop, g, sure, _ in _decided(window, part, texts):
                    step = np.zeros(len(g.words) + 1, np.int64)
                    hit = [g.win[sure]] + [np.asarray(starts[j] or [], np.int64) + g.wo[j - first] for j in range(first, stop)]
                    hit = np.unique(np.concatenate(hit))
                    step[hit] += 1
                    step[hit + window] -= 1
                    gone = np.cumsum(step)[:-1] > 0
                    for j in range(first, stop):
                        own = gone[g.wo[j - first] : g.wo[j - first + 1]]
                        words = texts[j].split()
                        n.append(int(own.sum()))
                        turn = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                        spans.append([{"start": int(x), "end": int(y)} for x, y in turn.reshape(-1, 2)])
                        sha.append(hashlib.sha256(b" ".join([w for w, x in zip(words, own.tolist(), strict=True) if not x])).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_th"), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(sha, pa.string())],
                    ["_id", "_th", "n_removed", "spans", "left_sha256"],
                )

    return run


def repeated_passages(docs: DataFrame, window: int = 35) -> DataFrame:
    """Each row of docs (doc_id, text) with n_words, n_removed, spans (word ranges, end exclusive) and kept_sha256.

    A word is removed when a window of `window` words over it starts anywhere else too, in its own or another
    document. Nodes of the graph are sampled k-mers (the least fingerprint of each window), edges the words from one
    node to the next. A node met at least twice with one edge in and one edge out everywhere lies on a nonbranching
    path; grouping nodes and joining their degrees back compacts such paths, and every window inside one is repeated
    wherever it stands. Windows at branches and path ends are verified by 128-bit fingerprints of all their words at
    their source coordinates. Node and window counts combine before the shuffle; common ones meet their one-row
    counts in joins that adaptive execution may split.

    Null and short texts keep all their words. Rows alike in doc_id and text are two documents that repeat each
    other. Other columns are ignored; no rows give no rows.
    """
    base = docs.select(F.col("doc_id"), *text_key(), "text")
    nodes = base.select("text").mapInArrow(_nodes(window, True), "node long, into long, out long").groupBy("node")
    plain = (F.col("i0") == F.col("i1")) & (F.col("o0") == F.col("o1"))
    nodes = nodes.agg(F.count("*").alias("c"), F.min("into").alias("i0"), F.max("into").alias("i1"), F.min("out").alias("o0"), F.max("out").alias("o1")).where("c > 1")
    nodes = nodes.select("node", plain.cast("int").alias("plain"))
    met = base.select("_id", "_th", "text").mapInArrow(_nodes(window, False), "node long, _id long, _th long, at int").join(nodes, "node")
    marks = met.groupBy("_id", "_th").agg(F.collect_list((F.col("at") * 2 + F.col("plain")).cast("int")).alias("marks"))
    texts = base.select("_id", "_th", "text").mapInArrow(packed, "_id long, _th long, ztext binary").join(marks.hint("merge"), ["_id", "_th"])
    texts = keep(texts, "shared-texts")
    open_ = texts.mapInArrow(_open_windows(window), "h1 long, h2 long, _id long, _th long, at int")
    twice = open_.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    starts = open_.join(twice, ["h1", "h2"]).groupBy("_id", "_th").agg(F.collect_set("at").alias("starts"))
    cut = texts.join(starts, ["_id", "_th"], "left").select("_id", "_th", "ztext", "marks", "starts")
    cut = cut.mapInArrow(_removed(window), "_id long, _th long, n_removed long, spans array<struct<start: long, end: long>>, left_sha256 string").dropDuplicates(["_id", "_th"])
    whole = base.mapInArrow(_whole, "doc_id long, _id long, _th long, n_words long, whole_sha256 string")
    return whole.join(cut, ["_id", "_th"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("left_sha256", "whole_sha256").alias("kept_sha256"),
        "spans",
    )
