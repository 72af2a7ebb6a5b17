"""Near-duplicate documents by an LSH forest of MinHash signatures, confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import textbytes as tb
from lectern.llm.common import keep, text_key
from lectern.llm.components import components
from lectern.llm.word_repeats import packed

TREES = 32
#: Hashes that two documents must share at the head of a tree's key to be neighbours, and those that order a region.
MIN_DEPTH, MORE_DEPTH = 5, 3
#: Neighbours on either side, in each tree's sorted order: those that share the longest prefix stand next to each other.
#: Members of a region with more are crowded, and are also compared by prefix filtering (`_crowded_pairs`).
NEIGHBOURS = 4
#: Hashes in the sketch that estimates a pair's similarity, and standard deviations below the threshold still verified.
SKETCH, SLACK = 128, 6

#: Rows at either end of a partition: as many as a run that is longer than the window needs on one side.
_ENDS = NEIGHBOURS + 1
_DEPTH = MIN_DEPTH + MORE_DEPTH
_KEY = 8 + 2 * MORE_DEPTH
_rng = np.random.default_rng(20240229)
_MUL = (_rng.integers(0, 2**32, TREES * _DEPTH, dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
_ADD = _rng.integers(0, 2**32, TREES * _DEPTH, dtype=np.uint32)


def shingle_sets(b: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints of each document's word shingles, A-Z taken as a-z, and where each set begins.

    A document with fewer words has its whole sequence as its one shingle; without words the set is empty. Fingerprints
    have 64 bits: a text of a million words has two alike with probability 3e-8. At most 65 536 documents at a time.
    """
    s, e, wo = tb.word_bounds(b, off)
    wh = tb.word_hashes(b, s, e, lower=True)
    pre = tb.prefix(wh, 1)
    count = np.diff(wo)
    doc = tb.doc_of(wo, len(wh))
    i = np.arange(len(wh))
    last = wo[1:][doc] if len(wh) else i
    short = count[doc] < words if len(wh) else np.zeros(0, bool)
    take = np.where(short, i == wo[:-1][doc] if len(wh) else False, i + words <= last)
    i = np.flatnonzero(take)
    sh = tb.spans_hash(pre, i, np.minimum(i + words, last[i]), 1)
    d = doc[i]
    order = np.argsort(sh)
    order = order[np.argsort(d[order].astype(np.uint16), kind="stable")]
    d, sh = d[order], sh[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (d[1:] != d[:-1])
    return sh[new], np.searchsorted(d[new], np.arange(len(off)))


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            size, lo, hi = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            trees, sketch = np.zeros((n, TREES, _KEY), np.uint8), np.zeros((n, SKETCH), np.uint8)
            for first, stop, b, off in _small(batch.column("text")):
                sets, at = shingle_sets(b, off, words)
                have = np.flatnonzero(np.diff(at))
                size[first:stop] = np.diff(at)
                if not len(have):
                    continue
                heads, rows = at[:-1][have], first + have
                lo[rows] = np.add.reduceat(tb.mix(sets ^ np.uint64(0xA5A5A5A5A5A5)), heads)
                hi[rows] = np.add.reduceat(tb.mix(sets + np.uint64(0x5851F42D4C957F2D)), heads)
                h = (tb.mix(sets) >> np.uint64(32)).astype(np.uint32)
                sig = np.empty((len(have), len(_MUL)), np.uint32)
                v = np.empty_like(h)
                for j in range(len(_MUL)):
                    np.multiply(h, _MUL[j], out=v)
                    v += _ADD[j]
                    sig[:, j] = np.minimum.reduceat(v, heads)
                t = sig.reshape(len(have), TREES, _DEPTH)
                region = np.zeros((len(have), TREES), np.uint64)
                for j in range(MIN_DEPTH):
                    region = tb.mix(region + t[:, :, j] + np.uint64(j))
                trees[rows, :, :8] = region.astype(">u8").view(np.uint8).reshape(len(have), TREES, 8)
                deep = np.ascontiguousarray((t[:, :, MIN_DEPTH:] >> np.uint32(16)).astype(">u2"))
                trees[rows, :, 8:] = deep.view(np.uint8).reshape(len(have), TREES, 2 * MORE_DEPTH)
                sketch[rows] = (tb.mix(sig[:, :SKETCH].astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "_id", "_th")), pa.array(size), pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64)), _fixed(trees.reshape(n, -1)), _fixed(sketch)],
                ["doc_id", "_id", "_th", "n_shingles", "set_lo", "set_hi", "trees", "sketch"],
            )

    return run


def _small(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """tb.chunks of at most 2048 documents each."""
    for at in range(0, len(col), 2048):
        for first, stop, b, off in tb.chunks(col.slice(at, 2048)):
            yield at + first, at + stop, b, off


def _fixed(m: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    n, width = m.shape
    off = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(m))])


def _bytes(col: pa.Array, width: int) -> np.ndarray:
    b, off = tb.flat(col)
    return b[off[0] : off[-1]].reshape(-1, width)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each tree that a class stands in."""
    for batch in batches:
        for at in range(0, len(batch), 4096):
            part = batch.slice(at, 4096)
            trees = _bytes(part.column("trees"), TREES * _KEY)
            n = len(trees)
            key = trees.reshape(n * TREES, _KEY)
            tree = np.tile(np.arange(TREES, dtype=np.int32), n)
            node = np.repeat(part.column("node").to_numpy(), TREES)
            yield pa.RecordBatch.from_arrays([pa.array(tree), _fixed(key), pa.array(node)], ["tree", "key", "node"])


def _neighbours(edges_too: bool):
    """Pairs of a sorted run that share MIN_DEPTH hashes and stand within NEIGHBOURS places (tree -1).

    Also, as tree -2, each member of a region with more members than the window reaches, and with edges_too the first
    and last rows of the partition, for what straddles two partitions. A pair is dense where both ends are such members.
    """

    def crowded(tree, region, node):
        w = NEIGHBOURS + 1
        far = np.flatnonzero((region[w:] == region[:-w]) & (tree[w:] == tree[:-w])) if len(node) > w else np.zeros(0, int)
        return np.unique(node[(far[:, None] + np.arange(w + 1)).ravel()])

    def pairs(tree, region, node, many):
        out, full = [], np.isin(node, many)
        for w in range(1, NEIGHBOURS + 1):
            near = np.flatnonzero((region[w:] == region[:-w]) & (tree[w:] == tree[:-w]) & (node[w:] != node[:-w])) if len(node) > w else np.zeros(0, int)
            out.append((np.minimum(node[near], node[near + w]), np.maximum(node[near], node[near + w]), (tree[near] < 2) & (w == 1), full[near] & full[near + w]))
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    def rows(a, b, early, dense, tree=None, key=None):
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(b), pa.array(early), pa.array(dense), pa.array(tree if tree is not None else np.full(n, -1, np.int32)), key if key is not None else pa.nulls(n, pa.binary())],
            ["a", "b", "early", "dense", "tree", "key"],
        )

    def run(batches):
        held, head = None, None
        for batch in batches:
            new = (batch.column("tree").to_numpy(), _bytes(batch.column("key"), _KEY), batch.column("node").to_numpy())
            if not len(new[0]):
                continue
            head = new if head is None else tuple(np.concatenate([x, y])[:_ENDS] for x, y in zip(head, new, strict=True)) if len(head[0]) < _ENDS else head
            head = tuple(x[:_ENDS] for x in head)
            own = new if held is None else tuple(np.concatenate([x, y]) for x, y in zip(held, new, strict=True))
            region = np.ascontiguousarray(own[1][:, :8]).view(np.uint64).ravel()
            many = crowded(own[0], region, own[2])
            yield rows(*pairs(own[0], region, own[2], many))
            no = np.zeros(len(many), bool)
            yield rows(many, many, no, no, np.full(len(many), -2, np.int32))
            held = tuple(x[-_ENDS:] for x in own)
        if edges_too and held is not None:
            for tree, key, node in (head, held):
                no = np.zeros(len(node), bool)
                yield rows(node, node, no, no, tree, _fixed(key))

    return run


_PAIRS = "a long, b long, early boolean, dense boolean, tree int, key binary"


def _likely(threshold: float):
    """Pairs whose sketches agree about as often as a pair at the threshold's would."""
    t = threshold + (1 - threshold) / 256
    least = SKETCH * (t - SLACK * (t * (1 - t) / SKETCH) ** 0.5)

    def run(batches):
        for batch in batches:
            x, y = _bytes(batch.column("sa"), SKETCH), _bytes(batch.column("sb"), SKETCH)
            good = pa.array((x == y).sum(axis=1) >= least)
            yield batch.select(["a", "b", "early", "dense"]).filter(good)

    return run


def _confirmed(words: int, percent: int):
    def sets(z, col):
        texts = [z.decompress(x) for x in col.to_pylist()]
        out = []
        for _, _, b, off in _small(pa.array(texts, pa.large_binary())):
            s, at = shingle_sets(b, off, words)
            out += [s[at[i] : at[i + 1]] for i in range(len(off) - 1)]
        return out

    def run(batches):
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                good = []
                for x, y in zip(sets(z, part.column("za")), sets(z, part.column("zb")), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * both >= percent * (len(x) + len(y) - both) > 0)
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _shingles(words: int):
    """One row for each shingle of a crowded class."""

    def run(batches):
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                texts = pa.array([z.decompress(x) for x in part.column("ztext").to_pylist()], pa.large_binary())
                for first, stop, b, off in _small(texts):
                    s, begins = shingle_sets(b, off, words)
                    n = np.diff(begins)
                    of = np.repeat(np.arange(first, stop), n)
                    own = [pa.array(part.column(c).to_numpy()[of]) for c in ("node", "component")]
                    yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int64)), *own, pa.array(n[of - first])], ["shingle", "node", "component", "n"])

    return run


def _crowded_pairs(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): every pair of texts (node, component, ztext) in unlike components that may reach the threshold.

    Prefix filtering: in one order of all shingles, two sets of n and more shingles with a similarity t or more share
    one of the first n - ceil(2t/(1+t) n) + 1 of the smaller and the first m - ceil(t m) + 1 of the larger. Shingles
    of one component alone come first, as they link nothing, then the rarest; so what a template's texts share comes
    last, and a group that is connected already drops out. A pair's first common shingle also leaves room enough behind
    it, in both sets, for all that they must have in common: texts of one template that each have too much of their own
    are told from it within the join, and are no candidates.
    """
    s = texts.mapInArrow(_shingles(words), "shingle long, node long, component long, n long")
    shared = s.groupBy("shingle").agg(F.count("*").alias("f"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("shingle", "f")
    w = Window.partitionBy("node")
    own = s.join(shared, "shingle").withColumn("place", F.col("n") - F.count("*").over(w) + F.row_number().over(w.orderBy("f", "shingle")))
    more = own.where(f"place <= n - (({percent} * n + 99) div 100) + 1")
    fewer = more.where(f"place <= n - (({2 * percent} * n + {99 + percent}) div {100 + percent}) + 1")
    x, y = (d.select("shingle", *[F.col(c).alias(f"{c}{k}") for c in ("node", "component", "n", "place")]) for d, k in ((fewer, 1), (more, 2)))
    common = f"(({percent} * (n1 + n2) + {99 + percent}) div {100 + percent})"
    pairs = x.join(y, "shingle").where(f"component1 <> component2 and (n1 < n2 or n1 = n2 and node1 < node2) and 100 * n1 >= {percent} * n2 and n1 - place1 + 1 >= {common} and n2 - place2 + 1 >= {common}")
    return pairs.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Each row of docs (doc_id, text) with n_shingles, component_id, kept, text_hash, first.

    Two documents are linked when their sets of `words`-word shingles have a Jaccard similarity of percent/100 or
    more; component_id is the smallest doc_id reachable over links and kept says whether the row has that doc_id.

    Equal sets form one class first, so a group of copies of any size is one member of the forest. Classes stand in
    TREES sorted orders of MinHash prefixes (one range-partitioned sort, so no prefix is a hot key); neighbours with
    at least MIN_DEPTH shared hashes are candidates, a sketch drops the unlikely, and the rest are confirmed on the
    full sets: a first wave with the nearest neighbours, then the pairs that the first wave has not yet connected. Of a
    region with more members than the window reaches only such pairs are looked at at all.
    Where more classes share the MIN_DEPTH hashes than the window reaches, their members in unlike components are
    compared by prefix filtering, which is exact. A pair at exactly 0.8 is missed with probability 3e-6.

    Null or wordless texts have n_shingles 0 and stay alone. A null doc_id counts as smaller than any other and its
    component_id is null. Rows repeated whole share a class. `first` marks one document of each component where several
    have its smallest doc_id (or none): that whose text has the smallest hash (text_hash); rows repeated whole are all
    first. Other columns are ignored; no rows give no rows.
    """
    base = docs.select("doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(), "text")
    sig = keep(base.mapInArrow(_signatures(words), "doc_id long, _id long, _th long, n_shingles long, set_lo long, set_hi long, trees binary, sketch binary"), "signatures")
    same = ["n_shingles", "set_lo", "set_hi"]
    classes = sig.where("n_shingles > 0").groupBy(*same).agg(F.min(F.struct("_id", "_th")).alias("first"))
    classes = keep(classes.select(*same, F.xxhash64(*same).alias("node"), F.col("first._id").alias("first_id"), F.col("first._th").alias("first_th")), "classes")
    reps = keep(sig.join(classes, [*same]).where("_id = first_id and _th = first_th").select("node", "trees", "sketch"), "representatives")
    forest = reps.mapInArrow(_forest, "tree int, key binary, node long").repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    found = keep(forest.mapInArrow(_neighbours(True), _PAIRS), "neighbours")
    ends = found.where("tree >= 0").select("tree", "key", F.col("a").alias("node")).distinct().coalesce(1).sortWithinPartitions("tree", "key", "node")
    found = found.where("tree < 0").unionByName(ends.mapInArrow(_neighbours(False), _PAIRS))
    pairs = keep(found.where("tree = -1").groupBy("a", "b").agg(F.max("early").alias("early"), F.max("dense").alias("dense")), "pairs")
    crowded = keep(found.where("tree = -2").select(F.col("a").alias("node")).distinct(), "crowded")
    sketch = reps.select("node", "sketch").dropDuplicates(["node"])

    def promising(pairs: DataFrame, name: str) -> DataFrame:
        p = pairs.join(sketch.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").join(sketch.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
        return keep(p.select("a", "b", "early", "dense", "sa", "sb").mapInArrow(_likely(percent / 100), "a long, b long, early boolean, dense boolean"), name)

    likely = promising(pairs.where("early or not dense"), "likely")
    # both ends of a dense pair are crowded, so a large group adds each of its classes once, not once for each pair
    members = likely.where("not dense").select(F.explode(F.array("a", "b")).alias("node")).unionByName(crowded).distinct()
    members = members.join(classes, "node").select("node", F.col("first_id").alias("_id"), F.col("first_th").alias("_th"))
    texts = base.select("_id", "_th", "text").mapInArrow(packed, "_id long, _th long, ztext binary").join(members.hint("merge"), ["_id", "_th"])
    texts = keep(texts.select("node", "ztext").dropDuplicates(["node"]), "texts")
    left, right = texts.select(F.col("node").alias("a"), F.col("ztext").alias("za")), texts.select(F.col("node").alias("b"), F.col("ztext").alias("zb"))

    def confirm(pairs: DataFrame) -> DataFrame:
        return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "za", "zb").mapInArrow(_confirmed(words, percent), "a long, b long")

    first = keep(confirm(likely.where("early")), "links")
    label = components(first)

    def apart(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(label.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side, "left")
        return pairs.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b", "early", "dense")

    later = promising(apart(pairs.where("dense and not early")), "dense-likely").unionByName(apart(likely.where("not early")))
    label = components(first.unionByName(confirm(later)))

    if not crowded.isEmpty():
        full = texts.join(crowded, "node").join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "ztext")
        late = promising(_crowded_pairs(full, words, percent).select("*", F.lit(False).alias("early"), F.lit(True).alias("dense")), "crowded-likely")
        if not late.isEmpty():
            label = components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(confirm(late)))

    of = keep(classes.join(label, "node", "left").select(*same, "first_id", "first_th", F.coalesce("component", "node").alias("root")), "roots")
    least = of.groupBy("root").agg(F.min(F.struct("first_id", "first_th")).alias("least"))
    of = of.join(least, "root").select(*same, "least")
    out = sig.select("doc_id", "_id", "_th", *same).join(of, same, "left")
    component = F.coalesce(F.col("least.first_id"), F.col("_id"))
    null = F.lit(None).cast("long")
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(component == -(2**63), null).otherwise(component).alias("component_id"),
        (F.col("_id") == component).alias("kept"),
        F.col("_th").alias("text_hash"),
        ((F.col("_id") == component) & (F.col("_th") == F.coalesce(F.col("least.first_th"), F.col("_th")))).alias("first"),
    )
