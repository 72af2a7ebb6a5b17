"""Packing documents into sequences of a fixed length, by a grouping genetic algorithm on islands."""

from __future__ import annotations

import functools
import json
import random
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import textbytes as tb
from lectern.llm.common import keep

#: Items that evolve together, islands for each such group, times that elites move on, and crossovers between moves.
GROUP, ISLANDS, MOVES, CROSSOVERS = 4096, 3, 3, 40
#: Solutions that an island keeps.
POPULATION = 8
#: Words, and pieces of them, whose ids a worker remembers: as many again stay until the newer ones fill up.
_WORDS, _PIECES = 150_000, 300_000


# The normaliser and the splitter whose effect on plain words is worked out here. A file with others is
# applied to whole texts.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: The same pieces where all characters are plain: letters, digits one by one, runs of other signs.
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_²³¹¼½¾]+|[0-9²³¹¼½¾]|(?:[^\\w\\s]|[_\x1c-\x1f])+")
#: Texts of these characters only are normalised by lower() alone (beyond them: composition and special cases).
_PLAIN = re.compile("[\x00-\u012f\u0131-\u017f]*")


def _byte_signs() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: its own if it is printable in Latin-1."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b if b in own else spare)
        spare += b not in own
    return out


class _Recent(dict):
    """A memory of fn's results: what is asked for stays; of two generations the older goes when the newer is full."""

    def __init__(self, fn, before: dict | None = None):
        super().__init__()
        self.fn, self.before = fn, before or {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.fn(key)
        self[key] = value
        return value

    def aged(self, most: int) -> _Recent:
        if len(self) <= most:
            return self
        self.before = {}
        return _Recent(self.fn, self)


class _Ids:
    """Token ids as little-endian 32-bit bytes, word by word: this tokenizer never joins across white space.

    Words of plain characters are cut into pieces here, and only pieces not met before go to the tokenizer's merges;
    other words go to the whole tokenizer. Both give what it gives for the whole text. A tokenizer with another
    normaliser or splitter, or a text that spells a special token, is applied to the whole text.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_word = spec.get("normalizer") == _NORMALIZER and split[0].get("pattern") == {"Regex": _SPLIT} and [x.get("type") for x in split] == ["Split", "ByteLevel"]
        self.special = [x["content"].encode() for x in spec["added_tokens"]]
        self.merge = self.tokenizer.model.tokenize
        self.signs = _byte_signs()
        self.words = _Recent(self._word)
        self.pieces = _Recent(self._piece)

    def encode(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if not (word.isascii() or _PLAIN.fullmatch(text)):
            return self.encode(text)
        text = text.lower()
        if text.isalpha():
            return self.pieces[text]
        if text[:-1].isalpha() and text[-1] in ".,;:!?)":
            return self.pieces[text[:-1]] + self.pieces[text[-1]]
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text)))

    def _piece(self, piece: str) -> bytes:
        plain = piece.isascii() and piece.isprintable()
        own = self.merge(piece if plain else "".join(map(self.signs.__getitem__, piece.encode())))
        return np.array([x.id for x in own], "<u4").tobytes() if len(own) > 8 else b"".join([x.id.to_bytes(4, "little") for x in own])

    def __call__(self, text: bytes) -> bytes:
        if not self.by_word or any(x in text for x in self.special):
            return self.encode(text.decode())
        out = b"".join(map(self.words.__getitem__, text.lower().split()))
        self.words, self.pieces = self.words.aged(_WORDS), self.pieces.aged(_PIECES)
        return out


@functools.lru_cache(maxsize=2)
def _ids(path: str) -> _Ids:
    """One memory for all tasks that a worker runs."""
    return _Ids(path)


def _tokenized(path: str, length: int, end: int, carried: list[str]):
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(path)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                b, off = tb.flat(part.column("text"))
                texts = [b[off[i] : off[i + 1]].tobytes() for i in range(len(part))]
                rows, piece, start, size, crc = [], [], [], [], []
                for i, text in enumerate(texts):
                    own = ids(text) + last
                    for j in range(0, len(own), 4 * length):
                        x = own[j : j + 4 * length]
                        rows.append(i)
                        piece.append(j // (4 * length))
                        start.append(j // 4)
                        size.append(len(x) // 4)
                        crc.append(zlib.crc32(x))
                kept = [part.column(c).take(pa.array(rows, pa.int64())) for c in carried]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                    [*carried, "piece", "start", "length", "ids_crc32"],
                )

    return run


class _Bins:
    """A packing in the making: which bin each item is in, and bins in the order of the room they have left."""

    def __init__(self, sizes: list[int], length: int):
        self.sizes, self.length = sizes, length
        self.items: list[list[int]] = []
        self.room: list[tuple[int, int]] = []

    def add(self, items: list[int]) -> None:
        insort(self.room, (self.length - sum(self.sizes[i] for i in items), len(self.items)))
        self.items.append(list(items))

    def fit(self, i: int) -> None:
        """Put an item where it leaves the least room, or in a bin of its own."""
        at = bisect_left(self.room, (self.sizes[i], -1))
        if at == len(self.room):
            self.add([i])
            return
        room, own = self.room.pop(at)
        self.items[own].append(i)
        insort(self.room, (room - self.sizes[i], own))

    def exchange(self, displaced: list[int]) -> list[int]:
        """Displaced items for smaller ones: each bin with room gives up what lets longer displaced ones fill it better.

        One item goes out for one longer, or two for one, or in bins of up to four items for two, that are longer together,
        never beyond the room left.
        """
        sizes = self.sizes
        out = sorted((sizes[i], i) for i in displaced)
        for at in range(len(self.room) - 1, -1, -1):
            room, own = self.room[at]
            bin_ = self.items[own]
            if room == 0 or not out:
                continue
            best = None
            pairs = [(sizes[x], (x,)) for x in bin_] + [(sizes[x] + sizes[y], (x, y)) for k, x in enumerate(bin_[:12]) for y in bin_[k + 1 : 12]]
            for size, gone in pairs:
                k = bisect_right(out, (size + room, self.length + len(sizes))) - 1
                if k >= 0 and out[k][0] > size and (best is None or out[k][0] - size > best[0]):
                    best = (out[k][0] - size, gone, (k,))
                if len(gone) == 2 and len(bin_) <= 4 and (best is None or best[0] < room):
                    lo, hi = 0, len(out) - 1
                    while lo < hi:  # the two displaced ones that come nearest to the room from below
                        both = out[lo][0] + out[hi][0]
                        if both > size + room:
                            hi -= 1
                            continue
                        if both > size and (best is None or both - size > best[0]):
                            best = (both - size, gone, (lo, hi))
                        lo += 1
            if best is None:
                continue
            gain, gone, put = best
            self.items[own] = [x for x in bin_ if x not in gone] + [out[k][1] for k in put]
            self.room[at] = (room - gain, own)
            for k in sorted(put, reverse=True):
                out.pop(k)
            for x in gone:
                insort(out, (sizes[x], x))
        self.room.sort()
        return [i for _, i in out]


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    bins = _Bins(sizes, length)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        bins.fit(i)
    return bins.items


def fitness(bins: list[list[int]], sizes: list[int], length: int) -> tuple[int, float]:
    """Fewer bins first; then uneven filling, which leaves whole bins to be emptied."""
    return -len(bins), sum((sum(sizes[i] for i in b) / length) ** 2 for b in bins)


def crossover(one: list[list[int]], two: list[list[int]], sizes: list[int], length: int, rng: random.Random) -> list[list[int]]:
    """A child of one with a share of two's well-filled bins put in whole.

    Bins of one that hold an injected item are opened, and its two emptiest; their other items, the displaced, are
    exchanged for shorter ones where that fills a bin better, and best-fitted again, the longest first.
    """
    full = sorted(two, key=lambda b: -sum(sizes[i] for i in b))[: max(1, len(two) // 2)]
    put = rng.sample(full, max(1, len(full) // rng.choice((4, 8, 16))))
    inside = {i for b in put for i in b}
    child, displaced = _Bins(sizes, length), []
    for b in put:
        child.add(b)
    opened = sorted(range(len(one)), key=lambda j: (sum(sizes[i] for i in one[j]), rng.random()))[: rng.choice((1, 2, 3))]
    for j, b in enumerate(one):
        if j in opened or not inside.isdisjoint(b):
            displaced += [i for i in b if i not in inside]
        else:
            child.add(b)
    displaced = child.exchange(displaced)
    for i in sorted(displaced, key=lambda i: (-sizes[i], i)):
        child.fit(i)
    return child.items


def _assigned(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.empty(n, np.int32)
    for j, b in enumerate(bins):
        out[b] = j
    return out


def _bins(assigned: np.ndarray) -> list[list[int]]:
    order = np.argsort(assigned, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(assigned[order])) + 1)]


def evolve(sizes: list[int], length: int, migrants: list[np.ndarray], seed: int) -> np.ndarray:
    """One island's share of generations: the best solution from the best fit, shuffled first fits and migrants."""
    rng = random.Random(seed)
    start = best_fit(sizes, length)
    least = -(-sum(sizes) // length)
    people = [_bins(m) for m in migrants] + [start]
    score = lambda s: fitness(s, sizes, length)
    best = max(people, key=score)
    if len(best) > least:
        while len(people) < POPULATION:
            bins = _Bins(sizes, length)
            for i in sorted(range(len(sizes)), key=lambda i: -sizes[i] * rng.uniform(0.8, 1.25)):
                bins.fit(i)
            people.append(bins.items)
        people.sort(key=score, reverse=True)
        for _ in range(CROSSOVERS):
            one, two = rng.sample(people, 2)
            people = sorted([*people, crossover(one, two, sizes, length, rng)], key=score, reverse=True)[:POPULATION]
            if len(people[0]) == least:
                break
        best = people[0]
    return _assigned(best, len(sizes))


def _evolved(length: int, move: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                migrants = [np.frombuffer(x, np.int32) for x in r["elites"] or ()]
                own = evolve(r["sizes"], length, migrants, (r["grp"] * ISLANDS + r["island"]) * MOVES + move)
                bins, even = fitness(_bins(own), r["sizes"], length)
                yield pa.RecordBatch.from_arrays([pa.array([r["grp"]], pa.int64()), pa.array([r["island"]], pa.int32()), pa.array([bins], pa.int64()), pa.array([even]), pa.array([own.tobytes()])], ["grp", "island", "score", "even", "solution"])

    return run


_SOLVED = "grp long, island int, score long, even double, solution binary"


def _packed(items: DataFrame, length: int, groups: int) -> DataFrame:
    """Items (any columns and length) with grp, bin: groups by hash, each evolved on its islands."""
    names = items.columns
    rows = items.withColumn("grp", F.pmod(F.xxhash64(*names), F.lit(groups))).groupBy("grp")
    held = keep(rows.agg(F.sort_array(F.collect_list(F.struct(F.col("length").alias("_l"), *names)), asc=False).alias("items")), "groups")
    todo = held.select("grp", F.expr("transform(items, x -> cast(x._l as int))").alias("sizes"), F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    elites = None
    for move in range(MOVES):
        own = todo.withColumn("elites", F.lit(None).cast("array<binary>")) if elites is None else todo.join(elites, ["grp", "island"], "left")
        solved = keep(own.repartition("grp", "island").mapInArrow(_evolved(length, move), _SOLVED), "islands")
        onward = F.explode(F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(ISLANDS)))).alias("island")
        elites = solved.select("grp", onward, "solution").groupBy("grp", "island").agg(F.sort_array(F.collect_list("solution")).alias("elites"))
    best = solved.groupBy("grp").agg(F.max(F.struct("score", "even", (-F.col("island")).alias("i"), "solution")).alias("best")).select("grp", "best.solution")

    def read(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("grp"), pa.array([np.frombuffer(x, np.int32).tolist() for x in batch.column("solution").to_pylist()], pa.list_(pa.int32()))], ["grp", "bins"])

    bins = best.mapInArrow(read, "grp long, bins array<int>")
    return held.join(bins, "grp").select("grp", F.explode(F.arrays_zip("items", "bins")).alias("x")).select("grp", F.col("x.bins").alias("bin"), *[F.col(f"x.items.{c}").alias(c) for c in names])


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, end: int = 1, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `carry` of docs (text), piece, start, length, ids_crc32, sequence_id, offset: a row for each piece.

    A document is its ids by the tokenizer file (a path that every executor has) and the id `end`; only longer ones are
    cut. Whole pieces are sequences of their own. The rest is dealt by hash into groups of about GROUP items; each
    group is a Spark row that ISLANDS islands evolve apart, from the best fit and perturbed best fits, and between
    MOVES epochs each island's elite also goes to the next. The emptiest bin of each group is then opened and its
    items are packed once more in groups of their own, so that groups cost no half-empty sequences.

    A null text is empty and has the one id `end`. Rows repeated whole are packed each. No rows give no rows. ids_crc32
    is the unsigned CRC-32 of the piece's ids as little-endian 32-bit numbers; offsets in a sequence have no gaps.
    """
    names = list(carry)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    pieces = docs.select(*names, "text").mapInArrow(_tokenized(tokenizer, length, end, names), f"{fields}, piece int, start long, length long, ids_crc32 long")
    pieces = keep(pieces.withColumn("_row", F.monotonically_increasing_id()), "tokens")
    whole = pieces.where(F.col("length") == length).select("*", F.concat(F.lit("w"), F.col("_row").cast("string")).alias("seq"))
    done, rest, level = [whole], pieces.where(F.col("length") < length), 0
    n = rest.count()
    while n:
        groups = -(-n // GROUP)
        out = keep(_packed(rest, length, groups).withColumn("seq", F.concat_ws("-", F.lit(level).cast("string"), "grp", "bin")), "packed")
        if groups == 1:
            done.append(out.drop("grp", "bin"))
            break
        fill = out.groupBy("grp", "seq").agg(F.sum("length").alias("fill")).groupBy("grp").agg(F.min_by("seq", F.struct("fill", "seq")).alias("seq"))
        done.append(out.join(fill.select("seq"), "seq", "left_anti").select(*pieces.columns, "seq"))
        rest = keep(out.join(fill.select("seq"), "seq", "left_semi").select(*pieces.columns), "open")
        n, level = rest.count(), level + 1
    found = done[0]
    for x in done[1:]:
        found = found.unionByName(x.select(found.columns))
    # a sequence has at most `length` pieces, so its window is bounded
    run = Window.partitionBy("seq").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    return found.select(*names, "piece", "start", "length", "ids_crc32", F.xxhash64("seq").alias("sequence_id"), F.coalesce(F.sum("length").over(run), F.lit(0)).alias("offset"))
