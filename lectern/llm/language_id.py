"""Language identification, words first: known words by log frequency, unseen ones by shrinking character n-grams."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import keep

#: Longest n-gram that an unseen word is scored by, before shorter ones.
LONGEST = 4
#: The most frequent words, at most so many and so many numbers with all languages, are looked up where a text is read
#: and are broadcast; all others are joined. The bound has no bearing on results.
HOT_WORDS, HOT_NUMBERS = 250_000, 4_000_000
#: Added to every count of a language.
SMOOTH = 0.5

_WORD = re.compile(r"[^\W\d_]+")
#: Rows that a task's counts may hold before they are handed on.
_HELD = 400_000
_BY = "array<struct<lang: int, n: long>>"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _counted(pairs: Iterator[tuple[str, Counter]], name: str) -> Iterator[pa.RecordBatch]:
    """Counts by language, combined over a task up to a bound before they are shuffled."""
    held: dict[str, Counter] = {}

    def out():
        for lang, c in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", name, "n"])

    for lang, c in pairs:
        held.setdefault(lang, Counter()).update(c)
        if sum(map(len, held.values())) > _HELD:
            yield from out()
            held = {}
    yield from out()


def _count_words(at: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            for batch in batches:
                for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                    yield at[lang], words_of(text.as_py())

        return _counted(pairs(), "word")

    return run


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its ends marked; single letters without the marks."""
    w = word if n == 1 else f"<{word}>"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pairs():
        for batch in batches:
            for word, by in zip(batch.column("word").to_pylist(), batch.column("by").to_pylist(), strict=True):
                own = Counter()
                for k in range(1, LONGEST + 1):
                    own.update(grams(word, k))
                for x in by:
                    yield x["lang"], {g: m * x["n"] for g, m in own.items()}

    return _counted(pairs(), "gram")


def _grams_of(n: int):
    """(word, gram, m): the n-grams of words and how often each stands in its word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, g, m) for w in batch.column("word").to_pylist() for g, m in Counter(grams(w, n)).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32())], ["word", "gram", "m"])

    return run


@dataclass
class Model:
    """What was learned: languages with their logarithms (few numbers each), and the tables of all words and n-grams.

    base[0] has each language's log probability of a word that only other languages know, base[k] that of such a k-gram;
    a count of n adds log((n + SMOOTH) / SMOOTH). hot: the count from which on a word belongs to the hot ones.
    """

    langs: list[str]
    prior: np.ndarray
    base: np.ndarray
    vocabulary: DataFrame | None
    grams: DataFrame | None
    hot: int


def _table(counts: DataFrame, name: str) -> DataFrame:
    """(name, total, by): the counts by language of each word or n-gram, gathered in one shuffle."""
    each = counts.repartition(name).groupBy(name, "lang").agg(F.sum("n").alias("n"))
    return each.groupBy(name).agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct(F.col("lang").cast("int").alias("lang"), "n"))).alias("by"))


def _sizes(table: DataFrame, langs: int) -> tuple[np.ndarray, int]:
    """Summed counts by language, and the number of rows."""
    size = np.zeros(langs)
    for r in table.select(F.explode("by").alias("x")).groupBy("x.lang").agg(F.sum("x.n").alias("n")).collect():
        size[r["lang"]] = r["n"]
    return size, table.count()


def _hot_from(vocabulary: DataFrame, langs: int) -> int:
    """The count from which on words are few enough to be broadcast, from a histogram of counts with fine bins."""
    most = min(HOT_WORDS, HOT_NUMBERS // langs)
    bin_ = F.floor(F.log2("total") * 64)
    rows = vocabulary.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("total").alias("least"), F.max("total").alias("greatest")).orderBy(F.desc("bin")).collect()
    found, seen = max((r["greatest"] for r in rows), default=0) + 1, 0
    for r in rows:
        seen += r["n"]
        if seen > most:
            break
        found = r["least"]
    return found


def train(labelled: DataFrame) -> Model:
    """A model from rows with text and lang: every word of every row, and every n-gram of every word, is counted and kept
    in tables; only a few numbers for each language reach the driver. Rows with a null in either column are passed over.
    """
    rows = labelled.select("text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    nothing = Model([], np.zeros(0), np.zeros((LONGEST + 1, 0)), None, None, 1)
    if not langs:
        return nothing
    counts = rows.mapInArrow(_count_words({x: i for i, x in enumerate(langs)}), "lang long, word string, n long")
    vocabulary = keep(_table(counts, "word"), "vocabulary")
    found = keep(_table(vocabulary.mapInArrow(_count_grams, "lang long, gram string, n long"), "gram"), "grams")
    size, types = _sizes(vocabulary, len(langs))
    if not types:
        return nothing
    base = [np.log(SMOOTH / (size + SMOOTH * types))]
    for k in range(1, LONGEST + 1):
        own, many = _sizes(found.where(F.length("gram") == k), len(langs))
        base.append(np.log(SMOOTH / (own + SMOOTH * max(1, many))))
    return Model(langs, np.log(np.maximum(size, SMOOTH) / size.sum()), np.array(base), vocabulary, found, _hot_from(vocabulary, len(langs)))


def _gains(by, times=1.0):
    """(lang, v): what a word's or n-gram's counts add to each language's score."""
    return F.transform(by, lambda x: F.struct(x["lang"].alias("lang"), (F.log((x["n"] + SMOOTH) / SMOOTH) * times).alias("v")))


class _Hot(dict):
    """The places of hot words; -1 for others."""

    def __missing__(self, key):
        return -1


@functools.lru_cache(maxsize=1)
def _lookup(value: _Sent) -> _Hot:
    """The places of the words of a broadcast table, worked out once for all tasks that a worker runs."""
    return _Hot((w, i) for i, w in enumerate(value.words.to_pylist()))


class _Sent:
    """The hot words and a row of gains for each."""

    def __init__(self, words: pa.Array, gains: np.ndarray):
        self.words, self.gains = words, gains


def _hot_table(model: Model) -> _Sent:
    t = model.vocabulary.where(F.col("total") >= model.hot).select("word", "by").toArrow().combine_chunks()
    gains = np.zeros((len(t), len(model.langs)))
    if len(t):
        by = t.column("by").chunk(0)
        row = np.repeat(np.arange(len(t)), np.diff(by.offsets.to_numpy()))
        flat = by.flatten()
        gains[row, flat.field("lang").to_numpy()] = np.log((flat.field("n").to_numpy() + SMOOTH) / SMOOTH)
    return _Sent(t.column("word").chunk(0) if len(t) else pa.array([], pa.string()), gains)


def _read(sent, carried: list[str]):
    """Each row's number of words (null without a letter), gains from its hot words, their number, and all its others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        at, gains = _lookup(own), own.gains
        for batch in batches:
            total, hot, size, rest = [], [], [], []
            for text in batch.column("_text"):
                text = text.as_py()
                c = Counter(words_of(text)) if text and any(map(str.isalpha, text)) else None
                if not c:
                    total.append(None)
                    hot.append([])
                    size.append(0)
                    rest.append([])
                    continue
                place = np.fromiter(map(at.__getitem__, c), np.int64, len(c))
                n = np.fromiter(c.values(), np.float64, len(c))
                known = place >= 0
                total.append(int(n.sum()))
                hot.append(n[known] @ gains[place[known]])
                size.append(int(n[known].sum()))
                rest.append([{"word": w, "c": m} for (w, m), k in zip(c.items(), known.tolist(), strict=True) if not k])
            cols = [pa.array(total, pa.int64()), pa.array(hot, pa.list_(pa.float64())), pa.array(size, pa.int64()), pa.array(rest, pa.list_(pa.struct([("word", pa.string()), ("c", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *cols], [*carried, "_words", "_hot", "_known", "_rest"])

    return run


def _unseen(words: DataFrame, model: Model) -> DataFrame:
    """(word, kind, gains) of words that the vocabulary doesn't have: the mean over their longest n-grams that it knows.

    kind is the length of those n-grams; words without any known letter are left out. Each length only joins the words
    that no greater length could score.
    """
    found = None
    for n in range(LONGEST, 0, -1):
        own = words.mapInArrow(_grams_of(n), "word string, gram string, m int")
        met = own.join(model.grams.where(F.length("gram") == n).select("gram", "by"), "gram")
        # -1 stands for the number of known n-grams
        parts = F.concat(F.array(F.struct(F.lit(-1).alias("lang"), F.col("m").cast("double").alias("v"))), _gains(F.col("by"), F.col("m")))
        each = met.select("word", F.explode(parts).alias("x")).groupBy("word", "x.lang").agg(F.sum("x.v").alias("v"))
        each = each.groupBy("word").agg(F.collect_list(F.struct("lang", "v")).alias("all"))
        m = F.get(F.filter("all", lambda x: x["lang"] < 0), F.lit(0))["v"]
        mean = F.transform(F.filter("all", lambda x: x["lang"] >= 0), lambda x: F.struct(x["lang"].alias("lang"), (x["v"] / m).alias("v")))
        done = keep(each.select("word", F.lit(n).alias("kind"), mean.alias("gains")), "unseen-words")
        found = done if found is None else found.unionByName(done)
        words = keep(words.join(done, "word", "left_anti"), "open-words")
        if words.isEmpty():
            break
    return found


def _decided(model: Model, carried: list[str]):
    langs, prior, base = model.langs, model.prior, model.base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = [], []
            for words, hot, known, more in zip(*(batch.column(c).to_pylist() for c in ("_words", "_hot", "_known", "more")), strict=True):
                if words is None:
                    pred.append("und")
                    score.append(0.0)
                    continue
                total = prior + known * base[0]
                if hot:
                    total = total + np.array(hot)
                for x in more or ():
                    if x["lang"] >= 0:
                        total[x["lang"]] += x["v"]
                    else:  # the number of words of a kind
                        total += x["v"] * base[-1 - x["lang"]]
                best = int(total.argmax())
                pred.append(langs[best])
                score.append(round(float(1 / np.exp(np.maximum(total - total[best], -700)).sum()), 9))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*carried, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text and any other columns) with lang_pred and score.

    The summed word scores of a text and the languages' priors give a posterior; score is that of the best language to
    nine places, ties go to the first by code point. A word counts by its own log frequency in each language where the
    vocabulary has it, else by its longest known n-grams. Hot words are looked up where the text is read; each text's
    others, counted first, meet the full tables in joins, which adaptive execution may split where a word is hot after
    all. Texts that are null, without a letter, or read by a model that has learned nothing are `und` with score 0.
    Columns of docs called lang_pred or score are replaced; no rows give no rows.
    """
    carried = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    if not model.langs:
        return docs.select(*carried, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(_hot_table(model))
    held = docs.select(F.struct(*carried, F.lit(0).alias("_")).alias("_own"), F.col("text").alias("_text"))
    shape = f"_own {held.schema['_own'].dataType.simpleString()}, _words long, _hot array<double>, _known long, _rest array<struct<word: string, c: int>>"
    held = keep(held.mapInArrow(_read(sent, ["_own"]), shape).withColumn("_row", F.monotonically_increasing_id()), "read-texts")

    pairs = held.select("_row", F.explode("_rest").alias("x")).select("_row", "x.word", "x.c")
    met = keep(pairs.join(model.vocabulary.where(F.col("total") < model.hot).select("word", "by"), "word", "left"), "met-words")
    known = met.where("by is not null").select("_row", "c", F.lit(0).alias("kind"), _gains(F.col("by")).alias("gains"))
    unseen = met.where("by is null").select("_row", "word", "c")
    scored = known
    words = keep(unseen.select("word").distinct(), "unseen")
    if not words.isEmpty():
        scored = known.unionByName(unseen.join(_unseen(words, model), "word").select("_row", "c", "kind", "gains"))
    # -1 - kind stands for the number of words of a kind
    times = F.transform("gains", lambda x: F.struct(x["lang"].alias("lang"), (x["v"] * F.col("c")).alias("v")))
    parts = F.concat(F.array(F.struct((-1 - F.col("kind")).alias("lang"), F.col("c").cast("double").alias("v"))), times)
    sums = scored.repartition("_row").select("_row", F.explode(parts).alias("x")).groupBy("_row", "x.lang").agg(F.sum("x.v").alias("v"))
    sums = sums.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("lang", "v"))).alias("more"))
    out = held.select("_own", "_words", "_hot", "_known", "_row").join(sums, "_row", "left")
    out = out.mapInArrow(_decided(model, ["_own"]), f"_own {held.schema['_own'].dataType.simpleString()}, lang_pred string, score double")
    return out.select(*[F.col(f"_own.`{c}`").alias(c) for c in carried], "lang_pred", "score")


def train_and_identify(spark: SparkSession, docs: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score: a model of the rows whose crc32(doc_id) mod folds is not 0, applied to all.

    A null doc_id counts as the empty text. Rows repeated whole are counted and predicted each.
    """
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0
    model = train(docs.where(~held).select("text", "lang"))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model)
