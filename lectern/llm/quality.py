"""Quality rules: repetition counts, and divergence of a text's histograms from its language's references.

Only DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import WORD_SPACE, keep

#: White space of the word rule, for trimming.
_BLANKS = " \t\n\x0b\x0c\r"
#: Characters counted as symbols.
SYMBOLS = "[#*$%&|<>]"
#: Character classes of the histogram; white space and everything else complete it.
CLASSES = {"upper": r"\p{Lu}", "digit": "[0-9]", "mark": r"[\p{P}\p{S}]"}
#: Words of a window for repetition: features() builds its hashes from those of two and four words.
WINDOW = 5
#: Words in a language's reference: its most frequent.
COMMON = 12


@dataclass(frozen=True)
class Limits:
    """Distances beyond which a text is rejected, and lengths below which its histograms say nothing."""

    classes: float = 0.27
    words: float = 0.38
    #: Of the distance that a text without any common word has: beyond it too few of its words are common.
    missing: float = 0.85
    least_chars: int = 250
    least_words: int = 50
    #: Common words that a text of its length is expected to have, for them to be missed.
    least_common: float = 9.0


def words_of(text: Column) -> Column:
    """The words of a text as an array; null or blank: none."""
    trimmed = F.btrim(text, F.lit(_BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, WORD_SPACE)).otherwise(F.array().cast("array<string>"))


def _lines_twice(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(_BLANKS))) > 0)
    return F.size(lines) - F.size(F.array_distinct(lines))


def features(docs: DataFrame, common: Column) -> DataFrame:
    """docs with _n (words), _chars, _symbols, _lines, _repeat, _classes and _common (counts for the words of `common`).

    Words are told apart by 64-bit hashes, windows by hashes of those: a text of a million words with unlike windows alone
    is taken to have equal ones with probability 3e-8. Words in windows met twice: a text without any such window, nearly every one, is told by a hash set; otherwise
    windows are sorted with their places, equal neighbours flagged, and the cover of the flagged places is summed.
    """
    d = docs.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    d = d.withColumn("_words", words_of(F.col("_text"))).withColumn("_n", F.size("_words").cast("long"))
    d = d.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    # hashes of two words, of four, of five: each pairs two arrays, one of them set off
    two = lambda x, y: F.xxhash64(x, y)
    room = F.greatest(F.col("_n").cast("int") - (WINDOW - 1), F.lit(0))
    d = d.withColumn("_h2", F.zip_with("_h", F.slice("_h", 2, F.size("_h")), two))
    d = d.withColumn("_h4", F.zip_with("_h2", F.slice("_h2", 3, F.size("_h2")), two))
    d = d.withColumn("_w5", F.zip_with(F.slice("_h4", 1, room), F.slice("_h", WINDOW, room), two))
    some = F.size("_w5") > F.size(F.array_distinct("_w5"))
    d = d.withColumn("_placed", F.when(some, F.array_sort(F.transform("_w5", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = lambda x, j: (x["h"] == F.get(F.col("_placed"), j - 1)["h"]) | (x["h"] == F.get(F.col("_placed"), j + 1)["h"])
    d = d.withColumn("_at", F.array_sort(F.transform(F.filter("_placed", lambda x, j: F.coalesce(twin(x, j), F.lit(False))), lambda x: x["i"])))
    cover = F.aggregate("_at", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    d = d.withColumn("_repeat", F.coalesce(cover, F.lit(0)).cast("long"))
    d = d.withColumn("_chars", F.length(F.array_join("_words", "")).cast("long"))
    d = d.withColumn("_few", few(F.col("_text"))).withColumn("_lines", _lines_twice(F.col("_text")).cast("long"))
    d = d.withColumn("_symbols", F.regexp_count("_few", F.lit(SYMBOLS)).cast("long")).withColumn("_classes", class_counts(F.col("_text"), F.col("_chars"), F.col("_few")))
    d = d.withColumn("_list", F.transform(common, lambda w: F.xxhash64(w)))
    d = d.withColumn("_short", F.filter("_h", lambda w: F.array_contains(F.col("_list"), w)))
    d = d.withColumn("_common", F.transform("_list", lambda c: F.size("_short") - F.size(F.array_remove("_short", c))))
    return d.drop("_text", "_words", "_few", "_h", "_h2", "_h4", "_w5", "_placed", "_at", "_list", "_short")


def few(text: Column) -> Column:
    """The characters of a text that CLASSES or SYMBOLS count, in one pass; most are of neither."""
    return F.regexp_replace(text, r"[^\p{Lu}\p{P}\p{S}0-9]++", "")


def class_counts(text: Column, chars: Column, few: Column) -> Column:
    """Counts by character class: those of CLASSES, white space, all others."""
    own = [F.regexp_count(few, F.lit(x)).cast("double") for x in CLASSES.values()]
    return F.array(*own, (F.length(text) - chars).cast("double"))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance (base 2, 0 to 1) of two arrays of probabilities of one length."""

    def term(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        part = lambda v: F.when(v > 0, v * F.log2(v / m)).otherwise(0.0)
        return (part(x) + part(y)) / 2

    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda a, x: a + x)))


@dataclass
class References:
    """Class probabilities, common words, and their probabilities with that of all others: `table` has a row for each
    language (_lang, classes, common, words), the rest is over all of them."""

    table: DataFrame
    classes: list[float]
    common: list[str]
    words: list[float]


def references(docs: DataFrame) -> References:
    """Histograms of every text of docs (text, lang), for each language and over all.

    Sums by language, and counts of all words by language and word, both combined before they are shuffled by keys that
    spread a hot language; the most frequent words of each language are cut down to COMMON before they meet. Only the
    reference over all reaches the driver: languages stay a table of a few hundred bytes each.
    """
    d = docs.select(F.col("lang").cast("string").alias("_lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = words_of(F.col("text"))
    counts = keep(d.select("_lang", F.explode(words).alias("word")).groupBy("_lang", "word").agg(F.count("*").alias("count")), "words")
    d = d.withColumn("few", few(F.col("text")))
    sums = [F.sum(F.regexp_count("few", F.lit(x))).alias(n) for n, x in CLASSES.items()]
    whole = d.groupBy("_lang").agg(F.sum(F.length("text")).alias("length"), *sums)
    chars = counts.groupBy(F.col("_lang").alias("_l")).agg(F.sum(F.length("word") * F.col("count")).alias("chars"))
    whole = whole.join(chars, F.col("_lang").eqNullSafe(F.col("_l")), "left").withColumn("space", F.col("length") - F.coalesce("chars", F.lit(0)))
    whole = keep(whole.select("_lang", "length", "space", *CLASSES), "sums")

    def classes(d: DataFrame) -> DataFrame:
        own = [*CLASSES, "space"]
        length = F.greatest(F.col("length"), F.lit(1))
        return d.withColumn("classes", F.array(*[F.col(c) / length for c in own], (F.col("length") - sum(map(F.col, own))) / length))

    def common(d: DataFrame, by: list[str]) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count"), "word"))
        best = d.withColumn("place", place).where(F.col("place") <= COMMON).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("place", "word", "count"))).alias("x"))
        best = best.join(d.groupBy(*by).agg(F.sum("count").alias("n")), by) if by else best.crossJoin(d.agg(F.sum("count").alias("n")))
        p = F.transform("x", lambda w: w["count"] / F.col("n"))
        rest = F.greatest(F.lit(0.0), 1 - F.aggregate(p, F.lit(0.0), lambda a, x: a + x))
        return best.select(*by, F.col("x.word").alias("common"), F.concat(p, F.array(rest)).alias("words"))

    all_words = common(counts.groupBy("word").agg(F.sum("count").alias("count")), []).first()
    all_classes = classes(whole.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in whole.columns[1:]])).first()["classes"]
    table = classes(whole.where("_lang is not null")).join(common(counts.where("_lang is not null"), ["_lang"]), "_lang", "left")
    table = keep(table.select("_lang", "classes", F.coalesce("common", F.array().cast("array<string>")).alias("common"), F.coalesce("words", F.array(F.lit(1.0))).alias("words")), "references")
    return References(table, all_classes, all_words["common"] if all_words else [], all_words["words"] if all_words else [1.0])


def _constant(values: list, kind: str) -> Column:
    return F.array(*map(F.lit, values)).cast(f"array<{kind}>")


def judge(docs: DataFrame, limits: Limits = Limits(), against: References | None = None) -> DataFrame:
    """Every column of docs in a struct `row`, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, class_distance, word_distance, missing_share and kept.

    base_failed: fewer than 10 words, or more than a fifth of them in 5-word windows that the text has twice. The
    method's verdict: the Jensen-Shannon distances between the text's and its language's histograms, of character
    classes, of the most common words, and of common words against all others where they are too few, are within the
    limits. The last limit follows from the reference: a share of the distance that a text without any common word has.
    A text shorter than a guard passes that comparison.

    The references (of docs itself, unless given) are joined by language, a row each; Spark broadcasts them where they
    are small. Nothing else is shuffled but their sums. Null texts are empty and fail. A null or unknown lang is
    compared with the reference over all. Columns of docs may have any names; no rows give no rows.
    """
    ref = against or references(docs)
    d = docs.select(F.struct("*").alias("row"), "text", F.col("lang").cast("string").alias("_lang"))
    d = d.join(ref.table, "_lang", "left")
    for name, values, kind in (("classes", ref.classes, "double"), ("common", ref.common, "string"), ("words", ref.words, "double")):
        d = d.withColumn(f"_ref_{name}", F.coalesce(name, _constant(values, kind))).drop(name)
    d = features(d, F.col("_ref_common"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    length = F.coalesce(F.length("text"), F.lit(0))
    p = F.transform(F.concat("_classes", F.array(length - total(F.col("_classes")))), lambda x: x / F.greatest(length, F.lit(1)))
    common = F.transform("_common", lambda x: x.cast("double"))
    d = d.withColumn("_hits", total(common))
    n = F.greatest(F.col("_n"), F.lit(1))
    w = F.transform(F.concat(common, F.array(F.col("_n") - F.col("_hits"))), lambda x: x / n)
    d = d.withColumn("class_distance", F.when(length >= limits.least_chars, jensen_shannon(p, F.col("_ref_classes"))))
    d = d.withColumn("word_distance", F.when(F.col("_n") >= limits.least_words, jensen_shannon(w, F.col("_ref_words"))))
    rest = F.element_at("_ref_words", -1)
    two = lambda x: F.array(x, 1 - x)
    few_common = (F.col("_n") >= limits.least_words) & (F.col("_n") * (1 - rest) >= limits.least_common) & (F.col("_hits") < F.col("_n") * (1 - rest))
    share = jensen_shannon(two(F.col("_hits") / n), two(1 - rest)) / jensen_shannon(two(F.lit(0.0)), two(1 - rest))
    d = d.withColumn("missing_share", F.when(few_common, share))
    # a filter on the verdict must not be pushed below this: it would copy the whole computation into itself, many times
    d = d.withColumn("_here", F.monotonically_increasing_id())
    failed = (F.col("_n") < 10) | (100 * F.col("_repeat") > 20 * F.col("_n"))
    within = lambda c, limit: F.coalesce(F.col(c), F.lit(0.0)) <= limit
    good = within("class_distance", limits.classes) & within("word_distance", limits.words) & within("missing_share", limits.missing)
    return d.select(
        "row",
        F.col("_n").alias("n_words"),
        F.col("_chars").alias("word_chars"),
        F.col("_symbols").alias("n_symbols"),
        F.col("_lines").alias("n_dup_lines"),
        F.col("_repeat").alias("n_repeat_words"),
        failed.alias("base_failed"),
        "class_distance",
        "word_distance",
        "missing_share",
        (~failed & good & (F.col("_here") >= 0)).alias("kept"),
    )
