"""What each filter of a chain removes under every order of the filters, by difference arrays over permutation ranks."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import WORD_SPACE
from lectern.llm.exact_dedup import NULL_ID, exact_groups

#: The filters of fails(), in the order of their bits.
LETTERS = "ABCDE"


def fails(text: Column) -> Column:
    """The filters A to D that a text (not null) fails, as bits; E needs the other texts."""
    words = F.array_remove(F.split(text, WORD_SPACE), "")
    n = F.size(words)
    a = n < 50
    b = 100 * F.size(F.array_distinct(words)).cast("long") < 65 * n.cast("long")
    c = 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 5 * F.length(text).cast("long")
    d = text.rlike(r"[#$%&*|]")
    return sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate((a, b, c, d))), F.lit(0))


def lehmer_rank(order: tuple[int, ...], n: int) -> int:
    """The place of the first permutation of 0..n-1 that begins with `order`, among all in lexicographic order."""
    return sum(sum(y < x for y in range(n) if y not in order[: i + 1]) * factorial(n - 1 - i) for i, x in enumerate(order))


def removal_intervals(n: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, start, stop): under the orders ranked start to stop - 1, what fails `mask` goes at step `step`.

    The orders that begin with filters which let it pass and then one that doesn't are neighbours in lexicographic order:
    each such beginning is one interval, and a mask's intervals cover every order once.
    """
    out = []
    for step in range(1, n + 1):
        for begin in permutations(range(n), step):
            free = [x for x in range(n) if x not in begin]
            start = lehmer_rank(begin, n)
            for chosen in range(1 << len(free)):
                mask = 1 << begin[-1] | sum(1 << x for i, x in enumerate(free) if chosen >> i & 1)
                out.append((mask, step, start, start + factorial(n - step)))
    return out


def audit(marks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row for each part, order of the filters and step, from marks (part, mask, good, toxic: 0 or 1).

    Documents are counted by part and mask first, so a part with a third of all rows is a few counts of each task.
    A mask's counts are added where each of its intervals of orders begins and taken off where it ends (840 intervals for
    five filters, a table of fixed size); running sums over the ranks then give what each step removes under each order.

    Masks are bits, the lowest for the first letter; a null mask is 0, a null part the empty string, null good or toxic 0.
    No rows give no rows; each part that occurs has a row for every order and step, zeros included.
    """
    n = len(letters)
    spark: SparkSession = marks.sparkSession
    orders = spark.createDataFrame([(r, "".join(letters[i] for i in p)) for r, p in enumerate(permutations(range(n)))], "rank int, filter_order string")
    spans = spark.createDataFrame(removal_intervals(n), "mask int, step int, start int, stop int")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    counts = marks.groupBy(F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), F.coalesce("mask", F.lit(0)).cast("int").alias("mask"))
    counts = counts.agg(F.count("*").alias("n"), F.sum(zero("good")).alias("good"), F.sum(zero("toxic")).alias("toxic"))
    has = lambda i: F.col("mask").bitwiseAND(1 << i) != 0
    each = lambda test: F.array(*[F.sum(F.when(test(i), F.col("n")).otherwise(0)) for i in range(n)])
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"), each(has).alias("failing"), each(lambda i: F.col("mask") == 1 << i).alias("only"))

    what = ("n", "good", "toxic")
    ends = counts.join(F.broadcast(spans), "mask").select("part", "step", F.explode(F.array(*[
        F.struct(F.col(end).alias("rank"), *[(sign * F.col(c)).alias(c) for c in what]) for end, sign in (("start", 1), ("stop", -1))
    ])).alias("e"))
    grid = parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")).withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(factorial(n) - 1))))
    grid = grid.select("*", *[F.lit(0).cast("long").alias(c) for c in what])
    change = ends.select("part", "step", "e.*").where(F.col("rank") < factorial(n)).unionByName(grid)
    change = change.groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in what])
    along = Window.partitionBy("part", "step").orderBy("rank")
    gone = change.select("part", "step", "rank", *[F.sum(c).over(along).alias(c) for c in what])

    gone = gone.join(F.broadcast(orders), "rank").join(parts, "part")
    gone = gone.withColumn("letter", F.expr("substring(filter_order, step, 1)"))
    gone = gone.withColumn("bit", F.instr(F.lit(letters), F.col("letter")))
    so_far = Window.partitionBy("part", "rank").orderBy("step")
    return gone.select(
        "part", "filter_order", "step",
        (F.col("total") - F.sum("n").over(so_far)).alias("kept"), F.col("n").alias("removed"), (F.element_at("failing", F.col("bit")) - F.col("n")).alias("redundant"),
        F.element_at("only", F.col("bit")).alias("unique_fails"), F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "letter")).alias("shapley"),
    )


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, mask, good, toxic) of each row of docs (doc_id, text, source): the filters it fails, its labels.

    A: under 50 words. B: under 65 % of the words distinct, case-sensitive. C: over 5 % of the code points A to Z. D: holds
    one of # $ % & * |. E: equal to the text of a smaller doc_id of the whole table (see exact_groups). Null texts are
    empty, a null doc_id is the smallest and has no labels, a null source is a part named by the empty string. A label is
    1 if any row of labels (doc_id, quality, toxic) says so; documents without labels count as neither good nor toxic.
    """
    own = docs.select("doc_id", "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), fails(F.coalesce("text", F.lit(""))).alias("mask"))
    told = exact_groups(own, carry=("part", "mask"))
    low = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NULL_ID))
    again = F.when(low("doc_id") > low("first_id"), 1 << 4).otherwise(0)
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(f"_{c}")
    by_id = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_label_of")).agg(one("quality"), one("toxic"))
    told = told.join(by_id, F.col("doc_id") == F.col("_label_of"), "left")
    return told.select("doc_id", "part", (F.col("mask") + again).alias("mask"), F.col("_quality").alias("good"), F.col("_toxic").alias("toxic"))


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters of marked(), for each source: 600 rows a source."""
    return audit(marked(docs, labels))
