"""Intervals over texts, and losses of tokens spread over bytes and read off by role."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union(intervals: DataFrame, by: list[str]) -> DataFrame:
    """(by, start, end): intervals that overlap or touch, as one."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    i = intervals.withColumn("_new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    i = i.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return i.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def complement(merged: DataFrame, lengths: DataFrame, by: list[str]) -> DataFrame:
    """(by, start, end): what merged intervals leave of 0 to `length`; a text without intervals is left whole."""
    w = Window.partitionBy(*by).orderBy("start")
    m = lengths.join(merged, by, "left").withColumn("_before", F.coalesce(F.lag("end").over(w), F.lit(0)))
    gaps = m.select(*by, F.col("_before").alias("start"), F.coalesce("start", "length").alias("end"))
    tails = m.groupBy(*by).agg(F.max("end").alias("start"), F.max("length").alias("end")).where("start is not null")
    return gaps.unionByName(tails.select(*gaps.columns)).where("start < end")


def contained(spans: DataFrame, by: list[str]) -> DataFrame:
    """Spans that no earlier or longer span of their group holds."""
    w = Window.partitionBy(*by).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_reach", F.max("end").over(w)).where("_reach is null or _reach < end").drop("_reach")


def invalid_tokens(tokens: DataFrame) -> DataFrame:
    """(doc_id, problem, n): indexes that repeat, offsets reversed or out of order, losses that are negative or not finite.

    A token may have several problems and counts for each.
    """
    w = Window.partitionBy("doc_id").orderBy("i", "start", "end")
    t = tokens.withColumn("ps", F.lag("start").over(w)).withColumn("pe", F.lag("end").over(w)).withColumn("pi", F.lag("i").over(w))
    found = {
        "repeated": F.col("pi") == F.col("i"),
        "reversed": F.col("start") >= F.col("end"),
        "order": (F.col("ps") > F.col("start")) | (F.col("pe") > F.col("end")),
        "loss": F.isnan("bits") | (F.col("bits") < 0) | (F.abs(F.col("bits")) == float("inf")) | F.col("bits").isNull(),
    }
    all_ = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in found.items()]))
    return t.select("doc_id", F.explode(all_).alias("problem")).groupBy("doc_id", "problem").agg(F.count("*").alias("n"))


def overlap(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """Tokens with the spans of their document that they overlap.

    Tokens are numbered in the order of their starts. One sweep over the sorted boundaries of both counts, for each span,
    the tokens that have started before its end and those of which, and of all before which, none reaches past its start:
    the tokens between are joined by their numbers, so that no more pairs meet than overlap (where tokens lie
    within others, a few more, which are dropped). A span given twice meets its tokens twice.
    """
    by_start = Window.partitionBy("doc_id").orderBy("start", "end")
    so_far = by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = tokens.withColumn("_n", F.row_number().over(by_start)).withColumn("_reach", F.max("end").over(so_far))
    s = spans.withColumnsRenamed({"start": "s_start", "end": "s_end"})
    key = s.columns
    none = [F.lit(None).cast(s.schema[c].dataType).alias(c) for c in key if c != "doc_id"]
    edge = lambda at, turn: F.struct(F.col(at).cast("long").alias("at"), F.lit(turn).alias("turn"))
    # of what lies at one place, tokens that end come before a span's start, and a span's end before tokens that start
    ends = t.select("doc_id", *none, F.explode(F.array(edge("_reach", 0), edge("start", 3))).alias("e"))
    ends = ends.unionByName(s.select(*key, F.explode(F.array(edge("s_start", 1), edge("s_end", 2))).alias("e")))
    sweep = Window.partitionBy("doc_id").orderBy("e.at", "e.turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = lambda turn: F.sum((F.col("e.turn") == turn).cast("long")).over(sweep)
    seen = ends.select(*key, "e.turn", run(0).alias("past"), run(3).alias("begun")).where("turn in (1, 2)")
    seen = seen.groupBy(*key).agg(F.max(F.when(F.col("turn") == 1, F.col("past"))).alias("lo"), F.max(F.when(F.col("turn") == 2, F.col("begun"))).alias("hi"), F.count(F.when(F.col("turn") == 1, 1)).cast("int").alias("copies"))
    seen = seen.where("lo < hi").select(*key, F.explode(F.sequence(F.col("lo") + 1, F.col("hi"))).alias("_n"), "copies")
    j = t.join(seen.withColumn("_n", F.col("_n").cast("int")), ["doc_id", "_n"]).where("start < s_end and end > s_start")
    return j.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("_n", "_reach", "copies", "_copy")


def _edges(trace: DataFrame) -> DataFrame:
    """(doc_id, at, bits, bytes, k): by how much bits and bytes a character, and the tokens over it, change at each place.

    A token's bits are spread evenly over its UTF-8 bytes, so a token of one-byte characters changes them where it starts
    and where it ends; one with longer characters does so at every character. A trace without texts has `bytes` instead.
    """
    piece = lambda start, end, bits, size: F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), bits.cast("double").alias("bits"), size.cast("double").alias("bytes"))
    start, end = F.col("start"), F.col("end")
    if "text" in trace.columns:
        size = F.octet_length("text")
        plain = F.array(piece(start, end, F.col("bits") / size * F.length("text"), F.length("text")))
        each = F.transform(F.split("text", ""), lambda c, i: piece(start + i, start + i + 1, F.col("bits") * F.octet_length(c) / size, F.octet_length(c)))
        pieces = F.when(size == F.length("text"), plain).otherwise(each)
    else:
        pieces = F.array(piece(start, end, F.col("bits"), F.col("bytes")))
    p = trace.where("start < end").select("doc_id", F.explode(pieces).alias("p"))
    wide = F.col("p.end") - F.col("p.start")
    edge = lambda at, sign: F.struct(F.col(at).alias("at"), (sign * F.col("p.bits") / wide).alias("bits"), (sign * F.col("p.bytes") / wide).alias("bytes"), F.lit(sign).alias("k"))
    return p.select("doc_id", F.explode(F.array(edge("p.start", 1), edge("p.end", -1))).alias("e")).select("doc_id", "e.*")


def _swept(edges: DataFrame) -> DataFrame:
    """edges in the order of their places, with width, own_bits, own_bytes and over: from the place before to this one, the
    characters between, their bits, their bytes (each once, however many tokens are over it) and the tokens over them."""
    order = Window.partitionBy("doc_id").orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    run = {c: F.sum(c).over(before).alias(f"_{c}") for c in ("bits", "bytes", "k")}
    d = edges.select("*", (F.col("at") - F.lag("at").over(order)).alias("width"), *run.values())
    live = F.coalesce(F.col("_k"), F.lit(0)) > 0
    own = lambda c: F.when(live, c * F.col("width")).otherwise(0.0)
    return d.withColumns({"own_bits": own(F.col("_bits")), "own_bytes": own(F.col("_bytes") / F.col("_k")), "over": F.coalesce("_k", F.lit(0))})


def allocation(tokens: DataFrame) -> DataFrame:
    """tokens (doc_id, start, end, bits, text) as segments (doc_id, start, end, bits, bytes, k) that don't overlap.

    A token's bits are spread evenly over its UTF-8 bytes. Texts are cut at every end of a token (at every character of
    tokens that aren't ASCII); a segment has the bits of the k tokens over it, and its bytes once.
    """
    s = _swept(_edges(tokens)).where("over > 0 and width > 0")
    return s.select("doc_id", (F.col("at") - F.col("width")).alias("start"), F.col("at").alias("end"), F.col("own_bits").alias("bits"), F.round("own_bytes").cast("long").alias("bytes"), F.col("over").alias("k"))


def _read_off(trace: DataFrame, spans: DataFrame, key: list[str]) -> DataFrame:
    """(doc_id, key, bits, bytes): of what a trace (tokens, or segments of allocation) has within spans, summed by key.

    One sweep over the sorted boundaries of trace and spans: running sums of bits and covered bytes, and a span is the
    difference of those at its two ends. Nothing is joined, and all steps of a document stay in one partition.
    """
    wanted = [c for c in key if c != "doc_id"]
    place = lambda c, sign: F.struct(F.col(c).cast("long").alias("at"), F.lit(sign).alias("sign"))
    fields = F.struct(*wanted) if wanted else F.struct(F.lit(0).alias("_"))
    ends = spans.where("start < end").select("doc_id", fields.alias("_key"), F.explode(F.array(place("start", -1), place("end", 1))).alias("p"))
    nothing = [F.lit(0.0).alias("bits"), F.lit(0.0).alias("bytes"), F.lit(0).alias("k")]
    ends = ends.select("doc_id", "p.at", *nothing, "p.sign", "_key")
    edges = _edges(trace)
    all_ = edges.select("*", F.lit(0).alias("sign"), F.lit(None).cast(ends.schema["_key"].dataType).alias("_key")).unionByName(ends)
    total = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = _swept(all_).select("doc_id", "sign", "_key", F.sum("own_bits").over(total).alias("b"), F.sum("own_bytes").over(total).alias("n"))
    s = s.where("sign <> 0").select("doc_id", *[F.col(f"_key.`{c}`").alias(c) for c in wanted], (F.col("sign") * F.col("b")).alias("b"), (F.col("sign") * F.col("n")).alias("n"))
    g = s.groupBy("doc_id", *wanted).agg(F.sum("b").alias("bits"), F.round(F.sum("n")).cast("long").alias("bytes"))
    return g.where("bytes > 0")


def interval_loss(trace: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """(doc_id, by, bits, bytes, bpb): bits per covered byte of the union of each group's spans; no row without bytes."""
    merged = union(spans.select("doc_id", *by, "start", "end"), ["doc_id", *by])
    return _read_off(trace, merged, by).withColumn("bpb", F.col("bits") / F.col("bytes"))


def occurrence_loss(trace: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """(doc_id, by, start, end, bpb): bits per covered byte of each span; spans without a covered byte have no row."""
    key = [*by, "start", "end"]
    return _read_off(trace, spans.select("doc_id", *key), key).select("doc_id", *key, (F.col("bits") / F.col("bytes")).alias("bpb"))


def tail_mean(values: DataFrame, by: list[str], value: str, share: float = 0.1) -> DataFrame:
    """(by, tail): the mean of the ceil(share * n) greatest values, one at least."""
    w = Window.partitionBy(*by)
    v = values.withColumn("_n", F.count("*").over(w)).withColumn("_k", F.row_number().over(w.orderBy(F.desc(value))))
    return v.where(F.col("_k") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * share))).groupBy(*by).agg(F.avg(value).alias("tail"))


#: Roles whose difficulty is measured.
ROLES = ("identifier", "literal", "call_target", "expression", "assignment_rhs", "control_header", "declaration_header")
#: Sets of occurrences whose gain from context is measured.
CONTEXT_ROLES = ("identifier", "short_identifier", "call_target", "expression", "assignment_rhs", "control_header")
SHORT_NAMES = "abcdeijkmnxyz"


def role_difficulty(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, role, mean, tail, std): of the union of a role's spans, of its hardest tenth, and among its spans."""
    each = occurrence_loss(segments, spans, ["role"])
    std = each.groupBy("doc_id", "role").agg(F.stddev_pop("bpb").alias("std"))
    mean = interval_loss(segments, spans, ["role"]).select("doc_id", "role", F.col("bpb").alias("mean"))
    return mean.join(tail_mean(each, ["doc_id", "role"], "bpb"), ["doc_id", "role"]).join(std, ["doc_id", "role"])


def role_table(difficulty: DataFrame) -> DataFrame:
    """(doc_id, and mean, tail and std of each role): null where a document lacks the role."""
    wide = difficulty.groupBy("doc_id").pivot("role", list(ROLES)).agg(*[F.first(c).alias(c) for c in ("mean", "tail", "std")])
    return wide.withColumnsRenamed({f"{r}_{k}": v for r, k, v in (("assignment_rhs", "mean", "assignment_value_surprisal"), ("literal", "tail", "literal_tail_surprisal"), ("declaration_header", "std", "declaration_surprisal_variation"))})


def coverage(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, role, occurrences, scored, covered_bytes): how much of a role's spans the trace covers."""
    n = spans.groupBy("doc_id", "role").agg(F.count("*").alias("occurrences"))
    scored = occurrence_loss(segments, spans, ["role"]).groupBy("doc_id", "role").agg(F.count("*").alias("scored"))
    covered = interval_loss(segments, spans, ["role"]).select("doc_id", "role", F.col("bytes").alias("covered_bytes"))
    return n.join(scored, ["doc_id", "role"], "left").join(covered, ["doc_id", "role"], "left").na.fill(0, ["scored", "covered_bytes"])


def reuse_difficulty(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """spans of bindings (doc_id, binding, start, end): (doc_id, first, later, later_tail, increase, within_std).

    first and later are of the unions of bindings' first and later spans; increase and within_std are means over the
    bindings met twice or more whose spans are all covered.
    """
    k = F.row_number().over(Window.partitionBy("doc_id", "binding").orderBy("start", "end"))
    s = spans.withColumn("part", F.when(k == 1, "first").otherwise("later"))
    parts = interval_loss(segments, s, ["part"]).groupBy("doc_id").pivot("part", ["first", "later"]).agg(F.first("bpb"))
    each = occurrence_loss(segments, s, ["binding", "part"])
    tail = tail_mean(each.where("part = 'later'"), ["doc_id"], "bpb").withColumnRenamed("tail", "later_tail")
    n = s.groupBy("doc_id", "binding").agg(F.count("*").alias("n")).where("n > 1")
    one = F.max(F.when(F.col("part") == "first", F.col("bpb")))
    by = each.groupBy("doc_id", "binding").agg(F.count("*").alias("scored"), one.alias("one"), F.stddev_pop("bpb").alias("std"), F.collect_list(F.when(F.col("part") == "later", F.col("bpb"))).alias("rest"))
    by = by.join(n, ["doc_id", "binding"]).where("scored = n")
    up = F.aggregate("rest", F.lit(0.0), lambda a, x: a + F.greatest(x - F.col("one"), F.lit(0.0))) / F.size("rest")
    means = by.groupBy("doc_id").agg(F.avg(up).alias("increase"), F.avg("std").alias("within_std"))
    return parts.join(tail, "doc_id", "left").join(means, "doc_id", "left")


def context_difficulty(short: DataFrame, long: DataFrame, spans: DataFrame, size: int = 32) -> DataFrame:
    """(doc_id, role, gain, q10, scored, eligible, skipped): bits per byte in the short less that in the long context.

    Traces (doc_id, i, start, end, bits, text) must have equal tokens: documents where they differ are left out. An
    occurrence is eligible if every token over it lies past the first two blocks of `size`.
    """
    same = ["doc_id", "i", "start", "end"]
    print_ = lambda d: d.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.xxhash64(*same).cast("decimal(38,0)")).alias("h"))
    good = print_(short).join(print_(long), ["doc_id", "n", "h"]).select("doc_id")
    early = short.where(F.floor(F.col("i") / size) * size <= size)
    spans = spans.join(good, "doc_id", "left_semi").select("doc_id", "role", "start", "end").distinct()
    key = ["doc_id", "role", "start", "end"]
    cut = occurrence_loss(early, spans, ["role"]).select(*key)
    fit = spans.join(cut, key, "left_anti")
    each = [occurrence_loss(t, fit, ["role"]).withColumnRenamed("bpb", c) for t, c in ((short, "s"), (long, "l"))]
    gain = each[0].join(each[1], key).withColumn("g", F.col("s") - F.col("l"))
    out = gain.groupBy("doc_id", "role").agg(F.avg("g").alias("gain"), F.percentile("g", F.lit(0.1)).alias("q10"), F.count("*").alias("scored"))
    n = spans.groupBy("doc_id", "role").agg(F.count("*").alias("n")).join(cut.groupBy("doc_id", "role").agg(F.count("*").alias("skipped")), ["doc_id", "role"], "left").na.fill(0, ["skipped"])
    n = n.select("doc_id", "role", (F.col("n") - F.col("skipped")).alias("eligible"), "skipped")
    return n.join(out, ["doc_id", "role"], "left").na.fill(0, ["scored"])


def comment_gain(present: DataFrame, removed: DataFrame) -> DataFrame:
    """(doc_id, gain, tokens, bytes) from losses (doc_id, i, start, end, bits, text) of the same tokens with the comment
    before them and without it: what the comment saves, over the bytes that the tokens cover, each once."""
    j = present.join(removed.select("doc_id", "i", "start", "end", F.col("bits").alias("after")), ["doc_id", "i", "start", "end"])
    bits = j.groupBy("doc_id").agg(F.sum(F.col("after") - F.col("bits")).alias("saved"), F.count("*").alias("tokens"))
    size = allocation(present).groupBy("doc_id").agg(F.sum("bytes").alias("bytes"))
    return bits.join(size, "doc_id").select("doc_id", (F.col("saved") / F.col("bytes")).alias("gain"), "tokens", "bytes")


def group_loss(segments: DataFrame, spans: DataFrame, group: str) -> DataFrame:
    """(doc_id, group, bits, bytes, bpb, whole): by the groups of spans that don't overlap; whole says whether the groups'
    bytes add up to those of all spans together."""
    parts = interval_loss(segments, spans, [group])
    all_ = interval_loss(segments, spans, []).select("doc_id", F.col("bytes").alias("_all"))
    sums = parts.groupBy("doc_id").agg(F.sum("bytes").alias("_sum"))
    return parts.join(all_.join(sums, "doc_id").select("doc_id", (F.col("_all") == F.col("_sum")).alias("whole")), "doc_id")


def definitions() -> list[tuple[str, str, str, str]]:
    """(name, family, formula, roles) of every measure of token losses, by rule."""
    out = [("perplexity", "global", "exp(mean(loss))", ""), ("bpb", "global", "bits / bytes", ""), ("block_tail", "global", "mean of the hardest tenth of blocks", "")]
    for r in ROLES:
        out += [(f"{r}_mean", "role", "bits / bytes of the union of spans", r), (f"{r}_tail", "role", "mean of the hardest tenth of spans", r), (f"{r}_std", "role", "deviation among spans", r)]
    out += [(f"block_{k}", "block", f, "") for k, f in (("std", "deviation among blocks"), ("tail_ratio", "tail / whole"), ("jump_mean", "mean change between neighbours"), ("jump_q90", "0.9 quantile of changes"), ("run_ratio", "longest run above the 0.8 quantile / blocks"), ("gini", "Gini coefficient of blocks"))]
    out += [(f"identifier_{k}", "identifier", f, "identifier") for k, f in (("short", "bits / bytes of short names"), ("first", "of first spans"), ("later", "of later spans"), ("later_tail", "hardest tenth of later spans"), ("increase", "mean rise over the first span"), ("within_std", "mean deviation within bindings"), ("onset", "first pieces"), ("continuation", "later pieces"))]
    out += [(f"{r}_context_gain", "context", "mean of short less long context", r) for r in CONTEXT_ROLES] + [("identifier_context_q10", "context", "0.1 quantile of gains", "identifier")]
    return out + [("comment_gain", "comment", "bits saved / bytes", "comment"), ("comment_density", "comment", "bytes of comments / bytes", "comment")]


def blocks(tokens: DataFrame, size: int = 32) -> DataFrame:
    """(doc_id, block, bpb): bits per byte of each `size` tokens."""
    g = tokens.groupBy("doc_id", F.floor(F.col("i") / size).alias("block")).agg(F.sum("bits").alias("b"), F.sum("bytes").alias("n"))
    return g.select("doc_id", "block", (F.col("b") / F.col("n")).alias("bpb"))


def block_measures(blocks: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """Over a document's blocks: mean of the top tenth, also over the document's own loss (doc_id, bpb) where given,
    deviation, Gini, mean and 0.9 quantile of the jumps between them, and the longest run above their 0.8 quantile."""
    w = Window.partitionBy("doc_id")
    up = F.row_number().over(w.orderBy("bpb", "block"))
    b = blocks.withColumn("n", F.count("*").over(w)).withColumn("up", up).withColumn("jump", F.abs(F.col("bpb") - F.lag("bpb").over(w.orderBy("block"))))
    hot = blocks.join(blocks.groupBy("doc_id").agg(F.percentile("bpb", F.lit(0.8)).alias("q")), "doc_id").where("bpb > q")
    runs = hot.withColumn("island", F.col("block") - F.row_number().over(w.orderBy("block"))).groupBy("doc_id", "island").agg(F.count("*").alias("run")).groupBy("doc_id").agg(F.max("run").alias("run"))
    tail = F.when(F.col("n") - F.col("up") < F.greatest(F.lit(1), F.ceil(F.col("n") * 0.1)), F.col("bpb"))
    gini = F.when(F.sum("bpb") > 0, 2 * F.sum(F.col("up") * F.col("bpb")) / (F.max("n") * F.sum("bpb")) - (F.max("n") + 1) / F.max("n")).otherwise(0.0)
    g = b.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.avg(tail).alias("tail"), F.round(F.stddev_pop("bpb"), 6).alias("std"), F.round(gini, 6).alias("gini"), F.round(F.avg("jump"), 6).alias("jump_mean"), F.round(F.percentile("jump", F.lit(0.9)), 6).alias("jump_q90"))
    g = g.join(runs, "doc_id", "left").withColumn("run_ratio", F.round(F.coalesce("run", F.lit(0)) / F.col("blocks"), 6)).drop("run")
    if whole is not None:
        g = g.join(whole.select("doc_id", F.col("bpb").alias("_whole")), "doc_id").withColumn("tail_ratio", F.round(F.when(F.col("_whole") > 0, F.col("tail") / F.col("_whole")), 6)).drop("_whole")
    return g.withColumn("tail", F.round("tail", 6))


def reuse(occurrences: DataFrame) -> DataFrame:
    """(doc_id, first, later, increase): first and later occurrences of bindings by their bpb, over bindings met twice."""
    w = Window.partitionBy("doc_id", "binding")
    o = occurrences.withColumn("k", F.row_number().over(w.orderBy("start"))).withColumn("one", F.first("bpb").over(w.orderBy("start")))
    later = F.col("k") > 1
    by = o.groupBy("doc_id", "binding").agg(F.first("one").alias("first"), F.avg(F.when(later, F.col("bpb"))).alias("later"), F.avg(F.when(later, F.greatest(F.col("bpb") - F.col("one"), F.lit(0.0)))).alias("increase")).where("later is not null")
    # the added billionth keeps halves of the last place from going either way
    return by.groupBy("doc_id").agg(*[F.round(F.avg(c) + 1e-9, 6).alias(c) for c in ("first", "later", "increase")])


def context_gain(short: DataFrame, long: DataFrame, size: int = 32) -> DataFrame:
    """(doc_id, gain, q10, n): loss in the short less that in the long context, over tokens past the first two blocks.

    Both traces must agree on a token's bytes; where they don't the token is left out.
    """
    j = short.select("doc_id", "i", "bytes", F.col("bits").alias("s")).join(long.select("doc_id", "i", "bytes", F.col("bits").alias("l")), ["doc_id", "i", "bytes"])
    j = j.where(F.floor(F.col("i") / size) * size > size).withColumn("g", (F.col("s") - F.col("l")) / F.col("bytes"))
    return j.groupBy("doc_id").agg(F.round(F.avg("g"), 6).alias("gain"), F.round(F.percentile("g", F.lit(0.1)), 6).alias("q10"), F.count("*").alias("n"))
