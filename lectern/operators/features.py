"""Per-document measures, worked out where a document is read: arrays of lines, tokens and chunks, nothing shuffled."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lectern.functions.arrays import counts, deviation, largest, mean, once, running, total, variation
from lectern.functions.scalar import IDENTIFIER, sigmoid, subtokens
from lectern.operators import counted
from lectern.operators import text as X
from lectern.operators.sweeps import TOGETHER


def r6(c: Column) -> Column:
    return F.round(c, 6)


def parsed(docs: DataFrame, language: str = "java") -> DataFrame:
    """docs (doc_id, content, more) with _lines, _code (the lines without comments), _tokens and _chunks, line by line."""
    d = docs.withColumn("_lines", X.line_array(F.col("content"))).withColumn("_code", X.line_array(X.strip_comments(F.col("content"))))
    return d.withColumn("_tokens", X.token_lines(F.col("_code"))).withColumn("_chunks", X.chunk_lines(F.col("_code")))


def _written(d: DataFrame) -> Column:
    """Lines that are not blank."""
    return F.filter("_lines", lambda l: F.trim(l) != "")


def line_stats(docs: DataFrame) -> DataFrame:
    """Over non-blank lines: their number, lengths, share of long ones, indents and steps between indents; a document
    without any has zeros."""
    d = docs.withColumn("_lines", X.line_array(F.col("content")))
    d = d.withColumn("_own", _written(d)).withColumn("_len", F.transform("_own", lambda l: F.length(l).cast("double")))
    d = d.withColumn("_indent", F.transform("_own", lambda l: (F.length(l) - F.length(F.ltrim(l))).cast("double")))
    d = d.withColumn("_step", F.transform(F.slice("_indent", 2, F.greatest(F.size("_indent") - 1, F.lit(0))), lambda x, i: F.abs(x - F.get("_indent", i))))
    n, zero = F.size("_own"), lambda c: r6(F.coalesce(c, F.lit(0.0)))
    share = lambda most: F.size(F.filter("_len", lambda x: x > most)) / F.greatest(n, F.lit(1))
    return d.select(
        "doc_id",
        n.cast("long").alias("loc"),
        r6(F.log1p(n)).alias("log_loc"),
        zero(mean(F.col("_len"))).alias("mean_length"),
        zero(deviation(F.col("_len"))).alias("std_length"),
        largest(F.col("_len")).cast("long").alias("max_length"),
        r6(share(80)).alias("over_80"),
        r6(share(100)).alias("over_100"),
        zero(mean(F.col("_indent"))).alias("mean_indent"),
        zero(deviation(F.col("_indent"))).alias("std_indent"),
        largest(F.col("_indent")).cast("long").alias("max_indent"),
        r6(variation(F.col("_indent"))).alias("indent_cv"),
        zero(mean(F.col("_step"))).alias("mean_step"),
        zero(deviation(F.col("_step"))).alias("std_step"),
        largest(F.col("_step")).cast("long").alias("max_step"),
    )


def chunk_stats(docs: DataFrame) -> DataFrame:
    """Chunks: number, per line with any their mean and deviation, share of distinct lexemes, lengths in characters and in
    word parts, and expressions against literals. Identifiers: lengths, single letters, digits, word parts."""
    d = counted.measured(docs, counted.CHUNK_FIELDS, counted.chunk_counts)
    mean_ = lambda of, n: F.when(F.col(n) > 0, F.col(of) / F.col(n)).otherwise(0.0)
    spread = lambda of, squares, n: F.when(F.col(n) > 0, F.sqrt(F.col(n) * F.col(squares) - F.col(of) * F.col(of)) / F.col(n)).otherwise(0.0)
    cv = lambda of, squares, n: F.when(F.col(of) > 0, spread(of, squares, n) / mean_(of, n)).otherwise(0.0)
    least = lambda c: F.greatest(F.col(c), F.lit(1))
    return d.select(
        "doc_id",
        F.col("n").alias("n_chunks"),
        r6(mean_("line_sum", "lines")).alias("per_line"),
        r6(spread("line_sum", "line_squares", "lines")).alias("per_line_std"),
        r6(F.col("distinct") / least("n")).alias("unique_ratio"),
        r6(F.log1p(mean_("chars", "n"))).alias("log_mean_chars"),
        r6(cv("chars", "chars_squares", "n")).alias("chars_cv"),
        r6(F.log1p("chars_most")).alias("log_max_chars"),
        r6(cv("parts", "parts_squares", "n")).alias("parts_cv"),
        r6(F.log1p("expressions") - F.log1p("literals")).alias("expression_literal"),
        r6(mean_("name_chars", "names")).alias("name_mean"),
        r6(spread("name_chars", "name_squares", "names")).alias("name_std"),
        F.col("name_most").alias("name_max"),
        r6(cv("name_chars", "name_squares", "names")).alias("name_cv"),
        r6(F.col("single") / least("names")).alias("single_letter"),
        r6(F.col("digits") / least("name_chars")).alias("digit_share"),
        r6(mean_("name_parts", "names")).alias("name_parts"),
    )


def chunk_inventory(docs: DataFrame) -> DataFrame:
    """A count and a share of all chunks for each of the chunk types, comments and imports among them."""
    lexical = [t for t in X.CHUNK_TYPES if t not in ("COMMENT", "IMPORT", "UNUSED_IMPORT")]
    d = parsed(docs).withColumn("_kinds", F.transform(F.flatten("_chunks"), lambda c: c["kind"]))
    many = lambda t: F.size(F.filter("_kinds", lambda k: k == t)).cast("long").alias(f"n_{t.lower()}")
    own = d.select("doc_id", *map(many, lexical))
    notes = X.comment_lines(X.comments(docs)).groupBy("doc_id").agg(F.count("*").alias("n_comment"))
    named = X.imports(docs).groupBy("doc_id").agg(F.count_if("used").alias("n_import"), F.count_if(~F.col("used")).alias("n_unused_import"))
    all_ = own.join(notes, "doc_id", "left").join(named, "doc_id", "left").na.fill(0)
    names = [f"n_{t.lower()}" for t in X.CHUNK_TYPES]
    n = F.greatest(sum(map(F.col, names)), F.lit(1))
    return all_.select("doc_id", *names, *[r6(F.col(c) / n).alias(f"share_{c[2:]}") for c in names])


def token_density(docs: DataFrame, language: str = "java") -> DataFrame:
    """Tokens of a kind for each non-blank line, the most names and numbers in one line, and the share of the text's
    characters that keywords and operators take, also against those of names. Equal tokens are told once.
    """
    d = counted.measured(docs, counted.DENSITY_FIELDS, counted.density_counts(language))
    rate = lambda kind: r6(F.col(f"n_{kind}") / F.greatest("loc", F.lit(1)))
    ink = F.greatest("ink", F.lit(1))
    return d.select(
        "doc_id",
        *[rate(k).alias(f"{k}s_per_line") for k in ("keyword", "operator", "comparison", "period", "comma", "paren")],
        "max_names",
        "max_numbers",
        r6(F.col("c_keyword") / ink).alias("keyword_area"),
        r6(F.col("c_operator") / ink).alias("operator_area"),
        r6(F.col("c_keyword") / F.greatest("c_identifier", F.lit(1))).alias("keyword_name_area"),
    )


#: Token kinds whose places on the page are measured.
PLACED = {"identifier": lambda x: X.vocabulary(x)["identifier"], "keyword": lambda x: X.vocabulary(x)["keyword"], "operator": lambda x: X.vocabulary(x)["operator"], "period": lambda x: x == ".", "number": lambda x: X.vocabulary(x)["number"]}


def vertical_position(docs: DataFrame) -> DataFrame:
    """Where tokens of a kind, comments and chunks stand on the page: (doc_id, kind, mean_y, std_y, line_span) with
    y = (line - 1) / (lines - 1); kinds that a document lacks have no row."""
    d = parsed(docs).withColumn("_last", F.greatest(F.size("_lines") - 1, F.lit(1)))
    found = F.filter(F.regexp_extract_all("content", F.lit(rf"(?s){X.STRING}|{X.COMMENT}|\r\n|[\r\n]"), F.lit(0)), lambda x: x.rlike(r"^(?://|/\*|[\r\n])"))
    ends = lambda x: F.regexp_count(x, F.lit(r"\r\n|\r|\n"))
    # the line that each comment begins on: the line ends before it
    lines = lambda p: once(running(F.transform(p, ends)), lambda r: F.transform(p, lambda x, i: F.struct((F.get(r, i) - ends(x)).alias("line"), x.startswith("/").alias("note"))))
    notes = F.transform(F.filter(once(found, lines), lambda x: x["note"]), lambda x: x["line"])

    def at(array: str, good) -> Column:
        return F.flatten(F.transform(array, lambda t, i: F.transform(F.filter(t, good), lambda _: i)))

    kinds = {**{k: at("_tokens", good) for k, good in PLACED.items()}, "chunk": at("_chunks", lambda _: F.lit(True)), "comment": notes}
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("at")) for k, c in kinds.items()])
    d = d.select("doc_id", "_last", F.explode(rows).alias("x")).where(F.size("x.at") > 0)
    y = F.transform("x.at", lambda i: i / F.col("_last"))
    return d.select("doc_id", "x.kind", r6(mean(y)).alias("mean_y"), r6(deviation(y)).alias("std_y"), (F.array_max("x.at") - F.array_min("x.at") + 1).cast("long").alias("line_span"))


def halstead(docs: DataFrame, language: str = "java") -> DataFrame:
    """docs with length, vocabulary, volume and n_lines: tokens of the text without its comments; keywords and operators
    are operators, all other tokens operands; all lines count, blank ones too."""
    d = docs.withColumn("_t", F.flatten(X.token_lines(X.line_array(X.strip_comments(F.col("content"))))))
    keywords, operators, _, _ = X.LANGUAGES[language]
    acts = lambda x: x.isin(*keywords, *operators)
    d = d.withColumn("length", F.size("_t").cast("long"))
    distinct = F.array_distinct("_t")
    d = d.withColumn("vocabulary", (F.size(F.filter(distinct, acts)) + F.size(F.filter(distinct, lambda x: ~acts(x)))).cast("long"))
    d = d.withColumn("n_lines", F.size(X.line_array(F.col("content"))).cast("long"))
    return d.withColumn("volume", F.when(F.col("vocabulary") > 1, F.col("length") * F.log2("vocabulary")).otherwise(0.0)).drop("_t")


@F.pandas_udf(DoubleType())
def entropy(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Shannon entropy of the bytes of UTF-8 texts, in bits: one histogram of 256 counts a text."""
    for texts in batches:
        out = []
        for t in texts:
            n = np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=256) if t else np.zeros(0)
            p = n[n > 0] / max(1, n.sum())
            out.append(float(-(p * np.log2(p)).sum()) + 0.0)
        yield pd.Series(out)


def byte_entropy(docs: DataFrame) -> DataFrame:
    """(doc_id, entropy, n_bytes)"""
    return docs.select("doc_id", entropy("content").alias("entropy"), F.octet_length("content").cast("long").alias("n_bytes"))


def posnett(volume: Column, lines: Column, entropy: Column) -> Column:
    """The published simple model of readability, as a probability."""
    return sigmoid(8.87 - 0.033 * volume + 0.40 * lines - 1.5 * entropy)


def spectral_energy(values: Column, bins: int = 4) -> Column:
    """Share of a series' energy, without its mean, in its lowest frequencies.

    The transform at k is two sums over the series; by Parseval the whole is the centred sum of squares, so only `bins`
    frequencies are computed. Frequencies k and n - k are one, and the middle one of an even n counts half.
    """

    def own(s: Column) -> Column:
        n, m = F.size(s), mean(s)
        c = F.transform(s, lambda x: x - m)
        part = lambda wave, k: F.aggregate(F.transform(c, lambda x, t: x * wave(2 * math.pi * k * t / n)), F.lit(0.0), lambda a, x: a + x)
        low = sum((F.when(2 * F.lit(k) <= n, part(F.cos, k) ** 2 + part(F.sin, k) ** 2).otherwise(0.0) for k in range(1, bins + 1)), F.lit(0.0))
        # the transform at n/2, which stands alone among the pairs
        middle = total(F.transform(c, lambda x, t: F.when(t % 2 == 0, x).otherwise(-x)))
        whole = (n * total(F.transform(c, lambda x: x * x)) + F.when(n % 2 == 0, middle**2).otherwise(0.0)) / 2
        return F.when(whole > 1e-9, low / whole).otherwise(0.0)

    return F.get(F.transform(F.array(values), own), F.lit(0))


#: The series by line whose low frequencies are measured, from lines and tokens.
def series() -> dict[str, Column]:
    v = lambda kind: (lambda x: X.vocabulary(x)[kind])
    t = F.col("_tokens")
    return {
        "length": F.transform("_lines", lambda l: F.length(l).cast("double")),
        "identifiers": counts(t, v("identifier")),
        "keywords": counts(t, v("keyword")),
        "periods": counts(t, lambda x: x == "."),
        "commas": counts(t, lambda x: x == ","),
        "comparisons": counts(t, v("comparison")),
    }


def spectra(docs: DataFrame) -> DataFrame:
    """(doc_id, a low-frequency share for each series)"""
    return parsed(docs).select("doc_id", *[spectral_energy(c).alias(f"low_{k}") for k, c in series().items()])


def aligned_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs): runs of one character that is no space, in one column of two or more lines on end.

    Lines are arrays of code points of the document's own row, and each is compared with the one above it: nothing is
    expanded or shuffled, and a task holds the arrays of as many documents at a time as have TOGETHER bytes. Documents
    without a character have no row.
    """

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        off = batch.column("lines").offsets.to_numpy()
        size = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column("lines").values).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))])
        cut = (size[off[1:]] - size[off[0]]) // TOGETHER
        edges = np.append(np.flatnonzero(np.append(True, cut[1:] != cut[:-1])[: len(cut)]), len(cut))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(lo, hi - lo)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b)):
            lines = batch.column("lines")
            many = lines.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            text = lines.flatten()
            size = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
            ch = np.frombuffer("".join(text.to_pylist()).encode("utf-32-le"), np.uint32)
            begins, line = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
            top = np.cumsum(many) - many  # the first line of each document has none above it
            first = np.zeros(len(size) + 1, bool)
            first[top] = True
            col, up = np.arange(len(ch)) - begins[line], np.maximum(line - 1, 0)
            above = np.where(~first[line] & (col < size[up]), begins[up] + col, -1)
            same = (above >= 0) & (ch == ch[above]) & (ch != 32)
            second = same & ~same[above]
            doc = np.repeat(np.arange(len(many)), many)[line]
            runs, chars = np.bincount(doc[second], minlength=len(many)), np.bincount(doc, minlength=len(many))
            some = np.flatnonzero(chars)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(some)), pa.array(runs[some].astype(np.int64))], names=["doc_id", "runs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", X.line_array(F.col("content")).alias("lines")).mapInArrow(run, f"doc_id {kind}, runs long")


def line_coherence(docs: DataFrame) -> DataFrame:
    """(doc_id, coherence): greatest cosine between two lines, each word weighed by 1 / its count in the document.

    A document's lines are rows of a sparse matrix that meet block by block where the document is read, so that a word
    on every line costs no pairs of rows; documents without two lines that share a word have no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(i, _most_alike(t)) for i, t in zip(batch["doc_id"], batch["words"], strict=True)]
            yield pd.DataFrame([x for x in found if x[1] is not None], columns=["doc_id", "coherence"])

    words = F.transform(X.token_lines(X.line_array(X.strip_comments(F.col("content")))), lambda t: F.transform(F.filter(t, lambda x: x.rlike(IDENTIFIER)), lambda x: F.lower(x)))
    return docs.select("doc_id", words.alias("words")).mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, coherence double")


def _most_alike(lines: list, block: int = 256) -> float | None:
    """The greatest cosine of two rows that share something, in blocks of rows against all later rows."""
    names: dict[str, int] = {}
    rows = [np.unique([names.setdefault(w, len(names)) for w in own], return_counts=True) for own in lines if len(own)]
    if len(rows) < 2:
        return None
    whole = np.bincount(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]))
    lines_of = np.bincount(np.concatenate([r[0] for r in rows]))
    rows = [(w, n / whole[w]) for w, n in rows]
    norm = np.array([np.sqrt((v * v).sum()) for _, v in rows])
    order = np.concatenate([np.full(len(w), i) for i, (w, _) in enumerate(rows)])
    col, val = np.concatenate([w for w, _ in rows]), np.concatenate([v for _, v in rows])
    shared = lines_of[col] > 1
    order, col, val = order[shared], col[shared], val[shared]
    best = None
    for x in range(0, len(rows), block):
        own = (order >= x) & (order < x + block)
        cols, at = np.unique(col[own], return_inverse=True)
        if not len(cols):
            continue
        # the block as a dense matrix over its own words only
        a = np.zeros((block, len(cols)))
        a[order[own] - x, at] = val[own]
        place = np.searchsorted(cols, col)
        meets = (place < len(cols)) & (cols[np.minimum(place, len(cols) - 1)] == col) & (order >= x)
        for y in range(x, len(rows), block):
            other = meets & (order >= y) & (order < y + block)
            if not other.any():
                continue
            b = np.zeros((block, len(cols)))
            b[order[other] - y, place[other]] = val[other]
            dot = a @ b.T
            i, j = np.nonzero(dot > 0)
            i, j = i[i + x < j + y], j[i + x < j + y]
            if len(i):
                top = float((dot[i, j] / (norm[i + x] * norm[j + y])).max())
                best = top if best is None else max(best, top)
    return best


def short_name_share(docs: DataFrame, short: str = "abcdeijkmnxyz") -> DataFrame:
    """(doc_id, share): of the identifier chunks those that are one of the short names."""
    names = F.filter(F.flatten(X.chunk_lines(X.line_array(X.strip_comments(F.col("content"))))), lambda c: c["kind"] == "IDENTIFIER")
    return docs.select("doc_id", r6(F.size(F.filter(names, lambda c: c["lexeme"].isin(*short))) / F.greatest(F.size(names), F.lit(1))).alias("share"))


def word_overlap(names: DataFrame, words: DataFrame) -> DataFrame:
    """How names' words show among others: (doc_id, most, coverage) from (doc_id, word) names and words."""
    n = names.distinct()
    c = words.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    return n.join(c, ["doc_id", "word"], "left").groupBy("doc_id").agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), r6(F.count("n") / F.count("*")).alias("coverage"))
