"""Lexers as one pass of a pattern that tiles the text: Python's tokens, and the lexical roles of brace languages.

A pattern cuts a text into pieces that leave nothing out, so that places are running sums of the pieces' lengths. All of
it is column expressions: a document is read where it lies, and only the relations expand what was found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lectern.functions.arrays import once, running
from lectern.operators.text import JAVA_KEYWORDS, PYTHON_KEYWORDS, PYTHON_WORDS

# Loops over groups are possessive: they match the same, and long texts don't make the regex engine recurse.
_WORD = r"[\p{L}\p{Nl}_][\p{L}\p{N}\p{Mn}\p{Mc}\p{Pc}]*+"
_NO_WORD_BEFORE, _NO_WORD_BEHIND = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: Where a word of any alphabet begins or ends.
_WORD_EDGE = rf"(?:(?<=[\p{{L}}\p{{N}}_]){_NO_WORD_BEHIND}|{_NO_WORD_BEFORE}(?=[\p{{L}}\p{{N}}_]))"


def _delimited(quote: str, lines: bool) -> str:
    """A string between quotes in which a backslash takes the next character with it, over line ends or not."""
    other = rf"[^{quote}\\]*+" if lines else rf"[^{quote}\\\n]*+"
    return rf"{quote}{other}(?:\\.{other})*+{quote}"


def _tripled(q: str) -> str:
    return rf"{q}{q}{q}[^{q}\\]*+(?:(?:\\.|{q}(?!{q}{q}))[^{q}\\]*+)*+{q}{q}{q}"


_DIGITS = r"[0-9](?:_?[0-9])*+"
# The operators and delimiters of Python, and the words that old snippets use as such.
PYTHON_SIGNS = (
    "**= //= >>= <<= ... != == <= >= -> := += -= *= /= %= &= |= ^= @= ** // << >> + - * / % @ & | ^ ~ < > = ( ) [ ] { } , . : ;"
).split()
FRAGMENT_SIGNS = "**= //= <<= >>= == != <= >= += -= *= /= %= &= |= ^= ** // << >> := -> + - * / % @ & | ^ ~ < > = ( ) [ ] { } , . :".split()
FRAGMENT_WORDS = "print exec".split()


def _signs(signs: list[str]) -> str:
    return "|".join("".join("\\" + c for c in s) for s in signs)


PYTHON_PIECE = "(?s)" + "|".join([
    r"#[^\r\n]*",
    rf"(?:[rRbBuUfF]|[rR][bBfF]|[bBfF][rR])?(?:{_tripled(chr(34))}|{_tripled(chr(39))}|{_delimited(chr(34), False)}|{_delimited(chr(39), False)})",
    rf"(?:0[xX](?:_?[0-9a-fA-F])++|0[bB](?:_?[01])++|0[oO](?:_?[0-7])++|(?:{_DIGITS}\.(?:{_DIGITS})?|\.{_DIGITS}|{_DIGITS})(?:[eE][+-]?{_DIGITS})?[jJ]?)",
    _WORD, _signs(PYTHON_SIGNS), r"\\\r?\n", r"\r\n|\r|\n", r"[ \t\f]+", ".",
])
FRAGMENT_TOKEN = "|".join([
    "#.*", _delimited(chr(34), True), _delimited(chr(39), True), rf"{_NO_WORD_BEFORE}[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?{_NO_WORD_BEHIND}",
    rf"{_NO_WORD_BEFORE}[A-Za-z_][\p{{L}}\p{{N}}_]*+", _signs(FRAGMENT_SIGNS),
])
_LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"


def _python_kind(x: Column) -> Column:
    """What a piece is: comment, end (of a line), blank, join (of two lines), string, number, keyword, name, operator, or
    other, which no token begins with."""
    first = F.left(x, F.lit(1))
    return (
        F.when(first == "#", "comment")
        .when(x.isin("\n", "\r", "\r\n"), "end")
        .when(first.isin(" ", "\t", "\f"), "blank")
        .when((first == "\\") & (F.length(x) > 1), "join")
        .when((F.length(x) > 1) & F.right(x, F.lit(1)).isin('"', "'"), "string")
        .when(x.isin(*PYTHON_SIGNS), "operator")
        .when(x.rlike(r"^\.?[0-9]"), "number")
        .when(x.isin(*PYTHON_KEYWORDS, *PYTHON_WORDS), "keyword")
        .when(x.rlike(r"^[\p{L}\p{Nl}_]"), "name")
        .otherwise("other")
    )


def _width(blank: Column) -> Column:
    """The column that white space at a line's beginning leads to: tabs go to the next multiple of eight."""
    step = lambda a, c: F.when(c == "\t", (F.floor(a / 8) + 1) * 8).when(c == "\f", F.lit(0)).otherwise(a + 1).cast("int")
    return F.when(F.contains(blank, F.lit("\t")) | F.contains(blank, F.lit("\f")), F.aggregate(F.split(blank, ""), F.lit(0), step)).otherwise(F.length(blank))


def _well_formed(pieces: Column) -> Column:
    """Whether pieces (x, kind) are the tokens of a whole text: nothing else between them, brackets that close in turn, and
    lines that go back only to the indent of a line before.

    An automaton over the pieces: the open brackets as a string of those that close them, the stack of indents, and
    whether a logical line is about to begin, at which column. Indents compare alike whether tabs count as eight or as one.
    """
    closing = lambda x: F.translate(x, "([{", ")]}")

    def step(s: Column, p: Column) -> Column:
        x, kind = p["x"], p["kind"]
        part = lambda **new: F.struct(*[new.get(k, s[k]).alias(k) for k in ("ok", "open", "indents", "fresh", "width", "alone")])
        back = F.filter(s["indents"], lambda i: i["width"] <= s["width"])
        top, below = F.element_at(s["indents"], -1), F.element_at(back, -1)
        own = F.struct(s["width"].alias("width"), s["alone"].alias("alone"))
        deeper = s["width"] > top["width"]
        indents = F.when(~s["fresh"], s["indents"]).when(deeper, F.concat(s["indents"], F.array(own))).otherwise(back)
        ok = s["ok"] & (~s["fresh"] | F.when(deeper, s["alone"] > top["alone"]).otherwise(below == own))
        opens, shuts = x.isin("(", "[", "{"), x.isin(")", "]", "}")
        open_ = F.when(opens, F.concat(closing(x), s["open"])).when(shuts, F.substring(s["open"], 2, 1 << 30)).otherwise(s["open"])
        good = ok & (kind != "other") & (~shuts | F.startswith(s["open"], x))
        within = s["open"] != ""
        return (
            F.when(~s["ok"], s)
            .when(kind == "end", F.when(within, s).otherwise(part(fresh=F.lit(True), width=F.lit(0), alone=F.lit(0))))
            .when(kind == "blank", F.when(s["fresh"], part(width=_width(x), alone=F.length(F.regexp_replace(x, ".*\f", "")))).otherwise(s))
            .when(kind.isin("comment", "join"), s)
            .otherwise(part(ok=good, open=open_, indents=indents, fresh=F.lit(False)))
        )

    left = F.struct(F.lit(0).alias("width"), F.lit(0).alias("alone"))
    start = F.struct(F.lit(True).alias("ok"), F.lit("").alias("open"), F.array(left).alias("indents"), F.lit(True).alias("fresh"), F.lit(0).alias("width"), F.lit(0).alias("alone"))
    return F.aggregate(pieces, start, step, lambda s: s["ok"] & (s["open"] == ""))


def python_tokens(content: Column) -> Column:
    """A Python text's `strict` (whether it is well formed) and `tokens`: array of (line from 1, token, kind) without
    comments, white space and line ends; kind is keyword, name, number, string or operator.

    A string, also one over several lines or of an f-string with all it holds, is one token. A text that isn't well formed,
    such as a snippet with open brackets or quotes, is read line by line by a simpler pattern: what it doesn't match is
    passed over, a # ends the line, and print and exec count as keywords. A null text is empty.
    """
    text = F.coalesce(content, F.lit(""))
    pieces = F.transform(F.regexp_extract_all(text, F.lit(PYTHON_PIECE), F.lit(0)), lambda x: F.struct(x.alias("x"), _python_kind(x).alias("kind")))
    token = lambda line, x, kind: F.struct(line.cast("int").alias("line"), x.alias("token"), kind.alias("kind"))
    breaks = lambda p: F.transform(p, lambda x: F.when(x["kind"].isin("end", "string", "join"), F.regexp_count(x["x"], F.lit(r"\r\n|\r|\n"))).otherwise(0))

    def whole(p: Column) -> Column:
        before = lambda s: F.transform(p, lambda x, i: token(F.get(s["run"], i) - F.get(s["own"], i) + 1, x["x"], x["kind"]))
        all_ = once(breaks(p), lambda own: once(F.struct(running(own).alias("run"), own.alias("own")), before))
        return F.filter(all_, lambda t: ~t["kind"].isin("comment", "end", "blank", "join"))

    def fragment(line: Column, i: Column) -> Column:
        found = F.regexp_extract_all(line, F.lit(FRAGMENT_TOKEN), F.lit(0))
        note = F.array_position(F.transform(found, lambda x: x.startswith("#")), True)
        own = F.when(note > 0, F.slice(found, F.lit(1), (note - 1).cast("int"))).otherwise(found)
        kind = lambda x: F.when(x.rlike("^[\"']"), "string").when(x.rlike("^[0-9]"), "number").when(x.isin(*PYTHON_KEYWORDS, *PYTHON_WORDS, *FRAGMENT_WORDS), "keyword").when(x.rlike("^[A-Za-z_]"), "name").otherwise("operator")
        return F.transform(own, lambda x: token(i + 1, x, kind(x)))

    lines = F.flatten(F.transform(F.split(text, _LINE_END), fragment))
    return once(pieces, lambda p: once(_well_formed(p), lambda ok: F.struct(ok.alias("strict"), F.when(ok, whole(p)).otherwise(lines).alias("tokens"))))


def python_halstead(content: Column) -> Column:
    """strict, length, vocabulary, volume of a Python text: operators and keywords are operators, all else operands."""

    def measures(t: Column) -> Column:
        acts = lambda x: x["kind"].isin("operator", "keyword")
        distinct = lambda good: F.size(F.array_distinct(F.transform(F.filter(t["tokens"], good), lambda x: x["token"])))
        n, v = F.size(t["tokens"]).cast("long"), (distinct(acts) + distinct(lambda x: ~acts(x))).cast("long")
        return once(F.struct(n.alias("n"), v.alias("v")), lambda s: F.struct(t["strict"].alias("strict"), s["n"].alias("length"), s["v"].alias("vocabulary"), F.when(s["v"] > 1, s["n"] * F.log2(s["v"])).otherwise(0.0).alias("volume")))

    return once(python_tokens(content), measures)


# Words of brace languages that name nothing, beside the keywords of Java; and words that are literals.
BRACE_WORDS = (
    "record sealed permits var yield auto register signed sizeof struct typedef union unsigned _Bool inline restrict namespace template typename using virtual explicit "
    "friend operator bool wchar_t nullptr delete dynamic_cast static_cast reinterpret_cast const_cast constexpr consteval constinit decltype noexcept thread_local alignas "
    "alignof co_await co_return co_yield __global__ __device__ __host__ __shared__ __constant__ __managed__ __restrict__ __launch_bounds__ __align__ __noinline__ __forceinline__"
).split()
LITERAL_WORDS = "true false null nullptr".split()
ROLE_PIECE = "(?s)" + "|".join([
    r"//[^\n]*", r"/\*[^*]*+(?:\*++[^*/][^*]*+)*+\*++/",
    _tripled(chr(34)), rf"(?:u8|[LuU])?{_delimited(chr(34), True)}|[LuU]?{_delimited(chr(39), True)}",
    rf"{_NO_WORD_BEFORE}(?:0[xX][0-9a-fA-F]+|0[bB][01]+|[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?)[uUlLfFdD]*{_WORD_EDGE}",
    r"[\p{L}\p{Nl}_][\p{L}\p{N}_$]*+|\$[\p{L}\p{N}_$]++", r"/\*", ".",
])


_LITERALS, _KEYWORDS = frozenset(LITERAL_WORDS), frozenset([*JAVA_KEYWORDS, *BRACE_WORDS])


def lexical_roles(content: Column) -> Column:
    """What the lexer alone tells of a text of a brace language: `spans`, array of (role, start, end, byte_start, byte_end)
    of its identifiers, literals and comments, and `unterminated`.

    Places count code points and UTF-8 bytes from 0, ends are exclusive. Where a string or comment is never closed reading
    ends: unterminated is the end of the last token before it (0 if none), else null. A null text is empty.
    """
    pieces, told = _role_pieces(content)
    return _roles_of(pieces, told)


def _role_pieces(content: Column) -> tuple[Column, Column]:
    """The pieces of a text, and what Java's letters and numbers beyond ASCII are of it: a letter each with a mark before it
    (n where it can't begin a name, l otherwise)."""
    text = F.coalesce(content, F.lit(""))
    far = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}&&[^\x00-\x7F]]"), F.lit(0)))
    mark = lambda c: F.concat(F.when(c.rlike(r"[\p{L}\p{Nl}]"), "l").otherwise("n"), c)
    return F.regexp_extract_all(text, F.lit(ROLE_PIECE), F.lit(0)), F.transform(far, mark)


ROLES = ("broken", "comment", "literal", "digit", "keyword", "identifier", "other")
#: Pieces that are worked on at once.
_PIECES = 1 << 18


def _role(x: str, names: set[str]) -> int:
    """What a piece is by itself, as a place in ROLES; names are the characters beyond ASCII that names begin with."""
    first = x[0]
    if x in ('"', "'", "/*"):
        return 0
    if x.startswith(("//", "/*")):
        return 1
    if len(x) > 1 and (x[-1] in "\"'" or first in "0123456789"):
        return 2
    if first in "0123456789":
        return 3
    if x in _LITERALS:
        return 2
    if x in _KEYWORDS:
        return 4
    if first == "_" or first.isascii() and first.isalpha() or first in names or len(x) > 1 and first == "$":
        return 5
    return 6


def _spans(pieces: pa.Array, told: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """For slices of documents: of each span its document in the slice, role, start, end, byte start and byte end; and of
    each document where reading ends, -1 if nowhere.

    Equal pieces are told once; places are running sums over the slice, less those at a document's beginning.
    """
    sizes = np.nan_to_num(pieces.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    begin = 0
    while begin < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[begin : begin + _PIECES]), _PIECES)))
        own, size = pieces.slice(begin, n), sizes[begin : begin + n]
        marks = pc.unique(told.slice(begin, n).flatten()).to_pylist()
        begin += n
        encoded = own.flatten().dictionary_encode()
        code, values = encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary
        words = values.to_pylist()
        names, far = {m[1] for m in marks if m[0] == "l"}, {m[1] for m in marks}
        joins = lambda c: c == "_" or c.isascii() and c.isalnum() or c in far
        kind = np.array([_role(x, names) for x in words], np.int8)[code] if len(words) else np.zeros(0, np.int8)
        chars = np.array([len(x) for x in words], np.int64)[code] if len(words) else np.zeros(0, np.int64)
        size_bytes = pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)[code] if len(words) else chars
        doc = np.repeat(np.arange(len(size)), size)
        first = np.concatenate([[0], np.cumsum(size)])
        ends, byte_ends = (np.concatenate([[0], np.cumsum(x)]) for x in (chars, size_bytes))
        ends, byte_ends = (x[1:] - x[first[doc]] for x in (ends, byte_ends))
        # a single digit is a literal unless its neighbours are of the same word
        at = np.flatnonzero(kind == 3)
        if len(at):
            tail, head = np.array([joins(x[-1]) for x in words])[code], np.array([joins(x[0]) for x in words])[code]
            before = (at > first[doc[at]]) & tail[at - 1]
            after = (at + 1 < first[doc[at] + 1]) & head[np.minimum(at + 1, len(head) - 1)]
            kind[at] = np.where(before | after, 6, 2)
        # what stands before the first piece that is broken
        stop = first[1:].copy()
        broken = np.flatnonzero(kind == 0)
        np.minimum.at(stop, doc[broken], broken)
        read = np.arange(len(kind)) < stop[doc]
        unterminated = np.where(stop < first[1:], 0, -1)
        token = np.flatnonzero(read & (kind != 6))
        cut = token[unterminated[doc[token]] >= 0]
        np.maximum.at(unterminated, doc[cut], ends[cut])
        s = token[kind[token] != 4]
        yield doc[s], kind[s], ends[s] - chars[s], ends[s], byte_ends[s] - size_bytes[s], byte_ends[s], unterminated


_SPAN = StructType([StructField("role", StringType()), *[StructField(c, IntegerType()) for c in ("start", "end", "byte_start", "byte_end")]])


@F.arrow_udf(StructType([StructField("spans", ArrayType(_SPAN)), StructField("unterminated", IntegerType())]))
def _roles_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for pieces, told in batches:
        parts = []
        for doc, kind, *places, unterminated in _spans(pieces, told):
            role = pa.array(ROLES).take(pa.array(kind))
            spans = pa.StructArray.from_arrays([role, *[pa.array(x.astype(np.int32)) for x in places]], names=["role", "start", "end", "byte_start", "byte_end"])
            off = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(unterminated)))]).astype(np.int32)
            parts.append(pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(off), spans), pa.array(unterminated.astype(np.int32), mask=unterminated < 0)], names=["spans", "unterminated"]))
        yield pa.concat_arrays(parts)


def role_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, identifiers, literals, comments, chars, byte_ends, unterminated) of texts (doc_id, content): how many spans of
    lexical_roles there are of each role, sums of their lengths and of their byte ends, and where reading ends."""
    names = ["identifiers", "literals", "comments", "chars", "byte_ends", "unterminated"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            for doc, kind, start, end, _, byte_end, unterminated in _spans(batch.column("p"), batch.column("told")):
                n = len(unterminated)
                of = lambda role: np.bincount(doc[kind == ROLES.index(role)], minlength=n)
                add = lambda x: np.bincount(doc, x, n).astype(np.int64)
                own = [of("identifier"), of("literal"), of("comment"), add(end - start), add(byte_end)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, n), *[pa.array(x.astype(np.int64)) for x in own], pa.array(unterminated.astype(np.int64), mask=unterminated < 0)], names=["doc_id", *names])
                begin += n

    pieces, told = _role_pieces(F.col("content"))
    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", pieces.alias("p"), told.alias("told")).mapInArrow(run, f"doc_id {key}, " + ", ".join(f"{c} long" for c in names))


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, strict, line, token, kind) of Python texts (doc_id, content)."""
    t = docs.select("doc_id", python_tokens(F.col("content")).alias("t"))
    return t.select("doc_id", "t.strict", F.explode("t.tokens").alias("x")).select("doc_id", "strict", "x.*")


def roles(docs: DataFrame) -> DataFrame:
    """(doc_id, role, start, end, byte_start, byte_end) of texts of brace languages (doc_id, content)."""
    t = docs.select("doc_id", F.explode(lexical_roles(F.col("content"))["spans"]).alias("x"))
    return t.select("doc_id", "x.*")
