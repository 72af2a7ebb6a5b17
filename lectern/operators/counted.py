"""Measures of documents that are counts of their tokens, each document walked over once where it lies.

A table of a few whole numbers for each document (how many, sums, sums of squares, greatest values) leaves the Python worker;
rates, deviations and roundings are columns of them. Facts of a token are told once for equal tokens.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.functions.scalar import ACCESS_TOKEN, CHUNK_TOKEN, IDENTIFIER, TOKEN
from lectern.operators import text as X

#: What a dot doesn't match in Java.
_ENDS = r"\n\r\x85\u2028\u2029"


def pattern(java: str) -> re.Pattern:
    """One of the token patterns, which have no other constructs that the two engines read differently."""
    return re.compile(java.replace(r"\\.", rf"\\[^{_ENDS}]").replace("#.*", rf"#[^{_ENDS}]*").replace(r"\z", r"\Z"), re.ASCII)


_QUOTED_OR_COMMENT, _TOKEN, _CHUNK, _ACCESS = (pattern(p) for p in (rf"{X.STRING}|{X.COMMENT}", TOKEN, CHUNK_TOKEN, ACCESS_TOKEN))
#: White space is ASCII's, but word edges are those of any letters.
_DECLARATION = re.compile(X.DECLARATION_LINE.replace(".*", rf"[^{_ENDS}]*").replace(r"\s", r"[ \t\n\x0b\f\r]"))
_NAME = re.compile(IDENTIFIER)
_SPACE, _NOT_LINE_END = re.compile(r"\s+", re.ASCII), re.compile(r"[^\n]+")


def _kept(m: re.Match) -> str:
    x = m[0]
    return "" if x.startswith("//") else _NOT_LINE_END.sub("", x) if x.startswith("/*") else x


def bare(text: str) -> str:
    """A text without comments; as text.strip_comments."""
    return _QUOTED_OR_COMMENT.sub(_kept, text) if "//" in text or "/*" in text else text


def lines(text: str) -> list[str]:
    """Physical lines; as text.line_array."""
    return text.replace("\r\n", "\n").replace("\r", "\n").removesuffix("\n").split("\n") if text else []


def measured(docs: DataFrame, names: str, measure: Callable[[str], tuple]) -> DataFrame:
    """(doc_id, names): whole numbers that `measure` tells of each text (doc_id, content); null texts are empty."""
    own = names.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t.as_py() or "") for t in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(len(own))]], names=["doc_id", *own])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "content").mapInArrow(run, f"doc_id {key}, " + ", ".join(f"{c} long" for c in own))


def moments(values: Counter) -> tuple[int, int, int, int]:
    """How many values there are, their sum, sum of squares, and the greatest (0 if none), from how often each is there."""
    return values.total(), sum(v * k for v, k in values.items()), sum(v * v * k for v, k in values.items()), max(values, default=0)


# ---- chunks


_REGEX_PAIRS = {"\\" + c for c in X.REGEX_CLASSES + X.REGEX_SIGNS}
_SETS = re.compile(r"\[([^\]]*)\]")
_KINDS = {x: k for k, own in reversed({"CONTROL_FLOW": X.CONTROL, "DECLARATION": X.DECLARE, **X.CHUNK_SIGNS}.items()) for x in own} | dict.fromkeys(["(", ")", *X.MODIFIERS])


def regex_like(literal: str) -> bool:
    """As text.looks_like_regex, of a literal with both of its quotes."""
    inner = literal[1:-1]
    pairs = {inner[i : i + 2] for i in range(max(len(inner) - 1, 1))}
    return bool(
        pairs & _REGEX_PAIRS
        or any(set(s) & set("^-\\") for s in _SETS.findall(inner))
        or pairs & {".*", ".+"} and set(inner) & set("^$|\\()")
        or len(inner) > 2 and (inner.startswith("^") or inner.endswith("$"))
        or "|" in inner and "||" not in pairs
    )


_WORD_PART = re.compile("[A-Z][a-z]+|[a-z]+|[0-9]+|[A-Z]+")


def parts(name: str) -> int:
    """How many subtokens a name has; as functions.scalar.subtokens."""
    return len(_WORD_PART.findall(_RUNS.sub(" \\g<0> ", name)))


_RUNS = re.compile("[A-Z][a-z]+|[a-z]+|[0-9]+")


@lru_cache(1 << 16)
def chunk(token: str, called: bool) -> tuple[str, str] | None:
    """(kind, lexeme) of a token before an opening bracket or not; None where it is no chunk. As text.chunk_lines."""
    first = token[0]
    if token in _KINDS:
        kind = _KINDS[token]
    elif first in "\"'":
        kind = "REGEX" if regex_like(token) else "LITERAL"
    else:
        kind = "LITERAL" if first in "0123456789" else "CALL" if called else "IDENTIFIER"
    lexeme = _SPACE.sub("", token)
    if kind is None or not lexeme:
        return None
    lexeme = ("literal_" if kind in ("LITERAL", "REGEX") else "call_" if kind == "CALL" else "") + lexeme
    return (kind, lexeme) if len(lexeme) <= X.LONGEST_LEXEME else None


@lru_cache(1 << 16)
def _chunk_facts(kind: str, lexeme: str) -> tuple[int, int, bool, bool, int]:
    """Characters, subtokens, whether it belongs to an expression, whether it is a name, and its digits."""
    return len(lexeme), parts(lexeme), kind in ("ARITHMETIC", "COMPARISON", "LOGICAL", "BITWISE", "ASSIGNMENT", "CALL"), kind == "IDENTIFIER", sum(c in "0123456789" for c in lexeme)


CHUNK_FIELDS = "lines line_sum line_squares line_most n chars chars_squares chars_most n_parts parts parts_squares parts_most distinct expressions literals names name_chars name_squares name_most single digits name_parts"


def chunk_counts(text: str) -> tuple:
    """CHUNK_FIELDS of a text: over lines with any chunk, over chunks, and over names."""
    found, a_line = Counter(), Counter()
    for line in lines(bare(text)):
        t = _CHUNK.findall(line)
        if t:
            own = [c for c in map(chunk, t, [x == "(" for x in t[1:]] + [False]) if c is not None]
            found.update(own)
            if own:
                a_line[len(own)] += 1
    chars, many, name_chars = Counter(), Counter(), Counter()
    expressions = literals = digits = name_parts = 0
    for (kind, lexeme), k in found.items():
        size, sub, expression, name, digit = _chunk_facts(kind, lexeme)
        chars[size] += k
        many[max(sub, 1)] += k
        expressions += k * expression
        literals += k * (kind == "LITERAL")
        if name:
            name_chars[size] += k
            digits, name_parts = digits + k * digit, name_parts + k * sub
    return (*moments(a_line), *moments(chars), *moments(many), len({x for _, x in found}), expressions, literals, *moments(name_chars), name_chars[1], digits, name_parts)


# ---- tokens


KINDS = ("keyword", "operator", "comparison", "number", "identifier", "period", "comma", "paren")
DENSITY_FIELDS = " ".join([*[f"n_{k}" for k in KINDS], *[f"c_{k}" for k in KINDS], "max_names", "max_numbers", "loc", "ink"])


def density_counts(language: str) -> Callable[[str], tuple]:
    """DENSITY_FIELDS of a text: tokens of each kind, their characters, the most names and numbers in a line, lines
    that are not blank, and characters that are no white space."""
    keywords, operators, comparisons, words = map(frozenset, X.LANGUAGES[language])
    single = {".": "period", ",": "comma", "(": "paren", ")": "paren"}

    def told(x: str) -> tuple[str, ...]:
        word, keyword, operator = x in words, x in keywords, x in operators
        rest = not (word or keyword or operator)
        own = [("keyword", keyword and not word), ("operator", operator and not word), ("comparison", x in comparisons and not word)]
        own += [("number", rest and x[0] in "0123456789"), ("identifier", rest and bool(_NAME.match(x)))]
        return (*[k for k, good in own if good], *([single[x]] if x in single else []))

    def count(text: str) -> tuple:
        found, kinds, names, numbers = Counter(), {}, 0, 0
        for line in lines(bare(text)):
            t = _TOKEN.findall(line)
            if not t:
                continue
            found.update(t)
            in_line = [0, 0]
            for x in t:
                k = kinds.get(x)
                if k is None:
                    k = kinds[x] = told(x)
                if "identifier" in k:
                    in_line[0] += 1
                elif "number" in k:
                    in_line[1] += 1
            names, numbers = max(names, in_line[0]), max(numbers, in_line[1])
        n, c = Counter(), Counter()
        for x, k in found.items():
            for kind in kinds[x]:
                n[kind] += k
                c[kind] += k * len(x)
        return (*[n[k] for k in KINDS], *[c[k] for k in KINDS], names, numbers, sum(bool(x.strip(" ")) for x in lines(text)), len(_SPACE.sub("", text)))

    return count


# ---- accesses


_LINKS = frozenset((*X.ACCESS, "(", ")", "[", "]"))


def access_counts(text: str) -> tuple[int, int, int]:
    """Chains of member accesses of a text, the longest, and all their accesses; as text.access_chains.

    One walk: of each bracket depth, the last token and the accesses of its open chain.
    """
    depth, near, open_, found = 0, {}, {}, Counter()
    for line in lines(bare(text)):
        if _DECLARATION.search(line):
            continue
        for x in _ACCESS.findall(line):
            if x[0] in "\"'`#":
                continue
            if x in ")]":
                depth -= 1
            name, sign = bool(_NAME.match(x)), x in X.ACCESS
            at = depth
            if x in "([":
                depth += 1
            if not (name or x in _LINKS) or at not in near or (name and near[at] not in X.ACCESS):
                found[open_.get(at, 0)] += 1
                open_[at] = 0
            open_[at] += sign
            near[at] = x
    for n in open_.values():
        found[n] += 1
    del found[0]
    return found.total(), max(found, default=0), sum(n * k for n, k in found.items())
