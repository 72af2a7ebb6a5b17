"""Systematic perturbations of texts, as rewrites of the whole table."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.functions.scalar import fingerprint
from lectern.operators.text import strip_comments

_PARTS = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^A-Za-z0-9_]+"


def comment_removal(docs: DataFrame) -> DataFrame:
    """docs without their comments, with how many there were and how many characters went."""
    from lectern.operators.text import COMMENT, STRING

    found = F.filter(F.regexp_extract_all("content", F.lit(rf"{STRING}|{COMMENT}"), F.lit(0)), lambda x: x.startswith("//") | x.startswith("/*"))
    bare = strip_comments(F.col("content"))
    d = docs.withColumn("comments", F.size(found)).withColumn("removed", F.length("content") - F.length(bare))
    return d.withColumn("content", bare)


@F.arrow_udf(StringType())
def hexadecimal(content: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Whole numbers of up to 15 digits without a leading zero in hexadecimal."""
    for texts in content:
        yield pa.array([None if t is None else _DIGITS.sub(_hex, t) for t in texts.to_pylist()], pa.string())


#: Runs of digits that no name or other digit stands before.
_DIGITS = re.compile("(?<![A-Za-z0-9_])[0-9]+")


def _hex(m: re.Match) -> str:
    x = m[0]
    return f"0x{int(x):x}" if len(x) <= 15 and (x == "0" or x[0] != "0") else x


def short_names(content: Column, keep: int = 3) -> Column:
    """Names cut to their first characters."""
    return F.regexp_replace(content, "([A-Za-z_][A-Za-z0-9_]{0,%d})[A-Za-z0-9_]*" % (keep - 1), "$1")


NAME = "[A-Za-z_][A-Za-z0-9_]*"


_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def letters(n: Column, most: int = 8) -> Column:
    """The nth name of letters: a to Z, then aa to ZZ, and so on, as long as it takes, up to `most` letters."""
    one = lambda k: F.substring(F.lit(_LETTERS), k.cast("int") + 1, F.lit(1))
    # how many letters, and the place among names of that length
    before = [sum(52**i for i in range(1, k)) for k in range(1, most + 2)]
    out = F.lit(None).cast("string")
    for k in range(most, 0, -1):
        place = n - before[k - 1]
        digits = [one(F.floor(place / F.lit(52**i)) % 52) for i in range(k - 1, -1, -1)]
        out = F.when(n < before[k], F.concat(*digits)).otherwise(out) if k == most else F.when(n < before[k], F.concat(*digits)).otherwise(out)
    return out


_NAME, _PART = re.compile(NAME), re.compile(_PARTS)


@lru_cache(1 << 16)
def _sha(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()


@lru_cache(1 << 16)
def _lettered(n: int) -> str:
    """The nth name of letters, as `letters` gives it."""
    out = ""
    while n >= 0:
        out, n = _LETTERS[n % 52] + out, n // 52 - 1
    return out


def _told(docs: DataFrame, to: str, tell: Callable[[str, list[str]], list[str]]) -> DataFrame:
    """(doc_id, name, `to`): what `tell` gives for a document's id and its names, each once, in the order of their SHA-256.

    A document's names are few beside the rows of a table, so they are told where it lies, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("doc_id"), batch.column("content"), strict=True):
                names = sorted(set(_NAME.findall(text.as_py() or "")), key=lambda x: (_sha(x), x))
                own = pa.array([key.as_py()] * len(names), batch.schema.field("doc_id").type)
                yield pa.RecordBatch.from_arrays([own, pa.array(names, pa.string()), pa.array(tell(str(key.as_py()), names), pa.string())], names=["doc_id", "name", to])

    return docs.select("doc_id", "content").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, name string, {to} string")


def garbled_names(docs: DataFrame) -> DataFrame:
    """(doc_id, name, garbled): a letter, or as many as are needed, for each name in the order of its SHA-256."""
    return _told(docs, "garbled", lambda doc, names: [_lettered(i) for i in range(len(names))])


@F.arrow_udf(StringType())
def garbled(content: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A text with its names exchanged for those of `garbled_names`: one table of names and one walk over its parts."""
    for texts in content:
        out = []
        for t in texts:
            parts = _PART.findall(t.as_py() or "")
            names = sorted({x for x in parts if _NAME.match(x)}, key=lambda x: (_sha(x), x))
            to = {x: _lettered(i) for i, x in enumerate(names)}
            out.append("".join([to.get(x, x) for x in parts]))
        yield pa.array(out, pa.string())


def renamed_short(docs: DataFrame, keep: int = 3) -> DataFrame:
    """(doc_id, name, renamed): names cut to their first characters; of those that would become one all but the first, in
    the order of their SHA-256, get a number."""
    return _told(docs, "renamed", lambda doc, names: _numbered([x[:keep] for x in names]))


def _numbered(words: Sequence[str]) -> list[str]:
    """Words of which all but the first of equal ones get a number."""
    used, out = {}, []
    for word in words:
        k = used[word] = used.get(word, 0) + 1
        out.append(word if k == 1 else f"{word}_{k}")
    return out


def renamed_misleading(docs: DataFrame, words: Sequence[str]) -> DataFrame:
    """(doc_id, name, misleading): a word of the length nearest to the name's, the shorter of two as near, chosen by a hash;
    of a document's names that would become one word all but the first, in the order of their SHA-256, get a number, so no
    two names of a document become one."""
    sizes = sorted({len(w) for w in words})
    by_size = {n: sorted(w for w in words if len(w) == n) for n in sizes}

    nearest = [by_size[min(sizes, key=lambda s: (abs(n - s), s))] for n in range(sizes[-1] + 1)]

    def word(doc: str, name: str) -> str:
        own = nearest[min(len(name), sizes[-1])]
        return own[int.from_bytes(hashlib.sha256(f"{doc}:{name}".encode()).digest()[:4]) % len(own)]

    return _told(docs, "misleading", lambda doc, names: _numbered([word(doc, x) for x in names]))


def rewritten(docs: DataFrame, names: DataFrame, to: str) -> DataFrame:
    """docs with their names exchanged for those of the table (doc_id, name, `to`): one map a document."""
    maps = names.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("name", to))).alias("_map"))
    parts = F.regexp_extract_all("content", F.lit(rf"{NAME}|[0-9]+|[^A-Za-z0-9_]+"), F.lit(0))
    j = docs.join(maps, "doc_id", "left")
    return j.withColumn("content", F.array_join(F.transform(parts, lambda x: F.coalesce(F.try_element_at("_map", x), x)), "")).drop("_map")


def class_corpus(files: DataFrame, kinds: Sequence[str], excluded: Sequence[str], each: int) -> DataFrame:
    """Files (project, path, content) of the wanted kinds outside excluded folders, `each` of a project: those with a method
    first, then of a middling size, then in the order of a seeded hash."""
    good = F.lit(True)
    for x in excluded:
        good = good & ~F.contains(F.col("path"), F.lit(x))
    kind = F.lit(False)
    for x in kinds:
        kind = kind | F.col("path").endswith(x)
    order = [F.desc(F.contains(F.col("content"), F.lit("("))), F.desc(F.length("content").between(1000, 20000)), fingerprint(F.concat(F.lit("5:"), "path")), "path"]
    return files.where(good & kind).withColumn("place", F.row_number().over(Window.partitionBy("project").orderBy(*order))).where(F.col("place") <= each)


#: A text in pieces: comments (a line's with its end), strings, white space, and what else there is.
_LAYOUT = re.compile(
    r"//[^\n]*\n?|/\*[^*]*+(?:\*++[^*/][^*]*+)*+(?:\*++/|\**+\Z)|\"\"\"[^\"\\]*+(?:(?:\\.|\"(?!\"\"))[^\"\\]*+)*+\"\"\""
    r"|\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"?|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?|\s++|[^\s\"'/]++|.",
    re.DOTALL | re.ASCII,
)


def compact_layout(content: Column, key: Column, share: int = 40) -> Column:
    """About `share` percent of the line breaks made single spaces: runs of white space with a line end, outside comments
    and strings and not at the text's ends.

    Of n such runs floor(share n / 100) go, one at least, but two always stay; which go is told by the SHA-256 of the key
    and the run's place.
    """

    @F.arrow_udf(StringType())
    def compact(content: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, keys in content:
            yield pa.array([_compact(t.as_py(), k.as_py() or "", share) for t, k in zip(texts, keys, strict=True)], pa.string())

    return compact(content, key)


def _compact(text: str | None, key: str, share: int) -> str | None:
    if text is None:
        return None
    pieces, runs, start = _LAYOUT.findall(text), [], 0
    for i, x in enumerate(pieces):
        if "\n" in x and x[0] in " \t\n\r\f\v" and 0 < i < len(pieces) - 1:
            runs.append((hashlib.sha256(f"{key}:{start}".encode()).digest(), i))
        start += len(x)
    for _, i in sorted(runs)[: max(0, min(len(runs) - 2, max(1, len(runs) * share // 100)))]:
        pieces[i] = " "
    return "".join(pieces)


SPECS = {
    "comments": lambda c, k: strip_comments(c),
    "hexadecimal": lambda c, k: hexadecimal(c),
    "short_names": lambda c, k: short_names(c),
    "compact": compact_layout,
}


def variants(docs: DataFrame, specs: dict = SPECS) -> DataFrame:
    """(doc_id, kind, position, content, content_sha256, changed): the original and each perturbation of it."""
    kinds = [("original", F.col("content")), *[(k, f(F.col("content"), F.col("doc_id").cast("string"))) for k, f in specs.items()]]
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("position"), c.alias("content")) for i, (k, c) in enumerate(kinds)])
    v = docs.select("doc_id", fingerprint(F.col("content")).alias("base"), F.explode(rows).alias("v")).select("doc_id", "base", "v.*").withColumn("content_sha256", fingerprint(F.col("content")))
    return v.withColumn("changed", F.col("content_sha256") != F.col("base")).drop("base")
