"""Rated corpora as a data source: spark.read.format("rated").option("layout", ...).load(path)."""

from __future__ import annotations

import csv
import io
import json
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lectern.sources.readers import ORDINAL

SCHEMA = "dataset string, task_id string, content string, readability_score double, metadata map<string, string>"
#: Items of a vote layout that one task reads the texts of.
ITEMS = 256


def _open(path: str):
    """(file system, path in it): of any store that Arrow knows by its address; a bare path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _read(path: str) -> str:
    store, own = _open(path)
    with store.open_input_stream(own) as f:
        return f.read().decode("utf-8")


#: Bytes of a file that one task takes lines of, and that are read at once.
RANGE, CHUNK = 1 << 24, 1 << 20


def _lines(path: str, first: int = 0, last: int = -1) -> Iterator[tuple[int, str]]:
    """(first byte, text) of the lines that begin within [first, last) of a file, up to its end where last is negative; a
    line and what was read beside it is all that is held."""
    store, own = _open(path)
    at = max(first - 1, 0)
    with store.open_input_file(own) if last >= 0 else store.open_input_stream(own) as f:
        if at:
            f.seek(at)
        held, skip, more = [], first > 0, b"-"
        while more:
            more = f.read(CHUNK)
            *whole, rest = more.split(b"\n")
            for x in whole:
                line = b"".join([*held, x])
                held = []
                if not skip:
                    yield at, line.decode("utf-8")
                skip, at = False, at + len(line) + 1
                if 0 <= last <= at:
                    return
            held.append(rest)
        if not skip:
            yield at, b"".join(held).decode("utf-8")


def _line_number(path: str, byte: int) -> int:
    """Which line begins at a byte, from 1."""
    return 1 + sum(at < byte for at, _ in _lines(path))


def _ranges(path: str) -> list[tuple[int, int]]:
    """A file's ranges of RANGE bytes; a compressed one is read from its beginning, as a whole."""
    import pyarrow as pa

    try:
        pa.Codec.detect(path)
        return [(0, -1)]
    except (ValueError, TypeError):  # no ending of a compressed file
        store, own = _open(path)
        return [(i, i + RANGE) for i in range(0, max(store.get_file_info(own).size, 1), RANGE)]


def _files(path: str) -> list[str]:
    """Addresses of the files at or under a path, in order; hidden ones and markers are left out."""
    from pyarrow import fs

    store, own = _open(path)
    info = store.get_file_info(own)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    base = path.rstrip("/")
    found = sorted(f.path for f in store.get_file_info(fs.FileSelector(own, recursive=True)) if f.type == fs.FileType.File)
    inside = [p[len(own.rstrip("/")) :].lstrip("/") for p in found]
    return [f"{base}/{p}" for p in inside if not any(x.startswith(("_", ".")) for x in p.split("/"))]


@dataclass
class Piece(InputPartition):
    """What one task reads: a file, of lines those that begin within the bytes from `first` up to `last`, and of a vote layout
    these items."""

    path: str
    first: int = 0
    last: int = -1


def _number(cell: str) -> float | None:
    cell = cell.strip()
    if not cell:
        return None
    x = float(cell)
    if not math.isfinite(x):
        raise ValueError(f"a vote that is not finite: {cell!r}")
    return x


def _rated(votes: list[float]) -> tuple[float | None, dict[str, str]]:
    told = {"rating_count": str(len(votes))}
    if votes:
        told |= {"rating_min": repr(min(votes)), "rating_max": repr(max(votes))}
    return (sum(votes) / len(votes) if votes else None), told


class Layout:
    """One form of files: how they are dealt to tasks and what rows they hold, as (task_id, content, score, metadata)."""

    def __init__(self, path: str, options: dict[str, str]):
        self.path, self.options = path.rstrip("/"), options

    def pieces(self) -> list[Piece]:
        return [Piece(p) for p in _files(self.path)]

    def rows(self, piece: Piece) -> Iterator[tuple]:
        raise NotImplementedError


class JsonLines(Layout):
    """An object a line: a name, text and score, or an id made of its parts and a verbal label."""

    def pieces(self) -> list[Piece]:
        return [Piece(p, *r) for p in _files(self.path) for r in _ranges(p)]

    def rows(self, piece: Piece) -> Iterator[tuple]:
        for at, line in _lines(piece.path, piece.first, piece.last):
            if not line.strip():
                continue
            try:
                r = json.loads(line)
            except ValueError as e:
                raise ValueError(f"{piece.path}, line {_line_number(piece.path, at)}: {e}") from None
            task = r.get("name") or r.get("item_id") or "__".join(str(r[k]) for k in ("dataset", "source_id", "generator_model") if r.get(k) is not None)
            score = r["score"] if r.get("score") is not None else ORDINAL.get(str(r.get("readability", "")).lower())
            yield task, r.get("code_snippet", r.get("code")), None if score is None else float(score), {}


class JsonArray(Layout):
    """One array of objects, whose code has escaped line ends and quotes."""

    def rows(self, piece: Piece) -> Iterator[tuple]:
        found = json.loads(_read(piece.path))
        if not isinstance(found, list):
            raise ValueError(f"{piece.path}: no array")
        for r in found:
            code = r.get("code")
            score = r.get("readability_score")
            yield r.get("task_id"), code if code is None else code.replace("\\r\\n", "\n").replace("\\n", "\n").replace('\\"', '"'), None if score is None else float(score), {}


class Votes(Layout):
    """A CSV of raters by items, and each item's text in a file of its own."""

    def table(self) -> list[list[str]]:
        rows = list(csv.reader(io.StringIO(_read(f"{self.path}/{self.options['votes']}"))))
        if not rows:
            raise ValueError(f"{self.options['votes']} is empty")
        return rows

    def items(self) -> list[tuple[str, str, int]]:
        """(task_id, file, column) of each item."""
        raise NotImplementedError

    def pieces(self) -> list[Piece]:
        self.table()
        n = len(self.items())
        return [Piece(self.path, i, min(n, i + ITEMS)) for i in range(0, n, ITEMS)]

    def votes(self, rows: list[list[str]], column: int) -> list[float]:
        """A column's votes; blank cells and rows that end before it don't count."""
        return [x for r in rows if column < len(r) for x in [_number(r[column])] if x is not None]

    def more(self, rows: list[list[str]]) -> dict[str, str]:
        return {}

    def body(self, rows: list[list[str]]) -> list[list[str]]:
        return rows

    def rows(self, piece: Piece) -> Iterator[tuple]:
        rows = self.table()
        body, more = self.body(rows), self.more(rows)
        for task, file, column in self.items()[piece.first : piece.last]:
            score, told = _rated(self.votes(body, column))
            yield task, _read(f"{self.path}/{file}"), score, told | more


class VoteMatrix(Votes):
    """No header; a rater, a group and exactly `items` votes a row, each item rated; groups are counted."""

    def table(self) -> list[list[str]]:
        rows, n = super().table(), int(self.options["items"])
        for i, r in enumerate(rows, 1):
            if len(r) != n + 2:
                raise ValueError(f"row {i} of the votes has {len(r)} columns, not {n + 2}")
        for k in range(n):
            if not self.votes(rows, k + 2):
                raise ValueError(f"item {k + 1} has no votes")
        return rows

    def items(self) -> list[tuple[str, str, int]]:
        return [(str(k), f"{self.options.get('texts', 'snippets')}/{k}{self.options.get('suffix', '')}", k + 1) for k in range(1, int(self.options["items"]) + 1)]

    def more(self, rows: list[list[str]]) -> dict[str, str]:
        return {f"group:{k}": str(n) for k, n in sorted(Counter(r[1].strip() for r in rows).items())}


class HeaderVotes(Votes):
    """A header whose columns but the first name the items: a prefix and a number, anything else is an error."""

    def items(self) -> list[tuple[str, str, int]]:
        prefix, out = self.options.get("prefix", "Snippet"), []
        for i, name in enumerate(self.table()[0][1:], 1):
            number = name.strip().removeprefix(prefix)
            if not name.strip().startswith(prefix) or not number.isdigit():
                raise ValueError(f"no score column: {name!r}")
            out.append((str(int(number)), f"{self.options.get('texts', 'snippets')}/{int(number)}{self.options.get('suffix', '')}", i))
        return out

    def body(self, rows: list[list[str]]) -> list[list[str]]:
        return rows[1:]


class LanguageVotes(Votes):
    """A folder of texts and a CSV without header for each language; columns after the rater's are the texts in the order of
    their numbers, rows may end early."""

    def items(self) -> list[tuple[str, str, int]]:
        folder, suffix = f"{self.options.get('texts', 'snippets')}/{self.options['language']}", self.options.get("suffix", "")
        names = [p.rsplit("/", 1)[-1] for p in _files(f"{self.path}/{folder}")]
        numbers = sorted(int(n.removesuffix(suffix)) for n in names if n.endswith(suffix) and n.removesuffix(suffix).isdigit())
        return [(f"{self.options['language']}/{k}", f"{folder}/{k}{suffix}", i) for i, k in enumerate(numbers, 1)]

    def more(self, rows: list[list[str]]) -> dict[str, str]:
        return {"language": self.options["language"]}


class Arff(Layout):
    """Comments, a declared header and rows of numbers: the declared attributes as metadata, the class as task."""

    def rows(self, piece: Piece) -> Iterator[tuple]:
        names: list[str] = []
        for n, line in enumerate(_read(piece.path).splitlines(), 1):
            line = line.strip()
            if not line or line.startswith("%"):
                continue
            if line.startswith("@"):
                if line.lower().startswith("@attribute"):
                    names.append(line.split(None, 2)[1].strip("'\""))
                continue
            cells = next(csv.reader([line]))
            if len(cells) != len(names):
                raise ValueError(f"{piece.path}, line {n}: {len(cells)} values for {len(names)} attributes")
            yield f"{piece.path.rsplit('/', 1)[-1]}:{n}", None, None, dict(zip(names, (c.strip() for c in cells), strict=True))


LAYOUTS: dict[str, Callable[[str, dict[str, str]], Layout]] = {
    "json_lines": JsonLines, "json_array": JsonArray, "vote_matrix": VoteMatrix, "header_votes": HeaderVotes, "language_votes": LanguageVotes, "arff": Arff,
}


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.dataset = options.get("dataset", "")
        self.layout = LAYOUTS[options["layout"]](options["path"], options)

    def partitions(self) -> list[Piece]:
        return self.layout.pieces()

    def read(self, partition: Piece | None) -> Iterator[tuple]:
        if partition is None:  # what Spark gives where there are no partitions
            return
        for row in self.layout.rows(partition):
            yield (self.dataset, *row)


class RatedCorpus(DataSource):
    """Rated corpora of any layout as (dataset, task_id, content, readability_score, metadata).

    Options: layout (one of LAYOUTS), dataset (its name), and of the vote layouts votes (the CSV), texts (the folder),
    suffix (of the files), items, prefix or language. A task reads a file, the lines that begin in
    some bytes of it, or some items of a vote layout. Headers, row
    lengths, votes and lines that break their layout's rules are errors that name the place; a path without files has no
    rows.
    """

    @classmethod
    def name(cls) -> str:
        return "rated"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        if options.get("layout") not in LAYOUTS:
            raise ValueError(f"layout must be one of {', '.join(LAYOUTS)}")
        return _Reader(options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RatedCorpus)
