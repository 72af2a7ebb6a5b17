"""Column functions over texts and numbers. All are built from Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the lexers take for tokens, ASCII-only and without look-around, so that every engine reads them alike.
OPERATOR = r">>>=|>>=|<<=|\+\+|--|==|!=|>=|<=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>>|>>|->|::"
QUOTED = r"\"[^\"\\]*(?:\\.[^\"\\]*)*\"|'[^'\\]*(?:\\.[^'\\]*)*'"
TOKEN = rf"{OPERATOR}|[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?[A-Za-z]*|{QUOTED}|[{{}}()\[\];,.:?~!%^&*+\-/=<>|]"
CHUNK_TOKEN = rf"{QUOTED}|0[xX][0-9A-Fa-f]+|[0-9]+(?:\.[0-9]+)?|[A-Za-z_][A-Za-z0-9_]*|==|!=|<=|>=|&&|\|\||<<|>>|\+\+|--|\+=|-=|\*=|/=|%=|[()+\-*/%<>&|^~=!]"
ACCESS_TOKEN = rf"{QUOTED}|`[^`]*`|#.*|[A-Za-z_$][A-Za-z0-9_$]*|[0-9][A-Za-z0-9_.]*|\?\.|::|->|[^\x20\x09-\x0D]"
IDENTIFIER = r"^[A-Za-z_$][A-Za-z0-9_$]*$"
NUMBER = r"^[0-9]"


def fingerprint(c: Column) -> Column:
    """SHA-256 of the UTF-8 text, in hex: the identity of a content."""
    return F.sha2(c.cast("binary"), 256)


def slug(c: Column) -> Column:
    """A path-safe form: runs of other characters become one hyphen; none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "-"), "^[-._]+|[-._]+$", "")


def subtokens(c: Column) -> Column:
    """The lower-case words of a camel-case, snake-case or numbered identifier."""
    spread = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", " "), "([A-Z][a-z]+|[a-z]+|[0-9]+)", " $1 ")
    return F.filter(F.split(F.lower(spread), " +"), lambda w: w != "")


def middle_cut(c: Column, limit: int = 6000, marker: str = "\n...\n") -> Column:
    """A text within limit characters as it is; a longer one as its head and tail around a marker."""
    room = limit - len(marker)
    head = (room + 1) // 2
    cut = F.concat(F.substring(c, 1, head), F.lit(marker), F.right(c, F.lit(room - head)))
    return F.when(F.length(c) > limit, cut).otherwise(c)


def segments(c: Column, size: int = 3000, overlap: int = 300) -> Column:
    """Overlapping pieces of a text, as an array; the one that reaches the end is the last."""
    step = size - overlap
    last = F.ceil(F.greatest(F.lit(0), F.length(c) - size) / step).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(c, i * step + 1, F.lit(size)))


def finite(c: Column) -> Column:
    """A number, or null where it is not finite."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def level(c: Column) -> Column:
    """LOW up to 0.4, MEDIUM up to 0.6, HIGH above; empty where there is no finite score."""
    return F.when(finite(c).isNull(), "").when(c <= 0.4, "LOW").when(c <= 0.6, "MEDIUM").otherwise("HIGH")


def expected_rating(c: Column) -> Column:
    """A vector {p4,p3,p2,p1} of probabilities as the rating to expect on a scale from 4 to 1."""
    p = F.transform(F.split(F.regexp_replace(c, "[{} ]", ""), ","), lambda x: x.try_cast("double"))
    return F.aggregate(F.zip_with(p, F.array(*[F.lit(float(x)) for x in (4, 3, 2, 1)]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)


def percentile_rank(place: Column, n: Column) -> Column:
    """Average ranks from 1 to n, taken to 0 to 1."""
    return (place - 1) / F.greatest(n - 1, F.lit(1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, floor: float = 1e-12) -> Column:
    n = F.greatest(norm(a), F.lit(floor))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def stable_index(n: int, *parts: Column) -> Column:
    """A choice from 0 to n - 1 that depends on the parts alone: the head of their SHA-256."""
    head = F.substring(F.sha2(F.concat_ws(":", *parts).cast("binary"), 256), 1, 8)
    return F.conv(head, 16, 10).cast("long") % n


def namespaced(*parts: Column) -> Column:
    """A feature's name within its namespace and family."""
    return F.concat_ws("__", *parts)


def family(name: Column) -> Column:
    """The family that a feature's name tells: the part after the namespace, else what stands before the first underscore."""
    parts = F.split(name, "__")
    return F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise(F.regexp_extract(name, "^([^_]*)", 1))


def without_surrogates(c: Column) -> Column:
    """A text with lone surrogates replaced, as before it is hashed."""
    return F.regexp_replace(c, "[\\x{D800}-\\x{DFFF}]", "\ufffd")


def reusable(record: Column) -> Column:
    """Whether a nested record (result: score, reasoning; error) holds a finite score with a reason, and no error."""
    good = finite(record["result"]["score"]).isNotNull() & record["error"].isNull() & (F.length(F.trim(record["result"]["reasoning"])) > 0)
    return F.coalesce(good, F.lit(False))


_TYPE = r"(^|[^A-Za-z0-9_])(class|interface|enum|record)\s+[A-Za-z_]"


def complete_type(c: Column) -> Column:
    """Whether a text declares a type, strings and line comments set aside."""
    bare = F.regexp_replace(F.regexp_replace(c, r"\"[^\"\n]*\"|'[^'\n]*'", '""'), r"//[^\n]*", "")
    return bare.rlike(_TYPE)


def wrapped(c: Column) -> Column:
    """A text that declares a type as it is; another within one."""
    return F.when(complete_type(c), c).otherwise(F.concat(F.lit("class Snippet {\n"), c, F.lit("\n}")))


def metrics(c: Column) -> Column:
    """Lines of `name: value` as a map to numbers; NaN is kept, what is no number is passed over."""
    lines = F.filter(F.split(c, "\n"), lambda l: l.rlike(r"^\s*[A-Za-z][^:]*:\s*(?:[+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?|NaN)\s*$"))
    pair = lambda l: F.struct(F.trim(F.regexp_extract(l, "^([^:]*):", 1)).alias("k"), F.trim(F.regexp_extract(l, ":(.*)$", 1)).try_cast("double").alias("v"))
    return F.map_from_entries(F.filter(F.transform(lines, pair), lambda p: p["v"].isNotNull()))


def first_object(c: Column) -> Column:
    """The first balanced JSON object of a text, braces within strings set aside; null without one.

    Strings and braces are cut out first; the depth at each brace is a running count, and the object ends where the depth
    that the first brace opened is closed.
    """
    parts = F.regexp_extract_all(c, F.lit(r'"[^"\\]*(?:\\.[^"\\]*)*"|[{}]|[^"{}]+|"'), F.lit(0))

    def found(p: Column) -> Column:
        step = lambda a, x: F.when(a["done"], a).otherwise(_step(a, x))
        zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("from"), F.lit(0).alias("i"), F.lit(False).alias("done"))
        end = F.aggregate(p, zero, step)
        return F.when(end["done"], F.array_join(F.slice(p, end["from"], end["i"] - end["from"] + 1), ""))

    return F.get(F.transform(F.array(parts), found), F.lit(0))


def _step(a: Column, x: Column) -> Column:
    i = a["i"] + 1
    depth = a["depth"] + F.when(x == "{", 1).when((x == "}") & (a["depth"] > 0), -1).otherwise(0)
    begins = (a["depth"] == 0) & (x == "{")
    return F.struct(depth.alias("depth"), F.when(begins, i).otherwise(a["from"]).alias("from"), i.alias("i"), ((a["depth"] > 0) & (depth == 0)).alias("done"))
