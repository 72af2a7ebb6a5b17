"""Python's tokens against the standard library's own tokenizer, lexical roles against a plain scan, and both by hand."""

import glob
import io
import keyword
import os
import re
import tokenize

import pytest
from pyspark.sql import functions as F

from lectern.operators import lexing as L


def by_library(source):
    """(line, token) of the standard tokenizer; f-strings with all they hold as one token; None where it fails."""
    lines, out, depth, began = source.splitlines(keepends=True), [], 0, None
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            name = tokenize.tok_name[t.type]
            if name == "FSTRING_START":
                began = t.start if depth == 0 else began
                depth += 1
            elif name == "FSTRING_END":
                depth -= 1
                if depth == 0:
                    (a, x), (b, y) = began, t.end
                    out.append((a, lines[a - 1][x:y] if a == b else "".join([lines[a - 1][x:], *lines[a : b - 1], lines[b - 1][:y]])))
            elif depth == 0 and name in ("NAME", "NUMBER", "OP", "STRING"):
                out.append((t.start[0], t.string))
    except (IndentationError, SyntaxError, tokenize.TokenError):
        return None
    return out


def lexed(spark, sources):
    d = spark.createDataFrame(list(enumerate(sources)), "doc_id int, content string").repartition(4)
    return {r["doc_id"]: r["t"] for r in d.select("doc_id", L.python_tokens(F.col("content")).alias("t")).collect()}


def test_python_sources_of_the_standard_library(spark):
    """Every token and its line, in sixty modules."""
    files = sorted(f for f in glob.glob(os.path.join(os.path.dirname(os.__file__), "*.py")) if os.path.getsize(f) < 60_000)[:60]
    sources = [open(f, encoding="utf-8").read() for f in files]
    got = lexed(spark, sources)
    for i, source in enumerate(sources):
        assert got[i]["strict"], files[i]
        assert [(t["line"], t["token"]) for t in got[i]["tokens"]] == by_library(source), files[i]
        for t in got[i]["tokens"]:
            assert (t["kind"] == "keyword") == keyword.iskeyword(t["token"])


GOOD = [
    "def add(left, right):\n    return left + right\n", "# explain\nx = 1\n", "if a:\n\tb\n\tif c:\n\t    d\ne\n", "x = (1,\n  2)\ny = [\n]\n", 'd = """a\n"b" \\""" """\ne = 1\n', "s = 'a\\\nb'\nt = 2\n", "a = b \\\n  + c\n",
    "\n\n   # only a comment\n\nx\n", "        value = legacy_call(item)\n        print value\n", "x = 0x_ff + 1_000.5e-3j + .5 + 5. + 0b1 + 0o7\n", "r'\\d' Rb'x' u'é' F'a'\n", "été = naïve1 ** 2 // 3 -> x := ...\n", "if a:\n    b\n\n  # odd\n    c\nd\n", "class A: pass", "", "a;b\r\nc\r\n",
]
BAD = ["if a:\n\tb\n        c\n", "x = (1\n", "x = 1)\n", "x = [1)\n", "'open\n", '"""never closed\n', "if a:\n        b\n    c\n", "a ? b\n", "x = $y\n", "a \\ b\n"]


def test_python_texts_by_hand(spark):
    got = lexed(spark, [*GOOD, *BAD])
    for i, source in enumerate(GOOD):
        assert got[i]["strict"] and [(t["line"], t["token"]) for t in got[i]["tokens"]] == by_library(source), source
    for i, source in enumerate(BAD, len(GOOD)):
        assert not got[i]["strict"], source
    kinds = {t["token"]: t["kind"] for t in got[0]["tokens"]}
    assert kinds == {"def": "keyword", "add": "name", "(": "operator", "left": "name", ",": "operator", "right": "name", ")": "operator", ":": "operator", "return": "keyword", "+": "operator"}


def test_python_fragments_are_read_line_by_line(spark):
    source = "print value # note ' here\nx = foo(1.5e3, 'a\\'b'\ny //= z ; exec \"code\"\n1abc _b2 café 'open\n"
    t = lexed(spark, [source])[0]
    assert not t["strict"]
    assert [(x["line"], x["token"], x["kind"]) for x in t["tokens"]] == [
        (1, "print", "keyword"), (1, "value", "name"), (2, "x", "name"), (2, "=", "operator"), (2, "foo", "name"), (2, "(", "operator"), (2, "1.5e3", "number"), (2, ",", "operator"), (2, "'a\\'b'", "string"),
        (3, "y", "name"), (3, "//=", "operator"), (3, "z", "name"), (3, "exec", "keyword"), (3, '"code"', "string"), (4, "_b2", "name"), (4, "café", "name"), (4, "open", "name"),
    ]


def test_comments_leave_python_halstead_alone(spark):
    plain = "def add(left, right):\n    return left + right\n"
    d = spark.createDataFrame([(1, plain), (2, "# explain the addition\n" + plain), (3, "x"), (4, None), (5, "open( it")], "doc_id int, content string")
    got = {r["doc_id"]: r["h"] for r in d.select("doc_id", L.python_halstead(F.col("content")).alias("h")).collect()}
    assert got[1] == got[2] and (got[1]["length"], got[1]["vocabulary"]) == (12, 10)
    assert got[1]["volume"] == pytest.approx(12 * 3.321928094887362)
    assert (got[3]["volume"], got[4]["volume"], got[4]["length"], got[4]["strict"]) == (0.0, 0.0, 0, True)
    assert not got[5]["strict"] and got[5]["length"] == 3


# ---- lexical roles

LEXEME = re.compile(
    r"(?P<comment>//[^\n]*|/\*[\s\S]*?\*/)"
    r'|(?P<literal>"""[\s\S]*?"""|(?:u8|[LuU])?"(?:\\[\s\S]|[^"\\])*"|[LuU]?\'(?:\\[\s\S]|[^\'\\])*\'|\b(?:0[xX][\da-fA-F]+|0[bB][01]+|[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?)[uUlLfFdD]*\b)'
    r"|(?P<name>[^\W\d][\w$]*|\$[\w$]+)"
)


def scanned(source):
    """Spans and where reading ends, found with Python's own engine by matches and the gaps between them."""
    out, at = [], 0
    for m in [*LEXEME.finditer(source), None]:
        gap = source[at : m.start() if m else len(source)]
        if any(x in gap for x in ('"', "'", "/*")):
            return out, at
        if m:
            at, x = m.end(), m.group()
            role = "identifier" if m.lastgroup == "name" else m.lastgroup
            role = "literal" if x in L.LITERAL_WORDS else "keyword" if x in (*L.JAVA_KEYWORDS, *L.BRACE_WORDS) else role
            if role != "keyword":
                out.append((role, m.start(), m.end()))
    return out, None


TEXTS = [
    "int a = 0x1F + b2; // note 'x'\nString s = \"é\\\" /* no */\"; /* a\n* b */ char c = '\\'';", "/** doc */ class A<T> { boolean ok = true; }", "x = 12abc + 1. + .5 + 1e9f + 7 + a1 1$a $b 0x1G", 'class D { String text = "unterminated text', "a /* open", "it's one", "", "a\n\"\"\"block\n\"q\" \"\"\" b",
    "u8\"x\" L'y' nullptr null 3", "été = ñ2; // ünï\n中文 9", "/* ** */ /**/ //", "a'b'c \"d\"e\" f",
]


def test_roles_equal_a_plain_scan(spark):
    rows = list(enumerate([*TEXTS, " ".join(TEXTS[:3]) * 40]))
    d = spark.createDataFrame([*rows, (99, None)], "doc_id int, content string").repartition(3)
    got = {r["doc_id"]: r["r"] for r in d.select("doc_id", L.lexical_roles(F.col("content")).alias("r")).collect()}
    assert got[99]["spans"] == [] and got[99]["unterminated"] is None
    for i, source in rows:
        spans, stop = scanned(source)
        assert ([(s["role"], s["start"], s["end"]) for s in got[i]["spans"]], got[i]["unterminated"]) == (spans, stop), source
        for s in got[i]["spans"]:
            assert source.encode()[s["byte_start"] : s["byte_end"]].decode() == source[s["start"] : s["end"]]
    assert {r["doc_id"] for r in L.roles(d).collect()} == {i for i, t in rows if scanned(t)[0]}


def test_long_texts_dont_recurse(spark):
    long = '"' + "\\n" * 300_000 + '" + /*' + "* " * 300_000 + "*/ x"
    d = spark.createDataFrame([(1, long)], "doc_id int, content string")
    r = d.select(L.lexical_roles(F.col("content")).alias("r"), F.size(L.python_tokens(F.concat(F.lit("s = '''"), F.col("content"), F.lit("'''")))["tokens"]).alias("n")).first()
    assert [s["role"] for s in r["r"]["spans"]] == ["literal", "comment", "identifier"] and r["n"] == 3


def test_role_counts(spark):
    """Counts against the spans that they are of, over documents of one slice and of several; no lambda reads the pieces."""
    from lectern.plans import registry

    some = ['int é5 = 5; // ü\n"a\\"b" x 7é \'c', "", "/* open", "$a _b 1_ 0x1F null 中文 Ⅷ ² 3²", "a 1 b /* c */ 2" * 50]
    d = spark.createDataFrame([(i, some[i % 5]) for i in range(40)] + [(40, None), (41, "ab 1 " * 200000)], "doc_id long, content string").coalesce(1)
    got = {r["doc_id"]: tuple(r)[1:] for r in L.role_counts(d).collect()}
    for r in d.select("doc_id", L.lexical_roles(F.col("content")).alias("r")).collect():
        s, stop = r["r"]["spans"], r["r"]["unterminated"]
        assert got[r["doc_id"]] == (*[sum(x["role"] == k for x in s) for k in ("identifier", "literal", "comment")], sum(x["end"] - x["start"] for x in s), sum(x["byte_end"] for x in s), stop)
    assert len(got) == 42 and got[2] == (0, 0, 0, 0, 0, 0) and got[41][:2] == (200000, 200000)
    assert got[3][0] == 5 and got[0][5] is not None  # $a, _b, the line behind 1, the two letters as one name, a numeral that is a letter
    assert "lambdafunction(isnotnull" not in registry.queries()["lexical_roles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
