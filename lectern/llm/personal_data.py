"""Personal data: base patterns, and further spans from weak labellers weighed by expectation-maximisation.

Only DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns and their order. Loops are possessive, which matches the same strings (nothing follows
# that could want a character back) and doesn't recurse on long runs. A run of characters that could begin a match does so
# at its first character or where the last match has ended, or nowhere: the look-behinds spare reading it from each of them.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Further spans: runs of at least 16 key characters, with a letter and a digit among them, that are judged secrets.
SECRET = "secret"
CANDIDATE = r"[A-Za-z0-9_+/=-]{16,}"
#: Characters before a candidate that labellers look at.
CONTEXT = 40
#: Names of fields that hold credentials.
GAZETTEER = ("token", "secret", "password", "passwd", "apikey", "api_key", "api-key", "access_key", "private_key", "client_secret", "auth", "bearer", "session", "credential")

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_SPANS = "array<struct<start: int, end: int, value: string>>"


def _running(numbers: Column, join=lambda x, y: x + y) -> Column:
    """Running sums (or another associative join) of an array: each round joins what stands twice as far apart, so n
    numbers take log n rounds of one pass and nothing is copied number by number."""
    round_ = lambda a, d: F.when(F.size(a) > d, F.transform(a, lambda x, i: F.when(i >= d, join(x, F.get(a, i - d))).otherwise(x))).otherwise(a)
    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(30)]), numbers, round_)


def _once(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places: the gaps between them and their own lengths, added up."""

    def placed(s: Column) -> Column:
        found, gaps = s["found"], F.transform(s["gaps"], lambda g: F.length(g))
        ends = _running(F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: g + F.length(m)))
        return F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))

    return _once(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")), placed)


#: Characters of the parts that a text is cut into where many places of it are read.
_PART = 1024


def _parts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PART}}}"), F.lit(0))


def _between(parts: Column, start: Column, length: Column) -> Column:
    """A substring (start from 0) by way of the parts that hold it, so that far places cost no more than near ones."""
    first = F.floor(start / _PART).cast("int")
    many = F.floor((start % _PART + length + _PART - 1) / _PART).cast("int")
    return F.when(length > 0, F.substring(F.array_join(F.slice(parts, first + 1, F.greatest(many, F.lit(1))), ""), start % _PART + 1, length)).otherwise("")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def step(a: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def base_spans(text: Column, kind: str) -> Column:
    """The base spans of a kind in a text that is not null, in order; a cheap test spares most texts the patterns."""
    none = F.array().cast(_SPANS)
    if kind == "email":
        return F.when(F.contains(text, F.lit("@")), _matches(text, EMAIL)).otherwise(none)
    if kind == "ip":
        good = lambda x: x["value"].rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
        return F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(_matches(text, IP), good)).otherwise(none)
    if kind == "card":
        bare = lambda x: F.regexp_replace(x["value"], "[^0-9]", "")
        good = lambda x: F.when(F.length(bare(x)).between(13, 19), _luhn(bare(x))).otherwise(False)
        return F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), F.filter(_matches(text, CARD), good)).otherwise(none)
    good = lambda x: F.length(F.regexp_replace(x["value"], "[^0-9]", "")).between(9, 15)
    return F.when(text.rlike(r"\+[0-9]"), F.filter(_matches(text, PHONE), good)).otherwise(none)


def _labels(value: Column, before: Column) -> dict[str, Column]:
    """The votes on a candidate: a regular form, a name from the gazetteer, and two signs of its context."""
    low = F.lower(before)
    names = "|".join(GAZETTEER)
    return {
        "regular": value.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[A-Z0-9]{20,})$"),
        "mixed": F.length(F.regexp_replace(F.regexp_replace(value, "[0-9]+", "1"), "[^1]+", "a")) >= 6,
        "named": low.rlike(f"(?:{names})[^a-z]*$"),
        "assigned": before.rlike(r"[=:]\s*[\"']?$"),
        "quoted": before.rlike("[\"']$"),
    }


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 100) -> dict[tuple[int, ...], float]:
    """The posterior of each vote pattern by expectation-maximisation: every labeller has a rate of right votes for
    either class, and the classes a prior; they start from the majority."""
    if not counts:
        return {}
    m = len(next(iter(counts)))
    post = {v: (sum(v) + 0.5) / (m + 1) for v in counts}
    for _ in range(rounds):
        n1 = sum(c * post[v] for v, c in counts.items())
        n0 = sum(counts.values()) - n1
        hit1 = [(sum(c * post[v] for v, c in counts.items() if v[j]) + 1) / (n1 + 2) for j in range(m)]
        hit0 = [(sum(c * (1 - post[v]) for v, c in counts.items() if v[j]) + 1) / (n0 + 2) for j in range(m)]
        prior = (n1 + 1) / (n1 + n0 + 2)
        new = {}
        for v in counts:
            a, b = math.log(prior), math.log(1 - prior)
            for j, x in enumerate(v):
                a += math.log(hit1[j] if x else 1 - hit1[j])
                b += math.log(hit0[j] if x else 1 - hit0[j])
            new[v] = 1 / (1 + math.exp(min(700.0, b - a)))
        done = max(abs(new[v] - post[v]) for v in counts) < 1e-9
        post = new
        if done:
            break
    return post


#: Bounds between which a span's length, its share of digits and of unlike characters are told apart.
LENGTHS, DIGITS, UNLIKE = (20, 28, 36, 48, 80), (10, 25, 40, 60), (25, 40, 55, 70)


def _shape(value: Column, before: Column) -> dict[str, Column]:
    """A span's own features, each a small number: length, share of digits, share of unlike characters (its variety),
    kinds of letters, signs, and the character before it."""
    length = F.length(value)
    share = lambda n, bounds: sum((F.when(100 * n >= b * length, 1).otherwise(0) for b in bounds), F.lit(0))
    upper, lower = value.rlike("[A-Z]"), value.rlike("[a-z]")
    last = F.right(before, F.lit(1))
    return {
        "length": sum((F.when(length >= b, 1).otherwise(0) for b in LENGTHS), F.lit(0)),
        "digits": share(F.length(F.regexp_replace(value, "[^0-9]+", "")), DIGITS),
        "unlike": share(F.size(F.array_distinct(F.split(value, ""))), UNLIKE),
        "letters": F.when(upper & lower, 2).when(upper, 1).otherwise(0),
        "signs": F.when(value.rlike("[/+]"), 2).when(value.rlike("[_=-]"), 1).otherwise(0),
        "ahead": F.when(last.isin('"', "'"), 2).when(last.isin("=", ":"), 1).otherwise(0),
    }


_SHAPE = {"length": len(LENGTHS) + 1, "digits": len(DIGITS) + 1, "unlike": len(UNLIKE) + 1, "letters": 3, "signs": 3, "ahead": 3}


@dataclass(frozen=True)
class Classifier:
    """Weights of the values of each feature, and the intercept."""

    weights: dict[str, list[float]]
    intercept: float


def fit(counts: dict[tuple[tuple[int, ...], tuple[int, ...]], int], rounds: int = 400, rate: float = 2.0, decay: float = 1e-3) -> Classifier:
    """The span classifier from counts of (votes, shape): expectation-maximisation estimates the labellers' reliabilities
    and with them each vote pattern's posterior, and a logistic regression of the posteriors on the spans' shapes, which
    the labellers don't vote by, is trained on those."""
    names, width = list(_SHAPE), sum(_SHAPE.values())
    begins = [sum(list(_SHAPE.values())[:k]) for k in range(len(names))]
    by_votes: dict[tuple[int, ...], int] = {}
    for (v, _), c in counts.items():
        by_votes[v] = by_votes.get(v, 0) + c
    post, total = reliabilities(by_votes), sum(counts.values()) + width / 2
    data = [([b + x for b, x in zip(begins, shape, strict=True)], post[v], c / total) for (v, shape), c in sorted(counts.items())]
    data += [([i], 0.0, 0.5 / total) for i in range(width)]
    w, last = [0.0] * width, 0.0
    for _ in range(rounds):
        g, g_last = [decay * x for x in w], 0.0
        for at, target, share in data:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, last + sum(w[i] for i in at)))))
            e = (p - target) * share
            g_last += e
            for i in at:
                g[i] += e
        w, last = [x - rate * y for x, y in zip(w, g)], last - rate * g_last
    return Classifier({k: w[b : b + _SHAPE[k]] for k, b in zip(names, begins, strict=True)}, last)


def _candidates(text: Column) -> Column:
    """Candidate spans with the characters before them as `before`."""
    good = lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]")
    found = F.when(text.rlike("[0-9]"), F.filter(_matches(text, CANDIDATE), good)).otherwise(F.array().cast(_SPANS))

    def placed(found: Column, parts: Column) -> Column:
        before = lambda x: _between(parts, F.greatest(F.lit(0), x["start"] - CONTEXT), F.least(F.lit(CONTEXT), x["start"]))
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), before(x).alias("before")))

    # the lambda binds the spans and the parts, which are worked out once a text
    both = F.transform(F.array(F.struct(found.alias("f"), F.when(F.size(found) > 0, _parts(text)).alias("p"))), lambda s: placed(s["f"], s["p"]))
    return F.get(both, F.lit(0))


def train(docs: DataFrame) -> Classifier:
    """The span classifier from the candidates of all docs: only a count for each pattern of votes and shape (2**5 times
    the shapes' 4 050, at most) reaches the driver."""
    found = docs.where(F.col("text").rlike("[0-9]")).select("text").select(F.explode(_candidates(F.col("text"))).alias("x"))
    votes, shape = _labels(F.col("x.value"), F.col("x.before")), _shape(F.col("x.value"), F.col("x.before"))
    columns = [c.cast("int").alias(f"{kind}_{k}") for kind, own in (("v", votes), ("s", shape)) for k, c in own.items()]
    rows = found.groupBy(*columns).count().collect()
    return fit({(tuple(r[f"v_{k}"] for k in votes), tuple(r[f"s_{k}"] for k in shape)): r["count"] for r in rows})


def find(docs: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """Every column of docs in a struct `row`, with `spans`: array of (kind, start, end), by kind (base kinds first, as
    in KINDS, then secrets) and start; code points from 0, end exclusive.

    Base spans are the leftmost non-overlapping matches that pass their tests. Secrets are the candidates that the
    classifier gives at least 0.5 and that no base span touches. Null texts have no spans; columns of docs may have any
    names; no rows give no rows. Every row is worked on where it is read, in time linear in its text (times the logarithm
    of its matches), runs of one kind of character included.
    """
    classifier = classifier or train(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.struct("*").alias("row"), text.alias("text"))
    named = lambda c, kind: F.transform(c, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    d = d.withColumn("base", F.concat(*[named(base_spans(F.col("text"), k), k) for k in KINDS]))

    def touched(x: Column, s: Column) -> Column:
        """Whether a base span overlaps x: of those that start before its end (found by halving), any reaches past its start."""
        half = lambda a, _: _once(F.floor((a["lo"] + a["hi"]) / 2).cast("int"), lambda m: F.when(F.get(s["starts"], m) < x["end"], F.struct((m + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), m.alias("hi"))))
        step = lambda a, i: F.when(a["lo"] < a["hi"], half(a, i)).otherwise(a)
        none, all_ = F.lit(0).alias("lo"), F.size(s["starts"]).alias("hi")
        before = F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(F.size(s["starts"]) + 1.0)).cast("int") + 1), F.struct(none, all_), step)["lo"]
        return F.coalesce(F.when(F.size(s["starts"]) > 0, F.get(s["reach"], before - 1) > x["start"]), F.lit(False))

    order = F.array_sort(F.transform("base", lambda y: F.struct(y["start"].alias("start"), y["end"].alias("end"))))
    reach = lambda o: _running(F.transform(o, lambda y: y["end"]), lambda a, b: F.greatest(a, b))
    sorted_ = _once(order, lambda o: F.struct(F.transform(o, lambda y: y["start"]).alias("starts"), reach(o).alias("reach")))

    def secret(x: Column, s: Column) -> Column:
        score = F.lit(classifier.intercept)
        for k, value in _shape(x["value"], x["before"]).items():
            score = score + F.get(F.array(*map(F.lit, classifier.weights[k])), value)
        return (score >= 0) & ~touched(x, s)

    both = F.struct(_candidates(F.col("text")).alias("found"), sorted_.alias("base"))
    chosen = _once(both, lambda s: F.filter(s["found"], lambda x: secret(x, s["base"])))
    more = named(chosen, SECRET)
    return d.select("row", F.concat("base", more).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping ones, as <KIND> of its first; a null text stays null."""
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    reach = lambda o: _running(F.transform(o, lambda x: x["end"]), lambda x, y: F.greatest(x, y))

    def cut(s: Column) -> Column:
        """Before each span that begins a run: what lies between it and the run before."""
        at = lambda i: F.when(i > 0, F.get(s["reach"], i - 1)).otherwise(0)
        piece = lambda x, i: F.when(x["start"] >= at(i), F.concat(_between(s["parts"], at(i), x["start"] - at(i)), F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise("")
        last = F.get(s["reach"], F.size(s["order"]) - 1)
        return F.concat(F.array_join(F.transform(s["order"], piece), ""), _between(s["parts"], last, F.length(text) - last))

    # each lambda binds what the next one reads more than once
    done = _once(order, lambda o: _once(F.struct(o.alias("order"), reach(o).alias("reach"), _parts(text).alias("parts")), cut))
    return F.when(F.size(spans) > 0, done).otherwise(text)
