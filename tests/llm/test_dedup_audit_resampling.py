"""Exact groups, the filter audit and importance resampling against brute force, and on the cases their docstrings define."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import exact_dedup, filter_audit, resampling
from lectern.llm.queries import ORACLE, QUERIES

from .test_corpus_operators import SCHEMA, docs, given, sentence, words  # noqa: F401

LOW = -(2**63)
ident = lambda i: LOW if i is None else i


# ---- exact groups


def test_filters_hold_what_went_in():
    rng = np.random.default_rng(1)
    for bits, size in ((64, 5000), (40, 1), (12, 4000), (5, 20), (1, 2)):
        p = np.unique(rng.integers(0, 2**bits, size, dtype=np.uint64, endpoint=False) if bits < 64 else rng.integers(0, 2**64, size, dtype=np.uint64))
        c = rng.integers(1, 4, len(p)) ** 9
        back = exact_dedup.decode(exact_dedup.encode(p, c, bits), bits)
        assert (back[0] == p).all() and (back[1] == c).all()


def test_merge_adds_counts():
    rng = np.random.default_rng(2)
    parts = [np.unique(rng.integers(0, 300, 200, dtype=np.uint64), return_counts=True) for _ in range(5)]
    p, c = exact_dedup.merge(*zip(*parts, strict=True))
    want = Counter()
    for a, b in parts:
        want.update(dict(zip(a.tolist(), b.tolist(), strict=True)))
    assert dict(zip(p.tolist(), c.tolist(), strict=True)) == want and (p[1:] > p[:-1]).all()
    assert len(exact_dedup.merge([], [])[0]) == 0


def brute_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(ident(i))
    out = Counter()
    for t, ids in groups.items():
        back = lambda i: None if i == LOW else i
        top = max(ids)
        for n, i in enumerate(sorted(ids, reverse=True)):
            out[back(i), back(min(ids)), back(top), len(ids), n == 0, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_groups(docs, given, bits):  # noqa: F811
    """With 3 bits nearly every fingerprint has unlike texts."""
    assert Counter(map(tuple, exact_dedup.exact_groups(docs, bits=bits).collect())) == brute_groups(given)


@pytest.mark.parametrize("hot", [1, 2048])
def test_exact_groups_hot_or_not(spark, monkeypatch, hot):
    """A third of all rows are one text; with HOT = 1 no fingerprint is hot, so all go the way of the others."""
    monkeypatch.setattr(exact_dedup, "HOT", hot)
    rows = [(i, "same" if i % 3 == 0 else f"own {i // 2}") for i in range(3000)] + [(None, "same"), (None, None), (5, "")]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert Counter(map(tuple, got)) == brute_groups(rows)


def test_exact_groups_carries_and_takes_any_columns(docs):  # noqa: F811
    got = exact_dedup.exact_groups(docs, carry=("lang",))  # docs has columns named kept, _id and row
    assert got.columns == ["doc_id", "lang", "first_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert exact_dedup.exact_groups(docs.where("false")).count() == 0


# ---- filter audit


def test_intervals_cover_every_order_once():
    orders = list(permutations(range(5)))
    spans = filter_audit.removal_intervals(5)
    for r, p in enumerate(orders):
        assert filter_audit.lehmer_rank(p, 5) == r
    for mask in range(1, 32):
        step_of = np.zeros(120, int)
        for m, step, a, b in spans:
            if m == mask:
                assert not step_of[a:b].any()
                step_of[a:b] = step
        assert step_of.tolist() == [next(s + 1 for s, x in enumerate(p) if mask >> x & 1) for p in orders]


def brute_mask(text):
    t, out = text or "", 0
    w = words(t)
    out |= len(w) < 50
    out |= (100 * len(set(w)) < 65 * len(w)) << 1
    out |= (100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t)) << 2
    return out | any(c in "#$%&*|" for c in t) << 3


def brute_audit(rows, labels):
    """rows: (doc_id, text, source); labels: doc_id -> (quality = 1, toxic = 1)."""
    first = {}
    for i, t, _ in rows:
        first[t or ""] = min(first.get(t or "", ident(i)), ident(i))
    marks = [(s or "", brute_mask(t) | (ident(i) > first[t or ""]) << 4, labels.get(i, (0, 0))) for i, t, s in rows]
    out = {}
    for part in {m[0] for m in marks}:
        own, total = [m[1:] for m in marks if m[0] == part], Counter()
        for p in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(p, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [m for m in left if m[0] & bit]
                left = [m for m in left if not m[0] & bit]
                total[letter] += len(gone)
                out[part, "".join(p), step] = [len(left), len(gone), sum(m[0] & bit > 0 for m in own) - len(gone), sum(m[0] == bit for m in own), sum(m[1][0] for m in gone), sum(m[1][1] for m in gone)]
        for (x, p, step), v in out.items():
            if x == part:
                v.append(total[p[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def test_filter_audit(spark, docs):  # noqa: F811
    extra = [(100 + i, t, None, s, 0, None, None, None) for i, (t, s) in enumerate([
        ("word " * 60, "s1"), ("A" * 49 + " b", ""), (sentence(50, 60) + " #", None), (sentence(51, 70), "s2"), (sentence(51, 70), "s9"), ("Aa " * 3 + sentence(52, 55), "s9"),
    ])]
    all_docs = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, None, 1), (8, 0, 1), (8, 1, None), (100, 1, 1), (104, 1, 0), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    told = {1: (1, 0), 2: (1, 1), 3: (0, 1), 8: (1, 1), 100: (1, 1), 104: (1, 0)}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in all_docs.collect()]
    got = [tuple(r) for r in filter_audit.filter_interactions(all_docs, labels).collect()]
    assert len(got) == len(set(got)) == 600 * len({s or "" for _, _, s in rows})
    assert set(got) == brute_audit(rows, told)


def test_filter_audit_of_nothing(docs):  # noqa: F811
    labels = docs.selectExpr("doc_id", "1 as quality", "0 as toxic").where("false")
    assert filter_audit.filter_interactions(docs.where("false"), labels).count() == 0


def test_audit_of_three_filters(spark):
    marks = spark.createDataFrame([("p", 3, 1, 0), ("p", 0, 0, 0), (None, None, None, None), ("p", 4, 0, 1)], "part string, mask int, good int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): r for r in filter_audit.audit(marks, "xyz").collect()}
    assert len(got) == 2 * 6 * 3
    r = got["p", "yxz", 2]
    assert (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) == (2, 0, 1, 0, 0, 0, 3)
    assert got["", "xyz", 3]["kept"] == 1 and got["p", "zxy", 1]["toxic_lost"] == 1


# ---- resampling


def brute_features(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def test_features_are_crc32_of_words_and_pairs():
    texts = ["", "a", "The  the,THE 42", "é—naïve x" + "ö" * 400 + " " + "q" * 90 + "\x00\x7f~tail", "中文 😀 z" * 5]
    data = [t.encode() for t in texts]
    b, off = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    bucket, doc, n = resampling.features(b, off, 10_000)
    for i, t in enumerate(texts):
        assert n[i] == brute_features(t)[0]
        assert sorted(bucket[doc == i].tolist()) == sorted(zlib.crc32(f.encode()) % 10_000 for f in brute_features(t)[1])


def brute_resample(rows, target, percent, m, seed, least):
    found = [(i, *brute_features(t)) for i, t in rows]
    bucket = lambda f: zlib.crc32(f.encode()) % m
    s = Counter(bucket(f) for _, _, fs in found for f in fs)
    t = Counter(bucket(f) for x in target for f in brute_features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + m) / ((s[b] + 1) * (t_all + m)))) for b in range(m)]
    out = []
    for i, n, fs in found:
        w = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    order = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], ident(r[0])))
    for k, r in enumerate(order[: percent * len(order) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize(("percent", "m"), [(25, 10_000), (100, 7), (0, 50), (60, 1)])
def test_resample(spark, docs, given, percent, m):  # noqa: F811
    target = [sentence(1, 90), None, "", "Zebra zebra"]
    got = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, buckets=m, carry=("lang",))
    assert got.columns == ["doc_id", "lang", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.drop("lang").collect())) == brute_resample(given, target, percent, m, 7, 20)


def test_resample_many_and_again(spark):
    rows = [(i, sentence(i % 700, 15 + i % 13)) for i in range(2100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([(sentence(3, 200),)], "text string")
    want = brute_resample(rows, [sentence(3, 200)], 25, 10_000, 7, 20)
    for d in (frame, frame.repartition(9)):
        assert Counter(map(tuple, resampling.resample(d, target).collect())) == want


def test_resample_of_nothing(spark, docs):  # noqa: F811
    nothing = docs.where("false")
    assert resampling.resample(nothing, nothing).count() == 0
    got = resampling.resample(docs, nothing)
    assert got.count() == docs.count() and got.where("rank is not null").count() > 0


@pytest.mark.parametrize("k", [1, 2, 137, 299, 300])
def test_kth_key(spark, k):
    keys = sorted((int(d), int(i), n) for n, (d, i) in enumerate(np.random.default_rng(5).integers(-4, 4, (300, 2))))
    rows = spark.createDataFrame(keys, "_down long, _id long, _at long")
    assert tuple(resampling.kth_key(rows, k)) == keys[k - 1]


# ---- on the tables


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_exact_dedup"])
def test_matches_oracle(spark, data, name):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"create view {t} as select * from '{os.path.join(data, t)}.parquet'")
    got, want = QUERIES[name](spark, data), c.sql(ORACLE[name])
    at = [want.columns.index(x) for x in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_resampling_on_the_tables(spark, data):
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{data}/{t}.parquet").select(*c).collect()]
    want = brute_resample(read("documents", "doc_id", "text"), [t for (t,) in read("benchmark", "text")], 25, 10_000, 7, 20)
    assert Counter(map(tuple, QUERIES["op13_importance_resampling"](spark, data).collect())) == want


def test_a_group_with_a_third_of_all_rows_is_combined_before_the_shuffle(spark):
    """Each task's filters hold a fingerprint once, however many of its rows have it."""
    rows = spark.range(0, 30_000, numPartitions=6).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") * 1000).cast("long").alias("_fp"))
    got = exact_dedup.repeated_prints(rows, 30_000).collect()
    assert [tuple(r) for r in got] == [(7, 10_000)]
