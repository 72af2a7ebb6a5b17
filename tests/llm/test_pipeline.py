"""The pipeline's stages, each on what its predecessor keeps, and as a whole against its own operators' brute force."""

import corpus_pipeline as p
import pytest
from pyspark.sql import functions as F

from .test_corpus_operators import SCHEMA, brute_components, brute_private, sentence


@pytest.fixture(scope="module")
def docs(spark):
    clean = "the of and to in a is that for on it was as with by " * 1
    rows = []
    for i in range(30):
        t = " ".join(w for pair in zip(sentence(i, 120).split(), (clean * 8).split()[:120], strict=True) for w in pair) + "."
        rows.append((i, t, "en", f"s{i % 3}", len(t), "k", "i", "r"))
    rows += [(40, rows[3][1], "en", "s0", 1, "k", "i", "r"), (41, rows[3][1] + " more", "en", "s0", 1, "k", "i", "r"), (42, None, None, None, None, None, None, None), (43, "short", "en", "s1", 5, "k", "i", "r")]
    rows += [(44, rows[5][1] + " mail me@here.org and more text", "en", None, 1, "k", "i", "r"), rows[7], (None, sentence(77, 300), "en", "s1", 1, "k", "i", "r")]
    # near copies without a doc_id, and with one that they share
    mixed = " ".join(w for pair in zip(sentence(90, 120).split(), (clean * 8).split()[:120], strict=True) for w in pair)
    rows += [(i, mixed + x, "en", "s2", 1, "k", "i", "r") for i in (None, 50, 50) for x in (" one.", " two.")]
    return spark.createDataFrame(rows, SCHEMA)


def test_stages(spark, docs, tmp_path):
    d = docs
    for i, (name, stage) in enumerate(p.STAGES):
        before = d
        out = stage(spark, d, "")
        out.write.parquet(f"file://{tmp_path}/{i}")
        d = spark.read.parquet(f"file://{tmp_path}/{i}")
        if i < len(p.STAGES) - 1:
            assert d.columns == docs.columns
        if name == "near_dedup":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            want = {k[0] for k in brute_components(rows, 5) if k[3]}
            assert {r["doc_id"] for r in d.collect()} == want and d.count() == len(want)
        if name == "personal_data":
            assert all(not brute_private(r["text"]) and len(r["text"]) == r["n_chars"] for r in d.collect()) and d.count() == before.count()
    assert d.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and d.count() > 0
    assert d.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_run_on_empty(spark, docs, tmp_path):
    docs.where("false").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert p.run(spark, f"file://{tmp_path}").count() == 0
