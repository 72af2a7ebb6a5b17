"""Rated corpora through the data source, models as stages, and perturbations by hand."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import fitted, perturb
from lectern.operators import models as J
from lectern.sources import rated

from .test_summaries import table  # noqa: F401


@pytest.fixture(scope="module")
def read(spark):
    rated.register(spark)
    return lambda path, **options: spark.read.format("rated").options(**options).load(str(path))


def rows(df):
    return sorted(((r["task_id"], r["content"], r["readability_score"]) for r in df.collect()), key=str)


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8", newline="")


def test_json_lines(read, tmp_path):
    put(tmp_path / "a.jsonl", '{"name": "x", "code_snippet": "é\\n", "score": 0.25}\n\n{"dataset": "d", "source_id": 1, "generator_model": "m", "code": "y", "readability": "High"}\n')
    put(tmp_path / "b.jsonl", '{"item_id": "z", "code": null}\n')
    put(tmp_path / "_SUCCESS", "")
    df = read(tmp_path, layout="json_lines", dataset="d")
    assert rows(df) == [("d__1__m", "y", 1.0), ("x", "é\n", 0.25), ("z", None, None)]
    assert df.rdd.getNumPartitions() == 2 and df.first()["dataset"] == "d"
    assert df.select("task_id").where("readability_score > 0.5").count() == 1
    put(tmp_path / "b.jsonl", '{"item_id": "z"}\n{broken\n')
    with pytest.raises(Exception, match="line 2"):
        read(tmp_path, layout="json_lines").collect()


def test_json_array(read, tmp_path):
    put(tmp_path / "a.json", json.dumps([{"task_id": "t", "code": 'a\\nb \\"q\\"', "readability_score": 3}]))
    assert rows(read(tmp_path / "a.json", layout="json_array")) == [("t", 'a\nb "q"', 3.0)]


@pytest.fixture
def matrix(tmp_path):
    put(tmp_path / "votes.csv", "r1,A,1,5\nr2,B,,3\nr3,A,2,4\n")
    for k in (1, 2):
        put(tmp_path / f"snippets/{k}.txt", f"text {k}\r\n")
    return tmp_path


def test_vote_matrix(read, matrix):
    options = dict(layout="vote_matrix", votes="votes.csv", items="2", suffix=".txt")
    df = read(matrix, **options)
    assert rows(df) == [("1", "text 1\r\n", 1.5), ("2", "text 2\r\n", 4.0)]
    assert {r["task_id"]: r["metadata"] for r in df.collect()}["1"] == {"rating_count": "2", "rating_min": "1.0", "rating_max": "2.0", "group:A": "2", "group:B": "1"}
    put(matrix / "votes.csv", "r1,A,1,5\nr2,B,3\n")
    with pytest.raises(Exception, match="row 2 of the votes has 3 columns, not 4"):
        read(matrix, **options).collect()
    put(matrix / "votes.csv", "r1,A,1,\n")
    with pytest.raises(Exception, match="item 2 has no votes"):
        read(matrix, **options).collect()


def test_header_votes(read, matrix):
    put(matrix / "scores.csv", "rater,Snippet2, Snippet1\nr1,5,1\nr2,4\n")
    options = dict(layout="header_votes", votes="scores.csv", suffix=".txt")
    assert rows(read(matrix, **options)) == [("1", "text 1\r\n", 1.0), ("2", "text 2\r\n", 4.5)]
    put(matrix / "scores.csv", "rater,Snippet1,Note\nr1,5,1\n")
    with pytest.raises(Exception, match="no score column: 'Note'"):
        read(matrix, **options).collect()


def test_language_votes(read, tmp_path):
    put(tmp_path / "scores/python.csv", "r1,1,,3\nr2,2\n")
    for k in (10, 2, 33):
        put(tmp_path / f"snippets/python/{k}.txt", f"text {k}")
    df = read(tmp_path, layout="language_votes", votes="scores/python.csv", language="python", suffix=".txt")
    assert rows(df) == [("python/10", "text 10", None), ("python/2", "text 2", 1.5), ("python/33", "text 33", 3.0)]
    assert df.first()["metadata"]["language"] == "python"


def test_arff(read, tmp_path):
    put(tmp_path / "a.arff", "% note\n@relation r\n@attribute 'len' numeric\n@attribute class {a,b}\n@data\n1.5,a\n2, b\n")
    assert sorted(r["metadata"]["class"] + r["metadata"]["len"] for r in read(tmp_path / "a.arff", layout="arff").collect()) == ["a1.5", "b2"]
    put(tmp_path / "a.arff", "@attribute x numeric\n@data\n1,2\n")
    with pytest.raises(Exception, match="2 values for 1 attributes"):
        read(tmp_path / "a.arff", layout="arff").collect()


def test_unknown_layout_and_empty_folder(read, tmp_path):
    with pytest.raises(Exception, match="layout must be one of"):
        read(tmp_path, layout="xml").collect()
    assert read(tmp_path, layout="json_lines").count() == 0


# ---- stages


def test_stage_gives_the_same_predictions_as_one_pass(table, tmp_path):  # noqa: F811
    df, _ = table
    stage = fitted.Ridge(features=list("abcde"), target="y", weight="w", alpha=3.0)
    stage.save(str(tmp_path / "stage"))
    stage = fitted.Ridge.load(str(tmp_path / "stage"))
    got = {r["id"]: r["prediction"] for r in fitted.cross_fitted(stage, df, "fold").collect()}
    want = {r["id"]: r["prediction"] for r in J.out_of_fold(df, list("abcde"), "y", F.col("w"), "fold", alpha=3.0).collect()}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def test_model_in_a_pipeline_survives_a_round_trip(table, tmp_path):  # noqa: F811
    from pyspark.ml import Pipeline, PipelineModel

    df, _ = table
    model = Pipeline(stages=[fitted.Ridge(features=["a", "b"], target="y")]).fit(df)
    model.save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    one, two = ({r["id"]: r["prediction"] for r in m.transform(df).collect()} for m in (model, again))
    assert one == two and len(one) == df.count() and all(0 <= x <= 1 for x in one.values())
    assert again.stages[0].getOrDefault("coefficients") == model.stages[0].getOrDefault("coefficients")
    assert again.transform(df.where("false")).count() == 0


# ---- layout


def test_compact_layout_keeps_two_breaks(spark):
    texts = ["a", "a\nb", "a\nb\nc", "a\nb\nc\nd", "\na\nb\nc\n", "\n".join(map(str, range(40))), 'a\n"x\ny"\nb /* n\nm */\nc // e\nd\nf', "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, content string")
    got = {r["doc_id"]: r["c"] for r in d.select("doc_id", perturb.compact_layout(F.col("content"), F.col("doc_id").cast("string")).alias("c")).collect()}
    assert [got[i] for i in range(3)] == texts[:3] and got[7] == "" and got[8] is None
    assert got[3].count("\n") == 2 and got[4].startswith("\na") and got[4].endswith("c\n") and got[4].count("\n") == 4
    assert got[5].count("\n") == 39 - 15 and got[5].replace("\n", " ") == texts[5].replace("\n", " ")
    assert "/* n\nm */" in got[6] and '"x' in got[6] and "// e\n" in got[6]


def test_misleading_names_are_unique(spark):
    d = spark.createDataFrame([(1, "counter = count + county; // counts"), (2, "count county")], "doc_id int, content string")
    r = perturb.renamed_misleading(d, ["abc", "sixsix", "sevenss"]).collect()
    assert sorted(x["misleading"] for x in r if x["doc_id"] == 1) == ["sevenss", "sixsix", "sixsix_2", "sixsix_3"]
    assert len({(x["doc_id"], x["misleading"]) for x in r}) == len(r) == 6


def test_lines_in_ranges(tmp_path, monkeypatch):
    """Every line is in one range, wherever the ranges and chunks end; no more than a chunk and a line is held."""
    import gzip
    import json

    from lectern.sources import rated

    texts = ["é" * k for k in range(40)] + ["x\\n" * 300, ""]
    body = "\n".join(json.dumps({"name": f"n{i}", "score": i, "code": t}, ensure_ascii=False) for i, t in enumerate(texts))
    for end in ("", "\n", "\n\n"):
        (tmp_path / "a.json").write_text(body + end, encoding="utf-8")
        for size, chunk in ((7, 3), (64, 50), (64, 1000), (1 << 20, 5)):
            monkeypatch.setattr(rated, "RANGE", size)
            monkeypatch.setattr(rated, "CHUNK", chunk)
            own = rated.JsonLines(str(tmp_path / "a.json"), {})
            pieces = own.pieces()
            assert len(pieces) == max(1, -(-len((body + end).encode()) // size))
            assert [(r[0], r[1]) for p in pieces for r in own.rows(p)] == [(f"n{i}", t) for i, t in enumerate(texts)]
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(body.encode()))
    own = rated.JsonLines(str(tmp_path / "b.json.gz"), {})
    assert len(own.pieces()) == 1 and len(list(own.rows(own.pieces()[0]))) == len(texts)
    (tmp_path / "a.json").write_text(body + "\n{broken", encoding="utf-8")
    own = rated.JsonLines(str(tmp_path / "a.json"), {})
    with pytest.raises(ValueError, match=f"line {len(texts) + 1}:"):
        [r for p in own.pieces() for r in own.rows(p)]
