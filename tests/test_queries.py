"""Every query of the engine's own operators against its oracle in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from lectern.plans import registry

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = registry.oracle_sql()
QUERIES = registry.queries()


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "~"
    return repr(round(x, 9) + 0.0) if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    mine = sorted(tuple(map(plain, r)) for r in got.collect())
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert mine == theirs


#: What SQL can't express is at least held to its shape and ranges; the operators are tested against numpy beside.
SHAPES = {
    "wide_curve": lambda r: sorted(x["k"] for x in r) == list(range(1, 151)) and {x["n"] for x in r} == {87} and all(x["correlation"] is None or abs(x["correlation"]) <= 1 for x in r),
    "python_lexing": lambda r: len(r) == 34 and all(x["tokens"] == sum(x[k] for k in ("keywords", "names", "numbers", "strings", "operators")) for x in r) and {x["strict"] for x in r} == {True, False},
    "posnett_by_language": lambda r: {x["language"] for x in r} == {"java", "python", "c"} and all(0 <= x["score"] <= 1 and x["vocabulary"] <= x["length"] for x in r),
    "spectral_dispersion": lambda r: len(r) == 10 and all(0 <= x["dispersion"] <= 1 and 1 <= x["effective_rank"] <= 64 for x in r),
    "kmeans_autok": lambda r: len({x["id"] for x in r}) == len(r) == 500 and len({x["cluster"] for x in r}) == r[0]["k"] and r[0]["k"] in (2, 3, 4, 6, 8, 12, 16),
    "leave_one_source_out": lambda r: len(r) == 20 and all(x["spearman"] is None or abs(x["spearman"]) <= 1 for x in r),
    "family_ablation": lambda r: {x["without"] for x in r} == {"none", "length", "indent", "tokens"} and len({x["n"] for x in r}) == 1,
    "feature_count_curve": lambda r: sorted(x["k"] for x in r) == list(range(7)) and all((x["spearman"] is None) == (x["k"] == 0) for x in r),
    "selected_evaluation": lambda r: {x["evaluation"] for x in r} == {"cross_validation", "leave_one_out", "in_sample"} and len({x["n"] for x in r}) == 1,
    "instantiation_comparison": lambda r: sorted(x["instantiation"] for x in r) == [0, 1, 2],
    "bootstrap_interval": lambda r: len(r) == 5 and all(x["valid"] >= 9500 and -1 <= x["low"] < x["high"] <= 1 for x in r),
    "correlation_selection": lambda r: [x["rank"] for x in r] == list(range(1, len(r) + 1)) and r[0]["feature"] == "mean_length",
    "joint_selection": lambda r: [x["rank"] for x in r] == list(range(1, len(r) + 1)) and r[0]["feature"] == "mean_length",
    "stability_ranking": lambda r: sorted(x["rank"] for x in r) == list(range(1, 7)) and all(0 <= x["frequency"] <= 1 and round(x["frequency"] * 200, 6) % 1 == 0 for x in r),
    "candidate_extension": lambda r: sum(x["before"] is not None for x in r) == 3 and sum(x["after"] is not None for x in r) == 3,
    "forward_features": lambda r: 1 <= len(r) <= 6 and all(0.5 <= x["accuracy"] <= 1 for x in r),
    "logistic_model": lambda r: len(r) == 7 and r[-1]["feature"] == "intercept",
    "model_card": lambda r: len(r) == 1 and len(r[0]["coefficients"]) == 6 and r[0]["rows"] == 87,
}


def test_every_query_is_tested():
    assert set(SHAPES) == set(QUERIES) - set(ORACLE)


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_shape(spark, name):
    assert SHAPES[name](QUERIES[name](spark, DATA).collect())


def test_imports_without_the_corpus_operators():
    """The entry points must work when the llm package is not there."""
    import subprocess
    import sys

    code = "import sys; sys.modules['lectern.llm'] = None; import __spark_entry__ as e; assert 'posnett' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    root = __file__.rsplit("/tests/", 1)[0]
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
