"""Rewritten texts against their oracle, on documents of which some are empty or null."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.plans import registry

TEXTS = [(1, "abcd = 255 + 007 // abcdef"), (2, ""), (3, None), (4, " \n"), (5, "x\x00y 12\r\n"), (6, "é"), (7, "")]


@pytest.mark.parametrize("name", ["perturb_hexadecimal", "perturb_short_names", "rewrite_garbled"])
def test_rewritten_without_text(spark, tmp_path, name):
    """A document without a piece has no row, one of white space alone has."""
    at = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("source", F.lit("s")).write.parquet(f"file://{at}")
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{at}/*.parquet'")
    got = sorted((r["doc_id"], r["sha"]) for r in registry.queries()[name](spark, f"file://{tmp_path}").collect())
    assert [k for k, _ in got] == [1, 4, 5, 6]
    assert got == sorted(duck.sql(f"select doc_id, sha from ({registry.oracle_sql()[name]})").fetchall())
