"""The stateful stream of tasks: plans, retirement and restarts; and views that are capped before the shuffle."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from lectern.operators import relations as E
from lectern.operators import statistics as G
from lectern.streaming import incremental as L

SCHEMA = "task_id long, content string, seen timestamp"
DAY = datetime(2024, 1, 1)


def test_tasks_are_computed_reused_and_retired(spark, tmp_path):
    source, sink = f"file://{tmp_path}/in", f"file://{tmp_path}/out"

    def run(rows):
        """A batch, by a query that is started anew and goes on from its checkpoint: the plans that it adds."""
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        before = spark.read.schema("task_id long, sha string, content string, plan string").parquet(sink) if (tmp_path / "out").exists() else None
        n = before.count() if before is not None else 0
        t = L.tracked(spark.readStream.schema(SCHEMA).parquet(source), "7 days", "1 hour")
        t.writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
        got = [tuple(r) for r in spark.read.parquet(sink).collect()]
        old = [] if before is None else [tuple(r) for r in before.collect()] if n == len(got) else seen
        new = list(got)
        for r in old:
            new.remove(r)
        seen[:] = got
        return sorted((r[0], r[3], r[2]) for r in new)

    seen = []
    at = lambda d: DAY + timedelta(days=d)
    assert run([(1, "a", at(0)), (2, "bb", at(0)), (3, "a", at(0))]) == [(1, "computed", "a"), (2, "computed", "bb"), (3, "computed", "a")]
    assert run([(1, "a", at(1)), (2, "cc", at(1)), (4, "d", at(1))]) == [(1, "reused", None), (2, "computed", "cc"), (4, "computed", "d")]
    assert run([(4, None, at(2)), (1, "x", at(2)), (1, "a", at(2.5))]) == [(1, "computed", "a"), (1, "computed", "x"), (4, "retired", None)]
    # a week after task 3 was last seen it goes, and comes back as a new one
    assert run([(1, "a", at(7.5))]) == [(1, "reused", None), (3, "retired", None)]
    assert run([(3, "a", at(7.6))]) == [(3, "computed", "a")]


def test_counts_equal_the_batch_plan(spark, tmp_path):
    rng = np.random.default_rng(1)
    old = [(int(i), f"t{i}", DAY) for i in range(200)]
    new = [(int(i), f"t{i}" if rng.random() < 0.6 else f"new{i}", DAY + timedelta(hours=2)) for i in range(50, 260)]
    for rows in (old, new):
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"file://{tmp_path}/in")
        t = L.tracked(spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in"), "30 days", "1 day")
        t.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    got = {r["plan"]: r["count"] for r in spark.read.parquet(f"file://{tmp_path}/out").groupBy("plan").count().collect()}
    sha = lambda rows: spark.createDataFrame(rows, SCHEMA).select("task_id", L.fingerprint(F.col("content")).alias("sha"))
    plan = {r["plan"]: r["count"] for r in E.reuse_plan(sha(new), sha(old).withColumn("version", F.lit(1)), 1).groupBy("plan").count().collect()}
    assert got == {"computed": 200 + plan["compute"], "reused": plan["exact"]}


def test_views_are_capped_before_the_shuffle(spark):
    rng = np.random.default_rng(2)
    rows = sorted({(int(d), str(k), f"x{i}") for d, k, i in zip(rng.integers(0, 3, 4000), rng.choice(["a", "b", "c"], 4000), rng.integers(0, 500, 4000), strict=True)})
    rows = [(*r, int(w)) for r, w in zip(rows, rng.integers(1, 6, len(rows)), strict=True)]
    df = spark.createDataFrame(rows, "doc_id int, kind string, lexeme string, n int").repartition(4)
    views = {"all": (), "ab": ("a", "b"), "c": ("c",)}
    capped = G.capped_views(df, ["doc_id"], "kind", views, "n", ["kind", "lexeme"], 512)
    want = []
    for d in range(3):
        for v, kinds in views.items():
            own = sorted((r for r in rows if r[0] == d and (not kinds or r[1] in kinds)), key=lambda r: (-r[3], r[1], r[2]))
            want += [(*r, v) for r in own[:512]]
    assert sorted(map(tuple, capped.select("doc_id", "kind", "lexeme", "n", "view").collect())) == sorted(want)
    plan = capped._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan
    assert G.capped_views(df.where("false"), ["doc_id"], "kind", views, "n", ["lexeme"]).count() == 0
