"""Incremental feature building: new and changed texts are computed, known ones kept, by content hash."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.functions.scalar import fingerprint
from lectern.operators.relations import reuse_plan

VERSION = 6


def refresh(items: DataFrame, store: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The feature table of items (task_id, content): rows of `store` (task_id, sha, version, features) that still hold,
    those of another task with the same text, and what `build` computes for the rest. Retired tasks drop out."""
    current = items.withColumn("sha", fingerprint(F.col("content")))
    plan = reuse_plan(current.select("task_id", "sha"), store.select("task_id", "sha", "version"), VERSION)
    values = store.where(F.col("version") == VERSION).drop("task_id").dropDuplicates(["sha"])
    known = plan.where("plan <> 'compute'").select("task_id", "sha").join(values, "sha")
    todo = current.join(plan.where("plan = 'compute'").select("task_id"), "task_id").dropDuplicates(["sha"])
    new = build(todo.select("sha", "content")).withColumn("version", F.lit(VERSION))
    fresh = plan.where("plan = 'compute'").select("task_id", "sha").join(new, "sha")
    return known.unionByName(fresh.select(known.columns))


def follow(stream: DataFrame, path: str, build: Callable[[DataFrame], DataFrame], checkpoint: str):
    """A streaming query that keeps the table at `path` up to date with a stream of (task_id, content).

    Each micro-batch leaves out texts that the table has (an anti-join on the hash) and appends the rest, so a batch
    that is run again after a failure adds nothing twice.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("sha", fingerprint(F.col("content"))).dropDuplicates(["sha"])
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            rows = rows.join(spark.read.parquet(path).select("sha"), "sha", "left_anti")
        build(rows.select("sha", "content")).withColumn("version", F.lit(VERSION)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


class _Tasks(StatefulProcessor):
    """What is known of one task: the hash of its text, and until when it stands without being seen again."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "sha string, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        have = self.known.get()
        sha, due = have if have is not None else (None, None)
        old = due
        for r in sorted(rows, key=lambda r: (r["seen"], r["sha"] or "")):
            until = int(r["seen"].timestamp() * 1000) + self.keep_ms
            if r["sha"] is None:
                plan, sha = "retired", None
            else:
                plan, sha = ("reused" if r["sha"] == sha else "computed"), r["sha"]
            due = until if due is None else max(due, until)
            yield Row(task_id=key[0], sha=r["sha"] if r["sha"] is not None else "", content=r["content"] if plan == "computed" else None, plan=plan)
        if old is not None and old != due:
            self.handle.deleteTimer(old)
        if sha is None:
            if old is not None and old == due:
                self.handle.deleteTimer(old)
            self.known.clear()
        else:
            if old != due:
                self.handle.registerTimer(due)
            self.known.update((sha, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        have = self.known.get()
        if have is not None:
            self.known.clear()
            yield Row(task_id=key[0], sha=have[0], content=None, plan="retired")

    def close(self) -> None:
        pass


def tracked(stream: DataFrame, keep: str, late: str) -> DataFrame:
    """What a stream of (task_id, content, seen: timestamp) asks for: (task_id, sha, content, plan) for each row, and one more
    for each task that is retired.

    plan is computed where a task is new or its text has changed (content comes along for those alone), reused where the
    text is the same as before, retired where the content is null or, with an empty row of its own, where a task hasn't
    been seen for `keep` (as "7 days") of event time; rows that are `late`r than that behind the newest are dropped.
    The state holds a hash and a time for each task, in RocksDB, so it may be larger than memory and restarts go on from
    it; rows of a task within a batch count in the order of `seen`. Nothing is compared with a whole table.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ms = int(spark.sql(f"select unix_millis(timestamp'1970-01-01 00:00:00Z' + interval {keep}) as ms").first()["ms"])
    rows = stream.withWatermark("seen", late).select("task_id", F.when(F.col("content").isNotNull(), fingerprint(F.col("content"))).alias("sha"), "content", "seen")
    kind = stream.schema["task_id"].dataType.simpleString()
    return rows.groupBy("task_id").transformWithState(_Tasks(ms), f"task_id {kind}, sha string, content string, plan string", "Append", "EventTime")
