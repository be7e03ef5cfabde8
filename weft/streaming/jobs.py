"""Incremental stores as Structured Streaming jobs (T1 to T3), run over what is there and then ended."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import report


def first_seen(checks: DataFrame, key: str, time: str = "ts", delay: str = "7 days") -> DataFrame:
    """Keys, each once within the delay; a key's state goes when the watermark has passed it."""
    return checks.withWatermark(time, delay).dropDuplicatesWithinWatermark([key]).select(key)


class _Streak(StatefulProcessor):
    """Keeps a user's last valid check and the failures behind it, since later batches may hold earlier checks.

    Below the watermark nothing is awaited: any valid check that still comes is
    behind the failures there and ends them all, so they are kept as a number.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts long, event_id long")
        self.old = handle.getValueState("old", "failures long")
        self.failures = handle.getListState("failures", "ts long, event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = last = tuple(self.last.get()) if self.last.exists() else None
        old = self.old.get()[0] if self.old.exists() else 0
        recent = list(map(tuple, self.failures.get())) if self.failures.exists() else []
        for got in rows:  # a part of the user's rows at a time
            places = list(zip(got["ts"].tolist(), got["event_id"].tolist()))
            valid = got["valid"].tolist()
            last = max([*([last] if last else []), *(p for p, v in zip(places, valid) if v)], default=None)
            recent += [p for p, v in zip(places, valid) if not v]
        if last != before:
            self.last.update(last)
            recent, old = [p for p in recent if p > last], 0
        elif last:
            recent = [p for p in recent if p > last]
        awaited = timerValues.getCurrentWatermarkInMs() * 1000 if self.bounded else None
        if awaited is not None and awaited > 0:
            old += sum(ts < awaited for ts, _ in recent)
            recent = [p for p in recent if p[0] >= awaited]
        self.old.update((old,))
        self.failures.put(recent) if recent else self.failures.clear()
        yield pd.DataFrame({"user_id": [key[0]], "failures": [old + len(recent)]})

    bounded = False


class _BoundedStreak(_Streak):
    bounded = True


def streaks(checks: DataFrame, delay: str | None = None) -> DataFrame:
    """The failures since each user's last valid check (user_id, ts, event_id, valid), as they change.

    Checks may come in any order, and each failure of a streak is remembered;
    with a delay, checks later than that are dropped, and a user's state is
    bounded by the failures within it.
    """
    timed = checks.withColumn("at", F.col("ts").cast("timestamp"))
    placed = (timed.withWatermark("at", delay) if delay else timed).withColumn("ts", F.unix_micros("at"))
    processor = _BoundedStreak() if delay else _Streak()
    return placed.groupBy("user_id").transformWithStateInPandas(processor, outputStructType="user_id long, failures long", outputMode="Update", timeMode="EventTime" if delay else "None")


def running_statistics(checks: DataFrame, distinct: str | None = None) -> DataFrame:
    """Number, errors and times by kind; with a column named, a sketch of its distinct values, which G4 merges and reads."""
    sketch = [F.hll_sketch_agg(distinct, report.SKETCH_BITS).alias("keys")] if distinct else []
    return checks.groupBy("event_type").agg(
        F.count("*").alias("number"), F.sum((F.col("event_type") == "error").cast("long")).alias("errors"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *sketch)


def run_once(stream: DataFrame, mode: str, checkpoint: str, keys: list[str] | None = None) -> DataFrame:
    """All that the stream has now, as a table in the checkpoint folder; of updates the last of each key."""
    path = f"{checkpoint.rstrip('/')}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/batch={number}-{mode}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{path}/rows")
    if mode == "complete":
        return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch", "left_semi").drop("batch")
    if keys:
        rest = [c for c in rows.columns if c not in keys and c != "batch"]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")
    return rows.drop("batch")
