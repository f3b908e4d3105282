"""Stateful streams (STR01-03, STR05-07, WIN10): the same results as in batch, with bounded state.

Each function takes a streaming DataFrame; ``run`` drives one to the end of what is there and returns what it
wrote, which serves tests and backfills.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import Workspace


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream; its time has no zone and is taken as UTC, since a watermark needs a timestamp."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process everything there is; a complete result replaces what an earlier batch wrote."""
    work = Workspace(stream.sparkSession, "stream")
    out = f"{work.path}/out"

    def write(batch: DataFrame, number: int) -> None:
        # Written under the batch's number: a batch that is repeated after a failure replaces itself.
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{work.path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out).select(stream.columns)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling windows by event type; a window older than ``late`` leaves the state, and events for it are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "total")


EMA = "user_id bigint, ema double, seen bigint"


def moving_averages(events: DataFrame, alpha: float = 0.25) -> DataFrame:
    """STR02: (user_id, ema, seen) after each batch, updated in the order of event_id within it; values that aren't positive only count as seen."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ema, seen = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("event_id")
        for value in rows["value"].tolist():
            if value is not None and value > 0:
                ema = value if ema is None else alpha * value + (1 - alpha) * ema
        state.update((ema, seen + len(rows)))
        yield pd.DataFrame({"user_id": [key[0]], "ema": [ema], "seen": [seen + len(rows)]})

    return events.groupBy("user_id").applyInPandasWithState(update, EMA, "ema double, seen bigint", "update", GroupStateTimeout.NoTimeout)


TURNS = "traj_uid string, stage string, steps int, valid boolean"


def trajectories(steps: DataFrame) -> DataFrame:
    """STR01: (traj_uid, stage, steps, valid): where each trajectory of (traj_uid, step, kind) stands after a batch.

    A decision that answers ends it, one that calls a tool asks for an answer, anything else makes it invalid.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stage, done, valid = state.get if state.exists else ("decision", 0, True)
        for kind in pd.concat(list(batches)).sort_values("step")["kind"].tolist():
            done += 1
            if stage == "decision" and kind in ("answer", "tool"):
                stage = "done" if kind == "answer" else "answer_after_tool"
            elif stage == "answer_after_tool" and kind == "answer":
                stage = "done"
            else:
                stage, valid = "done", False
        state.update((stage, done, valid))
        yield pd.DataFrame({"traj_uid": [key[0]], "stage": [stage], "steps": [done], "valid": [valid]})

    return steps.groupBy("traj_uid").applyInPandasWithState(update, TURNS, "stage string, steps int, valid boolean", "update", GroupStateTimeout.NoTimeout)


def last_states(states: DataFrame, key: str, order: str) -> DataFrame:
    """What an update stream wrote, reduced to the last row of each key by ``order``, a number that grows."""
    return states.groupBy(key).agg(F.max_by(F.struct(*[c for c in states.columns if c != key]), order).alias("s")).select(key, "s.*")


def recorder(log: DataFrame, steps: int) -> DataFrame:
    """STR03: one row: whether the log (step) has exactly 1 to ``steps``, once each."""
    return log.agg(F.coalesce((F.count("*") == steps) & (F.count_distinct("step") == steps) & (F.min("step") == 1) & (F.max("step") == steps), F.lit(steps == 0)).alias("complete"))


def removable(checkpoints: DataFrame, keep: int) -> DataFrame:
    """STR06: (step) of the checkpoints (step, complete) to delete: all but the last ``keep`` complete ones up to the latest; none if the latest is incomplete."""
    latest = checkpoints.agg(F.max(F.struct("step", "complete")).alias("m")).select("m.*").withColumnRenamed("step", "last").withColumnRenamed("complete", "sound")
    # A run has a handful of checkpoints.
    place = F.sum(F.col("complete").cast("int")).over(Window.partitionBy().orderBy(F.desc("step")))
    kept = F.col("complete") & (F.col("place") <= keep)
    return checkpoints.withColumn("place", place).join(F.broadcast(latest), F.col("sound") & (F.col("step") <= F.col("last"))).filter(~kept).select("step")  # one row


def missing(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """STR07, SRC14: what a resumed run still has to do."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")
