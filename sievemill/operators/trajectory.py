"""Trajectory analytics (AGG11-15, AGG29, JOI15, WIN01, WIN02, WIN11, WIN14, SCL28-30)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import sequence_number

EPSILON = 1e-6


def assembled(steps: DataFrame) -> DataFrame:
    """AGG14, JOI15: one row per trajectory from its steps (traj_uid, stage, sample_id, reward, low, crop, processed, full, padding).

    Stages are ``decision``, ``answer_direct`` and ``answer_after_tool``. Padding rows are left out. ``sound`` says whether
    the structure holds: one decision or direct answer and at most one later answer, one sample.
    """
    at = lambda stage, c: F.max(F.when(F.col("stage") == stage, F.col(c)))
    n = lambda *stages: F.count(F.when(F.col("stage").isin(*stages), 1))
    return (
        steps.filter(~F.col("padding"))
        .groupBy("traj_uid")
        .agg(
            F.min("sample_id").alias("sample_id"),
            (n("answer_after_tool") > 0).alias("used_tool"),
            F.coalesce(at("answer_after_tool", "reward"), at("decision", "reward")).alias("outcome"),
            F.when(n("answer_after_tool") > 0, at("decision", "reward")).alias("tool_reward"),
            (F.max("low") + F.coalesce(F.max("crop"), F.lit(0))).alias("acquired"),
            F.sum("processed").alias("processed"),
            F.max("full").alias("full"),
            ((n("decision") == 1) & (n("answer_after_tool") <= 1) & (F.min("sample_id") == F.max("sample_id")) & (F.count("*") == n("decision", "answer_after_tool"))).alias("sound"),
        )
    )


def standardized(value: Column, group: list[str], where: Column | None = None) -> Column:
    """WIN01, WIN02: (value - mean) / (sample deviation + epsilon) within the group, over the rows of ``where``.

    0 for rows outside, for fewer than two values and for a deviation of at most epsilon. A prompt's group is a
    handful of rollouts; the window is over them.
    """
    over = Window.partitionBy(*group)
    own = value if where is None else F.when(where, value)
    deviation = F.stddev_samp(own).over(over)
    result = F.when(deviation > EPSILON, (own - F.avg(own).over(over)) / (deviation + EPSILON))
    return F.coalesce(F.nanvl(result, F.lit(0.0)), F.lit(0.0))


def rewarded(rows: DataFrame, group: str, penalty: float = 0.01, threshold: float = 0.2) -> DataFrame:
    """SCL28, AGG12: balance and outcome rewards of (accuracy, answer_score, format_reward, used_tool) within each group.

    A correct answer by tool pays the penalty, a direct one if few of the group's correct answers are direct.
    """
    if not 0 <= penalty < 1 or not 0 <= threshold <= 1:
        raise ValueError("penalty must lie in [0, 1), threshold in [0, 1]")
    over = Window.partitionBy(group)
    correct = F.col("accuracy") > 0
    direct = F.sum(F.when(correct & ~F.col("used_tool"), 1).otherwise(0)).over(over)
    share = F.coalesce(F.try_divide(direct.cast("double"), F.sum(F.when(correct, 1).otherwise(0)).over(over).cast("double")), F.lit(0.0))
    score = F.coalesce(F.col("answer_score"), F.col("accuracy").cast("double"))
    balance = F.when(correct & (F.col("used_tool") | (F.col("direct_share") < threshold)), -penalty).otherwise(0.0)
    return (
        rows.withColumn("direct_share", share)
        .withColumn("balance_reward", balance)
        .withColumn("outcome_reward", F.when(correct, score).otherwise(score * (1 - penalty)) + F.col("format_reward") + F.col("balance_reward"))
    )


def with_advantages(rows: DataFrame, group: str) -> DataFrame:
    """WIN01, WIN02: outcome advantage over the group, tool advantage over its eligible tool rows only."""
    eligible = F.col("used_tool") & F.col("tool_reward_eligible") & F.col("tool_reward").isNotNull()
    return rows.withColumn("outcome_advantage", standardized(F.col("outcome_reward"), [group])).withColumn("tool_advantage", standardized(F.col("tool_reward"), [group], eligible))


def token_weights(rows: DataFrame, batch: str, tokens: str, is_tool: str, accumulation: int) -> DataFrame:
    """AGG15, SCL29: weight M / N of each row's tokens, N being its kind's tokens in the batch; 0 for rows without tokens."""
    if accumulation <= 0:
        raise ValueError("accumulation must be positive")
    kinds = rows.groupBy(F.col(batch).alias("__batch"), F.col(is_tool).alias("__kind")).agg(F.sum(tokens).alias("__sum"))
    same = F.col(batch).eqNullSafe(F.col("__batch")) & F.col(is_tool).eqNullSafe(F.col("__kind"))
    weight = F.coalesce(F.try_divide(F.lit(float(accumulation)), F.col("__sum").cast("double")), F.lit(0.0))
    return rows.join(kinds, same).withColumn("weight", F.when(F.col(tokens) > 0, weight).otherwise(0.0)).drop("__batch", "__kind", "__sum")


def clipped_loss(log_ratio: Column, advantage: Column, low: float = 0.2, high: float = 0.28, dual: float = 3.0) -> Column:
    """SCL30: clipped surrogate loss of one token, bounded for negative advantages by ``dual``."""
    ratio = F.exp(F.least(F.lit(20.0), F.greatest(F.lit(-20.0), log_ratio)))
    plain = F.greatest(-advantage * ratio, -advantage * F.least(F.lit(1 + high), F.greatest(F.lit(1 - low), ratio)))
    return F.when(advantage < 0, F.least(plain, -advantage * dual)).otherwise(plain)


def last_active(rows: DataFrame, key: str, step: str, active: Column, won: str) -> DataFrame:
    """AGG29: success by the last active step of each key."""
    return rows.groupBy(key).agg(F.max_by(won, F.when(active, F.col(step))).alias("success"))


def moving_average(rows: DataFrame, key: str, order: str, value: str, alpha: float = 0.25) -> DataFrame:
    """WIN10: exponential moving average in order; values that aren't positive are passed over, the first one seeds it.

    A sum of the values, each weighted by how many come after it, so no task holds a key's values: they are numbered
    over range partitions. ``seen`` counts all rows of the key.
    """
    own = F.col(key).alias("__key")
    usable = sequence_number(rows.filter(F.col(value) > 0).select(own, F.col(order).alias("__order"), F.col(value).cast("double").alias("__v")), ["__key"], [F.col("__order"), F.col("__v")], "__n")
    counts = rows.groupBy(own).agg(F.count("*").alias("seen"), F.count(F.when(F.col(value) > 0, 1)).alias("__all"))
    after = F.col("__all") - F.col("__n")
    weight = F.pow(F.lit(1 - alpha), after) * F.when(F.col("__n") == 1, 1.0).otherwise(alpha)
    sums = usable.join(counts.withColumnRenamed("__key", "__k"), F.col("__key").eqNullSafe(F.col("__k"))).groupBy("__k").agg(F.sum(weight * F.col("__v")).alias("ema"))
    return counts.join(sums, F.col("__key").eqNullSafe(F.col("__k")), "left").select(F.col("__key").alias(key), "ema", "seen")
