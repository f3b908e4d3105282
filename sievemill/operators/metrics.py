"""Evaluation metrics (AGG05-10, AGG16-19, AGG28-32, JOI13, JOI14, SCL31).

The mean of nothing is NULL, never 0. Cohorts come from one pass with grouping sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normal import normal_flag
from .quantiles import with_quantiles

PLACES = 6


def rounded(c: Column, places: int = PLACES) -> Column:
    """Sums of doubles depend on their order; results are compared to this many places."""
    return F.round(c, places)


def mean(c: Column | str, where: Column | None = None) -> Column:
    value = (F.col(c) if isinstance(c, str) else c).cast("double")
    return rounded(F.avg(value if where is None else F.when(where, value)))


def _no(c: str) -> Column:
    return ~F.col(c)


def records(evaluations: DataFrame) -> DataFrame:
    """Evaluation records without copied rows."""
    return evaluations.distinct()


def block(columns: list[str] = ()) -> list[Column]:
    """AGG05: metrics of a cohort of records with ``columns``.

    Without an answer_score a record's is whether it is correct; without estimated_generation_seconds their mean is NULL.
    """
    score = F.coalesce(F.col("answer_score").cast("double"), F.col("correct").cast("double")) if "answer_score" in columns else F.col("correct")
    seconds = F.col("estimated_generation_seconds") if "estimated_generation_seconds" in columns else F.lit(None)
    tool = F.col("used_tool")
    rewarded = tool & F.col("tool_reward_eligible") & F.col("tool_reward").isNotNull()
    return [
        F.count("*").alias("count"),
        mean("correct").alias("accuracy"),
        mean(score).alias("answer_score"),
        mean("correct", ~tool).alias("direct_answer_accuracy"),
        mean("correct", tool).alias("tool_answer_accuracy"),
        mean("used_tool").alias("tool_call_rate"),
        mean("format_compliance").alias("format_compliance"),
        mean(_no("first_action_valid")).alias("invalid_first_action_rate"),
        mean(_no("final_answer_valid")).alias("invalid_final_answer_rate"),
        mean("outcome_reward").alias("outcome_reward"),
        mean("tool_reward", rewarded).alias("tool_reward"),
        F.count(F.when(rewarded, 1)).alias("tool_reward_count"),
        mean("vision_tokens_low_first").alias("vision_tokens_low"),
        mean("vision_tokens_crop").alias("vision_tokens_crop"),
        mean("vision_tokens_acquired").alias("vision_tokens_acquired"),
        mean("vision_tokens_processed").alias("vision_tokens_processed"),
        mean("vision_ratio").alias("vision_token_ratio"),
        mean(seconds).alias("estimated_generation_seconds_per_sample"),
    ]


def benchmark_block() -> list[Column]:
    """AGG06: metrics of a benchmark's records."""
    tool = F.col("used_tool")
    plain = ["format_compliance", "vision_tokens_low_first", "vision_tokens_low_second", "vision_tokens_crop", "vision_tokens_full", "vision_tokens_acquired", "vision_tokens_processed", "vision_ratio", "vision_ratio_true"]
    return [
        F.count("*").alias("count"),
        F.count(F.when(F.col("correct"), 1)).alias("correct_count"),
        mean("correct").alias("accuracy"),
        mean("correct", ~tool).alias("direct_answer_accuracy"),
        mean("correct", tool).alias("tool_answer_accuracy"),
        mean("used_tool").alias("tool_call_rate"),
        mean(_no("first_action_valid")).alias("invalid_first_action_rate"),
        mean(_no("final_answer_valid")).alias("invalid_final_answer_rate"),
        *[mean(c).alias(c) for c in plain],
    ]


def by_cohort(evaluations: DataFrame, manifest: DataFrame) -> DataFrame:
    """AGG07: the block over all records and for each source flag; cohort is ``overall``, ``true``, ``false`` or ``unknown``."""
    flags = manifest.select("sample_id", normal_flag("use_tool").alias("flag")).filter("sample_id IS NOT NULL AND flag IS NOT NULL").groupBy("sample_id").agg(F.max("flag").alias("flag"))
    rows = records(evaluations).join(flags, "sample_id", "left").withColumn("cohort", F.coalesce(F.col("flag").cast("string"), F.lit("unknown")))
    return rows.groupingSets([[], ["cohort"]], "cohort").agg(F.grouping("cohort").alias("all"), *block(evaluations.columns)).withColumn("cohort", F.when(F.col("all") == 1, "overall").otherwise(F.col("cohort"))).drop("all")


def by_dataset(evaluations: DataFrame) -> DataFrame:
    """AGG08: the benchmark block over all records (dataset NULL, total 1) and for each data set (total 0)."""
    return records(evaluations).groupingSets([[], ["dataset"]], "dataset").agg(F.grouping("dataset").cast("int").alias("total"), *benchmark_block())


def macro_accuracy(evaluations: DataFrame) -> DataFrame:
    """AGG08: mean of the data sets' accuracies, those without one left out."""
    each = records(evaluations).groupBy("dataset").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"))
    return each.agg(rounded(F.avg("accuracy")).alias("macro_accuracy"), F.count("accuracy").alias("datasets"))


def throughput(count: Column, seconds: Column) -> Column:
    """AGG09: NULL for no time."""
    return F.try_divide(count.cast("double"), seconds.cast("double"))


def finite(*columns: str) -> Column:
    """FLT07: all present and finite."""
    ok = F.lit(True)
    for c in columns:
        ok &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return ok


def differences(df: DataFrame, p: str, q: str, keys: list[str]) -> DataFrame:
    """AGG16: distribution of abs(p - q) by ``keys``: counts, moments, quantiles and exceedance rates; pairs not finite are counted apart."""
    rows = df.select(*keys, finite(p, q).alias("ok"), F.when(finite(p, q), F.abs(F.col(p) - F.col(q))).alias("d"))
    over = [mean(F.col("d") > t).alias(f"over_{str(t).replace('0.', '')}") for t in (0.01, 0.05, 0.1, 0.5)]
    out = rows.groupBy(*keys).agg(F.count("*").alias("requested"), F.count("d").alias("finite"), F.count(F.when(~F.col("ok"), 1)).alias("not_finite"), mean("d").alias("mean"), rounded(F.stddev_pop("d")).alias("std"), rounded(F.max("d")).alias("max"), *over)
    return with_quantiles(out, rows, keys, "d", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, PLACES)


def ratios(df: DataFrame, new: str, old: str, keys: list[str], low: float = 0.8, high: float = 1.28) -> DataFrame:
    """AGG17: distribution of exp(new - old) by ``keys``, exponents cut at 20, with the part outside [low, high]."""
    r = F.when(finite(new, old), F.exp(F.least(F.lit(20.0), F.greatest(F.lit(-20.0), F.col(new) - F.col(old)))))
    rows = df.select(*keys, r.alias("r"))
    out = rows.groupBy(*keys).agg(F.count("r").alias("finite"), (F.count("*") - F.count("r")).alias("not_finite"), mean("r").alias("mean"), rounded(F.min("r")).alias("min"), rounded(F.max("r")).alias("max"), mean((F.col("r") < low) | (F.col("r") > high)).alias("outside"))
    return with_quantiles(out, rows, keys, "r", {"p01": 0.01, "p50": 0.5, "p99": 0.99}, PLACES)


def deltas(df: DataFrame, a: str, b: str, stage: str) -> DataFrame:
    """AGG18: for each stage the largest and root mean square difference and the relative L2 norm; NULL norm for an all-zero reference."""
    d = F.col(a).cast("double") - F.col(b)
    return df.groupBy(stage).agg(rounded(F.max(F.abs(d))).alias("max_abs"), rounded(F.sqrt(F.avg(d * d))).alias("rms"), rounded(F.try_divide(F.sqrt(F.sum(d * d)), F.sqrt(F.sum(F.col(a).cast("double") * F.col(a))))).alias("relative_l2"))


def first_differing(df: DataFrame, a: str, b: str, stage: str, order: str) -> DataFrame:
    """AGG18: the first stage, by ``order``, with any difference; one row, NULL if none differs."""
    return df.filter(~F.col(a).eqNullSafe(F.col(b))).agg(F.min_by(stage, F.struct(order, stage)).alias("first_stage"))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """JOI13, AGG19: joint counts and mean changes of two runs over (sample_id, correct, score); rows of one run only are counted."""
    b = before.select("sample_id", F.col("correct").alias("b_correct"), F.col("score").alias("b_score"), F.lit(1).alias("b"))
    a = after.select("sample_id", F.col("correct").alias("a_correct"), F.col("score").alias("a_score"), F.lit(1).alias("a"))
    rows = b.join(a, "sample_id", "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    n = lambda c: F.count(F.when(c, 1))
    return rows.agg(
        n(both).alias("paired"),
        n(F.col("a").isNull()).alias("only_before"),
        n(F.col("b").isNull()).alias("only_after"),
        mean(F.col("a_correct").cast("double") - F.col("b_correct").cast("double"), both).alias("accuracy_delta"),
        mean(F.col("a_score") - F.col("b_score"), both).alias("score_delta"),
        n(both & (F.col("a_score") != F.col("b_score"))).alias("changed"),
        n(both & ~F.col("b_correct") & F.col("a_correct")).alias("wrong_to_correct"),
        n(both & F.col("b_correct") & ~F.col("a_correct")).alias("correct_to_wrong"),
    )


def with_second(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """JOI14: first responses with their second ones, by ``keys``; those without one stay, with NULLs and ``has_second`` false.

    ``second`` holds a key once, so no first response is repeated. NULL keys are equal.
    """
    other = second.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in second.columns if c not in keys], F.lit(True).alias("__second"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return first.join(other, same, "left").withColumn("has_second", F.coalesce("__second", F.lit(False))).drop("__second", *[f"__{k}" for k in keys])


def vision_ratio(used: Column, full: Column, empty: Column | float | None = 0.0) -> Column:
    """SCL31: used over full tokens; ``empty`` where full is 0."""
    return F.coalesce(F.try_divide(used.cast("double"), full.cast("double")), F.lit(empty) if not isinstance(empty, Column) else empty)


def two_level_mean(df: DataFrame, outer: str, value: str) -> DataFrame:
    """AGG28: mean of the means of each ``outer``."""
    return df.groupBy(outer).agg(F.avg(value).alias("m")).agg(rounded(F.avg("m")).alias("mean"), F.count("m").alias("rows"))


def fingerprint(df: DataFrame, keys: list[str], name: str, value: Column) -> DataFrame:
    """AGG27: digest of the sorted (name, value) pairs of each key; for keys with a bounded number of names."""
    pair = F.concat_ws("=", F.col(name), F.coalesce(value.cast("string"), F.lit("null")))
    return df.groupBy(*keys).agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_set(pair))), 256).alias("fingerprint"))


def run_status(df: DataFrame, code: str, complete: str) -> Column:
    """AGG32: completed only with code 0 and a complete report; a negative code names its signal."""
    return F.when((F.col(code) == 0) & F.col(complete), "completed").when(F.col(code) < 0, F.concat(F.lit("signal "), -F.col(code))).when(F.col(code) == 0, "incomplete").otherwise("failed")
