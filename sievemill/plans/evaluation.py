"""Queries of the evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics, trajectory
from ..operators.metrics import mean, rounded
from ..session import table


def _evals(spark, d):
    return metrics.records(table(spark, d, "eval_record"))


def _pairs(spark, d):
    return _evals(spark, d).select("dataset", F.col("vision_ratio").alias("p"), F.col("vision_ratio_true").alias("q"))


def _runs(spark, d):
    """Two runs over samples: one data set stands for before, one for after (a proxy); a sample's records are averaged."""
    rows = _evals(spark, d).filter("sample_id IS NOT NULL")
    run = lambda name: rows.filter(F.col("dataset") == name).groupBy("sample_id").agg(F.min("correct").alias("correct"), F.max("outcome_reward").alias("score"))
    return run("dockqa"), run("signbench")


def _rollouts(spark, d):
    """Evaluation records as rollouts of a prompt's group, the sample (a proxy)."""
    rows = _evals(spark, d).filter("sample_id IS NOT NULL")
    return rows.select("eval_id", "sample_id", "used_tool", "tool_reward", "tool_reward_eligible", F.col("correct").cast("double").alias("accuracy"), F.lit(None).cast("double").alias("answer_score"), (F.col("format_compliance") / 10).alias("format_reward"))


def _rewarded(spark, d):
    return trajectory.rewarded(_rollouts(spark, d), "sample_id")


def agg05(spark, d):
    rows = _evals(spark, d)
    return rows.agg(*metrics.block(rows.columns))


def agg09(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("us"))
    return rows.select("user_id", rounded(metrics.throughput(F.col("n"), F.col("us") / 1e6), 9).alias("per_second"))


def agg12(spark, d):
    rows = _rewarded(spark, d)
    return rows.groupBy("sample_id").agg(rounded(F.max("direct_share")).alias("direct_share"))


def win01(spark, d):
    rows = trajectory.with_advantages(_rewarded(spark, d), "sample_id")
    return rows.select("eval_id", "sample_id", rounded(F.col("outcome_reward")).alias("outcome_reward"), rounded(F.col("outcome_advantage"), 5).alias("outcome_advantage"), rounded(F.col("tool_advantage"), 5).alias("tool_advantage"))


def scl29(spark, d):
    rows = _evals(spark, d).withColumn("batch", F.concat_ws("/", "dataset", F.substring("eval_id", -2, 2)))
    return trajectory.token_weights(rows, "batch", "vision_tokens_acquired", "used_tool", 4).select("eval_id", rounded(F.col("weight"), 9).alias("weight"))


def scl30(spark, d):
    rows = _pairs(spark, d)
    loss = trajectory.clipped_loss(F.col("q") - F.col("p"), F.lit(0.5) - F.col("p"))
    return rows.groupBy("dataset").agg(mean(loss).alias("loss"))


def scl31(spark, d):
    rows = _evals(spark, d)
    ratio = lambda c: rounded(metrics.vision_ratio(F.col(c), F.col("vision_tokens_full")))
    return rows.select("eval_id", ratio("vision_tokens_acquired").alias("acquired"), ratio("vision_tokens_processed").alias("processed"))


def agg18(spark, d):
    return metrics.deltas(_evals(spark, d), "vision_tokens_acquired", "vision_tokens_processed", "dataset")


def agg23(spark, d):
    size = F.struct("vision_tokens_processed", "eval_id")
    return _evals(spark, d).groupBy("dataset").agg(F.max(size).alias("m")).select("dataset", "m.vision_tokens_processed", "m.eval_id")


def agg30(spark, d):
    each = _evals(spark, d).groupBy("dataset").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"))
    best = each.agg(F.max(F.struct(F.round("accuracy", 12).alias("a"))).alias("m"))
    top = each.join(F.broadcast(best), F.round("accuracy", 12) == F.col("m.a"))  # one row
    return top.agg(F.min("dataset").alias("dataset"), rounded(F.max("accuracy")).alias("accuracy"))


def win08(spark, d):
    rows = _evals(spark, d).filter("tool_reward IS NOT NULL").withColumn("diff", F.abs(F.col("vision_ratio_true") - F.col("vision_ratio")))
    # A sample has a handful of records; those without one stand alone, so they are no hot key.
    order = Window.partitionBy("sample_id", F.when(F.col("sample_id").isNull(), F.col("eval_id"))).orderBy(F.desc("diff"), "eval_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter("rank <= 2").select("sample_id", "eval_id", rounded(F.col("diff")).alias("diff"), "rank")


def win09(spark, d):
    rows = _evals(spark, d).withColumn("diff", rounded(F.abs(F.col("vision_ratio_true") - F.col("vision_ratio")))).filter("diff IS NOT NULL")
    best = rows.groupBy("sample_id", "dataset").agg(F.max("diff").alias("diff"))
    return best.orderBy(F.desc("diff"), "sample_id", "dataset").limit(4)  # the report's four largest


def agg29(spark, d):
    events = table(spark, d, "events")
    return trajectory.last_active(events.withColumn("won", F.col("event_type") == "purchase"), "user_id", "event_id", F.col("value") > 50, "won")


def agg32(spark, d):
    rows = _evals(spark, d).select("eval_id", F.when(F.col("correct"), 0).when(F.col("used_tool"), -9).otherwise(1).alias("code"), "final_answer_valid")
    return rows.select("eval_id", metrics.run_status(rows, "code", "final_answer_valid").alias("status"))


def win10(spark, d):
    return trajectory.moving_average(table(spark, d, "events"), "user_id", "event_id", "value").select("user_id", rounded(F.col("ema")).alias("ema"), "seen")


def scl51(spark, d):
    props = F.from_json("props", "map<string,bigint>")
    return table(spark, d, "events").select("event_id", props["k"].alias("k"))


def scl52(spark, d):
    value = F.when(F.col("value") > 400, F.lit(float("nan"))).otherwise(F.col("value"))
    rows = table(spark, d, "events").withColumn("v", value)
    return rows.select("event_id", F.when(metrics.finite("v"), F.col("v")).alias("value"), (~metrics.finite("v")).alias("dropped"))


def agg28(spark, d):
    return metrics.two_level_mean(_evals(spark, d), "sample_id", "vision_tokens_acquired")


def agg27(spark, d):
    return metrics.fingerprint(_evals(spark, d).filter("sample_id IS NOT NULL"), ["sample_id"], "eval_id", F.col("vision_tokens_acquired"))


def flt12(spark, d):
    """Rows with a metric that is missing or not finite, by data set."""
    bad = ~metrics.finite("vision_ratio", "vision_ratio_true", "outcome_reward")
    return _evals(spark, d).groupBy("dataset").agg(F.count(F.when(bad, 1)).alias("bad"))


def joi18(spark, d):
    """Samples shared by each pair of data sets; the pairs come from a sample's own data sets, of which there are few."""
    each = _evals(spark, d).filter("sample_id IS NOT NULL").groupBy("sample_id").agg(F.sort_array(F.collect_set("dataset")).alias("s"))
    a = each.select("s", F.explode("s").alias("a"))
    return a.select("a", F.explode("s").alias("b")).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def joi14(spark, d):
    """First and second pictures' tokens; records that used the tool have a second response."""
    rows = _evals(spark, d).filter("sample_id IS NOT NULL")
    first = rows.groupBy("dataset", "sample_id").agg(F.max("vision_tokens_low_first").alias("low_first"))
    second = rows.filter("used_tool").groupBy("dataset", "sample_id").agg(F.max("vision_tokens_low_second").alias("low_second"), F.max("vision_tokens_crop").alias("crop"))
    return metrics.with_second(first, second, ["dataset", "sample_id"])


QUERIES = {
    "agg05_metric_block": agg05,
    "agg06_08_benchmark_blocks": lambda s, d: metrics.by_dataset(table(s, d, "eval_record")),
    "agg07_cohorts": lambda s, d: metrics.by_cohort(table(s, d, "eval_record"), table(s, d, "manifest")),
    "agg08_macro_accuracy": lambda s, d: metrics.macro_accuracy(table(s, d, "eval_record")),
    "agg09_throughput": agg09,
    "agg12_direct_share": agg12,
    "win01_win02_advantages": win01,
    "scl29_token_weights": scl29,
    "scl30_clipped_loss": scl30,
    "scl31_vision_ratios": scl31,
    "agg16_differences": lambda s, d: metrics.differences(_pairs(s, d), "p", "q", ["dataset"]),
    "agg17_ratios": lambda s, d: metrics.ratios(_pairs(s, d), "q", "p", ["dataset"]),
    "agg18_deltas": agg18,
    "agg18_first_differing": lambda s, d: metrics.first_differing(_evals(s, d), "vision_tokens_acquired", "vision_tokens_processed", "dataset", "eval_id"),
    "joi13_agg19_before_after": lambda s, d: metrics.before_after(*_runs(s, d)),
    "joi14_second_responses": joi14,
    "agg23_largest": agg23,
    "agg27_fingerprints": agg27,
    "agg28_two_level_mean": agg28,
    "agg29_last_active": agg29,
    "agg30_best": agg30,
    "agg32_run_status": agg32,
    "win08_top_differences": win08,
    "win09_focus": win09,
    "win10_moving_average": win10,
    "scl51_nested_get": scl51,
    "scl52_json_safe": scl52,
    "flt12_not_finite": flt12,
    "joi18_overlap": joi18,
}

_E = "e AS (SELECT DISTINCT * FROM eval_record)"


def _avg(c: str, name: str, where: str = "TRUE") -> str:
    return f"round(avg(CAST({c} AS DOUBLE)) FILTER (WHERE {where}), 6) AS {name}"


_COMMON = [_avg("correct", "accuracy"), _avg("correct", "direct_answer_accuracy", "NOT used_tool"), _avg("correct", "tool_answer_accuracy", "used_tool"), _avg("used_tool", "tool_call_rate"), _avg("NOT first_action_valid", "invalid_first_action_rate"), _avg("NOT final_answer_valid", "invalid_final_answer_rate"), _avg("format_compliance", "format_compliance")]
_ELIGIBLE = "used_tool AND tool_reward_eligible AND tool_reward IS NOT NULL"
_BLOCK = ", ".join(["count(*) AS count", *_COMMON, _avg("correct", "answer_score"), "CAST(NULL AS DOUBLE) AS estimated_generation_seconds_per_sample", _avg("outcome_reward", "outcome_reward"), _avg("tool_reward", "tool_reward", _ELIGIBLE), f"count(*) FILTER (WHERE {_ELIGIBLE}) AS tool_reward_count", _avg("vision_tokens_low_first", "vision_tokens_low"), *[_avg(c, c) for c in ("vision_tokens_crop", "vision_tokens_acquired", "vision_tokens_processed")], _avg("vision_ratio", "vision_token_ratio")])
_BENCH = ", ".join(["count(*) AS count", "count(*) FILTER (WHERE correct) AS correct_count", *_COMMON, *[_avg(c, c) for c in ("vision_tokens_low_first", "vision_tokens_low_second", "vision_tokens_crop", "vision_tokens_full", "vision_tokens_acquired", "vision_tokens_processed", "vision_ratio", "vision_ratio_true")]])
_ROLLOUTS = f"""{_E}, r AS (SELECT eval_id, sample_id, used_tool, tool_reward, tool_reward_eligible, CAST(correct AS DOUBLE) AS accuracy, format_compliance / 10 AS form FROM e WHERE sample_id IS NOT NULL),
    s AS (SELECT *, coalesce(CAST(sum(CASE WHEN accuracy > 0 AND NOT used_tool THEN 1 ELSE 0 END) OVER g AS DOUBLE) / nullif(sum(CASE WHEN accuracy > 0 THEN 1 ELSE 0 END) OVER g, 0), 0.0) AS direct_share
        FROM r WINDOW g AS (PARTITION BY sample_id)),
    o AS (SELECT *, (CASE WHEN accuracy > 0 THEN accuracy ELSE accuracy * CAST(0.99 AS DOUBLE) END) + form + CASE WHEN accuracy > 0 AND (used_tool OR direct_share < 0.2) THEN CAST(-0.01 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS outcome_reward FROM s)"""
_P, _Q = "vision_ratio", "vision_ratio_true"
_FLAGS = "f AS (SELECT sample_id, max(lower(trim(use_tool, ' \t\n\r')) IN ('true', '1')) AS flag FROM manifest WHERE lower(trim(use_tool, ' \t\n\r')) IN ('true', '1', 'false', '0') AND sample_id IS NOT NULL GROUP BY 1)"
_FINITE = "isfinite({0}) AND {0} IS NOT NULL"
_D = f"CASE WHEN {_FINITE.format(_P)} AND {_FINITE.format(_Q)} THEN abs({_P} - {_Q}) END AS d"
_R = f"CASE WHEN {_FINITE.format(_P)} AND {_FINITE.format(_Q)} THEN exp(least(20.0, greatest(-20.0, {_Q} - {_P}))) END AS r"
_STD = "coalesce(CASE WHEN stddev_samp({v}) OVER g > 1e-6 THEN ({v} - avg({v}) OVER g) / (stddev_samp({v}) OVER g + 1e-6) END, 0.0)"
_RUN = "SELECT sample_id, min(correct) AS correct, max(outcome_reward) AS score FROM e WHERE dataset = '{}' AND sample_id IS NOT NULL GROUP BY 1"

SQL = {
    "agg05_metric_block": f"WITH {_E} SELECT {_BLOCK} FROM e",
    "agg06_08_benchmark_blocks": f"WITH {_E} SELECT dataset, CAST(grouping(dataset) AS INTEGER) AS total, {_BENCH} FROM e GROUP BY GROUPING SETS ((), (dataset))",
    "agg07_cohorts": f"WITH {_E}, {_FLAGS}, r AS (SELECT e.*, coalesce(CAST(flag AS VARCHAR), 'unknown') AS c FROM e LEFT JOIN f USING (sample_id)) SELECT CASE WHEN grouping(c) = 1 THEN 'overall' ELSE c END AS cohort, {_BLOCK} FROM r GROUP BY GROUPING SETS ((), (c))",
    "agg08_macro_accuracy": f"WITH {_E} SELECT round(avg(a), 6) AS macro_accuracy, count(a) AS datasets FROM (SELECT avg(CAST(correct AS DOUBLE)) AS a FROM e GROUP BY dataset)",
    "agg09_throughput": "SELECT user_id, round(count(*) / nullif(CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1e6, 0), 9) AS per_second FROM events GROUP BY 1",
    "agg12_direct_share": f"WITH {_ROLLOUTS} SELECT sample_id, round(max(direct_share), 6) AS direct_share FROM o GROUP BY 1",
    "win01_win02_advantages": f"""WITH {_ROLLOUTS}, t AS (SELECT *, CASE WHEN used_tool AND tool_reward_eligible THEN tool_reward END AS tr FROM o)
        SELECT eval_id, sample_id, round(outcome_reward, 6) AS outcome_reward, round({_STD.format(v="outcome_reward")}, 5) AS outcome_advantage, round({_STD.format(v="tr")}, 5) AS tool_advantage FROM t WINDOW g AS (PARTITION BY sample_id)""",
    "scl29_token_weights": f"WITH {_E} SELECT eval_id, round(CASE WHEN vision_tokens_acquired > 0 THEN coalesce(4.0::DOUBLE / nullif(sum(vision_tokens_acquired) OVER (PARTITION BY dataset || '/' || right(eval_id, 2), used_tool), 0), 0) ELSE 0 END, 9) AS weight FROM e",
    "scl30_clipped_loss": f"""WITH {_E}, r AS (SELECT dataset, 0.5 - {_P} AS a, exp(least(20.0, greatest(-20.0, {_Q} - {_P}))) AS x FROM e),
        l AS (SELECT *, greatest(-a * x, -a * least(1.28::DOUBLE, greatest(0.8::DOUBLE, x))) AS plain FROM r)
        SELECT dataset, round(avg(CASE WHEN a < 0 THEN least(plain, -a * 3.0) ELSE plain END), 6) AS loss FROM l GROUP BY 1""",
    "scl31_vision_ratios": f"WITH {_E} SELECT eval_id, round(coalesce(vision_tokens_acquired::DOUBLE / nullif(vision_tokens_full, 0), 0), 6) AS acquired, round(coalesce(vision_tokens_processed::DOUBLE / nullif(vision_tokens_full, 0), 0), 6) AS processed FROM e",
    "agg16_differences": f"""WITH {_E}, r AS (SELECT dataset, {_D} FROM e) SELECT dataset, count(*) AS requested, count(d) AS finite, count(*) - count(d) AS not_finite, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, round(max(d), 6) AS max,
        round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.95), 6) AS p95, round(quantile_cont(d, 0.99), 6) AS p99, {", ".join(f"round(avg(CAST(d > {t} AS DOUBLE)), 6) AS over_{str(t).replace('0.', '')}" for t in (0.01, 0.05, 0.1, 0.5))} FROM r GROUP BY 1""",
    "agg17_ratios": f"""WITH {_E}, r AS (SELECT dataset, {_R} FROM e) SELECT dataset, count(r) AS finite, count(*) - count(r) AS not_finite, round(avg(r), 6) AS mean, round(min(r), 6) AS min, round(max(r), 6) AS max,
        round(quantile_cont(r, 0.01), 6) AS p01, round(quantile_cont(r, 0.5), 6) AS p50, round(quantile_cont(r, 0.99), 6) AS p99, round(avg(CAST(r < 0.8 OR r > 1.28 AS DOUBLE)), 6) AS outside FROM r GROUP BY 1""",
    "agg18_deltas": f"""WITH {_E}, r AS (SELECT dataset, CAST(vision_tokens_acquired AS DOUBLE) AS a, CAST(vision_tokens_acquired AS DOUBLE) - vision_tokens_processed AS d FROM e)
        SELECT dataset, round(max(abs(d)), 6) AS max_abs, round(sqrt(avg(d * d)), 6) AS rms, round(sqrt(sum(d * d)) / nullif(sqrt(sum(a * a)), 0), 6) AS relative_l2 FROM r GROUP BY 1""",
    "agg18_first_differing": f"WITH {_E} SELECT (SELECT dataset FROM e WHERE vision_tokens_acquired IS DISTINCT FROM vision_tokens_processed ORDER BY eval_id, dataset LIMIT 1) AS first_stage",
    "joi14_second_responses": f"""WITH {_E}, f AS (SELECT dataset, sample_id, max(vision_tokens_low_first) AS low_first FROM e WHERE sample_id IS NOT NULL GROUP BY 1, 2),
        s AS (SELECT dataset, sample_id, max(vision_tokens_low_second) AS low_second, max(vision_tokens_crop) AS crop FROM e WHERE sample_id IS NOT NULL AND used_tool GROUP BY 1, 2)
        SELECT f.dataset, f.sample_id, low_first, low_second, crop, s.sample_id IS NOT NULL AS has_second FROM f LEFT JOIN s ON f.sample_id = s.sample_id AND f.dataset IS NOT DISTINCT FROM s.dataset""",
    "joi13_agg19_before_after": f"""WITH {_E}, b AS ({_RUN.format("dockqa")}), a AS ({_RUN.format("signbench")}), j AS (SELECT b.sample_id AS bs, a.sample_id AS s, b.correct AS bc, a.correct AS ac, b.score AS bsc, a.score AS asc_ FROM b FULL OUTER JOIN a USING (sample_id))
        SELECT count(*) FILTER (WHERE bs IS NOT NULL AND s IS NOT NULL) AS paired, count(*) FILTER (WHERE s IS NULL) AS only_before, count(*) FILTER (WHERE bs IS NULL) AS only_after,
        round(avg(CAST(ac AS DOUBLE) - CAST(bc AS DOUBLE)), 6) AS accuracy_delta, round(avg(asc_ - bsc), 6) AS score_delta, count(*) FILTER (WHERE asc_ <> bsc) AS changed,
        count(*) FILTER (WHERE NOT bc AND ac) AS wrong_to_correct, count(*) FILTER (WHERE bc AND NOT ac) AS correct_to_wrong FROM j""",
    "agg23_largest": f"WITH {_E} SELECT dataset, m.t AS vision_tokens_processed, m.i AS eval_id FROM (SELECT dataset, max({{'t': vision_tokens_processed, 'i': eval_id}}) AS m FROM e GROUP BY 1)",
    "agg27_fingerprints": f"WITH {_E} SELECT sample_id, sha256(string_agg(p, chr(10) ORDER BY p)) AS fingerprint FROM (SELECT DISTINCT sample_id, eval_id || '=' || coalesce(CAST(vision_tokens_acquired AS VARCHAR), 'null') AS p FROM e WHERE sample_id IS NOT NULL) GROUP BY 1",
    "agg28_two_level_mean": f"WITH {_E} SELECT round(avg(m), 6) AS mean, count(m) AS rows FROM (SELECT avg(vision_tokens_acquired) AS m FROM e GROUP BY sample_id)",
    "agg29_last_active": "SELECT user_id, arg_max(event_type = 'purchase', event_id) FILTER (WHERE value > 50) AS success FROM events GROUP BY 1",
    "agg30_best": f"WITH {_E}, a AS (SELECT dataset, avg(CAST(correct AS DOUBLE)) AS accuracy FROM e GROUP BY 1) SELECT dataset, round(accuracy, 6) AS accuracy FROM a ORDER BY round(accuracy, 12) DESC, dataset LIMIT 1",
    "agg32_run_status": f"WITH {_E} SELECT eval_id, CASE WHEN correct AND final_answer_valid THEN 'completed' WHEN correct THEN 'incomplete' WHEN used_tool THEN 'signal 9' ELSE 'failed' END AS status FROM e",
    "win08_top_differences": f"WITH {_E} SELECT sample_id, eval_id, round(diff, 6) AS diff, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, CASE WHEN sample_id IS NULL THEN eval_id END ORDER BY diff DESC NULLS LAST, eval_id) AS rank FROM (SELECT *, abs(vision_ratio_true - vision_ratio) AS diff FROM e WHERE tool_reward IS NOT NULL)) WHERE rank <= 2",
    "win09_focus": f"WITH {_E} SELECT sample_id, dataset, max(round(abs(vision_ratio_true - vision_ratio), 6)) AS diff FROM e WHERE vision_ratio_true - vision_ratio IS NOT NULL GROUP BY 1, 2 ORDER BY diff DESC, sample_id NULLS FIRST, dataset LIMIT 4",
    "win10_moving_average": "SELECT user_id, round(list_reduce(list(value ORDER BY event_id) FILTER (WHERE value > 0), lambda a, v: 0.25::DOUBLE * v + 0.75::DOUBLE * a), 6) AS ema, count(*) AS seen FROM events GROUP BY 1",
    "scl51_nested_get": "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events",
    "scl52_json_safe": "SELECT event_id, CASE WHEN value <= 400 THEN value END AS value, value IS NULL OR value > 400 AS dropped FROM events",
    "flt12_not_finite": f"WITH {_E} SELECT dataset, count(*) FILTER (WHERE NOT coalesce(isfinite(vision_ratio) AND isfinite(vision_ratio_true) AND isfinite(outcome_reward), FALSE)) AS bad FROM e GROUP BY 1",
    "joi18_overlap": f"WITH {_E}, s AS (SELECT DISTINCT sample_id, dataset FROM e WHERE sample_id IS NOT NULL) SELECT a.dataset AS a, b.dataset AS b, count(*) AS shared FROM s a JOIN s b ON a.sample_id = b.sample_id AND a.dataset < b.dataset GROUP BY 1, 2",
}
