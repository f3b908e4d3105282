import math

import pytest
from pyspark.sql import functions as F

from sievemill.operators import labels, metrics, trajectory


def test_empty_means_are_null(spark):
    schema = "correct boolean, used_tool boolean, tool_reward_eligible boolean, tool_reward double, format_compliance double, first_action_valid boolean, final_answer_valid boolean, outcome_reward double, vision_tokens_low_first bigint, vision_tokens_crop bigint, vision_tokens_acquired bigint, vision_tokens_processed bigint, vision_ratio double"
    one = spark.createDataFrame([(True, False, False, None, 1.0, True, True, 1.0, 1, 0, 1, 1, 0.5)], schema)
    r = one.agg(*metrics.block()).head()
    assert (r["count"], r["accuracy"], r["tool_answer_accuracy"], r["tool_reward"], r["tool_reward_count"]) == (1, 1.0, None, None, 0)
    assert one.limit(0).agg(*metrics.block()).head()["accuracy"] is None


def test_distributions(spark):
    p, q = [0.8, 0.4, 0.9, 0.3], [0.6, 0.5, 0.1, math.nan]
    df = spark.createDataFrame(list(zip(p, q)), "p double, q double").filter("p <> 0.9")
    r = metrics.differences(df, "p", "q", []).head()
    assert (r["requested"], r["finite"], r["not_finite"], r["mean"], r["max"]) == (3, 2, 1, 0.15, 0.2)
    logs = spark.createDataFrame([(0.0, 0.0), (-20.3, -20.0), (-19.7, -20.0), (math.nan, -20.0)], "new double, old double")
    r = metrics.ratios(logs, "new", "old", []).head()
    assert (r["finite"], r["not_finite"]) == (3, 1) and r["outside"] == pytest.approx(2 / 3, abs=1e-6)


def test_before_after(spark):
    b = spark.createDataFrame([("a", True, 1.0), ("b", False, 0.0), ("c", True, 1.0)], "sample_id string, correct boolean, score double")
    a = spark.createDataFrame([("a", True, 1.0), ("b", True, 1.0), ("d", True, 1.0)], "sample_id string, correct boolean, score double")
    r = metrics.before_after(b, a).head()
    assert tuple(r) == (2, 1, 1, 0.5, 0.5, 1, 1, 0)


def test_first_responses_without_a_second_stay(spark):
    first = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "sample_id string, n int")
    second = spark.createDataFrame([("b", 20), (None, 30), ("z", 40)], "sample_id string, m int")
    got = metrics.with_second(first, second, ["sample_id"]).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == [("a", 1, None, False), ("b", 2, 20, True), (None, 3, 30, True)]


def test_rewards_and_advantages(spark):
    rows = [("d1", "g", 1.0, None, 0.1, False, 0.0, False), ("d2", "g", 0.0, None, 0.1, False, 0.0, False), ("t1", "g", 1.0, None, 0.1, True, 0.25, True), ("t2", "g", 1.0, None, 0.1, True, 1.0, True), ("one", "h", 1.0, None, 0.1, False, None, False)]
    df = spark.createDataFrame(rows, "id string, g string, accuracy double, answer_score double, format_reward double, used_tool boolean, tool_reward double, tool_reward_eligible boolean")
    got = {r["id"]: r for r in trajectory.with_advantages(trajectory.rewarded(df, "g"), "g").collect()}
    assert [got[i]["balance_reward"] for i in ("d1", "d2", "t1", "t2")] == [0, 0, -0.01, -0.01]
    assert got["t2"]["outcome_reward"] == pytest.approx(1.09)
    assert got["t2"]["tool_advantage"] == pytest.approx(1 / math.sqrt(2), abs=1e-5) and got["d1"]["tool_advantage"] == 0
    assert got["one"]["outcome_advantage"] == 0


def test_few_direct_answers_pay_too(spark):
    rows = [("d", "g", 1.0, None, 0.0, False)] + [(f"t{i}", "g", 1.0, None, 0.0, True) for i in range(5)]
    df = spark.createDataFrame(rows, "id string, g string, accuracy double, answer_score double, format_reward double, used_tool boolean")
    assert {r["balance_reward"] for r in trajectory.rewarded(df, "g").collect()} == {-0.01}


def test_token_weights_and_averages(spark):
    df = spark.createDataFrame([("b", 2, True), ("b", 3, False), ("b", 0, False)], "b string, n int, t boolean")
    got = sorted((r["n"], r["weight"]) for r in trajectory.token_weights(df, "b", "n", "t", 4).collect())
    assert got == [(0, 0.0), (2, 2.0), (3, pytest.approx(4 / 3))]
    steps = spark.createDataFrame([("r", 1, 100.0), ("r", 2, -1.0), ("r", 3, 60.0)], "k string, o int, v double")
    assert trajectory.moving_average(steps, "k", "o", "v").head()["ema"] == 90


def test_trajectories(spark):
    rows = [("a", "decision", "s", 1.0, 100, None, 100, 400, False), ("b", "decision", "s", 0.25, 100, 50, 100, 400, False), ("b", "answer_after_tool", "s", 1.0, None, None, 150, 400, False), ("b", "answer_after_tool", "s", 1.0, None, None, 150, 400, True), ("c", "answer_after_tool", "s", 1.0, 1, 1, 1, 1, False)]
    df = spark.createDataFrame(rows, "traj_uid string, stage string, sample_id string, reward double, low bigint, crop bigint, processed bigint, full bigint, padding boolean")
    got = {r["traj_uid"]: r for r in trajectory.assembled(df).collect()}
    assert (got["b"]["acquired"], got["b"]["processed"], got["b"]["tool_reward"], got["b"]["sound"]) == (150, 250, 0.25, True)
    assert got["a"]["tool_reward"] is None and not got["c"]["sound"]


def test_edits(spark):
    ann = spark.createDataFrame([("a", 1, None, ("localized", [[1, 2, 3, 4]])), ("b", 2, None, ("global", None)), ("c", 3, None, None)], "sample_id string, annotation_id bigint, annotated_at timestamp, region_annotation struct<status:string,reference_boxes_pixels:array<array<bigint>>>")
    edit = lambda s, e, t, o, ob, n, nb: (s, e, "", "", t, o, ob, n, nb)
    edits = spark.createDataFrame(
        [edit("a", True, "2026-01-01T00:00:00Z", "localized", [9, 9, 9, 9], "global", None), edit("a", True, "2026-01-02T01:00:00+02:00", "localized", [1, 2, 3, 4], "localized", [5, 6, 7, 8]), edit("b", True, "soon", "localized", None, "uncertain", None), edit("x", True, None, None, None, None, None)],
        "sample_id string, edited boolean, verdict string, note string, updated_at string, original_status string, original_reference_box_pixels array<bigint>, edited_status string, edited_reference_box_pixels array<bigint>",
    )
    got = {r["sample_id"]: (r["status"], r["box"], r["applied"], r["stale"]) for r in labels.edited(ann, edits).collect()}
    assert got == {"a": ("localized", [5, 6, 7, 8], True, False), "b": ("global", None, False, True), "c": (None, None, False, False)}
