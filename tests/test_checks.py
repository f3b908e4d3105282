import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemill.functions import actions, shape
from sievemill.operators import checks, labels, quantiles, sampling, trajectory, turns
from sievemill.sources import bundles


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_counts_and_phases(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "k string, i int")
    assert rows(checks.group_counts(df, "k", {"a": 2, "c": 1})) == [("", 1, 0, False), ("a", 2, 2, True), ("b", 1, 0, False), ("c", 0, 1, False)]
    assert rows(checks.phases(df.filter("k IS NOT NULL"), "k", "i", 1)) == [("a", 2, 1, False), ("b", 1, 1, True)]
    assert rows(checks.plan_report(df, "k", {"a": 1, "z": 0, "b": 2}, ["i"])) == [("a", 1, 2, 1, True), ("b", 2, 1, 1, False), ("z", 0, 0, 0, True)]
    problem = checks.first_problem({"one": F.col("i") > 2, "two": F.col("i") > 1})
    assert [r[0] for r in df.orderBy("i").select(problem).collect()] == [None, None, "two", "one"]
    none = df.limit(0)
    assert rows(checks.group_counts(none, "k", {"a": 1})) == [("a", 0, 1, False)] and checks.phases(none, "k", "i", 1).count() == 0


def test_cache_and_rules(spark):
    wanted = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "4")], "id string, f string")
    cache = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", None)], "id string, f string")
    assert rows(checks.cache_states(wanted, cache, "id", "f")) == [("a", "hit"), ("b", "mismatch"), ("c", "hit"), ("d", "miss")]
    df = spark.createDataFrame([("x", "images/a"), ("x", "images/a"), ("x", "images/../b"), ("y", None)], "id string, path string")
    assert rows(checks.manifest_rules(df, ["id"], "path", "images", 5)) == [("fewer than 5 rows", 2), ("outside of images", 2), ("repeated id", 1)]


def test_hashes_and_reviews(spark):
    held = spark.createDataFrame([("1", "2"), (None, "3")], "a string, b string")
    df = spark.createDataFrame([(0, "2", "9"), (1, "8", "1"), (2, None, None), (3, "7", "3"), (4, "3", None)], "i int, a string, b string")
    assert [r[0] for r in rows(labels.without_hashes(df, held, [["a", "b"]]))] == [2]
    assert [r[0] for r in rows(labels.without_hashes(df, held, [["a"], ["b"]]))] == [0, 1, 2, 4]
    assert [r[0] for r in spark.createDataFrame([([1], [1]), ([1], [2]), (None, None), ([], [])], "a array<int>, b array<int>").select(shape.aligned(F.col("a"), F.col("b"), F.lit(7))).collect()] == [7, None, None, 7]
    texts = [(" \\boxed{ 7 }\n",), ("\\fbox{x}",), ("\\boxed{x",), (None,), ("plain",)]
    assert [r[0] for r in spark.createDataFrame(texts, "t string").select(actions.unwrapped_of("t")).collect()] == [None if t is None else actions.unwrapped(t) for (t,) in texts]


TRAJECTORY = "id string, route string, question string, answer string, low_path string, crop_path string, low_width bigint, low_height bigint, box array<bigint>, width bigint, height bigint"


def test_turns(spark):
    data = [("a", "tool", "How many {width} rows?", "3", "l", "c", 50, 40, [10, 10, 20, 20], 100, 80), ("b", "direct", "Why?", None, "l", None, 5, 4, None, 10, 8), ("c", "direct", None, "x", "l", None, 5, 4, None, 10, 8)]
    df = spark.createDataFrame(data, TRAJECTORY)
    out = turns.turns(df, "id")
    got = {(r["id"], r["turn_index"]): r for r in out.collect()}
    assert set(got) == {("a", 0), ("a", 1), ("b", 0), ("c", 0)}
    assert "{width} rows" in got["a", 0]["prompt"] and "50 by 40" in got["a", 0]["prompt"] and got["a", 1]["images"] == ["l", "c"]
    assert actions.parse(got["a", 0]["target"])["kind"] == "tool" and actions.parse(got["a", 1]["target"])["answer"] == "3"
    assert actions.parse(got["b", 0]["target"])["error"] == "empty answer block" and got["c", 0]["prompt"] is None
    assert dict(rows(turns.loader_checks(out, "id"))) == {"unknown turn": 0, "placeholders": 1, "lone first turn": 0, "repeated turn": 0}
    broken = out.filter("NOT (id = 'a' AND turn_index = 1)").unionByName(out.filter("id = 'b'").withColumn("route", F.lit("tool")))
    assert dict(rows(turns.loader_checks(broken, "id"))) == {"unknown turn": 0, "placeholders": 1, "lone first turn": 2, "repeated turn": 1}
    assert turns.turns(df.limit(0), "id").count() == 0


def test_summary_and_thoughts(spark):
    texts = [(1, "s", "<think>a</think><answer>b</answer>"), (2, "s", "<think>a"), (3, "s", None), (4, None, "")]
    df = spark.createDataFrame(texts, "i int, k string, text string").withColumn("a", actions.parsed(F.col("text")))
    seen = df.select("k", *turns.inspected("text", F.when(F.col("i") == 2, "length").otherwise("stop"), F.lit(4), F.lit("<")))
    got = {r["k"]: r for r in turns.turn_summary(seen, "k").collect()}
    assert got["s"]["count"] == 3 and got["s"]["valid_action_rate"] == got["s"]["length_truncation_rate"] == 0.333333 and got["s"]["mean_generated_tokens"] == 4
    assert got["s"]["action_kinds"] == '{"answer":1,"invalid":2}' and got["s"]["finish_reasons"] == '{"length":1,"stop":2}' and got[None]["count"] == 1
    questions = [("Which ROW?", 0), ("The length of it", 1), ("how many?", 2), ("Who?", 3), ("score in the table", 0)]
    said = [*turns.THOUGHTS, turns.OTHER_THOUGHT]
    assert [r[0] for r in spark.createDataFrame(questions, "q string, n int").select(turns.thought(F.col("q"))).collect()] == [said[n] for _, n in questions]


def test_moving_average_and_first_ranks(spark):
    values = [5.0, -1.0, 3.0, None, 8.0, 0.0, 2.0]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)] + [(None, 1, 4.0), ("z", 1, -2.0)], "k string, i int, v double")
    ema = None
    for v in values:
        if v is not None and v > 0:
            ema = v if ema is None else 0.25 * v + 0.75 * ema
    got = {r["k"]: (r["ema"], r["seen"]) for r in trajectory.moving_average(df, "k", "i", "v").collect()}
    assert abs(got["k"][0] - ema) < 1e-12 and got["k"][1] == 7 and got[None] == (4.0, 1) and got["z"] == (None, 1)
    ranked = spark.range(50).withColumn("digest", sampling.rank_digest(F.col("id").cast("string"), 1))
    assert rows(sampling.first_ranks(ranked, 7).select("digest")) == sorted(rows(ranked.select("digest")))[:7]
    assert sampling.first_ranks(ranked.limit(0), 7).count() == 0


def test_quantiles(spark):
    rng = random.Random(7)
    data = [(rng.choice(["a", "a", "b", None]), rng.choice([None, rng.random(), 0.5])) for _ in range(300)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r["k"]: r for r in quantiles.quantiles(df, ["k"], "v", {"lo": 0.0, "mid": 0.37, "hi": 1.0}).collect()}
    for k in {k for k, v in data if v is not None}:
        own = np.array([v for j, v in data if j == k and v is not None])
        assert np.allclose([got[k]["lo"], got[k]["mid"], got[k]["hi"]], np.quantile(own, [0.0, 0.37, 1.0]))
    assert "none" not in got and quantiles.quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0
    whole = quantiles.quantiles(df, [], "v", {"m": 0.5}).head()["m"]
    assert np.isclose(whole, np.median([v for _, v in data if v is not None]))


def test_small_files(spark, tmp_path):
    assert bundles.configured({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}, overrides=["a.d.e=[1]", "f=x y"]) == {"a": {"b": 3, "c": 2, "d": {"e": [1]}}, "f": "x y"}
    folder = tmp_path / "run"
    (folder / "sub").mkdir(parents=True)
    for name in ("a.json", "sub/b.md", "weights.bin"):
        (folder / name).write_text(name)
    assert bundles.bundle(str(folder), str(tmp_path / "run.zip")) == ["run/a.json", "run/sub/b.md"]
    good = {n: hashlib.sha256(n.encode()).hexdigest() for n in ("a.json", "sub/b.md")}
    assert bundles.frozen(str(folder), good, str(tmp_path / "kept")) == good
    with pytest.raises(ValueError, match="a.json"):
        bundles.frozen(str(folder), good | {"a.json": "0"}, str(tmp_path / "other"))
    assert not (tmp_path / "other").exists()
    texts = [None, "", "short\nline", "word " * 60]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(bundles.clipped("t")).collect()]
    assert got[:3] == [None, "", "short line"] and got[3].count("\n") == 1 and got[3].endswith("wor…")
    assert spark.range(1).select(bundles.now()).head()[0].endswith("+00:00")
