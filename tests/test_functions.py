"""Golden vectors of the scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from sievemill.functions import actions, answers, geometry, normal, strata
from sievemill.functions.hashing import stable_score
from sievemill.plans import labels


@pytest.mark.parametrize(
    ("prediction", "references", "hit"),
    [("42,138", ["42138"], True), (" LEIGH  BARDUGO ", ["Leigh Bardugo"], True), ("5", ["15"], False), ("5%", ["5"], False), ("5 kg", ["5"], False), ("0.05", ["5"], False), (".5", ["5"], False), ("Friday or Sunday", ["Friday"], False), (None, ["x"], False), ("x", [], False), ("", [None, ""], True)],
)
def test_matches(prediction, references, hit):
    assert answers.match(prediction, references)[0] is hit


@pytest.mark.parametrize(
    ("prediction", "references", "score"),
    [("42130", ["42138"], 42130 / 42138), ("5%", ["5"], 0), ("-5", ["5"], 0), ("0", ["0.05"], 0), ("12", ["100", "15"], 0.8), ("1e999999", ["2e999999"], 0.5), ("1e1000000", ["2e1000000"], 0), ("99999999", ["100000000"], 0.9999)],
)
def test_partial_credit(prediction, references, score):
    assert answers.partial_credit(prediction, references) == pytest.approx(score)


def test_benchmark_scores():
    score = lambda *a: answers.benchmark_score(*a)[0]
    assert score("ChartQA", None, "104", ["100"]) and not score("ChartQA", None, "106", ["100"])
    assert score("MathVerse", "multi-choice", "option B", ["B"]) and not score("MathVerse", "multi-choice", "option C", ["B"])
    assert score("OCRBench", None, "it says A B", ["ab"]) and not score("OCRBench", None, None, ["ab"])


def test_actions():
    parse = actions.parse
    assert parse("<think>I can read it.</think><answer>\\boxed{659}</answer>")["answer"] == "659"
    call = lambda box: '<think>look</think><tool_call>{"name":"request_local_region","arguments":{"bbox_2d":%s}}</tool_call>' % box
    assert parse(call("[100,200,500,750]"), True, 400, 300)["bbox"] == [40, 60, 200, 225]
    assert parse(call("[549,79,625,103]"), True, 440, 180)["bbox"] == pytest.approx([241.56, 14.22, 275, 18.54])
    bad = ["", "<answer>1</answer>", "<think> ... </think><answer>1</answer>", "<think>……</think><answer>1</answer>", "\n<think>a</think><answer>1</answer>", "x<think>a</think><answer>1</answer>", call("[0,0,1,1001]"), call("[true,0,1,1]"), call("[0,0,%s,1]" % ("9" * 1000)), call("[" * 1200 + "]" * 1200), "<think>a<think>b</think></think><answer>1</answer>", "<think>a</think><answer>1</answer><answer>2</answer>", None]
    assert [parse(t)["valid"] for t in bad] == [False] * len(bad)
    assert not parse(call("[0,0,1,1]"), tool_allowed=False)["valid"]
    assert actions.candidate("prefix <answer>\\boxed{42}</answer>") == "42"


def test_actions_in_spark(spark):
    df = spark.createDataFrame([("<think>a</think><answer>b</answer>",), (None,), ("p <answer>\\boxed{ 4 }</answer>",)], "text string")
    got = [tuple(r) for r in df.select(actions.parsed(F.col("text"))["kind"], actions.answer_candidate("text"), actions.says_something_of("text")).collect()]
    assert got == [("answer", "b", True), ("invalid", None, False), ("invalid", "4", True)]


def best(spark, p, refs):
    df = spark.createDataFrame([(p, refs)], "p array<double>, g array<array<double>>")
    r = df.select(geometry.best_overlap(F.col("p"), F.col("g")).alias("b")).head()["b"]
    return r and (r["reward"], r["coverage"], r["iou"])


def test_geometry(spark):
    ref = [0.1, 0.1, 0.3, 0.3]
    assert best(spark, ref, [ref]) == pytest.approx((1, 1, 1))
    assert best(spark, [0.6, 0.6, 0.9, 0.9], [ref])[0] == 0
    assert best(spark, [0.0, 0.0, 1.0, 1.0], [ref])[:2] == pytest.approx((0.2, 1))
    assert best(spark, [0.2, 0.2, 0.4, 0.3], [[0.2, 0.2, 0.4, 0.4]]) == pytest.approx((0.5, 0.5, 0.5))
    assert best(spark, ref, []) is None and best(spark, None, [ref]) is None
    assert best(spark, ref, [[0.5, 0.5, 0.6, 0.6], ref])[0] == pytest.approx(1)
    boxes = [[0.1, 0.1, 0.1, 0.3], [math.nan, 0.0, 1.0, 1.0], [-1.0, 0.0, 1.0, 1.0], [0.0, 0.0, 1.0], None, [0.1, None, 0.2, 0.3], [0.11, 0.11, 0.91, 0.91]]
    df = spark.createDataFrame([(b,) for b in boxes], "b array<double>")
    assert [r[0] for r in df.select(geometry.is_box(F.col("b"))).collect()] == [False] * 6 + [True]
    assert df.filter(geometry.is_box(F.col("b"))).select(geometry.pixel_box(F.col("b"), F.lit(11), F.lit(11))).head()[0] == [1, 1, 11, 11]


def test_reward_packing(spark):
    df = spark.createDataFrame([(c, s, f) for c, s in ((False, 0.9999), (False, 0.25), (True, 1.0)) for f in (0.0, 0.05, 0.1)], "c boolean, s double, f double")
    packed = geometry.packed_reward(F.col("c"), F.col("s"), F.col("f")).cast("float").cast("double")
    for r in df.select("*", geometry.unpacked_reward(packed).alias("u")).collect():
        assert (r["u"]["accuracy"], r["u"]["format"]) == (float(r["c"]), pytest.approx(r["f"]))
        assert r["u"]["score"] == pytest.approx(1.0 if r["c"] else r["s"], abs=1e-5)


def test_normal_forms(spark):
    df = spark.createDataFrame(
        [(" DOC: 1\n", "2", "x", " Training"), (" ", "\t7 ", None, "DEV"), (None, "", "SHA256:0xAB ", "testing\t"), (None, None, "n/a", " "), ("", None, "0", None)], "group_key string, doc_id string, pixel_sha256 string, split string"
    )
    rows = df.select(normal.normal_group_key(), normal.normal_split()).collect()
    assert [r[0] for r in rows] == ["doc:1", "doc:7", "image:" + "ab".rjust(64, "0"), None, "image:" + "0" * 64]
    assert [r[1] for r in rows] == ["train", "val", "test", None, None]
    one = spark.range(1).select(normal.hash_long(normal.hash_value(F.lit("0XFFFFFFFFFFFFFFFF"), 16)), normal.hash_value(F.lit("1" * 17), 16), stable_score(7, F.lit("ä")), stable_score(7, F.lit(None).cast("string"))).head()
    import hashlib

    assert tuple(one) == (-1, None, hashlib.sha256("7\x1fä".encode()).hexdigest(), None)


def test_strata(spark):
    rows = [("How many tables?", [256, 256]), ("Name the ﬁrst TABLE", [256, 257]), ("tabletop", [0, 5]), ("Größe der Tabelle: ratio", None), (None, [2000, 2000]), ("row_1", [1]), ("which row?", [1024, 1024])]
    df = spark.createDataFrame(rows, "q string, s array<bigint>")
    got = [tuple(r) for r in df.select(strata.question_family("q"), strata.area_bucket("s")).collect()]
    assert got == [("count", "small"), ("table", "medium"), ("other", None), ("math", None), (None, "very_large"), ("other", None), ("table", "large")]


def test_all_references_are_compared(spark, tmp_path):
    box = [0.1, 0.1, 0.3, 0.3]
    rows = [("many", [box] + [[0.6, 0.6, 0.9, 0.9]] * 1000 + [box]), ("one", [box]), ("none", []), ("null", None)]
    schema = "annotation_id string, region_annotation struct<reference_boxes:array<array<double>>>"
    spark.createDataFrame([(i, (b,)) for i, b in rows], schema).write.parquet(f"{tmp_path}/annotations.parquet")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(labels, "_annotations", lambda s, d: s.read.parquet(f"{d}/annotations.parquet"))
        assert [tuple(r) for r in labels.scl22(spark, str(tmp_path)).collect()] == [("many", 1.0, 1.0, 1.0)]
