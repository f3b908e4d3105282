from pyspark.sql import functions as F

from sievemill.functions import derived


def test_derived(spark):
    df = spark.createDataFrame([("data/a/b", "x <image> y", ["i"], '{"b":1,"a":[2]}', 2)], "p string, t string, i array<string>, r string, n int")
    got = df.select(
        derived.rebased(F.col("p"), "/root/"),
        derived.expanded(F.col("t"), F.col("i"), "[I]"),
        derived.expanded(F.col("t"), F.array(), "[I]"),
        derived.request_fingerprint("r") == derived.request_fingerprint(F.lit('{"a": [2], "b": 1}')),
        derived.request_fingerprint(F.lit("{")),
        derived.total_steps(F.lit(0), F.lit(None).cast("int"), F.lit(7)),
        derived.sound_response(F.array(F.lit("a")), F.array(F.array(F.lit(3)))),
        derived.sound_response(F.array(F.lit("a")), F.array(F.array(F.lit(0)))),
        derived.format_score(F.lit(True), F.lit(True), F.lit("tool"), F.lit("tool")),
        derived.format_score(F.lit(None).cast("boolean"), F.lit(True), F.lit("tool"), F.lit("tool")),
    ).head()
    assert tuple(got) == ("/root/a/b", "x [I] y", None, True, None, 7, True, False, 1.0, 0.0)


def test_remaining(spark):
    got = spark.range(1).select(derived.remaining(F.lit(90.0), F.lit(2), F.lit(10)), derived.remaining(F.lit(90.0), F.lit(2), F.lit(0))).head()
    assert tuple(got[0]) == (20.0, 720.0, 0.25) and got[1] is None


def test_crop(spark):
    box = F.array(*[F.lit(v) for v in (250.0, 250.0, 750.0, 750.0)])
    got = spark.range(1).select(derived.executed_crop(box, F.lit(8), F.lit(4)).alias("c")).head()["c"]
    assert got["pixels"] == [2, 1, 6, 3] and got["executed"] == [0.25, 0.25, 0.75, 0.75]
