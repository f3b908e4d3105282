import random

from pyspark.sql import functions as F

from sievemill.operators import sequence
from sievemill.operators.ranking import hash_order_sum


def test_running_sums_equal_a_plain_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), rng.choice([rng.random(), 0.5, None, -1.0, 2.0]), i, rng.randrange(5)) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, unit double, id int, w int")
    got = {r["id"]: (r["rank"], r["run"]) for r in hash_order_sum(hash_order_sum(df, ["k"], "unit", ["id"]), ["k"], "unit", ["id"], F.col("w"), "run", 7).collect()}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        total = 0
        for n, r in enumerate(own, 1):
            total += r[3]
            assert got[r[2]] == (n, total)
    assert hash_order_sum(df.limit(0), ["k"], "unit", ["id"]).count() == 0


def test_sequence_blocks_and_padding(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", i) for i in range(100)], "k string, v int")
    got = {(r["k"], r["v"]): r["number"] for r in sequence.sequence_number(df, ["k"], [F.col("v")]).collect()}
    for key in "ab":
        assert [got[key, v] for v in sorted(v for k, v in got if k == key)] == list(range(1, sum(k == key for k, _ in got) + 1))
    assert {r["block"] for r in sequence.blocks(df, [], [F.col("v")], 30).collect()} == {0, 1, 2, 3}
    out = sequence.padded(df.limit(5), [F.col("v")], 12)
    assert out.count() == 12 and out.filter("padding").count() == 7
    assert sequence.padded(df.limit(0), [F.col("v")], 12).count() == 0
