import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievemill.sources import files, images
from sievemill.sources.arrow_ipc import ArrowStreamSource
from sievemill.streaming import state


def test_arrow_streams(spark, tmp_path):
    for name, parts in (("b.arrow", [[1, 2], [3]]), ("a.arrow", [[4]]), ("c.arrow", [[]])):
        schema = pa.schema([("v", pa.int64()), ("unused", pa.string())])
        with pa.OSFile(str(tmp_path / name), "wb") as f, pa.ipc.new_stream(f, schema) as w:
            for p in parts:
                w.write_batch(pa.record_batch([pa.array(p, pa.int64()), pa.array(["x"] * len(p))], schema=schema))
    spark.dataSource.register(ArrowStreamSource)
    df = spark.read.format("arrow_stream").schema("shard string, row_in_shard bigint, v bigint, absent string").load(str(tmp_path / "*.arrow"))
    assert sorted(tuple(r) for r in df.collect()) == [("a.arrow", 0, 4, None), ("b.arrow", 0, 1, None), ("b.arrow", 1, 2, None), ("b.arrow", 2, 3, None)]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    files.write_jsonl(df, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), "a int, b string").count() == 2
    with pytest.raises(Exception, match="exist"):
        files.write_jsonl(df, str(tmp_path / "j"))
    (tmp_path / "s.jsonl").write_text('{"a": 1}\n\n')
    assert files.read_jsonl(spark, str(tmp_path / "s.jsonl"), "a int").count() == 1
    with pytest.raises(Exception, match="blank line"):
        files.read_jsonl(spark, str(tmp_path / "s.jsonl"), "a int", strict=True).collect()
    files.write_checked(df, str(tmp_path / "p"), lambda t: None)
    assert files.row_count(spark, str(tmp_path / "p")) == 2
    with pytest.raises(FileExistsError):
        files.write_checked(df, str(tmp_path / "p"), lambda t: None)

    def refuse(_):
        raise ValueError("no")

    with pytest.raises(ValueError):
        files.write_checked(df, str(tmp_path / "q"), refuse)
    assert not (tmp_path / "q").exists() and not list(tmp_path.glob("*.staged"))
    found = files.digests(spark, str(tmp_path), "s.jsonl")
    known = spark.createDataFrame([("s.jsonl", found.head()["sha256"]), ("gone", "0")], "name string, sha256 string")
    assert [tuple(r) for r in files.wrong_digests(found, known).collect()] == [("gone", "missing")]
    assets = files.write_assets(spark.createDataFrame([(1, b"x"), (2, b"x"), (3, None)], "id int, blob binary"), "blob", ".png", str(tmp_path / "assets"))
    assert assets.count() == 3 and spark.read.parquet(str(tmp_path / "assets")).count() == 1
    files.write_assets(spark.createDataFrame([(1, b"x"), (2, b"y")], "id int, blob binary"), "blob", ".png", str(tmp_path / "assets"))
    assert sorted(bytes(r["blob"]) for r in spark.read.parquet(str(tmp_path / "assets")).collect()) == [b"x", b"y"]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    one, other = files.summary(df, ["b"]).head(), files.summary(df.orderBy(F.desc("a")), ["b"]).head()
    assert one == other and one["rows"] == 2


def test_images():
    import numpy as np

    grey = np.tile(np.arange(90, 0, -1, dtype=np.uint8), (80, 1))
    assert images.difference_hash(np.repeat(grey[:, :, None], 3, axis=2)) == "f" * 16
    blue = images.rgb(1, 1, 3, bytes([255, 0, 1]))
    assert blue.tolist() == [[[1, 0, 255]]]
    assert images.fit_sizes([(100, 100), (10, 10)], lambda s: s[0] * s[1], 5000)[0][0] < 100
    assert images.fit_sizes([(1, 1)], lambda s: 9, 5) is None


def test_image_sizes(spark):
    df = spark.createDataFrame([(1, 400)], "w bigint, h bigint")
    got = df.select(images.padded_size(F.col("w"), F.col("h")), images.half_size(F.col("w"), F.col("h")), images.within_budget(F.col("w"), F.col("h"), 100), images.vision_tokens(F.array(F.lit(1), F.lit(4), F.lit(6)))).head()
    assert list(map(lambda x: list(x) if isinstance(x, list) else x, got)) == [[4, 400], [1, 200], [1, 200], 6]


def test_streams_equal_batches(spark, tmp_path):
    events = [(u, i, [1.0, -2.0, 3.0][i % 3]) for i in range(12) for u in (1, 2)]
    schema = "user_id bigint, event_id bigint, value double"
    for k in range(2):
        spark.createDataFrame(events[k * 12 : (k + 1) * 12], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 5).parquet(str(tmp_path / "e"))
    got = {r["user_id"]: r["seen"] for r in state.last_states(state.run(state.moving_averages(stream), "update"), "user_id", "seen").collect()}
    assert got == {1: 12, 2: 12}
    log = spark.createDataFrame([(1,), (2,), (2,)], "step int")
    assert [state.recorder(log, n).head()[0] for n in (2, 3)] == [False, False] and state.recorder(log.distinct(), 2).head()[0]
    points = spark.createDataFrame([(20, True), (40, True), (60, True), (10, False), (80, False)], "step int, complete boolean")
    assert state.removable(points, 2).count() == 0
    assert sorted(r[0] for r in state.removable(points.filter("step <> 80"), 2).collect()) == [10, 20]
