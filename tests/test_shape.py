import posixpath

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from sievemill.functions import shape


def test_blobs(spark):
    df = spark.createDataFrame([(1, (b"abc", "x"), [b"de", None])], "id int, image struct<bytes:binary,name:string>, more array<binary>")
    assert shape.binary_paths(df.schema) == ["image.bytes", "more[]"]
    with pytest.raises(ValueError):
        shape.only_blob(df.schema)
    assert shape.only_blob(T.StructType([df.schema["image"]])) == "image.bytes"
    got = df.select(*[shape.without_bytes(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]).head()
    assert got["image"].asDict() == {"name": "x"} and [r and r["binary_length"] for r in got["more"]] == [2, None]


def test_names():
    assert shape.known_names("all", ["a", "b"]) == ["a", "b"]
    assert shape.known_names(" b,a ", ["a", "b"]) == ["a", "b"]
    with pytest.raises(ValueError):
        shape.known_names("c", ["a"])


def test_paths(spark):
    """Against the resolution of the operating system's own path type."""
    paths = ["images/a.png", "images/../x.png", "images/b/../a.png", "/images/a", "other/a", "../images/a", None, "./images/a", "images", "", "images/../etc/x/y", "images/../etc/passwd", "a/../images/x.png", "images/./b//c", "a/../../images/x", "images/b/..", "../base/images/a"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(shape.under(F.col("p"), "images")).collect()]

    def inside(p):
        if p is None or p.startswith("/"):
            return False
        full = posixpath.normpath(posixpath.join("/x/y", p))
        # A path that leaves the base is out even if it comes back.
        left = any(posixpath.normpath("/x/y/" + "/".join(p.split("/")[:i])).startswith("/x/y") is False for i in range(len(p.split("/")) + 1))
        return full.startswith("/x/y/images/") and not left

    assert got == [inside(p) for p in paths]


def test_mismatch_and_context(spark):
    df = spark.createDataFrame([([1, 2], [1, 2]), ([1, 2], [1, 3]), ([1], [1, None]), ([], [])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(shape.first_mismatch(F.col("a"), F.col("b"))).collect()] == [None, 1, 1, None]
    assert spark.range(1).select(shape.context(F.array(*[F.lit(i) for i in range(9)]), F.lit(1), 2)).head()[0] == [0, 1, 2, 3]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
