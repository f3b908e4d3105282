"""Row numbers in any order without a single-task window (WIN03, WIN04, WIN11, WIN12, SRT03)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Workspace


def sequence_number(df: DataFrame, keys: list[str], order: list, out: str = "number") -> DataFrame:
    """Add ``out``: 1, 2, 3 ... by ``order`` within ``keys`` (over all rows without keys). ``order`` should be total.

    Rows are range-partitioned by keys and order and stored, so that what a partition holds is fixed; counts
    of the earlier partitions are the offset of a window inside each. A hot key spreads over partitions.
    """
    own = [F.col(k) for k in keys]
    ranged = df.repartitionByRange(*own, *order).withColumn("__part", F.spark_partition_id())
    fixed = Workspace(df.sparkSession, "sequence").save(ranged, "rows")
    inside = Window.partitionBy("__part", *own).orderBy(*order)
    counts = fixed.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    # One row for each key and partition that holds it.
    before = Window.partitionBy(*own).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    numbered = fixed.withColumn("__inside", F.row_number().over(inside)).join(offsets, same, "left")
    return numbered.withColumn(out, F.col("__inside") + F.col("__offset")).drop("__part", "__p", "__inside", "__offset", *[f"__k{i}" for i in range(len(keys))])


def blocks(df: DataFrame, keys: list[str], order: list, size: int, out: str = "block") -> DataFrame:
    """WIN11: the number, from 0, of the block of ``size`` rows in order."""
    return sequence_number(df, keys, order, "__number").withColumn(out, F.floor((F.col("__number") - 1) / size)).drop("__number")


def padded(df: DataFrame, order: list, multiple: int) -> DataFrame:
    """WIN12: the rows with the first ones again, flagged ``padding``, so that their number is a multiple; none for none."""
    numbered = Workspace(df.sparkSession, "padded").save(sequence_number(df, [], order, "__number"), "rows")
    n = numbered.count()
    lacking = -n % multiple
    rows = numbered.withColumn("padding", F.lit(False))
    while lacking > 0 and n:
        rows = rows.unionByName(numbered.filter(F.col("__number") <= lacking).withColumn("padding", F.lit(True)))
        lacking -= n
    return rows.drop("__number")
