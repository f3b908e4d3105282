"""Ranks and running sums that no single task has to hold.

``row_number() over (partition by key order by hash)`` puts a whole key into one task. Here the order
value, a hash in [0, 1), is cut into equal bins: the bins' sums give each bin its offset, and a
window runs inside (key, bin) only. A key with a third of all rows is thus spread over all bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096


def hash_order_sum(df: DataFrame, keys: list[str], unit: str, ties: list[str], weight: Column | None = None, out: str = "rank", bins: int = BINS) -> DataFrame:
    """Add ``out``: the sum of ``weight`` (1 if none: the rank) up to and with the row, by ``unit`` and ``ties`` within ``keys``.

    ``unit`` is a double; values outside [0, 1) and NULL go to the outer bins and stay in order there.
    NULL keys form a key of their own. ``df`` is read twice, so hand over a stored table if it is costly.
    """
    weight = F.lit(1).cast("bigint") if weight is None else weight
    bin_of = F.least(F.lit(bins - 1), F.greatest(F.lit(-1), F.floor(F.coalesce(F.col(unit), F.lit(-1.0)) * bins))).cast("int")
    binned = df.withColumn("__bin", bin_of).withColumn("__w", weight)
    own = [F.col(k) for k in keys]
    sums = binned.groupBy(*keys, "__bin").agg(F.sum("__w").alias("__sum"))
    before = Window.partitionBy(*own).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    # At most bins + 1 rows a key, so this window is bounded.
    offsets = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__bin").alias("__b"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    same = F.col("__bin") == F.col("__b")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = Window.partitionBy(*own, "__bin").orderBy(unit, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return (
        binned.withColumn("__inside", F.sum("__w").over(inside))
        .join(offsets, same, "left")
        .withColumn(out, F.col("__inside") + F.col("__offset"))
        .drop("__bin", "__w", "__inside", "__offset", "__b", *[f"__k{i}" for i in range(len(keys))])
    )
