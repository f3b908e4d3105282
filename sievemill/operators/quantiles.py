"""Exact quantiles that no task holds a key's values for (AGG16, AGG17, AGG20)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequence import sequence_number


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """(keys, one column for each of ``wanted``): quantiles of the non-NULL values by linear interpolation; keys without values are missing.

    Values are numbered over range partitions; of each key only the rows at the wanted places go on.
    """
    own = {k: f"__own{i}" for i, k in enumerate(keys)}  # names that numbering does not use
    rows = df.filter(F.col(value).isNotNull()).select(*[F.col(k).alias(a) for k, a in own.items()], F.col(value).cast("double").alias("__v"))
    numbered = sequence_number(rows, list(own.values()), [F.col("__v")], "__n")
    sizes = numbered.groupBy(*own.values()).agg(F.max("__n").alias("__size"))
    sizes = sizes.select(*[F.col(a).alias(f"{a}s") for a in own.values()], "__size")
    same = F.lit(True)
    for a in own.values():
        same &= F.col(a).eqNullSafe(F.col(f"{a}s"))
    placed = numbered.join(F.broadcast(sizes) if not keys else sizes, same)  # without keys one row
    parts = []
    for name, q in wanted.items():
        at = F.lit(float(q)) * (F.col("__size") - 1) + 1
        # The weight of the row at or next to the place.
        weight = F.greatest(F.lit(0.0), 1 - F.abs(F.col("__n") - at))
        parts.append((name, weight))
    used = F.lit(False)
    for _, weight in parts:
        used |= weight > 0
    sums = placed.filter(used).groupBy(*own.values()).agg(*[F.sum(F.when(weight > 0, weight * F.col("__v"))).alias(name) for name, weight in parts])
    return sums.select(*[F.col(a).alias(k) for k, a in own.items()], *wanted)


def with_quantiles(out: DataFrame, df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], places: int) -> DataFrame:
    """``out`` (one row for each of the keys) with the quantiles of ``value`` in ``df``, rounded."""
    found = quantiles(df, keys, value, wanted)
    found = found.select(*[F.col(k).alias(f"__q{i}") for i, k in enumerate(keys)], *[F.round(F.col(n), places).alias(n) for n in wanted])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__q{i}"))
    return out.join(found, same, "left").drop(*[f"__q{i}" for i in range(len(keys))])
