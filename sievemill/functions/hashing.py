"""Stable hashes: the same digest in every run, partitioning and system."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separates the parts of a hashed key (unit separator).
SEPARATOR = "\x1f"


def stable_score(seed: Column | int | str, *parts: Column | str) -> Column:
    """SHA-256 hex of seed and parts joined by the unit separator; NULL if any of them is NULL."""
    first = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    rest = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = first
    for part in rest:
        text = F.concat(text, F.lit(SEPARATOR), part.cast("string"))
    return F.sha2(text, 256)


def unit_interval(digest: Column) -> Column:
    """The first 52 bits of a hex digest as an exact double in [0, 1)."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def stable_unit(salt: int | str, *parts: Column | str) -> Column:
    return unit_interval(stable_score(salt, *parts))
