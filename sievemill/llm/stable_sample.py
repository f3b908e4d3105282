"""Problem 2: a sample that is the same in every run and only grows with the data.

A record's stable key is hashed with a fixed salt to the unit interval and kept below the rate. The
decision looks at the record alone, so partitioning, order and later batches cannot change it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.normal import blank_to_null, normal_group_key, normal_split, trimmed

RATE = 0.05
SALT = "group-sample-1"


def drawn(rows: DataFrame, salt: Column | int | str, key: list[Column | str], rate: float) -> DataFrame:
    """``rows`` with score (the hash of salt and key), unit (it in [0, 1)) and chosen (whether unit lies below the rate; False for a NULL key)."""
    scored = rows.withColumn("score", hashing.stable_score(salt, *key)).withColumn("unit", hashing.unit_interval(F.col("score")))
    return scored.withColumn("chosen", F.coalesce(F.col("unit") < F.lit(float(rate)), F.lit(False)))


def sample(manifest: DataFrame, up_to_batch: int | None = None, rate: float = RATE, salt: str = SALT) -> DataFrame:
    """(sample_id, group, unit) of the groups in the sample, once per sample and group.

    Records without a group key have no stable key of their document, so their sample_id is the key.
    A sample delivered under two groups is in if one of them is; later batches add and never remove.
    A NULL batch_no belongs to no batch and is left out when ``up_to_batch`` is given.
    """
    rows = manifest if up_to_batch is None else manifest.filter(F.col("batch_no") <= up_to_batch)
    rows = rows.select("sample_id", F.coalesce(normal_group_key(), F.concat(F.lit("sample:"), "sample_id")).alias("group"))
    return drawn(rows, salt, ["group"], rate).filter("chosen").select("sample_id", "group", "unit").distinct()


def wrong_scores(manifest: DataFrame) -> DataFrame:
    """(sample_id, batch_no) of records with a normal split whose delivered score isn't the one that the draw gives them.

    The draw is repeated over the delivered records, salted with their own seed, by label and group, at rate 1: each record
    with a whole key is in it with its score. A missing score is wrong; so is any score of a record whose seed or
    group key is missing, since no draw can have produced it. Exact copies count once.
    """
    label = F.when(normal_split().isNull(), F.lit(None).cast("string")).when(F.col("replacement_meta").isNotNull(), "train-replacement").otherwise(normal_split())
    rows = manifest.select("sample_id", "batch_no", "selection_seed", label.alias("label"), normal_group_key().alias("group"), blank_to_null(F.lower(trimmed("selection_score"))).alias("delivered"))
    again = drawn(rows.filter("label IS NOT NULL"), F.col("selection_seed"), ["label", "group"], 1.0)
    return again.filter(~(F.col("chosen") & F.col("delivered").eqNullSafe(F.col("score")))).select("sample_id", "batch_no").distinct()
