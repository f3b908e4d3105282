"""Constraints on tables, each as a report of what holds (AGG25, FLT15, STR04, SMP15, SRC14, SRC15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shape import under


def group_counts(df: DataFrame, key: str, wanted: dict) -> DataFrame:
    """AGG25: (key, found, wanted, ok) of each key that is there or ``wanted``, as text; a key that isn't wanted should have no rows."""
    spark = df.sparkSession
    text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    plan = spark.createDataFrame([(text(k), n) for k, n in wanted.items()], "key string, wanted bigint")
    have = df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key")).agg(F.count("*").alias("found"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return have.join(plan, "key", "full_outer").select("key", zero("found"), zero("wanted")).withColumn("ok", F.col("found") == F.col("wanted"))


def first_problem(problems: dict[str, Column]) -> Column:
    """FLT15: the name of the first condition that holds; NULL if none does. A NULL condition doesn't hold."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(problems.items()):
        out = F.when(holds, name).otherwise(out)
    return out


def phases(df: DataFrame, phase: str, id_column: str, expected: int) -> DataFrame:
    """STR04: (phase, rows, samples, complete): a phase is complete with exactly ``expected`` rows of as many ids."""
    counted = df.groupBy(F.col(phase).alias("phase")).agg(F.count("*").alias("rows"), F.count_distinct(id_column).alias("samples"))
    return counted.withColumn("complete", (F.col("rows") == expected) & (F.col("samples") == expected))


def plan_report(df: DataFrame, name: str, targets: dict[str, int], unique: list[str]) -> DataFrame:
    """SMP15: (name, target, found, distinct_found, ok) of each planned name: whether as many rows as the target can be unique in every ``unique`` column."""
    plan = df.sparkSession.createDataFrame(list(targets.items()), "name string, target bigint")
    each = df.filter(F.col(name).isin(list(targets))).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("found"), *[F.count_distinct(c).alias(f"u_{i}") for i, c in enumerate(unique)])
    zero = lambda c: F.coalesce(c, F.lit(0))
    least = F.least(*[zero(f"u_{i}") for i in range(len(unique))]) if len(unique) > 1 else zero("u_0")
    return plan.join(each, "name", "left").select("name", "target", zero("found").alias("found"), least.alias("distinct_found"), (least >= F.col("target")).alias("ok"))


def manifest_rules(rows: DataFrame, unique: list[str], path: str, root: str, least: int) -> DataFrame:
    """SRC15: (rule, violations) over a manifest's distinct rows: ids that occur more than once, paths outside of ``root``, rows that are lacking."""
    rows = rows.distinct()
    repeated = rows.groupBy(*unique).agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("violations"))
    outside = rows.filter(~under(F.col(path), root)).agg(F.count("*").alias("violations"))
    lacking = rows.agg(F.greatest(F.lit(0).cast("bigint"), F.lit(least) - F.count("*")).alias("violations"))
    named = [("repeated id", repeated), (f"outside of {root}", outside), (f"fewer than {least} rows", lacking)]
    parts = [df.select(F.lit(name).alias("rule"), "violations") for name, df in named]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def cache_states(wanted: DataFrame, cache: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """SRC14: (key, state) of each wanted request: ``hit`` if the cache has its fingerprint, ``mismatch`` if another one, else ``miss``.

    Misses are to be requested; a mismatch is an error of the caller, as the cached answer belongs to another request.
    """
    have = cache.select(key, F.col(fingerprint).alias("__have"), F.lit(True).alias("__there"))
    same = F.col("__have").eqNullSafe(F.col(fingerprint))
    return wanted.join(have, key, "left").select(key, F.when(F.col("__there").isNull(), "miss").when(same, "hit").otherwise("mismatch").alias("state"))
