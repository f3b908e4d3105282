"""Deterministic samplers (SMP05-09, SMP11-14, AGG31, WIN05-07, WIN13).

Ranks come from salted hashes, so a draw is the same in every run and partitioning. Draws that a sequential
generator made are reproduced in contract (sizes, strata, uniqueness), not draw by draw, except the quotas
and seeds that the driver computes.
"""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import unit_interval
from ..session import Workspace
from .ranking import hash_order_sum


def name_seed(seed: int | str, name: str) -> int:
    """SMP13: the first eight bytes of a digest of seed and name."""
    return int.from_bytes(hashlib.sha256(f"{seed}:{name}".encode()).digest()[:8], "big")


def balanced_quotas(total: int, names: list[str], seed: int) -> dict[str, int]:
    """SMP05: equal quotas; the remainder goes to the first of the sorted names, shuffled."""
    order = sorted(names)
    random.Random(seed).shuffle(order)
    return {n: total // len(names) + (i < total % len(names)) for i, n in enumerate(order)}


def rank_digest(key: Column | str, seed: int | str) -> Column:
    """WIN05: the digest by which samples are ranked."""
    key = F.col(key) if isinstance(key, str) else key
    return F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)


def ranked(df: DataFrame, keys: list[str], id_column: str, seed: int | str) -> DataFrame:
    """WIN05: add digest and rank (1 first) by it within ``keys``. Rows without an id are left out."""
    rows = df.filter(F.col(id_column).isNotNull()).withColumn("digest", rank_digest(id_column, seed)).withColumn("__unit", unit_interval(F.col("digest")))
    return hash_order_sum(rows, keys, "__unit", ["digest"]).drop("__unit")


def first_ranks(df: DataFrame, n: int, *ties: str) -> DataFrame:
    """The first ``n`` rows by ``digest``, found by ranks over bins of it: nothing is merged in one task, however large ``n``."""
    placed = hash_order_sum(df.withColumn("__unit", unit_interval(F.col("digest"))), [], "__unit", ["digest", *ties], out="__rank")
    return placed.filter(F.col("__rank") <= n).drop("__unit", "__rank")


def largest_remainder(counts: DataFrame, keys: list[str], total: int) -> DataFrame:
    """AGG31, WIN06: (keys, n, quota): the share of ``total``, rounded down, and one more for the largest remainders, ties by key.

    ``counts`` (keys, n) has one row a stratum, a small table.
    """
    everything = Window.partitionBy()
    exact = F.lit(total) * F.col("n")
    sums = counts.withColumn("all", F.sum("n").over(everything))
    parts = sums.withColumn("whole", F.floor(exact / F.col("all"))).withColumn("rest", F.pmod(exact, F.col("all")))
    left = parts.withColumn("left", F.lit(total) - F.sum("whole").over(everything)).withColumn("place", F.row_number().over(everything.orderBy(F.desc("rest"), *keys)))
    return left.select(*keys, "n", (F.col("whole") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).alias("quota"))


def proportional(df: DataFrame, keys: list[str], id_column: str, total: int, seed: int | str) -> DataFrame:
    """SMP11, WIN07: ``total`` rows in the strata's proportions, each stratum's first by rank."""
    rows = Workspace(df.sparkSession, "proportional").save(df.filter(F.col(id_column).isNotNull()), "rows")
    quota = largest_remainder(rows.groupBy(*keys).agg(F.count("*").alias("n")), keys, total)
    quota = F.broadcast(quota.select(*[F.col(k).alias(f"__{k}") for k in keys], "quota"))  # one row a stratum
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return ranked(rows, keys, id_column, seed).join(quota, same).filter(F.col("rank") <= F.col("quota")).drop("quota", *[f"__{k}" for k in keys])


def unique_images(df: DataFrame, image: str, id_column: str, n: int, seed: int | str, forbidden: DataFrame | None = None) -> DataFrame:
    """SMP06, SMP10: ``n`` rows in hash order, one a picture, none of the forbidden pictures."""
    rows = df.filter(F.col(image).isNotNull() & F.col(id_column).isNotNull())
    if forbidden is not None:
        rows = rows.join(forbidden.select(image).distinct(), image, "left_anti")
    digest = rank_digest(id_column, seed)
    first = rows.withColumn("digest", digest).groupBy(image).agg(F.min(F.struct("digest", id_column)).alias("m"))
    return first_ranks(first.select(image, f"m.{id_column}", "m.digest"), n)


def scarcest_first(df: DataFrame, stratum: str, image: str, id_column: str, quotas: dict[str, int], seed: int | str) -> DataFrame:
    """SMP07: quotas of unique pictures by stratum, the stratum with the fewest rows first, pictures used once over all."""
    work = Workspace(df.sparkSession, "scarcest")
    rows = work.save(df.filter(F.col(stratum).isin(list(quotas))), "rows")
    have = {r[stratum]: r["n"] for r in rows.groupBy(stratum).agg(F.count("*").alias("n")).collect()}
    out = None
    for name in sorted(quotas, key=lambda s: (have.get(s, 0), s)):
        part = unique_images(rows.filter(F.col(stratum) == name), image, id_column, quotas[name], f"{seed}:{name}", out)
        part = work.save(part.withColumn(stratum, F.lit(name)), f"part-{len(name)}-{hashlib.sha256(name.encode()).hexdigest()[:8]}")
        out = part if out is None else out.unionByName(part)
    return out


def yes_no_pairs(df: DataFrame, keys: list[str], image: str, answer: Column, id_column: str, n: int, seed: int | str) -> DataFrame:
    """SMP08: for each of ``keys`` ``n`` pictures that have a yes and a no question, with one of each by rank."""
    digest = rank_digest(id_column, seed)
    pick = lambda a: F.min(F.when(F.col("__a") == a, F.struct("digest", id_column)))
    rows = df.withColumn("__a", answer).withColumn("digest", digest).filter(F.col(image).isNotNull() & F.col("digest").isNotNull())
    pairs = rows.groupBy(*keys, image).agg(pick("yes").alias("yes"), pick("no").alias("no")).filter("yes IS NOT NULL AND no IS NOT NULL")
    pairs = pairs.select(*keys, image, F.col(f"yes.{id_column}").alias("yes_id"), F.col(f"no.{id_column}").alias("no_id")).withColumn("__image", F.col(image).cast("string"))
    return ranked(pairs, keys, "__image", seed).filter(F.col("rank") <= n).drop("__image", "digest")


def first_come(rows: DataFrame, unique: list[str], n: int, work: Workspace, name: str) -> DataFrame:
    """The first ``n`` rows in the order of ``digest`` of which no two share a value of a ``unique`` column, as a walk finds them.

    In each round the rows that come first for all of their values are kept and exclude the others with one of
    them. No later round adds a row before the first undecided one, so it ends once ``n`` kept ones lie before.
    """
    order = F.struct("digest", *unique)
    undecided = work.save(rows.select("digest", *unique).distinct().withColumn("place", order), f"{name}-0")
    kept, step = undecided.limit(0), 0
    while (first := undecided.agg(F.min("place").alias("p")).head()["p"]) is not None:
        step += 1
        seen = undecided
        for c in unique:
            seen = seen.join(undecided.groupBy(c).agg(F.min("place").alias(f"__{c}")), c)
        heads = seen
        for c in unique:
            heads = heads.filter(F.col("place") == F.col(f"__{c}"))
        heads = work.save(heads.select(undecided.columns), f"{name}-heads-{step}")
        kept = kept.unionByName(heads)
        left = undecided
        for c in unique:
            left = left.join(heads.select(c), c, "left_anti")
        undecided = work.save(left.select(undecided.columns), f"{name}-{step}")
        # n is the size of a sample.
        ends = kept.orderBy("place").limit(n).agg(F.count("*").alias("n"), F.max("place.digest").alias("d")).head()
        first = undecided.agg(F.min("digest").alias("d")).head()["d"]
        if ends["n"] == n and (first is None or ends["d"] < first):
            break
    return kept.orderBy("place").limit(n).drop("place")


def distinct_versions(df: DataFrame, version: str, problem: str, id_column: str, versions: list[str], n: int, seed: int | str, image: str | None = None, forbidden: DataFrame | None = None) -> DataFrame:
    """SMP09: ``n`` rows of each version, no problem, id or picture (``image``) used twice over all of them; versions in the order given.

    None of the ``forbidden`` pictures is chosen. Rows without one of these values are left out. A version with
    fewer than ``n`` such rows is an error.
    """
    work = Workspace(df.sparkSession, "versions")
    unique = list(dict.fromkeys([problem, id_column, *([image] if image else [])]))
    rows = df.filter(F.col(version).isin(versions))
    for c in unique:
        rows = rows.filter(F.col(c).isNotNull())
    if forbidden is not None:
        rows = rows.join(forbidden.select(image).distinct(), image, "left_anti")
    rows = work.save(rows.select(version, *unique), "rows")
    out = None
    for i, name in enumerate(versions):
        free = rows.filter(F.col(version) == name).withColumn("digest", rank_digest(id_column, f"{seed}:{name}"))
        for c in unique if out is not None else []:
            free = free.join(out.select(c), c, "left_anti")
        part = work.save(first_come(free, unique, n, work, f"walk-{i}").withColumn(version, F.lit(name)), f"part-{i}")
        if (have := part.count()) != n:
            raise ValueError(f"only {have} of {n} rows for {name}")
        out = part if out is None else out.unionByName(part)
    return out


def round_robin(df: DataFrame, stratum: str, id_column: str, seed: int | str, shortest: bool = True) -> DataFrame:
    """WIN13, SMP14: strata take turns: (stratum, id, turn); with ``shortest`` no further than the smallest stratum goes."""
    rows = Workspace(df.sparkSession, "robin").save(df.filter(F.col(stratum).isNotNull()), "rows")
    turns = ranked(rows, [stratum], id_column, seed).select(stratum, id_column, F.col("rank").alias("turn"))
    if not shortest:
        return turns
    least = rows.filter(F.col(id_column).isNotNull()).groupBy(stratum).agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
    return turns.join(F.broadcast(least), F.col("turn") <= F.col("least")).drop("least")  # one row
