"""Building disjoint splits in hash order (SMP01-04, AGG02, AGG03, AGG04, JOI07-09, SET05, JOI12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import stable_score, unit_interval
from ..functions.normal import hash_long, hash_value, normal_flag, normal_group_key
from ..session import Workspace
from . import conflicts
from .ranking import hash_order_sum
from .sequence import sequence_number

COLUMNS = ["group_key", "pixel", "dhash", "flag", "source_key", "source_row_id", "sample_id"]


def candidates(manifest: DataFrame) -> DataFrame:
    """The manifest's distinct records with the fields that selection looks at, in normal form; rows without a group are left out."""
    return manifest.select(
        normal_group_key().alias("group_key"),
        F.unhex(hash_value("pixel_sha256", 64)).alias("pixel"),
        hash_long(hash_value("dhash", 16)).alias("dhash"),
        F.coalesce(normal_flag("use_tool"), F.lit(False)).alias("flag"),
        "source_key",
        "source_row_id",
        "sample_id",
    ).filter("group_key IS NOT NULL").distinct()


def representatives(rows: DataFrame, seed: int) -> DataFrame:
    """AGG03: of each source and group the row with the smallest score; ties by row content, so the choice is total."""
    score = stable_score(seed, F.col("source_key"), F.col("group_key"), F.col("source_row_id").cast("string"))
    whole = F.struct(*[c for c in COLUMNS if c not in ("source_key", "group_key")])
    return rows.withColumn("score", F.coalesce(score, F.lit("~"))).groupBy("source_key", "group_key").agg(F.min(F.struct("score", whole.alias("row"))).alias("m")).select("source_key", "group_key", "m.row.*").select(COLUMNS)


class Occupied:
    """What earlier splits hold: their groups, picture hashes and near hashes are out of bounds."""

    def __init__(self, work: Workspace):
        self.work, self.rows, self.steps = work, None, 0

    def add(self, rows: DataFrame) -> None:
        own = rows.select("group_key", "pixel", "dhash")
        self.rows = own if self.rows is None else self.rows.unionByName(own)

    def reasons(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the first reason against each, in the order group, exact, near; NULL if none."""
        if self.rows is None:
            return rows.withColumn("reason", F.lit(None).cast("string"))
        groups = self.rows.select("group_key", F.lit(True).alias("g")).distinct()
        pixels = self.rows.filter("pixel IS NOT NULL").select("pixel", F.lit(True).alias("p")).distinct()
        hashes = self.rows.filter("dhash IS NOT NULL").select("dhash").distinct()
        mine = rows.filter("dhash IS NOT NULL").select("dhash").distinct()
        links = conflicts.near_links(conflicts.placed_in_cells(mine), conflicts.placed_in_cells(hashes))
        near = links.filter("old").select(F.col("a").alias("dhash"), F.lit(True).alias("n")).distinct()
        reason = F.when(F.col("g"), "group_overlap").when(F.col("p"), "exact_duplicate_image").when(F.col("n"), "near_duplicate_image")
        return rows.join(groups, "group_key", "left").join(pixels, "pixel", "left").join(near, "dhash", "left").withColumn("reason", reason).drop("g", "p", "n")


def _kept(rows: DataFrame, work: Workspace, name: str) -> DataFrame:
    return work.save(conflicts.keep_first(rows, rows.count(), work, name), f"kept-{name}")


def _ranked(kept: DataFrame, keys: list[str]) -> DataFrame:
    """Add rank by ``key``, which begins with the hash, within ``keys``."""
    return hash_order_sum(kept.withColumn("__unit", unit_interval(F.col("selection_score"))), keys, "__unit", ["key"]).drop("__unit")


def _ordered(rows: DataFrame, seed: int, label: str) -> DataFrame:
    """Rows with selection_score and the unique key that gives the order."""
    score = stable_score(seed, F.lit(label), F.col("group_key"))
    return rows.withColumn("selection_score", score).withColumn("key", F.concat(score, F.lit(" "), "group_key", F.lit(" "), F.coalesce("source_key", F.lit("")))).filter("key IS NOT NULL")


def choose(rows: DataFrame, count: int, seed: int, label: str, occupied: Occupied) -> DataFrame:
    """SMP02: the first ``count`` rows in hash order that conflict with nothing occupied or chosen before; an error if there are fewer.

    Equal to walking the rows one by one: what is kept in order is the lexicographically first set without
    conflicts, and its first rows don't depend on those after them. Rows are ranked over bins of their hash, so no
    task merges a split.
    """
    occupied.steps += 1
    name = f"{label}-{occupied.steps}"
    free = occupied.reasons(_ordered(rows, seed, label)).filter("reason IS NULL").drop("reason")
    kept = _kept(occupied.work.save(free, f"free-{name}"), occupied.work, name)
    chosen = _ranked(kept, []).filter(F.col("rank") <= count).withColumn("split", F.lit(label)).drop("key", "rank")
    chosen = occupied.work.save(chosen, f"chosen-{name}")
    if (n := chosen.count()) != count:
        raise ValueError(f"only {n} of {count} rows for {label}")
    occupied.add(chosen)
    return chosen


def choose_quotas(rows: DataFrame, quotas: dict[bool, int], seed: int, label: str, occupied: Occupied) -> DataFrame:
    """SMP03: as ``choose`` with a quota for each flag; rows of a full stratum are passed over and block nothing.

    A stratum that is full changes what later rows conflict with, so the walk is cut where one fills up: the
    rows before are settled, its later rows are dropped, and the rest is walked again against the settled.
    """
    work, chosen, need = occupied.work, None, dict(quotas)
    left = _ordered(rows, seed, label).filter(F.col("flag").isin(list(quotas)))
    while any(need.values()):
        occupied.steps += 1
        name = f"{label}-{occupied.steps}"
        left = left.filter(F.col("flag").isin([f for f, n in need.items() if n]))
        free = work.save(occupied.reasons(left).filter("reason IS NULL").drop("reason"), f"free-{name}")
        kept = _kept(free, work, name)
        ends = {}
        open_ = {flag: n for flag, n in need.items() if n}
        within = F.lit(False)
        for flag, n in open_.items():
            within |= (F.col("flag") == flag) & (F.col("rank") <= n)
        found = {r["flag"]: r for r in _ranked(kept, ["flag"]).filter(within).groupBy("flag").agg(F.count("*").alias("n"), F.max("key").alias("key")).collect()}
        for flag, n in open_.items():
            have = found[flag]["n"] if flag in found else 0
            if have < n:
                raise ValueError(f"only {quotas[flag] - n + have} of {quotas[flag]} rows for {label}, flag {flag}")
            ends[flag] = found[flag]["key"]
        end = min(ends.values())
        part = work.save(kept.filter(F.col("key") <= end).withColumn("split", F.lit(label)), f"chosen-{name}")
        for r in part.groupBy("flag").count().collect():
            need[r["flag"]] -= r["count"]
        occupied.add(part)
        chosen = part if chosen is None else chosen.unionByName(part)
        left = free.filter(F.col("key") > end)
    if chosen is None:
        return _ordered(rows, seed, label).withColumn("split", F.lit(label)).drop("key").limit(0)
    return chosen.drop("key")


def splits(manifest: DataFrame, counts: dict[str, int], seed: int, quotas: dict[bool, int] | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """Test, then val, then train, each against what the earlier ones hold (SET01).

    Test comes from the validation source, the others from the training source; train may have flag quotas.
    ``excluded`` groups (group_key) are for neither val nor train.
    """
    work = Workspace(manifest.sparkSession, "selection")
    occupied = Occupied(work)
    found = work.save(representatives(candidates(manifest), seed), "representatives")
    test = choose(found.filter("source_key = 'smart_val'"), counts["test"], seed, "test", occupied)
    source = found.filter("source_key = 'smart_train'")
    if excluded is not None:
        source = source.join(excluded.select("group_key"), "group_key", "left_anti")
    val = choose(source, counts["val"], seed, "val", occupied)
    train = choose_quotas(source, quotas, seed, "train", occupied) if quotas else choose(source, counts["train"], seed, "train", occupied)
    return test.unionByName(val).unionByName(train)


def replacements(manifest: DataFrame, invalid: DataFrame, seed: int, label: str = "train-replacement", rank_seed: int | None = None) -> DataFrame:
    """SMP04, JOI12: for each invalid sample (sample_id, flag) a fresh row of its flag, everything known being out of bounds, the invalid samples too.

    Old and new are paired by position: old ones by sample_id, new ones in hash order. Columns old_sample_id, sample_id, flag, selection_score.
    An error tells of a flag with fewer fresh rows than invalid samples.
    """
    work = Workspace(manifest.sparkSession, "replacement")
    rows = candidates(manifest)
    gone = work.save(invalid.select("sample_id", "flag").distinct(), "invalid")
    quotas = {r["flag"]: r["count"] for r in gone.groupBy("flag").count().collect()}
    occupied = Occupied(work)
    known = manifest.filter("batch_no = 0").select("sample_id").union(gone.select("sample_id")).distinct()
    history = rows.join(known, "sample_id", "left_semi")
    occupied.add(work.save(history.select("group_key", "pixel", "dhash").distinct(), "history"))
    fresh = representatives(rows.filter("source_key = 'smart_train'"), seed if rank_seed is None else rank_seed)
    new = choose_quotas(fresh, quotas, seed, label, occupied)
    old = sequence_number(gone, ["flag"], [F.col("sample_id")], "n").withColumnRenamed("sample_id", "old_sample_id")
    new = sequence_number(new, ["flag"], [F.col("selection_score")], "n")
    return old.join(new, ["flag", "n"]).select("old_sample_id", "sample_id", "flag", "selection_score")


def audit(rows: DataFrame) -> DataFrame:
    """AGG04, JOI09: (check, violations) over chosen rows: repeated groups, equal pictures, near pictures."""
    repeated = lambda c: rows.filter(F.col(c).isNotNull()).groupBy(c).count().filter("count > 1").agg(F.count("*").alias("violations"))
    hashes = rows.filter("dhash IS NOT NULL").groupBy("dhash").count()
    near = conflicts.near_links(conflicts.placed_in_cells(hashes.select("dhash"))).agg(F.count("*").alias("violations"))
    parts = [("group", repeated("group_key")), ("pixel", repeated("pixel")), ("dhash", repeated("dhash")), ("near", near)]
    out = None
    for name, part in parts:
        one = part.select(F.lit(name).alias("check"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def exclusive(flag: Column) -> Column:
    """FLT02: a flag that is true, 1 or ``true`` in any case; False for everything else."""
    return F.coalesce(F.lower(flag.cast("string")).isin("true", "1"), F.lit(False))
