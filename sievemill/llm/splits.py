"""Problem 4: splits that keep all related records together.

Groups that share a sample_id form a component, so no sample is in two splits. Components of the same size and the
same label profile, the shares of the splits they were delivered in by tenths, form a bundle. Records flow from the
profiles to the splits at least cost: the part of the records that a move takes out of the split they were
delivered in, and a larger cost for each record by which a split deviates from its quota. The flow is then
rounded to whole components, bundle by bundle, largest first, and the members of a bundle are assigned in the order of
their hash.

Sizes above 127 count as equal if their first seven binary digits are, so there are at most 64 for each doubling,
and a few hundred profiles at most: the bundles fit the driver whatever the table. Components and groups never
leave the executors.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.normal import normal_group_key, normal_split
from ..operators.ranking import hash_order_sum
from ..session import Workspace

SHARES = {"train": 0.80, "val": 0.08, "test": 0.12}
SALT = "group-split-1"
MOVE, DEVIATE = 1, 3
#: Rows of a table (bundles, or groups of components with several) that are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1 << 18


def records(manifest: DataFrame) -> DataFrame:
    """(group_key, keyed, sample_id, batch_no, delivered), each once.

    Records without any key (``keyed`` is false) are grouped by their sample_id, under a name with a blank, which no normal key has.
    """
    own = normal_group_key()
    key = F.coalesce(own, F.concat(F.lit("sample: "), F.coalesce("sample_id", F.lit(""))))
    return manifest.select(key.alias("group_key"), own.isNotNull().alias("keyed"), "sample_id", "batch_no", normal_split().alias("delivered")).distinct()


def groups(rows: DataFrame, splits: list[str]) -> DataFrame:
    """(group_key, keyed, size, labelled, n_splits, n_0, n_1 ...) of each group: records, those with a split, the number of those, and records by split.

    A record is one (sample_id, batch_no); its copies count once, but one with two splits or keys, which is dirt, counts in
    each of its groups once per split. Counting is partial before the shuffle, so a hot group is no hot task.
    """
    by_split = [F.count(F.when(F.col("delivered") == s, 1)).alias(f"n_{i}") for i, s in enumerate(splits)]
    return rows.groupBy("group_key", "keyed").agg(F.count("*").alias("size"), F.count("delivered").alias("labelled"), F.size(F.collect_set("delivered")).alias("n_splits"), *by_split)


def shared_samples(rows: DataFrame) -> DataFrame:
    """(a, b): a group and the smallest other group that one of its samples was delivered under. A missing or blank sample_id joins nothing."""
    pairs = rows.filter(F.trim("sample_id") != "").select("sample_id", "group_key")
    several = pairs.groupBy("sample_id").agg(F.min("group_key").alias("b"), F.max("group_key").alias("most")).filter("b < most").select("sample_id", "b")
    return pairs.join(several, "sample_id").filter(F.col("group_key") > F.col("b")).select(F.col("group_key").alias("a"), "b").distinct()


def components(edges: DataFrame, work: Workspace) -> DataFrame | None:
    """(group_key, component) of every group of ``edges`` (a, b); None without edges. The component is the smallest group of it.

    Larger neighbours, then smaller ones, are linked to the smallest one around until nothing changes; each step halves
    the way to it. Steps are written tables.
    """
    before, step = None, 0
    while True:
        n = Observation()
        edges = work.save(edges.observe(n, F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")), f"edges-{step}")
        now = (n.get["n"], n.get["x"])
        if not now[0]:
            return None
        if now == before:
            return edges.select(F.col("a").alias("group_key"), F.col("b").alias("component"))
        before, step = now, step + 1
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        pair = lambda c: F.struct(F.col(c).alias("a"), F.col("m").alias("b"))
        edges = large.join(smallest, "a").select(F.inline(F.array(pair("a"), pair("b")))).filter("a <> b").distinct()


def size_class(size: Column) -> Column:
    """The size with all binary digits but the first seven 0."""
    digits = F.greatest(F.lit(0), F.length(F.bin(size)) - 7)
    return F.when(size < 128, size).otherwise(F.floor(size / F.pow(F.lit(2), digits)).cast("bigint") * F.pow(F.lit(2), digits).cast("bigint"))


def move_cost(profile: str, splits: list[str]) -> dict[str, float]:
    """Cost of a record of the profile to each split: the part of its records delivered in another one."""
    tenths = [int(t) for t in profile.split(".")]
    return {s: MOVE * (sum(tenths) - tenths[i]) / 10 for i, s in enumerate(splits)}


def cheapest_flow(supply: dict[str, int], quota: dict[str, float], deviate: int = DEVIATE) -> dict[tuple[str, str], float]:
    """Records of each label profile to each split, at least cost; successive shortest paths.

    Nodes are the profiles, the splits and a pool for what exceeds a quota. Since every profile reaches every
    split, a path is: profile, split, then perhaps back over a flow already sent and on to another split.
    """
    splits = list(quota)
    cost = {(p, s): c for p in supply for s, c in move_cost(p, splits).items()}
    flow: dict[tuple[str, str], float] = defaultdict(float)
    used = dict.fromkeys(splits, 0.0)
    for p in sorted(supply):
        left = float(supply[p])
        while left > 1e-9:
            # Bellman-Ford from p over the splits; an arc s -> t moves some profile's flow from s to t.
            dist = {s: (cost[p, s], [s], []) for s in splits}
            for _ in splits:
                for s in splits:
                    for t in splits:
                        for o in supply:
                            if s != t and flow[o, s] > 1e-9 and dist[s][0] + cost[o, t] - cost[o, s] < dist[t][0] - 1e-9:
                                dist[t] = (dist[s][0] + cost[o, t] - cost[o, s], [*dist[s][1], t], [*dist[s][2], (o, s, t)])
            ends = {s: dist[s][0] + (0 if quota[s] - used[s] > 1e-9 else deviate) for s in splits}
            end = min(splits, key=lambda s: (ends[s], splits.index(s)))
            _, path, moved = dist[end]
            room = quota[end] - used[end]
            step = min([left, room if room > 1e-9 else left, *(flow[o, s] for o, s, _ in moved)])
            flow[p, path[0]] += step
            for o, s, t in moved:
                flow[o, s] -= step
                flow[o, t] += step
            used[end] += step
            left -= step
    return {k: v for k, v in flow.items() if v > 1e-9}


def whole_groups(bundles: list[tuple[str, float, int]], flow: dict[tuple[str, str], float], quota: dict[str, float]) -> dict[tuple[str, float], dict[str, int]]:
    """Components of each bundle (profile, size, number) to each split.

    Largest sizes first. What rounding owes a split is carried on to the next bundle of the profile, and
    across profiles, so the smallest components settle the rest.
    """
    splits = list(quota)
    wanted = {(p, s): flow.get((p, s), 0.0) for p, _, _ in bundles for s in splits}
    room = {s: sum(v for (_, t), v in flow.items() if t == s) for s in splits}
    out: dict[tuple[str, float], dict[str, int]] = {}
    rest = defaultdict(float)
    for p, size, n in bundles:
        rest[p] += size * n
    for p, size, n in sorted(bundles, key=lambda b: (-b[1], b[0])):
        # The bundle's part of what its profile still has to send to each split.
        part = {s: wanted[p, s] * size * n / rest[p] / size if rest[p] else 0.0 for s in splits}
        take = {s: min(n, int(part[s] + 1e-9)) for s in splits}
        for _ in range(n - sum(take.values())):
            # Where one more group leaves the least excess: first over the split, then over the profile's share.
            best = max(splits, key=lambda s: (min(0.0, room[s] - size * (take[s] + 1)), part[s] - take[s], quota[s]))
            take[best] += 1
        for s in splits:
            wanted[p, s] -= size * take[s]
            room[s] -= size * take[s]
        short = sum(min(0.0, wanted[p, s]) for s in splits)  # what one split got too much, the others get less
        positive = sum(max(0.0, wanted[p, s]) for s in splits)
        for s in splits:
            wanted[p, s] = max(0.0, wanted[p, s]) * (1 + short / positive if positive else 0.0)
        rest[p] -= size * n
        out[p, size] = take
    return out


class GroupSplits:
    """Splits over one manifest."""

    def __init__(self, manifest: DataFrame, shares: dict[str, float] | None = None, salt: str = SALT):
        self.shares = shares or SHARES
        self.salt = salt
        self.work = work = Workspace(manifest.sparkSession, "splits")
        rows = work.save(records(manifest), "records")
        self.counts = [f"n_{i}" for i in range(len(self.shares))]
        own = groups(rows, list(self.shares))
        joined = components(shared_samples(rows), work)
        if joined is None:
            own = own.withColumn("component", F.col("group_key"))
        else:
            own = own.join(F.broadcast(joined) if joined.count() <= BROADCAST_ROWS else joined, "group_key", "left").withColumn("component", F.coalesce("component", "group_key"))
        self.groups = work.save(own, "groups")
        whole = self.groups
        if joined is not None:
            whole = whole.groupBy("component").agg(*[F.sum(c).alias(c) for c in ("size", *self.counts)])
        tenths = [F.round(F.col(c) * 10 / F.col("size")).cast("int") for c in self.counts]
        whole = whole.select("component", "size", F.concat_ws(".", *tenths).alias("profile"), size_class(F.col("size")).alias("class"), hashing.stable_unit(salt, "component").alias("unit"))
        #: (component, size, profile, class, unit): the bundles are those of equal profile and class.
        self.components = work.save(whole, "components")

    def cuts(self) -> list[tuple[str, int, list[int]]]:
        """(profile, class, ranks up to which the bundle's members go to each split), from the flow."""
        rows = self.components.groupBy("profile", "class").agg(F.count("*").alias("n"), F.sum("size").alias("records")).collect()
        supply: dict[str, int] = defaultdict(int)
        for r in rows:
            supply[r["profile"]] += r["records"]
        quota = {s: sum(supply.values()) * share for s, share in self.shares.items()}
        sizes = {(r["profile"], r["class"]): r["records"] / r["n"] for r in rows}
        taken = whole_groups([(r["profile"], sizes[r["profile"], r["class"]], r["n"]) for r in rows], cheapest_flow(supply, quota), quota)
        out = []
        for (profile, c), size in sizes.items():
            ends, upto = [], 0
            for n in taken[profile, size].values():
                upto += n
                ends.append(upto)
            out.append((profile, c, ends))
        return out

    def assigned(self) -> DataFrame:
        """(group_key, split, size, component, keyed, n_splits, moved, unavoidable) of each group; empty for an empty manifest.

        moved: records delivered in another split than the group's; unavoidable: how many would be in any split.
        """
        spark = self.groups.sparkSession
        cuts = self.cuts()
        spans = spark.createDataFrame(cuts, "profile string, class bigint, ends array<bigint>")
        ranked = hash_order_sum(self.components, ["profile", "class"], "unit", ["component"])
        ranked = ranked.join(F.broadcast(spans) if len(cuts) <= BROADCAST_ROWS else spans, ["profile", "class"])
        # A split's place is the number of ends that lie below the rank.
        place = F.size(F.filter("ends", lambda e: e < F.col("rank")))
        names = F.array(*[F.lit(s) for s in self.shares])
        kept = F.get(F.array(*self.counts), F.col("place"))
        out = self.groups.join(ranked.select("component", place.alias("place")), "component").withColumn("split", F.get(names, F.col("place")))
        most = F.greatest(*self.counts) if len(self.counts) > 1 else F.col(self.counts[0])
        return out.select("group_key", "split", "size", "component", "keyed", "n_splits", (F.col("labelled") - kept).alias("moved"), F.when(F.col("n_splits") > 1, F.col("labelled") - most).otherwise(0).alias("unavoidable"))

    def disagreeing(self) -> DataFrame:
        """(group_key) of the groups of which records have to leave the split they were delivered in, wherever the flow sends them: those of more than one normal split."""
        return self.assigned().filter("keyed AND unavoidable > 0").select("group_key")
