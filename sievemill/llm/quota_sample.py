"""Problem 3: a sample in target proportions, with minimum rows and a report of the shortfalls.

Divisor method: record number k (by a fixed hash) of a category with target t has priority (k - 0.5) / t,
minimum rows come before all others, and the S smallest priorities are kept. A category that runs out has
no further priorities, so its seats pass to the others without a rule of their own.

The cut-off follows from the categories' counts alone (one row per plan category, a bounded table), so
no global sort is needed: seats per category are computed from the counts, ranks by ``hash_order_sum``.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hashing
from ..functions.normal import blank_to_null, normal_flag, trimmed
from ..functions.strata import AREA_LIMITS, FAMILY_WORDS, FOLDED, area_bucket, positive_size, question_family
from ..operators.ranking import hash_order_sum
from ..session import Workspace

SALT = "quota-sample-1"
CATEGORY = ["family", "area", "use_tool"]
#: More plan rows than this are refused: the seats are computed in the driver.
MOST_CATEGORIES = 100_000


def eligible(annotations: DataFrame, manifest: DataFrame) -> DataFrame:
    """(sample_id, family, area, use_tool) once per annotated sample that fits a category.

    The flag of a sample delivered more than once is that of its latest batch with a readable one.
    Of annotations that disagree, one usable question and size are taken together (the smallest).
    """
    asked = (
        annotations.filter(F.col("sample_id").isNotNull() & blank_to_null(trimmed("question")).isNotNull() & positive_size("lowres_size"))
        .groupBy("sample_id")
        .agg(F.min(F.struct(question_family("question").alias("family"), area_bucket("lowres_size").alias("area"))).alias("c"))
    )
    flagged = (
        manifest.select("sample_id", "batch_no", normal_flag("use_tool").alias("flag"))
        .filter(F.col("sample_id").isNotNull() & F.col("flag").isNotNull())
        .groupBy("sample_id")
        .agg(F.max(F.struct(F.coalesce("batch_no", F.lit(-1)).alias("batch_no"), "flag")).alias("m"))
    )
    return asked.join(flagged, "sample_id").select("sample_id", "c.family", "c.area", F.col("m.flag").alias("use_tool"))


def seats(counts: list[int], targets: list[int], floors: list[int], total: int) -> list[int]:
    """Records to take of each category: the ``total`` smallest priorities, minimum rows first, ties by position."""
    if total >= sum(counts):
        return list(counts)
    first = [max(0, min(f, n)) for f, n in zip(floors, counts, strict=True)]
    order = range(len(counts))
    if sum(first) >= total:  # not even the minimum rows fit: the smallest priorities among them
        counts, first = first, [0] * len(counts)
    weight = [max(0, t) for t in targets]

    def upto(level: Fraction) -> list[int]:
        return [min(counts[i], max(first[i], math.floor(level * weight[i] + Fraction(1, 2)))) for i in order]

    low, high = Fraction(0), Fraction(1)
    reach = sum(n for n, t in zip(counts, weight, strict=True) if t) + sum(f for f, t in zip(first, weight, strict=True) if not t)
    aim = min(total, reach)
    while sum(upto(high)) < aim:
        high *= 2
    for _ in range(64):  # then fewer priorities lie between the two than there are categories
        mid = (low + high) / 2
        if sum(upto(mid)) < aim:
            low = mid
        else:
            high = mid
    taken = upto(low)
    left = total - sum(taken)
    heap = [(Fraction(2 * taken[i] + 1, 2 * weight[i]) if weight[i] else math.inf, i) for i in order if taken[i] < counts[i]]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        if not weight[i]:  # without a target, categories are filled by position
            step = min(left, counts[i] - taken[i])
        else:
            step = 1
        taken[i] += step
        left -= step
        if taken[i] < counts[i]:
            heapq.heappush(heap, (Fraction(2 * taken[i] + 1, 2 * weight[i]) if weight[i] else math.inf, i))
    return taken


class QuotaSample:
    """The draw over one pair of tables. ``size`` defaults to two fifths of the eligible samples, rounded down.

    A category that the plan names twice has the larger of its targets and minimums.
    """

    def __init__(self, annotations: DataFrame, manifest: DataFrame, plan: DataFrame, size: int | None = None, salt: str = SALT):
        spark = annotations.sparkSession
        self.records = Workspace(spark, "quota").save(eligible(annotations, manifest), "eligible")
        self.salt = salt
        have = {tuple(r[c] for c in CATEGORY): r["n"] for r in self.records.groupBy(*CATEGORY).agg(F.count("*").alias("n")).collect()}
        self.size = 2 * sum(have.values()) // 5 if size is None else size
        columns = [F.col("use_tool").cast("boolean").alias("use_tool") if c == "use_tool" else c for c in CATEGORY]
        rows = plan.select(*columns, "target_per_mille", "min_rows").groupBy(*CATEGORY).agg(F.max(F.coalesce("target_per_mille", F.lit(0))).alias("t"), F.max(F.coalesce("min_rows", F.lit(0))).alias("f")).sort(*CATEGORY).limit(MOST_CATEGORIES + 1).collect()
        if len(rows) > MOST_CATEGORIES:
            raise ValueError(f"more than {MOST_CATEGORIES} categories in the plan")
        counts = [have.get(tuple(r[c] for c in CATEGORY), 0) for r in rows]
        got = seats(counts, [r["t"] for r in rows], [r["f"] for r in rows], self.size)
        schema = T.StructType(
            [T.StructField("family", T.StringType()), T.StructField("area", T.StringType()), T.StructField("use_tool", T.BooleanType())]
            + [T.StructField(c, T.LongType()) for c in ("target_per_mille", "min_rows", "eligible", "needed", "taken")]
        )
        table = [(*(r[c] for c in CATEGORY), r["t"], r["f"], n, max(r["f"], -(-self.size * r["t"] // 1000)), k) for r, n, k in zip(rows, counts, got, strict=True)]
        #: One row per plan category: what it has, needs and gives.
        self.report = spark.createDataFrame(table, schema)

    def ranked(self) -> DataFrame:
        """(sample_id, family, area, use_tool, rank, target_per_mille, needed, taken): eligible samples of the plan's categories in the order of their hash."""
        units = self.records.withColumn("unit", hashing.stable_unit(self.salt, "sample_id"))
        ranks = hash_order_sum(units, CATEGORY, "unit", ["sample_id"]).drop("unit")
        return ranks.join(F.broadcast(self.report.select(*CATEGORY, "target_per_mille", "needed", "taken")), CATEGORY)  # at most MOST_CATEGORIES rows

    def chosen(self) -> DataFrame:
        """(sample_id, family, area, use_tool, rank, priority): ranks by hash, up to the category's seats."""
        return self.ranked().filter(F.col("rank") <= F.col("taken")).select("sample_id", *CATEGORY, "rank", F.try_divide(F.col("rank") - F.lit(0.5), F.col("target_per_mille").cast("double")).alias("priority"))

    def short(self) -> DataFrame:
        """(family, area, use_tool as text) of the categories that run out: no sample has the priority of their last needed seat, and the seat passes to others."""
        filled = self.ranked().filter(F.col("rank") == F.col("needed")).select(*CATEGORY)
        wanted = self.report.filter("needed > 0")
        return wanted.join(filled, CATEGORY, "left_anti").select("family", "area", F.col("use_tool").cast("string").alias("use_tool"))
