"""Problem 7: documents of several sources mixed to target shares of tokens, with capped repeats.

Iterative proportional fitting over cells (source, language, topic): the token weights are raked in turn to
the language and topic shares of the sources' own texts and to the sources' targets, each weight at most
max_repeats, the targets last. A cell's weight is the number of uses of each of its documents: the whole
part for all of them, the fraction as a probability.

The fraction is drawn as a sequential Poisson sample: a document's hash over its probability gives the
order, and a source takes documents in it until its tokens are reached, so its share is met within half a
document. Cells are a bounded table: at most MOST_SOURCES sources of the weights table, the MOST_LANGUAGES
languages with the most tokens and one for the rest, six topics; documents never leave the executors.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.normal import trimmed
from ..functions.strata import question_family
from ..operators.ranking import hash_order_sum
from ..session import Workspace
from . import bpe

SALT = "mixture-1"
ROUNDS = 100
#: More rows than this in the weights table are refused: the raking is done in the driver.
MOST_SOURCES = 10_000
BINS = 1 << 15
#: Change of a weight below which the raking ends.
CLOSE = 1e-9
#: Languages with the most tokens that have cells of their own; the others share one, so the cells stay few.
MOST_LANGUAGES = 500
#: Cells that are broadcast; more are joined by a shuffle.
BROADCAST_CELLS = 1 << 18


def language(column: str = "lang"):
    """The language of a tag such as ``en-GB``: two or three letters, else ``und``."""
    first = F.regexp_extract(F.lower(trimmed(column)), "^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(F.coalesce(first, F.lit("")) == "", "und").otherwise(first)


def sized(documents: DataFrame, path: str = bpe.TOKENIZER) -> DataFrame:
    """(doc_id, source, language, topic, tokens) of every document; a NULL or empty text has 0 tokens."""
    rows = documents.select("doc_id", "source", language().alias("language"), F.coalesce(question_family("text"), F.lit("other")).alias("topic"), "text")
    return bpe.count(rows, path=path).drop("text")


def rake(cells: dict[tuple[str, str, str], int], targets: dict[str, float], caps: dict[str, int], rounds: int = ROUNDS) -> dict[tuple[str, str, str], float]:
    """Weight of each cell (source, language, topic) with its tokens, by iterative proportional fitting.

    Weights lie between 0 and the source's cap. The sources' targets are met exactly where the cap allows,
    else the source is at its cap; languages and topics as near to their natural shares as that leaves them.
    It ends when no weight changes by more than CLOSE, or after ``rounds``.
    """
    if not cells:
        return {}
    names = list(cells)
    tokens = np.array([cells[c] for c in names], float)
    index = [np.unique([c[axis] for c in names], return_inverse=True) for axis in range(3)]
    sources, own = index[0]
    sums = lambda at, values: np.bincount(at, values)
    held = sums(own, tokens)
    cap = np.array([float(caps.get(s, 1)) for s in sources])
    goal = np.minimum([targets.get(s, 0.0) for s in sources], cap * held)
    # What each language and topic would have if the mixture were as the sources' own texts.
    natural = [sums(at, tokens) * goal.sum() / max(tokens.sum(), 1.0) for _, at in index[1:]]
    weight = np.minimum(goal / np.maximum(held, 1.0), cap)[own]
    for _ in range(rounds):
        before = weight
        for (_, at), wanted in zip(index[1:], natural, strict=True):
            now = sums(at, tokens * weight)
            factor = np.divide(wanted, now, out=np.ones_like(now), where=now > 0)
            weight = np.minimum(weight * factor[at], cap[own])
        weight = _filled(weight, tokens, own, goal, cap)
        if np.abs(weight - before).max() <= CLOSE:
            break
    return dict(zip(names, weight.tolist(), strict=True))


def _filled(weight: np.ndarray, tokens: np.ndarray, own: np.ndarray, goal: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """The weights scaled within each source to its goal; what exceeds the cap goes to the source's other cells."""
    free = tokens > 0
    empty = np.bincount(own, weight * free) <= 0
    weight = np.where(free & empty[own] & (goal > 0)[own], 1.0, weight)
    while True:
        fixed, now = np.bincount(own, tokens * weight * ~free, len(goal)), np.bincount(own, tokens * weight * free, len(goal))
        factor = np.divide(np.maximum(goal - fixed, 0.0), now, out=np.ones_like(now), where=now > 0)
        over = free & (weight * factor[own] > cap[own] * (1 + 1e-12))
        if not over.any():
            return np.where(free, np.minimum(weight * factor[own], cap[own]), weight)
        weight = np.where(over, cap[own], weight)
        free = free & ~over


class Mixture:
    """The mixture of one pair of tables. The total is the tokens of all documents, those of other sources included.

    A source that the table names twice has the sum of its shares and the larger of its repeats; a missing
    share is 0, missing repeats are 1. A document without tokens is not used.
    """

    def __init__(self, documents: DataFrame, source_weight: DataFrame, path: str = bpe.TOKENIZER, salt: str = SALT):
        spark = documents.sparkSession
        self.salt = salt
        self.documents = Workspace(spark, "mixture").save(sized(documents, path), "documents")
        plan = source_weight.filter("source IS NOT NULL").groupBy("source").agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("cap"))
        rows = plan.limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources in the weights table")
        self.total = self.documents.agg(F.coalesce(F.sum("tokens"), F.lit(0))).head()[0]
        self.targets = {r["source"]: r["share"] * self.total for r in rows}
        self.shares = {r["source"]: r["share"] for r in rows}
        self.caps = {r["source"]: r["cap"] for r in rows}
        names = F.broadcast(plan.select("source"))  # at most MOST_SOURCES rows
        self.wanted = self.documents.join(names, "source", "left_semi").filter("tokens > 0")
        common = self.wanted.groupBy("language").agg(F.sum("tokens").alias("n")).orderBy(F.desc("n"), "language").limit(MOST_LANGUAGES)
        common = [r["language"] for r in common.collect()]
        self.wanted = self.wanted.withColumn("language", F.when(F.col("language").isin(common), F.col("language")).otherwise("other"))
        cells = {(r["source"], r["language"], r["topic"]): r["n"] for r in self.wanted.groupBy("source", "language", "topic").agg(F.sum("tokens").alias("n")).collect()}
        self.tokens = cells
        self.weights = rake(cells, self.targets, self.caps)
        extra: dict[str, float] = defaultdict(float)
        table = []
        for c, n in cells.items():
            whole = int(self.weights[c] + 1e-9)
            part = max(0.0, self.weights[c] - whole)
            extra[c[0]] += n * part
            table.append((*c, whole, part if part > 1e-9 else 0.0))
        self._few = len(table) <= BROADCAST_CELLS
        self._cells = spark.createDataFrame(table, "source string, language string, topic string, whole int, part double")
        self._extra = spark.createDataFrame([(s, x) for s, x in extra.items()], "source string, wanted double")

    def documents_used(self) -> DataFrame:
        """(doc_id, source, tokens, repeats) of the documents in the mixture."""
        return self._used(["doc_id", "source", "tokens", "repeats"])

    def _used(self, columns: list[str]) -> DataFrame:
        rows = self.wanted.join(F.broadcast(self._cells) if self._few else self._cells, ["source", "language", "topic"])
        fixed = rows.filter("part = 0").withColumn("repeats", F.col("whole"))
        # The order is the hash over the probability; on a scale of octaves no bin holds more than a hundredth of a cell.
        order = F.greatest(hashing.stable_unit(self.salt, F.col("doc_id")), F.lit(2.0**-60)) / F.col("part")
        drawn = rows.filter("part > 0").withColumn("unit", F.lit(0.5) + F.log2(order) / 128)
        drawn = hash_order_sum(drawn, ["source"], "unit", ["doc_id"], weight=F.col("tokens"), out="upto", bins=BINS)
        drawn = drawn.join(F.broadcast(self._extra), "source").withColumn("repeats", F.col("whole") + F.when(F.col("upto") - F.col("tokens") / 2 <= F.col("wanted"), 1).otherwise(0))
        return fixed.select(columns).unionByName(drawn.select(columns)).filter("repeats > 0")

    def report(self) -> DataFrame:
        """(source, target_share, max_repeats, available_tokens, target_tokens, used_tokens, actual_share, share_of_mixture, short) of each source of the weights table."""
        spark = self.documents.sparkSession
        plan = spark.createDataFrame([(s, self.shares[s], self.caps[s], self.targets[s]) for s in self.shares], "source string, target_share double, max_repeats int, target_tokens double")
        have = self.wanted.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
        used = self.documents_used().groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"))
        zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("available_tokens", "used_tokens")]
        rows = plan.join(have, "source", "left").join(used, "source", "left").select("source", "target_share", "max_repeats", "target_tokens", *zero)
        return (
            rows.withColumn("mixed", F.sum("used_tokens").over(Window.partitionBy()))  # at most MOST_SOURCES rows
            .withColumn("actual_share", F.coalesce(F.try_divide("used_tokens", F.lit(float(self.total))), F.lit(0.0)))
            .withColumn("share_of_mixture", F.coalesce(F.try_divide("used_tokens", "mixed"), F.lit(0.0)))
            .withColumn("short", F.col("target_tokens") > F.col("max_repeats") * F.col("available_tokens"))
            .drop("mixed")
        )

    def marginals(self) -> DataFrame:
        """(axis, value, natural_share, raked_share, actual_share) of each language and topic: its share of the tokens of the sources' own texts, of the raked weights, and of the mixture drawn."""
        spark = self.documents.sparkSession
        cells = self.weights
        rows = []
        for axis, name in ((1, "language"), (2, "topic")):
            for value in sorted({c[axis] for c in cells}):
                of = [c for c in cells if c[axis] == value]
                rows.append((name, value, float(sum(self.tokens[c] for c in of)), float(sum(self.tokens[c] * cells[c] for c in of))))
        plan = spark.createDataFrame(rows, "axis string, value string, natural double, raked double")
        axes = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in ("language", "topic")])
        used = self._used(["language", "topic", "tokens", "repeats"]).select(F.inline(axes), (F.col("tokens") * F.col("repeats")).alias("n"))
        joined = plan.join(used.groupBy("axis", "value").agg(F.sum("n").alias("used")), ["axis", "value"], "left").withColumn("used", F.coalesce("used", F.lit(0)).cast("double"))
        share = lambda c: F.coalesce(F.try_divide(F.col(c), F.sum(c).over(Window.partitionBy("axis"))), F.lit(0.0))  # noqa: E731 - a bounded table
        return joined.select("axis", "value", share("natural").alias("natural_share"), share("raked").alias("raked_share"), share("used").alias("actual_share"))
