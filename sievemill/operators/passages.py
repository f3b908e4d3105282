"""Decontamination by passages (JOI10): what two texts share, wherever in their lines it stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Workspace

#: Words from which on sentences are a passage of their own; shorter ones count together with their neighbours.
WORDS = 8
#: Documents in which a passage may stand before it is boilerplate: so many, or one in COMMON_SHARE if that is more.
COMMON, COMMON_SHARE = 10, 1000
_SINGLE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
_SENTENCES = r"[\n\r]+|(?<=[.!?])\s+(?=[\p{Lu}\p{Lo}\p{Ps}\p{Pi}\"'])|(?<=[。！？])"
_WORD = rf"[{_SINGLE}]|[\p{{L}}\p{{M}}\p{{N}}&&[^{_SINGLE}]]+"


def sentences(text: Column) -> Column:
    """Array of the sentences and lines with any word, each as its words in lower case, without punctuation; a Chinese or Japanese character is a word."""
    words = F.transform(F.split(text, _SENTENCES), lambda s: F.array_join(F.regexp_extract_all(F.lower(s), F.lit(_WORD), F.lit(0)), " "))
    return F.filter(words, lambda s: s != "")


def _enough(s: Column) -> Column:
    return F.size(F.split(s, " ")) >= WORDS


def _runs(s: Column) -> Column:
    """For each sentence the shortest run from it on that has WORDS words. A sentence has a word at least, so WORDS of them suffice."""
    grown = lambda run, x: F.when((run == "") | ~_enough(run), F.ltrim(F.concat_ws(" ", run, x))).otherwise(run)
    at = F.sequence(F.lit(1), F.size(s))
    return F.filter(F.when(F.size(s) > 0, F.transform(at, lambda i: F.aggregate(F.slice(s, i, WORDS), F.lit(""), grown))).otherwise(F.array().cast("array<string>")), _enough)


def _runs_back(s: Column) -> Column:
    """The same up to each sentence, so that the last short ones have a passage as well."""
    grown = lambda run, x: F.when((run == "") | ~_enough(run), F.rtrim(F.concat_ws(" ", x, run))).otherwise(run)
    at = F.sequence(F.lit(1), F.size(s))
    return F.filter(F.when(F.size(s) > 0, F.transform(at, lambda i: F.aggregate(F.slice(F.reverse(s), i, WORDS), F.lit(""), grown))).otherwise(F.array().cast("array<string>")), _enough)


def passages(s: Column) -> Column:
    """The distinct passages among sentences ``s``: each sentence is in one, unless the text is shorter than WORDS words."""
    return F.array_distinct(F.concat(_runs(s), _runs_back(s)))


def without_passages(documents: DataFrame, held: Column, id_column: str, text: str) -> DataFrame:
    """JOI10: the documents that are not ``held`` and share no passage with one that is, boilerplate apart.

    A held text with fewer than WORDS words is compared by its single sentences.
    """
    work = Workspace(documents.sparkSession, "passages")
    split = documents.select(id_column, F.coalesce(held, F.lit(False)).alias("held"), sentences(F.col(text)).alias("s"))
    own = passages(F.col("s"))
    # Of the others all sentences too, since a short held text may stand there.
    found = F.when(F.col("held") & (F.size(own) > 0), own).when(F.col("held"), F.col("s")).otherwise(F.concat(own, F.col("s")))
    rows = work.save(split.select(id_column, "held", F.explode(F.array_distinct(F.transform(found, lambda p: F.xxhash64(p)))).alias("h")), "passages")
    common = max(COMMON, documents.count() // COMMON_SHARE)
    others = work.save(rows.filter(~F.col("held")).join(rows.filter("held").select("h").distinct(), "h", "left_semi").select(id_column, "h"), "shared")
    frequent = others.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > common).select("h")
    hit = others.join(frequent, "h", "left_anti").select(id_column).distinct()
    return documents.filter(~F.coalesce(held, F.lit(False))).join(hit, id_column, "left_anti")
