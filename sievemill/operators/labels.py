"""Merging labels, human edits and sources (JOI01-06, FLT03-06, FLT09, PRJ13-15, SET02-05, AGG20-22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.normal import trimmed

# The statuses of a region label.
STATUSES = ["localized", "global", "uncertain"]


def annotations_once(annotations: DataFrame) -> DataFrame:
    """Annotations without exact copies; those without an id are told apart by their whole content."""
    content = F.when(F.col("annotation_id").isNull(), F.to_json(F.struct("*")))
    return annotations.withColumn("__content", content).dropDuplicates(["annotation_id", "__content"]).drop("__content")


def latest(annotations: DataFrame, *columns: str) -> DataFrame:
    """The last annotation of each sample by time, then id: (sample_id, columns...)."""
    picked = F.max_by(F.struct(*columns), F.struct(F.col("annotated_at"), F.col("annotation_id")))
    return annotations.filter("sample_id IS NOT NULL").groupBy("sample_id").agg(picked.alias("a")).select("sample_id", "a.*")


def latest_edits(edits: DataFrame) -> DataFrame:
    """The last edit of each sample; its time may be written with any zone. Edits without a readable time come first."""
    when = F.try_to_timestamp("updated_at")
    fields = [c for c in edits.columns if c != "sample_id"]
    order = F.struct(when.isNotNull(), when, F.col("updated_at"), F.coalesce("edited_status", F.lit("")), F.coalesce("verdict", F.lit("")), F.coalesce("note", F.lit("")))
    return edits.filter("sample_id IS NOT NULL").groupBy("sample_id").agg(F.max_by(F.struct(*fields), order).alias("e")).select("sample_id", "e.*")


def edited(annotations: DataFrame, edits: DataFrame) -> DataFrame:
    """JOI03, PRJ13: (sample_id, status, box, applied, stale) of each annotated sample after its last edit.

    An edit is stale, and not applied, if what it started from isn't what the sample has; NULLs compare as equal.
    """
    own = latest(annotations, F.col("region_annotation.status").alias("status"), F.get("region_annotation.reference_boxes_pixels", F.lit(0)).alias("box"))
    rows = own.join(latest_edits(edits), "sample_id", "left")
    wanted = F.coalesce(F.col("edited"), F.lit(False))
    stale = wanted & ~(F.col("status").eqNullSafe(F.col("original_status")) & F.col("box").eqNullSafe(F.col("original_reference_box_pixels")))
    applied = wanted & ~stale
    return rows.select("sample_id", F.when(applied, F.col("edited_status")).otherwise(F.col("status")).alias("status"), F.when(applied, F.col("edited_reference_box_pixels")).otherwise(F.col("box")).alias("box"), applied.alias("applied"), stale.alias("stale"))


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """JOI05, SET02, SET04: keys of one side only, with the side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def with_fallback(manifest: DataFrame, annotations: DataFrame) -> DataFrame:
    """JOI01, PRJ15: (sample_id, question, status, annotated): the annotation's question where there is one, else the manifest's."""
    base = manifest.filter("sample_id IS NOT NULL").groupBy("sample_id").agg(F.min("question").alias("q"))
    own = latest(annotations, F.col("question").alias("question"), F.col("region_annotation.status").alias("status")).withColumn("annotated", F.lit(True))
    return base.join(own, "sample_id", "left").select("sample_id", F.coalesce("question", "q").alias("question"), F.coalesce("status", F.lit("unlabelled")).alias("status"), F.coalesce("annotated", F.lit(False)).alias("annotated"))


def reviewed(annotations: DataFrame, reviews: DataFrame) -> DataFrame:
    """PRJ15: (sample_id, original, accepted, overridden): the last label's acceptance, and what the last review makes of it.

    A review keeps (``keep``) or refuses (``fix``); any other verdict, in whatever case, changes nothing.
    """
    own = latest(annotations, accepted().alias("original"))
    verdict = F.lower(trimmed("verdict"))
    said = F.when(verdict == "keep", True).when(verdict == "fix", False)
    rows = own.join(latest_edits(reviews).select("sample_id", said.alias("said")), "sample_id", "left")
    return rows.select("sample_id", "original", F.coalesce("said", "original").alias("accepted"), F.col("said").isNotNull().alias("overridden"))


def without_hashes(rows: DataFrame, held: DataFrame, hashes: list[list[str]]) -> DataFrame:
    """JOI10: the rows none of whose hashes a held row has; the columns of each list are compared among one another. A missing hash equals nothing."""
    for group in hashes:
        known = held.select(F.explode(F.array(*group)).alias("__hash")).filter(F.col("__hash").isNotNull()).distinct()
        for c in group:
            rows = rows.join(known, F.col(c) == F.col("__hash"), "left_anti")
    return rows


def problems() -> Column:
    """FLT09: what is wrong with a label first; NULL if nothing is."""
    region = F.col("region_annotation")
    boxes = F.coalesce(region["reference_boxes_pixels"], F.array())
    n = F.size(boxes)
    good = F.forall(boxes, lambda b: geometry.is_pixel_box(b, F.col("width"), F.col("height")))
    return (
        F.when(F.col("annotation_error").isNotNull(), "error")
        .when(region.isNull(), "no_region")
        .when(~F.coalesce(region["status"].isin(STATUSES), F.lit(False)), "status")
        .when((region["status"] == "localized") & (n == 0), "no_box")
        .when((region["status"] != "localized") & (n > 0), "needless_box")
        .when(~F.coalesce(good, F.lit(False)), "malformed_box")
    )


def accepted() -> Column:
    """FLT05: the answer matched and the status is localized."""
    return F.coalesce(F.col("quality_checks.answer_match.match") & (F.col("region_annotation.status") == "localized"), F.lit(False))


def replaced(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SET05: rows of ``new`` take the place of those with their key; new keys are added."""
    return rows.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
