"""Box geometry as Column expressions (SCL20-25, SCL27, SCL33, SCL54, PRJ14, JOI20)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 1000


def _at(box: Column, i: int) -> Column:
    return F.get(box, F.lit(i))


def is_box(box: Column, low: float = 0.0, high: float | Column = 1.0) -> Column:
    """SCL20: four finite numbers within the range, of positive area; False for NULL."""
    inside = F.forall(box, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (v >= low) & (v <= high))
    return F.coalesce((F.size(box) == 4) & inside & (_at(box, 0) < _at(box, 2)) & (_at(box, 1) < _at(box, 3)), F.lit(False))


def is_pixel_box(box: Column, width: Column, height: Column) -> Column:
    """SCL25: four whole pixels inside the picture, of positive area; False for NULL."""
    some = F.coalesce((F.size(box) == 4) & F.forall(box, lambda v: v.isNotNull() & (v >= 0)), F.lit(False))
    return F.coalesce(some & (_at(box, 0) < _at(box, 2)) & (_at(box, 1) < _at(box, 3)) & (_at(box, 2) <= width) & (_at(box, 3) <= height), F.lit(False))


def pixel_box(box: Column, width: Column, height: Column) -> Column:
    """SCL21: outward-rounded pixels of a box in [0, 1]; NULL if it is none."""
    parts = F.array(*[(F.floor if i < 2 else F.ceil)(_at(box, i) * (width if i % 2 == 0 else height)) for i in range(4)])
    return F.when(is_box(box), parts)


def unit_box(box: Column, width: Column, height: Column) -> Column:
    """PRJ14: a pixel box divided by the picture's size."""
    return F.array(*[F.try_divide(_at(box, i).cast("double"), (width if i % 2 == 0 else height).cast("double")) for i in range(4)])


def to_span(box: Column, width: Column, height: Column) -> Column:
    """SCL23: pixels to whole 0-1000 coordinates, rounded outwards."""
    low = lambda i, n: F.floor(F.try_divide(_at(box, i) * SPAN, n)).cast("bigint")
    high = lambda i, n: F.ceil(F.try_divide(_at(box, i) * SPAN, n)).cast("bigint")
    return F.array(low(0, width), low(1, height), high(2, width), high(3, height))


def from_span(box: Column, width: Column, height: Column) -> Column:
    """SCL24: 0-1000 coordinates to pixels, rounded outwards."""
    return F.array(*[(F.floor if i < 2 else F.ceil)(_at(box, i) * (width if i % 2 == 0 else height) / F.lit(float(SPAN))).cast("bigint") for i in range(4)])


def area(box: Column) -> Column:
    return (_at(box, 2) - _at(box, 0)) * (_at(box, 3) - _at(box, 1))


def overlap(p: Column, g: Column) -> Column:
    side = lambda i: F.greatest(F.lit(0.0), F.least(_at(p, i + 2), _at(g, i + 2)) - F.greatest(_at(p, i), _at(g, i)))
    return side(0) * side(1)


def best_overlap(p: Column, references: Column, coverage_weight: float = 0.5) -> Column:
    """SCL22, JOI20: struct (reward, coverage, iou) of the reference with the largest reward.

    The reward is the weighted geometric mean of the covered part of the reference and the intersection over
    union. Malformed references are no references; NULL, not zero, if there are none or ``p`` is no box.
    """
    if not 0 < coverage_weight < 1:
        raise ValueError("coverage_weight must lie between 0 and 1")

    def one(g: Column) -> Column:
        common = overlap(p, g)
        coverage, iou = common / area(g), common / (area(p) + area(g) - common)
        return F.struct((F.pow(coverage, F.lit(coverage_weight)) * F.pow(iou, F.lit(1 - coverage_weight))).alias("reward"), coverage.alias("coverage"), iou.alias("iou"))

    return F.when(is_box(p), F.array_max(F.transform(F.filter(references, lambda g: is_box(g)), one)))


def centre_box(box: Column) -> Column:
    """SCL33: the box clamped to 0-1000, or the middle half of the picture without one."""
    clamped = F.array(*[F.greatest(F.lit(0.0), F.least(F.lit(float(SPAN)), _at(box, i))) for i in range(4)])
    return F.when(F.coalesce(F.size(box) == 4, F.lit(False)), clamped).otherwise(F.array(*[F.lit(v) for v in (250.0, 250.0, 750.0, 750.0)]))


def packed_reward(correct: Column, score: Column, form: Column) -> Column:
    """SCL27: one number for exactness, similarity and format."""
    return F.when(correct, F.lit(1.0) + form).otherwise(form + score / 32.0)


def unpacked_reward(value: Column) -> Column:
    """SCL27: struct (accuracy, score, format) of a packed reward."""
    exact = value >= 1.0
    steps = F.when(exact, F.bround((value - 1.0) / 0.05)).otherwise(F.floor(value / 0.05 + 1e-6))
    form = F.greatest(F.lit(0.0), F.least(F.lit(2.0), steps.cast("double"))) * 0.05
    score = F.when(exact, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.9999), (value - form) * 32.0)))
    return F.struct(F.when(exact, 1.0).otherwise(0.0).alias("accuracy"), score.alias("score"), form.alias("format"))
