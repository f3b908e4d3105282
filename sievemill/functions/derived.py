"""Small derived values (SCL16, SCL32, SCL34, SCL44, SCL54, SCL55, SCL58, FLT16)."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import geometry


def rebased(path: Column, root: str) -> Column:
    """SCL16: the path below ``root``, a leading ``data/`` dropped."""
    return F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(path, "^data/", ""))


def total_steps(*candidates: Column) -> Column:
    """SCL55: the first of the numbers that is positive; NULL if none is."""
    return F.coalesce(*[F.when(c > 0, c) for c in candidates])


def remaining(average: Column, step: Column, total: Column) -> Column:
    """SCL32: struct (percent, seconds, total_hours) of a run at ``step`` of ``total`` with an average step time; NULL without a total."""
    left = F.greatest(F.lit(0), total - step)
    return F.when(total > 0, F.struct((step / total * 100).alias("percent"), (left * average).alias("seconds"), (total * average / 3600).alias("total_hours")))


def format_score(valid: Column, has_think: Column, kind: Column, expected: Column) -> Column:
    """SCL34, SCL56: 1 for a valid turn with a think block and the expected action, else 0; averaged over turns by ``avg``."""
    return F.when(F.coalesce(valid & has_think & (kind == expected), F.lit(False)), 1.0).otherwise(0.0)


def expanded(prompt: Column, images: Column, token: str) -> Column:
    """SCL58: placeholders replaced by ``token``; NULL if they are not as many as the images."""
    n = F.regexp_count(prompt, F.lit("<image>"))
    return F.when(n == F.size(images), F.replace(prompt, F.lit("<image>"), F.lit(token)))


def sound_response(texts: Column, counts: Column) -> Column:
    """FLT16: as many texts as count lists, and every image count positive."""
    return F.coalesce((F.size(texts) == F.size(counts)) & F.forall(counts, lambda c: F.forall(c, lambda n: F.coalesce(n > 0, F.lit(False)))), F.lit(False))


def executed_crop(box: Column, width: Column, height: Column) -> Column:
    """SCL54: struct (pixels, executed) of a 0-1000 box: outward-rounded pixels inside the picture, and those in [0, 1]."""
    pixels = geometry.from_span(box, width, height)
    inside = F.array(*[F.greatest(F.lit(0).cast("bigint"), F.least((width if i % 2 == 0 else height).cast("bigint"), F.get(pixels, F.lit(i)))) for i in range(4)])
    return F.struct(inside.alias("pixels"), geometry.unit_box(inside, width, height).alias("executed"))


@F.pandas_udf(T.StringType())
def request_fingerprint(request: pd.Series) -> pd.Series:
    """SCL44: digest of a JSON text with its keys sorted, so that their order does not matter; NULL for NULL or malformed text."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else hashlib.sha256(json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False).encode()).hexdigest()
        except ValueError:
            return None

    return request.map(one)
