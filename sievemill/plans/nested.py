"""Queries of problem 5: flat tables out of the annotations' nested columns."""

from __future__ import annotations

from ..operators import nested
from ..session import table


def _query(operator):
    return lambda spark, d: operator(table(spark, d, "annotations"))


QUERIES = {
    "p5_found": _query(nested.children_found),
    "p5_parents": _query(nested.parents),
    "p5_boxes": _query(nested.boxes),
    "p5_attempts": _query(nested.attempts),
    "p5_priors": _query(nested.priors),
    "p5_usage": _query(nested.usage),
    "p5_normalizations": _query(nested.normalizations),
}

_EACH = "SELECT annotation_id, {name} AS child, CAST(i - 1 AS VARCHAR) AS pos FROM annotations, LATERAL (SELECT unnest(range(1, coalesce(len({array}), 0) + 1)) AS i) WHERE {array}[i] IS NOT NULL"
_PRIORS = "annotation_meta.prior_records"
_PRIOR_ATTEMPTS = f"""SELECT annotation_id, i - 1 AS i, j - 1 AS j, {_PRIORS}[i].attempts[j] AS a FROM annotations, LATERAL (SELECT unnest(range(1, coalesce(len({_PRIORS}), 0) + 1)) AS i) x,
    LATERAL (SELECT unnest(range(1, coalesce(len({_PRIORS}[i].attempts), 0) + 1)) AS j) y WHERE {_PRIORS}[i].attempts[j] IS NOT NULL"""
_USAGE = "SELECT annotation_id, k AS key, annotation_meta.usage[k] AS tokens FROM annotations, LATERAL (SELECT unnest(map_keys(annotation_meta.usage)) AS k) WHERE annotation_meta.usage[k] IS NOT NULL"


def _each(array: str, name: str) -> str:
    return _EACH.format(name=f"'{name}'", array=array)


def _elements(array: str, columns: str) -> str:
    return f"""SELECT DISTINCT annotation_id, CAST(i - 1 AS INTEGER) AS pos, {columns.format(e=f"{array}[i]")} FROM annotations,
        LATERAL (SELECT unnest(range(1, coalesce(len({array}), 0) + 1)) AS i) WHERE {array}[i] IS NOT NULL"""


_BOXES, _PIXELS = "region_annotation.reference_boxes", "region_annotation.reference_boxes_pixels"

SQL = {
    "p5_found": " UNION ".join(
        [
            _each(_BOXES, "box"),
            _each(_PIXELS, "box"),
            _each("quality_checks.schema_normalizations", "normalization"),
            _each("annotation_meta.attempts", "attempt"),
            _each(_PRIORS, "prior"),
            f"SELECT annotation_id, 'prior_attempt' AS child, i || '.' || j AS pos FROM ({_PRIOR_ATTEMPTS})",
            f"SELECT annotation_id, 'usage' AS child, key AS pos FROM ({_USAGE})",
        ]
    ),
    "p5_parents": """SELECT DISTINCT annotation_id, sample_id, source_info.use_tool AS use_tool, source_info.tgt_width AS tgt_width, source_info.tgt_height AS tgt_height,
        region_annotation.status AS status, region_annotation.answer_from_image AS answer_from_image, region_annotation.coordinate_system AS coordinate_system,
        quality_checks.answer_match.match AS answer_matches, quality_checks.answer_match.method AS answer_method, quality_checks.valid_annotation AS valid_annotation,
        quality_checks.accepted_by_answer AS accepted_by_answer, quality_checks.region_reward_eligible AS region_reward_eligible, quality_checks.localization_review AS localization_review,
        annotation_meta.provider AS provider, annotation_meta.requested_model AS requested_model, annotation_meta.request_fingerprint AS request_fingerprint,
        annotation_meta.created_at AS created_at, annotation_meta.elapsed_seconds AS elapsed_seconds FROM annotations""",
    "p5_boxes": f"""SELECT DISTINCT annotation_id, CAST(i - 1 AS INTEGER) AS pos, {_BOXES}[i] AS box, {_PIXELS}[i] AS box_pixels FROM annotations,
        LATERAL (SELECT unnest(range(1, greatest(coalesce(len({_BOXES}), 0), coalesce(len({_PIXELS}), 0)) + 1)) AS i) WHERE {_BOXES}[i] IS NOT NULL OR {_PIXELS}[i] IS NOT NULL""",
    "p5_attempts": f"""{_elements("annotation_meta.attempts", "CAST(NULL AS INTEGER) AS prior_pos, {e}.attempt AS attempt, {e}.http_status AS http_status, {e}.error AS error")}
        UNION SELECT annotation_id, CAST(j AS INTEGER) AS pos, CAST(i AS INTEGER) AS prior_pos, a.attempt, a.http_status, a.error FROM ({_PRIOR_ATTEMPTS})""",
    "p5_priors": _elements(_PRIORS, "{e}.request_fingerprint AS request_fingerprint, {e}.created_at AS created_at"),
    "p5_usage": f"SELECT DISTINCT annotation_id, key, tokens FROM ({_USAGE})",
    "p5_normalizations": _elements("quality_checks.schema_normalizations", "{e} AS normalization"),
}
