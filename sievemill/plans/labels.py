"""Queries of labels, edits and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import labels
from ..operators.metrics import PLACES, mean, rounded
from ..operators.quantiles import with_quantiles
from ..session import table


def _annotations(spark, d):
    return labels.annotations_once(table(spark, d, "annotations"))


def _boxes(spark, d):
    """Every pixel box of an annotation with its place."""
    rows = _annotations(spark, d)
    return rows.select("annotation_id", "width", "height", F.col("region_annotation.reference_boxes").alias("units"), F.posexplode("region_annotation.reference_boxes_pixels").alias("pos", "box")).filter("box IS NOT NULL")


def _units(spark, d):
    return _annotations(spark, d).select("annotation_id", "width", "height", F.posexplode("region_annotation.reference_boxes").alias("pos", "box")).filter("box IS NOT NULL")


def agg20(spark, d):
    rows = _annotations(spark, d)
    usage = lambda k: F.sum(F.coalesce(F.try_element_at("annotation_meta.usage", F.lit(k)), F.lit(0)))
    box = F.get("region_annotation.reference_boxes", F.lit(0))
    out = rows.agg(
        F.count("*").alias("rows"),
        F.count(F.when(F.col("annotation_error").isNotNull(), 1)).alias("errors"),
        F.count(F.when(labels.accepted(), 1)).alias("accepted"),
        usage("prompt_tokens").alias("prompt_tokens"),
        usage("completion_tokens").alias("completion_tokens"),
        mean("annotation_meta.elapsed_seconds").alias("mean_seconds"),
        F.concat_ws(",", F.sort_array(F.collect_set("annotation_meta.requested_model"))).alias("models"),
    )
    areas = rows.select(F.when(geometry.is_box(box), geometry.area(box)).alias("area"))
    return with_quantiles(out, areas, [], "area", {"median_area": 0.5}, PLACES)


def scl22(spark, d):
    boxes = F.col("region_annotation.reference_boxes")
    others = F.slice(boxes, 2, F.greatest(F.size(boxes) - 1, F.lit(0)))
    rows = _annotations(spark, d).select("annotation_id", F.get(boxes, F.lit(0)).alias("p"), others.alias("g")).filter(F.size("g") > 0)
    best = geometry.best_overlap(F.col("p"), F.filter("g", lambda b: b.isNotNull()))
    return rows.select("annotation_id", rounded(best["reward"]).alias("reward"), rounded(best["coverage"]).alias("coverage"), rounded(best["iou"]).alias("iou"))


def scl23(spark, d):
    rows = _boxes(spark, d).filter(geometry.is_pixel_box(F.col("box"), F.col("width"), F.col("height")))
    span = geometry.to_span(F.col("box"), F.col("width"), F.col("height"))
    return rows.select("annotation_id", "pos", span.alias("span"), geometry.from_span(span, F.col("width"), F.col("height")).alias("executed"))


def scl27(spark, d):
    packed = geometry.packed_reward(F.col("correct"), F.coalesce("tool_reward", F.lit(0.0)), F.when(F.col("format_compliance") >= 1, 0.1).when(F.col("format_compliance") > 0, 0.05).otherwise(0.0))
    rows = table(spark, d, "eval_record").distinct().withColumn("r", geometry.unpacked_reward(packed))
    return rows.select("eval_id", F.col("r.accuracy").alias("accuracy"), rounded(F.col("r.score")).alias("score"), rounded(F.col("r.format")).alias("format"))


QUERIES = {
    "joi01_with_fallback": lambda s, d: labels.with_fallback(table(s, d, "manifest"), table(s, d, "annotations")),
    "joi03_prj13_edited": lambda s, d: labels.edited(table(s, d, "annotations"), table(s, d, "review_edit")),
    "joi05_set02_coverage": lambda s, d: labels.coverage(table(s, d, "annotations"), table(s, d, "review_edit"), "sample_id"),
    "joi02_totals": lambda s, d: labels.coverage(table(s, d, "manifest"), table(s, d, "annotations"), "sample_id").groupBy("side").agg(F.count("*").alias("n")),
    "set03_intersection": lambda s, d: table(s, d, "annotations").select("sample_id").intersect(table(s, d, "review_edit").select("sample_id")).agg(F.count("*").alias("n")),
    "flt05_flt06_flags": lambda s, d: _annotations(s, d).select("annotation_id", labels.accepted().alias("accepted"), F.col("annotation_error").isNotNull().alias("error")),
    "flt04_eligible": lambda s, d: _annotations(s, d).filter(F.col("quality_checks.region_reward_eligible") & (F.size("region_annotation.reference_boxes") > 0)).select("annotation_id"),
    "flt09_label_problems": lambda s, d: _annotations(s, d).groupBy(labels.problems().alias("problem")).agg(F.count("*").alias("n")),
    "agg20_label_report": agg20,
    "agg22_statuses": lambda s, d: _annotations(s, d).groupBy(F.col("region_annotation.status").alias("status"), F.col("quality_checks.answer_match.match").alias("matches")).agg(F.count("*").alias("n")),
    "agg21_verdicts": lambda s, d: table(s, d, "review_edit").distinct().groupBy(F.lower("verdict").alias("verdict"), "edited").agg(F.count("*").alias("n")),
    "scl20_valid_boxes": lambda s, d: _units(s, d).select("annotation_id", "pos", geometry.is_box(F.col("box")).alias("valid")),
    "scl21_pixel_boxes": lambda s, d: _units(s, d).filter(geometry.is_box(F.col("box"))).select("annotation_id", "pos", geometry.pixel_box(F.col("box"), F.col("width"), F.col("height")).alias("pixels")),
    "scl22_joi20_best_overlap": scl22,
    "scl23_scl24_span": scl23,
    "scl25_pixel_checks": lambda s, d: _boxes(s, d).select("annotation_id", "pos", geometry.is_pixel_box(F.col("box"), F.col("width"), F.col("height")).alias("valid")),
    "scl27_rewards": scl27,
    "scl33_centre_boxes": lambda s, d: _annotations(s, d).select("annotation_id", geometry.centre_box(F.transform(F.get("region_annotation.reference_boxes_pixels", F.lit(0)), lambda v: v.cast("double"))).alias("box")),
    "prj14_unit_boxes": lambda s, d: _boxes(s, d).filter(geometry.is_pixel_box(F.col("box"), F.col("width"), F.col("height"))).select("annotation_id", "pos", F.transform(geometry.unit_box(F.col("box"), F.col("width"), F.col("height")), lambda v: F.round(v, 9)).alias("unit")),
}

_A = "a AS (SELECT DISTINCT ON (annotation_id) * FROM annotations)"
_LATEST = "SELECT sample_id, arg_max({what}, {{'t': annotated_at, 'i': annotation_id}}) AS a FROM annotations WHERE sample_id IS NOT NULL GROUP BY 1"


def _each(array: str) -> str:
    return f"SELECT annotation_id, width, height, CAST(i - 1 AS INTEGER) AS pos, {array}[i] AS box FROM a, LATERAL (SELECT unnest(range(1, coalesce(len({array}), 0) + 1)) AS i) WHERE {array}[i] IS NOT NULL"


_PIX, _UNI = "region_annotation.reference_boxes_pixels", "region_annotation.reference_boxes"


def _is_box(b: str) -> str:
    return f"coalesce(len({b}) = 4 AND len(list_filter({b}, lambda v: v IS NULL OR isnan(v) OR v < 0 OR v > 1)) = 0 AND {b}[1] < {b}[3] AND {b}[2] < {b}[4], FALSE)"


def _is_pix(b: str, w: str = "width", h: str = "height") -> str:
    return f"coalesce(len({b}) = 4 AND len(list_filter({b}, lambda v: v IS NULL OR v < 0)) = 0 AND {b}[1] < {b}[3] AND {b}[2] < {b}[4] AND {b}[3] <= {w} AND {b}[4] <= {h}, FALSE)"


_EDITS = """l AS (SELECT sample_id, arg_max({'edited': edited, 'os': original_status, 'ob': original_reference_box_pixels, 'es': edited_status, 'eb': edited_reference_box_pixels},
    {'k': TRY_CAST(updated_at AS TIMESTAMPTZ) IS NOT NULL, 't': TRY_CAST(updated_at AS TIMESTAMPTZ), 'u': updated_at, 's': coalesce(edited_status, ''), 'v': coalesce(verdict, ''), 'n': coalesce(note, '')}) AS e FROM review_edit WHERE sample_id IS NOT NULL GROUP BY 1)"""
_I = "(greatest(0.0, least(p[3], g[3]) - greatest(p[1], g[1])) * greatest(0.0, least(p[4], g[4]) - greatest(p[2], g[2])))"
_AREA = "(({0}[3] - {0}[1]) * ({0}[4] - {0}[2]))"

SQL = {
    "joi01_with_fallback": f"""WITH b AS (SELECT sample_id, min(question) AS q FROM manifest WHERE sample_id IS NOT NULL GROUP BY 1), o AS ({_LATEST.format(what="{'q': question, 's': region_annotation.status}")})
        SELECT b.sample_id, coalesce(a.q, b.q) AS question, coalesce(a.s, 'unlabelled') AS status, o.sample_id IS NOT NULL AS annotated FROM b LEFT JOIN o USING (sample_id)""",
    "joi03_prj13_edited": f"""WITH o AS ({_LATEST.format(what="{'s': region_annotation.status, 'b': region_annotation.reference_boxes_pixels[1]}")}), {_EDITS},
        j AS (SELECT o.sample_id, a.s, a.b, e, coalesce(e.edited, FALSE) AS w, a.s IS NOT DISTINCT FROM e.os AND a.b IS NOT DISTINCT FROM e.ob AS same FROM o LEFT JOIN l USING (sample_id))
        SELECT sample_id, CASE WHEN w AND same THEN e.es ELSE s END AS status, CASE WHEN w AND same THEN e.eb ELSE b END AS box, w AND same AS applied, w AND NOT same AS stale FROM j""",
    "joi05_set02_coverage": "SELECT sample_id, 'left' AS side FROM (SELECT sample_id FROM annotations EXCEPT SELECT sample_id FROM review_edit) UNION ALL SELECT sample_id, 'right' FROM (SELECT sample_id FROM review_edit EXCEPT SELECT sample_id FROM annotations)",
    "joi02_totals": "SELECT side, count(*) AS n FROM (SELECT sample_id, 'left' AS side FROM (SELECT sample_id FROM manifest EXCEPT SELECT sample_id FROM annotations) UNION ALL SELECT sample_id, 'right' FROM (SELECT sample_id FROM annotations EXCEPT SELECT sample_id FROM manifest)) GROUP BY 1",
    "set03_intersection": "SELECT count(*) AS n FROM (SELECT sample_id FROM annotations INTERSECT SELECT sample_id FROM review_edit)",
    "flt05_flt06_flags": f"WITH {_A} SELECT annotation_id, coalesce(quality_checks.answer_match.match AND region_annotation.status = 'localized', FALSE) AS accepted, annotation_error IS NOT NULL AS error FROM a",
    "flt04_eligible": f"WITH {_A} SELECT annotation_id FROM a WHERE quality_checks.region_reward_eligible AND len({_UNI}) > 0",
    "flt09_label_problems": f"""WITH {_A} SELECT CASE WHEN annotation_error IS NOT NULL THEN 'error' WHEN region_annotation IS NULL THEN 'no_region' WHEN coalesce(region_annotation.status NOT IN ('localized', 'global', 'uncertain'), TRUE) THEN 'status'
        WHEN region_annotation.status = 'localized' AND coalesce(len({_PIX}), 0) = 0 THEN 'no_box' WHEN region_annotation.status <> 'localized' AND coalesce(len({_PIX}), 0) > 0 THEN 'needless_box'
        WHEN len(list_filter(coalesce({_PIX}, []), lambda b: NOT {_is_pix("b")})) > 0 THEN 'malformed_box' END AS problem, count(*) AS n FROM a GROUP BY 1""",
    "agg20_label_report": f"""WITH {_A} SELECT count(*) AS rows, count(annotation_error) AS errors, count(*) FILTER (WHERE quality_checks.answer_match.match AND region_annotation.status = 'localized') AS accepted,
        CAST(sum(coalesce(annotation_meta.usage['prompt_tokens'], 0)) AS BIGINT) AS prompt_tokens, CAST(sum(coalesce(annotation_meta.usage['completion_tokens'], 0)) AS BIGINT) AS completion_tokens, round(avg(annotation_meta.elapsed_seconds), 6) AS mean_seconds,
        round(median({_AREA.format(f"{_UNI}[1]")}) FILTER (WHERE {_is_box(f"{_UNI}[1]")}), 6) AS median_area, (SELECT string_agg(m, ',' ORDER BY m) FROM (SELECT DISTINCT annotation_meta.requested_model AS m FROM annotations)) AS models FROM a""",
    "agg22_statuses": f"WITH {_A} SELECT region_annotation.status AS status, quality_checks.answer_match.match AS matches, count(*) AS n FROM a GROUP BY 1, 2",
    "agg21_verdicts": "SELECT lower(verdict) AS verdict, edited, count(*) AS n FROM (SELECT DISTINCT * FROM review_edit) GROUP BY 1, 2",
    "scl20_valid_boxes": f"WITH {_A} SELECT annotation_id, pos, {_is_box('box')} AS valid FROM ({_each(_UNI)})",
    "scl21_pixel_boxes": f"WITH {_A} SELECT annotation_id, pos, [CAST(floor(box[1] * width) AS BIGINT), CAST(floor(box[2] * height) AS BIGINT), CAST(ceil(box[3] * width) AS BIGINT), CAST(ceil(box[4] * height) AS BIGINT)] AS pixels FROM ({_each(_UNI)}) WHERE {_is_box('box')}",
    "scl22_joi20_best_overlap": f"""WITH {_A}, r AS (SELECT annotation_id, {_UNI}[1] AS p, {_UNI}[2:] AS gs FROM a WHERE len({_UNI}) > 1), x AS (SELECT annotation_id, p, unnest(gs) AS g FROM r),
        y AS (SELECT annotation_id, {_I} / {_AREA.format('g')} AS coverage, {_I} / ({_AREA.format('p')} + {_AREA.format('g')} - {_I}) AS iou FROM x WHERE {_is_box('p')} AND {_is_box('g')}),
        z AS (SELECT annotation_id, max({{'r': pow(coverage, 0.5) * pow(iou, 0.5), 'c': coverage, 'i': iou}}) AS m FROM y GROUP BY 1)
        SELECT r.annotation_id, round(m.r, 6) AS reward, round(m.c, 6) AS coverage, round(m.i, 6) AS iou FROM r LEFT JOIN z USING (annotation_id)""",
    "scl23_scl24_span": f"""WITH {_A}, b AS (SELECT * FROM ({_each(_PIX)}) WHERE {_is_pix('box')}), s AS (SELECT *, [box[1] * 1000 // width, box[2] * 1000 // height, (box[3] * 1000 + width - 1) // width, (box[4] * 1000 + height - 1) // height] AS span FROM b)
        SELECT annotation_id, pos, span, [CAST(floor(span[1] * width / 1000.0::DOUBLE) AS BIGINT), CAST(floor(span[2] * height / 1000.0::DOUBLE) AS BIGINT), CAST(ceil(span[3] * width / 1000.0::DOUBLE) AS BIGINT), CAST(ceil(span[4] * height / 1000.0::DOUBLE) AS BIGINT)] AS executed FROM s""",
    "scl25_pixel_checks": f"WITH {_A} SELECT annotation_id, pos, {_is_pix('box')} AS valid FROM ({_each(_PIX)})",
    "scl27_rewards": """WITH e AS (SELECT DISTINCT * FROM eval_record), f AS (SELECT eval_id, correct, coalesce(tool_reward, 0.0::DOUBLE) AS s, (CASE WHEN format_compliance >= 1 THEN 0.1 WHEN format_compliance > 0 THEN 0.05 ELSE 0 END)::DOUBLE AS form FROM e),
        v AS (SELECT eval_id, CASE WHEN correct THEN 1.0::DOUBLE + form ELSE form + s / 32.0::DOUBLE END AS v FROM f),
        g AS (SELECT *, greatest(0.0::DOUBLE, least(2.0::DOUBLE, CASE WHEN v >= 1 THEN round_even((v - 1) / 0.05::DOUBLE, 0) ELSE floor(v / 0.05::DOUBLE + 1e-6::DOUBLE) END)) * 0.05::DOUBLE AS form FROM v)
        SELECT eval_id, CASE WHEN v >= 1 THEN 1.0::DOUBLE ELSE 0 END AS accuracy, round(CASE WHEN v >= 1 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(0.9999::DOUBLE, (v - form) * 32.0::DOUBLE)) END, 6) AS score, round(form, 6) AS format FROM g""",
    "scl33_centre_boxes": f"WITH {_A} SELECT annotation_id, CASE WHEN len({_PIX}[1]) = 4 THEN list_transform({_PIX}[1], lambda v: greatest(0.0::DOUBLE, least(1000.0::DOUBLE, v::DOUBLE))) ELSE [250.0::DOUBLE, 250, 750, 750] END AS box FROM a",
    "prj14_unit_boxes": f"WITH {_A} SELECT annotation_id, pos, [round(box[1]::DOUBLE / width, 9), round(box[2]::DOUBLE / height, 9), round(box[3]::DOUBLE / width, 9), round(box[4]::DOUBLE / height, 9)] AS unit FROM ({_each(_PIX)}) WHERE {_is_pix('box')}",
}
