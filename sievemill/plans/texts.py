"""Queries of answers and tagged actions over annotations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import actions, answers
from ..operators import labels, turns
from ..operators.metrics import mean, rounded
from ..session import table


def _answered(spark, d):
    """The annotation's reading of the answer as prediction, the sample's answers as references."""
    rows = labels.annotations_once(table(spark, d, "annotations"))
    return rows.select("annotation_id", "data_source", F.col("region_annotation.answer_from_image").alias("prediction"), F.coalesce("answers", F.array().cast("array<string>")).alias("answers"))


def _turns(spark, d):
    return table(spark, d, "documents").filter("source IN ('rollout_log', 'sft_target')").select("doc_id", "source", "text")


def _parsed(spark, d):
    return _turns(spark, d).withColumn("a", actions.parsed(F.col("text"))).select("doc_id", "source", "a.*")


def scl03(spark, d):
    return _answered(spark, d).withColumn("m", answers.match_of("prediction", "answers")).select("annotation_id", "m.match", "m.method")


def scl04(spark, d):
    return _answered(spark, d).select("annotation_id", rounded(answers.credit_of("prediction", "answers")).alias("score"))


def scl07(spark, d):
    kinds = F.when(F.col("data_source") == "pier_sheets", "ChartQA").when(F.col("data_source") == "shop_receipts", "OCRBench").otherwise("MathVerse")
    return _answered(spark, d).withColumn("s", answers.score_of(kinds, F.when(F.col("annotation_id") % 2 == 0, "multi-choice").otherwise("free-form"), F.col("prediction"), F.col("answers"))).select("annotation_id", "s.correct", "s.method")


def _inspected(spark, d):
    """Rollouts and targets as generations; blank-separated words stand for tokens, an end inside a tag or text for a length limit."""
    rows = _turns(spark, d).withColumn("a", actions.parsed(F.col("text")))
    finish = F.when(F.endswith(F.rtrim("text"), F.lit(">")), "stop").when(F.col("text").isNotNull(), "length")
    return rows.select("doc_id", "source", *turns.inspected("text", finish, F.size(F.split(F.coalesce("text", F.lit("")), " ")), F.get(F.split("text", " "), F.lit(0))))


QUERIES = {
    "scl01_normal_answers": lambda s, d: _answered(s, d).select("annotation_id", answers.normal_text_of("prediction").alias("answer")),
    "scl02_numbers": lambda s, d: _answered(s, d).select("annotation_id", answers.plain_number_of("prediction").alias("number")),
    "scl03_joi19_matches": scl03,
    "scl04_partial_credit": scl04,
    "scl07_benchmark_scores": scl07,
    "agg10_turn_summary": lambda s, d: turns.turn_summary(_inspected(s, d), "source"),
    "scl08_actions": lambda s, d: _parsed(s, d).select("doc_id", "kind", "valid", "answer", "error"),
    "scl09_says_something": lambda s, d: table(s, d, "documents").select("doc_id", actions.says_something_of("text").alias("something")),
    "scl11_answer_candidates": lambda s, d: table(s, d, "documents").select("doc_id", actions.answer_candidate("text").alias("candidate")),
    "scl14_placeholders": lambda s, d: table(s, d, "documents").select("doc_id", F.coalesce(actions.placeholders(F.col("text")), F.lit(0)).alias("images")),
    "prj10_prj11_targets": lambda s, d: _answered(s, d).select("annotation_id", actions.tagged(F.coalesce("prediction", F.lit("")), actions.call_text(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4))), actions.CALL).alias("target")),
    "scl57_inspection": lambda s, d: _inspected(s, d).drop("source", "valid_action", "action_kind", "parse_error"),
    "scl57_actions": lambda s, d: _inspected(s, d).select("doc_id", "valid_action", "action_kind", "parse_error"),
    "scl04_mean_credit": lambda s, d: scl04(s, d).agg(mean("score").alias("score")),
}

_TRIMMED = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_INNER = _TRIMMED.format("regexp_extract(text, '(?s)<answer>(.*?)</answer>', 1)")
_BARE = f"CASE WHEN starts_with({_INNER}, '\\boxed{{') AND ends_with({_INNER}, '}}') THEN {_TRIMMED.format(f'substr({_INNER}, 8, length({_INNER}) - 8)')} WHEN starts_with({_INNER}, '\\fbox{{') AND ends_with({_INNER}, '}}') THEN {_TRIMMED.format(f'substr({_INNER}, 7, length({_INNER}) - 7)')} ELSE {_INNER} END"
_SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]"


def _normal(c: str) -> str:
    """Compatibility forms and case folding as far as the tables have them: lower case and sharp s."""
    return rf"regexp_replace(trim(regexp_replace(replace(lower({c}), 'ß', 'ss'), '{_SPACE}+', ' ', 'g')), '[.。]+$', '')"


def _plain(c: str) -> str:
    return rf"CASE WHEN regexp_full_match({c}, '[+-]?(\d{{1,3}}(,\d{{3}})+|\d+)(\.\d+)?(e[+-]?\d+)?') THEN replace({c}, ',', '') END"


def _loose(c: str, chart: bool = False) -> str:
    """A number of the benchmark's grammar; for charts without dollar and percent signs around it."""
    bare = f"replace(trim({c}), ',', '')"
    bare = f"regexp_replace({bare}, '^[$% ]+|[$% ]+$', '', 'g')" if chart else bare
    bare = f"regexp_replace({bare}, '°+$', '')"
    return rf"CASE WHEN regexp_full_match({bare}, '[+-]?(\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?') THEN CAST({bare} AS DOUBLE) END"


def _each(of) -> str:
    return f"list_transform(goals, lambda g: {of('g')})"


_ANSWERED = f"""r AS (SELECT DISTINCT ON (annotation_id) annotation_id, data_source, {_normal('region_annotation.answer_from_image')} AS p, list_transform(list_filter(coalesce(answers, []), lambda a: a IS NOT NULL), lambda a: {_normal('a')}) AS goals FROM annotations),
    n AS (SELECT *, {_plain('p')} AS number, {_each(_plain)} AS numbers FROM r),
    m AS (SELECT *, CASE WHEN p IS NULL THEN 'unmatched_requires_review' WHEN list_contains(goals, p) THEN 'normalized_exact' WHEN len(list_filter(numbers, lambda x: CAST(x AS DOUBLE) = CAST(number AS DOUBLE))) > 0 THEN 'numeric_exact' ELSE 'unmatched_requires_review' END AS method FROM n)"""
_LETTERS = "list_filter(list_transform(goals, lambda g: upper(trim(g))), lambda c: c IN ('A', 'B', 'C', 'D', 'E'))"
_SQUEEZED = "regexp_replace({0}, ' ', '', 'g')"

SQL = {
    "scl01_normal_answers": f"WITH {_ANSWERED} SELECT annotation_id, p AS answer FROM r",
    "scl02_numbers": f"WITH {_ANSWERED} SELECT annotation_id, number FROM n",
    "scl03_joi19_matches": f"WITH {_ANSWERED} SELECT annotation_id, method <> 'unmatched_requires_review' AS match, method FROM m",
    "scl04_partial_credit": f"""WITH {_ANSWERED} SELECT annotation_id, round(CASE WHEN method <> 'unmatched_requires_review' THEN 1.0::DOUBLE ELSE least(0.9999::DOUBLE, greatest(0.0::DOUBLE, coalesce(list_max(list_transform(list_filter(numbers, lambda x: x IS NOT NULL AND starts_with(x, '-') = starts_with(number, '-')),
        lambda x: 1 - abs(CAST(x AS DOUBLE) - CAST(number AS DOUBLE)) / greatest(abs(CAST(x AS DOUBLE)), abs(CAST(number AS DOUBLE))))), 0.0))) END, 6) AS score FROM m""",
    "scl04_mean_credit": f"""WITH {_ANSWERED} SELECT round(avg(CASE WHEN method <> 'unmatched_requires_review' THEN 1.0::DOUBLE ELSE round(least(0.9999::DOUBLE, greatest(0.0::DOUBLE, coalesce(list_max(list_transform(list_filter(numbers, lambda x: x IS NOT NULL AND starts_with(x, '-') = starts_with(number, '-')),
        lambda x: 1 - abs(CAST(x AS DOUBLE) - CAST(number AS DOUBLE)) / greatest(abs(CAST(x AS DOUBLE)), abs(CAST(number AS DOUBLE))))), 0.0))), 6) END), 6) AS score FROM m""",
    "scl07_benchmark_scores": rf"""WITH {_ANSWERED}, k AS (SELECT *, {_loose('p', True)} AS chart, {_each(lambda c: _loose(c, True))} AS charts, {_loose('p')} AS plain, {_each(_loose)} AS plains FROM m),
        s AS (SELECT annotation_id, CASE WHEN p IS NULL THEN 'invalid_format' WHEN method <> 'unmatched_requires_review' THEN method
        WHEN data_source = 'pier_sheets' THEN CASE WHEN len(list_filter(charts, lambda g: abs(chart - g) <= abs(g) * 0.05::DOUBLE)) > 0 THEN 'chartqa_numeric_5pct' ELSE 'unmatched' END
        WHEN data_source = 'shop_receipts' THEN CASE WHEN len(list_filter(goals, lambda g: {_SQUEEZED.format('g')} <> '' AND contains({_SQUEEZED.format('p')}, {_SQUEEZED.format('g')}))) > 0 THEN 'ocrbench_substring' ELSE 'unmatched' END
        WHEN annotation_id % 2 = 0 AND len(list_filter({_LETTERS}, lambda c: regexp_full_match(p, '(option|choice|answer( is)?)\s*[::]?\s*' || lower(c)))) > 0 THEN 'mathverse_choice_letter'
        WHEN len(list_filter(plains, lambda g: g = plain)) > 0 THEN 'mathverse_numeric_exact' ELSE 'unmatched' END AS method FROM k)
        SELECT annotation_id, method NOT IN ('invalid_format', 'unmatched') AS correct, method FROM s""",
    "scl09_says_something": r"SELECT doc_id, coalesce(length(regexp_replace(text, '[\s\p{Z}\x{85}.…]', '', 'g')) > 0, FALSE) AS something FROM documents",
    "scl11_answer_candidates": f"SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '(?s)<answer>.*?</answer>')) = 1 THEN nullif({_BARE}, '') END AS candidate FROM documents",
    "scl14_placeholders": "SELECT doc_id, CAST(coalesce((length(text) - length(replace(text, '<image>', ''))) // 7, 0) AS INTEGER) AS images FROM documents",
    "prj10_prj11_targets": """SELECT DISTINCT annotation_id, '<think>' || coalesce(region_annotation.answer_from_image, '') || '</think>' || chr(10) || chr(10) || '<tool_call>{"name":"request_local_region","arguments":{"bbox_2d":[1,2,3,4]}}</tool_call>' AS target FROM annotations""",
    "scl57_inspection": """SELECT doc_id, text AS raw_completion, CASE WHEN ends_with(rtrim(text, ' '), '>') THEN 'stop' WHEN text IS NOT NULL THEN 'length' END AS finish_reason, CAST(len(string_split(coalesce(text, ''), ' ')) AS INTEGER) AS generated_tokens,
        string_split(text, ' ')[1] AS first_token, coalesce(starts_with(text, '<think>'), FALSE) AS starts_with_think, coalesce(contains(text, '</think>'), FALSE) AS has_closing_think FROM documents WHERE source IN ('rollout_log', 'sft_target')""",
}
