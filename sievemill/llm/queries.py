"""Queries of the problems in this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from ..session import table
from . import bpe, history, mixture, quota_sample, splits, stable_sample, truncation


def _quota(spark, d):
    return quota_sample.QuotaSample(table(spark, d, "annotations"), table(spark, d, "manifest"), table(spark, d, "sample_plan"))


def _mixture(spark, d):
    return mixture.Mixture(table(spark, d, "documents"), table(spark, d, "source_weight"))


QUERIES = {
    "p1_found": history.rejected,
    "p1_accepted": lambda spark, d: history.checked(table(spark, d, "manifest"))[0],
    "p2_found": lambda spark, d: stable_sample.wrong_scores(table(spark, d, "manifest")),
    "p2_sample": lambda spark, d: stable_sample.sample(table(spark, d, "manifest")),
    "p2_sample_up_to_batch_4": lambda spark, d: stable_sample.sample(table(spark, d, "manifest"), up_to_batch=4),
    "p3_found": lambda spark, d: _quota(spark, d).short(),
    "p3_sample": lambda spark, d: _quota(spark, d).chosen().select("sample_id", "family", "area", "use_tool", "rank"),
    "p3_report": lambda spark, d: _quota(spark, d).report,
    "p4_found": lambda spark, d: splits.GroupSplits(table(spark, d, "manifest")).disagreeing(),
    "p4_splits": lambda spark, d: splits.GroupSplits(table(spark, d, "manifest")).assigned(),
    "p6_ids": lambda spark, d: bpe.encode(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids"),
    "p6_decoded": lambda spark, d: bpe.decode(bpe.encode(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")).select("doc_id", "decoded"),
    "p7_documents": lambda spark, d: _mixture(spark, d).documents_used(),
    "p7_shares": lambda spark, d: _mixture(spark, d).report(),
    "p7_marginals": lambda spark, d: _mixture(spark, d).marginals(),
    "p8_found": lambda spark, d: truncation.cut_documents(table(spark, d, "documents")),
    "p8_sources": lambda spark, d: truncation.by_source(table(spark, d, "documents")),
    "p8_evidence": lambda spark, d: truncation.by_evidence(table(spark, d, "documents")),
}

_SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]"
_HASH = rf"regexp_replace(regexp_replace(lower(regexp_replace(pixel_sha256, '{_SPACE}+', '', 'g')), '^([a-z][a-z0-9_-]*[:=])?(0x)?', ''), '^0+(.)', '\1')"
_GROUP = f"""coalesce(nullif(lower(regexp_replace(group_key, '{_SPACE}+', '', 'g')), ''),
    'doc:' || nullif(regexp_replace(doc_id, '^{_SPACE}+|{_SPACE}+$', '', 'g'), ''),
    CASE WHEN regexp_full_match({_HASH}, '[0-9a-f]{{1,64}}') THEN 'image:' || lpad({_HASH}, 64, '0') END)"""
_LOW_SPLIT = f"lower(regexp_replace(split, '^{_SPACE}+|{_SPACE}+$', '', 'g'))"
_SPLIT = f"""CASE WHEN {_LOW_SPLIT} = 'training' THEN 'train' WHEN {_LOW_SPLIT} IN ('valid', 'validation', 'dev') THEN 'val'
    WHEN {_LOW_SPLIT} = 'testing' THEN 'test' ELSE nullif({_LOW_SPLIT}, '') END"""
_UNIT = "CAST('0x' || substr(sha256('{salt}' || chr(31) || {key}), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE)"


def _sample_sql(where: str) -> str:
    unit = _UNIT.format(salt=stable_sample.SALT, key='"group"')
    return f"""WITH g AS (SELECT DISTINCT sample_id, coalesce({_GROUP}, 'sample:' || sample_id) AS "group" FROM manifest {where})
        SELECT sample_id, "group", {unit} AS unit FROM g WHERE {unit} < {stable_sample.RATE}"""


_WORD = r"[^\p{L}\p{N}_]"
_FAMILIES = "".join(f" WHEN regexp_matches(q, '(^|{_WORD})({'|'.join(words)})($|{_WORD})') THEN '{name}'" for name, words in quota_sample.FAMILY_WORDS.items())
_AREAS = "".join(f" WHEN lowres_size[1] * lowres_size[2] <= {limit} THEN '{name}'" for name, limit in quota_sample.AREA_LIMITS.items())
_FOLD = "lower(question)"
for _a, _b in quota_sample.FOLDED.items():
    _FOLD = f"replace({_FOLD}, '{_a}', '{_b}')"
_FLAG = f"lower(regexp_replace(use_tool, '^{_SPACE}+|{_SPACE}+$', '', 'g'))"
_ELIGIBLE = f"""asked AS (SELECT sample_id, min({{'family': family, 'area': area}}) AS c FROM (
        SELECT sample_id, CASE{_FAMILIES} ELSE 'other' END AS family, CASE{_AREAS} ELSE 'very_large' END AS area
        FROM (SELECT *, {_FOLD} AS q FROM annotations) WHERE sample_id IS NOT NULL AND regexp_replace(question, '{_SPACE}+', '', 'g') <> ''
        AND len(lowres_size) = 2 AND lowres_size[1] > 0 AND lowres_size[2] > 0) GROUP BY sample_id),
    flagged AS (SELECT sample_id, max({{'batch_no': coalesce(batch_no, -1), 'flag': {_FLAG} IN ('true', '1')}}).flag AS use_tool FROM manifest
        WHERE {_FLAG} IN ('true', '1', 'false', '0') AND sample_id IS NOT NULL GROUP BY sample_id),
    eligible AS (SELECT sample_id, c.family AS family, c.area AS area, use_tool FROM asked JOIN flagged USING (sample_id)),
    size AS (SELECT 2 * count(*) // 5 AS s FROM eligible),
    plan AS (SELECT family, area, use_tool, max(target_per_mille) AS t, max(min_rows) AS f FROM sample_plan GROUP BY ALL)"""
_PLANNED = """counted AS (SELECT p.*, CAST(count(e.sample_id) AS BIGINT) AS eligible, greatest(p.f, (any_value(s) * p.t + 999) // 1000) AS needed
    FROM plan p CROSS JOIN size LEFT JOIN eligible e ON p.family = e.family AND p.area = e.area AND p.use_tool = e.use_tool GROUP BY p.family, p.area, p.use_tool, p.t, p.f)"""
_CHOSEN = f"""ranked AS (SELECT e.*, t, f, row_number() OVER (PARTITION BY e.family, e.area, e.use_tool ORDER BY {_UNIT.format(salt=quota_sample.SALT, key="sample_id")}, sample_id) AS rank
        FROM eligible e JOIN plan p ON p.family = e.family AND p.area = e.area AND p.use_tool = e.use_tool),
    seated AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN rank <= f THEN 0 ELSE 1 END, (rank - 0.5) / CAST(t AS DOUBLE), family, area, use_tool) AS seat FROM ranked),
    chosen AS (SELECT sample_id, family, area, use_tool, rank FROM seated, size WHERE seat <= s)"""

SQL = {
    "p2_found": f"""WITH r AS (SELECT sample_id, batch_no, nullif(lower(regexp_replace(selection_score, '^{_SPACE}+|{_SPACE}+$', '', 'g')), '') AS score, selection_seed, replacement_meta,
            {_SPLIT} AS split, {_GROUP} AS g FROM manifest)
        SELECT DISTINCT sample_id, batch_no FROM r WHERE split IS NOT NULL AND (score IS NULL OR score IS DISTINCT FROM
            sha256(CAST(selection_seed AS VARCHAR) || chr(31) || CASE WHEN replacement_meta IS NOT NULL THEN 'train-replacement' ELSE split END || chr(31) || g))""",
    "p2_sample": _sample_sql(""),
    "p2_sample_up_to_batch_4": _sample_sql("WHERE batch_no <= 4"),
    "p3_found": f"WITH {_ELIGIBLE}, {_PLANNED} SELECT family, area, CAST(use_tool AS VARCHAR) AS use_tool FROM counted WHERE eligible < needed",
    "p3_sample": f"WITH {_ELIGIBLE}, {_CHOSEN} SELECT * FROM chosen",
    "p3_report": f"""WITH {_ELIGIBLE}, {_PLANNED}, {_CHOSEN}
        SELECT c.family, c.area, c.use_tool, CAST(t AS BIGINT) AS target_per_mille, CAST(f AS BIGINT) AS min_rows, eligible, CAST(needed AS BIGINT) AS needed, CAST(count(x.sample_id) AS BIGINT) AS taken
        FROM counted c LEFT JOIN chosen x ON c.family = x.family AND c.area = x.area AND c.use_tool = x.use_tool GROUP BY ALL""",
    "p4_found": f"SELECT group_key FROM (SELECT {_GROUP} AS group_key, {_SPLIT} AS split FROM manifest) WHERE group_key IS NOT NULL GROUP BY group_key HAVING count(DISTINCT split) > 1",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS decoded FROM documents",
}
