"""Queries of data set construction over the manifest."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.hashing import stable_score
from ..functions.normal import blank_to_null, hash_long, hash_value, normal_flag, normal_group_key, normal_split, trimmed
from ..functions.strata import FAMILY_WORDS, FOLDED, area_bucket, question_family
from ..operators import conflicts, sampling, selection, sequence, turns
from ..operators.metrics import rounded
from ..session import Workspace, table

SEED = 7101


def _records(spark, d):
    """The manifest's records without exact copies, one row a (sample_id, batch_no) unless its copies differ."""
    return table(spark, d, "manifest").distinct()


def _samples(spark, d):
    """One row a sample: the smallest question, its family and area bucket."""
    rows = table(spark, d, "manifest").filter("sample_id IS NOT NULL").groupBy("sample_id").agg(F.min("question").alias("question"), F.min("lowres_size").alias("size"), F.min("source_key").alias("source_key"))
    return rows.select("sample_id", "source_key", F.coalesce(question_family("question"), F.lit("none")).alias("family"), F.coalesce(area_bucket("size"), F.lit("none")).alias("area"))


def flt01(spark, d):
    reason = (
        F.when(blank_to_null(trimmed(F.coalesce("question", F.lit("")))).isNull() | F.col("answers").isNull(), "missing_image_question_or_solution")
        .when(hash_value("pixel_sha256", 64).isNull(), "invalid_image")
        .when(F.coalesce(F.col("source_info.tgt_width"), F.lit(0)) == 0, "missing_target_size")
    )
    return _records(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def agg04(spark, d):
    return table(spark, d, "manifest").agg(F.count("sample_id").alias("rows"), F.count_distinct("sample_id").alias("samples"), F.count_distinct("image_path").alias("images"))


def prj01(spark, d):
    return _records(spark, d).select("sample_id", "batch_no", F.coalesce(trimmed(F.replace("question", F.lit("<image>"), F.lit(""))), F.lit("")).alias("question"), normal_group_key().alias("group_key"))


def prj03(spark, d):
    env = F.struct("sample_id", normal_split().alias("split"), "question", F.coalesce("answers", F.array().cast("array<string>")).alias("answers"), F.coalesce(normal_flag("use_tool"), F.lit(False)).alias("source_use_tool"))
    return _records(spark, d).select("sample_id", "batch_no", F.to_json(F.struct(env.alias("env_kwargs")), {"ignoreNullFields": "false"}).alias("row"))


def prj06(spark, d):
    return _records(spark, d).select("sample_id", "batch_no", F.coalesce(blank_to_null(F.col("question")), F.get("answers", F.lit(0)), F.lit("")).alias("first_truthy"), F.coalesce("original_answer", F.get("answers", F.lit(0))).alias("first_present"))


def prj07(spark, d):
    kept = F.filter(F.transform("answers", lambda a: trimmed(a)), lambda a: a != "")
    return _records(spark, d).select("sample_id", "batch_no", F.coalesce(kept, F.array().cast("array<string>")).alias("answers"))


def prj09(spark, d):
    text = turns.prompt("Picture of {width} by {height} pixels.\nQuestion: {question}", F.col("question"), F.get("lowres_size", F.lit(0)), F.get("lowres_size", F.lit(1)))
    return _records(spark, d).filter((F.size("lowres_size") == 2) & F.forall("lowres_size", lambda v: v.isNotNull()) & F.col("question").isNotNull()).select("sample_id", "batch_no", text.alias("prompt"))


def agg03(spark, d):
    rows = selection.representatives(selection.candidates(table(spark, d, "manifest")), SEED)
    score = stable_score(SEED, F.col("source_key"), F.col("group_key"), F.col("source_row_id").cast("string"))
    return rows.select("source_key", "group_key", score.alias("score"))


def win03(spark, d):
    rows = _records(spark, d).filter("source_row_in_shard IS NOT NULL")
    shards = rows.groupBy("source_key", "source_shard").agg((F.max("source_row_in_shard") + 1).alias("n"))
    # One row a shard.
    before = Window.partitionBy("source_key").orderBy("source_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.select("source_key", "source_shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return rows.join(offsets, ["source_key", "source_shard"]).select("sample_id", "batch_no", (F.col("offset") + F.col("source_row_in_shard")).alias("global_row_id"))


def win04(spark, d):
    rows = table(spark, d, "manifest").select("source_key", "sample_id").filter("sample_id IS NOT NULL").distinct()
    return sequence.sequence_number(rows, ["source_key"], [F.col("sample_id")]).select("source_key", "sample_id", F.col("number").cast("bigint").alias("number"))


def win11(spark, d):
    rows = table(spark, d, "eval_record").select("eval_id").filter("eval_id IS NOT NULL").distinct()
    return sequence.blocks(rows, [], [F.col("eval_id")], 8).select("eval_id", F.col("block").cast("bigint").alias("block"))


def win12(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey")
    return sequence.padded(rows, [F.col("n_nationkey")], 12)


def win05(spark, d):
    return sampling.ranked(_samples(spark, d), ["source_key"], "sample_id", SEED).select("source_key", "sample_id", "rank")


def agg31(spark, d):
    counts = _samples(spark, d).groupBy("family", "area").agg(F.count("*").alias("n"))
    return sampling.largest_remainder(counts, ["family", "area"], 300)


def smp11(spark, d):
    return sampling.proportional(_samples(spark, d), ["family", "area"], "sample_id", 300, SEED).select("sample_id", "family", "area", "rank")


def win13(spark, d):
    return sampling.round_robin(_samples(spark, d), "family", "sample_id", SEED)


def smp06(spark, d):
    rows = _records(spark, d).select("sample_id", hash_value("pixel_sha256", 64).alias("image"))
    forbidden = _records(spark, d).filter(normal_split() == "train").select(hash_value("pixel_sha256", 64).alias("image")).filter("image IS NOT NULL")
    return sampling.unique_images(rows, "image", "sample_id", 50, SEED, forbidden)


def joi07(spark, d):
    rows = _records(spark, d).select("sample_id", "batch_no", normal_group_key().alias("group_key"), normal_split().alias("split"))
    held = rows.filter("split = 'test'").select("group_key").filter("group_key IS NOT NULL").distinct()
    return rows.filter("split = 'train'").join(held, "group_key", "left_anti").select("sample_id", "batch_no")


def joi08(spark, d):
    rows = _records(spark, d).select("sample_id", "batch_no", hash_value("pixel_sha256", 64).alias("pixel"), normal_split().alias("split"))
    held = rows.filter("split IN ('val', 'test') AND pixel IS NOT NULL").select("pixel").distinct()
    return rows.filter("split = 'train'").join(held, "pixel", "left_anti").select("sample_id", "batch_no")


def joi09(spark, d):
    """Each distinct difference hash and the number of other ones within four bits."""
    hashes = _records(spark, d).select(hash_long(hash_value("dhash", 16)).alias("dhash")).filter("dhash IS NOT NULL").distinct()
    links = conflicts.near_links(conflicts.placed_in_cells(hashes))
    ends = links.select(F.explode(F.array("a", "b")).alias("dhash")).groupBy("dhash").agg(F.count("*").alias("links"))
    return hashes.join(ends, "dhash", "left").select("dhash", F.coalesce("links", F.lit(0)).alias("links"))


def _selected(spark, d):
    """Splits as large as the smallest tables allow, in the reference's order."""
    rows = table(spark, d, "manifest")
    n = rows.filter("source_key = 'smart_val'").select(F.count_distinct(normal_group_key()).alias("n")).head()["n"]
    return selection.splits(rows, {"test": max(1, n // 4), "val": max(1, n // 8), "train": max(2, n // 2)}, SEED, {True: max(1, n // 4), False: max(1, n // 4)})


def smp02(spark, d):
    return _selected(spark, d).select("split", "group_key", "sample_id", "selection_score", "flag")


def audit(spark, d):
    """Violations among the records as delivered, which are many."""
    return selection.audit(selection.candidates(table(spark, d, "manifest")).select("group_key", "pixel", "dhash").distinct())


def smp04(spark, d):
    rows = table(spark, d, "manifest").filter("replacement_meta IS NOT NULL AND sample_id IS NOT NULL")
    invalid = rows.select("sample_id", F.coalesce(normal_flag("use_tool"), F.lit(False)).alias("flag")).groupBy("sample_id").agg(F.max("flag").alias("flag"))
    return selection.replacements(table(spark, d, "manifest"), invalid, SEED + 1, rank_seed=SEED)


def set04(spark, d):
    """Differences between the sets of batch 0 and later samples."""
    rows = table(spark, d, "manifest")
    old, new = rows.filter("batch_no = 0").select("sample_id"), rows.filter("batch_no > 0").select("sample_id")
    return old.subtract(new).agg(F.count("*").alias("only_old")).join(new.subtract(old).agg(F.count("*").alias("only_new")))


QUERIES = {
    "smp01_stable_scores": lambda s, d: _records(s, d).select("sample_id", "batch_no", stable_score(SEED, "sample_id").alias("score")),
    "agg01_counts": lambda s, d: _records(s, d).groupBy("source_key", normal_split().alias("split")).agg(F.count("*").alias("n")),
    "flt01_agg02_rejections": flt01,
    "flt02_flags": lambda s, d: _records(s, d).groupBy(selection.exclusive(F.col("use_tool")).alias("flag")).agg(F.count("*").alias("n")),
    "agg03_representatives": agg03,
    "agg04_uniqueness": agg04,
    "prj01_candidates": prj01,
    "prj03_env_rows": prj03,
    "prj06_first_present": prj06,
    "prj07_answer_lists": prj07,
    "prj09_prompts": prj09,
    "prj19_agg26_strata": lambda s, d: _samples(s, d).groupBy("family", "area").agg(F.count("*").alias("n")),
    "win03_global_row_ids": win03,
    "win04_sequence": win04,
    "win05_hash_ranks": win05,
    "agg31_win06_quotas": agg31,
    "smp11_win07_proportional": smp11,
    "win11_blocks": win11,
    "win12_padded": win12,
    "win13_round_robin": win13,
    "smp06_unique_images": smp06,
    "joi07_free_groups": joi07,
    "joi08_free_images": joi08,
    "joi09_scl43_near_hashes": joi09,
    "smp02_smp03_splits": smp02,
    "agg04_joi09_audit": audit,
    "smp04_joi12_replacements": smp04,
    "set04_differences": set04,
    "srt03_slice": lambda s, d: table(s, d, "eval_record").select("eval_id").filter("eval_id IS NOT NULL").distinct().orderBy("eval_id").offset(10).limit(25),
    "scl26_area_buckets": lambda s, d: _records(s, d).groupBy(area_bucket("lowres_size").alias("bucket")).agg(F.count("*").alias("n")),
    "scl12_question_families": lambda s, d: _records(s, d).groupBy(question_family("question").alias("family")).agg(F.count("*").alias("n")),
    "scl40_text_digests": lambda s, d: table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest")),
    "agg24_longest": lambda s, d: table(s, d, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct(F.coalesce(F.length("text"), F.lit(-1)), -F.col("doc_id"))).alias("doc_id")),
    "agg09_bytes": lambda s, d: table(s, d, "documents").groupBy("source").agg(rounded(F.avg(F.octet_length("text"))).alias("mean_bytes")),
}

_SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _hash(c: str, n: int) -> str:
    bare = rf"regexp_replace(regexp_replace(lower(regexp_replace({c}, '{_SPACE}+', '', 'g')), '^([a-z][a-z0-9_-]*[:=])?(0x)?', ''), '^0+(.)', '\1')"
    return f"CASE WHEN regexp_full_match({bare}, '[0-9a-f]{{1,{n}}}') THEN lpad({bare}, {n}, '0') END"


_BARE = "replace(question, '<image>', '')"
_M = "m AS (SELECT DISTINCT * FROM manifest)"
_GROUP = f"coalesce(nullif(lower(regexp_replace(group_key, '{_SPACE}+', '', 'g')), ''), 'doc:' || nullif({_trim('doc_id')}, ''), 'image:' || {_hash('pixel_sha256', 64)})"
_LOW = f"lower({_trim('split')})"
_SPLIT = f"CASE WHEN {_LOW} = 'training' THEN 'train' WHEN {_LOW} IN ('valid', 'validation', 'dev') THEN 'val' WHEN {_LOW} = 'testing' THEN 'test' ELSE nullif({_LOW}, '') END"
_FLAG = f"lower({_trim('use_tool')}) IN ('true', '1')"
_EDGE = r"[^\p{L}\p{N}_]"


def _family(c: str) -> str:
    text = f"lower({c})"
    for a, b in FOLDED.items():
        text = f"replace({text}, '{a}', '{b}')"
    return f"CASE WHEN {c} IS NULL THEN NULL" + "".join(f" WHEN regexp_matches({text}, '(^|{_EDGE})({'|'.join(w)})($|{_EDGE})') THEN '{n}'" for n, w in FAMILY_WORDS.items()) + " ELSE 'other' END"


def _area(c: str) -> str:
    return f"CASE WHEN coalesce(len({c}) = 2 AND {c}[1] > 0 AND {c}[2] > 0, FALSE) THEN CASE WHEN {c}[1] * {c}[2] <= 65536 THEN 'small' WHEN {c}[1] * {c}[2] <= 262144 THEN 'medium' WHEN {c}[1] * {c}[2] <= 1048576 THEN 'large' ELSE 'very_large' END END"


_S = f"""g AS (SELECT sample_id, min(question) AS question, min(lowres_size) AS size, min(source_key) AS source_key FROM manifest WHERE sample_id IS NOT NULL GROUP BY 1),
    s AS (SELECT sample_id, source_key, coalesce({_family('question')}, 'none') AS family, coalesce({_area('size')}, 'none') AS area FROM g)"""
_RANKED = f"SELECT *, row_number() OVER (PARTITION BY {{by}} ORDER BY sha256('{SEED}:' || sample_id)) AS rank FROM s"
_QUOTA = """c AS (SELECT family, area, count(*) AS n FROM s GROUP BY 1, 2), x AS (SELECT *, CAST(sum(n) OVER () AS BIGINT) AS a FROM c), y AS (SELECT *, 300 * n // a AS w, 300 * n % a AS r FROM x),
    q AS (SELECT family, area, n, CAST(w + CASE WHEN row_number() OVER (ORDER BY r DESC, family, area) <= 300 - sum(w) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM y)"""
_HASHES = f"h AS (SELECT DISTINCT CAST('0x' || {_hash('dhash', 16)} AS UBIGINT) AS u FROM manifest WHERE {_hash('dhash', 16)} IS NOT NULL)"

SQL = {
    "smp01_stable_scores": f"WITH {_M} SELECT sample_id, batch_no, sha256('{SEED}' || chr(31) || sample_id) AS score FROM m",
    "agg01_counts": f"WITH {_M} SELECT source_key, {_SPLIT} AS split, count(*) AS n FROM m GROUP BY 1, 2",
    "flt01_agg02_rejections": f"""WITH {_M} SELECT CASE WHEN coalesce({_trim('question')}, '') = '' OR answers IS NULL THEN 'missing_image_question_or_solution' WHEN {_hash('pixel_sha256', 64)} IS NULL THEN 'invalid_image'
        WHEN coalesce(source_info.tgt_width, 0) = 0 THEN 'missing_target_size' END AS reason, count(*) AS n FROM m GROUP BY 1""",
    "flt02_flags": f"WITH {_M} SELECT coalesce(lower(use_tool) IN ('true', '1'), FALSE) AS flag, count(*) AS n FROM m GROUP BY 1",
    "agg03_representatives": f"""WITH r AS (SELECT source_key, {_GROUP} AS group_key, source_row_id FROM manifest) SELECT source_key, group_key, min(sha256('{SEED}' || chr(31) || source_key || chr(31) || group_key || chr(31) || source_row_id)) AS score
        FROM r WHERE group_key IS NOT NULL GROUP BY 1, 2""",
    "agg04_uniqueness": "SELECT count(sample_id) AS rows, count(DISTINCT sample_id) AS samples, count(DISTINCT image_path) AS images FROM manifest",
    "prj01_candidates": f"WITH {_M} SELECT sample_id, batch_no, coalesce({_trim(_BARE)}, '') AS question, {_GROUP} AS group_key FROM m",
    "prj03_env_rows": f"""WITH {_M} SELECT sample_id, batch_no, to_json({{'env_kwargs': {{'sample_id': sample_id, 'split': {_SPLIT}, 'question': question, 'answers': coalesce(answers, []), 'source_use_tool': coalesce({_FLAG}, FALSE)}}}})::VARCHAR AS row FROM m""",
    "prj06_first_present": f"WITH {_M} SELECT sample_id, batch_no, coalesce(nullif(question, ''), answers[1], '') AS first_truthy, coalesce(original_answer, answers[1]) AS first_present FROM m",
    "prj07_answer_lists": f"WITH {_M} SELECT sample_id, batch_no, coalesce(list_filter(list_transform(answers, lambda a: {_trim('a')}), lambda a: a <> ''), []) AS answers FROM m",
    "prj09_prompts": f"WITH {_M} SELECT sample_id, batch_no, 'Picture of ' || lowres_size[1] || ' by ' || lowres_size[2] || ' pixels.' || chr(10) || 'Question: ' || question AS prompt FROM m WHERE len(lowres_size) = 2 AND lowres_size[1] IS NOT NULL AND lowres_size[2] IS NOT NULL AND question IS NOT NULL",
    "prj19_agg26_strata": f"WITH {_S} SELECT family, area, count(*) AS n FROM s GROUP BY 1, 2",
    "win03_global_row_ids": f"""WITH {_M}, r AS (SELECT * FROM m WHERE source_row_in_shard IS NOT NULL), c AS (SELECT source_key, source_shard, max(source_row_in_shard) + 1 AS n FROM r GROUP BY 1, 2),
        o AS (SELECT source_key, source_shard, coalesce(sum(n) OVER (PARTITION BY source_key ORDER BY source_shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM c)
        SELECT sample_id, batch_no, CAST(f + source_row_in_shard AS BIGINT) AS global_row_id FROM r JOIN o USING (source_key, source_shard)""",
    "win04_sequence": "SELECT source_key, sample_id, row_number() OVER (PARTITION BY source_key ORDER BY sample_id) AS number FROM (SELECT DISTINCT source_key, sample_id FROM manifest WHERE sample_id IS NOT NULL)",
    "win05_hash_ranks": f"WITH {_S} SELECT source_key, sample_id, rank FROM ({_RANKED.format(by='source_key')})",
    "agg31_win06_quotas": f"WITH {_S}, {_QUOTA} SELECT * FROM q",
    "smp11_win07_proportional": f"WITH {_S}, {_QUOTA} SELECT sample_id, family, area, rank FROM ({_RANKED.format(by='family, area')}) JOIN q USING (family, area) WHERE rank <= quota",
    "win11_blocks": "SELECT eval_id, (row_number() OVER (ORDER BY eval_id) - 1) // 8 AS block FROM (SELECT DISTINCT eval_id FROM eval_record WHERE eval_id IS NOT NULL)",
    "win12_padded": "WITH r AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS i, count(*) OVER () AS n FROM nation) SELECT n_nationkey, FALSE AS padding FROM r UNION ALL SELECT n_nationkey, TRUE FROM r WHERE i <= (12 - n % 12) % 12",
    "win13_round_robin": f"WITH {_S} SELECT family, sample_id, rank AS turn FROM ({_RANKED.format(by='family')}) WHERE rank <= (SELECT min(n) FROM (SELECT count(*) AS n FROM s GROUP BY family))",
    "smp06_unique_images": f"""WITH {_M}, r AS (SELECT sample_id, {_hash('pixel_sha256', 64)} AS image, {_SPLIT} AS split FROM m), b AS (SELECT DISTINCT image FROM r WHERE split = 'train' AND image IS NOT NULL)
        SELECT image, arg_min(sample_id, digest) AS sample_id, min(digest) AS digest FROM (SELECT *, sha256('{SEED}:' || sample_id) AS digest FROM r WHERE image IS NOT NULL AND sample_id IS NOT NULL AND image NOT IN (SELECT image FROM b)) GROUP BY 1 ORDER BY digest LIMIT 50""",
    "joi07_free_groups": f"WITH {_M}, r AS (SELECT sample_id, batch_no, {_GROUP} AS g, {_SPLIT} AS split FROM m) SELECT sample_id, batch_no FROM r WHERE split = 'train' AND NOT EXISTS (SELECT 1 FROM r t WHERE t.split = 'test' AND t.g = r.g)",
    "joi08_free_images": f"WITH {_M}, r AS (SELECT sample_id, batch_no, {_hash('pixel_sha256', 64)} AS p, {_SPLIT} AS split FROM m) SELECT sample_id, batch_no FROM r WHERE split = 'train' AND NOT EXISTS (SELECT 1 FROM r t WHERE t.split IN ('val', 'test') AND t.p = r.p)",
    "joi09_scl43_near_hashes": f"""WITH {_HASHES}, l AS (SELECT a.u AS a, b.u AS b FROM h a JOIN h b ON a.u <> b.u AND bit_count(xor(a.u, b.u)) <= 4)
        SELECT CASE WHEN h.u >= 9223372036854775808 THEN CAST(CAST(h.u AS HUGEINT) - 18446744073709551616 AS BIGINT) ELSE CAST(h.u AS BIGINT) END AS dhash, count(l.b) AS links FROM h LEFT JOIN l ON l.a = h.u GROUP BY h.u""",
    "agg04_joi09_audit": f"""WITH r AS (SELECT DISTINCT {_GROUP} AS g, {_hash('pixel_sha256', 64)} AS p, CAST('0x' || {_hash('dhash', 16)} AS UBIGINT) AS h FROM manifest), s AS (SELECT * FROM r WHERE g IS NOT NULL), d AS (SELECT DISTINCT h FROM s WHERE h IS NOT NULL)
        SELECT 'group' AS "check", count(*) AS violations FROM (SELECT g FROM s GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'pixel', count(*) FROM (SELECT p FROM s WHERE p IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
        UNION ALL SELECT 'dhash', count(*) FROM (SELECT h FROM s WHERE h IS NOT NULL GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'near', count(*) FROM d a JOIN d b ON a.h < b.h AND bit_count(xor(a.h, b.h)) <= 4""",
    "set04_differences": "SELECT (SELECT count(*) FROM (SELECT sample_id FROM manifest WHERE batch_no = 0 EXCEPT SELECT sample_id FROM manifest WHERE batch_no > 0)) AS only_old, (SELECT count(*) FROM (SELECT sample_id FROM manifest WHERE batch_no > 0 EXCEPT SELECT sample_id FROM manifest WHERE batch_no = 0)) AS only_new",
    "srt03_slice": "SELECT DISTINCT eval_id FROM eval_record WHERE eval_id IS NOT NULL ORDER BY eval_id OFFSET 10 LIMIT 25",
    "scl26_area_buckets": f"WITH {_M} SELECT {_area('lowres_size')} AS bucket, count(*) AS n FROM m GROUP BY 1",
    "scl12_question_families": f"WITH {_M} SELECT {_family('question')} AS family, count(*) AS n FROM m GROUP BY 1",
    "scl40_text_digests": "SELECT doc_id, sha256(text) AS digest FROM documents",
    "agg24_longest": "SELECT source, arg_max(doc_id, {'n': coalesce(length(text), -1), 'd': -doc_id}) AS doc_id FROM documents GROUP BY 1",
    "agg09_bytes": "SELECT source, round(avg(strlen(text)), 6) AS mean_bytes FROM documents GROUP BY 1",
}
