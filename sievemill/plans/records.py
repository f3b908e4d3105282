"""Queries of projections, integrity checks and replays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, shape
from ..functions.normal import hash_value, normal_flag, normal_group_key, normal_split, trimmed
from ..operators import labels, passages, sampling, turns
from ..operators.metrics import mean, rounded
from ..session import table
from ..sources import files

SEED = 7101


def _records(spark, d):
    return table(spark, d, "manifest").distinct()


def _annotations(spark, d):
    return labels.annotations_once(table(spark, d, "annotations"))


def _evals(spark, d):
    return table(spark, d, "eval_record").distinct()


def prj02(spark, d):
    """The 29 columns of a manifest, made from the source's fields; nested source information as JSON."""
    made = F.format_string("smart-%s-%05d", F.replace("source_key", F.lit("smart_"), F.lit("")), F.col("source_row_id"))
    rows = _records(spark, d).filter("source_row_id IS NOT NULL AND source_key IS NOT NULL").withColumn("sample_id", made)
    at = lambda folder, end: F.concat(F.lit(f"{folder}/"), F.col("sample_id"), F.lit(end))
    plain = ["source", "source_revision", "source_access", "source_shard", "source_row_in_shard", "source_row_id", "doc_id", "selection_seed", "selection_score", "data_source", "width", "height", "source_image_size", "lowres_size", "image_sha256", "source_bytes_sha256", "pixel_sha256", "dhash", "question", "answers", "original_answer"]
    return rows.select(
        "sample_id",
        *plain,
        normal_group_key().alias("group_id"),
        normal_split().alias("split"),
        F.lit(False).alias("formal_split_audit_pending"),
        F.to_json("source_info", {"ignoreNullFields": "false"}).alias("source_info"),
        at("images", ".png").alias("image_path"),
        at("originals", ".bin").alias("original_bytes_path"),
        at("lowres", ".png").alias("lowres_path"),
    )


def _trajectories(spark, d):
    """Annotations as trajectories: by the tool where the source says so and there is a box."""
    first = lambda c: F.get(c, F.lit(0))
    rows = _annotations(spark, d).filter("annotation_id IS NOT NULL AND sample_id IS NOT NULL")
    box = first("region_annotation.reference_boxes_pixels")
    tool = F.coalesce(normal_flag("source_info.use_tool"), F.lit(False)) & geometry.is_pixel_box(box, F.col("width"), F.col("height"))
    return rows.select(
        "annotation_id",
        "sample_id",
        F.when(tool, "tool").otherwise("direct").alias("route"),
        "question",
        first("answers").alias("answer"),
        F.col("lowres_path").alias("low_path"),
        F.concat(F.lit("crops/"), "sample_id", F.lit(".png")).alias("crop_path"),
        F.col("lowres_size").alias("low_size"),
        first("lowres_size").alias("low_width"),
        F.get("lowres_size", F.lit(1)).alias("low_height"),
        box.alias("box"),
        "width",
        "height",
    )


def prj08(spark, d):
    return turns.turns(_trajectories(spark, d), "annotation_id").select("annotation_id", "route", "turn_index", "stage", F.sha2("prompt", 256).alias("prompt"), "images", "target")


def src17(spark, d):
    return turns.loader_checks(turns.turns(_trajectories(spark, d).filter("question IS NOT NULL"), "annotation_id"), "annotation_id")


def prj12(spark, d):
    """Thoughts of all questions, rewritten."""
    text, log = turns.rewritten(turns.thought(F.coalesce("question", F.lit(""))))
    return _records(spark, d).select("sample_id", "batch_no", text.alias("thought"), log.alias("log"))


def prj16(spark, d):
    names = ["dockqa", "signbench", "dialset", "sheetprobe", "streetyn"]
    return _evals(spark, d).filter("sample_id IS NOT NULL").groupBy("sample_id").agg(*[rounded(F.max(F.when(F.col("dataset") == n, F.col("vision_ratio")))).alias(n) for n in names])


def flt10(spark, d):
    """First drift of each trajectory from its source: what batch 0 delivered, and the sample's last label."""
    least = lambda c, n: F.min(c).alias(n)
    fields = table(spark, d, "manifest").filter("batch_no = 0 AND sample_id IS NOT NULL").groupBy("sample_id").agg(
        least("question", "s_question"), least(F.get("answers", F.lit(0)), "s_answer"), least("lowres_size", "s_low_size"), least("width", "s_width"), least("height", "s_height"), least(normal_split(), "s_split"), least(normal_flag("use_tool"), "s_flag")
    )
    last = labels.latest(table(spark, d, "annotations"), F.get("region_annotation.reference_boxes_pixels", F.lit(0)).alias("s_box"), F.col("quality_checks.region_reward_eligible").alias("s_eligible"))
    rows = _trajectories(spark, d).join(fields, "sample_id", "left").join(last, "sample_id", "left")
    return rows.select("annotation_id", "route", turns.drift().alias("drift"))


def joi04(spark, d):
    """Samples whose last label carries another fingerprint than their first one."""
    rows = _annotations(spark, d).filter("sample_id IS NOT NULL").groupBy("sample_id").agg(F.min_by("annotation_meta.request_fingerprint", "annotation_id").alias("a"), F.max_by("annotation_meta.request_fingerprint", "annotation_id").alias("b"))
    return rows.select("sample_id", F.col("a").eqNullSafe(F.col("b")).alias("same"))


def joi10(spark, d):
    """Documents without a line of at least 30 characters that a bench_card has too."""
    lines = table(spark, d, "documents").select("doc_id", "source", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).filter(F.length("line") >= 30).select("doc_id", "source", F.xxhash64("line").alias("h"))
    held = lines.filter("source = 'bench_card'").select("h").distinct()
    hit = lines.filter("source <> 'bench_card'").join(held, "h", "left_semi").select("doc_id").distinct()
    return table(spark, d, "documents").filter("source <> 'bench_card'").select("doc_id").join(hit, "doc_id", "left_anti")


def joi10_passages(spark, d):
    """Documents without a passage of a bench_card, wherever in their lines it stands."""
    return passages.without_passages(table(spark, d, "documents"), F.col("source") == "bench_card", "doc_id", "text").select("doc_id")


def joi11(spark, d):
    """Rows of the shards that validation samples point at, each looked up once."""
    wanted = _records(spark, d).filter("source_key = 'smart_val'").select("source_shard", "source_row_in_shard").distinct()
    return _records(spark, d).join(wanted, ["source_shard", "source_row_in_shard"], "left_semi").groupBy("source_key").agg(F.count("*").alias("n"))


def joi16(spark, d):
    rows = _annotations(spark, d).select("annotation_id", F.col("region_annotation.reference_boxes_pixels").alias("b")).filter(F.size("b") > 1)
    a, b = F.get("b", F.lit(0)), F.get("b", F.lit(1))
    return rows.filter(a.isNotNull() & b.isNotNull()).select("annotation_id", shape.first_mismatch(a, b).alias("place"))


def joi17(spark, d):
    """Mean difference of each pair of data sets over their common samples; the pairs are those of a sample's own rows."""
    rows = _evals(spark, d).filter("sample_id IS NOT NULL AND vision_ratio IS NOT NULL").groupBy("sample_id", "dataset").agg(F.max("vision_ratio").alias("v"))
    each = rows.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("dataset", "v"))).alias("s"))
    pairs = each.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).filter("a.dataset < b.dataset")
    return pairs.groupBy(F.col("a.dataset").alias("a"), F.col("b.dataset").alias("b")).agg(F.count("*").alias("n"), mean(F.col("b.v") - F.col("a.v")).alias("delta"))


def joi21(spark, d):
    """Annotations that repeat a delivered record in every identifying field, NULLs being equal."""
    keys = ["sample_id", "question", "width", "height", "image_sha256"]
    a = _annotations(spark, d).select("annotation_id", *keys)
    b = table(spark, d, "manifest").filter("sample_id IS NOT NULL").select(*[F.col(k).alias(f"m_{k}") for k in keys]).distinct()
    same = a["sample_id"] == b["m_sample_id"]
    for k in keys[1:]:
        same &= a[k].eqNullSafe(b[f"m_{k}"])
    return a.join(b, same, "left_semi").select("annotation_id")


def agg11(spark, d):
    """One row a sample, its first record, then rates."""
    first = _evals(spark, d).filter("sample_id IS NOT NULL").groupBy("sample_id").agg(F.min_by(F.struct("correct", "used_tool"), "eval_id").alias("r"))
    return first.agg(F.count("*").alias("n"), mean("r.correct").alias("accuracy"), mean("r.used_tool").alias("tool_rate"))


def win15(spark, d):
    words = F.split(F.coalesce("question", F.lit("")), " ")
    return _records(spark, d).select("sample_id", "batch_no", F.concat_ws(" ", shape.context(words, F.lit(3), 2)).alias("context"))


def set05(spark, d):
    old = table(spark, d, "manifest").filter("batch_no = 0 AND sample_id IS NOT NULL").groupBy("sample_id").agg(F.max("batch_no").alias("batch_no"))
    new = table(spark, d, "manifest").filter("batch_no > 0 AND sample_id IS NOT NULL").groupBy("sample_id").agg(F.max("batch_no").alias("batch_no"))
    return labels.replaced(old, new, "sample_id").groupBy("batch_no").agg(F.count("*").alias("n"))


def scl13(spark, d):
    return _records(spark, d).groupBy(turns.thought(F.coalesce("question", F.lit(""))).alias("thought")).agg(F.count("*").alias("n"))


def smp08(spark, d):
    answer = F.lower(trimmed(F.get("answers", F.lit(0))))
    return sampling.yes_no_pairs(_records(spark, d).withColumn("image", normal_group_key()), ["source_key"], "image", answer, "sample_id", 5, SEED).select("source_key", "image", "yes_id", "no_id", "rank")


def smp07(spark, d):
    rows = _records(spark, d).withColumn("image", hash_value("pixel_sha256", 64))
    return sampling.scarcest_first(rows, "data_source", "image", "sample_id", {"pier_sheets": 20, "shop_receipts": 20, "lab_dials": 20}, SEED).select("data_source", "image", "sample_id")


def smp09(spark, d):
    """Pictures of the training split are forbidden, as in smp06."""
    rows = _records(spark, d).withColumn("image", hash_value("pixel_sha256", 64))
    forbidden = rows.filter(normal_split() == "train").select("image").filter("image IS NOT NULL")
    return sampling.distinct_versions(rows, "source_key", "question", "sample_id", ["smart_val", "smart_train"], 30, SEED, "image", forbidden).select("source_key", "question", "sample_id")


def srt05(spark, d):
    """Hinted ones first, in the order of arrival: the first 20 of a probe."""
    rows = _records(spark, d).filter("sample_id IS NOT NULL").select("sample_id", "batch_no", F.coalesce(F.lower(trimmed("use_tool")).isin("true", "1"), F.lit(False)).alias("hint"))
    return rows.orderBy(F.desc("hint"), "batch_no", "sample_id").limit(20)


QUERIES = {
    "prj02_manifest": prj02,
    "prj08_turns": prj08,
    "prj12_rewrites": prj12,
    "src17_turn_loader": src17,
    "prj16_pivot": prj16,
    "flt10_drift": flt10,
    "flt11_paths": lambda s, d: _records(s, d).groupBy(shape.under(F.col("image_path"), "images").alias("inside")).agg(F.count("*").alias("n")),
    "flt13_slice": lambda s, d: _evals(s, d).filter("used_tool AND eval_id IS NOT NULL").orderBy("eval_id").offset(5).limit(20).select("eval_id"),
    "joi04_fingerprints": joi04,
    "joi06_sources": lambda s, d: _annotations(s, d).join(table(s, d, "manifest").filter("sample_id IS NOT NULL").groupBy("sample_id").agg(F.max("batch_no").alias("last_batch")), "sample_id").select("annotation_id", "last_batch"),
    "joi10_decontaminated": joi10,
    "joi10_passages": joi10_passages,
    "joi11_lookups": joi11,
    "joi16_scl50_mismatches": joi16,
    "joi17_phase_pairs": joi17,
    "joi21_replays": joi21,
    "agg11_training_metrics": agg11,
    "win15_context": win15,
    "set05_replaced": set05,
    "scl13_thoughts": scl13,
    "smp07_scarcest_first": smp07,
    "smp08_yes_no_pairs": smp08,
    "smp09_distinct_versions": smp09,
    "srt05_priority": srt05,
    "snk08_summary": lambda s, d: files.summary(_evals(s, d).select("eval_id", "dataset"), ["dataset"]).select("rows", "strata"),
}

_M = "m AS (SELECT DISTINCT * FROM manifest)"
_A = "a AS (SELECT DISTINCT ON (annotation_id) * FROM annotations)"
_E = "e AS (SELECT DISTINCT * FROM eval_record)"
# The names of a path with its dots resolved; a step out of the base leaves '/' at the front for good.
_RESOLVED = """list_reduce(list_transform(list_filter(string_split(image_path, '/'), lambda x: x NOT IN ('', '.')), lambda x: [x]),
    lambda a, x: CASE WHEN x[1] <> '..' OR coalesce(a[1] = '/', FALSE) THEN a || x WHEN len(a) = 0 THEN ['/'] ELSE a[:-2] END, CAST([] AS VARCHAR[]))"""

_SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]"
_HEX = rf"regexp_replace(regexp_replace(lower(regexp_replace(pixel_sha256, '{_SPACE}+', '', 'g')), '^([a-z][a-z0-9_-]*[:=])?(0x)?', ''), '^0+(.)', '\1')"
_GROUP = f"""coalesce(nullif(lower(regexp_replace(group_key, '{_SPACE}+', '', 'g')), ''), 'doc:' || nullif(regexp_replace(doc_id, '^{_SPACE}+|{_SPACE}+$', '', 'g'), ''),
    'image:' || CASE WHEN regexp_full_match({_HEX}, '[0-9a-f]{{1,64}}') THEN lpad({_HEX}, 64, '0') END)"""
_LOW = f"lower(regexp_replace(split, '^{_SPACE}+|{_SPACE}+$', '', 'g'))"
_SPLIT = f"CASE WHEN {_LOW} = 'training' THEN 'train' WHEN {_LOW} IN ('valid', 'validation', 'dev') THEN 'val' WHEN {_LOW} = 'testing' THEN 'test' ELSE nullif({_LOW}, '') END"
_FLAG = f"lower(regexp_replace(use_tool, '^{_SPACE}+|{_SPACE}+$', '', 'g'))"
_BOX = "region_annotation.reference_boxes_pixels[1]"
_IS_BOX = f"coalesce(len({_BOX}) = 4 AND len(list_filter({_BOX}, lambda v: v IS NULL OR v < 0)) = 0 AND {_BOX}[1] < {_BOX}[3] AND {_BOX}[2] < {_BOX}[4] AND {_BOX}[3] <= width AND {_BOX}[4] <= height, FALSE)"
_T = f"""t AS (SELECT annotation_id, sample_id, CASE WHEN coalesce(lower(regexp_replace(source_info.use_tool, '^{_SPACE}+|{_SPACE}+$', '', 'g')) IN ('true', '1'), FALSE) AND {_IS_BOX} THEN 'tool' ELSE 'direct' END AS route, question, answers[1] AS answer,
    lowres_path AS low_path, lowres_size AS low_size, lowres_size[1] AS low_width, lowres_size[2] AS low_height, {_BOX} AS box, width, height FROM a WHERE annotation_id IS NOT NULL AND sample_id IS NOT NULL)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _says(words: list[str]) -> str:
    return " OR ".join(f"contains(lower(question), '{w}')" for w in words)


_THOUGHT = "CASE" + "".join(f" WHEN {_says(words)} THEN {_quoted(t)}" for t, words in turns.THOUGHTS.items()) + f" ELSE {_quoted(turns.OTHER_THOUGHT)} END"

SQL = {
    "prj02_manifest": f"""WITH {_M}, r AS (SELECT *, 'smart-' || replace(source_key, 'smart_', '') || '-' || printf('%05d', source_row_id) AS made FROM m WHERE source_row_id IS NOT NULL AND source_key IS NOT NULL)
        SELECT made AS sample_id, source, source_revision, source_access, source_shard, source_row_in_shard, source_row_id, doc_id, selection_seed, selection_score, data_source, width, height, source_image_size, lowres_size, image_sha256, source_bytes_sha256, pixel_sha256, dhash,
        question, answers, original_answer, {_GROUP} AS group_id, {_SPLIT} AS split, FALSE AS formal_split_audit_pending, to_json(source_info)::VARCHAR AS source_info, 'images/' || made || '.png' AS image_path, 'originals/' || made || '.bin' AS original_bytes_path, 'lowres/' || made || '.png' AS lowres_path FROM r""",
    "prj08_turns": f"""WITH {_A}, {_T}, u AS (SELECT *, 0 AS i FROM t UNION ALL SELECT *, 1 FROM t WHERE route = 'tool')
        SELECT annotation_id, route, CAST(i AS INTEGER) AS turn_index, CASE i WHEN 0 THEN 'decision' ELSE 'answer_after_tool' END AS stage,
        sha256(CASE i WHEN 0 THEN replace(replace(replace({_quoted(turns.FIRST)}, '{{width}}', CAST(low_width AS VARCHAR)), '{{height}}', CAST(low_height AS VARCHAR)), '{{question}}', question) ELSE replace({_quoted(turns.SECOND)}, '{{question}}', question) END) AS prompt,
        CASE i WHEN 0 THEN [low_path] ELSE [low_path, 'crops/' || sample_id || '.png'] END AS images,
        CASE WHEN i = 1 THEN '<think>The region shows the answer.</think>' || chr(10) || chr(10) || '<answer>' || coalesce(answer, '') || '</answer>' WHEN route = 'tool' THEN '<think>' || replace({_THOUGHT}, 'marked region', 'relevant region') || '</think>' || chr(10) || chr(10) ||
        '<tool_call>{{"name":"request_local_region","arguments":{{"bbox_2d":[' || box[1] * 1000 // width || ',' || box[2] * 1000 // height || ',' || (box[3] * 1000 + width - 1) // width || ',' || (box[4] * 1000 + height - 1) // height || ']}}}}</tool_call>'
        ELSE '<think>The picture shows the answer.</think>' || chr(10) || chr(10) || '<answer>' || coalesce(answer, '') || '</answer>' END AS target FROM u""",
    "src17_turn_loader": f"""WITH {_A}, {_T}, q AS (SELECT * FROM t WHERE question IS NOT NULL) SELECT 'unknown turn' AS rule, CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'lone first turn', 0 UNION ALL SELECT 'repeated turn', 0
        UNION ALL SELECT 'placeholders', (SELECT count(*) FILTER (WHERE low_width IS NULL OR low_height IS NULL OR contains(question, '<image>')) + count(*) FILTER (WHERE route = 'tool' AND contains(question, '<image>')) FROM q)""",
    "prj12_rewrites": f"""WITH {_M}, x AS (SELECT sample_id, batch_no, {_THOUGHT} AS t FROM m) SELECT sample_id, batch_no, replace(t, 'marked region', 'relevant region') AS thought,
        CASE WHEN contains(t, 'marked region') THEN ['Replaced ''marked region'' with ''relevant region''.'] ELSE [] END AS log FROM x""",
    "prj16_pivot": f"WITH {_E} SELECT sample_id, {', '.join(f'''round(max(vision_ratio) FILTER (WHERE dataset = '{n}'), 6) AS {n}''' for n in ('dockqa', 'signbench', 'dialset', 'sheetprobe', 'streetyn'))} FROM e WHERE sample_id IS NOT NULL GROUP BY 1",
    "flt10_drift": f"""WITH {_A}, {_T}, s AS (SELECT sample_id, min(question) AS sq, min(answers[1]) AS sa, min(lowres_size) AS sl, min(width) AS sw, min(height) AS sh, min({_SPLIT}) AS ss, min(CASE WHEN {_FLAG} IN ('true', '1') THEN TRUE WHEN {_FLAG} IN ('false', '0') THEN FALSE END) AS sf
            FROM manifest WHERE batch_no = 0 AND sample_id IS NOT NULL GROUP BY 1),
        l AS (SELECT sample_id, arg_max({{'b': region_annotation.reference_boxes_pixels[1], 'e': quality_checks.region_reward_eligible}}, {{'t': annotated_at, 'i': annotation_id}}) AS l FROM annotations WHERE sample_id IS NOT NULL GROUP BY 1),
        j AS (SELECT t.*, s.*, l.l.b AS sb, l.l.e AS se FROM t LEFT JOIN s ON s.sample_id = t.sample_id LEFT JOIN l ON l.sample_id = t.sample_id)
        SELECT annotation_id, route, CASE WHEN ss IS DISTINCT FROM 'train' THEN 'not a training source' WHEN answer IS DISTINCT FROM sa OR answer IS NULL THEN 'gold answer' WHEN question IS DISTINCT FROM sq THEN 'question'
        WHEN low_size IS DISTINCT FROM sl OR width IS DISTINCT FROM sw OR height IS DISTINCT FROM sh THEN 'picture size' WHEN route = 'tool' AND NOT coalesce(sf, FALSE) THEN 'no tool hint' WHEN route = 'tool' AND NOT coalesce(se, FALSE) THEN 'no verified region'
        WHEN route = 'tool' AND box IS DISTINCT FROM sb THEN 'source box' WHEN route <> 'tool' AND coalesce(sf, TRUE) THEN 'unexpected tool hint' END AS drift FROM j""",
    "flt11_paths": f"WITH {_M}, r AS (SELECT image_path, {_RESOLVED} AS r FROM m) SELECT coalesce(NOT starts_with(image_path, '/') AND r[1] = 'images' AND len(r) > 1, FALSE) AS inside, count(*) AS n FROM r GROUP BY 1",
    "flt13_slice": f"WITH {_E} SELECT eval_id FROM e WHERE used_tool AND eval_id IS NOT NULL ORDER BY eval_id OFFSET 5 LIMIT 20",
    "joi04_fingerprints": f"WITH {_A}, f AS (SELECT sample_id, first(annotation_meta.request_fingerprint ORDER BY annotation_id) AS x, last(annotation_meta.request_fingerprint ORDER BY annotation_id) AS y FROM a WHERE sample_id IS NOT NULL GROUP BY 1) SELECT sample_id, x IS NOT DISTINCT FROM y AS same FROM f",
    "joi06_sources": f"WITH {_A}, s AS (SELECT sample_id, max(batch_no) AS last_batch FROM manifest WHERE sample_id IS NOT NULL GROUP BY 1) SELECT annotation_id, last_batch FROM a JOIN s USING (sample_id)",
    "joi10_decontaminated": """WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT * FROM l WHERE length(line) >= 30)
        SELECT doc_id FROM documents WHERE source <> 'bench_card' AND doc_id NOT IN (SELECT doc_id FROM k WHERE source <> 'bench_card' AND line IN (SELECT line FROM k WHERE source = 'bench_card'))""",
    "joi11_lookups": f"WITH {_M} SELECT source_key, count(*) AS n FROM m WHERE EXISTS (SELECT 1 FROM m v WHERE v.source_key = 'smart_val' AND v.source_shard = m.source_shard AND v.source_row_in_shard = m.source_row_in_shard) GROUP BY 1",
    "joi16_scl50_mismatches": f"""WITH {_A}, r AS (SELECT annotation_id, region_annotation.reference_boxes_pixels[1] AS a, region_annotation.reference_boxes_pixels[2] AS b FROM a WHERE len(region_annotation.reference_boxes_pixels) > 1)
        SELECT annotation_id, CAST(list_filter(range(0, greatest(len(a), len(b))), lambda i: a[i + 1] IS DISTINCT FROM b[i + 1] OR i >= len(a) OR i >= len(b))[1] AS INTEGER) AS place FROM r WHERE a IS NOT NULL AND b IS NOT NULL""",
    "joi17_phase_pairs": f"""WITH {_E}, r AS (SELECT sample_id, dataset, max(vision_ratio) AS v FROM e WHERE sample_id IS NOT NULL AND vision_ratio IS NOT NULL GROUP BY 1, 2)
        SELECT a.dataset AS a, b.dataset AS b, count(*) AS n, round(avg(b.v - a.v), 6) AS delta FROM r a JOIN r b ON a.sample_id = b.sample_id AND a.dataset < b.dataset GROUP BY 1, 2""",
    "joi21_replays": f"""WITH {_A} SELECT annotation_id FROM a WHERE EXISTS (SELECT 1 FROM manifest m WHERE m.sample_id = a.sample_id AND m.question IS NOT DISTINCT FROM a.question AND m.width IS NOT DISTINCT FROM a.width
        AND m.height IS NOT DISTINCT FROM a.height AND m.image_sha256 IS NOT DISTINCT FROM a.image_sha256)""",
    "agg11_training_metrics": f"WITH {_E}, f AS (SELECT sample_id, arg_min({{'c': correct, 't': used_tool}}, eval_id) AS r FROM e WHERE sample_id IS NOT NULL GROUP BY 1) SELECT count(*) AS n, round(avg(CAST(r.c AS DOUBLE)), 6) AS accuracy, round(avg(CAST(r.t AS DOUBLE)), 6) AS tool_rate FROM f",
    "win15_context": f"WITH {_M} SELECT sample_id, batch_no, array_to_string(string_split(coalesce(question, ''), ' ')[2:6], ' ') AS context FROM m",
    "set05_replaced": "SELECT batch_no, count(*) AS n FROM (SELECT sample_id, max(batch_no) AS batch_no FROM manifest WHERE sample_id IS NOT NULL AND batch_no IS NOT NULL GROUP BY 1) GROUP BY 1",
    "scl13_thoughts": f"WITH {_M} SELECT {_THOUGHT} AS thought, count(*) AS n FROM m GROUP BY 1",
    "snk08_summary": f"""WITH {_E}, c AS (SELECT coalesce(dataset, '') AS k, count(*) AS n FROM e GROUP BY dataset) SELECT CAST(sum(n) AS BIGINT) AS rows, '{{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}}' AS strata FROM c""",
    "smp08_yes_no_pairs": f"""WITH {_M}, r AS (SELECT source_key, {_GROUP} AS image, lower(regexp_replace(answers[1], '^{_SPACE}+|{_SPACE}+$', '', 'g')) AS a, sample_id, sha256('{SEED}:' || sample_id) AS digest FROM m WHERE sample_id IS NOT NULL),
        p AS (SELECT source_key, image, arg_min(sample_id, digest) FILTER (WHERE a = 'yes') AS yes_id, arg_min(sample_id, digest) FILTER (WHERE a = 'no') AS no_id FROM r WHERE image IS NOT NULL GROUP BY 1, 2)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY sha256('{SEED}:' || image)) AS rank FROM p WHERE yes_id IS NOT NULL AND no_id IS NOT NULL) WHERE rank <= 5""",
    "srt05_priority": f"WITH {_M} SELECT sample_id, batch_no, coalesce(lower(trim(use_tool, ' \t\n\r')) IN ('true', '1'), FALSE) AS hint FROM m WHERE sample_id IS NOT NULL ORDER BY hint DESC, batch_no, sample_id LIMIT 20",
}
