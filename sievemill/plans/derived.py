"""Queries of derived values, constraints and run control that have none elsewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import actions, answers, derived, geometry, shape
from ..functions.normal import hash_value, normal_flag, normal_split
from ..functions.strata import area_bucket
from ..operators import checks, labels, metrics, sampling, sequence, trajectory
from ..operators.metrics import rounded
from ..session import table
from ..sources import files, images
from ..streaming import state

SEED = 7101


def _records(spark, d):
    return table(spark, d, "manifest").distinct()


def _evals(spark, d):
    return metrics.records(table(spark, d, "eval_record"))


def _read(spark, d):
    """What the annotations read in the pictures."""
    return labels.annotations_once(table(spark, d, "annotations")).select("annotation_id", F.col("region_annotation.answer_from_image").alias("answer"))


def flt03(spark, d):
    """Only true and false themselves; other spellings are no flag."""
    flag = F.when(F.col("use_tool") == "true", True).when(F.col("use_tool") == "false", False)
    return _records(spark, d).groupBy(flag.alias("flag")).agg(F.count("*").alias("n"))


def flt07(spark, d):
    valid = F.coalesce("used_tool", F.lit(False)) & metrics.finite("vision_ratio", "vision_ratio_true")
    return _evals(spark, d).select("eval_id", valid.alias("valid"))


def agg14(spark, d):
    """Evaluation records as trajectories of a decision and, with the tool, an answer; every decision has a padding copy."""
    rows = _evals(spark, d).filter("eval_id IS NOT NULL")
    same = [F.col("eval_id").alias("traj_uid"), "sample_id", F.col("vision_tokens_low_first").alias("low"), F.col("vision_tokens_crop").alias("crop"), F.col("vision_tokens_processed").alias("processed"), F.col("vision_tokens_full").alias("full")]
    decision = rows.select(*same, F.lit("decision").alias("stage"), F.when(F.col("used_tool"), F.col("tool_reward")).otherwise(F.col("outcome_reward")).alias("reward"))
    answer = rows.filter("used_tool").select(*same, F.lit("answer_after_tool").alias("stage"), F.col("outcome_reward").alias("reward"))
    copies = decision.withColumn("padding", F.lit(True))
    steps = decision.unionByName(answer).withColumn("padding", F.lit(False)).unionByName(copies)
    out = trajectory.assembled(steps)
    return out.select("traj_uid", "sample_id", "used_tool", rounded(F.col("outcome")).alias("outcome"), rounded(F.col("tool_reward")).alias("tool_reward"), "acquired", "processed", "full", "sound")


def agg13(spark, d):
    deviation = F.stddev_samp("outcome_reward")
    return _evals(spark, d).filter("sample_id IS NOT NULL").groupBy("sample_id").agg(rounded(F.coalesce(F.when(deviation > trajectory.EPSILON, deviation), F.lit(0.0))).alias("deviation"))


def agg25(spark, d):
    return checks.group_counts(table(spark, d, "sample_plan").filter("use_tool IS NOT NULL"), "use_tool", {True: 24, False: 24})


def srt02(spark, d):
    rows = table(spark, d, "manifest").select("sample_id").filter("sample_id IS NOT NULL").distinct()
    return rows.withColumn("digest", sampling.rank_digest("sample_id", SEED)).orderBy("digest")


def srt04(spark, d):
    """The first 25 of each source by hash: ranked, so no source is sorted in one task."""
    rows = table(spark, d, "manifest").select("source_key", "sample_id").distinct()
    return sampling.ranked(rows, ["source_key"], "sample_id", SEED).filter("rank <= 25").select("source_key", "sample_id", "rank")


def src19(spark, d):
    """Orders as checkpoints of their customers' runs."""
    path = F.concat(F.lit("runs/"), F.col("o_custkey"), F.lit("/global_step_"), F.col("o_orderkey"))
    steps = table(spark, d, "orders").select(F.col("o_custkey").alias("run"), path.alias("path"), (F.col("o_orderstatus") == "F").alias("complete"))
    return files.latest_complete(steps)


def scl10(spark, d):
    return table(spark, d, "documents").select("doc_id", actions.unwrapped_of("text").alias("content"))


def scl28(spark, d):
    rows = _evals(spark, d).filter("sample_id IS NOT NULL")
    rows = rows.select("eval_id", "sample_id", "used_tool", F.col("correct").cast("double").alias("accuracy"), F.lit(None).cast("double").alias("answer_score"), (F.col("format_compliance") / 10).alias("format_reward"))
    return trajectory.rewarded(rows, "sample_id").select("eval_id", rounded(F.col("balance_reward")).alias("balance_reward"), rounded(F.col("outcome_reward")).alias("outcome_reward"))


def scl32(spark, d):
    """Events as steps of runs of 100, or of unknown length."""
    total = derived.total_steps(F.when(F.col("event_id") % 7 == 0, -1).otherwise(0), F.when(F.col("event_id") % 5 > 0, 100).otherwise(0))
    left = derived.remaining(F.col("value"), F.col("event_id") % 130, total)
    return table(spark, d, "events").select("event_id", total.alias("total"), rounded(left["percent"]).alias("percent"), rounded(left["seconds"], 3).alias("seconds"), rounded(left["total_hours"]).alias("total_hours"))


def scl34(spark, d):
    score = derived.format_score(F.col("final_answer_valid"), F.col("first_action_valid"), F.when(F.col("used_tool"), "tool").otherwise("answer"), F.lit("tool"))
    return _evals(spark, d).groupBy("dataset").agg(metrics.mean(score).alias("format_score"))


def _sized(spark, d):
    return table(spark, d, "manifest").select("width", "height").filter("width > 0 AND height > 0").distinct()


def scl47(spark, d):
    w, h = F.col("width"), F.col("height")
    whole = lambda c: F.transform(c, lambda v: v.cast("bigint"))
    return _sized(spark, d).select("width", "height", whole(images.half_size(w, h)).alias("half"), whole(images.within_budget(w, h, 65536)).alias("budget"), whole(images.padded_size(w, F.lit(3).cast("bigint"))).alias("padded"))


def scl49(spark, d):
    grid = F.array(F.lit(1).cast("bigint"), F.ceil(F.col("height") / 14).cast("bigint"), F.ceil(F.col("width") / 14).cast("bigint"))
    return _sized(spark, d).select("width", "height", images.vision_tokens(grid).cast("bigint").alias("tokens"))


def scl54(spark, d):
    """Pixel boxes read as 0-1000 boxes and executed."""
    rows = labels.annotations_once(table(spark, d, "annotations")).select("annotation_id", "width", "height", F.get("region_annotation.reference_boxes_pixels", F.lit(0)).alias("box"))
    rows = rows.filter(F.coalesce((F.size("box") == 4) & F.forall("box", lambda v: v.isNotNull()) & (F.col("width") > 0) & (F.col("height") > 0), F.lit(False)))
    crop = derived.executed_crop(F.col("box"), F.col("width"), F.col("height"))
    return rows.select("annotation_id", crop["pixels"].alias("pixels"), F.transform(crop["executed"], lambda v: F.round(v, 9)).alias("executed"))


def scl58(spark, d):
    """Every document as a prompt with one picture: expanded if it has one placeholder, else an error, here NULL."""
    expanded = derived.expanded(F.col("text"), F.array(F.lit("picture")), "<|image|>")
    return table(spark, d, "documents").select("doc_id", F.sha2(expanded, 256).alias("digest"))


def flt16(spark, d):
    counts = F.transform(F.coalesce("answers", F.array().cast("array<string>")), lambda a: F.array(F.length(a)))
    texts = F.filter(F.coalesce("answers", F.array().cast("array<string>")), lambda a: a.isNotNull())
    return _records(spark, d).groupBy(derived.sound_response(texts, counts).alias("sound")).agg(F.count("*").alias("n"))


def str06(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("step"), (F.col("n_nationkey") % 3 != 1).alias("complete"))
    return state.removable(rows, 2).select(F.col("step").cast("bigint").alias("step"))


def str10(spark, d):
    """Records that used the tool, eight to a batch of second turns."""
    rows = _evals(spark, d).filter("used_tool AND eval_id IS NOT NULL").select("eval_id").distinct()
    return sequence.blocks(rows, [], [F.col("eval_id")], 8, "batch").select("eval_id", F.col("batch").cast("bigint").alias("batch"))


def prj04(spark, d):
    image = F.struct(F.col("text").cast("binary").alias("bytes"), F.col("source").alias("name"))
    rows = table(spark, d, "documents").select("doc_id", image.alias("image"))
    path = shape.only_blob(rows.schema)
    more = rows.withColumn("more", F.array(F.col("image.bytes")))
    return more.select("doc_id", F.lit(path).alias("path"), shape.without_bytes(F.col("image"), rows.schema["image"].dataType)["name"].alias("name"), F.get(shape.without_bytes(F.col("more"), more.schema["more"].dataType), F.lit(0))["binary_length"].alias("length"))


def prj18(spark, d):
    names = shape.known_names("smart_val, smart_train", ["smart_train", "smart_val", "bench"])
    return _records(spark, d).filter(F.col("source_key").isin(names)).groupBy("source_key").agg(F.count("*").alias("n"))


def flt14(spark, d):
    """The first unit box's left side, only where the two pixel boxes before it are the same."""
    rows = labels.annotations_once(table(spark, d, "annotations")).select("annotation_id", F.col("region_annotation.reference_boxes_pixels").alias("b"), F.col("region_annotation.reference_boxes").alias("u"))
    looked = shape.aligned(F.get("b", F.lit(0)), F.get("b", F.lit(1)), F.get(F.get("u", F.lit(0)), F.lit(0)))
    return rows.select("annotation_id", F.round(looked, 9).alias("value"))


def flt15(spark, d):
    """The plan's rows as configurations: a share within 0 to 1000, a minimum of at most 30, and no minimum where there is no share."""
    rows = table(spark, d, "sample_plan")
    problem = checks.first_problem({"share out of range": ~F.col("target_per_mille").between(0, 1000), "minimum above 30": F.col("min_rows") > 30, "minimum without a share": (F.col("target_per_mille") == 0) & (F.col("min_rows") > 0)})
    return rows.select("family", "area", "use_tool", problem.alias("problem"))


def str04(spark, d):
    """Data sets as phases of a validation that each must have every sample of the largest once."""
    rows = _evals(spark, d).filter("sample_id IS NOT NULL AND dataset IS NOT NULL").select("dataset", "sample_id")
    return checks.phases(rows, "dataset", "sample_id", 500)


def smp15(spark, d):
    rows = _records(spark, d).select("data_source", "sample_id", hash_value("pixel_sha256", 64).alias("image"))
    return checks.plan_report(rows, "data_source", {"pier_sheets": 100, "shop_receipts": 100, "lab_dials": 10**9}, ["sample_id", "image"])


def src14(spark, d):
    """First labels as the cache, last ones as what is wanted now."""
    rows = labels.annotations_once(table(spark, d, "annotations")).filter("sample_id IS NOT NULL AND annotation_id IS NOT NULL")
    own = F.struct("annotation_id", F.col("annotation_meta.request_fingerprint").alias("f"))
    each = rows.groupBy("sample_id").agg(F.min(own).alias("a"), F.max(own).alias("b"))
    cache = each.filter("a.f IS NOT NULL").select("sample_id", F.col("a.f").alias("fingerprint"))
    return checks.cache_states(each.select("sample_id", F.col("b.f").alias("fingerprint")), cache, "sample_id", "fingerprint")


def joi10_hashes(spark, d):
    """Evaluation records with none of the training records' byte and pixel hashes."""
    rows = _records(spark, d).select("sample_id", "batch_no", normal_split().alias("split"), *[hash_value(c, 64).alias(c) for c in ("image_sha256", "source_bytes_sha256", "pixel_sha256")])
    held = rows.filter("split = 'train'")
    return labels.without_hashes(rows.filter("split IN ('val', 'test')"), held, [["image_sha256", "source_bytes_sha256"], ["pixel_sha256"]]).select("sample_id", "batch_no").distinct()


def prj15(spark, d):
    return labels.reviewed(table(spark, d, "annotations"), table(spark, d, "review_edit"))


def smp14(spark, d):
    rows = table(spark, d, "manifest").filter("sample_id IS NOT NULL").groupBy("sample_id").agg(F.coalesce(F.max(normal_flag("use_tool")), F.lit(False)).alias("flag"), F.coalesce(F.min(area_bucket("lowres_size")), F.lit("none")).alias("area"))
    rows = rows.select("sample_id", F.concat_ws("/", F.col("flag").cast("string"), "area").alias("stratum"))
    return sampling.round_robin(rows, "stratum", "sample_id", SEED, shortest=False).filter("turn <= 4")


def smp13(spark, d):
    names = ["dockqa", "signbench", "dialset", "sheetprobe", "streetyn"]
    return spark.createDataFrame([(n, str(sampling.name_seed(SEED, n))) for n in names], "dataset string, seed string")


QUERIES = {
    "flt03_strict_flags": flt03,
    "flt07_valid_tokens": flt07,
    "agg14_flt08_joi15_trajectories": agg14,
    "agg13_deviations": agg13,
    "agg15_token_sums": lambda s, d: _evals(s, d).groupBy("dataset", "used_tool").agg(F.sum("vision_tokens_acquired").alias("tokens")),
    "agg25_group_counts": agg25,
    "win14_first_of_trajectory": lambda s, d: _evals(s, d).filter("sample_id IS NOT NULL AND eval_id IS NOT NULL").groupBy("sample_id").agg(F.min("eval_id").alias("eval_id")),
    "srt01_sorted": lambda s, d: table(s, d, "review_edit").select("sample_id", "verdict").distinct().orderBy("sample_id", "verdict"),
    "srt02_hash_order": srt02,
    "srt04_first_ranks": srt04,
    "src19_srt06_latest_steps": src19,
    "set01_union": lambda s, d: _records(s, d).filter(normal_split() == "test").select("sample_id").unionByName(_records(s, d).filter(normal_split() == "val").select("sample_id")).unionByName(_records(s, d).filter(normal_split() == "train").select("sample_id")),
    "scl05_benchmark_texts": lambda s, d: _read(s, d).select("annotation_id", answers.benchmark_text_of("answer").alias("answer")),
    "scl06_benchmark_numbers": lambda s, d: _read(s, d).select("annotation_id", answers.loose_number_of("answer").alias("number")),
    "scl10_unwrapped": scl10,
    "scl16_rebased": lambda s, d: _records(s, d).select("sample_id", "batch_no", derived.rebased(F.concat(F.lit("data/"), "image_path"), "/pool/set").alias("path")),
    "scl28_outcome_rewards": scl28,
    "scl32_scl55_remaining": scl32,
    "scl34_scl56_format_scores": scl34,
    "scl44_request_fingerprints": lambda s, d: table(s, d, "events").select("event_id", derived.request_fingerprint("props").alias("fingerprint")),
    "scl45_46_47_sizes": scl47,
    "scl49_vision_tokens": scl49,
    "scl54_crops": scl54,
    "scl58_expanded": scl58,
    "flt16_sound_responses": flt16,
    "str03_recorder": lambda s, d: state.recorder(table(s, d, "nation").select((F.col("n_nationkey") + 1).alias("step")), 25),
    "str06_removable": str06,
    "str07_missing": lambda s, d: state.missing(table(s, d, "manifest").select("sample_id").distinct(), table(s, d, "annotations"), "sample_id"),
    "str10_second_turns": str10,
    "prj04_prj05_blobs": prj04,
    "prj18_known_names": prj18,
    "prj15_reviewed": prj15,
    "flt14_aligned": flt14,
    "flt15_constraints": flt15,
    "str04_phases": str04,
    "smp12_uniform": lambda s, d: sampling.ranked(table(s, d, "manifest").select("sample_id").distinct(), [], "sample_id", SEED).filter("rank <= 40").select("sample_id", "rank"),
    "smp13_name_seeds": smp13,
    "smp14_turns": smp14,
    "smp15_plan": smp15,
    "src14_cache_states": src14,
    "joi10_hashes": joi10_hashes,
}

_E = "e AS (SELECT DISTINCT * FROM eval_record)"
_M = "m AS (SELECT DISTINCT * FROM manifest)"
_A = "a AS (SELECT DISTINCT ON (annotation_id) * FROM annotations)"
_SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _hash(c: str) -> str:
    bare = rf"regexp_replace(regexp_replace(lower(regexp_replace({c}, '{_SPACE}+', '', 'g')), '^([a-z][a-z0-9_-]*[:=])?(0x)?', ''), '^0+(.)', '\1')"
    return f"CASE WHEN regexp_full_match({bare}, '[0-9a-f]{{1,64}}') THEN lpad({bare}, 64, '0') END"


_LOW = f"lower({_trim('split')})"
_SPLIT = f"CASE WHEN {_LOW} = 'training' THEN 'train' WHEN {_LOW} IN ('valid', 'validation', 'dev') THEN 'val' WHEN {_LOW} = 'testing' THEN 'test' ELSE nullif({_LOW}, '') END"
_PIX, _UNI = "region_annotation.reference_boxes_pixels", "region_annotation.reference_boxes"
# Case folding and compatibility forms as far as the tables have them; commas and marks as the benchmark's grammar.
_READ = "region_annotation.answer_from_image"
_TEXT = rf"regexp_replace(trim(regexp_replace(replace(lower({_READ}), 'ß', 'ss'), '{_SPACE}+', ' ', 'g')), '[.。]+$', '')"
_BARE = rf"regexp_replace(replace(trim({_TEXT}), ',', ''), '°+$', '')"
_PIXELS = ", ".join(f"greatest(0, least({s}, CAST({f}(box[{i}] * {s} / 1000.0::DOUBLE) AS BIGINT)))" for i, (s, f) in enumerate((("width", "floor"), ("height", "floor"), ("width", "ceil"), ("height", "ceil")), 1))
_WORDS = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_INNER = _WORDS.format("text")
_FLAG = f"lower({_trim('use_tool')})"
_AREA = "CASE WHEN coalesce(len(lowres_size) = 2 AND lowres_size[1] > 0 AND lowres_size[2] > 0, FALSE) THEN CASE WHEN lowres_size[1] * lowres_size[2] <= 65536 THEN 'small' WHEN lowres_size[1] * lowres_size[2] <= 262144 THEN 'medium' WHEN lowres_size[1] * lowres_size[2] <= 1048576 THEN 'large' ELSE 'very_large' END END"
_EDITS = """l AS (SELECT sample_id, arg_max({'v': verdict}, {'k': TRY_CAST(updated_at AS TIMESTAMPTZ) IS NOT NULL, 't': TRY_CAST(updated_at AS TIMESTAMPTZ), 'u': updated_at, 's': coalesce(edited_status, ''), 'v': coalesce(verdict, ''), 'n': coalesce(note, '')}).v AS verdict
    FROM review_edit WHERE sample_id IS NOT NULL GROUP BY 1)"""

SQL = {
    "flt03_strict_flags": f"WITH {_M} SELECT CASE WHEN use_tool = 'true' THEN TRUE WHEN use_tool = 'false' THEN FALSE END AS flag, count(*) AS n FROM m GROUP BY 1",
    "flt07_valid_tokens": f"WITH {_E} SELECT eval_id, coalesce(used_tool, FALSE) AND coalesce(isfinite(vision_ratio) AND isfinite(vision_ratio_true), FALSE) AS valid FROM e",
    "agg14_flt08_joi15_trajectories": f"""WITH {_E} SELECT eval_id AS traj_uid, min(sample_id) AS sample_id, coalesce(bool_or(used_tool), FALSE) AS used_tool,
        round(coalesce(max(outcome_reward) FILTER (WHERE used_tool), max(CASE WHEN used_tool THEN tool_reward ELSE outcome_reward END)), 6) AS outcome, round(CASE WHEN bool_or(used_tool) THEN max(CASE WHEN used_tool THEN tool_reward ELSE outcome_reward END) END, 6) AS tool_reward,
        max(vision_tokens_low_first) + coalesce(max(vision_tokens_crop), 0) AS acquired, CAST(sum(vision_tokens_processed * CASE WHEN used_tool THEN 2 ELSE 1 END) AS BIGINT) AS processed, max(vision_tokens_full) AS full,
        count(*) = 1 AND count(*) FILTER (WHERE used_tool) <= 1 AND min(sample_id) = max(sample_id) AS sound FROM e WHERE eval_id IS NOT NULL GROUP BY 1""",
    "agg13_deviations": f"WITH {_E} SELECT sample_id, round(coalesce(CASE WHEN stddev_samp(outcome_reward) > 1e-6 THEN stddev_samp(outcome_reward) END, 0), 6) AS deviation FROM e WHERE sample_id IS NOT NULL GROUP BY 1",
    "agg15_token_sums": f"WITH {_E} SELECT dataset, used_tool, CAST(sum(vision_tokens_acquired) AS BIGINT) AS tokens FROM e GROUP BY 1, 2",
    "agg25_group_counts": "SELECT CAST(use_tool AS VARCHAR) AS key, count(*) AS found, CAST(24 AS BIGINT) AS wanted, count(*) = 24 AS ok FROM sample_plan WHERE use_tool IS NOT NULL GROUP BY use_tool",
    "win14_first_of_trajectory": "SELECT sample_id, min(eval_id) AS eval_id FROM eval_record WHERE sample_id IS NOT NULL AND eval_id IS NOT NULL GROUP BY 1",
    "srt01_sorted": "SELECT DISTINCT sample_id, verdict FROM review_edit ORDER BY 1 NULLS FIRST, 2 NULLS FIRST",
    "srt02_hash_order": f"SELECT sample_id, sha256('{SEED}:' || sample_id) AS digest FROM (SELECT DISTINCT sample_id FROM manifest WHERE sample_id IS NOT NULL) ORDER BY 2",
    "srt04_first_ranks": f"SELECT source_key, sample_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY sha256('{SEED}:' || sample_id)) AS rank FROM (SELECT DISTINCT source_key, sample_id FROM manifest WHERE sample_id IS NOT NULL)) WHERE rank <= 25",
    "src19_srt06_latest_steps": "SELECT o_custkey AS run, max(o_orderkey) AS step FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
    "set01_union": f"WITH {_M} SELECT sample_id FROM m WHERE {_SPLIT} IN ('train', 'val', 'test')",
    "scl05_benchmark_texts": f"WITH {_A} SELECT annotation_id, trim({_TEXT}) AS answer FROM a",
    "scl10_unwrapped": f"SELECT doc_id, CASE WHEN starts_with({_INNER}, '\\boxed{{') AND ends_with({_INNER}, '}}') THEN {_WORDS.format(f'substr({_INNER}, 8, length({_INNER}) - 8)')} WHEN starts_with({_INNER}, '\\fbox{{') AND ends_with({_INNER}, '}}') THEN {_WORDS.format(f'substr({_INNER}, 7, length({_INNER}) - 7)')} ELSE {_INNER} END AS content FROM documents",
    "scl06_benchmark_numbers": rf"WITH {_A} SELECT annotation_id, CASE WHEN regexp_full_match({_BARE}, '[+-]?(\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?') THEN {_BARE} END AS number FROM a",
    "scl16_rebased": f"WITH {_M} SELECT sample_id, batch_no, '/pool/set/' || image_path AS path FROM m",
    "scl28_outcome_rewards": f"""WITH {_E}, r AS (SELECT eval_id, sample_id, used_tool, CAST(correct AS DOUBLE) AS accuracy, format_compliance / 10 AS form FROM e WHERE sample_id IS NOT NULL),
        s AS (SELECT *, coalesce(CAST(sum(CASE WHEN accuracy > 0 AND NOT used_tool THEN 1 ELSE 0 END) OVER g AS DOUBLE) / nullif(sum(CASE WHEN accuracy > 0 THEN 1 ELSE 0 END) OVER g, 0), 0.0) AS share FROM r WINDOW g AS (PARTITION BY sample_id)),
        b AS (SELECT *, CASE WHEN accuracy > 0 AND (used_tool OR share < 0.2) THEN CAST(-0.01 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS balance FROM s)
        SELECT eval_id, round(balance, 6) AS balance_reward, round((CASE WHEN accuracy > 0 THEN accuracy ELSE accuracy * CAST(0.99 AS DOUBLE) END) + form + balance, 6) AS outcome_reward FROM b""",
    "scl32_scl55_remaining": """WITH t AS (SELECT event_id, value, event_id % 130 AS step, CASE WHEN event_id % 5 > 0 THEN 100 END AS total FROM events)
        SELECT event_id, total, round(step / total::DOUBLE * 100, 6) AS percent, round(CASE WHEN total IS NOT NULL THEN greatest(0, total - step) * value END, 3) AS seconds, round(total * value / 3600, 6) AS total_hours FROM t""",
    "scl34_scl56_format_scores": f"WITH {_E} SELECT dataset, round(avg(CASE WHEN coalesce(final_answer_valid AND first_action_valid AND used_tool, FALSE) THEN 1.0::DOUBLE ELSE 0 END), 6) AS format_score FROM e GROUP BY 1",
    "scl44_request_fingerprints": """SELECT event_id, sha256('{"k": ' || (props->>'k') || '}') AS fingerprint FROM events""",
    "scl45_46_47_sizes": """SELECT DISTINCT width, height, [greatest(1, width // 2), greatest(1, height // 2)] AS half,
        [greatest(1, CAST(floor(width * least(1.0::DOUBLE, sqrt(65536.0::DOUBLE / (width * height)))) AS BIGINT)), greatest(1, CAST(floor(height * least(1.0::DOUBLE, sqrt(65536.0::DOUBLE / (width * height)))) AS BIGINT))] AS budget,
        [greatest(width, 1), greatest(3, CAST(ceil(width / 100.0::DOUBLE) AS BIGINT))] AS padded FROM manifest WHERE width > 0 AND height > 0""",
    "scl49_vision_tokens": "SELECT DISTINCT width, height, CAST(((height + 13) // 14) * ((width + 13) // 14) // 4 AS BIGINT) AS tokens FROM manifest WHERE width > 0 AND height > 0",
    "scl54_crops": f"""WITH {_A}, b AS (SELECT annotation_id, width, height, {_PIX}[1] AS box FROM a), c AS (SELECT annotation_id, width, height, [{_PIXELS}] AS pixels FROM b WHERE len(box) = 4 AND len(list_filter(box, lambda v: v IS NULL)) = 0 AND width > 0 AND height > 0)
        SELECT annotation_id, pixels, [round(pixels[1]::DOUBLE / width, 9), round(pixels[2]::DOUBLE / height, 9), round(pixels[3]::DOUBLE / width, 9), round(pixels[4]::DOUBLE / height, 9)] AS executed FROM c""",
    "scl58_expanded": "SELECT doc_id, CASE WHEN (length(text) - length(replace(text, '<image>', ''))) = 7 THEN sha256(replace(text, '<image>', '<|image|>')) END AS digest FROM documents",
    "flt16_sound_responses": f"WITH {_M}, r AS (SELECT coalesce(answers, []) AS s FROM m) SELECT len(list_filter(s, lambda x: x IS NULL OR length(x) = 0)) = 0 AS sound, count(*) AS n FROM r GROUP BY 1",
    "str03_recorder": "SELECT count(*) = 25 AND count(DISTINCT n_nationkey) = 25 AND min(n_nationkey) = 0 AND max(n_nationkey) = 24 AS complete FROM nation",
    "str06_removable": """WITH s AS (SELECT n_nationkey AS step, n_nationkey % 3 <> 1 AS complete FROM nation), k AS (SELECT step FROM s WHERE complete ORDER BY step DESC LIMIT 2)
        SELECT CAST(step AS BIGINT) AS step FROM s WHERE (SELECT arg_max(complete, step) FROM s) AND step NOT IN (SELECT step FROM k)""",
    "str07_missing": "SELECT DISTINCT sample_id FROM manifest m WHERE NOT EXISTS (SELECT 1 FROM annotations a WHERE a.sample_id = m.sample_id)",
    "str10_second_turns": "SELECT eval_id, (row_number() OVER (ORDER BY eval_id) - 1) // 8 AS batch FROM (SELECT DISTINCT eval_id FROM eval_record WHERE used_tool AND eval_id IS NOT NULL)",
    "prj04_prj05_blobs": "SELECT doc_id, 'image.bytes' AS path, source AS name, CAST(strlen(text) AS INTEGER) AS length FROM documents",
    "prj18_known_names": f"WITH {_M} SELECT source_key, count(*) AS n FROM m WHERE source_key IN ('smart_val', 'smart_train') GROUP BY 1",
    "prj15_reviewed": f"""WITH o AS (SELECT sample_id, arg_max(coalesce(quality_checks.answer_match.match AND region_annotation.status = 'localized', FALSE), {{'t': annotated_at, 'i': annotation_id}}) AS original FROM annotations WHERE sample_id IS NOT NULL GROUP BY 1), {_EDITS}
        SELECT sample_id, original, coalesce(CASE lower({_trim('verdict')}) WHEN 'keep' THEN TRUE WHEN 'fix' THEN FALSE END, original) AS accepted, lower({_trim('verdict')}) IN ('keep', 'fix') IS TRUE AS overridden FROM o LEFT JOIN l USING (sample_id)""",
    "flt14_aligned": f"WITH {_A} SELECT annotation_id, CASE WHEN {_PIX}[1] IS NOT DISTINCT FROM {_PIX}[2] AND {_PIX}[1] IS NOT NULL THEN round({_UNI}[1][1], 9) END AS value FROM a",
    "flt15_constraints": "SELECT family, area, use_tool, CASE WHEN target_per_mille NOT BETWEEN 0 AND 1000 THEN 'share out of range' WHEN min_rows > 30 THEN 'minimum above 30' WHEN target_per_mille = 0 AND min_rows > 0 THEN 'minimum without a share' END AS problem FROM sample_plan",
    "str04_phases": f"WITH {_E} SELECT dataset AS phase, count(*) AS rows, count(DISTINCT sample_id) AS samples, count(*) = 500 AND count(DISTINCT sample_id) = 500 AS complete FROM e WHERE sample_id IS NOT NULL AND dataset IS NOT NULL GROUP BY 1",
    "smp12_uniform": f"SELECT sample_id, row_number() OVER (ORDER BY sha256('{SEED}:' || sample_id)) AS rank FROM (SELECT DISTINCT sample_id FROM manifest WHERE sample_id IS NOT NULL) ORDER BY rank LIMIT 40",
    "smp13_name_seeds": f"SELECT n AS dataset, CAST(CAST('0x' || substr(sha256('{SEED}:' || n), 1, 16) AS UBIGINT) AS VARCHAR) AS seed FROM (SELECT unnest(['dockqa', 'signbench', 'dialset', 'sheetprobe', 'streetyn']) AS n)",
    "smp14_turns": f"""WITH s AS (SELECT sample_id, coalesce(max(CASE WHEN {_FLAG} IN ('true', '1') THEN TRUE WHEN {_FLAG} IN ('false', '0') THEN FALSE END), FALSE) AS flag, coalesce(min({_AREA}), 'none') AS area FROM manifest WHERE sample_id IS NOT NULL GROUP BY 1)
        SELECT stratum, sample_id, turn FROM (SELECT flag || '/' || area AS stratum, sample_id, row_number() OVER (PARTITION BY flag, area ORDER BY sha256('{SEED}:' || sample_id)) AS turn FROM s) WHERE turn <= 4""",
    "smp15_plan": f"""WITH {_M}, r AS (SELECT data_source, sample_id, {_hash('pixel_sha256')} AS image FROM m), p AS (SELECT unnest(['pier_sheets', 'shop_receipts', 'lab_dials']) AS name, unnest([100, 100, 1000000000]) AS target)
        SELECT name, CAST(target AS BIGINT) AS target, count(data_source) AS found, least(count(DISTINCT sample_id), count(DISTINCT image)) AS distinct_found, least(count(DISTINCT sample_id), count(DISTINCT image)) >= target AS ok FROM p LEFT JOIN r ON data_source = name GROUP BY name, target""",
    "src14_cache_states": f"""WITH {_A}, x AS (SELECT sample_id, arg_min({{'f': annotation_meta.request_fingerprint}}, annotation_id).f AS c, arg_max({{'f': annotation_meta.request_fingerprint}}, annotation_id).f AS w FROM a WHERE sample_id IS NOT NULL AND annotation_id IS NOT NULL GROUP BY 1)
        SELECT sample_id, CASE WHEN c IS NULL THEN 'miss' WHEN c IS NOT DISTINCT FROM w THEN 'hit' ELSE 'mismatch' END AS state FROM x""",
    "joi10_hashes": f"""WITH {_M}, r AS (SELECT sample_id, batch_no, {_SPLIT} AS split, {_hash('image_sha256')} AS i, {_hash('source_bytes_sha256')} AS s, {_hash('pixel_sha256')} AS p FROM m), t AS (SELECT * FROM r WHERE split = 'train'), h AS (SELECT i AS h FROM t UNION SELECT s FROM t)
        SELECT DISTINCT sample_id, batch_no FROM r WHERE split IN ('val', 'test') AND NOT EXISTS (SELECT 1 FROM h WHERE h = r.i) AND NOT EXISTS (SELECT 1 FROM h WHERE h = r.s) AND NOT EXISTS (SELECT 1 FROM t WHERE t.p = r.p)""",
}
