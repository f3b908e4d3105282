"""Queries of sources and sinks: whole tables written, read again and compared with themselves."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.normal import normal_flag
from ..operators import checks, labels
from ..session import Workspace, hadoop_path, table
from ..sources import arrow_ipc, bundles, files, windows


def _place(spark, name: str) -> str:
    return f"{Workspace(spark, 'storage').path}/{name}"


def src01(spark, d, strict: bool = False):
    rows, path = table(spark, d, "review_edit"), _place(spark, "lines")
    files.write_jsonl(rows, path)
    return files.read_jsonl(spark, path, rows.schema, strict)


def src03(spark, d):
    """The nations, a fixed number, as one JSON array over several lines."""
    rows, path = table(spark, d, "nation"), _place(spark, "whole")
    text = F.concat(F.lit("[\n"), F.array_join(F.sort_array(F.collect_list(F.to_json(F.struct("*")))), ",\n"), F.lit("\n]"))
    rows.agg(text.alias("value")).write.text(path)
    return files.read_json(spark, path, rows.schema)


def src06(spark, d, columns: tuple[str, ...] = ()):
    rows, path = table(spark, d, "customer"), _place(spark, "table")
    files.write_parquet(rows, path)
    return files.read_matching(spark, path, "part-*.parquet", rows.select(*columns).schema if columns else None)


def snk03(spark, d):
    """Every nation appended in two writes."""
    path = _place(spark, "log")
    for _ in range(2):
        files.write_jsonl(table(spark, d, "nation").select("n_nationkey"), path, "append")
    return files.read_jsonl(spark, path, "n_nationkey bigint").groupBy("n_nationkey").agg(F.count("*").alias("n"))


def snk05(spark, d):
    rows, path = table(spark, d, "supplier"), _place(spark, "staged")
    want = rows.count()

    def whole(written):
        if written.count() != want:
            raise ValueError("rows are missing")

    files.write_checked(rows, path, whole)
    return spark.read.schema(rows.schema).parquet(path)


def snk06(spark, d):
    """Every text as an asset, delivered twice: each content is there once."""
    rows, path = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content")), _place(spark, "assets")
    for _ in range(2):
        files.write_assets(rows, "content", ".txt", path)
    return spark.read.parquet(path).groupBy("sha256").agg(F.count("*").alias("n"), F.max(F.octet_length("content")).alias("bytes"))


def src04(spark, d):
    """The events as Arrow streams, one a partition, numbered within each."""
    path = _place(spark, "shards")
    spark.dataSource.register(arrow_ipc.ArrowStreamSource)
    arrow_ipc.write_streams(table(spark, d, "events").select("event_id", "user_id", "value"), path)
    rows = spark.read.format("arrow_stream").schema("shard string, row_in_shard bigint, event_id bigint, user_id bigint, value double").load(f"{path}/*.arrow")
    # Row numbers are dense: none is missing or double.
    return rows.withColumn("dense", F.lit(True)).select("event_id", "user_id", "value", "dense").unionByName(
        rows.groupBy("shard").agg(F.count_distinct("row_in_shard").alias("n"), F.max("row_in_shard").alias("top"), F.count("*").alias("all")).filter("n <> all OR top <> all - 1").select(F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast("bigint").alias("user_id"), F.lit(None).cast("double").alias("value"), F.lit(False).alias("dense"))
    )


def src05(spark, d):
    """Rows of the shards looked up by place, and whether they hold what was recorded; every third record is recorded wrongly."""
    path = _place(spark, "shards")
    spark.dataSource.register(arrow_ipc.ArrowStreamSource)
    arrow_ipc.write_streams(table(spark, d, "documents").select("doc_id", "text"), path)
    shards = spark.read.format("arrow_stream").schema("shard string, row_in_shard bigint, doc_id bigint, text string").load(f"{path}/*.arrow")
    record = F.when(F.col("doc_id") % 3 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("text", 256))
    wanted = shards.select("shard", "row_in_shard", record.alias("recorded"))
    return arrow_ipc.looked_up(shards, wanted, F.sha2("text", 256), "recorded").select("doc_id", "unchanged")


def src10(spark, d):
    """The nations, a fixed number, served in three windows."""
    spark.dataSource.register(windows.RowWindows)
    folder, rows = _place(spark, "served"), table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()
    for offset in (0, 10, 20):
        own = [{"row_idx": i, "row": r.asDict()} for i, r in enumerate(rows) if offset <= i < offset + 10]
        path, fs = hadoop_path(spark, f"{folder}/rows_{offset}.json")
        stream = fs.create(path)
        stream.write(bytearray(json.dumps({"rows": own}).encode()))
        stream.close()
    address = hadoop_path(spark, folder)[0].toUri().getPath()
    found = spark.read.format("row_windows").option("offsets", "0,10,20").option("length", 10).load(f"file://{address}/rows_{{offset}}.json")
    return found.select("row_index", "window", F.get_json_object("row", "$.n_name").alias("name"))


def prj17(spark, d):
    """Review-gallery records: labels with what their pictures are called."""
    rows = labels.annotations_once(table(spark, d, "annotations"))
    boxes = F.col("region_annotation.reference_boxes_pixels")
    picture = lambda folder, end: F.concat(F.lit(f"assets/{folder}/"), F.col("sample_id"), F.lit(end))
    return rows.select(
        "annotation_id",
        "sample_id",
        "question",
        "answers",
        F.col("region_annotation.answer_from_image").alias("answer_from_image"),
        F.col("region_annotation.status").alias("status"),
        F.coalesce("quality_checks.answer_match.match", F.lit(False)).alias("strict_answer_match"),
        F.coalesce(normal_flag("source_info.use_tool"), F.lit(False)).alias("use_tool"),
        "width",
        "height",
        F.coalesce(F.size(boxes), F.lit(0)).alias("boxes"),
        picture("overlays", ".png").alias("overlay"),
        F.when(F.size(boxes) > 0, picture("crops", ".png")).alias("model_crop"),
        picture("editor", ".jpg").alias("editor"),
    )


QUERIES = {
    "src10_row_windows": src10,
    "prj17_gallery_records": prj17,
    "scl15_clipped": lambda s, d: table(s, d, "documents").select("doc_id", bundles.clipped("text").alias("text")),
    "src01_snk01_json_lines": src01,
    "src02_strict_json_lines": lambda s, d: src01(s, d, True),
    "src03_whole_json": src03,
    "src04_src11_arrow_streams": src04,
    "src05_lookups": src05,
    "src06_src13_snk02_parquet": src06,
    "src07_pruned_parquet": lambda s, d: src06(s, d, ("c_custkey", "c_acctbal")),
    "src08_footer_rows": lambda s, d: s.createDataFrame([(files.row_count(s, f"{d}/orders.parquet"),)], "rows bigint"),
    "src15_manifest_rules": lambda s, d: checks.manifest_rules(table(s, d, "manifest"), ["sample_id", "batch_no"], "image_path", "images", 1000),
    "snk03_append_log": snk03,
    "snk04_snk05_staged": snk05,
    "snk06_snk07_assets": snk06,
}

_SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]"

SQL = {
    "src10_row_windows": "SELECT n_nationkey AS row_index, n_nationkey // 10 * 10 AS window, n_name AS name FROM nation",
    "prj17_gallery_records": f"""WITH a AS (SELECT DISTINCT ON (annotation_id) *, region_annotation.reference_boxes_pixels AS b FROM annotations)
        SELECT annotation_id, sample_id, question, answers, region_annotation.answer_from_image AS answer_from_image, region_annotation.status AS status, coalesce(quality_checks.answer_match.match, FALSE) AS strict_answer_match,
        coalesce(lower(regexp_replace(source_info.use_tool, '^{_SPACE}+|{_SPACE}+$', '', 'g')) IN ('true', '1'), FALSE) AS use_tool, width, height, CAST(coalesce(len(b), 0) AS INTEGER) AS boxes,
        'assets/overlays/' || sample_id || '.png' AS overlay, CASE WHEN len(b) > 0 THEN 'assets/crops/' || sample_id || '.png' END AS model_crop, 'assets/editor/' || sample_id || '.jpg' AS editor FROM a""",
    "src01_snk01_json_lines": "SELECT * FROM review_edit",
    "src02_strict_json_lines": "SELECT * FROM review_edit",
    "src03_whole_json": "SELECT * FROM nation",
    "src04_src11_arrow_streams": "SELECT event_id, user_id, value, TRUE AS dense FROM events",
    "src05_lookups": "SELECT doc_id, CASE WHEN text IS NULL THEN FALSE ELSE doc_id % 3 <> 0 END AS unchanged FROM documents",
    "src06_src13_snk02_parquet": "SELECT * FROM customer",
    "src07_pruned_parquet": "SELECT c_custkey, c_acctbal FROM customer",
    "src08_footer_rows": "SELECT count(*) AS rows FROM orders",
    "src15_manifest_rules": """WITH m AS (SELECT DISTINCT * FROM manifest) SELECT 'repeated id' AS rule, (SELECT count(*) FROM (SELECT 1 FROM m GROUP BY sample_id, batch_no HAVING count(*) > 1)) AS violations
        UNION ALL SELECT 'outside of images', (SELECT count(*) FROM m WHERE NOT coalesce(starts_with(image_path, 'images/') AND NOT contains(image_path, '..') AND length(image_path) > 7, FALSE)) UNION ALL SELECT 'fewer than 1000 rows', (SELECT greatest(0, 1000 - count(*)) FROM m)""",
    "snk03_append_log": "SELECT n_nationkey, CAST(2 AS BIGINT) AS n FROM nation",
    "snk04_snk05_staged": "SELECT * FROM supplier",
    "snk06_snk07_assets": "SELECT DISTINCT sha256(text) AS sha256, CAST(1 AS BIGINT) AS n, CAST(strlen(text) AS INTEGER) AS bytes FROM documents WHERE text IS NOT NULL",
}
