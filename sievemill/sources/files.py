"""Readers and writers of files (SRC01-03, SRC06-08, SRC13, SRC15-19, SNK01-08)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import hadoop_path


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """SRC01, SRC02: JSON lines; anything malformed is an error. Blank lines are skipped, or with ``strict`` an error."""
    if not strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path)
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    checked = F.when(F.trim("value") == "", F.raise_error(F.lit("blank line"))).otherwise(parsed)
    return lines.select(checked.alias("r")).select("r.*")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC03: whole-file JSON."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_matching(spark: SparkSession, folder: str, pattern: str, schema: str | None = None) -> DataFrame:
    """SRC06, SRC07, SRC13: Parquet files of a folder whose names match."""
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    return (reader.schema(schema) if schema else reader).parquet(folder)


def row_count(spark: SparkSession, path: str) -> int:
    """SRC08: from the footers alone."""
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return spark.read.parquet(path).count()


def digests(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """SRC15, SCL40: (path, length, sha256) of each file; for manifests and assets, as a file is held whole."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "length", F.sha2("content", 256).alias("sha256"))


def wrong_digests(found: DataFrame, recorded: DataFrame) -> DataFrame:
    """SRC15: (name, problem) of files that are missing, not recorded or other than recorded (name, sha256)."""
    own = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("have"))
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("sha256").isNull(), "not_recorded").when(F.col("have") != F.col("sha256"), "other_content")
    return own.join(recorded.select("name", "sha256"), "name", "full_outer").select("name", problem.alias("problem")).filter("problem IS NOT NULL")


def latest_complete(steps: DataFrame) -> DataFrame:
    """SRC19, SRT06: (run, step) of the highest complete step of each run, by number."""
    return steps.filter("complete").withColumn("step", F.regexp_extract("path", r"global_step_(\d+)$", 1)).filter("step <> ''").groupBy("run").agg(F.max(F.col("step").cast("bigint")).alias("step"))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK01, SNK03, SNK04: JSON lines by the commit protocol; NULL fields are kept. An existing target is an error unless ``mode`` says otherwise."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK02: Parquet with zstd."""
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_checked(df: DataFrame, path: str, check) -> None:
    """SNK05: write beside the target, let ``check`` look at what was written, then rename."""
    spark = df.sparkSession
    target, fs = hadoop_path(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    staged = f"{path}.{uuid.uuid4().hex}.staged"
    try:
        write_parquet(df, staged)
        check(spark.read.schema(df.schema).parquet(staged))
        if not fs.rename(hadoop_path(spark, staged)[0], target):
            raise OSError(f"{staged} can't be renamed")
    finally:
        fs.delete(hadoop_path(spark, staged)[0], True)


def write_assets(df: DataFrame, content: str, extension: str, path: str) -> DataFrame:
    """SNK06, SNK07: each distinct content once, in folders by the first digits of its digest; adds sha256 and the asset's place.

    Content that is there already is not written again. Assets are stored as rows of Parquet tables partitioned by
    those digits: millions of small files serve no one.
    """
    keyed = df.withColumn("sha256", F.sha2(content, 256)).withColumn("head", F.substring("sha256", 1, 2))
    new = keyed.select("head", "sha256", content).filter(F.col(content).isNotNull()).dropDuplicates(["sha256"])
    where, fs = hadoop_path(df.sparkSession, path)
    if fs.exists(where):
        # Only digests are read of what is there.
        held = df.sparkSession.read.schema(T.StructType([new.schema["sha256"], new.schema["head"]])).parquet(path)
        new = new.join(held, ["head", "sha256"], "left_anti")
    new.select("sha256", content, "head").write.mode("append").partitionBy("head").parquet(path)
    return keyed.withColumn("asset", F.concat(F.lit("images/high/"), "head", F.lit("/"), "sha256", F.lit(extension))).drop("head", content)


def summary(df: DataFrame, strata: list[str]) -> DataFrame:
    """SNK08: one row: total, counts by stratum as JSON, and a digest that doesn't depend on row order."""
    counts = df.groupBy(*strata).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*sorted(df.columns))).alias("x"))
    name = F.concat_ws("/", *strata)
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name.alias("k"), "n"))))).alias("strata"), F.coalesce(F.bit_xor("x"), F.lit(0)).alias("digest"))
