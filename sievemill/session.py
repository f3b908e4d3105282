"""Tables and the shared working folder of a session."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset and everything runs on this machine one is made and set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sievemill-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).parent
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    path, fs = hadoop_path(spark, f"{shared_folder(spark)}/sievemill-{uuid.uuid4().hex}.zip")
    stream = fs.create(path)
    stream.write(bytearray(out.getvalue()))
    stream.close()
    spark.sparkContext.addPyFile(path.toString())


class Workspace:
    """A folder below the shared one for tables that cut lineage and outlive executors.

    Tables are read back with the schema they were written with, so an empty one is no special case.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, mode: str = "error", partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` as table ``name``; the result reads the whole table (all appends)."""
        writer = df.write.mode(mode)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        """Delete a table whose readers are done."""
        path, fs = hadoop_path(self.spark, f"{self.path}/{name}" if name else self.path)
        fs.delete(path, True)
