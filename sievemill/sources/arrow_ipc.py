"""Arrow IPC stream files as a Spark source (SRC04, SRC05, SRC11): one partition a shard, rows numbered within it.

    spark.dataSource.register(ArrowStreamSource)
    spark.read.format("arrow_stream").schema("...").load("/shards/*.arrow")

Columns named in the schema are taken from the shards, missing ones are NULL; ``shard`` and ``row_in_shard``,
if the schema names them, tell where a row is from. Only the schema's columns are converted. Shards lie in a
folder that driver and executors share, on any file system that Arrow knows by its scheme.
"""

from __future__ import annotations

import fnmatch
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path with or without a scheme, and the path on it."""
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path) if ":/" in path else (fs.LocalFileSystem(), os.path.abspath(path))


class Shard(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ArrowStreamReader(DataSourceReader):
    def __init__(self, schema, paths: list[str]):
        self.schema, self.paths = schema, paths

    def partitions(self) -> list[Shard]:
        return [Shard(p) for p in self.paths]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        if partition is None or not partition.path:
            return
        target = to_arrow_schema(self.schema)
        done = 0
        system, path = located(partition.path)
        with system.open_input_stream(path) as source, pa.ipc.open_stream(source) as reader:
            for batch in reader:
                n, columns = batch.num_rows, []
                for field in target:
                    if field.name == "shard":
                        column = pa.array([os.path.basename(partition.path)] * n, pa.string())
                    elif field.name == "row_in_shard":
                        column = pa.array(np.arange(done, done + n))
                    elif field.name in batch.schema.names:
                        column = batch.column(batch.schema.get_field_index(field.name))
                    else:
                        column = pa.nulls(n, field.type)
                    columns.append(column.cast(field.type))
                done += n
                yield pa.RecordBatch.from_arrays(columns, schema=target)


class ArrowStreamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_stream"

    def schema(self) -> str:
        raise ValueError("arrow_stream needs a schema")

    def reader(self, schema) -> ArrowStreamReader:
        folder, pattern = os.path.split(self.options["path"])
        system, path = located(folder)
        scheme = folder[: len(folder) - len(path)] if folder.endswith(path) else ""
        found = system.get_file_info(fs.FileSelector(path))
        return ArrowStreamReader(schema, sorted(scheme + f.path for f in found if f.is_file and fnmatch.fnmatch(f.base_name, pattern)))


def write_streams(df: DataFrame, path: str) -> None:
    """Each partition as one Arrow stream file below ``path``, under a name of its own.

    A file is written beside and renamed, so a task that is repeated leaves no half one; the file names that were
    reported last are the table's, any others are removed.
    """
    system, folder = located(path)
    system.create_dir(folder, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, where = located(path)
        name, writer, staged = f"data-{uuid.uuid4().hex}.arrow", None, None
        for batch in batches:
            if writer is None:
                staged = target.open_output_stream(f"{where}/{name}.part")
                writer = pa.ipc.new_stream(staged, batch.schema)
            writer.write_batch(batch)
        if writer is not None:
            writer.close()
            staged.close()
            target.move(f"{where}/{name}.part", f"{where}/{name}")
            yield pa.RecordBatch.from_pydict({"name": [name]})

    kept = {r["name"] for r in df.mapInArrow(write, "name string").collect()}  # one name a partition
    for f in system.get_file_info(fs.FileSelector(folder)):
        if f.base_name not in kept:
            system.delete_file(f.path)


def looked_up(shards: DataFrame, wanted: DataFrame, content: Column, recorded: str) -> DataFrame:
    """SRC05: the rows of the shards at the ``wanted`` places (shard, row_in_shard, recorded), with ``unchanged``: whether ``content`` is what was recorded."""
    found = shards.join(wanted, ["shard", "row_in_shard"])
    return found.withColumn("unchanged", F.coalesce(content == F.col(recorded), F.lit(False)))
