"""Windows of a row service as a Spark source (SRC10): one partition a window of rows.

    spark.dataSource.register(RowWindows)
    spark.read.format("row_windows").option("offsets", "0,5500").option("length", 100).load("https://host/rows?offset={offset}&length={length}")

Each window is a JSON object with ``rows``, a list of ``row_idx`` and ``row``. The address may be of any scheme that
urllib opens, ``file:`` among them; a window that can't be read is an error of its task, which Spark repeats.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SECONDS = 60


class Window(InputPartition):
    def __init__(self, offset: int):
        self.offset = offset


class WindowReader(DataSourceReader):
    def __init__(self, address: str, offsets: list[int], length: int):
        self.address, self.offsets, self.length = address, offsets, length

    def partitions(self) -> list[Window]:
        return [Window(o) for o in self.offsets]

    def read(self, partition: Window) -> Iterator[tuple]:
        address = self.address.replace("{offset}", str(partition.offset)).replace("{length}", str(self.length))
        with urllib.request.urlopen(address, timeout=SECONDS) as response:
            found = json.load(response)
        for item in found["rows"]:
            yield item["row_idx"], partition.offset, json.dumps(item["row"], ensure_ascii=False, separators=(",", ":"))


class RowWindows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "row_windows"

    def schema(self) -> str:
        return "row_index bigint, window bigint, row string"

    def reader(self, schema) -> WindowReader:
        return WindowReader(self.options["path"], [int(o) for o in self.options["offsets"].split(",")], int(self.options.get("length", 100)))
