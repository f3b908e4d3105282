"""Problem 1: each new batch against everything accepted before, over an index instead of the records.

The history is a persisted inverted file. Its vectors are the 64-bit difference hashes. Five coarse
quantisers, the five disjoint bands of the hash, put each vector into five cells; a cell's list holds the
full vectors. The distance bound: a vector that shares no cell with the query differs from it in at least one
bit of every band, so in more than four bits. Once the query's own five cells are probed no match within
four bits can remain, and what they hold is ranked exactly by the Hamming distance. Accepted vectors are
appended to their cells; the accepted records themselves are not read again.

**Layout.** An index is a folder of segments, one a batch. A segment's lists are partitions: those of one
band whose cells begin with the same bits, as many bits as make a partition ``part_rows`` entries. A batch reads
the partitions of its own cells and, of the pixel hashes, those of its own prefixes; a history ten times as
large has ten times as many partitions, and a batch reads as many as before. Lists longer than ``hot_cell`` are
stored split: the bits outside a cell's band form five bands again, by the same bound, and so once more. The cells
that a segment has split are stored with it and a probe goes down the same way. This is no cap; all
vectors stay reachable. ``most_segments`` segments of about one size are merged into one, so a vector is
written again as often as the history has grown by that factor.

Within a batch, records come in the order of their sample_id and a record is rejected by an accepted one
before it. Exact copies are collapsed first, equal pixel hashes are treated as groups, and only pairs of
different hash values become links, so no group is expanded into its pairs.
"""

from __future__ import annotations

import math
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.normal import hash_long, hash_value, normal_group_key
from ..operators.conflicts import HOT_CELL, LOCAL_ROWS, RADIUS, cells_of, descended, distance, full_cells, keep_first, placed_in_cells
from ..session import Workspace, hadoop_path, table

#: Entries of a partition that the layout aims at.
PART_ROWS = 1 << 18
#: Vectors of a cell from which on it is stored split.
HOT_LIST = 1 << 13
#: Segments of about one size that are merged into one.
MOST_SEGMENTS = 8
#: Probes (cell, hash) of a batch that are broadcast, 16 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 18
#: Most bits by which a band's cells, or the pixel hashes, are divided into partitions.
MOST_BITS = 12

#: Entries: accepted records with their hashes, vectors in a cell, pixel hashes.
INDEX = "sample_id string, batch_no int, pixel binary, dhash bigint, cell bigint"
RECORD = ["sample_id", "batch_no", "pixel", "dhash"]


def records(manifest: DataFrame) -> DataFrame:
    """(sample_id, batch_no, pixel, dhash) of each record: hashes by value, the pixel hash from the group key where it is missing.

    Copies of a record count once; should they disagree, the smallest hash that isn't missing holds.
    """
    key = normal_group_key()
    pixel = F.coalesce(hash_value("pixel_sha256", 64), F.when(key.startswith("image:"), hash_value(F.substring(key, 7, 1 << 20), 64)))
    rows = manifest.select("sample_id", "batch_no", F.unhex(pixel).alias("pixel"), hash_long(hash_value("dhash", 16)).alias("dhash"))
    return rows.groupBy("sample_id", "batch_no").agg(F.min("pixel").alias("pixel"), F.min("dhash").alias("dhash"))


def cell_range(cell: Column) -> Column:
    """Band and first MOST_BITS bits of a first-level cell, as one number; the last band's cells have one bit less than the others'."""
    band = F.shiftright(cell, 13)
    bits = cell.bitwiseAND(F.lit((1 << 13) - 1))
    return (F.shiftleft(band, MOST_BITS) + F.when(band == 5, bits).otherwise(F.shiftright(bits, 1))).cast("int")


def pixel_range(pixel: Column) -> Column:
    """The first MOST_BITS bits of a pixel hash."""
    return F.conv(F.substring(F.hex(pixel), 1, MOST_BITS // 4), 16, 10).cast("int")


@dataclass(frozen=True)
class Segment:
    """Stored batches ``first`` to ``last``: their records, the bits that name a partition, and the levels at which cells are split."""

    first: int
    last: int
    rows: int
    bits: int
    levels: int

    @property
    def name(self) -> str:
        return f"segment={self.first:06d}-{self.last:06d}-{self.rows}-{self.bits}-{self.levels}"

    @staticmethod
    def of(name: str) -> Segment | None:
        found = re.fullmatch(r"segment=(\d+)-(\d+)-(\d+)-(\d+)-(\d+)", name)
        return Segment(*map(int, found.groups())) if found else None


class AcceptedHistory:
    """The persisted cells and the check of batches against them.

    ``path`` names a folder that all executors share and outlives the session; without one, a folder of the
    session's checkpoint directory is used. A segment appears by the renaming of its folder, so an index holds a
    batch wholly or not at all; one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, hot_cell: int = HOT_CELL, local_rows: int = LOCAL_ROWS, hot_list: int = HOT_LIST, part_rows: int = PART_ROWS, most_segments: int = MOST_SEGMENTS, broadcast_rows: int = BROADCAST_ROWS):
        self.spark = spark
        self.work = Workspace(spark, "history-work")
        self.index_path = path or Workspace(spark, "history").path
        self.hot_cell, self.local_rows, self.hot_list, self.part_rows, self.most_segments, self.broadcast_rows = hot_cell, local_rows, hot_list, part_rows, most_segments, broadcast_rows
        self.where, self.fs = hadoop_path(spark, self.index_path)
        self.segments = self._stored()
        self.steps = 0

    def _stored(self) -> list[Segment]:
        if not self.fs.exists(self.where):
            return []
        found = [s for s in (Segment.of(f.getPath().getName()) for f in self.fs.listStatus(self.where)) if s]
        # What a merged segment covers is left over from a merge that was cut short.
        return sorted((s for s in found if not any(o != s and o.first <= s.first and s.last <= o.last for o in found)), key=lambda s: s.first)

    def _read(self, kind: str, segments: list[Segment]) -> DataFrame:
        schema = f"{INDEX}, segment string, kind string, part int"
        if not segments:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", self.index_path)
        return reader.parquet(*[f"{self.index_path}/{s.name}" for s in segments]).filter(F.col("kind") == kind)

    def _split(self, first: int, last: int, level: int) -> str:
        return f"{self.index_path}/splits/{first}-{last}-{level}"

    def accepted(self) -> DataFrame:
        """(sample_id, batch_no) of the accepted records."""
        return self._read("record", self.segments).select("sample_id", "batch_no")

    def check(self, batch: DataFrame, records: int | None = None) -> None:
        """Decide the records (sample_id, batch_no, pixel, dhash) of one batch and append the accepted ones.

        ``records`` is their number, where it is known.

        A record with neither hash equals nothing and is accepted. A NULL sample_id comes first.
        """
        self.steps += 1
        name = f"{self.steps}"
        records = batch.count() if records is None else records
        hashed = batch.filter(F.col("pixel").isNotNull() | F.col("dhash").isNotNull())
        free = batch.filter(F.col("pixel").isNull() & F.col("dhash").isNull()).select(RECORD)
        # Records equal in both hashes: whatever becomes of the first one rejects the others.
        first = F.min(F.struct(F.coalesce("sample_id", F.lit("")).alias("key"), "sample_id", "batch_no"))
        nodes = hashed.groupBy("pixel", "dhash").agg(first.alias("first")).select("pixel", "dhash", "first.*")
        if self.segments:
            ranges = self._ranges(hashed)
            hint = F.broadcast if records * (RADIUS + 1) <= self.broadcast_rows else (lambda df: df)
            nodes = nodes.join(hint(self._near(hashed, ranges, hint)), "dhash", "left_anti").join(hint(self._seen(hashed, ranges, hint)), "pixel", "left_anti")
        nodes = keep_first(nodes, records, self.work, name, self.local_rows, self.hot_cell).select(RECORD)
        number = 1 + max((s.last for s in self.segments), default=-1)
        self.segments.append(self._store(nodes.unionByName(free), records, number, number))
        self.work.drop()
        self._merge()

    def _ranges(self, hashed: DataFrame) -> tuple[list[int], list[int]] | None:
        """The ranges of cells and of pixel hashes that the batch names, at most 5 + 1 times 2^MOST_BITS; None if no segment is divided by them."""
        if not any(s.bits for s in self.segments):
            return None
        cells = F.when(F.col("dhash").isNotNull(), F.transform(cells_of(F.col("dhash")), cell_range))
        pixels = F.when(F.col("pixel").isNotNull(), F.array(pixel_range(F.col("pixel"))))
        none = F.array().cast("array<int>")
        # Those of cells start at 2^MOST_BITS, so the two don't mix.
        named = [r["r"] for r in hashed.select(F.explode(F.concat(F.coalesce(cells, none), F.coalesce(pixels, none))).alias("r")).distinct().collect()]
        return [r for r in named if r >> MOST_BITS], [r for r in named if not r >> MOST_BITS]

    def _lists(self, kind: str, segments: list[Segment], ranges: list[int] | None) -> DataFrame:
        """The lists of ``segments``, only the partitions that the ranges name."""
        out = None
        for bits in sorted({s.bits for s in segments}):
            rows = self._read(kind, [s for s in segments if s.bits == bits])
            if bits and ranges is not None:
                rows = rows.filter(F.col("part").isin(sorted({r >> (MOST_BITS - bits) for r in ranges})))
            out = rows if out is None else out.unionByName(rows)
        return out

    def _near(self, hashed: DataFrame, ranges, hint) -> DataFrame:
        """(dhash) of the batch's vectors within the radius of an accepted one. Accepted ones are far apart, so few lie around any."""
        vectors = hashed.select("dhash").filter("dhash IS NOT NULL").distinct()
        out = None
        plain = [s for s in self.segments if not s.levels]
        for group in [[s] for s in self.segments if s.levels] + ([plain] if plain else []):
            probes = placed_in_cells(vectors)
            for level in range(group[0].levels):
                probes = descended(probes, self.spark.read.schema("cell bigint").parquet(self._split(group[0].first, group[0].last, level)), level)
            lists = self._lists("vector", group, ranges and ranges[0]).select("cell", F.col("dhash").alias("b"))
            hits = lists.join(hint(probes), "cell").filter(distance("b", "dhash") <= RADIUS).select("dhash")
            out = hits if out is None else out.unionByName(hits)
        return out

    def _seen(self, hashed: DataFrame, ranges, hint) -> DataFrame:
        """(pixel) of the batch's pixel hashes that an accepted record has, once each."""
        own = hashed.select("pixel").filter("pixel IS NOT NULL")
        return self._lists("pixel", self.segments, ranges and ranges[1]).select("pixel").join(hint(own), "pixel", "left_semi")

    def _store(self, accepted: DataFrame, most: int, first: int, last: int) -> Segment:
        """Write a segment of at most ``most`` accepted records: these, their vectors in cells and their pixel hashes."""
        staged = f"{self.index_path}/staged-{uuid.uuid4().hex}"
        bits = min(MOST_BITS, max(0, math.ceil(math.log2(max(1, most) / self.part_rows))))
        n, levels = Observation(), 0
        accepted = accepted.observe(n, F.count("*").alias("n"))
        part = lambda r: F.shiftright(r, MOST_BITS - bits).cast("int")
        if most > self.hot_list:  # else no cell can hold more
            accepted = self.work.save(accepted, f"accepted-{first}-{last}")
        vectors = accepted.filter("dhash IS NOT NULL").select(F.explode(cells_of(F.col("dhash"))).alias("cell"), "dhash").withColumn("part", part(cell_range(F.col("cell"))))
        while levels < 2 and most > self.hot_list:
            full, found = self._split(first, last, levels), Observation()
            full_cells(vectors, self.hot_list).observe(found, F.count("*").alias("n")).write.mode("overwrite").parquet(full)
            if not found.get["n"]:
                break
            vectors = descended(vectors, self.spark.read.schema("cell bigint").parquet(full), levels)
            levels += 1
        null = lambda kind: F.lit(None).cast(kind)

        def entry(kind: str, where: Column, *columns: str) -> Column:
            own = [F.col(c).alias(c) if c in columns else null(t).alias(c) for c, t in (x.split() for x in INDEX.split(", "))]
            return F.struct(*own, F.lit(kind).alias("kind"), where.alias("part"))

        record, pixel = entry("record", F.lit(0), *RECORD), entry("pixel", part(pixel_range(F.col("pixel"))), "pixel")
        both = F.when(F.col("pixel").isNull(), F.array(record)).otherwise(F.array(record, pixel))
        if levels:
            entries = accepted.select(F.inline(both)).unionByName(vectors.select(entry("vector", F.col("part"), "cell", "dhash").alias("e")).select("e.*"))
        else:  # in one pass
            in_cells = F.transform(cells_of(F.col("dhash")), lambda c: F.struct(*[null(t).alias(x) if x not in ("cell", "dhash") else (c if x == "cell" else F.col("dhash")).alias(x) for x, t in (y.split() for y in INDEX.split(", "))], F.lit("vector").alias("kind"), part(cell_range(c)).alias("part")))
            entries = accepted.select(F.inline(F.when(F.col("dhash").isNull(), both).otherwise(F.concat(both, in_cells))))
        if bits:
            entries = entries.repartition("kind", "part").sortWithinPartitions("kind", "part", "cell", "pixel")
        elif most <= self.local_rows:
            entries = entries.coalesce(1)
        entries.write.partitionBy("kind", "part").parquet(staged)
        segment = Segment(first, last, n.get["n"], bits, levels)
        if not self.fs.rename(hadoop_path(self.spark, staged)[0], hadoop_path(self.spark, f"{self.index_path}/{segment.name}")[0]):
            raise OSError(f"{staged} can't be renamed")
        return segment

    def _merge(self) -> None:
        """Merge the last segments once ``most_segments`` of them are within a factor of that many of each other."""
        tail = self.segments[-self.most_segments :]
        if len(tail) < self.most_segments or max(s.rows for s in tail) > self.most_segments * max(1, min(s.rows for s in tail)):
            return
        merged = self._store(self._read("record", tail).select(RECORD), sum(s.rows for s in tail), tail[0].first, tail[-1].last)
        self.segments = [*self.segments[: -len(tail)], merged]
        for s in tail:
            self.fs.delete(hadoop_path(self.spark, f"{self.index_path}/{s.name}")[0], True)


def checked(manifest: DataFrame, history: AcceptedHistory | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) records (sample_id, batch_no) of all batches, in the order of batch_no; a NULL batch_no comes last."""
    spark = manifest.sparkSession
    history = history or AcceptedHistory(spark)
    staged = Workspace(spark, "batches").save(records(manifest), "records", partition_by=["batch_no"])
    sizes = {r["batch_no"]: r["n"] for r in staged.groupBy("batch_no").agg(F.count("*").alias("n")).collect()}
    for n in sorted(sizes, key=lambda n: (n is None, n)):
        history.check(staged.filter(F.col("batch_no").eqNullSafe(F.lit(n).cast("int"))), sizes[n])
    accepted = history.accepted().withColumnRenamed("sample_id", "s").withColumnRenamed("batch_no", "n")
    same = staged["sample_id"].eqNullSafe(accepted["s"]) & staged["batch_no"].eqNullSafe(accepted["n"])
    return history.accepted(), staged.join(accepted, same, "left_anti").select("sample_id", "batch_no")


def rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(table(spark, sf_dir, "manifest"))[1]
