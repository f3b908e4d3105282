"""First-come selection among conflicting rows (the heart of SMP02-04, JOI08, JOI09).

Rows come in the order of a key; one is kept unless a kept one before it has the same ``pixel`` hash or a
``dhash`` within four bits. Near hashes are found by banding: two 64-bit values that differ in at most four
bits agree on one of five disjoint bands. Equal hashes are handled as groups and never become pairs.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Workspace

RADIUS = 4
# Fixed values: (lowest bit, bits) of the RADIUS + 1 bands of a hash, of those over the bits outside a band, and of
# those over the bits outside such a finer one. The last band of each takes what is left.
BANDS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
FINER = [(0, 10), (10, 10), (20, 10), (30, 10), (40, 12)]
FINEST = [(0, 8), (8, 8), (16, 8), (24, 8), (32, 10)]
LEVELS = [BANDS, FINER, FINEST]
#: Bits of a band by level. A cell's number is that of the cell above it, its band's number (3 bits) and its band's bits.
WIDTHS = [13, 12, 10]
#: First-level cells there can be: what is kept of each is bounded.
MOST_CELLS = 4 * (1 << 13) + (1 << 12)
#: Hashes in a cell from which on it is refined.
HOT_CELL = 1024
#: Nodes and links of one order that are settled in one task; above, in rounds over all executors.
LOCAL_ROWS = 200_000


def _bits(value: Column, low: int, n: int) -> Column:
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << n) - 1))


def cells_of(dhash: Column) -> Column:
    """Array of the five cells of a hash: band number, from 1, and the band's bits. So no cell has the number of one of another level."""
    return F.array(*[_bits(dhash, low, n) + F.lit(i << WIDTHS[0]) for i, (low, n) in enumerate(BANDS, 1)])


def _outside(value: Column, band: Column, bands: list[tuple[int, int]], first: int) -> Column:
    """The bits of ``value`` outside the band of that number, counted from ``first``, pushed together."""
    out = F.lit(None).cast("bigint")
    for i, (low, n) in enumerate(bands, first):
        above = F.shiftrightunsigned(value, low + n) if low + n < 64 else F.lit(0).cast("bigint")
        out = F.when(band == i, F.shiftleft(above, low).bitwiseOR(value.bitwiseAND(F.lit((1 << low) - 1)))).otherwise(out)
    return out


def child_cells(cell: Column, dhash: Column, level: int) -> Column:
    """Array of the five cells into which one of ``level`` (0 or 1) is split: bands of the bits outside its own bands.

    By the same bound as before: two hashes of the cell within the radius agree on one of these bands.
    """
    if level == 0:
        rest = _outside(dhash, _bits(cell, WIDTHS[0], 3), BANDS, 1)
    else:
        rest = _outside(_outside(dhash, _bits(cell, WIDTHS[1] + 3 + WIDTHS[0], 3), BANDS, 1), _bits(cell, WIDTHS[1], 3), FINER, 0)
    width = WIDTHS[level + 1]
    return F.array(*[F.shiftleft(F.shiftleft(cell, 3).bitwiseOR(F.lit(j)), width).bitwiseOR(_bits(rest, low, n)) for j, (low, n) in enumerate(LEVELS[level + 1])])


def distance(a: Column | str, b: Column | str) -> Column:
    """SCL43: differing bits of two hashes."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def placed_in_cells(hashes: DataFrame) -> DataFrame:
    """(cell, dhash) of each hash in its five cells."""
    return hashes.select(F.explode(cells_of(F.col("dhash"))).alias("cell"), "dhash")


def full_cells(entries: DataFrame, most: int) -> DataFrame:
    """(cell) of the cells with more than ``most`` entries."""
    return entries.groupBy("cell").agg(F.count("*").alias("size")).filter(F.col("size") > most).select("cell")


def descended(entries: DataFrame, split: DataFrame, level: int) -> DataFrame:
    """``entries`` (cell, dhash, ...) with those in the cells ``split`` (cell) of ``level`` moved to these cells' children."""
    marked = split.withColumn("__split", F.lit(True))
    flagged = entries.join(F.broadcast(marked) if level == 0 else marked, "cell", "left")  # MOST_CELLS rows at most
    place = F.when(F.col("__split"), child_cells(F.col("cell"), F.col("dhash"), level)).otherwise(F.array("cell"))
    return flagged.withColumn("cell", F.explode(place)).drop("__split").select(entries.columns)


def near_links(new: DataFrame, old: DataFrame | None = None, hot_cell: int = HOT_CELL) -> DataFrame:
    """(a, b, old): a hash of ``new`` and one within the radius, which is of ``old`` or a larger one of ``new``.

    Both hold (cell, dhash), each hash once. Cells with more than ``hot_cell`` hashes are split by the same
    bound over the other bits, twice if need be; all pairs stay reachable.
    """
    listed = new.withColumn("old", F.lit(False))
    if old is not None:
        listed = listed.unionByName(old.withColumn("old", F.lit(True)))
    probes = new
    for level in (0, 1):
        full = full_cells(listed, hot_cell)
        if level == 0:  # at most MOST_CELLS rows
            rows = [(r["cell"],) for r in full.collect()]
            full = new.sparkSession.createDataFrame(rows, "cell bigint") if rows else None
        elif not full.head(1):
            full = None
        if full is None:
            break
        probes, listed = descended(probes, full, level), descended(listed, full, level)
    probes, lists = probes.withColumnRenamed("dhash", "a"), listed.withColumnRenamed("dhash", "b")
    match = (distance("a", "b") <= RADIUS) & (F.col("old") | (F.col("a") < F.col("b")))
    return probes.join(lists, "cell").filter(match).select("a", "b", "old").distinct()


def keep_first(nodes: DataFrame, rows: int, work: Workspace, name: str, local_rows: int = LOCAL_ROWS, hot_cell: int = HOT_CELL) -> DataFrame:
    """The nodes (key, pixel, dhash, ...) that no kept one before them excludes.

    ``key`` is unique text and gives the order, ``rows`` bounds the number of nodes. NULL hashes equal nothing.
    Up to ``local_rows`` nodes are walked in one task, which looks only into the cells of the kept ones. Of more, those
    that share a hash or lie near another one are settled in rounds over all executors, until so few are left.
    """
    if rows <= local_rows:
        return _walked(nodes)
    nodes = work.save(nodes, f"nodes-{name}")
    hashes = nodes.select("dhash").filter("dhash IS NOT NULL").distinct()
    links = work.save(near_links(placed_in_cells(hashes), None, hot_cell).select("a", "b"), f"near-{name}")
    involved = work.save(_involved(nodes, links), f"involved-{name}")
    kept = involved.join(_rounds(involved.select("key", "pixel", "dhash"), links, work, name, local_rows), "key", "left_semi").select(nodes.columns)
    return nodes.join(involved.select("key"), "key", "left_anti").select(nodes.columns).unionByName(kept)


def _involved(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The nodes that share a hash with another one or lie within the radius of another one."""
    shared = nodes.groupBy("pixel").count().filter("pixel IS NOT NULL AND count > 1").select("pixel", F.lit(True).alias("p"))
    twice = nodes.groupBy("dhash").count().filter("dhash IS NOT NULL AND count > 1").select("dhash")
    near = links.select(F.explode(F.array("a", "b")).alias("dhash")).union(twice).distinct().withColumn("d", F.lit(True))
    return nodes.join(shared, "pixel", "left").join(near, "dhash", "left").filter(F.col("p") | F.col("d")).select(*nodes.columns)


def _walked(nodes: DataFrame) -> DataFrame:
    """In one task; the callers bound the rows."""
    # The hashes go as text, since pandas would make missing ones, and with them all, inexact.
    plain = nodes.withColumn("dhash", F.col("dhash").cast("string"))
    kept = plain.groupBy(F.lit(0).alias("one")).applyInPandas(_walk, plain.schema)
    return kept.withColumn("dhash", F.col("dhash").cast("bigint"))


def _walk(nodes: pd.DataFrame) -> pd.DataFrame:
    """The nodes in the order of their keys that no kept one before has the pixel hash of or lies near to."""
    shifts = [(i, low, (1 << n) - 1) for i, (low, n) in enumerate(BANDS)]
    lists: dict[tuple[int, int], list[int]] = defaultdict(list)  # kept hashes by cell; kept ones are far apart, so lists stay short
    pixels, hashes, kept = set(), set(), []
    nodes = nodes.sort_values("key")
    for at, (pixel, dhash) in enumerate(zip(nodes["pixel"].tolist(), nodes["dhash"].tolist(), strict=True)):
        if pixel is not None and pixel in pixels:
            continue
        if dhash is not None:
            if dhash in hashes:
                continue
            own = int(dhash) & ((1 << 64) - 1)
            cells = [(i, (own >> low) & mask) for i, low, mask in shifts]
            if any((own ^ other).bit_count() <= RADIUS for cell in cells for other in lists.get(cell, ())):
                continue
            hashes.add(dhash)
            for cell in cells:
                lists[cell].append(own)
        if pixel is not None:
            pixels.add(pixel)
        kept.append(at)
    return nodes.iloc[kept]


def _rounds(undecided: DataFrame, links: DataFrame, work: Workspace, name: str, few: int) -> DataFrame:
    """(key) of the kept nodes. In each round those that no undecided one precedes are kept and exclude the others around them."""
    both = links.union(links.select("b", "a"))
    kept = undecided.select("key").limit(0)
    step = 0
    while (left := undecided.count()) > few:
        step += 1
        by_pixel = undecided.filter("pixel IS NOT NULL").groupBy("pixel").agg(F.min("key").alias("pixel_first"))
        by_hash = undecided.filter("dhash IS NOT NULL").groupBy("dhash").agg(F.min("key").alias("first"))
        around = both.join(by_hash, both["b"] == by_hash["dhash"]).select(F.col("a").alias("dhash"), "first").unionByName(by_hash).groupBy("dhash").agg(F.min("first").alias("hash_first"))
        seen = undecided.join(by_pixel, "pixel", "left").join(around, "dhash", "left")
        # The first around a hash may be its own: then nothing precedes it. A later one around changes nothing.
        first = (F.coalesce("pixel_first", "key") == F.col("key")) & (F.coalesce("hash_first", "key") == F.col("key"))
        heads = work.save(seen.filter(first).select("key", "pixel", "dhash"), f"heads-{name}-{step}")
        hashes = heads.select("dhash").filter("dhash IS NOT NULL")
        blocked = both.join(hashes, both["a"] == hashes["dhash"]).select(F.col("b").alias("dhash")).union(hashes).distinct()
        pixels = heads.select("pixel").filter("pixel IS NOT NULL")
        undecided = undecided.join(heads.select("key"), "key", "left_anti").join(pixels, "pixel", "left_anti").join(blocked, "dhash", "left_anti")
        undecided = work.save(undecided.select("key", "pixel", "dhash"), f"undecided-{name}-{step}")
        kept = kept.union(heads.select("key"))
    return kept.union(_walked(undecided).select("key")) if left else kept
