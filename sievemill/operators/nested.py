"""Problem 5: flat, linked tables out of deeply nested records, by structural indexing of their JSON text.

A batch of JSON texts is one byte buffer. Bitmaps of quotes, brackets and delimiters over the whole buffer
give, without looking at single characters in Python: which quotes are escaped, which structural
characters lie in strings (parity of the running quote count), the nesting depth (prefix sum of brackets),
the container of every delimiter (stable sort by depth) and the byte span of every value. Paths such as
``annotation_meta.prior_records[].attempts[]`` then select spans, and each becomes a row that names its
record and its place.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are indexed at once; a longer single text is indexed alone.
CHUNK_BYTES = 2 << 20

QUOTE, BACKSLASH, COMMA, COLON = b'"\\,:'
OPENS, CLOSES = b"[{", b"]}"
_STRUCTURAL = np.zeros(256, bool)
_STRUCTURAL[list(b'"[]{}:,')] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\r\n")] = True


@dataclass
class Index:
    """Structural index of a buffer of texts. Slots are the places of values, each named by the token before it."""

    buffer: np.ndarray
    token: np.ndarray  # byte position of each structural character outside strings, quotes included
    slot: np.ndarray  # token before the value, ascending
    container: np.ndarray  # of each slot: token of the bracket around it
    rank: np.ndarray  # of each slot: its position in its container
    start: np.ndarray  # of each slot: first byte of its value
    end: np.ndarray  # of each slot: byte after its value
    root: np.ndarray  # of each text: token of its outermost bracket, or -1
    well_formed: np.ndarray  # of each text


def structural_index(buffer: np.ndarray, offsets: np.ndarray) -> Index:
    """Index texts ``buffer[offsets[i]:offsets[i + 1]]``. Texts that aren't balanced JSON objects or arrays get no slots."""
    texts = len(offsets) - 1
    quotes = buffer == QUOTE
    slashes = np.flatnonzero(buffer == BACKSLASH)
    if len(slashes):  # a run of backslashes of odd length escapes what follows it
        first = np.r_[True, np.diff(slashes) > 1]
        begin = slashes[first]
        length = np.diff(np.r_[np.flatnonzero(first), len(slashes)])
        after = (begin + length)[length % 2 == 1]
        quotes[after[after < len(buffer)]] = False
    marks = _STRUCTURAL[buffer] & ((buffer != QUOTE) | quotes)
    token = np.flatnonzero(marks)
    kind = buffer[token]
    text = np.searchsorted(offsets, token, "right") - 1
    bounds = np.searchsorted(token, offsets)

    is_quote = kind == QUOTE
    seen = np.cumsum(is_quote)
    before_text = np.r_[0, seen][bounds[:-1]]
    inside = ((seen - before_text[text]) % 2 == 1) & ~is_quote
    odd = (np.r_[0, seen][bounds[1:]] - before_text) % 2 == 1
    keep = ~inside
    token, kind, text = token[keep], kind[keep], text[keep]
    bounds = np.searchsorted(token, offsets)

    opens = (kind == OPENS[0]) | (kind == OPENS[1])
    closes = (kind == CLOSES[0]) | (kind == CLOSES[1])
    depth = np.cumsum(opens.astype(np.int64) - closes)
    depth -= np.r_[0, depth][bounds[:-1]][text]
    level = depth + closes  # of the container a token opens, closes or divides

    n = len(token)
    bracket = np.flatnonzero(opens | closes)
    bad = odd.copy()
    if n:
        has = bounds[1:] > bounds[:-1]
        bad[has] |= depth[bounds[1:][has] - 1] != 0
        np.logical_or.at(bad, text[depth < 0], True)
        outside = (level == 0) & ~is_quote[keep]
        np.logical_or.at(bad, text[outside], True)
    order = np.argsort(level[~is_quote[keep]], kind="stable")
    frame = np.flatnonzero(~is_quote[keep])[order]  # brackets and delimiters, by level, in order within it
    frame_open = opens[frame]
    owner = np.maximum.accumulate(np.where(frame_open, np.arange(len(frame)), -1)) if len(frame) else np.zeros(0, int)
    owner_token = np.where(owner >= 0, frame[owner], -1) if len(frame) else owner
    # A close must match the bracket that it closes.
    if len(frame):
        shut = closes[frame] & (owner_token >= 0)
        wrong = shut & (kind[frame] != kind[np.maximum(owner_token, 0)] + 2)
        np.logical_or.at(bad, text[frame[wrong]], True)
    in_array = kind[np.maximum(owner_token, 0)] == OPENS[0]
    starts = np.where(in_array, frame_open | (kind[frame] == COMMA), kind[frame] == COLON) & (owner_token >= 0)
    commas = np.cumsum((kind[frame] == COMMA) & (owner_token >= 0))
    rank = commas - commas[np.maximum(owner, 0)] if len(frame) else commas

    at = np.flatnonzero(starts[:-1]) if len(frame) else np.zeros(0, int)  # a slot ends at the next token of its level
    slot, container, rank = frame[at], owner_token[at], rank[at]
    follows = frame[at + 1]
    same = owner_token[at + 1] == container
    start, end = token[slot] + 1, token[follows]
    start, end = _strip(buffer, start, end)
    ok = same & (start < end) & ~bad[text[slot]]
    slot, container, rank, start, end = (x[ok] for x in (slot, container, rank, start, end))
    by = np.argsort(slot)
    root = np.full(texts, -1, np.int64)
    if len(bracket):
        first = np.full(texts, -1, np.int64)
        firsts, where = np.unique(text, return_index=True)
        first[firsts] = where
        good = (first >= 0) & ~bad
        good[good] &= opens[first[good]]
        root[good] = first[good]
    return Index(buffer, token, slot[by], container[by], rank[by], start[by], end[by], root, ~bad & (root >= 0))


def _strip(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    while len(more := np.flatnonzero((start < end) & _BLANK[buffer[np.minimum(start, len(buffer) - 1)]])):
        start[more] += 1
    while len(more := np.flatnonzero((start < end) & _BLANK[buffer[np.maximum(end - 1, 0)]])):
        end[more] -= 1
    return start, end


def _steps(path: str) -> list[str]:
    return re.findall(r"\[\]|\{\}|[^.\[\]{}]+", path)


class _Walk:
    """Follows paths through an index."""

    def __init__(self, index: Index):
        self.index = index
        self.by_container = np.argsort(index.container, kind="stable")
        self.sorted_container = index.container[self.by_container]

    def _text(self, begin: int, end: int) -> str:
        raw = self.index.buffer[begin:end].tobytes()
        return json.loads(b'"' + raw + b'"') if b"\\" in raw else raw.decode()

    def _key_spans(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        token = self.index.token
        at = self.index.slot[slots]  # the colon; the two tokens before it are the key's quotes
        return token[at - 2] + 1, token[at - 1]

    def _inner(self, slots: np.ndarray, bracket: int) -> np.ndarray:
        """Token of the bracket that the value of a slot opens, else -1."""
        return np.where(self.index.buffer[self.index.start[slots]] == bracket, self.index.slot[slots] + 1, -1)

    def _children(self, container: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``container``, slot) of all slots of the containers, in order."""
        low = np.searchsorted(self.sorted_container, container, "left")
        high = np.searchsorted(self.sorted_container, container, "right")
        count = np.where(container >= 0, high - low, 0)
        parent = np.repeat(np.arange(len(container)), count)
        inside = np.arange(len(parent)) - np.repeat(np.cumsum(count) - count, count)
        return parent, self.by_container[low[parent] + inside]

    def rows(self, path: str) -> tuple[np.ndarray, list[str], np.ndarray]:
        """(text, position, slot) of every value that the path names and that isn't null."""
        index = self.index
        text = np.flatnonzero(index.root >= 0)
        brackets = index.root[text]
        slots: np.ndarray | None = None
        places: list[list[str]] = []
        for step in _steps(path):
            if slots is not None:
                brackets = self._inner(slots, OPENS[0] if step == "[]" else OPENS[1])
            else:
                wanted = OPENS[0] if step == "[]" else OPENS[1]
                brackets = np.where(index.buffer[index.token[brackets]] == wanted, brackets, -1)
            parent, slots = self._children(brackets)
            if step == "[]":
                label = [str(r) for r in index.rank[slots].tolist()]
            elif step == "{}":
                begin, end = self._key_spans(slots)
                label = [self._text(b, e) for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
            else:
                hit = self._named(slots, step)
                parent, slots = parent[hit], slots[hit]
                label = None
            text = text[parent]
            places = [[p[i] for i in parent.tolist()] for p in places]
            if label is not None:
                places.append(label)
        assert slots is not None
        begin = index.start[slots]
        there = ~((index.end[slots] - begin == 4) & (index.buffer[begin] == ord("n")))
        text, slots = text[there], slots[there]
        positions = [".".join(x) for x in zip(*places, strict=True)] if places else [""] * len(there)
        return text, [p for p, t in zip(positions, there.tolist(), strict=True) if t], slots

    def _named(self, slots: np.ndarray, key: str) -> np.ndarray:
        """Positions in ``slots`` whose key is ``key``."""
        raw = np.frombuffer(json.dumps(key, ensure_ascii=False)[1:-1].encode(), np.uint8)
        begin, end = self._key_spans(slots)
        hit = np.flatnonzero(end - begin == len(raw))
        if len(hit) and len(raw):
            hit = hit[(self.index.buffer[begin[hit][:, None] + np.arange(len(raw))] == raw).all(axis=1)]
        return hit


def _spans(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans as an Arrow string array."""
    length = end - start
    offsets = np.r_[0, np.cumsum(length)]
    take = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - start, length)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(buffer[take]))


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    begin, n = 0, len(offsets) - 1
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + CHUNK_BYTES, "right")) - 1)
        yield begin, end
        begin = end


def child_rows(df: DataFrame, ids: Sequence[str], text: Column, tables: dict[str, list[str]], values: bool = True) -> DataFrame:
    """Rows (ids..., child, path, pos, value) of every value that the tables' paths name in the JSON ``text``.

    ``tables`` maps a child table to its paths. In a path, ``[]`` stands for the elements of an array and ``{}``
    for the entries of an object; ``pos`` joins their positions and keys by dots. ``value`` is the JSON text
    of the value (NULL without ``values``). JSON null is no value. A NULL or blank text, and one whose
    quotes or brackets don't balance, has no children. Of an object's repeated key all values count.
    """
    fields = [df.select(i).schema[0] for i in ids]
    schema = T.StructType([*fields, *(T.StructField(c, T.StringType()) for c in ("child", "path", "pos", "value"))])
    paths = [(t, p) for t, ps in tables.items() for p in ps]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1).cast(pa.large_string()).fill_null("")
            if not len(column):
                continue
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
            for begin, end in _chunks(offsets):
                own = offsets[begin : end + 1]
                index = structural_index(data[own[0] : own[-1]], own - own[0])
                walk = _Walk(index)
                for table, path in paths:
                    rows, places, slots = walk.rows(path)
                    if not len(rows):
                        continue
                    taken = pa.array(rows + begin)
                    value = _spans(index.buffer, index.start[slots], index.end[slots]) if values else pa.nulls(len(rows), pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(i).take(taken) for i in range(len(ids))), pa.array([table] * len(rows)), pa.array([path] * len(rows)), pa.array(places, pa.string()), value],
                        names=[*ids, "child", "path", "pos", "value"],
                    )

    return df.select(*ids, text.alias("__text")).mapInArrow(run, schema)


def json_text(*columns: str) -> Column:
    """The columns as one JSON object, with nulls, so that positions are those of the arrays as delivered."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


# The child tables of an annotation.
ANNOTATION_CHILDREN = {
    "box": ["region_annotation.reference_boxes[]", "region_annotation.reference_boxes_pixels[]"],
    "normalization": ["quality_checks.schema_normalizations[]"],
    "attempt": ["annotation_meta.attempts[]"],
    "prior": ["annotation_meta.prior_records[]"],
    "prior_attempt": ["annotation_meta.prior_records[].attempts[]"],
    "usage": ["annotation_meta.usage{}"],
}
NESTED = ["region_annotation", "quality_checks", "annotation_meta"]


def annotation_children(annotations: DataFrame, tables: Sequence[str] | None = None, values: bool = True) -> DataFrame:
    """(annotation_id, child, path, pos, value) of the child tables; exact copies of an annotation give copies of rows."""
    own = {t: ANNOTATION_CHILDREN[t] for t in tables or ANNOTATION_CHILDREN}
    roots = sorted({p.split(".")[0] for ps in own.values() for p in ps})
    return child_rows(annotations, ["annotation_id"], json_text(*roots), own, values)


def children_found(annotations: DataFrame) -> DataFrame:
    """(annotation_id, child, pos) of every child, once."""
    return annotation_children(annotations, values=False).select("annotation_id", "child", "pos").distinct()


def boxes(annotations: DataFrame) -> DataFrame:
    """(annotation_id, pos, box, box_pixels) of every position that has one of the two; malformed boxes keep their readable members."""
    rows = annotation_children(annotations, ["box"])
    pixels = F.col("path").contains("pixels")
    return (
        rows.groupBy("annotation_id", F.col("pos").cast("int").alias("pos"))
        .agg(F.max(F.when(~pixels, F.col("value"))).alias("b"), F.max(F.when(pixels, F.col("value"))).alias("p"))
        .select("annotation_id", "pos", F.from_json("b", "array<double>").alias("box"), F.from_json("p", "array<bigint>").alias("box_pixels"))
    )


ATTEMPT = "struct<attempt:int,http_status:int,error:string>"


def attempts(annotations: DataFrame) -> DataFrame:
    """(annotation_id, prior_pos, pos, attempt, http_status, error); prior_pos is NULL for the record's own attempts."""
    rows = annotation_children(annotations, ["attempt", "prior_attempt"]).distinct()
    place = F.split("pos", r"\.")
    return rows.select("annotation_id", F.when(F.col("child") == "prior_attempt", place[0].cast("int")).alias("prior_pos"), F.element_at(place, -1).cast("int").alias("pos"), F.from_json("value", ATTEMPT).alias("a")).select("annotation_id", "prior_pos", "pos", "a.*")


def priors(annotations: DataFrame) -> DataFrame:
    """(annotation_id, pos, request_fingerprint, created_at) of the prior records."""
    rows = annotation_children(annotations, ["prior"]).distinct()
    return rows.select("annotation_id", F.col("pos").cast("int").alias("pos"), F.from_json("value", "struct<request_fingerprint:string,created_at:string>").alias("r")).select("annotation_id", "pos", "r.*")


def usage(annotations: DataFrame) -> DataFrame:
    """(annotation_id, key, tokens) of the usage counters."""
    return annotation_children(annotations, ["usage"]).select("annotation_id", F.col("pos").alias("key"), F.col("value").cast("bigint").alias("tokens")).distinct()


def normalizations(annotations: DataFrame) -> DataFrame:
    """(annotation_id, pos, normalization)."""
    rows = annotation_children(annotations, ["normalization"]).distinct()
    return rows.select("annotation_id", F.col("pos").cast("int").alias("pos"), F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), "v string")["v"].alias("normalization"))


def parents(annotations: DataFrame) -> DataFrame:
    """The scalar members, one row per annotation: the table that the children's annotation_id refers to."""
    return annotations.select(
        "annotation_id",
        "sample_id",
        F.col("source_info.use_tool").alias("use_tool"),
        F.col("source_info.tgt_width").alias("tgt_width"),
        F.col("source_info.tgt_height").alias("tgt_height"),
        F.col("region_annotation.status").alias("status"),
        F.col("region_annotation.answer_from_image").alias("answer_from_image"),
        F.col("region_annotation.coordinate_system").alias("coordinate_system"),
        F.col("quality_checks.answer_match.match").alias("answer_matches"),
        F.col("quality_checks.answer_match.method").alias("answer_method"),
        F.col("quality_checks.valid_annotation").alias("valid_annotation"),
        F.col("quality_checks.accepted_by_answer").alias("accepted_by_answer"),
        F.col("quality_checks.region_reward_eligible").alias("region_reward_eligible"),
        F.col("quality_checks.localization_review").alias("localization_review"),
        F.col("annotation_meta.provider").alias("provider"),
        F.col("annotation_meta.requested_model").alias("requested_model"),
        F.col("annotation_meta.request_fingerprint").alias("request_fingerprint"),
        F.col("annotation_meta.created_at").alias("created_at"),
        F.col("annotation_meta.elapsed_seconds").alias("elapsed_seconds"),
    ).distinct()
