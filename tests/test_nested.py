"""Problem 5 against json, on hand-made and random texts."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from sievemill.operators import nested


def index_of(*texts):
    raw = [t.encode() for t in texts]
    return nested.structural_index(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])


def value(rng, depth):
    kind = rng.randrange(8 if depth < 5 else 4)
    if kind == 0:
        return rng.choice([None, True, False, -1.5e3, 0, 12])
    if kind < 4:
        return rng.choice(["", "a", 'q"uo', "back\\slash", '\\"', "br[a]c{k}e,t:s", "ü中\n", "\\\\"])
    if kind < 6:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b", 'k"', "x\\"]) + str(i): value(rng, depth + 1) for i in range(rng.randrange(4))}


def walk(v, path):
    """(path with [] and {}, place) of every value below."""
    if isinstance(v, list):
        for i, x in enumerate(v):
            yield (*path, str(i)), x
            yield from walk(x, (*path, str(i)))


def test_slots_of_random_texts():
    rng = random.Random(5)
    values = [value(rng, 0) for _ in range(400)]
    values = [v for v in values if isinstance(v, (list, dict))]
    for gap in (None, (" ,\n", " :\t")):
        texts = [json.dumps(v, ensure_ascii=False, **({"separators": gap} if gap else {})) for v in values]
        index = index_of(*texts)
        assert index.well_formed.all()
        tokens = [json.loads(index.buffer[s:e].tobytes()) for s, e in zip(index.start, index.end)]

        def below(v):
            kids = v if isinstance(v, list) else v.values() if isinstance(v, dict) else []
            return [x for k in kids for x in (k, *below(k))]

        assert sorted(map(json.dumps, tokens)) == sorted(json.dumps(x) for v in values for x in below(v))


def test_paths_and_places():
    docs = [{"m": {"p": [{"a": [1, None, {"z": 2}]}, None, {"a": []}, {"b": 1}], "u": {"k.1": 5, 'q"': None, "é": 7}}}, {"m": None}, {"m": {"p": None}}, [], {"x": "m"}]
    walk_ = nested._Walk(index_of(*[json.dumps(d) for d in docs]))
    assert walk_.rows("m.p[]")[1] == ["0", "2", "3"]
    rows, places, _ = walk_.rows("m.p[].a[]")
    assert (rows.tolist(), places) == ([0, 0], ["0.0", "0.2"])
    assert walk_.rows("m.u{}")[1] == ["k.1", "é"]
    assert walk_.rows("m.x[]")[1] == []


def test_malformed_texts_have_no_children():
    good = '{"a":[1,2]}'
    bad = ['{"a":[1,2}', '{"a":[1,2]', '"a', "", "7", "[1]]", '{"a":[1,"2]}', "]["]
    for b in bad:
        walk_ = nested._Walk(index_of(good, b, good))
        rows, places, _ = walk_.rows("a[]")
        assert (rows.tolist(), places) == ([0, 0, 2, 2], ["0", "1", "0", "1"]), b


def rows_of(spark, json_rows, schema):
    return spark.createDataFrame([(i, r) for i, r in enumerate(json_rows)], "id int, r string").select("id", F.from_json("r", schema).alias("r")).select("id", "r.*")


SCHEMA = """annotation_id bigint, box string,
  region_annotation struct<reference_boxes:array<array<double>>,reference_boxes_pixels:array<array<bigint>>>,
  quality_checks struct<schema_normalizations:array<string>>,
  annotation_meta struct<usage:map<string,bigint>,attempts:array<struct<attempt:int,http_status:int,error:string>>,
    prior_records:array<struct<request_fingerprint:string,created_at:string,attempts:array<struct<attempt:int,http_status:int,error:string>>>>>"""


def test_children_of_annotations(spark):
    full = {
        "annotation_id": 1,
        "box": "a clashing name",
        "region_annotation": {"reference_boxes": [[0.1, 0.2], None, []], "reference_boxes_pixels": [None, None, None, [1]]},
        "quality_checks": {"schema_normalizations": ["", None, 'say "hi" \\ [x] ' + "long " * 50_000]},
        "annotation_meta": {"usage": {"a": 1, "b": None}, "attempts": [None, {"attempt": 2}], "prior_records": [None, {"created_at": "t", "attempts": [{"error": "e"}, None]}]},
    }
    rows = [full, full, {"annotation_id": 2}, {"annotation_id": None, "quality_checks": {"schema_normalizations": ["n"]}}, {"annotation_id": 3, "annotation_meta": {"prior_records": []}}]
    df = rows_of(spark, [json.dumps(r) for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in nested.children_found(df.filter("annotation_id = 1")).collect())
    assert got == sorted(
        [(1, "box", "0"), (1, "box", "2"), (1, "box", "3"), (1, "normalization", "0"), (1, "normalization", "2"), (1, "usage", "a"), (1, "attempt", "1"), (1, "prior", "1"), (1, "prior_attempt", "1.0")]
    )
    assert [tuple(r) for r in nested.children_found(df.filter("annotation_id IS NULL")).collect()] == [(None, "normalization", "0")]
    assert nested.children_found(df.filter("annotation_id IN (2, 3)")).count() == 0
    assert nested.children_found(df.limit(0)).count() == 0
    longest = nested.normalizations(df).filter("pos = 2").head()["normalization"]
    assert longest == full["quality_checks"]["schema_normalizations"][2]
    boxes = {r["pos"]: (r["box"], r["box_pixels"]) for r in nested.boxes(df).collect()}
    assert boxes == {0: ([0.1, 0.2], None), 2: ([], None), 3: (None, [1])}
    tries = sorted((r["prior_pos"] is None, r["pos"], r["attempt"], r["error"]) for r in nested.attempts(df).collect())
    assert tries == [(False, 0, None, "e"), (True, 1, 2, None)]
    assert [tuple(r) for r in nested.usage(df).collect()] == [(1, "a", 1)]
