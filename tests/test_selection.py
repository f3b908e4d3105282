"""Selection against the sequential walk it replaces."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sievemill.functions.hashing import SEPARATOR
from sievemill.operators import conflicts, passages, sampling, selection
from sievemill.plans import datasets
from sievemill.session import Workspace

SEED = 11


def near(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1") <= 4


def some_rows(rng, n, keys):
    """Rows with equal, near and missing hashes."""
    base = [rng.getrandbits(63) for _ in range(max(2, n // 6))]
    for i in range(n):
        h = rng.choice(base)
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 6])):
            h ^= 1 << rng.randrange(63)
        yield (keys + str(i), bytes([rng.randrange(n)]) if rng.random() < 0.8 else None, h if rng.random() < 0.9 else None, rng.random() < 0.5, "s", i, f"{keys}{i}")


def digest(label, group):
    import hashlib

    return hashlib.sha256(f"{SEED}{SEPARATOR}{label}{SEPARATOR}{group}".encode()).hexdigest()


def walk(rows, quotas, label, held, stratified):
    """The plain algorithm: row by row, first come first served."""
    need, out = dict(quotas), []
    for r in sorted(rows, key=lambda r: digest(label, r[0])):
        if not any(need.values()):
            break
        flag = r[3] if stratified else None
        if not need.get(flag):
            continue
        if any(r[0] == h[0] or (r[1] is not None and r[1] == h[1]) or (r[2] is not None and h[2] is not None and near(r[2], h[2])) for h in held):
            continue
        held.append(r)
        out.append(r[0])
        need[flag] -= 1
    return None if any(need.values()) else out


SCHEMA = "group_key string, pixel binary, dhash bigint, flag boolean, source_key string, source_row_id bigint, sample_id string"


def test_choose_equals_the_walk(spark):
    rng = random.Random(3)
    rows = list(some_rows(rng, 60, "g"))
    df = spark.createDataFrame(rows, SCHEMA)
    occupied, held = selection.Occupied(Workspace(spark, "t")), []
    for label, n in (("test", 6), ("val", 5)):
        got = {r["group_key"] for r in selection.choose(df, n, SEED, label, occupied).collect()}
        assert got == set(walk(rows, {None: n}, label, held, False))
    with pytest.raises(ValueError):
        selection.choose(df, 1000, SEED, "train", occupied)


def test_quotas_equal_the_walk(spark):
    for seed in (1, 2):
        rng = random.Random(seed)
        rows = list(some_rows(rng, 70, "q"))
        quotas = {True: 3, False: 9}
        want = walk(rows, quotas, "train", [], True)
        got = selection.choose_quotas(spark.createDataFrame(rows, SCHEMA), quotas, SEED, "train", selection.Occupied(Workspace(spark, "t")))
        assert sorted(r["group_key"] for r in got.collect()) == sorted(want)


def test_conflicts_in_rounds_and_in_split_cells(spark):
    rng = random.Random(9)
    rows = [(f"{i:04d}", p, h) for i, (_, p, h, *_) in enumerate(some_rows(rng, 150, "c"))]
    df = spark.createDataFrame(rows, "key string, pixel binary, dhash bigint")
    kept = []
    for k, p, h in rows:
        if not any((p is not None and p == q) or (h is not None and g is not None and near(h, g)) for _, q, g in kept):
            kept.append((k, p, h))
    hashes = conflicts.placed_in_cells(df.filter("dhash IS NOT NULL").select("dhash").distinct())
    distinct = sorted({h for _, _, h in rows if h is not None})
    for hot, local in ((1024, 10**6), (0, 0), (3, 0), (3, 20)):
        links = conflicts.near_links(hashes, hot_cell=hot).select("a", "b")
        assert {(r["a"], r["b"]) for r in links.collect()} == {(a, b) for a in distinct for b in distinct if a < b and near(a, b)}
        got = conflicts.keep_first(df, 10**5, Workspace(spark, "t"), "t", local, hot)
        assert sorted(r["key"] for r in got.collect()) == [k for k, _, _ in kept]
    none = df.limit(0)
    assert conflicts.keep_first(none, 0, Workspace(spark, "t"), "t").count() == 0
    assert conflicts.keep_first(none, 1, Workspace(spark, "t"), "t", 0).count() == 0


def test_largest_remainder_and_proportional(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 3), (None, 2)], "k string, n bigint")
    assert {r["k"]: r["quota"] for r in sampling.largest_remainder(counts, ["k"], 5).collect()} == {"a": 3, "b": 1, None: 1}  # 2.5, 1.5, 1: of equal remainders the first key's
    df = spark.createDataFrame([("a" if i % 4 else None, f"id{i}") for i in range(40)] + [("a", None)], "k string, id string")
    got = sampling.proportional(df, ["k"], "id", 8, 1).collect()
    assert sorted((r["k"] or "") for r in got) == ["", ""] + ["a"] * 6


def test_samplers(spark):
    df = spark.createDataFrame([("xy"[i % 2], f"p{i % 7}", f"id{i}", ["yes", "no"][i % 3 > 0]) for i in range(60)], "s string, image string, id string, a string")
    assert sampling.unique_images(df, "image", "id", 5, 1, df.filter("image = 'p1'").select("image")).select("image").distinct().count() == 5
    got = sampling.scarcest_first(df, "s", "image", "id", {"x": 3, "y": 4}, 1)
    assert (got.count(), got.select("image").distinct().count()) == (7, 7)
    pairs = sampling.yes_no_pairs(df, ["s"], "image", F.col("a"), "id", 2, 1).collect()
    assert len(pairs) == 4 and all(p["yes_id"] != p["no_id"] for p in pairs)
    assert sampling.distinct_versions(df, "s", "image", "id", ["x", "y"], 3, 1).select("image").distinct().count() == 6
    turns = sampling.round_robin(df.filter("id <> 'id0'"), "s", "id", 1)
    assert turns.count() == 58
    quotas = sampling.balanced_quotas(11, ["a", "b", "c"], 5)
    assert sum(quotas.values()) == 11 and max(quotas.values()) - min(quotas.values()) == 1


def test_all_invalid_samples_are_replaced_as_in_the_walk(spark, tmp_path):
    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(60)]
    columns = "sample_id string, group_key string, doc_id string, pixel_sha256 string, dhash string, use_tool string, source_key string, source_row_id bigint, batch_no int, replacement_meta struct<reason:string>"
    rows = []
    for i in range(160):
        h = rng.choice(base) ^ (1 << rng.randrange(63))
        invalid = 20 <= i < 40
        batch = 0 if i < 20 else 1
        rows.append((f"s{i:03d}", f"g{i if i % 7 else i // 2}", None, f"{rng.randrange(120):x}", f"{h:016x}", rng.choice(["true", "False"]), "smart_train", i, batch, ("bad",) if invalid else None))
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/manifest.parquet")
    sha = lambda *parts: hashlib.sha256(SEPARATOR.join(map(str, parts)).encode()).hexdigest()

    flag = {r[0]: r[5] == "true" for r in rows}
    invalid = sorted(r[0] for r in rows if r[9])
    held = [(r[1], r[3], int(r[4], 16)) for r in rows if r[8] == 0 or r[9]]
    first = {}
    for r in rows:
        score = sha(datasets.SEED, r[6], r[1], r[7])
        if r[1] not in first or score < first[r[1]][0]:
            first[r[1]] = (score, r)
    need = {f: sum(flag[s] == f for s in invalid) for f in (True, False)}
    new = {True: [], False: []}
    for _, r in sorted(first.values(), key=lambda x: sha(datasets.SEED + 1, "train-replacement", x[1][1])):
        f, h = flag[r[0]], int(r[4], 16)
        if len(new[f]) < need[f] and not any(r[1] == g or r[3] == p or near(h, d) for g, p, d in held):
            held.append((r[1], r[3], h))
            new[f].append(r[0])
    assert len(invalid) == 20 and all(len(new[f]) == need[f] for f in need)
    want = {(old, n, f) for f in need for old, n in zip([s for s in invalid if flag[s] == f], new[f], strict=True)}
    got = datasets.smp04(spark, str(tmp_path)).collect()
    assert {(r["old_sample_id"], r["sample_id"], r["flag"]) for r in got} == want and len(got) == 20
    with pytest.raises(ValueError, match="only .* rows for train-replacement"):
        selection.replacements(spark.read.parquet(f"{tmp_path}/manifest.parquet"), spark.createDataFrame([(r[0], True) for r in rows], "sample_id string, flag boolean"), SEED)


def test_versions_share_no_picture(spark):
    rng = random.Random(6)
    rows = [(rng.choice("xy"), f"p{rng.randrange(30)}", f"id{i}", f"i{rng.randrange(25)}" if i % 9 else None) for i in range(90)]
    df = spark.createDataFrame(rows, "s string, problem string, id string, image string")
    forbidden = spark.createDataFrame([("i1",), ("i2",), ("i3",)], "image string")
    used, want = [set(), set(), {"i1", "i2", "i3"}], []
    for v in "xy":
        picked = []
        for r in sorted((r for r in rows if r[0] == v and r[3]), key=lambda r: hashlib.sha256(f"1:{v}:{r[2]}".encode()).hexdigest()):
            if len(picked) < 8 and not any(x in u for x, u in zip((r[1], r[2], r[3]), used, strict=True)):
                picked.append(r)
                for x, u in zip((r[1], r[2], r[3]), used, strict=True):
                    u.add(x)
        assert len(picked) == 8
        want += [(v, r[1], r[2], r[3]) for r in picked]
    got = sampling.distinct_versions(df, "s", "problem", "id", ["x", "y"], 8, 1, "image", forbidden).select("s", "problem", "id", "image").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    with pytest.raises(ValueError, match="of 20 rows for"):
        sampling.distinct_versions(df, "s", "problem", "id", ["x", "y"], 20, 1, "image", forbidden)


def test_passages_are_found_anywhere(spark):
    bench = ["# Run 7\n| total | 500 |\nWas the tool drawer photographed twice, or is the left-hand copy a reprint? Yes.\n照片来自同一个码头，只是角度不同。", "Short text"]
    common = "The low-resolution view drops the last digit of every long number."
    texts = {
        "inside a line": "Before that. Was the tool drawer photographed twice, or is the left-hand copy a reprint? After that.",
        "short lines together": "x\n# Run 7\n| total | 500 |\nWas the tool drawer photographed twice, or is the left-hand copy a reprint? No.",
        "chinese": "别的。照片来自同一个码头，只是角度不同。别的。",
        "short text": "Longer one.\nShort text\nand more words than the other one has got.",
        "heading only": "# Run 7\nSomething else is said here, in a sentence of its own.",
        "other": "Was the tool drawer photographed once, or is the right-hand copy a reprint?",
        "empty": "",
        "null": None,
    } | {f"boilerplate {i}": f"{common} {i}" for i in range(passages.COMMON + 1)}
    rows = [(f"bench {i}", "bench", t) for i, t in enumerate([*bench, common])] + [(k, "web", t) for k, t in texts.items()] + [("no source", None, bench[0])]
    df = spark.createDataFrame(rows, "id string, source string, text string")
    got = {r["id"] for r in passages.without_passages(df, F.col("source") == "bench", "id", "text").collect()}
    assert got == set(texts) - {"inside a line", "short lines together", "chinese", "short text"}
