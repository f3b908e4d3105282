"""Problems 2, 3 and 4."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sievemill.functions.hashing import stable_score
from sievemill.llm import quota_sample, splits, stable_sample

MANIFEST = "sample_id string, batch_no int, group_key string, doc_id string, pixel_sha256 string, split string, selection_seed bigint, selection_score string, replacement_meta struct<reason:string>, unit string, use_tool string"


def manifest(spark, rows):
    full = [(r.get("s"), r.get("b", 0), r.get("g"), r.get("d"), r.get("p"), r.get("split"), r.get("seed", 7), r.get("score"), r.get("meta"), "clash", r.get("tool")) for r in rows]
    return spark.createDataFrame(full, MANIFEST)


def test_wrong_scores(spark):
    score = lambda label, g: spark.range(1).select(stable_score(7, F.lit(label), F.lit(g))).head()[0]
    good, replaced = score("train", "doc:1"), score("train-replacement", "doc:1")
    rows = [
        {"s": "ok", "g": " DOC:1", "split": "Training ", "score": f" {good.upper()}\n"},
        {"s": "meta", "g": "doc:1", "split": "test", "score": replaced, "meta": ("r",)},
        {"s": "cut", "g": "doc:1", "split": "train", "score": good[:32]},
        {"s": "none", "g": "doc:1", "split": "train"},
        {"s": "none", "g": "doc:1", "split": "train"},
        {"s": "blank", "g": "doc:1", "split": "train", "score": " "},
        {"s": "no split", "g": "doc:1", "split": " "},
        {"s": "no seed", "g": "doc:1", "split": "train", "seed": None, "score": good},
        {"s": "no key", "split": "train", "score": good},
        {"s": "meta2", "g": "doc:1", "split": "train", "score": good, "meta": ("r",)},
    ]
    got = sorted(r["sample_id"] for r in stable_sample.wrong_scores(manifest(spark, rows)).collect())
    assert got == ["blank", "cut", "meta2", "no key", "no seed", "none"]
    assert stable_sample.wrong_scores(manifest(spark, [])).count() == 0


def test_the_sample_only_grows(spark):
    rng = random.Random(4)
    rows = [{"s": f"s{i}", "b": i % 10, "g": rng.choice([f"doc:{i % 300}", f"DOC: {i % 300}", None])} for i in range(2000)] + [{"s": "n", "b": None, "g": "doc:1"}]
    df = manifest(spark, rows)
    before = set()
    for b in (0, 4, 9):
        now = {r["sample_id"] for r in stable_sample.sample(df, b).collect()}
        assert before <= now
        before = now
    again = {r["sample_id"] for r in stable_sample.sample(df.repartition(7), 9).collect()}
    assert again == before and 0 < len(before) < 300
    groups = df.select(F.lower(F.regexp_replace("group_key", " ", "")).alias("g")).distinct().count()
    assert 0 < groups
    assert stable_sample.sample(df, rate=0.0).count() == 0


def by_priority(counts, targets, floors, total):
    """All priorities in order."""
    rows = []
    for i, n in enumerate(counts):
        for k in range(1, n + 1):
            rows.append((k > floors[i], Fraction(2 * k - 1, 2 * targets[i]) if targets[i] else 10**9, i))
    rows.sort()
    return [sum(r[2] == i for r in rows[:total]) for i in range(len(counts))]


def test_seats():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randrange(1, 7)
        counts = [rng.choice([0, 1, 5, rng.randrange(60)]) for _ in range(n)]
        targets = [rng.choice([1, 7, 21, rng.randrange(100), 0]) for _ in range(n)]
        floors = [rng.randrange(5) for _ in range(n)]
        total = rng.randrange(sum(counts) + 5)
        got = quota_sample.seats(counts, targets, floors, total)
        want = by_priority(counts, targets, floors, total)
        assert sum(got) == min(total, sum(counts))
        if all(targets) or total <= sum(n for n, t in zip(counts, targets) if t):
            assert got == want, (counts, targets, floors, total)


def test_quota_sample(spark):
    tools = [" TRUE", "1", "false", "0", "maybe", None]
    asked = [(f"s{i}", q, size) for i in range(120) for q, size in [(["table", " ", None, "how many"][i % 4], [[10, 10], [0, 5], None, [300, 300]][(i // 4) % 4])]]
    annotations = spark.createDataFrame(asked + asked[:3] + [(None, "table", [1, 1])], "sample_id string, question string, lowres_size array<bigint>")
    records = manifest(spark, [{"s": f"s{i}", "tool": tools[i % 6]} for i in range(130)] + [{"s": "s0", "b": 3, "tool": "?"}])
    plan = spark.createDataFrame([("table", "small", True, 300, 1), ("table", "small", False, 300, 40), ("count", "medium", True, 400, 0), ("chart", "large", None, 0, 0)], "family string, area string, use_tool boolean, target_per_mille int, min_rows int")
    eligible = {}
    for s, q, size in asked:
        flag = {0: True, 1: True, 2: False, 3: False}.get(int(s[1:]) % 6)
        if q in ("table", "how many") and size in ([10, 10], [300, 300]) and flag is not None:
            eligible[s] = ("table" if q == "table" else "count", "small" if size == [10, 10] else "medium", flag)
    draw = quota_sample.QuotaSample(annotations, records, plan)
    assert draw.size == 2 * len(eligible) // 5
    report = {tuple(r)[:3]: r for r in draw.report.collect()}
    for key, r in report.items():
        assert r["eligible"] == sum(v == key for v in eligible.values())
        assert r["needed"] == max(r["min_rows"], -(-draw.size * r["target_per_mille"] // 1000))
    chosen = [tuple(r)[:4] for r in draw.chosen().collect()]
    assert len({c[0] for c in chosen}) == len(chosen) and all(eligible[c[0]] == c[1:] for c in chosen)
    assert {k: sum(c[1:] == k for c in chosen) for k in report} == {k: r["taken"] for k, r in report.items()}
    assert {tuple(r) for r in draw.short().collect()} == {(*k[:2], str(k[2]).lower()) for k, r in report.items() if r["eligible"] < r["needed"]}
    none = quota_sample.QuotaSample(annotations.limit(0), records.limit(0), plan)
    assert none.size == 0 and none.chosen().count() == 0 and none.short().count() == 2  # those with minimum rows


def test_groups_stay_together(spark):
    rng = random.Random(6)
    rows = []
    for g in range(400):
        label = rng.choice(["train", " TRAIN", "test", "val", "dev", None])
        for k in range(rng.choice([1, 1, 2, 5]) if g else 500):  # the first group holds a third of the rows
            rows.append({"s": f"{g}-{k}", "g": f"doc:{g}", "split": label if rng.random() < 0.97 else "test"})
    rows += rows[:20] + [{"s": "alone"}, {"s": "alone", "b": 1, "split": "val"}, {"s": "alone", "b": 2, "split": "test"}]
    work = splits.GroupSplits(manifest(spark, rows))
    out = [tuple(r) for r in work.assigned().collect()]
    assert len({r[0] for r in out}) == len(out)
    total = len({(r["s"], r.get("b", 0)) for r in rows})
    assert sum(r[2] for r in out) == total
    for split, share in splits.SHARES.items():
        assert sum(r[2] for r in out if r[1] == split) == pytest.approx(share * total, abs=0.01 * total)
    norm = {"train": "train", "TRAIN": "train", "test": "test", "val": "val", "dev": "val"}
    seen = {}
    for r in rows:
        if r.get("split") and r.get("g"):
            seen.setdefault(r["g"], set()).add(norm[r["split"].strip()])
    assert {r[0] for r in work.disagreeing().collect()} == {g for g, s in seen.items() if len(s) > 1}
    assert {tuple(r) for r in splits.GroupSplits(manifest(spark, rows).repartition(3)).assigned().collect()} == set(out)
    assert splits.GroupSplits(manifest(spark, [])).assigned().count() == 0


def test_related_groups_and_mixed_labels(spark):
    rows = [{"s": f"a{i}", "g": f"doc:{i}", "split": "train"} for i in range(300)]
    rows += [{"s": f"b{i}", "b": b, "g": f"doc:{i + b}", "split": "test"} for b in (0, 1) for i in range(40, 60)]  # a chain of groups
    rows += [{"s": f"c{i}", "g": "doc:mixed", "split": "train" if i else "test"} for i in range(20)] + [{"s": f"d{i}", "g": "doc:tests", "split": "test" if i else "train"} for i in range(20)]
    rows += [{"s": f"e{i}", "g": f"doc:e{i}", "split": "test"} for i in range(20)] + [{"s": None, "g": f"doc:{i}", "split": "train"} for i in range(9)] + [{"s": " ", "g": f"doc:{i}", "split": "odd"} for i in range(5)]
    out = {r["group_key"]: r for r in splits.GroupSplits(manifest(spark, rows)).assigned().collect()}
    assert {out[f"doc:{i}"]["component"] for i in range(40, 61)} == {"doc:40"} and len({out[f"doc:{i}"]["split"] for i in range(40, 61)}) == 1
    assert out["doc:1"]["component"] == "doc:1"  # a missing sample_id relates nothing
    assert (out["doc:mixed"]["split"], out["doc:mixed"]["moved"], out["doc:mixed"]["unavoidable"]) == ("train", 1, 1)
    assert out["doc:tests"]["split"] == "test" and out["doc:tests"]["unavoidable"] == 1
    assert all((r["unavoidable"] > 0) == (r["n_splits"] > 1) and r["moved"] >= r["unavoidable"] for r in out.values())
    assert {k for k, r in out.items() if r["n_splits"] > 1} == {f"doc:{i}" for i in [*range(5), *range(40, 61)]} | {"doc:mixed", "doc:tests"}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    edges = [(f"{max(p):03d}", f"{min(p):03d}") for p in pairs if p[0] != p[1]]
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = splits.components(spark.createDataFrame(edges, "a string, b string"), splits.Workspace(spark, "t"))
    assert {tuple(r) for r in got.collect()} == {(n, r) for n, r in root.items() if n != r}
    assert splits.components(spark.createDataFrame([], "a string, b string"), splits.Workspace(spark, "t")) is None
    sizes = [1, 7, 127, 128, 129, 255, 256, 257, 1000, 2**40 + 5]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in sizes], "n bigint").select(splits.size_class(F.col("n"))).collect()]
    assert got == [n if n < 128 else n >> (n.bit_length() - 7) << (n.bit_length() - 7) for n in sizes]


def test_cheapest_flow():
    profiles = {"train": "10.0.0", "val": "0.10.0", "none": "0.0.0"}
    flow = splits.cheapest_flow({profiles["train"]: 50, profiles["val"]: 30, profiles["none"]: 20}, {"train": 80.0, "val": 8.0, "test": 12.0})
    sent = lambda s: sum(v for (_, t), v in flow.items() if t == s)
    assert [sent(s) for s in ("train", "val", "test")] == [80, 8, 12]
    assert flow[profiles["train"], "train"] == 50 and flow[profiles["val"], "val"] == 8
    flow = splits.cheapest_flow({"1.0.9": 100, "9.0.1": 900}, {"train": 900.0, "val": 0.0, "test": 100.0})
    assert flow["1.0.9", "test"] == 100 and flow["9.0.1", "train"] == 900
