"""Problems 6, 7 and 8."""

import random

import pytest
from pyspark.sql import functions as F

from sievemill.llm import bpe, mixture, truncation

ENCODER = bpe.Encoder(open(bpe.TOKENIZER, "rb").read())


def test_encoder_equals_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(bpe.TOKENIZER)
    own.encode_special_tokens = True
    plain = lambda t: own.encode(t, add_special_tokens=False).ids
    rng = random.Random(8)
    words = list(ENCODER.automaton.vocab)
    texts = ["a" * 999, "ab" * 300, " " * 90 + "x", "中" * 99, "!" * 300, "<|endoftext|>", "it's we'll\r\n\t", "é ​👩‍🔧", "　", "'s'S"]
    for _ in range(4000):
        raw = b"".join(rng.choice(words) for _ in range(rng.randint(1, 5)))
        try:
            texts.append(raw.decode())
        except UnicodeDecodeError:
            pass
    for t in texts:
        ids = ENCODER.encode(t)
        assert ids == plain(t), t
        assert ENCODER.decode(ids) == t
        assert ENCODER.count(t) == len(ids)


def test_vocabulary_and_batches():
    """Every entry through the automaton against merging by rank; words of several texts gathered in one batch."""
    vocab, merges = bpe.read_vocabulary(open(bpe.TOKENIZER, "rb").read())
    ranks = {a + b: i for i, (a, b) in enumerate(merges)}
    rng = random.Random(4)
    for word in [*vocab, *(bytes(rng.choices(b"aeinrst e", k=rng.randrange(1, 40))) for _ in range(300))]:
        assert [ENCODER.automaton.label[t] for t in ENCODER.automaton.walk(word)] == bpe.merged(word, ranks, len(merges)), word
    texts = ["a b a", None, "", "b" * 70, "a b a", " "]
    ids, upto = ENCODER.encode_all(texts)
    assert [ids[upto[i] : upto[i + 1]].tolist() for i in range(len(texts))] == [ENCODER.encode(t) for t in texts]
    assert ENCODER.count_all(texts).tolist() == [len(ENCODER.encode(t)) for t in texts]
    assert ENCODER.encode_all([])[1].tolist() == [0] and ENCODER.encode_all([None])[1].tolist() == [0, 0]


def test_splitting():
    """The quick engine against the general one, on every character up to U+FFFF and on random texts."""
    import regex

    general, quick = regex.compile(bpe.PATTERN).findall, bpe.splitter(bpe.PATTERN)
    rng = random.Random(5)
    every = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c} {c}{c}  {c}1" for c in every] + ["".join(rng.choices([*"ab1 \n\t'.", "'s", "é", "中", "½", "\u3000", "\u200d", "😀", "\x1c", "\x85"], k=rng.randrange(30))) for _ in range(3000)]
    assert all(quick(t) == general(t) for t in texts)
    assert bpe.splitter(r"\p{Lu}+|\d|.")("ABc1") == ["AB", "c", "1"]


def test_rank_files_give_the_same_merges():
    small = {s: i for s, i in ENCODER.automaton.vocab.items() if i < 2000}
    import base64

    lines = b"\n".join(base64.b64encode(s) + b" " + str(i).encode() for s, i in small.items())
    vocab, merges = bpe.read_vocabulary(lines)
    full = bpe.read_vocabulary(open(bpe.TOKENIZER, "rb").read())[1]
    assert vocab == small and merges == full[: len(merges)]


def test_encoding_in_spark(spark):
    rows = [(1, "hello world", 5), (2, "", 6), (3, None, 7), (4, " ", 8), (5, "long " * 100_000, 9), (6, "hello world", 10)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")  # a column with the result's name
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(df).collect()}
    assert got == {i: ENCODER.encode(t) for i, t, _ in rows} and got[2] == got[3] == []
    assert {r["doc_id"]: r["decoded"] for r in bpe.decode(bpe.encode(df)).collect()} == {i: t or "" for i, t, _ in rows}
    assert {r["doc_id"]: r["tokens"] for r in bpe.count(df).collect()} == {i: len(x) for i, x in got.items()}
    assert bpe.encode(df.limit(0)).count() == 0


def test_raking():
    cells = {("a", "en", "x"): 100, ("a", "de", "x"): 100, ("b", "en", "x"): 50, ("b", "de", "y"): 10, ("c", "en", "y"): 5}
    weight = mixture.rake(cells, {"a": 100.0, "b": 90.0, "c": 60.0}, {"a": 1, "b": 2, "c": 3})
    sums = lambda s: sum(n * weight[c] for c, n in cells.items() if c[0] == s)
    assert sums("a") == pytest.approx(100) and sums("b") == pytest.approx(90) and sums("c") == pytest.approx(15)
    assert all(0 <= w <= {"a": 1, "b": 2, "c": 3}[c[0]] + 1e-9 for c, w in weight.items())
    assert mixture.rake({}, {"a": 1.0}, {}) == {}
    assert mixture.rake({("a", "en", "x"): 0}, {"a": 5.0}, {"a": 2})[("a", "en", "x")] <= 2
    # Without caps in the way the languages keep their natural shares: half and half.
    cells = {("a", "en", "x"): 900, ("a", "de", "x"): 100, ("b", "en", "x"): 100, ("b", "de", "x"): 900}
    weight = mixture.rake(cells, {"a": 300.0, "b": 100.0}, {"a": 5, "b": 5})
    assert sum(n * weight[c] for c, n in cells.items() if c[1] == "de") == pytest.approx(200, abs=1e-3)


def test_mixture(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["big"] * 8 + ["small", "none"]), rng.choice(["en", "EN-gb", None, "zh", "??"]), " ".join(["word"] * rng.randrange(1, 60))) for i in range(1500)] + [(9001, "big", "en", None), (9002, "small", "en", ""), (9003, None, "en", "word")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string")
    weights = spark.createDataFrame([("big", 0.5, 1), ("small", 0.2, 3), ("empty", 0.3, 2)], "source string, target_share double, max_repeats int")
    mix = mixture.Mixture(docs, weights)
    assert mix.total == sum(len(t.split()) for *_, t in rows if t)
    used = {r["doc_id"]: r for r in mix.documents_used().collect()}
    caps = {"big": 1, "small": 3}
    assert all(1 <= r["repeats"] <= caps[r["source"]] for r in used.values()) and not {9001, 9002, 9003} & set(used)
    report = {r["source"]: r for r in mix.report().collect()}
    assert report["big"]["actual_share"] == pytest.approx(0.5, abs=0.002)
    assert report["small"]["actual_share"] == pytest.approx(min(0.2, 3 * report["small"]["available_tokens"] / mix.total), abs=0.002)
    assert (report["empty"]["used_tokens"], report["empty"]["short"]) == (0, True)
    assert {r["doc_id"]: r["repeats"] for r in mixture.Mixture(docs.repartition(5), weights).documents_used().collect()} == {i: r["repeats"] for i, r in used.items()}
    for axis in ("language", "topic"):
        rows = [r for r in mix.marginals().collect() if r["axis"] == axis]
        assert sum(r["actual_share"] for r in rows) == pytest.approx(1) == sum(r["natural_share"] for r in rows)
        assert all(abs(r["actual_share"] - r["raked_share"]) < 0.03 for r in rows)
    none = mixture.Mixture(docs.limit(0), weights)
    assert none.marginals().count() == 0
    assert none.documents_used().count() == 0 and none.report().count() == 3


SENTENCES = ["The reviewer moved the box toward the lower edge and kept the status.", "Both readings agree, so the second number on the label must be right.", "Counting from the left there are several items behind the old railing."]


def test_cut_texts(spark):
    rng = random.Random(1)
    whole = lambda: " ".join(rng.choice(SENTENCES) for _ in range(rng.randint(2, 5)))
    rows = [(i, "feed", whole() + f" Seen {i}.") for i in range(300)]
    complete = [(1000 + i, "titles", f"Figure {i}") for i in range(30)] + [(1100, "feed", None), (1101, "feed", ""), (1102, "feed", " \n"), (1103, "feed", "ok"), (1104, "x", '{"a": [1]}'), (1105, "x", "Reply <think>"), (1106, "x", "<think>a b c d e</think><answer>f</answer>"), (1107, "x", "word " * 60_000 + "end.")]
    cut = [(2000, "feed", whole() + " The reviewer moved the bo"), (2001, "feed", whole() + " Both readings agree, so the second"), (2002, "feed", whole() + " Counting from the l…"), (2003, "x", '{"a": [1'), (2004, "x", "<think>a b c d e f g"), (2005, "x", "one two three four fiv�"), (2006, "feed", whole() + " The reviewer moved the box (toward"), (2007, None, whole() + " The reviewer moved the bo")]
    cut += [(2100 + k, "feed", cut[0][2]) for k in range(50)]  # copies
    df = spark.createDataFrame(rows + complete + cut, "doc_id bigint, source string, text string").withColumn("cut", F.lit("clash"))
    got = {r["doc_id"] for r in truncation.cut_documents(df).collect()}
    assert got == {r[0] for r in cut}
    by = {r["source"]: (r["texts"], r["cut"]) for r in truncation.by_source(df).collect()}
    assert by[None] == (1, 1) and by["titles"] == (30, 0) and by["feed"][1] == 54
    assert truncation.cut_documents(df.limit(0)).count() == 0


def test_limits(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "ü"]) for _ in range(80))[: rng.randrange(101, 300)] for _ in range(200)] + [("".join(rng.choice("abcdefgh ") for _ in range(400)))[:200] for _ in range(40)]
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id bigint, source string, text string")
    assert (200, "c") in {(r["size"], r["unit"]) for r in truncation.limits(truncation.endings(df)).collect()}


def test_structure_of_whole_texts(spark):
    long = "word " * 300
    rows = [("Notes (see " + long, True), ("Notes (see) " + long, False), ("[1 " + long + "(x)", True), ("  {" + long, True), ("```\ncode " + long, True), ("<think>" + long, True), (long + "." * 900, False), (" " * 500, None), ("(a" + " " * 900 + "[...]", True)]
    got = {r["doc_id"]: r["structure"] for r in truncation.endings(spark.createDataFrame([(i, "s", t) for i, (t, _) in enumerate(rows)], "doc_id bigint, source string, text string")).collect()}
    assert got == {i: x for i, (_, x) in enumerate(rows) if x is not None}


def test_longer_words(spark):
    """Against all pairs, with words above and below HEAD letters."""
    words = ["a", "ab", "abc", "b", "x" * 30, "x" * 31, "x" * 40, "x" * 24, "1a"]
    own = spark.createDataFrame([("c", w, i + 1) for i, w in enumerate(words)], "w2 string, w3 string, inner bigint")
    for context in (["w2"], []):
        got = {r["w3"]: r["longer"] for r in truncation._longer(own.select(*context, "w3", "inner"), own.select(*context, "w3"), context).collect()}
        want = {p: n for p in words if (n := sum(i + 1 for i, w in enumerate(words) if w.startswith(p) and w != p and w[0].isalpha()))}
        assert {p: got[p] for p in words if p in got} == want
