"""Problem 6: a public byte-level BPE vocabulary compiled to a deterministic automaton.

The automaton reads tokens. It starts as one state with a loop for every byte. Each merge (u, v), in order
of rank, applies one gadget: the state q that u leads to is copied without its arc v, u leads to the copy
from then on (so u followed by v can't be read any more), and every state with an arc u gets an arc uv to
where v leads. What the result accepts are exactly the tokenizations that the merges produce, one for each
byte string. All arcs with one label lead to the same state, so a state is a copy of an earlier one minus
one arc, and a transition is looked up along these copies and kept in a table.

A word is encoded by walking it once: a table over (node, byte) spells out the tokens that begin at each place
where a path ends, and the one whose arc leaves the state reached there goes on. Decoding emits the arcs' labels.
The words of an Arrow batch are numbered, distinct ones are walked once, and the ids of the texts are gathered from
theirs with numpy.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: A larger vocabulary file isn't sent to the executors.
MOST_BYTES = 64 << 20
#: Distinct words whose ids a worker keeps; beyond it starts afresh.
CACHE_WORDS = 300_000

# Fixed value: how the byte-level tokenizers split text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files: itself where printable, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(raw: bytes) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """(bytes to id, merges in order) of a vocabulary file: JSON with merges, or lines of base64 bytes and rank."""
    if raw.lstrip()[:1] == b"{":
        model = json.loads(raw)["model"]
        letters = _byte_letters()
        as_bytes = functools.cache(lambda s: bytes(letters[c] for c in s))
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merges = [(as_bytes(a), as_bytes(b)) for a, b in pairs]
        made = {a + b for a, b in merges} | {bytes([b]) for b in range(256)}
        vocab = {as_bytes(s): i for s, i in model["vocab"].items() if all(c in letters for c in s)}
        return {s: i for s, i in vocab.items() if s in made}, merges
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
    merges = []
    for s in sorted((s for s in ranks if len(s) > 1), key=ranks.__getitem__):
        # With the merges of lower rank alone, a token is a pair: the one that makes it.
        parts = merged(s, ranks, ranks[s])
        if len(parts) != 2:
            raise ValueError(f"{s!r} is not made of two tokens of lower rank")
        merges.append((parts[0], parts[1]))
    return ranks, merges


def merged(s: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """The parts of ``s`` after all merges of a rank below the given one, lowest first."""
    parts = [s[i : i + 1] for i in range(len(s))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Automaton:
    """The compiled automaton of a vocabulary."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.vocab: dict[bytes, int] = {}
        self.label: dict[int, bytes] = {}
        self.left: dict[int, int] = {}
        self.made: dict[int, int] = {}  # number of the merge that makes the token, -1 for bytes
        self.leads: dict[int, int] = {}  # state that the token's arcs lead to
        # State 0 is the first one; state k + 1 is made by merge k as a copy of its parent without one arc.
        self.parent: list[int] = [0]
        self.without: list[int] = [-1]
        self.table: dict[tuple[int, int], bool] = {}
        self.next: dict[int, int] | None = None
        for b in range(256):
            if (s := bytes([b])) in vocab:
                self.vocab[s], self.label[vocab[s]] = vocab[s], s
                self.made[vocab[s]], self.leads[vocab[s]] = -1, 0
        for a, b in merges:
            self.add(a, b, vocab[a + b])

    def add(self, a: bytes, b: bytes, new: int) -> None:
        """Apply the gadget of the next merge."""
        u, v = self.vocab[a], self.vocab[b]
        end = self.leads[v]
        self.parent.append(self.leads[u])
        self.without.append(v)
        self.leads[u] = len(self.parent) - 1
        self.vocab[a + b], self.label[new] = new, a + b
        self.left[new], self.made[new], self.leads[new] = u, len(self.parent) - 2, end
        self.next = None

    def has_arc(self, state: int, token: int) -> bool:
        """Whether an arc ``token`` leaves the state. Arcs made before the state were copied with it, later ones came with their left part."""
        known = self.table.get((state, token))
        if known is None:
            s, t = state, token
            while s and t != self.without[s]:
                if self.made[t] >= s - 1:
                    t = self.left[t]
                else:
                    s = self.parent[s]
            known = self.table[state, token] = not s
        return known

    def spell(self) -> None:
        """Make the table over (node, byte) of the tokens' spellings; tokens added later are not in it."""
        self.next: dict[int, int] = {}
        self.token = [-1]
        for s, t in self.vocab.items():
            node = 0
            for b in s:
                step = node << 8 | b
                node = self.next.get(step, 0)
                if not node:
                    node = self.next[step] = len(self.token)
                    self.token.append(-1)
            self.token[node] = t

    def walk(self, word: bytes) -> list[int]:
        """The one path of tokens that spells the word."""
        if self.next is None:
            self.spell()
        n, following, tokens, leads = len(word), self.next, self.token, self.leads
        last, states = [-1] * (n + 1), [0] * (n + 1)
        for begin in range(n):
            if begin and last[begin] < 0:
                continue
            state, node, end = states[begin], 0, begin
            while end < n and (node := following.get(node << 8 | word[end])):
                end += 1
                token = tokens[node]
                if token >= 0 and last[end] < 0 and self.has_arc(state, token):
                    last[end], states[end] = token, leads[token]
        out = []
        while n:
            if last[n] < 0:
                raise ValueError(f"no token for byte {word[n - 1]}")
            out.append(last[n])
            n -= len(self.label[last[n]])
        return out[::-1]


class _Words(dict):
    """Numbers of words, made where missing, with their ids one after another."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.ids, self.ends = array("i"), array("q")

    def __missing__(self, word: str) -> int:
        self.ids.extend(self.automaton.walk(word.encode("utf-8", "surrogatepass")))
        self.ends.append(len(self.ids))
        self[word] = len(self.ends) - 1
        return len(self.ends) - 1

    def trim(self) -> None:
        """Start afresh if too much is kept; between batches only, since numbers change."""
        if len(self) > CACHE_WORDS or len(self.ids) > 8 * CACHE_WORDS:
            self.clear()
            self.ids, self.ends = array("i"), array("q")
        if len(self.automaton.table) > 8 * CACHE_WORDS:
            self.automaton.table.clear()


def _ranges(kind: str) -> str:
    """The characters up to U+FFFF of a kind, such as ``\\p{L}``, as the inside of a character set."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000))))
    return "".join(re.escape(run[0]) if len(run) == 1 else f"{re.escape(run[0])}-{re.escape(run[-1])}" for run in _runs(regex.findall(kind, every)))


def _runs(characters: list[str]) -> Iterator[str]:
    """Runs of characters that follow each other."""
    begin = 0
    for i in range(1, len(characters) + 1):
        if i == len(characters) or ord(characters[i]) != ord(characters[i - 1]) + 1:
            yield "".join(characters[begin:i])
            begin = i


@functools.lru_cache(maxsize=4)
def splitter(pattern: str):
    """A function from text to words: ``findall`` of the pattern.

    Texts without characters above U+FFFF go through the standard library's engine, which looks up sets of characters
    in a bitmap; the pattern's kinds are spelled out for it. Other texts, and patterns with other kinds, take ``regex``.
    """
    general = regex.compile(pattern).findall
    out, inside = "", False
    for part in re.split(r"(\\p\{[LN]\}|\\s|\\S|\\.|\[\^?|\])", pattern):
        if part in (r"\p{L}", r"\p{N}", r"\s"):
            out += _ranges(part) if inside else f"[{_ranges(part)}]"
        elif part == r"\S" and not inside:
            out += f"[^{_ranges(chr(92) + 's')}]"
        elif part.startswith("\\"):
            return general
        else:
            inside = part.startswith("[") or (inside and part != "]")
            out += part
    quick = re.compile(out).findall
    return lambda text: quick(text) if text.isascii() or 2 * len(text) == len(text.encode("utf-16-le", "surrogatepass")) else general(text)


class Encoder:
    def __init__(self, raw: bytes, pattern: str = PATTERN):
        self.automaton = Automaton(*read_vocabulary(raw))
        self.words = _Words(self.automaton)
        self.split = splitter(pattern)

    def _numbered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word of the texts, number of words up to each text)."""
        self.words.trim()
        split, found, ends = self.split, [], [0]
        for t in texts:
            if t:
                found += split(t)
            ends.append(len(found))
        return np.fromiter(map(self.words.__getitem__, found), np.int64, len(found)), np.array(ends)

    def _sizes(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first id and number of ids of each word, number of ids up to each text)."""
        stops = np.array(self.words.ends, np.int64)
        starts = np.concatenate([[0], stops[:-1]])[words] if len(words) else words
        sizes = stops[words] - starts if len(words) else words
        return starts, sizes, np.concatenate([[0], np.cumsum(sizes)])[ends]

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids up to each text)."""
        words, ends = self._numbered(texts)
        starts, sizes, upto = self._sizes(words, ends)
        # Place of each id: the first of its word, and how far it is into the word.
        into = np.arange(upto[-1]) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.array(self.words.ids, np.int32)[np.repeat(starts, sizes) + into], upto

    def count_all(self, texts: list[str | None]) -> np.ndarray:
        return np.diff(self._sizes(*self._numbered(texts))[2])

    def encode(self, text: str | None) -> list[int]:
        """Ids of the text without special tokens; none for an empty or missing text."""
        return self.encode_all([text])[0].tolist()

    def count(self, text: str | None) -> int:
        return int(self.count_all([text])[0])

    def decode(self, ids: list[int] | None) -> str:
        return b"".join(map(self.automaton.label.__getitem__, ids or [])).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def encoder(packed: bytes, pattern: str = PATTERN) -> Encoder:
    """One encoder a worker process and vocabulary."""
    return Encoder(zlib.decompress(packed), pattern)


def packed_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(MOST_BYTES + 1)
    if len(raw) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
    return zlib.compress(raw)


def _per_batch(df: DataFrame, text: str, out: T.StructField, of, path: str) -> DataFrame:
    """``df`` with the column ``out`` for ``text``; the other columns stay as they are."""
    spark: SparkSession = df.sparkSession
    ship(spark)
    # The driver reads the file, so executors need not have it; its size is bounded by MOST_BYTES.
    packed = spark.sparkContext.broadcast(packed_vocabulary(path))
    at = df.columns.index(text)
    keep = [i for i, c in enumerate(df.columns) if c != out.name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(packed.value)
        for batch in batches:
            made = of(own, batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), made], names=[*(batch.schema.names[i] for i in keep), out.name])

    return df.mapInArrow(run, T.StructType([*(df.schema[i] for i in keep), out]))


def _id_lists(own: Encoder, texts: list[str | None]) -> pa.Array:
    ids, upto = own.encode_all(texts)
    if len(ids) >= 1 << 31:
        raise ValueError("more token ids in a batch than a list column can hold")
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids, pa.int32()))


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str = TOKENIZER) -> DataFrame:
    """Add ``out``, the token ids of ``text`` as ARRAY<INT>; the empty array for empty and NULL texts."""
    return _per_batch(df, text, T.StructField(out, T.ArrayType(T.IntegerType())), _id_lists, path)


def count(df: DataFrame, text: str = "text", out: str = "tokens", path: str = TOKENIZER) -> DataFrame:
    """Add ``out``, the number of tokens of ``text``; 0 for empty and NULL texts."""
    return _per_batch(df, text, T.StructField(out, T.LongType()), lambda own, texts: pa.array(own.count_all(texts), pa.int64()), path)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str = TOKENIZER) -> DataFrame:
    """Add ``out``, the text of the token ids; the empty text for none. Bytes that are no UTF-8 become U+FFFD."""
    packed = df.sparkSession.sparkContext.broadcast(packed_vocabulary(path))

    @F.pandas_udf("string")
    def text_of(column):
        own = encoder(packed.value)
        return column.map(lambda x: own.decode([] if x is None else x.tolist()))

    return df.withColumn(out, text_of(ids))
