"""Byte-level BPE encoding of text columns by a compiled token automaton.

The merges of a public vocabulary are compiled in order into a deterministic automaton whose
states are the tokens. The gadget of the merge u v -> w adds a state w reached over the arcs
of u and then v, and cuts the arc v out of every state that a path of u still leads to. What
remains are exactly the paths that BPE itself would choose, so any prefix of a word ends in
one state only. Two tables hold the automaton: a byte trie with the arcs, and the arcs cut
between two states, which are worked out on first use by undoing both tokens' gadgets from
the newest and then remembered. Encoding runs over the bytes of a pre-split word once with
table lookups; decoding emits the byte labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from loopline.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

#: Fixed value: how the vocabulary splits text into words, white space being the Unicode property.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_letters() -> dict[str, int]:
    """The letter standing for each byte in a vocabulary file: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> tuple[dict[int, bytes], list[tuple[int, int, int]]]:
    """Bytes of each token that merging can make, and the merges (left, right, result) in order."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters, vocab = byte_letters(), model["vocab"]
    tokens = {vocab[c]: bytes([b]) for c, b in letters.items()}
    merges = []
    for m in model["merges"]:
        left, right = m.split(" ") if isinstance(m, str) else m
        u, v, w = vocab[left], vocab[right], vocab[left + right]
        tokens[w] = tokens[u] + tokens[v]
        merges.append((u, v, w))
    return tokens, merges


class Automaton:
    """The compiled automaton of a vocabulary."""

    def __init__(self, tokens: dict[int, bytes], merges: list[tuple[int, int, int]], remembered: int = 400_000) -> None:
        self.label = tokens
        self.arcs: dict[int, int] = {}
        self.token_at = [-1]
        self.gadget: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for t, text in tokens.items():
            if len(text) == 1:
                self._path(text, t)
        for i, (u, v, w) in enumerate(merges):
            self.gadget.setdefault((u, v), i)
            if w not in self.halves:
                self.halves[w], self.born[w] = (u, v), i
            self._path(tokens[w], w)
        self.cut: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.remembered = remembered
        self.split = regex.compile(SPLIT).findall

    def _path(self, text: bytes, token: int) -> None:
        node = 0
        for b in text:
            key = node << 8 | b
            nxt = self.arcs.get(key)
            if nxt is None:
                nxt = self.arcs[key] = len(self.token_at)
                self.token_at.append(-1)
            node = nxt
        self.token_at[node] = token

    def follows(self, a: int, b: int) -> bool:
        """Whether the arc b is left in state a, i.e. BPE keeps the two tokens apart.

        The two are taken apart from the later merge on. At each step the tokens touching at
        the border must have no gadget older than the merge last undone, else that gadget
        would have come first and joined them. Of two equal merges the right token's is
        later, because BPE works from the left.
        """
        known = self.cut.get((a, b))
        if known is not None:
            return known
        left, right, limit, ok = a, b, (len(self.gadget) + len(self.halves) + 1, 0), True
        while True:
            g = self.gadget.get((left, right))
            if g is not None and (g, 0) < limit:
                ok = False
                break
            undo_left, undo_right = self.born.get(left, -1), self.born.get(right, -1)
            if undo_left < 0 and undo_right < 0:
                break
            if undo_left > undo_right:
                limit, left = (undo_left, 0), self.halves[left][1]
            else:
                limit, right = (undo_right, 1), self.halves[right][0]
        if len(self.cut) > 4 * self.remembered:
            self.cut.clear()
        self.cut[a, b] = ok
        return ok

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """Token ids of one pre-split word: the state of each prefix, then the path back from the end."""
        n = len(word)
        state, start = [-1] * (n + 1), [0] * (n + 1)
        arcs, token_at, follows = self.arcs, self.token_at, self.follows
        for i in range(n):
            here = state[i]
            if i and here < 0:
                continue
            node = 0
            for j in range(i, n):
                node = arcs.get(node << 8 | word[j], -1)
                if node < 0:
                    break
                t = token_at[node]
                if t >= 0 and (not i or follows(here, t)):
                    state[j + 1], start[j + 1] = t, i
        out, end = [], n
        while end:
            out.append(state[end])
            end = start[end]
        return tuple(reversed(out))

    def encode(self, text: str | None, into: array) -> None:
        """Append the ids of a text to ``into``; null and the empty text have none."""
        if not text:
            return
        words, extend = self.words, into.extend
        for w in self.split(text):
            ids = words.get(w)
            if ids is None:
                ids = self.encode_word(w.encode("utf-8"))
                if len(words) >= self.remembered:
                    words.clear()
                if len(w) <= 64:
                    words[w] = ids
            extend(ids)

    def decode(self, ids: list[int]) -> str:
        """The text whose bytes the ids' arcs are labelled with; broken UTF-8 is replaced."""
        return b"".join(self.label.get(i, b"") for i in ids).decode("utf-8", errors="replace")


_compiled: dict[str, Automaton] = {}


def _automaton(shared: Broadcast, key: str) -> Automaton:
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Automaton(*shared.value)
    return _compiled[key]


def _shared(df: DataFrame, path: str) -> tuple[Broadcast, str]:
    """The vocabulary for the workers, and its digest: workers live on between queries and keep what they compiled by it."""
    with open(path, "rb") as f:
        digest = hashlib.sha256(f.read()).hexdigest()
    return df.sparkSession.sparkContext.broadcast(read_vocabulary(path)), digest


def encode(df: DataFrame, keys: list[str], text: str, path: str = VOCABULARY, flush: int = 1_000_000) -> DataFrame:
    """``keys`` and ``ids`` (array<int>, never null) of every row's text, without special tokens.

    Null and empty texts have the empty list; strings of special tokens are ordinary text.
    Whole texts are encoded whatever their length. Other columns and their names play no
    part. The vocabulary is a file of fixed size, read on the driver and broadcast.
    """
    shared, key = _shared(df, path)
    rows = spread(df.select(*keys, F.col(text).cast("string").alias("__text")))
    fields = [f for f in rows.schema.fields if f.name != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _automaton(shared, key)
        for batch in batches:
            texts, flat, ends, first = batch.column(batch.num_columns - 1), array("i"), [0], 0
            for i in range(batch.num_rows):
                a.encode(texts[i].as_py(), flat)
                ends.append(len(flat))
                if len(flat) >= flush or i == batch.num_rows - 1:
                    ids = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.frombuffer(flat, dtype=np.int32) if len(flat) else np.array([], dtype=np.int32)))
                    piece = [c.slice(first, i + 1 - first) for c in batch.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*piece, ids], names=[*batch.schema.names[:-1], "ids"])
                    flat, ends, first = array("i"), [0], i + 1

    return rows.mapInArrow(run, StructType([*fields, StructField("ids", ArrayType(IntegerType()))]))


def decode(df: DataFrame, keys: list[str], ids: str, path: str = VOCABULARY) -> DataFrame:
    """``keys`` and ``text`` of every row's ids; null ids give null, the empty list the empty text."""
    shared, key = _shared(df, path)
    rows = df.select(*keys, F.col(ids).alias("__ids"))
    fields = [f for f in rows.schema.fields if f.name != "__ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _automaton(shared, key)
        for batch in batches:
            out = [None if x is None else a.decode(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], names=[*batch.schema.names[:-1], "text"])

    return rows.mapInArrow(run, StructType([*fields, StructField("text", StringType())]))
