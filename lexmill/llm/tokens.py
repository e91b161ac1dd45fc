"""Problem 7: encoding of a corpus with a public tokenizer.

The merges are compiled, in their order, into a deterministic automaton over tokens by one gadget each: merging (u, v)
into w gives every state that has an arc u a new arc w, splits off u's target state without its arc v, and lets w end
in v's state as it is then. A state therefore is known by the token it was entered with, its inheritance by the right
halves, an arc's birth by the left halves; `arc` reads that off and keeps it in a transition table. A word's tokens
are its one path from the start through byte trie and table; decoding emits the arc labels.
"""

from __future__ import annotations

import hashlib
import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.base import arrow_map, id_and_text

#: Fixed value: how this vocabulary's tokenizer splits text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = 1 << 40


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The vocabulary file writes printable bytes as themselves and the others as code points from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """Compiled merges of a byte-level tokenizer file."""

    def __init__(self, content: bytes, words: int = 200_000, arcs: int = 2_000_000):
        model = json.loads(content)["model"]
        byte = _byte_of_char()
        as_bytes = lambda s: bytes(byte[c] for c in s)
        self.words, self.arcs = words, arcs
        self.label: dict[int, bytes] = {}
        self.born: dict[int, int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.gone: dict[int, int] = {}
        of = {}
        for k, i in model["vocab"].items():
            if all(c in byte for c in k):
                of[as_bytes(k)] = i
        self.start = 1 << 20
        for b in range(256):
            if (i := of.get(bytes([b]))) is not None:
                self.label[i], self.born[i] = bytes([b]), -1
        for rank, m in enumerate(model["merges"]):
            u, v = m.split(" ") if isinstance(m, str) else m
            self.gadget(rank, of[as_bytes(u)], of[as_bytes(v)], of[as_bytes(u) + as_bytes(v)])
        self.node: dict[int, int] = {}
        self.at: dict[int, int] = {}
        nodes = 1
        for i, lab in self.label.items():
            n = 0
            for b in lab:
                nxt = self.node.get(n << 8 | b)
                if nxt is None:
                    nxt = self.node[n << 8 | b] = nodes
                    nodes += 1
                n = nxt
            self.at[n] = i
        self.table: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def gadget(self, rank: int, u: int, v: int, w: int) -> None:
        self.gone[u << 20 | v] = rank
        if w not in self.born:
            self.born[w], self.left[w], self.right[w], self.label[w] = rank, u, v, self.label[u] + self.label[v]

    def lost(self, state: int, token: int) -> int:
        """When the state entered with `state` lost its arc `token`."""
        first, until = NEVER, NEVER
        while True:
            k = self.gone.get(state << 20 | token, NEVER)
            if k < until and k < first:
                first = k
            born = self.born[state]
            if born < 0:
                return first
            until = min(until, born)
            state = self.right[state]

    def arc(self, state: int, token: int) -> bool:
        key = state << 20 | token
        ok = self.table.get(key)
        if ok is None:
            ok, at, t = True, NEVER, token
            while True:
                k = self.lost(state, t)
                if k <= at and k != NEVER:
                    ok = False
                    break
                at = self.born[t]
                if at < 0:
                    break
                t = self.left[t]
            if len(self.table) > self.arcs:
                self.table.clear()
            self.table[key] = ok
        return ok

    def path(self, word: bytes) -> list[int]:
        """The arc labels' ids on the word's one path."""
        n = len(word)
        into, frm = [0] * (n + 1), [-1] * (n + 1)
        node, at, start = self.node, self.at, self.start
        into[0] = start
        for s in range(n):
            state, k, e = into[s], 0, s
            while e < n:
                k = node.get(k << 8 | word[e])
                if k is None:
                    break
                e += 1
                t = at.get(k)
                if t is not None and frm[e] < 0 and (state == start or self.arc(state, t)):
                    into[e], frm[e] = t, s
        out, e = [], n
        while e > 0:
            out.append(into[e])
            e = frm[e]
        return out[::-1]

    def ids(self, word: str) -> bytes:
        """int32 ids of a pre-split word."""
        got = self.known.get(word)
        if got is None:
            got = array("i", self.path(word.encode("utf-8", "replace"))).tobytes()
            if len(self.known) > self.words:
                self.known.clear()
            if len(word) < 64:
                self.known[word] = got
        return got

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(map(self.ids, SPLITTER.findall(text))), np.int32).tolist()

    def decode(self, ids) -> str:
        return b"".join(self.label[i] for i in ids).decode("utf-8", "replace")


SPLITTER = regex.compile(SPLIT)
_COMPILED: dict[str, Automaton] = {}


def automaton(content: bytes) -> Automaton:
    """Compiled once in a worker process."""
    key = hashlib.md5(content).hexdigest()
    if key not in _COMPILED:
        _COMPILED[key] = Automaton(content)
    return _COMPILED[key]


def _content(df: DataFrame, path: str | None):
    with open(path or default_tokenizer(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file: a few MB whatever the corpus


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(id, ids) of every row, without special tokens; empty and null texts give an empty list."""
    content = _content(df, tokenizer)

    def run(batches):
        a = automaton(content.value)
        for b in batches:
            for k in range(0, b.num_rows, 512):  # long id lists leave in pieces
                part = b.slice(k, 512)
                chunks = [b"".join(map(a.ids, SPLITTER.findall(t))) if t else b"" for t in part.column(1).to_pylist()]
                sizes = np.fromiter((len(c) // 4 for c in chunks), np.int32, len(chunks))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(chunks), np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["_id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(id_and_text(df, id_col, text_col), run, f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col)


def count(df: DataFrame, text_col: str = "text", out: str = "n_tokens", tokenizer: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep` and the number of tokens; null and empty texts have 0."""
    content = _content(df, tokenizer)
    d = df.select(*keep, F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        a = automaton(content.value)
        for b in batches:
            n = [sum(map(len, map(a.ids, SPLITTER.findall(t)))) // 4 if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])
    return arrow_map(d, run, f"{fields}, `{out}` long")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """(id, text): the labels on the way; a null list gives a null text."""
    content = _content(df, tokenizer)

    def run(batches):
        a = automaton(content.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else a.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=["_id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(F.col(id_col).alias("_id"), ids_col), run, f"_id {kind}, text string").withColumnRenamed("_id", id_col)
