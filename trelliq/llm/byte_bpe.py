"""Byte-level BPE by a two-tier lookup.

A pre-token that is in the vocabulary as a whole is resolved by a minimal perfect hash: a table as long as the vocabulary in
which every token has a slot of its own, and one displacement per bucket of tokens. Others are merged, lowest rank first and
leftmost among equals, with a heap of candidate pairs over a linked list of byte ranges. What a run of text between spaces
encodes to is remembered, since runs repeat, up to a number of bytes; long runs (text without spaces) are not.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import Memory, slices

_hash = xxhash.xxh64_intdigest

#: Unicode's White_Space, which \s means to the tokenizer.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Runs of text that pre-tokens never cross. A word of ASCII letters before a space or plain punctuation is a run by itself.
_RUNS = re.compile(f" ?[A-Za-z]+(?=[{SPACES},.;:|!?])| ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: n slots, n keys, no collision; other strings land in some slot.

    Buckets of several keys, largest first, take the first displacement that moves all their keys to free slots. Buckets of one
    key come last and name a free slot outright, as a negative displacement.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // per_bucket)
        self.displacement = [0] * self.buckets
        slot_key = [-1] * n
        groups: dict[int, list[tuple[int, int]]] = {}
        for i, k in enumerate(keys):
            h = _hash(k)
            groups.setdefault(h % self.buckets, []).append((h, i))
        free = None
        for b, members in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
            if len(members) == 1:
                free = free or [s for s in range(n) if slot_key[s] < 0]
                d, slots = None, [free.pop()]
                self.displacement[b] = -1 - slots[0]
            else:
                d = 0
                while True:
                    slots = [self._slot(h, d) for h, _ in members]
                    if len(set(slots)) == len(slots) and all(slot_key[s] < 0 for s in slots):
                        break
                    d += 1
                self.displacement[b] = d
            for s, (_, i) in zip(slots, members, strict=True):
                slot_key[s] = i
        self.slot_key = slot_key

    def _slot(self, h: int, d: int) -> int:
        return ((h >> 17) ^ (d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFF)) % self.n

    def index(self, key: bytes) -> int:
        """Index of ``key`` among the keys if it is one of them; else that of another."""
        h = _hash(key)
        d = self.displacement[h % self.buckets]
        return self.slot_key[self._slot(h, d) if d >= 0 else -1 - d]


class Codec:
    """Encodes text to ids and ids to bytes by the ranks of a vocabulary; ``tokens[i]`` has rank i."""

    def __init__(self, tokens: list[bytes], pattern: str, memory: int = 64 << 20):
        self.tokens = tokens
        self.perfect = PerfectHash(tokens)
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACES}").replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]"))
        self.memory = Memory(self._run, memory)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece that is not a token, by a heap over linked bytes. O(n log n)."""
        n, rank = len(piece), self.rank.get
        following, previous = list(range(1, n + 2)), list(range(-1, n))
        # An entry is rank << 32 | start; it still holds if its range and the next together have that rank.
        heap = [r << 32 | i for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            entry = pop(heap)
            i = entry & 0xFFFFFFFF
            j = following[i]
            if j >= n:
                continue
            end = following[j]
            if rank(piece[i:end]) != entry >> 32:
                continue
            following[j], following[i] = n, end
            if end < n:
                previous[end] = i
                r = rank(piece[i : following[end]])
                if r is not None:
                    push(heap, r << 32 | i)
            before = previous[i]
            if before >= 0:
                r = rank(piece[before:end])
                if r is not None:
                    push(heap, r << 32 | before)
        ids, i = [], 0
        while i < n:
            end = following[i]
            ids.append(rank(piece[i:end]))
            i = end
        return ids

    def _run(self, run: str) -> tuple[int, ...]:
        # A run of ASCII letters after at most one space is a pre-token by itself.
        if not (run.isascii() and (run[1:] if run[0] == " " else run).isalpha()):
            pieces = self.pattern.findall(run)
            if len(pieces) > 1:
                return tuple(chain.from_iterable(map(self.memory.__getitem__, pieces)))
        raw = run.encode("utf-8", "replace")
        i = self.perfect.index(raw)
        return (i,) if self.tokens[i] == raw else tuple(self.merge(raw))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.memory.__getitem__, _RUNS.findall(text or ""))))

    def decode(self, ids) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file (base64 token, rank) in order of their ranks, which must be 0, 1, 2 and so on."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(r): base64.b64decode(t) for t, r in pairs}
    return [ranks[i] for i in range(len(ranks))]


_CODECS: dict[str, Codec] = {}


def _shared(vocabulary) -> Codec:
    """One codec, with its memory, for all tasks that a worker runs."""
    digest, tokens, pattern = vocabulary.value
    if digest not in _CODECS:
        _CODECS[digest] = Codec(tokens, pattern)
    return _CODECS[digest]


def _broadcast(spark, ranks_path: str, pattern: str):
    tokens = read_ranks(ranks_path)
    digest = hashlib.sha256(pattern.encode() + b"".join(tokens)).hexdigest()
    return spark.sparkContext.broadcast((digest, tokens, pattern))


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) for every row of ``docs`` (doc_id, text, ...).

    Null text counts as empty, and empty text has no ids. Whole texts are encoded, however long. Repeated rows and null
    doc_ids are passed on; an empty table gives an empty result. Other columns are neither read nor returned. The
    vocabulary (bounded: a rank file) is broadcast.
    """
    vocabulary = _broadcast(docs.sparkSession, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _shared(vocabulary)
        for batch in batches:
            for part in slices(batch, "text", rows=256):
                ids = [np.array(codec.encode(t), np.int32) for t in part.column("text").to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, bytes for every row of ``encoded`` (doc_id, ids); null ids count as none, an unknown id is an error."""
    vocabulary = _broadcast(encoded.sparkSession, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _shared(vocabulary)
        for batch in batches:
            raw = [codec.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "bytes"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ``encode`` and ``decode`` of every row in one step, as digests."""
    vocabulary = _broadcast(docs.sparkSession, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _shared(vocabulary)
        names = [str(i) for i in range(len(codec.tokens))]
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for batch in batches:
            out = []
            for text in batch.column("text"):
                ids = codec.encode(text.as_py())
                out.append((len(ids), sha(" ".join([names[i] for i in ids]).encode()), sha(codec.decode(ids))))
            n, a, b = zip(*out, strict=True) if out else ((), (), ())
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
