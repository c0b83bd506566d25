"""Token ids in compressed binary files.

Documents are dealt by ranges of doc_id and encoded in order. Every million ids or so close a block, which Re-Pair compresses
by itself: pairs of neighbouring symbols that are frequent become nonterminals, the most frequent first, until no pair is left
that pays for its rule. The rules of a round are applied at once where they do not overlap. A block stores its rules, the length
each nonterminal expands to, the remaining symbols and where each document starts among them, so any document can be decoded
alone. Blocks are rows of a Parquet table (part, block, header columns, payload), which Spark's committer writes whole even when
executors are lost, and any store that Spark knows can hold.

Payload, little-endian: 4 bytes ``RPG2``, uint32 base, rules, symbols, documents, rounds; uint32 rules per round; left and right of
each rule; uint32 expansion lengths; the symbols; uint32 symbols per document; uint32 ids per document. Symbols below ``base`` are
ids, ``base + i`` is rule i. Lists of symbols (left, right, the rest) store the low 16 bits of each as uint16 and after them one
plane of bits for each bit above that any symbol needs; list and planes are padded to 4 bytes.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Memory, partitions_of, slices

MAGIC = b"RPG2"


# Encoding

#: The normalizer and the splitter under which chunks between white space can be encoded one by one.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLITTER = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def _splits_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer drops white space and never joins what stands on its two sides, and hands whole words of letters to its model."""
    model, normalizer, splitter = spec["model"], spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    # An added token that begins with a sign and has letters is never part of letters with signs after them.
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and re.fullmatch(r"[!-/:-@\[-`{-~]\S*[A-Za-z]\S*", t["content"]) for t in spec.get("added_tokens") or [])
    return (
        plain and normalizer.get("normalizers") == _NORMALIZER and splitter.get("pretokenizers") == _SPLITTER
        and spec.get("truncation") is None and model.get("type") == "BPE" and not model.get("dropout")
    )


def _gathered(values: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of ``size`` values that stand one after the other, those named by ``which``, in its order, and how long each is."""
    each = size[which]
    ends = np.cumsum(each)
    shift = (np.cumsum(size) - size)[which] - (ends - each)
    return values[np.arange(len(ends) and ends[-1]) + np.repeat(shift, each)], each


class ChunkEncoder:
    """Ids of whole texts as the tokenizers library gives them.

    If the tokenizer's file says that it drops white space and splits at it, texts are cut at ASCII white space and each distinct
    chunk of a batch is encoded once. Latin letters with ASCII signs after them are two parts, and a word of such letters goes to the
    library's model directly, as its normalizer and splitter would hand it over; other chunks go through the whole library. Short
    parts are remembered up to a number of bytes. With any other file whole texts go through the whole library.
    """

    _SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII signs without the apostrophe, which the splitter may join to letters
    _LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c != "\u0130")  # their lower case has letters only

    def __init__(self, tokenizer_json: str, memory: int = 96 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        self.by_chunk = _splits_at_spaces(json.loads(tokenizer_json))
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        self.visible = {b: chr(b) if b in printable else chr(next(other)) for b in range(256)}
        self.memory = Memory(self._part, memory)

    def _part(self, part: str) -> bytes:
        """Ids of a word in lower case, of signs, or of any other chunk."""
        if not part.isalpha() or max(part) >= "\u0250" or "\u0130" in part:
            return self._whole(part)
        if not part.isascii():
            part = "".join([self.visible[b] for b in unicodedata.normalize("NFC", part).encode()])
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() if text else b""

    def encode(self, text: str | None) -> bytes:
        """Ids of one text as little-endian uint32."""
        return self.encode_all(pa.array([text], pa.string()))[0].astype("<u4").tobytes()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has. Null counts as empty."""
        if not self.by_chunk:
            raw = [self._whole(t or "") for t in texts.to_pylist()]
            return np.frombuffer(b"".join(raw), "<u4"), np.array([len(r) // 4 for r in raw], np.int64)
        cut = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        chunks = cut.flatten().dictionary_encode()
        known = chunks.dictionary
        words, signs = pc.utf8_rtrim(known, characters=self._SIGNS), pc.utf8_ltrim(known, characters=self._LETTERS)
        length = lambda a: pc.binary_length(a).to_numpy(zero_copy_only=False)
        # Letters up to where signs begin, and nothing else: what both leave makes the chunk.
        two = pa.array(length(words) + length(signs) == length(known))
        parts = [pc.if_else(two, pc.utf8_lower(words), known).dictionary_encode(), pc.if_else(two, signs, "").dictionary_encode()]
        raw = [self.memory[p] for x in parts for p in x.dictionary.to_numpy(zero_copy_only=False).tolist()]
        which = np.column_stack([parts[0].indices.to_numpy(), parts[1].indices.to_numpy() + len(parts[0].dictionary)]).ravel()
        ids, each = _gathered(np.frombuffer(b"".join(raw), "<u4"), np.array([len(r) // 4 for r in raw], np.int64), which)
        flat, each = _gathered(ids, each[0::2] + each[1::2], chunks.indices.to_numpy())
        stops = np.concatenate([[0], np.cumsum(each)])[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        return flat, np.diff(stops)


# Re-Pair

_TABLE_BITS = 18


def _hashed(key: np.ndarray) -> np.ndarray:
    kind = key.dtype.type
    factor, down = (0x9E3779B1, 32 - _TABLE_BITS) if kind is np.uint32 else (0x9E3779B97F4A7C15, 64 - _TABLE_BITS)
    return (key * kind(factor)) >> kind(down)


def _frequent(key: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``key`` of keys that occur ``least`` times or more, which key each has, those keys ascending and their counts."""
    ordered = np.sort(key)
    # A key that occurs often enough equals the one so many places on.
    often = np.flatnonzero(ordered[: max(len(key) - least + 1, 0)] == ordered[least - 1 :])
    value = ordered[often]
    value = value[np.concatenate([[True], value[1:] != value[:-1]])] if len(value) else value
    if not len(value):
        return often, often, value, often
    count = np.searchsorted(ordered, value, side="right") - np.searchsorted(ordered, value)
    # Places are found by a table of hashed keys, and by a search where two keys share a slot.
    slot = np.full(1 << _TABLE_BITS, -1, np.int32)
    slot[_hashed(value)] = np.arange(len(value), dtype=np.int32)
    which = slot[_hashed(key)]
    some = np.flatnonzero(which >= 0)
    which, key = which[some], key[some]
    other = np.flatnonzero(value[which] != key)
    if len(other):
        found = np.searchsorted(value, key[other]).clip(max=len(value) - 1)
        which[other] = np.where(value[found] == key[other], found, -1)
        some, which = some[which >= 0], which[which >= 0]
    return some, which, value, count


def _packed(symbols: np.ndarray, bits: int) -> bytes:
    fill = lambda raw: raw + b"\0" * (-len(raw) % 4)
    planes = [fill(np.packbits((symbols >> np.uint32(b)).astype(np.uint8) & 1).tobytes()) for b in range(16, bits)]
    return b"".join([fill(symbols.astype("<u2").tobytes()), *planes])


def _unpacked(payload: bytes, at: int, n: int, bits: int) -> tuple[np.ndarray, int]:
    out = np.frombuffer(payload, "<u2", n, at).astype(np.uint32)
    at += -(-2 * n // 4) * 4
    for b in range(16, bits):
        plane = np.frombuffer(payload, np.uint8, -(-n // 8), at)
        out |= np.unpackbits(plane, count=n).astype(np.uint32) << np.uint32(b)
        at += -(-len(plane) // 4) * 4
    return out, at


def compress(ids: np.ndarray, lengths: np.ndarray, base: int, least: int = 12, fall: int = 64) -> bytes:
    """A block's payload from its ids and the number of ids of each document. Rules never cross documents.

    A pair becomes a rule while it is seen ``least`` times or more: a rule takes about 8 bytes and a use saves about 2, less where
    pairs overlap. Each round takes the pairs seen at least 1/``fall`` as often as the most frequent one. A pair's count never grows
    after the round that made its symbols, so places with rarer pairs are not looked at again.
    """
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)
    ends = np.cumsum(lengths)
    last[ends[lengths > 0] - 1] = True
    lefts, rights, per = [], [], []
    symbols = base
    at = np.flatnonzero(~last[:-1])
    while len(at):
        kind, shift = (np.uint32, 16) if symbols <= 1 << 16 else (np.uint64, 32)
        key = seq[at].astype(kind) << kind(shift) | seq[at + 1].astype(kind)
        some, pair, value, count = _frequent(key, least)
        if not len(value):
            break
        at = at[some]
        order = np.argsort(-count, kind="stable")
        order = order[: np.searchsorted(-count[order], -max(least, -(-int(count.max()) // fall)), side="right")]
        rank = np.full(len(value), -1, np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        rank = rank[pair]
        place, rank = at[rank >= 0], rank[rank >= 0]
        # Of overlapping places the better rule goes first; of a run of one rule every other place.
        near = np.concatenate([[False], np.diff(place) == 1])
        before = np.concatenate([[-1], rank[:-1]])
        after = np.concatenate([rank[1:], [-1]])
        near_after = np.concatenate([near[1:], [False]])
        index = np.arange(len(place))
        start = np.maximum.accumulate(np.where(near & (before == rank), 0, index))
        keep = ~(near & (before < rank)) & ~(near_after & (after < rank)) & ((index - start) % 2 == 0)
        place, rank = place[keep], rank[keep]
        used = np.zeros(len(order), bool)
        used[rank] = True
        chosen = value[order[used]]
        lefts.append((chosen >> kind(shift)).astype(np.uint32))
        rights.append((chosen & kind((1 << shift) - 1)).astype(np.uint32))
        per.append(len(chosen))
        seq[place] = symbols + (np.cumsum(used) - 1)[rank]
        last[place] = last[place + 1]
        stay = np.ones(len(seq), bool)
        stay[place + 1] = False
        # Next come the frequent pairs that are left, and the new symbols with what stands on either side.
        mark = np.zeros(len(seq), bool)
        mark[at], mark[place] = True, True
        previous = place[place > 0] - 1
        mark[previous - ~stay[previous]] = True
        mark &= ~last
        seq, last, mark = seq[stay], last[stay], mark[stay]
        mark[-1] = False
        at = np.flatnonzero(mark)
        symbols += len(chosen)
    left, right = (np.concatenate([np.empty(0, np.uint32), *x]) for x in (lefts, rights))
    size = np.ones(symbols, np.uint32)
    at = base
    for n in per:
        size[at : at + n] = size[left[at - base : at - base + n]] + size[right[at - base : at - base + n]]
        at += n
    full = lengths > 0
    per_doc = np.zeros(len(lengths), np.uint32)
    per_doc[full] = np.diff(np.concatenate([[0], np.flatnonzero(last) + 1]))
    bits = (symbols - 1).bit_length()
    head = np.array([base, symbols - base, len(seq), len(lengths), len(per), *per], "<u4").tobytes()
    rules = _packed(left, bits) + _packed(right, bits) + size[base:].astype("<u4").tobytes()
    return MAGIC + head + rules + _packed(seq, bits) + per_doc.astype("<u4").tobytes() + lengths.astype("<u4").tobytes()


class Block:
    """A payload opened for decoding, whole, one document or one id at a time."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token block")
        self.base, rules, symbols, docs, rounds = (int(x) for x in np.frombuffer(payload, "<u4", 5, 4))
        at = 24
        self.per = np.frombuffer(payload, "<u4", rounds, at)
        bits = (self.base + rules - 1).bit_length()
        self.left, at = _unpacked(payload, at + 4 * rounds, rules, bits)
        self.right, at = _unpacked(payload, at, rules, bits)
        self.expansion = np.frombuffer(payload, "<u4", rules, at)
        self.symbols, at = _unpacked(payload, at + 4 * rules, symbols, bits)
        self.per_doc = np.frombuffer(payload, "<u4", docs, at)
        self.lengths = np.frombuffer(payload, "<u4", docs, at + 4 * docs)
        self._stops: np.ndarray | None = None

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        first = self.base + len(self.left)
        for n in self.per[::-1]:
            first -= int(n)
            rule = np.flatnonzero(seq >= first)
            if len(rule):
                which = seq[rule] - self.base
                seq = np.insert(seq, rule + 1, self.right[which])
                seq[rule + np.arange(len(rule))] = self.left[which]
        return seq

    def ids(self) -> np.ndarray:
        return self._expand(self.symbols)

    def document(self, i: int) -> np.ndarray:
        start = int(self.per_doc[:i].sum())
        return self._expand(self.symbols[start : start + int(self.per_doc[i])])

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        rule = symbols >= self.base
        out[rule] = self.expansion[symbols[rule] - self.base]
        return out

    def token(self, i: int, j: int) -> int:
        """The j-th id of document i: its symbol by a search in the sums of expansion lengths, then down the rules."""
        if not 0 <= j < int(self.lengths[i]):
            raise IndexError(j)
        if self._stops is None:
            self._stops = np.cumsum(self._sizes(self.symbols))
        j += int(self.lengths[:i].sum(dtype=np.int64))
        at = int(np.searchsorted(self._stops, j, side="right"))
        s, j = int(self.symbols[at]), j - int(self._stops[at - 1]) if at else j
        while s >= self.base:
            left, right = int(self.left[s - self.base]), int(self.right[s - self.base])
            n = int(self._sizes(np.array([left]))[0])
            s, j = (left, j) if j < n else (right, j - n)
        return s


# Files

_ENCODERS: dict[int, ChunkEncoder] = {}

BLOCK_SCHEMA = "part int, block long, doc_ids array<long>, n_tokens long, payload binary"


def write_blocks(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, block_tokens: int = 1 << 20, batch_rows: int = 2000) -> None:
    """Write the ids of every row of ``docs`` (doc_id, text, ...), each document with ``end_id`` at its end, in order of doc_id.

    Null text counts as empty: only the end id. Null doc_ids come first. Rows of equal doc_id stand together, ordered by a hash of
    their text, so repeated rows are written once each and reruns agree. An empty table gives an empty file table. A document is
    never split; a task holds one block (``block_tokens`` ids, or one longer document) besides the ``batch_rows`` rows that it reads at once.
    Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        source = f.read()
    shared = spark.sparkContext.broadcast(source)
    token = zlib.crc32(source.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _ENCODERS:
            _ENCODERS[token] = ChunkEncoder(shared.value)
        encoder = _ENCODERS[token]
        base = encoder.tokenizer.get_vocab_size(True)
        part, block = TaskContext.get().partitionId(), 0
        doc_ids, ids, lengths, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal block, held
            flat, names = np.concatenate(ids), pa.concat_arrays(doc_ids)
            columns = {
                "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int64()), "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
                "n_tokens": pa.array([len(flat)], pa.int64()), "payload": pa.array([compress(flat, np.concatenate(lengths), base)], pa.binary()),
            }
            block, held = block + 1, 0
            for x in (doc_ids, ids, lengths):
                x.clear()
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        for batch in batches:
            for some in slices(batch, "text"):
                found, n = encoder.encode_all(some.column("text"))
                stops = np.cumsum(n + 1)
                flat = np.full(len(found) + len(n), end_id, np.uint32)
                inside = np.ones(len(flat), bool)
                inside[stops - 1] = False
                flat[inside] = found
                at = 0
                while at < len(n):
                    done = int(stops[at - 1]) if at else 0
                    # Up to and with the document that fills the block.
                    upto = min(int(np.searchsorted(stops, done + block_tokens - held)) + 1, len(n))
                    doc_ids.append(some.column("doc_id").slice(at, upto - at))
                    ids.append(flat[done : stops[upto - 1]])
                    lengths.append(n[at:upto] + 1)
                    held += len(ids[-1])
                    at = upto
                    if held >= block_tokens:
                        yield close()
        if ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(partitions_of(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, batch_rows)
    try:
        ordered.mapInArrow(run, BLOCK_SCHEMA).write.parquet(path)
    finally:
        spark.conf.set(setting, before)


def read_index(blocks: DataFrame) -> DataFrame:
    """part, block, first: the number of ids in all blocks before each. The driver holds one sum for each part.

    No blocks give an empty index. (part, block) names one block; a table that holds blocks twice is an error of its writer.
    """
    narrow = blocks.select("part", "block", "n_tokens")
    sums = sorted(narrow.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    firsts, total = [], 0
    for part, n in sums:
        firsts.append((part, total))
        total += n
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    within = narrow.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return within.join(blocks.sparkSession.createDataFrame(firsts, "part int, base long"), "part").select("part", "block", (F.col("base") + F.col("before")).alias("first"))


def read_documents(blocks: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in a table of blocks.

    Documents come back as they were written: null doc_ids as null, empty texts with their end id alone, repeated rows each for
    itself. No blocks give an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                opened = Block(batch.column("payload")[row].as_py())
                flat = opened.ids().astype("<u4")
                stops = np.cumsum(opened.lengths, dtype=np.int64)
                starts = stops - opened.lengths
                n = len(stops)
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                columns = {
                    "part": pa.array(np.full(n, batch.column("part")[row].as_py(), np.int32)), "block": pa.array(np.full(n, batch.column("block")[row].as_py(), np.int64)),
                    "doc_id": batch.column("doc_ids")[row].values, "offset": pa.array(starts), "n_tokens": pa.array(opened.lengths.astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([starts, stops[-1:]]).astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = "part int, block long, doc_id long, offset long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    found = blocks.select("part", "block", "doc_ids", "payload").mapInArrow(run, schema)
    out = found.join(read_index(blocks), ["part", "block"])
    return out.select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
