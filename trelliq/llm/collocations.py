"""Phrases whose words keep together, from generalised suffix automata of word sequences.

Every task turns its texts into shards of word ids and builds a suffix automaton of each, no deeper than the longest phrase. Its states are
enumerated into phrases with the number of places where they end, and these counts are added up across shards. Scores need no more than
the counts of phrases and of their parts; whether a longer phrase makes a shorter one redundant follows from the suffix links of the
phrases, and of their mirror images, one word at a time.

Most phrases of a corpus are rare, and no frequent phrase has a rare part. So a first pass counts hashes of words, pairs and triples; those
that are frequent set bits in a table of fixed size, and the automata leave out what has no bit. That only saves work: what shares a
hash or a bit with something frequent is counted in vain, and counts are exact however full the table is.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, partitions_of

#: Lower-cases A-Z, makes what ends a piece a line feed, and tabs spaces.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))

#: Words of a shard, bytes of its vocabulary, and bytes of a text that become words at once.
SHARD_WORDS, SHARD_BYTES, SLICE_BYTES = 1 << 20, 32 << 20, 1 << 20

#: Phrases of up to so many words are counted by hashes of 40 bits first. The table of frequent ones has 2^26 bits (8 MB, sent to every
#: task), put together in blocks.
HASHED_WORDS, TABLE_BITS, BLOCK_BITS = 3, 26, 17

#: Counts of phrases that a task adds up over its shards take up to so many bytes before they leave it.
HELD_BYTES = 64 << 20

#: Shuffle partitions for each task of the phrase pass. A task sends each of its phrases about once, so more tasks send more rows for the same phrases.
PARTITIONS_A_TASK = 8

#: Totals by language are broadcast up to this many bytes.
BROADCAST_BYTES = 8 << 20

#: Multiplier of a pair's first word and of the mix (odd 64-bit constants of XXH64).
_MIX = (np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F))


def _slices(text: bytes, size: int) -> Iterator[list[bytes]]:
    """Words of a text and line feeds between its pieces, some at a time, with empty strings among them."""
    text = text.translate(_PLAIN)
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            end = 1 + max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end))
            if end <= at:
                end = 1 + min((i for i in (text.find(b" ", at), text.find(b"\n", at)) if i >= 0), default=len(text))
        yield text[at:end].replace(b"\n", b" \n ").split(b" ")
        at = end


class _Names:
    """Language, word and hash by id; id 0 is what parts pieces."""

    def __init__(self):
        self.langs, self.words, self.hashes = [None], [b"\n"], array("Q", [0])

    def add(self, lang: str, word: bytes, h: int) -> None:
        self.langs.append(lang)
        self.words.append(word)
        self.hashes.append(h)


class _Vocabulary(dict):
    """Ids of one language's words, from a list that all languages of a shard share."""

    def __init__(self, lang: str, names: _Names):
        super().__init__({b"": -1, b"\n": 0})
        self.lang, self.names, self.salt, self.size = lang, names, lang.encode("utf-8", "surrogatepass") + b"\0", 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.names.words)
        self.size += 170 + 2 * len(word)
        self.names.add(self.lang, word, xxhash.xxh3_64_intdigest(self.salt + word))
        return n


@dataclass
class Shard:
    """Word ids with 0 between pieces; the first ``context`` of them were counted by the shard before."""

    words: np.ndarray
    context: int
    names: _Names

    def hashes(self) -> np.ndarray:
        return np.frombuffer(self.names.hashes, np.uint64)


def shards(batches: Iterator[pa.RecordBatch], depth: int, most: tuple[int, int, int]) -> Iterator[Shard]:
    """The texts (lang string, text binary) of a partition; one longer than a shard goes on in the next, with its last words as context. ``most``: see SHARD_WORDS."""
    most_words, most_bytes, slice_bytes = most
    parts: list[np.ndarray] = []
    held = context = 0
    names = _Names()
    vocabularies: dict[str, _Vocabulary] = {}

    def close() -> Shard:
        return Shard(np.concatenate(parts), context, names)

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            for tokens in _slices(text.as_py(), slice_bytes):
                known = vocabularies.get(lang)
                if known is None:
                    known = vocabularies[lang] = _Vocabulary(lang, names)
                ids = np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens))
                parts.append(ids[ids >= 0])
                held += len(parts[-1])
                if held >= most_words or sum(v.size for v in vocabularies.values()) >= most_bytes:
                    done = close()
                    yield done
                    names = _Names()
                    fresh = _Vocabulary(lang, names)
                    # The text may go on: what a phrase may still begin with stays. A piece that has ended takes nothing along.
                    last = [fresh[done.names.words[i]] for i in done.words[-(depth - 1) :]] if depth > 1 else []
                    vocabularies = {lang: fresh}
                    parts, held, context = [np.array(last, np.int32)], 0, len(last)
            parts.append(np.zeros(1, np.int32))
    if held:
        yield close()


def _hashes(shard: Shard, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For phrases of 1, 2, ... words: the places where one ends, and its hash."""
    of_word = shard.hashes()[shard.words]
    alive, h = shard.words > 0, of_word.copy()
    for d in range(1, min(depth, HASHED_WORDS) + 1):
        if d > 1:
            mixed = (h[:-1] * _MIX[0]) ^ of_word[1:]
            mixed ^= mixed >> np.uint64(29)
            h[1:] = mixed * _MIX[1]
            alive[1:] = alive[:-1] & (shard.words[1:] > 0)
            alive[0] = False
        yield np.flatnonzero(alive), (h[alive] >> np.uint64(24)).astype(np.int64)


def _counts(depth: int):
    """Tasks' counts of hashes."""
    most = SHARD_WORDS, SHARD_BYTES, SLICE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in shards(batches, depth, most):
            for at, h in _hashes(s, depth):
                keys, n = np.unique(h[at >= s.context], return_counts=True)
                found = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int32))], names=["key", "n"])
                yield from (found.slice(i, 1 << 16) for i in range(0, found.num_rows, 1 << 16))

    return run


def _bits():
    """Blocks of the table, from the places of its bits."""
    block_bits = BLOCK_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column("at").to_numpy()
            for block in np.unique(at >> block_bits).tolist():
                bits = blocks.setdefault(block, np.zeros(1 << block_bits, bool))
                bits[at[at >> block_bits == block] & ((1 << block_bits) - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array([np.packbits(b).tobytes() for b in blocks.values()], pa.binary())], names=["block", "bits"])

    return run


def _frequent(rows: DataFrame, depth: int, least: int) -> bytes:
    """The table: a bit for the hash of every word, pair and triple that occurs ``least`` times, and perhaps of others."""
    n = partitions_of(rows.sparkSession)
    # A shard's hashes differ, so there is nothing to add up before the shuffle; a hash has a row from each shard at most.
    counted = rows.mapInArrow(_counts(depth), "key long, n int").repartition(2 * n, "key").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    bits = counted.select(F.shiftright("key", 40 - TABLE_BITS).alias("at"))
    found = bits.repartition(n, F.shiftright("at", BLOCK_BITS)).mapInArrow(_bits(), "block long, bits binary")
    table, size = bytearray(1 << TABLE_BITS - 3), 1 << BLOCK_BITS - 3
    for block, bits in found.toLocalIterator():
        table[block * size : (block + 1) * size] = bits
    return bytes(table)


@dataclass
class SuffixAutomaton:
    """States of a generalised suffix automaton; each stands for the phrases that end at the same places.

    A state's phrases are the last ``shortest`` to ``longest`` words before ``end``, one of its ``count`` places. ``link`` is the state
    of the longest suffix that ends at more places; -1 is the empty phrase.
    """

    shortest: np.ndarray
    longest: np.ndarray
    count: np.ndarray
    end: np.ndarray
    link: np.ndarray


def suffix_automaton(words: np.ndarray, depth: int, context: int = 0, frequent: list[np.ndarray] = ()) -> SuffixAutomaton:
    """The automaton of sequences with 0 between them, for phrases of up to ``depth`` words.

    Built a word deeper at a time: each phrase moves on by each word that follows it somewhere, and its suffix link is the phrase that
    its last words make, which ends at the same place one level up. A phrase that ends at as many places as its suffix is in the same
    state. Places before ``context`` are not counted. ``frequent`` says of phrases of 1, 2, ... words whether the one that ends at a place is to
    be kept; all longer ones go with it.
    """
    size = int(words.max(initial=0)) + 1
    place = np.arange(len(words))
    node, alive = words.astype(np.int64), words > 0
    if len(frequent):
        alive &= frequent[0]
    depths, counts, ends, links = [], [], [], []
    base = 0  # nodes of the levels before
    below = -1
    for d in range(1, depth + 1):
        if d > 1:
            moves = np.zeros(len(words), bool)
            moves[1:] = alive[:-1] & alive[1:]
            if d <= len(frequent):
                moves &= frequent[d - 1]
            at = place[moves]
            if not len(at):
                break
            keys, node_of = np.unique(node[at - 1] * size + words[at], return_inverse=True)
            n = len(keys)
            suffix = node[at]
        else:
            at, node_of, n, suffix = place[alive], node[alive], size, None
        end, link = np.zeros(n, np.int64), np.full(n, -1)
        end[node_of] = at
        if suffix is not None:
            link[node_of] = suffix + below
        depths.append(np.full(n, d))
        counts.append(np.bincount(node_of[at >= context], minlength=n))
        ends.append(end)
        links.append(link)
        alive = np.zeros(len(words), bool)
        alive[at] = True
        node = np.full(len(words), -1)
        node[at] = node_of
        below, base = base, base + n
    if not depths:
        return SuffixAutomaton(*[np.zeros(0, np.int64)] * 5)
    d, count, end, link = (np.concatenate(x) for x in (depths, counts, ends, links))
    same = (link >= 0) & (count == count[link])
    head = np.arange(len(d))
    # From the deepest level up, a suffix that ends at the same places joins the state of the longer phrase.
    for level in range(depth, 1, -1):
        v = np.flatnonzero(same & (d == level))
        head[link[v]] = head[v]
    lowest = np.full(len(d), depth + 1)
    np.minimum.at(lowest, head, d)
    last = np.flatnonzero(~same)  # a state's shortest phrase links to another state
    out = np.full(len(d), -1)
    out[head[last]] = np.where(link[last] >= 0, head[link[last]], -1)
    states = np.flatnonzero((head == np.arange(len(d))) & (count > 0))
    number = np.full(len(d) + 1, -1)
    number[states] = np.arange(len(states))
    return SuffixAutomaton(lowest[states], d[states], count[states], end[states], number[out[states]])


def _phrases(depth: int, table: bytes | None):
    """Tasks' counts of phrases, and of all words as phrases of none. A phrase's counts in the shards of a task are added up while they fit into HELD_BYTES."""
    most, shift, room = (SHARD_WORDS, SHARD_BYTES, SLICE_BYTES), 40 - TABLE_BITS, HELD_BYTES

    def rows(lang: str, phrases: list[bytes | None], counts: list[int]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(phrases), 1 << 16):
            some = phrases[i : i + (1 << 16)]
            lengths = [0 if p is None else p.count(b" ") + 1 for p in some]
            columns = [pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()), pa.array(lengths, pa.int32()), pa.array(counts[i : i + (1 << 16)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "words", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if table is None else np.frombuffer(table, np.uint8)
        totals: dict[str, int] = {}
        held: dict[str, dict[bytes, int]] = {}
        size = 0
        for s in shards(batches, depth, most):
            frequent = []
            for at, h in _hashes(s, depth) if bits is not None else ():
                h >>= shift
                frequent.append(np.zeros(len(s.words), bool))
                frequent[-1][at] = bits[h >> 3] >> (7 - (h & 7)) & 1
            a = suffix_automaton(s.words, depth, s.context, frequent)
            for lang, n in zip(s.names.langs[1:], np.bincount(s.words[s.context :], minlength=len(s.names.words)).tolist()[1:], strict=True):
                totals[lang] = totals.get(lang, 0) + n
            words = [s.names.words[i] for i in s.words.tolist()]
            langs = [s.names.langs[i] for i in s.words[a.end].tolist()]
            for lang, low, high, n, end in zip(langs, a.shortest.tolist(), a.longest.tolist(), a.count.tolist(), a.end.tolist(), strict=True):
                of_lang = held.get(lang)
                if of_lang is None:
                    of_lang = held[lang] = {}
                end += 1
                for k in range(low, high + 1):
                    phrase = b" ".join(words[end - k : end])
                    before = of_lang.get(phrase)
                    if before is None:
                        of_lang[phrase] = n
                        size += 200 + len(phrase)
                    else:
                        of_lang[phrase] = before + n
                if size > room:
                    for of, counts in held.items():
                        yield from rows(of, list(counts), list(counts.values()))
                    held, size = {}, 0
        for of, counts in held.items():
            yield from rows(of, list(counts), list(counts.values()))
        for of, n in totals.items():
            yield from rows(of, [None], [n])

    return run


def _local(rows: DataFrame, longest: int, table: bytes | None) -> DataFrame:
    """Counts of phrases from tasks that read several of the table's parts each, as many as there are cores at least."""
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, partitions_of(spark) // PARTITIONS_A_TASK)
    return rows.coalesce(tasks).mapInArrow(_phrases(longest, table), "lang string, phrase binary, words int, n long")


def phrase_counts(docs: DataFrame, longest: int = 5, min_count: int = 100, prune: bool = True) -> DataFrame:
    """(lang, phrase, words, n) of all phrases of 1 to ``longest`` words that occur ``min_count`` times or more, and, as a null phrase of 0 words,
    each language's number of words. See ``collocations`` for what a word and a phrase are. The result is a table in the shared folder."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    table = _frequent(rows, longest, min_count) if prune else None
    counted = _local(rows, longest, table).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter((F.col("n") >= min_count) | (F.col("words") == 0))
    return materialize(counted.select("lang", F.col("phrase").cast("string").alias("phrase"), "words", "n"), "phrases")


def _best(scored: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each language by score, count and phrase, with their rank; first in parts of a language, then of what those keep."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(32))
    some = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= most)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.filter(F.col("rank") <= most).drop("part")


def collocations(docs: DataFrame, longest: int = 5, min_count: int = 100, most: int = 2000, subsumed_percent: int = 100, prune: bool = True) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``most`` best phrases of ``docs`` (text, lang, ...).

    Texts are read whole, with A-Z lower-cased; ``.,;:!?`` and line ends part pieces, spaces and tabs the words of a piece. A phrase is 2 to
    ``longest`` words in a row within a piece that occurs a >= ``min_count`` times, overlaps included, among the language's n words. Cut after any
    of its words, it scores 1000 a n / (l r), rounded down, where l and r count its parts; the lowest such score is its own, of equal
    ones that of the first cut. A phrase goes if a longer one that contains it has ``subsumed_percent`` of its count. Ties in score
    fall by higher count, then by the phrase's bytes. All is exact, in 38 digits.

    A null lang is ``und`` and one language with it; a null text is empty. Repeated rows count each. Tables without phrases, and
    empty ones, give an empty result. Other columns are neither read nor returned.
    """
    counts = phrase_counts(docs, longest, min_count, prune)
    phrases, totals = counts.filter("words > 0").select("lang", "phrase", "words", "n"), counts.filter("words = 0").select("lang", F.col("n").alias("total"))
    words = F.split("phrase", " ")
    part = lambda start, n: F.array_join(F.slice(words, start, n), " ")
    candidates = phrases.filter("words > 1")
    # A containing phrase's count is at most that of any phrase between the two, so one word more on either side decides.
    longer = candidates.filter("words > 2").select("lang", "n", F.explode(F.array(part(F.lit(2), F.col("words") - 1), part(F.lit(1), F.col("words") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    open_ = candidates.join(longer, ["lang", "phrase"], "left").filter((100 * F.coalesce("longer", F.lit(0)) < subsumed_percent * F.col("n")))
    cuts = open_.select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    side = lambda key, count: phrases.select("lang", F.col("phrase").alias(key), F.col("n").alias(count))
    if (totals.agg(F.sum(F.length("lang") + 40)).first()[0] or 0) <= BROADCAST_BYTES:
        totals = F.broadcast(totals)
    parted = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    big = lambda c: f"CAST({c} AS DECIMAL(18, 0))"
    score = F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * {big('a')} * {big('total')}) div ({big('l')} * {big('r')})")
    scored = parted.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r", "total").alias("cut")).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("cut").alias("cut"))
    flat = scored.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.total").alias("n"), "cut.score")
    return _best(flat, most).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
