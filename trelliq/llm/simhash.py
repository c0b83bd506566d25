"""SimHash near-duplicates by a binary trie self-join.

Equal fingerprints are collapsed first. Two fingerprints within 3 bits agree on one of four 16-bit blocks, so each goes,
rotated, to four tables whose tries start with a shared block and no error. Below it the trie is joined with itself: pairs
of nodes go down together, gather the bits in which they differ, and are dropped beyond the budget. A trie node is a range of the
sorted fingerprints, so a whole frontier of node pairs takes one step in a few array operations. Pairs of nodes whose leaves
are already known to be one group are dropped too, so that a large group of near copies is linked without visiting all its pairs.

A table's block that very many fingerprints share is cut once more: what they have left are 48 bits, of which two of them agree on
one of four parts of 12 bits. So such a block goes to four tasks' worth of smaller tries, with 28 shared bits, and no link is lost.
Tasks read their blocks in sorted order and hold some at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ROW_KEY, discard, keyed, materialize, slices
from .graph import components

BLOCKS, BLOCK_BITS, BITS = 4, 16, 64
PART_BITS = (BITS - BLOCK_BITS) // BLOCKS

#: A block with more distinct fingerprints than this is cut; about as many rows are held in a task at once.
HOT = 1 << 20

#: The list of hot blocks is broadcast up to this many rows (of some 20 bytes), and joined by shuffle beyond it.
BROADCAST_ROWS = 1 << 18

#: Node pairs that take a step at once; more wait on a stack.
FRONTIER = 1 << 20

_xxh = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text: bit i is set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        return _xxh(b" ".join(words))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        part = words[at : min(at + (1 << 15), n) + shingle - 1]
        grams = zip(*[part[i:] for i in range(shingle)], strict=False)
        hashes = np.array([_xxh(b" ".join(g)) for g in grams], dtype=np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", *ROW_KEY]
    for batch in batches:
        for some in slices(batch, "text"):
            fp = np.array([fingerprint(t) for t in some.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[some.column(c) for c in names], pa.array(fp)], names=[*names, "fp"])


def _hook(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Merge the classes that the pairs (x, y) link; labels are roots before and after."""
    while True:
        a, b = label[x], label[y]
        open_ = a != b
        if not open_.any():
            return
        x, y, a, b = x[open_], y[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def trie_self_join(keys: np.ndarray, budget: int = 3, top: int = BLOCK_BITS, frontier: int = FRONTIER) -> np.ndarray:
    """Class of each of the sorted distinct ``keys`` (uint64) under links between keys that share their first ``top`` bits and
    differ in at most ``budget`` of the others; a class is named by its smallest index."""
    m = len(keys)
    label = np.arange(m)
    edge = np.flatnonzero(np.diff(keys >> np.uint64(BITS - top)) != 0) + 1
    lo, hi = np.concatenate([[0], edge]), np.concatenate([edge, [m]])
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(BITS - top - 1, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        bit, al, ah, bl, bh, err = stack.pop()
        if len(al) > frontier:
            for part in np.array_split(np.arange(len(al)), -(-len(al) // frontier)):
                stack.append((bit, al[part], ah[part], bl[part], bh[part], err[part]))
            continue
        # Leaf pairs are decided by the whole key.
        leaf = (ah - al == 1) & (bh - bl == 1)
        if leaf.any():
            x, y = al[leaf], bl[leaf]
            near = np.bitwise_count(keys[x] ^ keys[y]) <= budget
            _hook(label, x[near], y[near])
        run = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        one = (run[ah - 1] == run[al]) & (run[bh - 1] == run[bl]) & (label[al] == label[bl])
        go = ~(leaf | one)
        if bit < 0 or not go.any():
            continue
        al, ah, bl, bh, err = al[go], ah[go], bl[go], bh[go], err[go]
        ones = np.concatenate([[0], np.cumsum(((keys >> np.uint64(bit)) & np.uint64(1)).astype(np.int64))])
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        itself = al == bl
        other = ~itself
        children = [
            (al, am, bl, bm, err, None),
            (am, ah, bm, bh, err, None),
            (al, am, bm, bh, err + 1, None),
            (am, ah, bl, bm, err + 1, other),
        ]
        parts = []
        for a0, a1, b0, b1, e, where in children:
            ok = (a1 > a0) & (b1 > b0) & (e <= budget) & ~((a0 == b0) & (a1 - a0 == 1))
            if where is not None:
                ok &= where
            parts.append((a0[ok], a1[ok], b0[ok], b1[ok], e[ok]))
        nxt = [np.concatenate(c) for c in zip(*parts, strict=True)]
        if len(nxt[0]):
            stack.append((bit - 1, *nxt))
    return label


def _links(budget: int, hold: int):
    """Links within each block from rows (grid, key, fp) sorted by grid and key: ``grid`` says which bits the fingerprints share."""

    def of_grid(top: int, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(key)
        label = trie_self_join(key[order], budget, top)
        linked = np.flatnonzero(label != np.arange(len(label)))
        if len(linked):
            fp = fp[order]
            yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[label[linked]])], names=["u", "v"])

    def of_rows(grid: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = [0, *(np.flatnonzero(np.diff(grid)) + 1).tolist(), len(grid)]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            yield from of_grid(_top(int(grid[a])), key[a:b], fp[a:b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            grid, key, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("grid", "key", "fp"))
            held.append((grid, key.view(np.uint64), fp))
            if sum(len(h[0]) for h in held) < hold:
                continue
            grid, key, fp = (np.concatenate(c) for c in zip(*held, strict=True))
            # All blocks but the last are complete.
            same = (grid == grid[-1]) & (key >> np.uint64(BITS - _top(int(grid[-1]))) == key[-1] >> np.uint64(BITS - _top(int(grid[-1]))))
            cut = int(np.argmax(same))
            yield from of_rows(grid[:cut], key[:cut], fp[:cut]) if cut else ()
            held = [(grid[cut:], key[cut:], fp[cut:])]
        if held:
            yield from of_rows(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def _top(grid: int) -> int:
    """Bits that fingerprints of one block of a grid share: a grid is a table, whole (0 to 3) or cut by one of four parts."""
    return BLOCK_BITS if grid < BLOCKS else BLOCK_BITS + PART_BITS


def _turned(value, by: int, bits: int):
    """The low ``bits`` of a column, of which all others are 0, rotated to the left."""
    if not by:
        return value
    low = F.lit((1 << bits) - 1 if bits < 64 else -1)
    return F.shiftleft(value, by).bitwiseAND(low).bitwiseOR(F.shiftrightunsigned(value, bits - by))


def _blocks(distinct: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """(grid, key, fp): each fingerprint in every grid, its shared bits first; and the table of hot blocks that this reads."""
    keys = F.array(*[F.struct(F.lit(k).alias("grid"), _turned(F.col("fp"), k * BLOCK_BITS, BITS).alias("key")) for k in range(BLOCKS)])
    tables = distinct.select("fp", F.explode(keys).alias("t")).select("t.grid", "t.key", "fp")
    block = F.shiftrightunsigned("key", BITS - BLOCK_BITS).alias("block")
    large = materialize(tables.groupBy("grid", block).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("grid", "block", F.lit(True).alias("hot")), "simhash-hot")
    n = large.count()
    if not n:
        return tables, large
    rest = F.col("key").bitwiseAND(F.lit((1 << (BITS - BLOCK_BITS)) - 1))
    first = F.shiftleft("block", BITS - BLOCK_BITS)
    parts = [F.struct((F.col("grid") + BLOCKS * (j + 1)).alias("grid"), first.bitwiseOR(_turned(rest, j * PART_BITS, BITS - BLOCK_BITS)).alias("key")) for j in range(BLOCKS)]
    marked = tables.withColumn("block", block).join(F.broadcast(large) if n <= BROADCAST_ROWS else large, ["grid", "block"], "left")
    whole = F.array(F.struct("grid", "key"))
    return marked.select("fp", F.explode(F.when(F.col("hot"), F.array(*parts)).otherwise(whole)).alias("t")).select("t.grid", "t.key", "fp"), large


def near_duplicates(docs: DataFrame, budget: int = 3) -> DataFrame:
    """Fingerprint and component of every row of ``docs`` (doc_id, text, ...): doc_id, fp, component_id, first, the row's place.

    Documents are linked where fingerprints differ in at most ``budget`` (0 to 3) bits, and components are what links reach.
    component_id is the smallest doc_id of the component; ``first`` marks one row of it, one with that doc_id. Null and blank
    texts have fingerprint 0 and are linked like any other. Null doc_ids come last: component_id is null only where all are.
    Repeated rows share a component. An empty table gives an empty result. Other columns are neither read nor returned.
    """
    if not 0 <= budget < BLOCKS:
        raise ValueError("four blocks find differences of at most 3 bits")
    rows = keyed(docs.select("doc_id", "text"), "simhash-rows").withColumn("doc_id", F.col("doc_id").cast("long"))
    prints = materialize(rows.mapInArrow(_fingerprints, "doc_id long, __trelliq_file long, __trelliq_row long, fp long"), "simhash")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *ROW_KEY)
    distinct = materialize(prints.groupBy("fp").agg(F.min(place).alias("rep")), "simhash-distinct")
    tables, large = _blocks(distinct, HOT)
    shared = F.when(F.col("grid") < BLOCKS, F.shiftrightunsigned("key", BITS - BLOCK_BITS)).otherwise(F.shiftrightunsigned("key", BITS - BLOCK_BITS - PART_BITS))
    sorted_ = tables.repartition("grid", shared).sortWithinPartitions("grid", "key")
    links = sorted_.mapInArrow(_links(budget, HOT), "u long, v long")
    roots = components(links)
    grouped = materialize(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    for done in (large, distinct):
        discard(done)
    best = grouped.groupBy("root").agg(F.min("rep").alias("best"))
    found = grouped.join(best, "root").select(F.col("fp").alias("fp_"), "best")
    out = prints.join(found, F.col("fp") == F.col("fp_"))
    first = F.lit(True)
    for c in ("doc_id", *ROW_KEY):
        first = first & F.col(c).eqNullSafe(F.col(f"best.{c}"))
    return out.select("doc_id", *ROW_KEY, "fp", F.col("best.doc_id").alias("component_id"), first.alias("first"))


def keep_one_of_each(docs: DataFrame, budget: int = 3) -> DataFrame:
    """``docs`` with one row of each component, columns as they were.

    It is the row with the smallest doc_id, of several such rows one of them, and one with a null doc_id only where all are null. Null
    and blank texts are one component with whatever else has fingerprint 0 or is linked to it. An empty table stays empty.
    """
    rows = keyed(docs, "simhash-rows")
    kept = near_duplicates(rows.drop(*ROW_KEY), budget).filter("first").select(*ROW_KEY)
    return rows.join(kept, ROW_KEY, "left_semi").drop(*ROW_KEY)
