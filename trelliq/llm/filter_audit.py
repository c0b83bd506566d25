"""How filters of a corpus interact, from a histogram of their failure masks; DataFrame operations only.

Every document gets a mask with one bit for each filter that it fails. All that an order of filters keeps, removes or removes first
follows from how many documents of a part have each mask, so the texts are read once, and the orders are gone through over the 32
cells of each part.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE
from .quality import _let

#: Filters in the order of their bits.
FILTERS = "ABCDE"
_COPY = 1 << FILTERS.index("E")


def _failures_of_text(text: Column) -> Column:
    """Bits A to D of a text: few words, few different words, many capitals, symbols."""
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    counts = _let(words, lambda ws: F.struct(F.size(ws).cast("long").alias("n"), F.size(F.array_distinct(ws)).cast("long").alias("d")))
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    bit = lambda fails, i: F.when(fails, F.lit(1 << i)).otherwise(F.lit(0))
    by_words = _let(counts, lambda c: bit(c["n"] < 50, 0) + bit(100 * c["d"] < 65 * c["n"], 1))
    return by_words + bit(100 * capitals.cast("long") > 5 * F.char_length(text).cast("long"), 2) + bit(text.rlike("[#$%&*|]"), 3)


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of each source fail exactly the filters in ``mask``, and how many of them are labelled.

    A copy (E) is a document whose text a smaller doc_id has, in any source. Texts are told apart by SHA-256. A null text is empty, a null
    source the empty part, which it shares with empty sources. Repeated rows count each and are not copies of one another; a document
    without doc_id is never a copy and makes none, and has no label. Repeated labels of a document count once, and label it if one of
    them does. Other columns are neither read nor returned; an empty table has no cells.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        _failures_of_text(text).alias("mask"),
    )
    is_one = lambda c: F.max(F.when(F.col(c) == 1, F.lit(1)).otherwise(F.lit(0))).cast("long").alias(c)
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality"), is_one("toxic"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    labelled = rows.join(marks, "doc_id", "left").select("doc_id", "part", "digest", "mask", zero("quality").alias("good"), zero("toxic").alias("toxic"))
    # Equal texts have equal bits A to D, so a text's documents of a part are one row, with those of its smallest doc_id apart.
    each = labelled.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n", "good", "toxic")))
    whole = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    texts = each.groupBy("part", "digest", "mask", F.col("doc_id").isNull().alias("nameless")).agg(*whole, first.alias("first"))
    smallest = texts.groupBy(F.col("digest").alias("d")).agg(F.min("first.doc_id").alias("smallest"))
    known = texts.join(smallest, texts["digest"] == smallest["d"])
    original = lambda c: F.when(F.col("nameless"), F.col(c)).when(F.col("first.doc_id") == F.col("smallest"), F.col(f"first.{c}")).otherwise(F.lit(0).cast("long"))
    cell = lambda mask, value: F.struct(mask.alias("mask"), *[value(c).alias(c) for c in ("n", "good", "toxic")])
    two = F.array(cell(F.col("mask"), original), cell(F.col("mask") + _COPY, lambda c: F.col(c) - original(c)))
    return known.select("part", F.explode(two).alias("c")).select("part", "c.*").groupBy("part", "mask").agg(*whole)


def _steps() -> Column:
    """All orders, step by step: the order, the step, its filter's bit, and the bits of the filters before it."""
    bits = {f: 1 << i for i, f in enumerate(FILTERS)}
    steps = [
        {"filter_order": "".join(order), "step": k + 1, "bit": bits[f], "before": sum(bits[x] for x in order[:k])}
        for order in permutations(FILTERS)
        for k, f in enumerate(order)
    ]
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, bit: int, before: int>>")


def orders(cells: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from the cells of ``masks``.

    600 rows for each part that has a cell; parts without cells have no rows, cells of a part must differ in ``mask``, and a null part is
    a part. Sums are longs. An empty table gives an empty result, and other columns are neither read nor returned.
    """
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def over(count: str, test) -> Column:
        holds = lambda c: test(c["mask"].bitwiseAND(F.col("s.bit")) != 0, c["mask"].bitwiseAND(F.col("s.before")) != 0, c["mask"])
        return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(holds(c), c[count]).otherwise(F.lit(0).cast("long")))

    here = lambda fails, gone, mask: fails & ~gone
    steps = parts.select("part", "cells", F.explode(_steps()).alias("s")).select(
        "part", "s.filter_order", "s.step", "s.bit",
        over("n", lambda fails, gone, mask: ~fails & ~gone).alias("kept"),
        over("n", here).alias("removed"),
        over("n", lambda fails, gone, mask: fails & gone).alias("redundant"),
        over("n", lambda fails, gone, mask: mask == F.col("s.bit")).alias("unique_fails"),
        over("good", here).alias("good_lost"),
        over("toxic", here).alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit"))
    return steps.withColumn("shapley", shapley).drop("bit")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes at each step of each of the 120 orders, for every part of ``docs`` (doc_id, text, source, ...).

    See ``masks`` for nulls, ties, repeated rows and labels, and ``orders`` for the columns. A text of any length is one value of one row.
    """
    return orders(masks(docs, labels))
