"""Quality rules as a bitmask ledger, in DataFrame operations only.

Every rule is evaluated once per document. The ledger stores the measurements and one long whose bit i says that rule i
failed. A policy is a named, versioned set of rules (a mask): applying one is ``failures & mask``, so policies can change
without touching a text again, and ablations come from counting the few distinct failure masks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD


@dataclass(frozen=True)
class Rule:
    """A failure condition over the ledger's measurements, in SQL. Rules never see the text."""

    name: str
    fails: str


#: Bit i of ``failures`` is rule i. New rules are added at the end; a rule that changes is a new rule.
RULES: tuple[Rule, ...] = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("capitals", "2 * n_capitals > n_letters"),
    Rule("repeated_lines", "10 * n_dup_lines > 4 * n_lines"),
    Rule("stuttering", "10 * n_stutters > 3 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("few_letters", "2 * n_letters < word_chars"),
)

#: (policy, version) -> names of its rules.
POLICIES: dict[tuple[str, int], tuple[str, ...]] = {
    ("base", 1): ("few_words", "repeated_windows"),
    ("corpus", 1): tuple(r.name for r in RULES),
}


def mask_of(policy: str, version: int) -> int:
    bits = {r.name: 1 << i for i, r in enumerate(RULES)}
    return sum(bits[name] for name in POLICIES[policy, version])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _window_hashes(words: Column) -> Column:
    """A 64-bit hash for each window of 8 words (XXH64, chained over the words)."""
    window = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(8)])
    return F.when(F.size(words) >= 8, F.transform(F.sequence(F.lit(0), F.size(words) - 8), window)).otherwise(F.expr("cast(array() as array<bigint>)"))


def _covered(hashes: Column) -> Column:
    """Number of words in windows whose hash occurs twice or more: the length of a union of intervals of 8."""

    def from_pairs(pairs: Column) -> Column:
        same = lambda x, k: (F.get(pairs, k - 1)["h"] == x["h"]) | (F.get(pairs, k + 1)["h"] == x["h"])
        starts = F.sort_array(F.transform(F.filter(pairs, lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"]))
        step = lambda acc, i: F.struct((i + 8).alias("end"), (acc["total"] + F.least(F.lit(8), i + 8 - acc["end"])).alias("total"))
        return F.aggregate(starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")), step)["total"]

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(pairs, from_pairs))


def _of_words(words: Column) -> Column:
    stutter = F.filter(words, lambda w, i: (i > 0) & (F.get(words, i - 1) == w))
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.concat_ws("", words)).cast("long").alias("word_chars"),
        _let(_window_hashes(words), _covered).cast("long").alias("n_repeat_words"),
        F.size(stutter).cast("long").alias("n_stutters"),
    )


def _of_lines(lines: Column) -> Column:
    return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))


def _kept_chars(text: Column, dropped: str) -> Column:
    return F.char_length(F.regexp_replace(text, dropped, "")).cast("long")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stutters", "n_lines", "n_letters", "n_capitals")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failures`` for every row of ``docs`` (doc_id, text, ...).

    Null and blank texts have no words, fail few_words and measure 0 throughout. Repeated rows are measured each for itself.
    A null doc_id is passed on. An empty table gives an empty ledger. Other columns are neither read nor returned. Windows
    count as equal by a 64-bit hash of their words; within one text of a million words the odds of a wrong match are 3e-8.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, SPACE, "") != "")
    measured = docs.select(
        "doc_id",
        _let(words, _of_words).alias("w"),
        _let(lines, _of_lines).alias("l"),
        _kept_chars(text, "[^#*$%&|<>]+").alias("n_symbols"),
        _kept_chars(text, r"[^\p{L}]+").alias("n_letters"),
        _kept_chars(text, r"[^\p{Lu}]+").alias("n_capitals"),
    ).select("doc_id", "w.*", "l.*", "n_symbols", "n_letters", "n_capitals")
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return measured.select("doc_id", *MEASURES, failures.cast("long").alias("failures"))


def decide(book: DataFrame, policy: str = "corpus", version: int = 1) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy; failing the base always drops.

    Row by row: repeated rows are decided alike, null doc_ids and other columns are passed on, an empty ledger stays empty. A null in
    ``failures``, which ``ledger`` never writes, gives nulls.
    """
    failed = lambda mask: F.col("failures").bitwiseAND(F.lit(mask)) != 0
    base = failed(mask_of("base", 1))
    return book.withColumns({"base_failed": base, "kept": ~(base | failed(mask_of(policy, version)))})


def ablations(book: DataFrame, policy: str = "corpus", version: int = 1) -> DataFrame:
    """For each rule of a policy: documents that fail it, fail nothing else of the policy, and are dropped in all.

    The documents are first counted by failure mask (at most 2 to the number of rules), from which all else follows. Repeated rows
    count each, and null doc_ids like others. An empty ledger has no masks, and the result no rows.
    """
    mask = mask_of(policy, version)
    cells = book.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(RULES) if mask >> i & 1]))
    counted = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).alias
    return (
        cells.select("bits", "n", rules.alias("r"))
        .groupBy("r.rule", "r.bit")
        .agg(counted(F.col("bits").bitwiseAND(F.col("r.bit")) != 0)("failing"), counted(F.col("bits") == F.col("r.bit"))("only_this"), counted(F.col("bits") != 0)("dropped"))
    )
