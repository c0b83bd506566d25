"""Rows that the phrase pass of op12_collocations gives."""

from collections import Counter

import pyarrow as pa
import pytest

from trelliq.llm import collocations


@pytest.mark.parametrize("room", [None, 600])
def test_a_phrase_leaves_its_task_once(monkeypatch, room):
    monkeypatch.setattr(collocations, "SHARD_WORDS", 20)
    if room:
        monkeypatch.setattr(collocations, "HELD_BYTES", room)
    texts = [("en", "a b c. a b d e"), ("de", "a b c"), ("en", "a b c")] * 40
    batches = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in texts]), pa.array([x[1].encode() for x in texts])], names=["lang", "text"])] * 3
    rows = [(r["lang"], r["phrase"], r["words"], r["n"]) for b in collocations._phrases(3, None)(iter(batches)) for r in b.to_pylist()]
    found = Counter()
    for lang, phrase, words, n in rows:
        assert words == (len(phrase.split()) if phrase else 0)
        found[lang, phrase] += n
    expected = Counter()
    for lang, text in texts * 3:
        for piece in text.split("."):
            words = piece.split()
            expected[lang, None] += len(words)
            expected.update((lang, " ".join(words[i : i + k]).encode()) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    assert found == expected
    # Without the bound on memory each has one row, however many shards the task had.
    assert (len(rows) == len(found)) == (room is None)


def test_rows_do_not_grow_with_the_parts_of_a_table(spark):
    rows = spark.range(640, numPartitions=64).selectExpr("'en' AS lang", "CAST(concat('a b c. d ', id % 2) AS BINARY) AS text")
    found = collocations._local(rows, 3, None).toPandas()
    # a, b, c, a b, b c, a b c, d, 0, 1, d 0, d 1 and the number of words: from each task, and not from each of 64 parts.
    assert found["n"].sum() == 640 * (5 + 3 + 6) and len(found) == 12 * spark.sparkContext.defaultParallelism
