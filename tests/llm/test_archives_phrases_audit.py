"""WARC archives, phrases and the filter audit against brute force, and on odd rows, hostile payloads and every place of a cut."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import TINY
from test_operators import LOWER, edge, nothing  # noqa: F401

from trelliq.llm import collocations, filter_audit, warc
from trelliq.llm.common import scratch
from trelliq.llm.queries import ORACLE_SQL, QUERIES


def values(df):
    return sorted(map(tuple, df.collect()), key=repr)


# Archives

MAGIC = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Page-ID: 999\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: 6\r\n\r\nhello!\r\n\r\n"
LONG = "<p>" + "long " * 600 + "</p>"
PAGES = [
    (1, "http://a.org/1", "x" * 99), (2, "http://a.org/2", "x" * 99), (3, "http://a.org/3", "y" * 100), (4, "http://a.org/4", "y" * 100), (5, None, None), (6, "", ""),
    (7, "http://b.org/\r\nWARC-Type: bad", "<html>\r\n\r\n" + MAGIC * 3 + "end"), (8, "http://b.org", MAGIC), (9, "http://b.org", "\r\n\r\n" + MAGIC), (10, "u", LONG), (11, "u", LONG),
    (11, "u", LONG), (None, "u", LONG), (None, "u", "é" * 120), (12, "u", "WARC/1.0\r\nContent-Length: 99999999\r\n\r\n" + "z" * 50), (13, "u", "ü" * 50), (14, "u", "ü" * 50),
    (15, "u", "WARC/1.1\r\n" * 40), (16, "u", "\n\r\n\r\r\n\r\n\r" * 30), (0, "u", MAGIC + "tail   and \x85"),
]


def brute_pages(rows):
    out, first, n = [], {}, Counter()
    data = [(i, (h or "").encode()) for i, _, h in rows]
    for i, h in data:
        if len(h) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    for i, h in data:
        n[i, h] += 1
        again = len(h) >= 100 and h in first and (i != first[h] or n[i, h] > 1)
        out.append((i, len(h), hashlib.sha256(h).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "'y' AS file", "'z' AS offset", "1 AS row", "2 AS n", "3 AS first")


def test_archives_round_trip(spark, pages):
    assert values(warc.round_trip(pages.repartition(3))) == brute_pages(PAGES)
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize(("size", "broadcast", "n"), [(127, True, 4), (700, False, 20), (3000, True, 20)])
def test_archives_cut_anywhere(spark, monkeypatch, size, broadcast, n):
    """Blocks smaller than a header, than a payload, and with several records; false records in payloads stay what they are."""
    path, rows = scratch(spark, "test-warc"), PAGES[-n:]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    if not broadcast:
        monkeypatch.setattr(warc, "BROADCAST_BYTES", -1)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        got = warc.read_archives(spark, path).selectExpr("headers['warc-page-id'] AS i", "payload", "headers['warc-type'] AS t").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = Counter((None if i is None else str(i), (h or "").encode()) for i, _, h in rows)
    revisits = [r.i for r in got if r.t == "revisit"]
    found = Counter((r.i, bytes(r.payload)) for r in got if r.t == "response")
    assert not found - want and sum(found.values()) + len(revisits) == len(rows)


def write(path, name, data):
    import os

    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "wb") as f:
        f.write(data)


def test_archives_of_other_writers(spark, tmp_path):
    record = lambda kind, body, eol=b"\r\n\r\n": b"WARC/1.0\r\nwarc-type: " + kind + b"\r\ncontent-length: " + str(len(body)).encode() + b"\r\n\r\n" + body + eol
    good = record(b"warcinfo", b"software: x\r\n") + record(b"resource", bytes(range(256)) * 3) + record(b"metadata", b"")
    write(tmp_path / "good", "a.warc", good)
    write(tmp_path / "good", "b.warc", record(b"conversion", MAGIC.encode()))
    got = warc.read_archives(spark, str(tmp_path / "good")).selectExpr("headers['warc-type'] AS t", "payload").collect()
    assert sorted((r.t, bytes(r.payload)) for r in got) == sorted([("warcinfo", b"software: x\r\n"), ("resource", bytes(range(256)) * 3), ("metadata", b""), ("conversion", MAGIC.encode())])
    write(tmp_path / "cut", "a.warc", good + record(b"resource", b"q" * 500)[:200])
    with pytest.raises(ValueError, match="records lead to"):
        warc.read_archives(spark, str(tmp_path / "cut"))
    assert warc.read_archives(spark, str(tmp_path / "cut"), strict=False).count() == 3


def test_revisit_of_what_is_missing(spark, pages):
    path = scratch(spark, "test-warc")
    from pyspark.sql import functions as F

    warc.records(pages).filter(~F.col("record").contains("WARC-Page-ID: 3\r\n")).write.option("lineSep", "\r\n\r\n").text(path)
    got = {r.page_id: r for r in warc.page_records(warc.read_archives(spark, path)).collect()}
    assert got[4].record_type == "revisit" and got[4].refers_to is None and got[4].payload_digest is None and 3 not in got


# Phrases


def brute_counts(rows, longest):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for d in range(1, longest + 1):
                for i in range(len(ws) - d + 1):
                    f[lang, " ".join(ws[i : i + d])] += 1
    return n, f


def brute_phrases(rows, longest=5, least=100, most=2000, percent=100):
    n, f = brute_counts(rows, longest)
    f = {k: c for k, c in f.items() if c >= least}
    found = defaultdict(list)
    for (lang, phrase), a in f.items():
        ws = phrase.split(" ")
        inside = lambda other: len(other.split(" ")) > len(ws) and f" {phrase} " in f" {other} "  # noqa: B023, E731
        if len(ws) < 2 or any(m == lang and inside(p) and 100 * c >= percent * a for (m, p), c in f.items()):
            continue
        cuts = []
        for k in range(1, len(ws)):
            l, r = f[lang, " ".join(ws[:k])], f[lang, " ".join(ws[k:])]
            cuts.append((1000 * a * n[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        found[lang].append((-score, -a, phrase.encode(), l, r))
    out = []
    for lang, each in found.items():
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(each)[:most])]
    return sorted(out, key=repr)


def brute_automaton(sequences, depth):
    """Classes of phrases that end at the same places."""
    ends = defaultdict(set)
    for s, words in enumerate(sequences):
        for i in range(len(words)):
            for d in range(1, min(depth, i + 1) + 1):
                ends[tuple(words[i - d + 1 : i + 1])].add((s, i))
    classes = defaultdict(list)
    for phrase, places in ends.items():
        classes[frozenset(places)].append(phrase)
    return classes


def test_suffix_automaton_against_classes_of_places():
    rng = random.Random(5)
    for depth, letters in itertools.product((1, 2, 3, 5), (1, 2, 4)):
        sequences = [[rng.randint(1, letters) for _ in range(rng.randint(0, 12))] for _ in range(6)]
        words = np.array([x for s in sequences for x in [*s, 0]], np.int32)
        a = collocations.suffix_automaton(words, depth)
        phrase = lambda i, n: tuple(words[a.end[i] - n + 1 : a.end[i] + 1].tolist())  # noqa: B023, E731
        states = [{phrase(i, n) for n in range(a.shortest[i], a.longest[i] + 1)} for i in range(len(a.end))]
        classes = brute_automaton(sequences, depth)
        assert sorted(map(sorted, states)) == sorted(map(sorted, classes.values()))
        by = {p: places for places, phrases in classes.items() for p in phrases}
        for i in range(len(states)):
            assert a.count[i] == len(by[phrase(i, a.longest[i])])
            short = phrase(i, a.shortest[i])
            assert (a.link[i] == -1) == (len(short) == 1)
            if len(short) > 1:
                assert short[1:] in states[a.link[i]]


@pytest.mark.parametrize("prune", [True, False])
def test_collocations(spark, edge, nothing, prune, monkeypatch):  # noqa: F811
    rng = random.Random(3)
    vocabulary = ["a", "B", "b", "ça", "dé", "x.y", "q q", "n\x1c", "longer" * 30]
    rows = [(" ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", "\n", "\t"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", None, "und", "fr"])) for _ in range(120)]
    rows += [(None, "en"), ("", None), ("a a a a a a a a", "fr"), ("one two three four five six " * 300, "de"), ("..!?", "de"), ("x " * 2000 + "y", "en")]
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "'w' AS words", "'p' AS phrase", "1 AS n")
    # Shards, slices and a table so small that texts go over them and much shares its bits.
    for name, value in {"SHARD_WORDS": 50, "SLICE_BYTES": 64, "TABLE_BITS": 8, "BLOCK_BITS": 5}.items():
        monkeypatch.setattr(collocations, name, value)
    n, f = brute_counts(rows, 4)
    got = collocations.phrase_counts(df, 4, 20, prune).collect()
    assert {(r.lang, r.phrase): r.n for r in got if r.words} == {k: c for k, c in f.items() if c >= 20}
    assert {r.lang: r.n for r in got if not r.words} == {k: c for k, c in n.items() if c}
    for most, percent in ((2000, 100), (3, 60)):
        assert values(collocations.collocations(df, 5, 20, most, percent, prune)) == brute_phrases(rows, 5, 20, most, percent)
    assert collocations.collocations(nothing).count() == 0
    assert collocations.collocations(edge).filter("lang = 'lang'").count() > 0


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(F.lit(3 * 10**12).alias("a"), F.lit(10**13).alias("total"), F.lit(4 * 10**12).alias("l"), F.lit(5 * 10**12).alias("r"))
    big = lambda c: f"CAST({c} AS DECIMAL(18, 0))"
    got = row.selectExpr(f"(CAST(1000 AS DECIMAL(4, 0)) * {big('a')} * {big('total')}) div ({big('l')} * {big('r')}) AS s").first().s
    assert got == 1000 * 3 * 10**25 // (20 * 10**24)


# Filter audit


def brute_audit(docs, labels):
    good, toxic = Counter(), Counter()
    for i, q, t in labels:
        if i is not None:
            good[i] |= q == 1
            toxic[i] |= t == 1
    smallest = {}
    for i, text, _ in docs:
        if i is not None:
            smallest[text or ""] = min(smallest.get(text or "", i), i)
    fails = defaultdict(list)
    for i, text, source in docs:
        text = text or ""
        ws = re.findall("[^\x20\x09-\x0d]+", text)
        bits = [len(ws) < 50, 100 * len(set(ws)) < 65 * len(ws), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)), i is not None and i > smallest[text]]
        fails[source or ""].append(({f for f, b in zip("ABCDE", bits, strict=True) if b}, good[i] if i is not None else 0, toxic[i] if i is not None else 0))
    out, removed = [], Counter()
    for part, rows in fails.items():
        for order in itertools.permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order):
                here = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                removed[part, f] += len(here)
                out.append([part, "".join(order), k + 1, len(left), len(here), sum(f in r[0] for r in rows) - len(here), sum(r[0] == {f} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here), f])
    return sorted([(*r[:9], removed[r[0], r[9]]) for r in out], key=repr)


def test_audit(spark, edge, nothing):  # noqa: F811
    many = " ".join(f"w{i}" for i in range(60))
    docs = [(r.doc_id, r.text, r.source) for r in edge.collect()]
    docs += [(i, t, s) for i, (t, s) in enumerate(itertools.product([many, many + " #", "AB " * 60, many.upper(), "a b " * 40, "short", None, ""], ["p", "q", None, "", "p"]), 100)]
    docs += [(500, many, "p"), (500, many, "p"), (501, many, "p"), (None, many, "r"), (3, many, "z"), (3, "other", "z")]
    labels = [(i, i % 2, i % 3 // 2) for i in range(95, 140)] + [(100, 1, 0), (100, 0, 1), (500, 1, 1), (None, 1, 1), (101, None, None), (9999, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "'n' AS n", "'m' AS mask", "'p' AS part", "1 AS good", "2 AS first")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS text", "'y' AS digest")
    assert values(filter_audit.audit(df.repartition(3), marks)) == brute_audit(docs, labels)
    assert filter_audit.audit(nothing, marks).count() == 0
    assert values(filter_audit.audit(df, marks.limit(0))) == brute_audit(docs, [])
    cells = filter_audit.masks(df, marks).groupBy("part").count().collect()
    assert all(r["count"] <= 32 for r in cells)


@pytest.mark.parametrize("name", ["op11_warc", "op12_collocations", "op13_filter_audit"])
def test_queries_match_sql(spark, duck, name):
    from test_queries import same

    same(QUERIES[name](spark, TINY).toPandas(), duck.execute(ORACLE_SQL[name]).df())
