"""What is held at once is bounded: samples, batches of long texts, and scratch tables by run."""

import threading

import numpy as np
import pyarrow as pa

from trelliq.llm import common, exact_dedup, language, simhash


def test_sample_of_one_doc_id_on_many_rows(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(language.ByteCNN, "train", lambda self, x, y, rng: taken.append(len(y)))
    docs = spark.range(100_000).selectExpr("7L AS doc_id", "concat('some text ', id) AS text", "if(id % 50 = 0, 'b', 'a') AS lang")
    collected = []
    frame = type(docs)
    old = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: collected.append(out := old(self)) or out)
    net = language.fit(docs, per_language=100)
    copies = spark.range(50_000).selectExpr("id AS doc_id", "'one and the same' AS text", "'c' AS lang")
    assert language.fit(copies.withColumn("doc_id", copies.doc_id * 0), per_language=100).classes == ["c"]
    assert net.classes == ["a", "b"] and max(map(len, collected)) <= 200 and taken[0] <= 4 * 200


def test_batches_are_cut_by_bytes(monkeypatch):
    texts = ["a" * (1 << 20)] * 30 + ["b"] * 3000 + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array([1] * len(texts)), pa.array(range(len(texts)))], names=["doc_id", "text", *common.ROW_KEY])
    parts = list(common.slices(batch, "text", 8 << 20))
    assert sum(p.num_rows for p in parts) == len(texts) and max(p.column("text").nbytes for p in parts) < 10 << 20
    assert [p.num_rows for p in common.slices(batch, "text", 8 << 20, rows=100)].count(100) >= 29
    assert [p.num_rows for p in common.slices(batch, "text", 10)][:30] == [1] * 30
    held = []
    monkeypatch.setattr(simhash, "fingerprint", lambda t: held.append(len(t or "")) or 0)
    assert sum(b.num_rows for b in simhash._fingerprints(iter([batch]))) == len(texts) == len(held)
    found = list(exact_dedup._digests(32, True)(iter([batch])))
    assert sum(b.num_rows for b in found) == len(texts) and max(b.column("norm").nbytes for b in found) < 10 << 20


def test_runs_side_by_side_keep_their_tables(spark):
    mine, other = threading.Event(), threading.Event()
    seen = {}

    def run():
        with common.scratch_run():
            table = common.materialize(spark.range(5).toDF("a"), "mine")
            mine.set()
            other.wait(60)
            seen["mine"] = table.count()
            common.clear(spark)
            seen["left"] = common.made()

    thread = threading.Thread(target=run)
    thread.start()
    mine.wait(60)
    with common.scratch_run():
        table = common.materialize(spark.range(3).toDF("a"), "other")
        assert common.made() == 1
        common.clear(spark, keep=(table._trelliq_path,))
        other.set()
        thread.join()
        assert table.count() == 3 and seen == {"mine": 5, "left": 0}
        common.clear(spark)
        assert common.made() == 0


def test_network_against_a_plain_convolution():
    """The forward pass, byte by byte and filter by filter."""
    rng = np.random.default_rng(0)
    net = language.ByteCNN.fresh(["x", "y", "z"], rng)
    for text in ("Hallo, wie geht es dir heute?", "ça va"):
        row = language.windows(text)
        got = net.log_probabilities(row)
        for i in range(len(row)):
            assert np.allclose(np.exp(got[i]).sum(), 1)
            np.testing.assert_allclose(got[i], plain(net, row[i]), atol=1e-4)


def plain(net, window):
    p, hidden = net.params, []
    for w in language.WIDTHS:
        for f in range(p[f"k{w}"].shape[1]):
            best = -np.inf
            for at in range(len(window) - w + 1):
                total = p[f"b{w}"][f]
                for j in range(w):
                    for e in range(p["embed"].shape[1]):
                        total += p["embed"][window[at + j], e] * p[f"k{w}"][j * p["embed"].shape[1] + e, f]
                best = max(best, total)
            hidden.append(max(best, 0.0))
    z = [sum(h * p["out"][i, c] for i, h in enumerate(hidden)) + p["bias"][c] for c in range(len(net.classes))]
    return np.array(z) - np.log(np.exp(np.array(z) - max(z)).sum()) - max(z)


def test_deep_urls_take_no_more_rounds(spark, monkeypatch):
    """One url of 500 segments among short ones: as many tables are written as without it."""
    from trelliq.llm import urls

    def written(deep):
        rows = [(i, f"http://h.com/{'fr' if i % 2 else 'de'}/a{'bcdefgh'[i % 7]}/x{i % 5}y/z") for i in range(200)] + [(200, "http://h.com/trap/" + "/".join("abc"[i % 3] for i in range(deep)))]
        tables = []
        old = urls.materialize
        with monkeypatch.context() as m:
            m.setattr(urls, "materialize", lambda df, name: tables.append(name) or old(df, name))
            out = {r.page_id: r.template for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
        assert len(out) == 201 and out[200].count("/") == deep + 1
        return len(tables)

    assert written(500) <= written(6) + 1
