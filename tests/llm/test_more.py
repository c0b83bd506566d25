"""Derived tables, long and hostile texts, hot groups and second implementations of the corpus operators."""

import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import TINY
from pyspark.sql import functions as F
from test_operators import EDGE, RANKS, WORD, brute_fingerprint, docs, edge, norm, nothing  # noqa: F401

from trelliq.llm import byte_bpe, common, exact_dedup, html_text, language, mixing, pii, quality, simhash, token_files, urls

tokenizers = pytest.importorskip("public_tokenizers")


# Row keys


@pytest.fixture(scope="module")
def derived(docs):  # noqa: F811
    twice = docs.limit(1).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    return {
        "explode": docs.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))),
        "join": docs.join(F.broadcast(twice)),
        "union": docs.unionByName(docs),
        "sample": docs.sample(0.5, seed=3),
        "random filter": docs.filter(F.rand() < 0.5),
        "filter": docs.filter("doc_id % 2 = 0").select("text", "doc_id", "source", "lang"),
    }


def test_what_counts_as_stored(derived):
    assert [n for n, t in derived.items() if common._is_stored(t)] == ["filter"]
    for t in (derived["union"], derived["sample"]):
        places = common.keyed(t).select(*common.ROW_KEY)
        assert places.distinct().count() == t.count()


@pytest.mark.parametrize("name", ["explode", "join", "filter"])
def test_derived_tables(derived, name):
    table = derived[name]
    rows = table.select("doc_id", "text").collect()
    found = exact_dedup.deduplicate(table).collect()
    texts = {norm(r.text) for r in rows}
    assert len(found) == len(rows) and sum(r.kept for r in found) == len(texts)
    assert exact_dedup.keep_first_rows(table).count() == len(texts)
    near = simhash.near_duplicates(table).collect()
    assert len(near) == len(rows) and simhash.keep_one_of_each(table).count() == sum(r.first for r in near) == len({r.component_id for r in near})
    plan = mixing.mix(table).collect()
    assert len(plan) == len(rows) and Counter(r.doc_id for r in mixing.take(table).collect()) == sum((Counter({r.doc_id: r.copies}) for r in plan), Counter())
    assert language.keep_known(table).count() == sum(bool(r.text) and language.has_letter(r.text) for r in rows)


def test_shared_folder(spark, monkeypatch):
    class Remote:
        conf, sparkContext = type("C", (), {"get": staticmethod(lambda k, d: None)}), type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        common.shared_dir(Remote)
    mark = common.made()
    table = common.materialize(spark.range(3).toDF("a"), "gone")
    assert table.count() == 3 and common.made() == mark + 1
    common.clear(spark, mark)
    assert common.made() == mark


# Tokens


def test_memory_is_bounded_by_bytes():
    m = common.Memory(lambda s: s.encode(), 100_000)
    for i in range(3000):
        assert m[f"w{i}"] == b"w%d" % i
    assert len(m) + len(m.old) <= 2 * 100_000 / 240
    long = "x" * 100_000
    assert m[long] == long.encode() and long not in m and long not in m.old


def test_texts_without_spaces():
    import tiktoken
    from tokenizers import Tokenizer

    r = random.Random(5)
    texts = ["".join(r.choice("漢字仮名交文章語句") for _ in range(350_000)), "".join(r.choice("0123456789abcdefABCDEF+/=") for _ in range(1_000_000))]
    path = tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        mine = token_files.ChunkEncoder(f.read())
    lib = Tokenizer.from_file(path)
    codec = byte_bpe.Codec(byte_bpe.read_ranks(RANKS), tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=codec.rank, special_tokens={})
    for t in texts:
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == other.encode_ordinary(t)
    for memory in (mine.memory, codec.memory):
        assert all(len(k) <= memory.longest for k in [*memory, *memory.old])


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_tokenizer_file(name):
    from tokenizers import Tokenizer

    with open(tokenizers.path(name), encoding="utf-8") as f:
        source = f.read()
    lib, mine, r = Tokenizer.from_str(source), token_files.ChunkEncoder(source), random.Random(6)
    assert mine.by_chunk == (name == "word_bpe_49k.json")
    chars = [chr(c) for c in (*range(9, 14), *range(28, 33), *range(33, 0x250), *range(0x300, 0x370), 0x85, 0xA0, 0x2028, 0x3000, 0x391, 0x3C2, 0x416, 0x5D0, 0x627, 0xE01, 0x1100, 0x4E00, 0x212B, 0xFB01, 0x1F600, 0x2160)] + ["²", "½", "km²", " the", "'s", "'S", "'ll", "<|endoftext|>"]
    texts = [None, "", *("".join(r.choice(chars) for _ in range(r.randint(0, 14))) for _ in range(20000))]
    flat, n = mine.encode_all(pa.array(texts))
    stops = np.cumsum(n)
    want = lib.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for t, stop, size, e in zip(texts, stops.tolist(), n.tolist(), want, strict=True):
        assert flat[stop - size : stop].tolist() == e.ids, t
    one = mine.encode_all(pa.array(texts).slice(100, 50))
    assert one[0].tolist() == flat[stops[99] : stops[149]].tolist()
    assert [len(x) for x in mine.encode_all(pa.array([], pa.string()))] == [0, 0]


def test_repair_goes_on_until_no_pair_pays():
    rng = np.random.default_rng(1)
    phrase = rng.integers(0, 40000, 300)
    ids = np.concatenate([np.concatenate([phrase, rng.integers(0, 40000, 20)]) for _ in range(200)]).astype(np.uint32)
    payload = token_files.compress(ids, np.full(200, 320), 49408)
    b = token_files.Block(payload)
    assert (b.ids() == ids).all() and len(payload) < 4 * len(ids) / 10 and int(b.expansion.max()) > 64
    inner = np.ones(len(b.symbols), bool)
    inner[np.cumsum(b.per_doc) - 1] = False
    pairs = Counter(zip(b.symbols[:-1][inner[:-1]].tolist(), b.symbols[1:][inner[:-1]].tolist(), strict=True))
    assert max(pairs.values()) < 12
    for i in (0, 57, 199):
        assert (b.document(i) == ids[i * 320 : (i + 1) * 320]).all() and [b.token(i, j) for j in (0, 100, 319)] == ids[[i * 320, i * 320 + 100, i * 320 + 319]].tolist()
    with pytest.raises(IndexError):
        b.token(0, 320)


# Near copies


def test_hot_blocks_are_cut(spark, monkeypatch):
    r = random.Random(8)
    base, fps = [r.getrandbits(64) for _ in range(6)], set()
    for b in base[:2]:  # many that share blocks
        fps |= {b ^ (r.getrandbits(16) << r.choice((0, 16, 32))) for _ in range(120)}
    for f in list(fps)[:60] + base:
        fps |= {f, f ^ 1 << r.randrange(64), f ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) ^ 1 << r.randrange(64)}
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    want = {f: f for f in fps}
    while True:
        new = {f: min(want[g] for g in fps if (f ^ g).bit_count() <= 3) for f in fps}
        if new == want:
            break
        want = new
    from trelliq.llm.graph import components

    for hot in (1 << 20, 5):
        tables, large = simhash._blocks(spark.createDataFrame(signed, "fp long"), hot)
        assert (large.count() > 0) == (hot == 5) and {x.grid >= 4 for x in tables.select("grid").distinct().collect()} == ({False, True} if hot == 5 else {False})
        links = tables.repartition(3, "grid", F.shiftrightunsigned("key", 48)).sortWithinPartitions("grid", "key")
        found = components(links.mapInArrow(simhash._links(3, 7), "u long, v long")).collect()
        root = {f: f for f in fps}
        groups = defaultdict(list)
        for x in found:
            groups[x.root].append(x.node % 2**64)
        for g in groups.values():
            root |= dict.fromkeys(g, min(g))
        assert root == want


# Mixing


def test_mixing_against_bisection(docs):  # noqa: F811
    plan = mixing.mix(docs).collect()
    by = defaultdict(list)
    for r in plan:
        by[r.source].append(r)
    for rows in by.values():
        sizes, goal = Counter(r.size for r in rows), rows[0].target
        total = sum(s * n for s, n in sizes.items())
        rate = lambda s, lam: min(3.0, math.exp(min(lam * s, 5.0)))
        low, high = -10.0, 10.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(n * s * rate(s, mid) for s, n in sizes.items()) < goal else (low, mid)
        full = goal >= 3 * total * (1 - 1e-12)
        carry, copies = 0.0, {}
        for s in sorted(sizes, reverse=True):
            each = 0.0 if s == 0 else 3.0 if full else rate(s, low)
            assert all(r.rate == pytest.approx(each, rel=1e-6, abs=1e-9) for r in rows if r.size == s)
            if s:
                want = sizes[s] * each
                copies[s] = min(3 * sizes[s], max(0, math.floor(want + carry / s + 0.5)))
                carry += (want - copies[s]) * s
        got = Counter()
        for r in rows:
            got[r.size] += r.copies
            assert r.size == 0 or r.copies in (copies[r.size] // sizes[r.size], copies[r.size] // sizes[r.size] + 1)
        assert all(abs(got[s] - copies[s]) <= 1 for s in copies) and got[0] == 0


# Urls


def brute_tree(rows, fan_out=16, rare=0.05, z=2.0, least=5, strength=5.0, purity=0.7, share=0.2):
    """Template and rejection of each (host, segments, label), by walking down each host's tree."""
    rows = [(h, tuple(s), y) for h, s, y in rows]
    labels = [y for *_, y in rows if y is not None]
    prior = sum(labels) / len(labels) if labels else 0.0
    known = lambda group: [y for *_, y in group if y is not None]
    template = {(h, s): ("",) for h, s, _ in rows}
    for depth in range(max((len(s) for _, s, _ in rows), default=0)):
        nodes = defaultdict(lambda: defaultdict(list))
        for h, s, y in rows:
            if len(s) > depth:
                nodes[h, template[h, s]][s[depth]].append((h, s, y))
        named = {}
        for at, kids in nodes.items():
            everything = [r for g in kids.values() for r in g]
            for seg, group in kids.items():
                y, every = known(group), known(everything)
                rest = len(every) - len(y)
                pooled = sum(every) / len(every) if every else 0
                if len(y) < least:
                    differs = False
                elif rest == 0:
                    differs = True
                else:
                    spread = math.sqrt(pooled * (1 - pooled) * (1 / len(y) + 1 / rest))
                    differs = abs(sum(y) / len(y) - (sum(every) - sum(y)) / rest) > z * spread
                variable = len(kids) >= fan_out and len(group) < rare * len(everything)
                named[at, seg] = seg if differs else "*" if variable else seg if len(y) < least else "+"
        template |= {(h, s): (*t, f"{t[-1]}/{named[(h, t), s[depth]]}") for (h, s), t in template.items() if len(s) > depth}
    out = {}
    for (h, s), t in template.items():
        blocked = prior
        for node in t:
            y = known([r for r in rows if r[0] == h and node in template[h, r[1]]])
            blocked = (sum(y) + strength * blocked) / (len(y) + strength)
        here = [r for r in rows if r[0] == h and t[-1] in template[h, r[1]]]
        n = len(known(here))
        out[h, "/".join(s)] = (t[-1], blocked, blocked >= purity and n >= least and ("/*/" not in t[-1] + "/" or n >= share * len(here)))
    return out


def test_url_tree_against_brute_force(spark):
    r = random.Random(4)
    rows = []
    for h in range(4):
        bad = set(r.sample("abcdefghijklmnopqrstuvwxyz", 8))
        for _ in range(250):
            s = [r.choice("abcdefghijklmnopqrstuvwxyz"[: r.choice((3, 26))]) for _ in range(r.randint(0, 5))]
            rows.append((f"h{h}", s, None if r.random() < 0.4 else int(bool(bad & set(s[:2])) ^ (r.random() < 0.1))))
    got = {(x.host, x.pattern): x for x in urls.template_tree(spark.createDataFrame(rows, "host string, segments array<string>, label int")).collect()}
    want = brute_tree(rows)
    assert got.keys() == want.keys() and any(w[2] for w in want.values()) and any("*" in w[0] for w in want.values()) and any("+" in w[0] for w in want.values())
    for k, (template, share, rejected) in want.items():
        assert (got[k].template, got[k].rejected) == (template, rejected) and got[k].blocked_share == pytest.approx(share)


def test_url_odd_rows(spark):
    long = "http://h.com/fr/" + "a" * 100_000 + "/" + "/".join("bcd" * 20)
    rows = [(None, "http://h.com/de/1"), (1, "http://h.com/de/1"), (1, "http://h.com/de/1"), (2, None), (2, None), (3, long), (4, "://"), (5, "http:///x")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert Counter((r.page_id, r.verdict, r.rule) for r in got) == Counter({(None, "block", "com/de/"): 1, (1, "block", "com/de/"): 2, (2, "allow", None): 2, (3, "allow", "com/fr/"): 1, (4, "allow", None): 1, (5, "allow", None): 1})
    empty = spark.createDataFrame([], "host string, segments array<string>, label int")
    assert urls.template_tree(empty).count() == 0


# Html


def words(n):
    return "word " * n


def test_html_loses_nothing_by_names_and_shares():
    page = '<html><body><article class="post-12 post type-post category-social has-sidebar"><h1>T</h1><section class="share-price"><p>at 12</p></section><div class="share-buttons">tell</div></article></body></html>'
    assert html_text.extract(page, []) == "T\nat 12"
    assert html_text.extract('<body><main id="comments"><p>about comments</p></main><div class="site-footer">foot</div>', []) == "about comments"
    page = f'<html><body><div id="w"><h1>Title</h1><p>intro</p><div class="content"><p>{words(60)}</p></div><p>closing</p><ul><li><a href="/a">More things</a></ul></div></body></html>'
    assert html_text.extract(page, [html_text.vote(page)]).split("\n") == ["Title", "intro", words(60).strip(), "closing"]
    page = f'<html><body><div class="lead"><p>first</p></div><div class="text"><p>{words(60)}</p></div></body></html>'
    assert html_text.extract(page, ["/html/body/div.text", "/html/body/div.lead"]).startswith("first\n")


def test_html_boilerplate_by_repetition(spark):
    page = lambda i: f'<html><body><div class="w"><p>Every page says this.</p><p>intro {i}</p><div class="x"><p>{words(40)}{i}</p></div></div></body></html>'
    rows = [(i, f"http://h.org/{i}", page(i)) for i in range(6)] + [(None, "http://h.org/0", page(0))] * 3 + [(50 + i, "http://copies.org/1", page(9)) for i in range(5)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and sum(r.page_id is None for r in got) == 3
    for r in got:
        lines = r.text.split("\n")
        if r.url.startswith("http://copies"):  # copies of one page make nothing boilerplate
            assert lines == ["Every page says this.", "intro 9", f"{words(40)}9"]
        else:
            assert lines == [f"intro {lines[-1].split()[-1]}", lines[-1]] and lines[-1].startswith("word")


def test_html_is_linear_on_hostile_pages():
    took = {}
    for n in (10_000, 100_000):
        pages = ["<div>" * n + "".join(f"<p>para {i}" for i in range(n)), "<b>" * n + "x</i>" * n, "".join(f'<div class="c{i}"><p>t {i}</div>' for i in range(n))]
        began = time.perf_counter()
        found = [html_text.extract(p, [html_text.vote(p)]) for p in pages]
        took[n] = time.perf_counter() - began
        assert found[0].count("\n") == n - 1 and found[1] == "x" * n and found[2].count("\n") == n - 1
    assert took[100_000] < 40 * took[10_000]


# Personal data


def test_pii_goes_back_on_random_values():
    f, r = pii.Feistel(b"0123456789abcdef"), random.Random(2)
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))

    def card():
        body = "4" + pick("0123456789", 14)
        return body + pii.luhn_digit(body)

    def values():
        d, m, y = r.randint(1, 28), r.randint(1, 12), r.randint(1900, 2099)
        yield from (("date", t) for t in (f"{d:02d}/{m:02d}/{y}", f"{d}/{m}/{y}", f"{m}/{d}/{y}", f"{d:02d}.{m}.{y}", f"{y}-{m:02d}-{d:02d}", f"{y}/{m}/{d}", "3/4/2020"))
        yield "ip", ".".join(str(r.randint(0, 255)) for _ in range(4))
        yield "ip", ".".join(f"{r.randint(0, 255):0{r.randint(1, 3)}d}" for _ in range(4))
        yield "ip", ":".join(f"{r.randint(0, 65535):x}" for _ in range(8))
        yield "ip", f"2001:DB8::{r.randint(0, 65535):X}"
        yield "card", card()
        yield "phone", f"+1 ({pick('0123456789', 3)}) 555-{pick('0123456789', 4)}"
        yield "ssn", f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"
        yield "email", f"{pick('abcXYZ019', 6)}.{pick('abc', 3)}@{pick('abc0', 5)}x.example.com"
        for chars in ("0123456789abcdef", "0123456789ABCDEF", "0123456789abcdefABCDEF", "0123456789", "z0123456789", "abcdefgh"):
            yield "secret", f"token={pick(chars, r.choice((16, 40, 300)))}"

    same = 0
    for _ in range(300):
        for kind, text in values():
            new, found = pii.pseudonymise(f"a {text}, b", f.forward)
            assert found == Counter({kind: 1}) and len(new) == len(text) + 5 or kind == "ip" and found == Counter(ip=1), (text, new)
            assert pii.pseudonymise(new, f.backward)[0] == f"a {text}, b"
            same += new == f"a {text}, b"
    assert same <= 12
    for t in ("std::vector", "a::b", "abc::def", "12:30:45", "00:1A:2B:3C:4D:5E", "10:20", "1:2:3:4:5:6:7:8:9"):
        assert pii.pseudonymise(t, f.forward)[0] == t


# Whole table, odd rows


def test_odd_rows_everywhere(spark, edge, nothing):  # noqa: F811
    import corpus_pipeline

    for table in (edge, nothing):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, TINY)
            now = common.materialize(now, f"odd-{name}")
            if name != "encoding":
                assert now.columns == table.columns
        if table is nothing:
            assert now.count() == 0
        else:
            assert now.count() > 0 and now.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    kept = quality.decide(quality.ledger(edge)).collect()
    assert len(kept) == len(EDGE) and quality.ablations(quality.ledger(nothing)).count() == 0
    assert {brute_fingerprint(t) for _, t, _ in EDGE} and all(len(WORD.findall(t or "")) >= 0 for _, t, _ in EDGE)
