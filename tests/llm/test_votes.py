"""Hosts' votes decide what a page's text is: small pages, and a second implementation of vote, choice and boilerplate."""

import random
from collections import Counter
from html.parser import HTMLParser

from trelliq.llm import html_text


def words(n, w="word"):
    return " ".join([w] * n)


def texts(spark, pages):
    rows = [(i, f"http://{host}/{i}", page) for i, (host, page) in enumerate(pages)]
    return {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}


def test_what_stands_beside_the_article_goes():
    story = f"<p>{words(40)}</p>"
    only = lambda page: html_text.extract(page, [html_text.vote(page)])
    assert only(f'<body><div class="article">{story}</div><div class="rail"><p>Unique teaser of another story</p></div></body>') == words(40)
    assert only(f'<body><article>{story}</article><div class="discussion"><p>Bob says this is all wrong</p></div></body>') == words(40)
    assert only(f"<body><article><header><h1>Title</h1><p>standfirst</p></header>{story}</article></body>") == f"Title\nstandfirst\n{words(40)}"
    assert only(f"<body><h1>Title</h1><p>share this</p><article>{story}</article><p>Bob</p></body>") == f"Title\n{words(40)}"
    assert only(f"<body><div><p>lead</p><div>{story}</div><p>end</p></div></body>") == f"lead\n{words(40)}\nend"


def test_the_vote_changes_what_a_page_gives(spark):
    usual = lambda i: f'<body><div class="story"><p>{words(40, f"s{i}")}</p></div><div class="rail"><p>{words(3, f"r{i}")}</p></div></body>'
    odd = f'<body><div class="story"><p>short story</p></div><div class="rail"><p>{words(90, "teaser")}</p></div></body>'
    got = texts(spark, [("h.org", usual(i)) for i in range(11)] + [("h.org", odd), ("alone.org", odd)])
    assert all(got[i] == words(40, f"s{i}") for i in range(11))
    # Its own best container is the rail; the host's pages say where the story is. A page alone on its host has only itself.
    assert html_text.extract(odd, []) == got[12] == words(90, "teaser")
    assert got[11] == "short story"


class Tree(HTMLParser):
    """Well-formed pages of div, article and p, by the standard library's parser."""

    def __init__(self, page):
        super().__init__()
        self.root = self.here = {"tag": "", "path": "", "up": None, "children": [], "blocks": []}
        self.order, self.text = [], None
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "p":
            self.text = ""
            return
        name = dict(attrs).get("class")
        node = {"tag": tag, "path": f"{self.here['path']}/{tag}" + (f".{name}" if name else ""), "up": self.here, "children": [], "blocks": []}
        self.here["children"].append(node)
        self.here = node

    def handle_endtag(self, tag):
        if tag == "p":
            self.here["blocks"].append(self.text)
            self.order.append((self.here, self.text))
            self.text = None
        else:
            self.here = self.here["up"]

    def handle_data(self, data):
        if self.text is not None:
            self.text += data


def size(node):
    return sum(map(len, node["blocks"])) + sum(map(size, node["children"]))


def chain(node):
    return [] if node is None else [node, *chain(node["up"])]


def good(node):
    return node["tag"] == "article" or "content" in node["path"].rpartition("/")[2]


def best(tree):
    node = tree.root
    while not good(node):
        options = [c for c in node["children"] if size(c) and size(c) >= (0.4 if good(c) else 0.8) * size(tree.root)]
        if not options:
            break
        node = max(options, key=lambda c: (good(c), size(c)))
    return node


def inside(node, tops):
    return any(n is t for n in chain(node) for t in tops)


def brute(pages):
    """Texts of one host's pages."""
    trees = [Tree(p) for p in pages]
    bests = [best(t) for t in trees]
    votes = Counter(b["path"] for b in bests)
    won = [p for p, n in sorted(votes.items(), key=lambda x: (-x[1], x[0])) if n >= 0.1 * len(pages) and p]
    main = ["\n".join(t for n, t in tree.order if inside(n, [b])) for tree, b in zip(trees, bests, strict=True)]
    stands = {}
    for tree, b, m in zip(trees, bests, main, strict=True):
        for n, t in tree.order:
            if t and not (good(b) and inside(n, [b])):
                stands.setdefault((n["path"], t), set()).add(m)
    common = {k for k, v in stands.items() if len(v) > 1 and 2 * len(v) >= len(set(main))}
    out = []
    for tree, b in zip(trees, bests, strict=True):
        nodes = []
        todo = [tree.root]
        while todo:
            nodes.append(todo.pop())
            todo += nodes[-1]["children"]
        has_text = lambda ns: any(inside(n, ns) for n, t in tree.order if t)  # noqa: B023, E731
        tops = [n for n in nodes if n["path"] in won and inside(n, [b])]
        if not has_text(tops):
            above = next((n for n in chain(b)[1:] if n["path"] in won), None)
            tops = [above or b]
            if above is None:
                tops = next((ns for p in won if has_text(ns := [n for n in nodes if n["path"] == p])), tops)
        tops = [n for n in tops if not inside(n["up"], tops)]
        holds = [h for n in tops for h in chain(n["up"])]
        marked = any(n["tag"] == "article" for n in tops)
        also = [n for n in nodes if n["path"] in won and not any(n is h for h in holds) and not inside(n, [b])]
        keep = lambda n, t: inside(n, tops + also) or any(n is h for h in holds) and not marked and (n["path"], t) not in common  # noqa: B023, E731
        out.append("\n".join(t for n, t in tree.order if t and keep(n, t)))
    return out


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        if depth < 3 and rng.random() < 0.5:
            tag = rng.choice(["div", "div", "div", "article"])
            name = rng.choice(["", ' class="a"', ' class="b"', ' class="content"'])
            out.append(f"<{tag}{name}>{random_page(rng, depth + 1)}</{tag}>")
        else:
            out.append(f"<p>{rng.choice(['same everywhere', words(rng.randint(1, 30), f'w{rng.randint(0, 50)}')])}</p>")
    return "".join(out)


def test_against_a_second_implementation(spark):
    rng = random.Random(11)
    hosts = {f"h{i}.org": [random_page(rng) for _ in range(rng.randint(1, 14))] for i in range(60)}
    shared = [random_page(rng) for _ in range(4)]
    for i in range(60, 80):  # hosts with templates, so that paths win
        hosts[f"h{i}.org"] = [rng.choice(shared).replace("w1", f"v{j}") for j in range(12)]
    pages = [(h, p) for h, ps in hosts.items() for p in ps]
    got, at, changed = texts(spark, pages), 0, 0
    for host, ps in hosts.items():
        want = brute(ps)
        for i, p in enumerate(ps):
            assert got[at + i] == want[i], (host, p)
            changed += want[i] != html_text.extract(p, [])
        at += len(ps)
    assert changed > 50
