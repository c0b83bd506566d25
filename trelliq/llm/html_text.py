"""Main text of web pages by consensus of each host's pages.

First every page names the container that holds its text best, as a generalised path of tags and classes, and the text blocks that
might lie outside of it. Spark counts the votes for paths per host, and on how many different pages of the host a block stands.
Then every page is read again: the text comes from its containers on the paths that won its host, in page order, and only where it
has none of them from its own best container. What stands in other containers (teasers, discussions) is left out, whatever they are
called. Blocks that stand around the article, right in a container that holds it, belong to it unless most of their text is links,
they are in the page's header, or half of the host's pages have them; around an article or main element only headings do.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .urls import host_and_path

#: Winning paths are broadcast up to this many bytes, and joined by shuffle beyond it.
BROADCAST_BYTES = 8 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg|textarea|title)\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<[!?/a-zA-Z][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[a-z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br td th".split())
_CONTAINER = frozenset("html body main article section div td table center blockquote content".split())
_CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SELF_CLOSING = {"li": frozenset(["li"]), "p": frozenset(["p"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"])}
#: What an implied end tag never reaches beyond.
_SCOPE = frozenset("table ul ol dl div article section main body html td blockquote".split())

#: Elements, roles and words of class and id that mark what is not the article.
_DROP_TAGS = frozenset("head nav footer aside form menu dialog button select input object canvas audio video map".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar form".split())
_DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation "
    "newsletter notice notices notification overlay pager pagination popup promo promotion recommended related reply replies respond share sharing sidebar signup skyscraper social sponsor sponsored "
    "subscribe subscription toolbar widget widgets".split()
)
#: Words that say place or form only: a name of drop words and these marks its element, a name with others (share-price) does not.
_FORM_WORDS = frozenset(
    "area bar block bottom box btn button buttons col column container content desktop fixed form global group header icon icons inner item items js large left link links list main message mobile "
    "module outer page panel policy post posts primary region right row secondary section site slot small sticky text the this title top unit wrap wrapper".split()
)
_KEEP_WORDS = frozenset("article body content entry main post story text".split())
_NEVER_BY_NAME = frozenset("html body article main".split())

#: A longer path is continued from its hash, so that deep nesting takes no more room.
_LONG_PATH = 512


class _Node:
    __slots__ = ("tag", "parent", "up", "path", "drop", "good", "own", "total", "children", "header", "heading", "within")

    def __init__(self, tag, parent, up, path, drop, good, header, heading, within):
        self.tag, self.parent, self.up, self.path, self.drop, self.good, self.header, self.heading, self.within = tag, parent, up, path, drop, good, header, heading, within
        self.own, self.total, self.children = 0, 0, []


def _unwanted(name: str) -> bool:
    words = _PART.findall(name)
    return not _DROP_WORDS.isdisjoint(words) and all(w in _DROP_WORDS or w in _FORM_WORDS for w in words)


def _element(tag: str, attrs: str, parent: _Node, holder: _Node) -> _Node:
    names: list[str] = []
    drop, good, label = tag in _DROP_TAGS, tag in ("article", "main"), tag
    if attrs:
        for name, *values in _ATTR.findall(attrs):
            name, value = name.lower(), next((v for v in values if v), "")
            if name == "class":
                label = ".".join([tag, *sorted(re.sub(r"\d+", "0", c) for c in value.lower().split())])
            if name in ("class", "id"):
                names += value.lower().split()
            elif name == "role":
                drop = drop or value.lower() in _DROP_ROLES
                good = good or value.lower() == "main"
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                drop = True
    # A header inside an article is the article's own.
    within = parent.tag in ("article", "main") or parent.within
    header = parent.header or tag == "header" and not within
    if names and tag not in ("html", "body"):
        words = {w for n in names for w in _PART.findall(n)}
        drop = drop or tag not in _NEVER_BY_NAME and any(map(_unwanted, names))
        good = good or not _KEEP_WORDS.isdisjoint(words)
        header = header or "header" in words and tag not in _NEVER_BY_NAME and not within
    path = parent.path
    if tag in _CONTAINER:
        path = f"{path if len(path) <= _LONG_PATH else xxhash.xxh64_hexdigest(path)}/{label}"
    return _Node(tag, parent, holder, path, parent.drop or drop, good, header, tag in _HEADINGS or tag in _INLINE and parent.heading, within)


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class _Block:
    holder: _Node  # the container that it stands in
    text: str
    linked: int  # characters inside links
    header: bool  # in the page's header
    heading: bool

    @property
    def plain(self) -> bool:
        return 2 * self.linked <= len(self.text)

    def digest(self) -> int:
        return xxhash.xxh64_intdigest(f"{self.holder.path}\n{self.text}".encode("utf-8", "replace")) - (1 << 63)


def parse(page: str) -> tuple[_Node, list[_Node], list[_Block]]:
    """The tree's root, its containers, parents before children, and the blocks of visible text. Linear in the page's size."""
    root = _Node("", None, None, "", False, False, False, False, False)
    here, holder = root, root
    containers, blocks = [root], []
    parts: list[str] = []
    linked = links = 0
    headed = titled = False
    open_tags: Counter = Counter()

    def close_block() -> None:
        nonlocal linked, headed, titled
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append(_Block(holder, text, linked, headed, titled))
            parts.clear()
        linked, headed, titled = 0, False, False

    def pop_to(node: _Node) -> None:
        nonlocal here, holder, links
        while here is not node:
            if here.tag == "a":
                links = max(0, links - 1)
            open_tags[here.tag] -= 1
            here = here.parent
        holder = here if here.parent is None or here.tag in _CONTAINER else here.up

    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            if not here.drop and (here.heading or not here.header):
                parts.append(text)
                if links:
                    linked += len(text)
                headed, titled = headed or here.header, titled or here.heading
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if not open_tags[tag]:
                continue
            node = here
            while node.tag != tag:
                node = node.parent
            if tag not in _INLINE:
                close_block()
            elif tag in ("td", "th"):
                parts.append(" ")
            pop_to(node.parent)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in _INLINE:
            close_block()
        elif tag in ("td", "th"):
            parts.append(" ")
        if tag in _VOID:
            continue
        ends = _SELF_CLOSING.get(tag, frozenset())
        if tag in _CLOSES_P:
            ends = ends | {"p"}
        if any(open_tags[e] for e in ends):
            node, found = here, None
            while node.parent is not None and (node.tag not in _SCOPE or node.tag in ends):
                if node.tag in ends:
                    found = node
                node = node.parent
            if found is not None:
                pop_to(found.parent)
        here = _element(tag, m["attrs"] or "", here, holder)
        open_tags[tag] += 1
        if tag == "a":
            links += 1
        if tag in _CONTAINER:
            holder.children.append(here)
            containers.append(here)
            holder = here
    close_block()
    return root, containers, blocks


def _totals(node: _Node) -> int:
    order, stack = [], [node]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += n.children
    for n in reversed(order):
        n.total = n.own + sum(c.total for c in n.children if not c.drop)
    return node.total


def best_container(root: _Node, blocks: list[_Block], share: float = 0.8, good_share: float = 0.4) -> _Node:
    """The highest container that is marked as content, or else the smallest, with most of the page's unlinked text.

    One that is marked as content needs a smaller share, and nothing inside it is left out. Shares are of the whole page, so they do
    not multiply on the way down; a quotation is never a page's container.
    """
    for b in blocks:
        if b.plain:
            b.holder.own += len(b.text)
    whole = _totals(root)
    node = root
    while not node.good:
        options = [c for c in node.children if not c.drop and c.tag != "blockquote" and c.total and c.total >= (good_share if c.good else share) * whole]
        if not options:
            break
        node = max(options, key=lambda c: (c.good, c.total))
    return node


def _inside(containers: list[_Node], test) -> set[int]:
    """Ids of the containers that pass a test or lie in one that does; parents come before children."""
    out: set[int] = set()
    for n in containers:
        if test(n) or n.up is not None and id(n.up) in out:
            out.add(id(n))
    return out


def scan(page: str | None) -> tuple[str, int, set[int]]:
    """The page's vote, a digest of its main text, and digests of blocks that might be boilerplate."""
    root, containers, blocks = parse(page or "")
    best = best_container(root, blocks)
    inside = _inside(containers, lambda n: n is best)
    main = xxhash.xxh64()
    for b in blocks:
        if id(b.holder) in inside:
            main.update(b.text.encode("utf-8", "replace") + b"\n")
    # What is inside a container that is marked as content is never left out.
    loose = {b.digest() for b in blocks if b.plain and not b.header and not (best.good and id(b.holder) in inside)}
    return best.path, main.intdigest() - (1 << 63), loose


def vote(page: str | None) -> str:
    return scan(page)[0]


def extract(page: str | None, paths: list[str], boilerplate: frozenset[int] = frozenset()) -> str:
    """Text of the page's containers on ``paths`` inside its own best container, in page order.

    Without any such container there, the nearest container around its best one that is on a path; else those on the first of
    ``paths`` that has text; else its own best container. Containers on ``paths`` elsewhere on the page come along unless they hold
    these; and so do blocks that stand right in a container that holds these, if they are no boilerplate, or if the text comes from an
    article or main element only headings.
    """
    root, containers, blocks = parse(page or "")
    if not blocks:
        return ""
    best, won = best_container(root, blocks), frozenset(paths)
    in_best = _inside(containers, lambda n: n is best)
    found = _inside(containers, lambda n: id(n) in in_best and n.path in won)
    if not any(id(b.holder) in found for b in blocks):
        around = best.up
        while around is not None and around.path not in won:
            around = around.up
        found = _inside(containers, lambda n: n is around) if around is not None else in_best
        # A page whose best container is not where the host has its text: the first path that has some.
        for path in paths if around is None else ():
            there = _inside(containers, lambda n: n.path == path)  # noqa: B023
            if any(id(b.holder) in there for b in blocks):
                found = there
                break
    tops = [n for n in containers if id(n) in found and (n.up is None or id(n.up) not in found)]
    holds, marked = _around(tops), any(n.tag in ("article", "main") for n in tops)
    found |= _inside(containers, lambda n: n.path in won and id(n) not in holds and id(n) not in in_best)
    belongs = lambda b: id(b.holder) in holds and (b.heading or not marked) and b.plain and not b.header and b.digest() not in boilerplate
    return "\n".join(b.text for b in blocks if id(b.holder) in found or belongs(b))


def _around(nodes: list[_Node]) -> set[int]:
    """Ids of the containers that hold one of ``nodes``."""
    out: set[int] = set()
    for n in nodes:
        n = n.up
        while n is not None and id(n) not in out:
            out.add(id(n))
            n = n.up
    return out


def _scans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths, mains, blocks = [], [], [], []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            path, main, loose = scan(page.as_py())
            # The vote's row has a path, the others a block.
            hosts += [host] * (1 + len(loose))
            paths += [path] + [None] * len(loose)
            mains += [main] * (1 + len(loose))
            blocks += [None, *loose]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(mains, pa.int64()), pa.array(blocks, pa.int64())], names=["host", "path", "main", "block"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = zip(batch.column("html"), batch.column("paths").to_pylist(), batch.column("boilerplate").to_pylist(), strict=True)
        texts = [extract(t.as_py(), p or [], frozenset(b or ())) for t, p, b in lists]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, least_share: float = 0.1) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html, ...).

    A path wins a host with ``least_share`` of its pages' votes or more (so a host has at most 1/least_share of them), the most votes
    first, ties in order of the path. A block is boilerplate of a host if it stands, on the same path, on two or more and on at
    least half of the host's pages of different main text; so a host has at most twice as many as a page has blocks on average,
    and copies of one page make nothing boilerplate. Null or empty html gives empty text. Null urls share the empty host. Pages are
    read whole; truncated markup is read as far as it goes. Repeated rows and null page_ids are passed on; an empty table gives an
    empty result. Other columns are neither read nor returned. Votes and blocks are counted before they are shuffled by host, so a
    host may have any share of the pages.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), "html")
    hosted = rows.withColumn("host", host_and_path(F.col("url"))[0])
    scanned = materialize(hosted.select("host", "html").mapInArrow(_scans, "host string, path string, main long, block long"), "html-scan")
    votes = scanned.filter("path is not null").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    counted = materialize(votes, "html-votes")
    totals = counted.groupBy("host").agg(F.sum("n").alias("all"))
    winners = counted.join(totals, "host").filter((F.col("n") >= least_share * F.col("all")) & (F.col("path") != ""))
    paths = winners.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "path"))).alias("w")).select("host", F.col("w.path").alias("paths"))
    mains = scanned.select("host", "main").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("mains"))
    spread = scanned.filter("block is not null").select("host", "block", "main").distinct().groupBy("host", "block").agg(F.count(F.lit(1)).alias("n"))
    common = spread.filter("n > 1").join(mains, "host").filter("2 * n >= mains").groupBy("host").agg(F.sort_array(F.collect_list("block")).alias("boilerplate"))
    lists = materialize(paths.join(common, "host", "full_outer"), "html-lists")
    for done in (counted, scanned):
        discard(done)
    size = lists.agg(F.sum(F.length("host") + F.length(F.array_join(F.coalesce("paths", F.array()), "")) + 8 * F.size(F.coalesce("boilerplate", F.array())) + 32)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        lists = F.broadcast(lists)
    out = hosted.join(lists, "host", "left").select("page_id", "url", "html", "paths", "boilerplate")
    return out.mapInArrow(_texts, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
