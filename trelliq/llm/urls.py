"""URL filter: longest-prefix rules, and a path-template tree per host for what the rules leave open.

The tree is built from the distinct path patterns of each host, counted before anything is joined, down from the host to where they part
and on. At each parting a segment whose labelled share of blocked pages differs significantly from its siblings' stays as it is. Others become the
wildcard ``*`` if they are variable (one of many siblings, and rare), or ``+`` if they have labels enough to show that they are
alike, so that similar branches merge; common segments with too few labels stay as they are. Each node's blocked share
is smoothed towards its parent's, the host's towards that of all labelled pages; a template whose smoothed share reaches
``purity`` is rejected if ``min_labels`` labelled pages bear it out, and, where it has ``*``, these are ``evidence_share`` of its
pages or more. DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with its path.
Rule = tuple[str, str, str]

RULES: tuple[Rule, ...] = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(url.isNull() | (at == 0), F.lit("")).otherwise(F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _pattern(path: Column, max_depth: int | None) -> Column:
    """The path's segments with long hexadecimal runs and numbers generalised; what lies deeper than max_depth, if given, is one segment."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    hexed = lambda s: F.regexp_replace(s, r"(?i)\b(?=[0-9a-f-]*[0-9])[0-9a-f]{8}[0-9a-f-]*\b", "{x}")
    general = lambda s: F.regexp_replace(hexed(s), "[0-9]+", "{n}")
    if max_depth is None:
        return F.transform(segments, general)
    deep = F.when(F.size(segments) > max_depth, F.array(F.lit("**"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.transform(F.slice(segments, 1, max_depth), general), deep)


def _common_prefix(a: Column, b: Column) -> Column:
    """How many elements two arrays begin with alike."""
    differ = F.filter(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda i: F.element_at(a, i) != F.element_at(b, i))
    return F.coalesce(F.array_min(differ) - 1, F.least(F.size(a), F.size(b)))


def _grown(active: DataFrame, fan_out: int, rare: float, z: float, min_labels: int, strength: float) -> DataFrame:
    """``active`` patterns a step further down: where a node's patterns part by one segment, and where they do not by all that they share.

    Sums are taken by node and segment, before anything is joined. A stretch that all patterns of a node share is always literal: there is one
    child, which is neither variable nor unlike its siblings.
    """
    counts = ("n", "labelled", "blocked")
    sums = [F.sum(c).alias(c) for c in counts]
    here = active.withColumn("seg", F.element_at("rest", 1))
    nodes = here.groupBy("host", "node", "seg").agg(*sums, F.min("rest").alias("low"), F.max("rest").alias("high"))
    above = nodes.groupBy("host", "node").agg(F.count(F.lit(1)).alias("fan"), *[F.sum(c).alias(f"all_{c}") for c in counts])
    rest_n, rest_b = F.col("all_labelled") - F.col("labelled"), F.col("all_blocked") - F.col("blocked")
    pooled = F.col("all_blocked") / F.col("all_labelled")
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / rest_n))
    few = F.col("labelled") < min_labels
    differs = F.when(few, False).when(rest_n == 0, True).otherwise(F.abs(F.col("blocked") / F.col("labelled") - rest_b / rest_n) > z * spread)
    variable = (F.col("fan") >= fan_out) & (F.col("n") < rare * F.col("all_n"))
    name = F.when(differs, F.col("seg")).when(variable, "*").when(few, F.col("seg")).otherwise("+")
    # Lexicographically the first and the last pattern of a set share what all of them share.
    steps = F.when(F.col("fan") == 1, _common_prefix(F.col("low"), F.col("high"))).otherwise(F.lit(1))
    named = nodes.join(above, ["host", "node"]).select("host", "node", "seg", name.alias("named"), steps.alias("steps"), *counts)
    merged = named.groupBy("host", "node", "named").agg(*[F.sum(c).alias(f"node_{c}") for c in counts])
    names = named.select("host", "node", "seg", "named", "steps").join(merged, ["host", "node", "named"])
    grown = here.join(names, ["host", "node", "seg"])
    taken = F.when(F.col("steps") == 1, F.col("named")).otherwise(F.array_join(F.slice("rest", F.lit(1), F.col("steps")), "/"))
    l, b, k = F.col("node_labelled").cast("double"), F.col("node_blocked").cast("double"), F.col("steps")
    # One step towards the node's own share is (b + strength * above) / (l + strength); this is k of them.
    once = (b + strength * F.col("share")) / (l + strength)
    share = F.when(k == 1, once).when(l == 0, F.col("share")).otherwise(b / l + (F.col("share") - b / l) * F.pow(strength / (l + strength), k))
    return grown.select(
        "host", "pattern", "n", "labelled", "blocked", F.slice("rest", k + 1, F.size("rest")).alias("rest"), F.concat("template", F.lit("/"), taken).alias("template"),
        F.xxhash64("node", "named", taken).alias("node"), share.alias("share"), F.col("node_labelled").alias("evidence"), F.col("node_n").alias("pages"),
        (F.col("starred") | (F.col("named") == "*")).alias("starred"),
    )


def template_tree(
    labelled: DataFrame, fan_out: int = 16, rare: float = 0.05, z: float = 2.0, min_labels: int = 5, strength: float = 5.0, purity: float = 0.7, evidence_share: float = 0.2
) -> DataFrame:
    """(host, pattern) -> template, smoothed blocked share, rejected. ``labelled``: host, segments, label (blocked 1, allowed 0, null).

    One row per host and pattern, in however many rows it came; repeated rows count each. Rows without segments have the template
    ''. Without labels every share is 0 and nothing is rejected. An empty table gives an empty tree. Hosts and segments must not be null.

    Patterns leave the work when they are named to their end. A round takes every node's patterns on to where they part, so there are as many
    rounds as partings on one path, and a deep url that shares its end with no other takes none for it. Nodes have 64-bit hashes of what
    they are called within their host.
    """
    pattern = F.array_join("segments", "/")
    counts = labelled.groupBy("host", pattern.alias("pattern")).agg(
        F.first("segments").alias("segments"), F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked")
    )
    counts = materialize(counts, "url-patterns")
    whole = counts.agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b")).first()
    prior = float((whole.b or 0) / whole.l if whole.l else 0.0)
    hosts = counts.groupBy("host").agg(F.sum("n").alias("pages"), F.sum("labelled").alias("evidence"), F.sum("blocked").alias("all_blocked"))
    root = counts.join(hosts, "host").select(
        "host", "pattern", "n", "labelled", "blocked", F.col("segments").alias("rest"), F.lit("").alias("template"), F.lit(0).cast("long").alias("node"),
        ((F.col("all_blocked") + strength * prior) / (F.col("evidence") + strength)).alias("share"), "evidence", "pages", F.lit(False).alias("starred"),
    )
    tables = [materialize(root, "url-levels")]
    while (tables[-1].agg(F.max(F.size("rest"))).first()[0] or 0) > 0:
        tables.append(materialize(_grown(tables[-1].filter(F.size("rest") > 0), fan_out, rare, z, min_labels, strength), "url-levels"))
    done = [t.filter(F.size("rest") == 0).select("host", "pattern", "template", "share", "evidence", "pages", "starred") for t in tables]
    tree = materialize(reduce(DataFrame.union, done), "url-tree")
    for t in (counts, *tables):
        discard(t)
    borne = ~F.col("starred") | (F.col("evidence") >= evidence_share * F.col("pages"))
    rejected = (F.col("share") >= purity) & (F.col("evidence") >= min_labels) & borne
    return tree.select("host", "pattern", "template", F.col("share").alias("blocked_share"), rejected.alias("rejected"))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, labels: DataFrame | None = None, max_depth: int | None = None, **tree_options) -> DataFrame:
    """A verdict for every row of ``pages`` (page_id, url, ...): page_id, host, path, rule, verdict, template, blocked_share.

    The longest fitting rule decides; else the template tree, learned from the urls that a rule decides and, if given, from
    ``labels`` (page_id unique, blocked boolean), which come first. A null url or one without ``://`` has empty host and path and falls under
    the empty host's template. Without any label everything the rules leave open is allowed. Repeated rows each get a verdict.
    Null page_ids are passed on. An empty table gives an empty result. Other columns are neither read nor returned.
    """
    host, path = host_and_path(F.col("url"))
    cut = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    cut = cut.withColumns({"by_rule": longest_rule(F.col("host"), F.col("path"), rules), "segments": _pattern(F.col("path"), max_depth)})
    label = F.when(F.col("by_rule.verdict") == "block", 1).when(F.col("by_rule.verdict") == "allow", 0)
    seen = cut.select("page_id", "host", "segments", label.alias("label"))
    if labels is not None:
        given = labels.select("page_id", F.col("blocked").cast("int").alias("given"))
        seen = seen.join(given, "page_id", "left").withColumn("label", F.coalesce("given", "label"))
    tree = template_tree(seen.select("host", "segments", "label"), **tree_options)
    out = cut.withColumn("pattern", F.array_join("segments", "/")).join(tree, ["host", "pattern"], "left")
    verdict = F.coalesce(F.col("by_rule.verdict"), F.when(F.col("rejected"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("by_rule.rule").alias("rule"), verdict.alias("verdict"), "template", "blocked_share")
