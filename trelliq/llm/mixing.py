"""Mixing sources to target weights by entropy balancing.

The mix gives each document d a rate r_d, how often it is taken. Among all rates between 0 and ``limit`` whose tokens meet
every source's target, entropy balancing picks those closest (in relative entropy) to taking every document once. Their
form follows from the convex dual, which has one variable per source: r_d = min(limit, exp(lambda_s * size_d / scale_s)).
Each Newton iteration on the dual is one distributed aggregation over the table (source, size, documents of that size):
documents of equal source and size have equal rates, so they are counted before anything is shuffled. The rates are then
rounded into whole copies, largest documents first, each size passing on the tokens by which it missed.

The driver holds one number per source, as it does the sources' weights, and nothing per document.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ROW_KEY, discard, keyed, materialize

#: Documents of one source and size are ranked in buckets of about this many, so that no task ranks an unbounded group.
BUCKET = 1024


def word_count(text) -> F.Column:
    """Number of words of a text; null and blank texts have none."""
    trimmed = F.regexp_replace(text, r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    words = F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    return F.when(text.isNull() | (trimmed == ""), F.lit(0)).otherwise(words).cast("long")


def targets(sizes: dict, weights: dict, limit: float = 3.0) -> dict:
    """Targets that share the sum of all sizes by weight, none above ``limit`` times its source's size.

    What a source at its limit cannot take is shared among the others by weight, until none is above. Keys may be None.
    A source without tokens gets 0. Where every source is at its limit, the sum of the targets is what they can hold.
    """
    total, out, free = float(sum(sizes.values())), {}, {s for s in sizes if weights.get(s, 0) > 0 and sizes[s] > 0}
    out = {s: 0.0 for s in sizes}
    left = total
    while free:
        share = sum(weights[s] for s in free)
        above = {s for s in free if left * weights[s] / share > limit * sizes[s]}
        if not above:
            out |= {s: left * weights[s] / share for s in free}
            break
        for s in above:
            out[s] = limit * float(sizes[s])
            left -= out[s]
        free -= above
    return out


def solve_dual(cells: DataFrame, goal: dict, sizes: dict, limit: float = 3.0, iterations: int = 60, tolerance: float = 1e-9) -> dict:
    """The dual variable of each source, by Newton steps kept inside a shrinking bracket.

    ``cells`` has (source, size, n). Every iteration is one aggregation over it, which gives each source's tokens and their
    slope at the present variables. Sources whose target is 0 or all they can hold need none: -inf and inf.
    """
    spark = cells.sparkSession
    top = math.log(limit)
    fixed = {s: (-math.inf if goal[s] <= 0 else math.inf) for s in goal if goal[s] <= 0 or goal[s] >= limit * sizes[s] * (1 - 1e-12)}
    # rate = exp(lambda * size / sizes-weighted mean); bracket ends: at `high` even a document of one token is at the limit
    rows = cells.groupBy("source").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("scale")).collect()
    scale = {r.source: r.scale or 1.0 for r in rows}
    state = {s: 0.0 for s in goal if s not in fixed}
    low = {s: None for s in state}
    high = {s: top * scale[s] for s in state}
    step_down = {s: 1.0 for s in state}
    active = set(state)
    for _ in range(iterations):
        if not active:
            break
        table = spark.createDataFrame([(s, float(state[s]), float(scale[s])) for s in active], "key string, lam double, scale double")
        x = F.col("size") / F.col("scale")
        rate = F.exp(F.least(F.col("lam") * x, F.lit(top)))
        tokens = F.col("n") * F.col("size")
        found = (
            cells.join(table, F.col("source").eqNullSafe(F.col("key")))
            .groupBy("key")
            .agg(F.sum(tokens * rate).alias("have"), F.sum(F.when(F.col("lam") * x < top, tokens * rate * x).otherwise(0.0)).alias("slope"))
            .collect()
        )
        for s, have, slope in found:
            miss = goal[s] - have
            if abs(miss) <= tolerance * goal[s]:
                active.discard(s)
                continue
            at = state[s]
            if miss > 0:
                low[s] = at
            else:
                high[s] = at
            new = at + miss / slope if slope > 0 else math.inf
            if low[s] is None:
                # no lower bound yet: never below a doubling step
                new = max(new, at - step_down[s])
                step_down[s] *= 2
            elif not low[s] < new < high[s]:
                new = (low[s] + high[s]) / 2
            if new >= high[s]:
                new = ((low[s] if low[s] is not None else at) + high[s]) / 2
            if new == at:
                active.discard(s)
            state[s] = new
    # Rounded, so that the order in which a shuffle adds up cannot reach the copies.
    return fixed | {s: float(f"{v / scale[s]:.10e}") for s, v in state.items()}


def _copies(limit: float):
    cap = int(math.floor(limit))

    def of_source(cells: pd.DataFrame) -> pd.DataFrame:
        """Whole copies of each size, largest first; the tokens missed so far pass on to the next size."""
        cells = cells.sort_values("size", ascending=False)
        carry, total = 0.0, []
        for size, n, want in zip(cells["size"].tolist(), cells["n"].tolist(), cells["want"].tolist(), strict=True):
            if size == 0:
                total.append(0)
                continue
            c = min(cap * n, max(0, math.floor(want + carry / size + 0.5)))
            carry += (want - c) * size
            total.append(c)
        return pd.DataFrame({"source": cells["source"], "size": cells["size"], "n": cells["n"], "copies": total})

    return of_source


def mix(docs: DataFrame, weights: dict | None = None, cycle: tuple = (5, 2, 1), limit: float = 3.0) -> DataFrame:
    """How often to take each document, so that each source's tokens come near its share of all tokens.

    ``docs`` has doc_id, text, source. ``weights`` maps source to weight (absent: 0); without it the sources in order of
    code points, null last, weigh ``cycle``, repeating. Returns one row per row of ``docs``: doc_id, source, size (words),
    source_size, target (the source's), rate, copies, taken (copies * size) and the row's place.

    Null text has size 0. Null is a source of its own. Documents of size 0 are never taken and change nothing. Repeated
    rows count each for itself. No tokens at all, or an empty table: targets and copies are 0. Only these columns are read;
    others with any names are left alone. Ties between documents of equal source and size fall by a hash of doc_id, so
    reruns agree. A fractional ``limit`` bounds rates as given and copies by its whole part.
    """
    rows = keyed(docs.select("doc_id", "text", "source"), "mix-rows")
    narrow = materialize(rows.select("doc_id", *ROW_KEY, F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "mix-sizes")
    cells = materialize(narrow.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    found = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("tokens")).collect()
    sizes = {r.source: r.tokens for r in found}
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    if weights is None:
        weights = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    goal = targets(sizes, weights, limit)
    dual = solve_dual(cells.filter("size > 0"), goal, sizes, limit)

    spark = docs.sparkSession
    table = spark.createDataFrame([(s, sizes[s], goal[s], dual.get(s, 0.0)) for s in order], "key string, source_size long, target double, lam double")
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("lam") == math.inf, limit).when(F.col("lam") == -math.inf, 0.0).otherwise(F.exp(F.least(F.col("lam") * F.col("size"), F.lit(math.log(limit)))))
    rated = cells.join(table, F.col("source").eqNullSafe(F.col("key"))).withColumn("rate", rate).withColumn("want", F.col("n") * F.col("rate"))
    whole = rated.select("source", "size", "n", "want").groupBy("source").applyInPandas(_copies(limit), "source string, size long, n long, copies long")
    plan = materialize(
        rated.alias("r").join(whole.alias("w"), F.col("r.source").eqNullSafe(F.col("w.source")) & (F.col("r.size") == F.col("w.size")))
        .select("r.source", "r.size", "r.n", "source_size", "target", "rate", "copies"),
        "mix-plan",
    )
    discard(cells)

    # Which documents of a cell get one copy more: ranks within hash buckets, after each bucket's share of the remainder.
    hashed = F.xxhash64(F.lit("mix"), "doc_id")
    shared = narrow.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size")))
    dealt = shared.select(
        "d.doc_id", *[f"d.{c}" for c in ROW_KEY], "d.source", "d.size", "p.source_size", "p.target", "p.rate", "p.copies", "p.n",
        F.pmod(hashed, F.ceil(F.col("p.n") / BUCKET)).alias("bucket"), hashed.alias("h"),
    )
    counts = dealt.groupBy("source", "size", "n", "copies", "bucket").agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(Window.partitionBy("source", "size").orderBy("bucket"))
    share = lambda x: F.floor(x * F.col("rest") / F.col("n"))
    buckets = (
        counts.withColumn("upto", upto)
        .withColumn("rest", F.col("copies") % F.col("n"))
        .select(F.col("source").alias("bs"), F.col("size").alias("bz"), F.col("bucket").alias("bb"), (share(F.col("upto")) - share(F.col("upto") - F.col("m"))).alias("more"))
    )
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h", "doc_id", *ROW_KEY)))
    taken = ranked.join(buckets, F.col("source").eqNullSafe(F.col("bs")) & (F.col("size") == F.col("bz")) & (F.col("bucket") == F.col("bb")))
    copies = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("rank") <= F.col("more"), 1).otherwise(0)
    return taken.select(
        "doc_id", *ROW_KEY, "source", "size", "source_size", "target", "rate", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken")
    )


def take(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows of ``docs``: every document as often as the mix takes it, columns as they were.

    Null and blank texts are never taken. Rows with a null source or doc_id are taken like others, and repeated rows each for
    itself. An empty table, or one without words, gives no rows.
    """
    rows = keyed(docs, "mix-rows")
    plan = mix(rows.drop(*ROW_KEY), **options).filter("copies > 0").select(*ROW_KEY, F.col("copies").alias("__trelliq_copies"))
    many = rows.join(plan, ROW_KEY).withColumn("__trelliq_copy", F.explode(F.sequence(F.lit(1), F.col("__trelliq_copies").cast("int"))))
    return many.drop(*ROW_KEY, "__trelliq_copies", "__trelliq_copy")
