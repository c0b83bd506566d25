"""Language identification by a byte convolutional network.

A text is lower-cased, encoded and cut into windows of a fixed number of bytes, all of it. Each byte has an embedding; filters
of several widths slide over a window, each keeps its largest response, and a softmax layer reads these. A text's prediction
comes from the mean of its windows' log-probabilities. The network is trained in numpy on the driver, on a bounded sample of
labelled rows, and applied to batches of windows on the executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ROW_KEY, keyed, slices

WINDOW = 96
WIDTHS = (2, 3, 4)

#: ASCII other than letters says nothing about a language; all of it becomes a space.
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 or 65 <= b <= 90 else 32 for b in range(256))

_MAY_BE_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """The pattern also takes numerals such as ½ and Ⅷ."""
    return any(m[0].isalpha() for m in _MAY_BE_LETTER.finditer(text))


def windows(text: str, size: int = WINDOW) -> np.ndarray:
    """All of a text as rows of ``size`` bytes, the last filled up with spaces."""
    raw = text.lower().encode("utf-8", "replace").translate(_FOLD)
    n = max(1, -(-len(raw) // size))
    return np.frombuffer(raw.ljust(n * size), np.uint8).reshape(n, size)


@dataclass
class ByteCNN:
    """Embedding (256, e), a (width * e, f) filter bank and bias for each width, and an output layer."""

    classes: list[str]
    params: dict[str, np.ndarray]

    @staticmethod
    def fresh(classes: list[str], rng: np.random.Generator, embed: int = 6, filters: int = 12) -> ByteCNN:
        init = lambda *s: (rng.standard_normal(s) * np.sqrt(1.0 / s[0])).astype(np.float32)
        p = {"embed": (rng.standard_normal((256, embed)) * 0.5).astype(np.float32)}
        for w in WIDTHS:
            p[f"k{w}"], p[f"b{w}"] = init(w * embed, filters), np.zeros(filters, np.float32)
        p["out"], p["bias"] = init(len(WIDTHS) * filters, len(classes)), np.zeros(len(classes), np.float32)
        return ByteCNN(classes, p)

    def _columns(self, x: np.ndarray, width: int) -> np.ndarray:
        """(n, positions, width * e): for each position of a filter the embeddings that it sees."""
        n, length, e = x.shape
        a, b, c = x.strides
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(x, (n, length - width + 1, width * e), (a, b, c)))

    def _responses(self, columns: np.ndarray, width: int) -> np.ndarray:
        n, positions, c = columns.shape
        return (columns.reshape(-1, c) @ self.params[f"k{width}"]).reshape(n, positions, -1)

    def log_probabilities(self, rows: np.ndarray, block: int = 128) -> np.ndarray:
        p, out = self.params, []
        for at in range(0, len(rows), block):
            x = p["embed"][rows[at : at + block]]
            pooled = [self._responses(self._columns(x, w), w).max(axis=1) + p[f"b{w}"] for w in WIDTHS]
            z = np.maximum(np.concatenate(pooled, axis=1), 0) @ p["out"] + p["bias"]
            z -= z.max(axis=1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
        return np.concatenate(out)

    def _gradients(self, rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.params, len(rows)
        x = p["embed"][rows]
        columns = {w: self._columns(x, w) for w in WIDTHS}
        where, pooled = {}, []
        for w in WIDTHS:
            r = self._responses(columns[w], w)
            where[w] = r.argmax(axis=1)
            pooled.append(np.take_along_axis(r, where[w][:, None, :], 1)[:, 0] + p[f"b{w}"])
        h = np.concatenate(pooled, axis=1)
        a = np.maximum(h, 0)
        z = a @ p["out"] + p["bias"]
        z -= z.max(axis=1, keepdims=True)
        d = np.exp(z)
        d /= d.sum(axis=1, keepdims=True)
        d[np.arange(n), y] -= 1
        d *= (weight / weight.sum())[:, None]
        g = {"out": a.T @ d, "bias": d.sum(axis=0), "embed": np.zeros_like(p["embed"])}
        dh = (d @ p["out"].T) * (h > 0)
        e = p["embed"].shape[1]
        for i, w in enumerate(WIDTHS):
            f = p[f"k{w}"].shape[1]
            dr = dh[:, i * f : (i + 1) * f]
            seen = columns[w][np.arange(n)[:, None], where[w]]  # (n, f, width * e)
            g[f"k{w}"] = np.matmul(seen.transpose(1, 2, 0), dr.T[:, :, None])[:, :, 0].T
            g[f"b{w}"] = dr.sum(axis=0)
            dx = dr[:, :, None] * p[f"k{w}"].T[None]  # (n, f, width * e)
            for j in range(w):
                byte = rows[np.arange(n)[:, None], where[w] + j]
                np.add.at(g["embed"], byte.ravel(), dx[:, :, j * e : (j + 1) * e].reshape(-1, e))
        return g

    def train(self, rows: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int = 5, least_steps: int = 600, batch: int = 128, rate: float = 4e-3) -> None:
        """Adam with a falling rate; classes weigh alike. Small samples are gone through more often."""
        epochs = max(epochs, -(-least_steps * batch // len(rows)))
        weight = (1.0 / np.bincount(y, minlength=len(self.classes)).clip(1))[y].astype(np.float32)
        m = {k: np.zeros_like(v) for k, v in self.params.items()}
        v = {k: np.zeros_like(w) for k, w in self.params.items()}
        step, steps = 0, epochs * -(-len(rows) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), batch):
                take = order[at : at + batch]
                step += 1
                for k, g in self._gradients(rows[take], y[take], weight[take]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    scale = rate * (1 - step / (steps + 1)) / (1 - 0.9**step) * np.sqrt(1 - 0.99**step)
                    self.params[k] -= (scale * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; ``und`` and 0 for null and for texts without letters."""
        known = [i for i, t in enumerate(texts) if t and has_letter(t)]
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        group, held = [], 0
        for i in known:
            group.append(i)
            held += len(texts[i])
            if held > 1 << 22:
                self._predict(texts, group, langs, scores)
                group, held = [], 0
        if group:
            self._predict(texts, group, langs, scores)
        return langs, scores

    def _predict(self, texts, group, langs, scores) -> None:
        rows = [windows(texts[i]) for i in group]
        starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]])
        mean = np.add.reduceat(self.log_probabilities(np.concatenate(rows)), starts, axis=0) / np.array([len(r) for r in rows])[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for i, best, row in zip(group, p.argmax(axis=1), p, strict=True):
            langs[i], scores[i] = self.classes[best], float(row[best])


def held_out(doc_id: Column) -> Column:
    """True for documents that are never learned from: crc32 of doc_id as text leaves 1 by 3. False for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, per_language: int = 1000, pieces: int = 4, seed: int = 7, languages: int = 400) -> ByteCNN | None:
    """A network for the languages of the labelled rows that are not held out, from at most ``per_language`` rows of each.

    The sample is those rows with the smallest hash of doc_id and text (so reruns agree), and of each up to ``pieces`` windows spread over
    the text. Of more than ``languages`` labels the most frequent are learned. So no more reaches the driver than
    languages * per_language * pieces * WINDOW * 4 bytes. Rows with null doc_id, text or lang are not learned from; repeated rows
    count each. None if there is nothing to learn from.
    """
    usable = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter("doc_id is not null and text is not null and lang is not null").filter(~held_out(F.col("doc_id")))
    scale, h = 1 << 20, F.xxhash64(F.lit(seed), "doc_id", "text")
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(h).alias("different"))
    # The most frequent languages, so that what comes to the driver is bounded however many labels there are.
    counts = counts.orderBy(F.desc("n"), "lang").limit(languages)
    # Half as many more of a language's different rows as are needed: so few that no task has many, and only copies can make them more.
    odds = F.least(F.lit(scale), (F.lit(scale * 1.5 * per_language) / F.col("different")).cast("int") + 1)
    length = F.char_length("text")
    piece = lambda i: F.substring("text", (F.floor(length * i / pieces) + 1).cast("int"), F.lit(WINDOW))
    sampled = usable.withColumn("h", h).join(F.broadcast(counts.select("lang", odds.alias("odds"))), "lang").filter(F.pmod("h", F.lit(scale)) < F.col("odds"))
    # Whatever the table holds, many rows of one doc_id included, no more than ``per_language`` rows of a language come to the driver: the first of
    # each task's, and then the first of those.
    chosen = sampled.select("lang", "h", "doc_id", *[piece(i).alias(f"p{i}") for i in range(pieces)]).withColumn("task", F.spark_partition_id())
    order = [F.pmod("h", F.lit(scale)), F.col("h"), F.col("doc_id").cast("string"), *[F.col(f"p{i}") for i in range(pieces)]]
    for within in (["lang", "task"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*within).orderBy(*order))
        chosen = chosen.withColumn("place", place).filter(F.col("place") <= per_language).drop("place")
    by_lang: dict[str, list] = {}
    for r in chosen.collect():
        by_lang.setdefault(r.lang, []).append((r.h % scale, r.h, str(r.doc_id), *[r[f"p{i}"] for i in range(pieces)]))
    classes, rows, y = sorted(by_lang), [], []
    for c, lang in enumerate(classes):
        for r in sorted(by_lang[lang])[:per_language]:
            for text in dict.fromkeys(r[3:]):
                if has_letter(text):
                    rows.append(windows(text)[0])
                    y.append(c)
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    net = ByteCNN.fresh(classes, rng)
    net.train(np.stack(rows), np.array(y), rng)
    return net


def predict(docs: DataFrame, net: ByteCNN | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, ...).

    Null texts and texts without letters are ``und`` with score 0, and so is everything if there is no network. Texts are read
    whole. Repeated rows and null doc_ids are passed on; an empty table gives an empty result. Of other columns none is read.
    """
    return _apply(docs.select("doc_id", "text"), net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def _apply(rows: DataFrame, net: ByteCNN | None) -> DataFrame:
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", rows=1024):
                texts = part.column("text").to_pylist()
                langs, scores = net.predict(texts) if net else (["und"] * len(texts), [0.0] * len(texts))
                kept = [part.column(c) for c in names if c != "text"]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*[c for c in names if c != "text"], "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double")


def keep_known(docs: DataFrame, languages: list[str] | None = None, least_score: float = 0.0) -> DataFrame:
    """Rows of ``docs`` whose text has a language: one of ``languages`` (default: any that was learned) with ``least_score`` or more.

    Null and empty texts and those without letters go, and so does everything if there is nothing to learn from. Repeated rows stay
    or go together; null doc_ids make no difference. Columns are as they were. An empty table stays empty.
    """
    rows = keyed(docs, "language-rows")
    found = _apply(rows.select("text", *ROW_KEY), fit(docs)).filter(F.col("lang_pred") != "und").filter(F.col("score") >= least_score)
    if languages is not None:
        found = found.filter(F.col("lang_pred").isin(languages))
    return rows.join(found.select(*ROW_KEY), ROW_KEY, "left_semi").drop(*ROW_KEY)
