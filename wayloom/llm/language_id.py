"""Operator 3, language identification: a convolutional network over bytes.

Filters of several widths run over the bytes of fixed-length windows, each
filter's maximum over a window (rectified) is a feature, and a softmax layer
gives the window's languages; a text's probabilities are those of its windows,
weighted by their bytes.  Inputs are one-hot bytes, so a filter is a table and
a convolution adds table rows: training is numpy on the driver, and inference
adds rows of two-byte tables over flat arrays, window by window, in bounded
memory.

The training sample is bounded: PER_LANGUAGE documents of each language, or as
many as make SAMPLE documents over all languages (of which the SAMPLE
commonest are learned), those of least hashed doc_id, none longer than
MAX_CHARS, WINDOWS_EACH windows of each.  Inference reads every whole text in one pass without a shuffle.

Defined results: a text that is null or has no letter is `und` with score 0;
without labelled rows every text is; A-Z are folded; equal rows teach once,
different texts of one doc_id each; each row gives a row; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import grams

WIDTHS, FILTERS, WINDOW = (2, 3, 4), 16, 256
PER_LANGUAGE, SAMPLE, WINDOWS_EACH, MAX_CHARS = 400, 4000, 8, 50_000
#: Parts into which hashes of doc_ids are dealt to thin languages out before they are shuffled.
PARTS = 1 << 40
EPOCHS, BATCH, RATE = 6, 128, 0.01
UNKNOWN = "und"
SCHEMA = "doc_id long, lang_pred string, score double"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def windows(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat folded bytes, each row padded with zeros to whole windows; windows and bytes of each row."""
    offsets, data = grams.buffers(text)
    size = np.diff(offsets)
    count = (size + max(WIDTHS) - 1 + WINDOW - 1) // WINDOW
    start = np.concatenate([[0], np.cumsum(count * WINDOW)])
    flat = np.zeros(int(start[-1]) + max(WIDTHS), np.uint8)
    flat[np.arange(len(data)) + np.repeat(start[:-1] - offsets[:-1], size)] = _FOLD[data]
    return flat, count, size


class Network:
    """Filter tables by width, and the softmax layer."""

    def __init__(self, langs: list[str]) -> None:
        r = np.random.default_rng(7)
        self.langs = langs
        self.tables = [r.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        for t in self.tables:
            t[:, 0] = 0
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.dense = r.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.offset = np.zeros(len(langs), np.float32)

    def train(self, x: np.ndarray, y: np.ndarray) -> Network:
        """x: windows with the bytes that the widest filter reaches beyond them; y: index of the language."""
        params = [*self.tables, *self.bias, self.dense, self.offset]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        r, step = np.random.default_rng(8), 0
        k = len(WIDTHS)
        for _ in range(EPOCHS):
            order = r.permutation(len(x))
            for lo in range(0, len(order), BATCH):
                xs, ys = x[order[lo : lo + BATCH]], y[order[lo : lo + BATCH]]
                n = len(xs)
                tops, places = [], []
                for w, t, b in zip(WIDTHS, self.tables, self.bias, strict=True):
                    z = t[0][xs[:, :WINDOW]]
                    for j in range(1, w):
                        z += t[j][xs[:, j : j + WINDOW]]
                    at = z.argmax(1)
                    places.append(at)
                    tops.append(np.take_along_axis(z, at[:, None], 1)[:, 0] + b)
                raw = np.concatenate(tops, 1)
                h = np.maximum(raw, 0)
                s = h @ self.dense + self.offset
                p = np.exp(s - s.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(n), ys] -= 1
                p /= n
                back = (p @ self.dense.T) * (raw > 0)
                grads = [np.zeros_like(t) for t in self.tables] + [back[:, i * FILTERS : (i + 1) * FILTERS].sum(0) for i in range(k)] + [h.T @ p, p.sum(0)]
                for i, (w, at) in enumerate(zip(WIDTHS, places, strict=True)):
                    g = back[:, i * FILTERS : (i + 1) * FILTERS]
                    for j in range(w):
                        np.add.at(grads[i][j], (xs[np.arange(n)[:, None], at + j], np.arange(FILTERS)), g)
                    grads[i][:, 0] = 0
                step += 1
                for q, g, a, c in zip(params, grads, first, second, strict=True):
                    a += 0.1 * (g - a)
                    c += 0.001 * (g * g - c)
                    q -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.999**step)) + 1e-8)
        return self

    def pairs(self) -> list[np.ndarray]:
        """For each width, tables by two bytes (and by one for what is left)."""
        out = []
        for t in self.tables:
            out.append([(t[j][:, None] + t[j + 1][None]).reshape(65536, FILTERS) if j + 1 < len(t) else t[j] for j in range(0, len(t), 2)])
        return out

    def window_probabilities(self, flat: np.ndarray, n: int, pairs: list) -> np.ndarray:
        """Softmax of n windows that follow each other in flat."""
        out = np.empty((n, len(self.langs)), np.float32)
        step = 64
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            part = flat[lo * WINDOW : hi * WINDOW + max(WIDTHS)].astype(np.int32)
            m = (hi - lo) * WINDOW
            two = (part[:-1] << 8) | part[1:]
            tops = []
            for w, tables, b in zip(WIDTHS, pairs, self.bias, strict=True):
                z = None
                for i, t in enumerate(tables):
                    j = 2 * i
                    rows = t.take((two if j + 1 < w else part)[j : j + m], axis=0)
                    z = rows if z is None else np.add(z, rows, out=z)
                tops.append(z.reshape(hi - lo, WINDOW, FILTERS).max(1) + b)
            s = np.maximum(np.concatenate(tops, 1), 0) @ self.dense + self.offset
            p = np.exp(s - s.max(1, keepdims=True))
            out[lo:hi] = p / p.sum(1, keepdims=True)
        return out


def _has_letter(text: pa.Array) -> np.ndarray:
    """Whether each row has a letter; only rows without an ASCII one are looked at character by character."""
    offsets, data = grams.buffers(text)
    folded = data | 32
    ascii_letters = np.concatenate([[0], np.cumsum((folded >= 97) & (folded <= 122) & (data < 128))])
    out = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(c.isalpha() for c in text[int(i)].as_py())
    return out


def _predictor(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network | None = shared.value
        pairs = net.pairs() if net else None
        for b in batches:
            text = grams.as_text(b.column(1))
            for lo, hi in grams.slices(text):
                part = text[lo:hi]
                langs, scores = np.full(hi - lo, UNKNOWN, object), np.zeros(hi - lo)
                if net:
                    flat, count, size = windows(part)
                    p = net.window_probabilities(flat, int(count.sum()), pairs)
                    start = np.concatenate([[0], np.cumsum(count)])
                    full = np.flatnonzero(count)
                    worth = np.full(int(start[-1]), float(WINDOW))
                    last = start[1:][full] - 1
                    worth[last] = np.maximum(size[full] - (count[full] - 1) * WINDOW, 0)
                    # A last window may hold nothing but padding.
                    mean = np.add.reduceat(p * worth[:, None], start[:-1][full], axis=0) / np.maximum(size[full], 1)[:, None] if len(full) else np.zeros((0, len(net.langs)))
                    langs[full], scores[full] = np.array(net.langs, object)[mean.argmax(1)], mean.max(1)
                    none = ~_has_letter(part)
                    langs[none], scores[none] = UNKNOWN, 0.0
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi].cast(pa.int64()), pa.array(langs, pa.string()), pa.array(np.clip(scores, 0, 1))], names=["doc_id", "lang_pred", "score"])

    return predict


def train(docs: DataFrame) -> Network | None:
    """A network from the bounded sample of labelled documents outside the held-out fold; None without any."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = rows.filter(f"lang is not null and doc_id is not null and text is not null and length(text) <= {MAX_CHARS}").filter(~held_out(F.col("doc_id")))
    known = known.select("doc_id", "lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("place"), F.xxhash64("text").alias("mark"))
    langs = known.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("doc_id").alias("ids")).orderBy(F.desc("n"), "lang").limit(SAMPLE)
    langs = [(r["lang"], r["ids"]) for r in langs.collect()]
    if not langs:
        return None
    each = max(1, min(PER_LANGUAGE, SAMPLE // len(langs)))
    # Of common languages only about three times the sample is shuffled: those of least place.
    below = docs.sparkSession.createDataFrame([(lang, min(PARTS, 3 * each * PARTS // max(1, ids))) for lang, ids in langs], "lang string, below long")
    near = known.join(F.broadcast(below), "lang").filter("place < below")
    order = Window.partitionBy("lang").orderBy("place", "doc_id", "mark")
    ids = near.select("doc_id", "lang", "place", "mark").distinct().withColumn("n", F.row_number().over(order)).filter(f"n <= {each}").select("doc_id", "lang", "mark")
    # One row for each of the sample, however often the input repeats it.
    sample = near.join(F.broadcast(ids), ["doc_id", "lang", "mark"]).groupBy("doc_id", "lang", "mark").agg(F.min("text").alias("text")).orderBy("doc_id", "lang", "text").toPandas()
    if sample.empty:
        return None
    langs = sorted(sample["lang"].unique())
    flat, count, _ = windows(grams.as_text(pa.array(sample["text"], pa.large_string())))
    start = np.concatenate([[0], np.cumsum(count)])
    chosen = [np.unique(np.linspace(lo, hi - 1, min(WINDOWS_EACH, hi - lo)).astype(int)) for lo, hi in zip(start[:-1], start[1:], strict=True) if hi > lo]
    y = np.repeat(np.searchsorted(langs, sample["lang"][np.diff(start) > 0].to_numpy(str)), [len(c) for c in chosen])
    at = np.concatenate(chosen)[:, None] * WINDOW + np.arange(WINDOW + max(WIDTHS) - 1)
    return Network(langs).train(flat[np.minimum(at, len(flat) - 1)], y)


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_predictor(shared), SCHEMA)


def language_id(docs: DataFrame) -> DataFrame:
    """Trains on documents outside the held-out fold and predicts the language of every document."""
    found = identify(docs, train(docs))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
