"""Operator 8, benchmark decontamination: winnowing.

From each sliding window of `window` words both sides keep the least hash of
its k-grams (k = window // 2), so equal windows have equal fingerprints and no
shared span of a window or more is missed.  A bitmap of the benchmark's
fingerprints, 16 bits for each and 16 MB at most, is sent to the tasks that
read the documents; windows whose fingerprint it may hold are joined with the
benchmark's on fingerprint and whole-window hash, and the joined windows are
extended over their union.  Items shorter than a window are one window of
their own length, which is its own fingerprint.

Hashes have 128 bits (fingerprint and window).  A full bitmap only costs
time: the join decides.  It is with distinct windows, one row each, so a
window that a third of all documents hold is split by skew handling; items
come from a second join, of the distinct windows of each document.  A
document's hits are merged by one sort, in constant memory.

Defined results: null or empty texts have no words and no hits; items without
words never occur; a null item_id marks words but is neither listed nor
counted; rows that share an item_id are one item with the windows of all; each
row gives a row, repeated ones too; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import grams
from .grams import U
from .memory import releasing
from .store import settled

WINDOW = 10
#: log2 of the bitmap's bits at least and at most, and how many a fingerprint gets.
LEAST_BITS, MOST_BITS, BITS_EACH = 16, 27, 16
_PIECE = "row long, doc_id long, n_words long, found array<struct<fp:long,wh:long,m:int,start:int>>"
_FOUND = pa.list_(pa.struct([("fp", pa.int64()), ("wh", pa.int64()), ("m", pa.int32()), ("start", pa.int32())]))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out = values[: len(values) - width + 1].copy()
    for j in range(1, width):
        np.minimum(out, values[j : j + len(out)], out=out)
    return out


def _windows(w: grams.Words, m: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, fingerprint and hash of all windows of m words that lie within a row."""
    wh = grams.kgrams(w.hash, m, seed=3)
    if not len(wh):
        return np.empty(0, np.int64), wh, wh
    if m < window:
        fp = grams.kgrams(w.hash, m, seed=5)
    else:
        k = max(1, m // 2)
        fp = sliding_min(grams.kgrams(w.hash, k, seed=7), m - k + 1)
    row = grams.row_of(w.first)
    at = np.flatnonzero(row[: len(wh)] == row[m - 1 :])
    return at, fp[at], wh[at]


def _items(window: int):
    schema = pa.schema([("item_id", pa.string()), ("fp", pa.int64()), ("wh", pa.int64()), ("m", pa.int32())])

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, text = b.column(0), grams.as_text(b.column(1))
            for lo, hi in grams.slices(text):
                w = grams.words(text[lo:hi], grams.ALNUM, lower=True)
                n = np.diff(w.first)
                for m in np.unique(np.minimum(n[n > 0], window)):
                    at, fp, wh = _windows(w, int(m), window)
                    row = grams.row_of(w.first)[at]
                    mine = (n[row] == m) | ((m == window) & (n[row] >= window))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[mine] + lo)), pa.array(fp[mine].view(np.int64)), pa.array(wh[mine].view(np.int64)), pa.array(np.full(int(mine.sum()), m, np.int32))], schema=schema)

    return items


def _documents(window: int, lengths: list[int], bitmap, bitmap_bits: int):
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, n_before, part = bitmap.value, 0, TaskContext.get().partitionId()
        for b in batches:
            ids, text = b.column(0), grams.as_text(b.column(1))
            for lo, hi in grams.slices(text):
                w = grams.words(text[lo:hi], grams.ALNUM, lower=True)
                parts = []
                for m in lengths:
                    at, fp, wh = _windows(w, m, window)
                    place = fp >> U(64 - bitmap_bits)
                    hit = np.flatnonzero(bits[(place >> U(3)).astype(np.int64)] >> (place & U(7)).astype(np.uint8) & 1)
                    parts.append((at[hit], fp[hit], wh[hit], np.full(len(hit), m, np.int32)))
                at, fp, wh, m = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64), *[np.empty(0, U)] * 2, np.empty(0, np.int32))
                order = np.argsort(at, kind="stable")
                at, fp, wh, m = at[order], fp[order], wh[order], m[order]
                row = np.searchsorted(w.first, at, "right") - 1
                found = pa.StructArray.from_arrays([pa.array(fp.view(np.int64)), pa.array(wh.view(np.int64)), pa.array(m), pa.array((at - w.first[row]).astype(np.int32))], fields=list(_FOUND.value_type))
                offsets = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                rows = np.arange(n_before + lo, n_before + hi, dtype=np.int64) + (part << 40)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), ids[lo:hi].cast(pa.int64()), pa.array(np.diff(w.first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), found, type=_FOUND)], names=["row", "doc_id", "n_words", "found"]
                )
            n_before += len(text)

    return documents


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """fp, wh, m, item_id: the distinct windows of each item."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_items(window), "item_id string, fp long, wh long, m int").distinct()


def _bitmap(windows: DataFrame, bits: int) -> np.ndarray:
    """At most 2**(bits - 5) rows reach the driver, whatever the benchmark's size."""
    place = F.shiftrightunsigned("fp", 64 - bits)
    words = windows.groupBy((F.shiftright(place, 5)).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(fp, {64 - bits}) & 31 as int))")).alias("bits"))
    packed = words.toPandas()
    out = np.zeros(1 << (bits - 5), "<u4")
    out[packed["word"].to_numpy(np.int64)] = packed["bits"].to_numpy(np.int64).astype("<u4")
    return out.view(np.uint8)


def merged_spans(hits: DataFrame) -> DataFrame:
    """row, spans (their union, in order) and n_hit of each document's hits (row, start, end)."""
    ordered = Window.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    fresh = hits.withColumn("fresh", F.when(F.col("start") <= before, 0).otherwise(1))
    run = fresh.withColumn("run", F.sum("fresh").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = run.groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each document the words inside any occurrence of a benchmark window.

    docs: doc_id long, text string; benchmark: item_id, text.  Returns doc_id,
    n_words, n_hit, n_items, items_sha256, contaminated, items (array) and
    spans (array of the merged hit spans, in words).
    """
    spark = docs.sparkSession
    of_items = settled(benchmark_windows(benchmark, window))
    windows = of_items.select("fp", "wh", "m").distinct()
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(BITS_EACH * max(1, of_items.count())))))
    lengths = sorted(r["m"] for r in windows.select("m").distinct().collect())
    bitmap = spark.sparkContext.broadcast(_bitmap(windows, bits))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = settled(texts.mapInArrow(releasing(_documents(window, lengths, bitmap, bits)), _PIECE))
    probes = pieces.filter(F.size("found") > 0).select("row", F.inline("found"))
    hits = settled(probes.join(windows, ["fp", "wh", "m"]).select("row", "fp", "wh", "m", "start", (F.col("start") + F.col("m")).alias("end")))
    named = of_items.filter("item_id is not null")
    items = hits.select("row", "fp", "wh", "m").distinct().join(named, ["fp", "wh", "m"]).groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    found = settled(merged_spans(hits.select("row", "start", "end").distinct()).join(items, "row", "left"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return pieces.select("row", "doc_id", "n_words").join(found, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
        items.alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )
