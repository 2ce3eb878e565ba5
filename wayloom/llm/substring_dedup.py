"""Operator 1, substring dedup: fixed-block anchors.

Aligned, non-overlapping blocks of half a window's words are the reference
index; every rolling window of that length is a probe.  Any repeat of a whole
window holds an aligned block of either copy, so a probe that meets a block
somewhere else anchors it.  Anchored hits are extended left and right over all
neighbouring probes that repeat too, which gives the maximal exact repeats;
inside these, each window of `window` words is settled exactly: the first
occurrence in (doc_id, row, start) stays, all words of later ones go.

Three packed shuffles (probes, answers, windows of repeats) and one of the
texts.  A flush sends a key or a window once however often it has it, so no
passage, however common, grows a bucket by more than one entry a flush.

Defined results: a null text has no words; texts shorter than a window keep
all; rows that share a doc_id are documents of their own, in the order of
their places in the input's files; a null doc_id sorts before all others;
other columns are ignored.  Only where a doc_id occurs twice do rows' numbers
travel beside it: eight bytes an entry more.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams, repeats
from .grams import U
from .repeats import DOCS, ENTRIES, PACKETS, get, put
from .store import numbered

WINDOW = 20
NULL_KEY = -(1 << 63)
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _narrow(values: np.ndarray) -> bytes:
    """Non-negative integers in the fewest bytes that hold them all, after that number; zeros in none."""
    top = int(values.max()) if len(values) else 0
    if not top:
        return bytes(1)
    size = next(s for s in (1, 2, 4, 8) if top < 1 << (8 * s) or s == 8)
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def _wide(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int64) if packed[0] else np.zeros(n, np.int64)


def put_places(docs: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> bytes:
    """Places, ascending by doc key: gaps between keys (they wrap, so any keys will do), rows' numbers and starts."""
    return put(docs[:1].astype("<i8"), struct.pack("<q", len(docs)), _narrow(np.diff(docs.astype("<i8").view(U))), _narrow(rows), _narrow(starts))


def get_places(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    head, n, gaps, rows, starts = get(packed)
    (n,) = struct.unpack("<q", n)
    gaps = _wide(gaps, n - 1).view(U)
    first = np.frombuffer(head, "<i8").view(U)
    return np.cumsum(np.concatenate([first, gaps]), dtype=U).view(np.int64), _wide(rows, n), _wide(starts, n)


def _gather(block: int):
    def gather(b: pa.RecordBatch) -> Iterator[tuple]:
        keys, text = [np.asarray(c) for c in b.columns[:-1]], grams.as_text(b.columns[-1])
        for lo, hi in grams.slices(text):
            w = grams.words(text[lo:hi])
            k = grams.kgrams(w.hash, block)
            row = grams.row_of(w.first)
            at = np.flatnonzero(row[: len(k)] == row[block - 1 :]) if len(k) else np.empty(0, np.int64)
            aligned = (at - w.first[row[at]]) % block == 0
            yield len(w.start), k[at], at, aligned, [keys[0][lo:hi].astype("<i8"), np.diff(w.first).astype("<i8"), *(k[lo:hi].astype("<i8") for k in keys[1:])]

    return gather


def _by_group(docs: np.ndarray, rows: np.ndarray, starts: np.ndarray, groups: int, flush: int) -> Iterator[tuple]:
    """Marks as packets, one for each group of documents."""
    which = np.mod(docs ^ rows, groups)
    order = np.lexsort((starts, rows, docs, which))
    which, docs, rows, starts = which[order], docs[order], rows[order], starts[order]
    edges = np.flatnonzero(np.append(repeats.first_of_groups(which), True)) if len(which) else []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield int(which[lo]), flush, DOCS, put_places(docs[lo:hi], rows[lo:hi], starts[lo:hi])


def _extend(block: int, bits: int, groups: int):
    """A flush: anchored maximal runs, their windows by bucket, and marks for what the flush itself has earlier."""
    c1, c2, c3, c4 = grams.stream(77, 4)

    def extend(table: pa.Table) -> pa.Table:
        r = repeats.Repeated(table)
        flush = table["flush"][0].as_py()
        n = len(r.key) - block
        if n <= 0:
            return pa.Table.from_batches([repeats.batch([])])
        seen = np.concatenate([[0], np.cumsum(r.key != 0)])
        anchors = np.concatenate([[0], np.cumsum(r.marked)])
        span = block + 1
        place = np.flatnonzero((seen[span:] - seen[:-span] == span) & (anchors[span:] > anchors[:-span]))
        doc_at = np.searchsorted(r.first, place, "right") - 1
        numbers = np.frombuffer(r.columns[2], "<i8") if len(r.columns) > 2 else np.zeros(len(r.doc), np.int64)
        doc, row, start = r.doc[doc_at], numbers[doc_at], place - r.first[doc_at]
        order = np.lexsort((start, row, doc))
        place, doc, row, start = place[order], doc[order], row[order], start[order]
        left, right = r.key[place], r.key[place + block]
        with np.errstate(over="ignore"):
            key, where = grams.mix(left * c1 + right * c2), grams.mix(left * c3 + right * c4)
        order = np.argsort(key, kind="stable")
        new = repeats.first_of_groups(key[order])
        rep = order[np.flatnonzero(new)]
        mine = np.repeat(rep, np.diff(np.append(np.flatnonzero(new), len(order))))
        later = order[order != mine]
        rows = list(_by_group(doc[later], row[later], start[later], groups, flush))
        rep = np.sort(rep)
        for b, sel in repeats.by_bucket((where[rep] >> U(64 - bits)).astype(np.int64)):
            sel = rep[sel]
            rows.append((b, flush, ENTRIES, put(key[sel].astype("<u8"), put_places(doc[sel], row[sel], start[sel]))))
        return pa.Table.from_batches([repeats.batch([(s % (1 << bits), s if k == DOCS else f, k, d) for s, f, k, d in rows])])

    return extend


def _settle(groups: int):
    """A bucket of windows: all but the first occurrence of each are marked.  Marks already made pass through."""

    def settle(table: pa.Table) -> pa.Table:
        rows, keys, docs, numbers, starts = [], [], [], [], []
        for flush, kind, data in zip(*(table[c].to_pylist() for c in ("flush", "kind", "data")), strict=True):
            if kind == DOCS:
                rows.append((flush, 0, DOCS, data))
                continue
            k, places = get(data)
            d, r, s = get_places(places)
            keys.append(np.frombuffer(k, "<u8"))
            docs.append(d)
            numbers.append(r)
            starts.append(s)
        if keys:
            keys, docs, numbers, starts = (np.concatenate(x) for x in (keys, docs, numbers, starts))
            order = np.lexsort((starts, numbers, docs, keys))
            new = repeats.first_of_groups(keys[order])
            at = np.flatnonzero(new)
            first = np.repeat(order[at], np.diff(np.append(at, len(order))))
            later = order[order != first]
            rows += _by_group(docs[later], numbers[later], starts[later], groups, 0)
        return pa.Table.from_batches([repeats.batch(rows)])

    return settle


def _cut(window: int, with_text: bool):
    """A group of documents with its marks: what is left of each text."""

    def kept(text: pa.Array, keys: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> tuple[list, list, list, list]:
        w = grams.words(text)
        lo, hi = np.searchsorted(docs, keys, "left"), np.searchsorted(docs, keys, "right")
        change = np.zeros(len(w.start) + 1, np.int64)
        at = np.repeat(w.first[:-1] - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) if len(lo) else lo
        mine = starts[np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange(int((hi - lo).sum()))]
        place = mine + np.repeat(w.first[:-1], hi - lo)
        ends = np.repeat(w.first[1:], hi - lo)
        np.add.at(change, place, 1)
        np.add.at(change, np.minimum(place + window, ends), -1)
        stay = np.cumsum(change[:-1]) == 0
        size = (w.end - w.start)[stay] + 1
        off = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(w.start[stay] - off[:-1], size) + np.arange(off[-1])
        out = np.append(w.data, np.uint8(32))[take]
        out[off[1:] - 1] = 32
        held = np.concatenate([[0], np.cumsum(stay)])[w.first]
        out = memoryview(out)
        parts = [bytes(out[off[a] : off[b] - 1]) if b > a else b"" for a, b in zip(held[:-1], held[1:], strict=True)]
        n = np.diff(w.first)
        return n.tolist(), (n - np.diff(held)).tolist(), [hashlib.sha256(p).hexdigest() for p in parts], parts

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        places = [get_places(x) for x in right["data"].to_pylist()] if len(right) else []
        docs, rows, starts = (np.concatenate([p[i] for p in places]) if places else np.empty(0, np.int64) for i in range(3))
        text = grams.as_text(left["text"])
        keys, numbers = (left[c].combine_chunks().to_numpy() if len(left) else np.empty(0, np.int64) for c in ("doc_key", "row_key"))
        # Pairs of doc key and row number become numbers of their own.
        all_docs, all_rows = np.concatenate([keys, docs]), np.concatenate([numbers, rows])
        order = np.lexsort((all_rows, all_docs))
        pair = np.empty(len(order), np.int64)
        pair[order] = np.cumsum(repeats.first_of_groups(all_docs[order]) | repeats.first_of_groups(all_rows[order]))
        keys, docs = pair[: len(keys)], pair[len(keys) :]
        order = np.lexsort((starts, docs))
        docs, starts = docs[order], starts[order]
        out = [[], [], [], []]
        for lo, hi in grams.slices(text):
            for o, x in zip(out, kept(text[lo:hi], keys[lo:hi], docs, starts), strict=True):
                o += x
        columns = [left["doc_id"].combine_chunks(), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            columns.append(pa.array([p.decode() for p in out[3]], pa.string()))
            names.append("kept_text")
        return pa.table(dict(zip(names, columns, strict=True)))

    return cut


def _prime_from(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def substring_dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Removes every word covered by a `window`-word sequence that starts earlier too.

    docs: doc_id long, text string.  Returns doc_id, n_words, n_removed,
    kept_sha256 and, if asked, kept_text (kept words joined by one space).
    `window` must be even.
    """
    if window < 2 or window % 2:
        raise ValueError("window must be even and positive")
    block = window // 2
    shared = not docs.groupBy(F.col("doc_id").cast("long")).count().filter("count > 1").isEmpty()
    rows = (numbered(docs.select("doc_id", "text") if "row_key" in docs.columns else docs) if shared else docs.withColumn("row_key", F.lit(0).cast("long"))).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("doc_key"), "row_key", F.col("text").cast("string").alias("text")
    )
    bits = repeats.bucket_bits(docs.select("doc_id", "text"))
    groups = _prime_from(1 << bits)
    found = repeats.exchange(rows.select("doc_key", *["row_key"] * shared, "text"), _gather(block), bits)
    marks = found.groupBy("flush").applyInArrow(_extend(block, bits, groups), PACKETS).groupBy("slot").applyInArrow(_settle(groups), PACKETS)
    schema = SCHEMA if with_text else SCHEMA.removesuffix(", kept_text string")
    left = rows.withColumn("slot", F.expr(f"cast(pmod(doc_key ^ row_key, {groups}) as int)"))
    return left.groupBy("slot").cogroup(marks.select("slot", "data").groupBy("slot")).applyInArrow(_cut(window, with_text), schema)
