"""Which k-grams of a corpus occur more than once: a packed, two-way exchange.

A map task hashes every k-gram of a *flush* (a bounded number of words of
consecutive rows) and sends each distinct key of the flush once to the bucket
that the key's leading bits name.  A bucket sees all flushes, so it knows
which keys repeat, and answers each flush with the positions that do.  Keys
travel as 4 or 5 bytes and positions as gaps of one or two, so the
exchange writes less than the text it stands for; and since a flush sends a
key once however often it occurs there, a passage that a third of all rows
hold costs one entry a flush, not one a row.

A bucket stands for a few MB of input, so their number grows with it and what
a task holds does not.  Up to 2**FINE_BITS buckets a flush has enough keys for
each to pack them.  Beyond, the exchange has two levels: packets go to
2**COARSE_BITS slots, are cut there, many at a time, by the next bits of their
keys, and meet in the buckets of a second shuffle.

Rows on the way are (slot int, flush long, kind int, data binary).
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams
from .grams import U
from .memory import releasing

PACKETS = "slot int, flush long, kind int, data binary"
_ARROW = pa.schema([("slot", pa.int32()), ("flush", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
#: Words that a map task gathers before it sends their keys: bounds its memory.
FLUSH_WORDS = 1_000_000
ENTRIES, DOCS = 0, 1
#: log2 of the buckets of an exchange of one level at most, and of the slots of the first of two levels.
FINE_BITS, COARSE_BITS = 14, 12
#: Bytes of packets that a task of the second level gathers before it passes them on.
GATHERED = 32 << 20
#: Spark's estimate for what it knows nothing about is larger than this.
UNKNOWN_BYTES = 1 << 55


def input_bytes(df: DataFrame) -> int:
    """Size of the input: Spark's estimate from file sizes, or the measured length of the texts where it has none."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return estimate if estimate < UNKNOWN_BYTES else df.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0


def bits_of(size: int, each: int = 2 << 20) -> int:
    """log2 of the number of buckets: one for every few MB of input, 128 at least; a slot is an int."""
    return min(30, max(7, math.ceil(math.log2(max(1, size) / each))))


def bucket_bits(df: DataFrame, each: int = 2 << 20) -> int:
    """`bits_of` the size of a table."""
    return bits_of(input_bytes(df), each)


def put_gaps(ascending: np.ndarray) -> bytes:
    """Ascending non-negative integers as gaps of one or two bytes, whichever take less; the largest number of a width means that much more to come.

    With many buckets a flush has few keys for each, so gaps are as wide as there are buckets.
    """
    gaps = np.diff(ascending, prepend=0)
    narrow = len(gaps) + int((gaps // 255).sum()) <= 2 * (len(gaps) + int((gaps // 65535).sum()))
    width, most = ("<u1", 255) if narrow else ("<u2", 65535)
    ends = np.cumsum(gaps // most + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, most, width)
    out[ends] = gaps % most
    return (b"\1" if narrow else b"\2") + out.tobytes()


def get_gaps(packed: bytes) -> np.ndarray:
    width = packed[0]
    raw = np.frombuffer(packed, f"<u{width}", offset=1)
    return np.cumsum(raw, dtype=np.int64)[raw != (255 if width == 1 else 65535)]


def put(*parts: bytes | np.ndarray) -> bytes:
    """Byte strings and arrays, each after its length."""
    raw = [p if isinstance(p, bytes) else np.ascontiguousarray(p).tobytes() for p in parts]
    return b"".join(x for r in raw for x in (struct.pack("<q", len(r)), r))


def get(packed: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(packed):
        (n,) = struct.unpack_from("<q", packed, at)
        out.append(packed[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def in_buckets(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets that occur, the edges of their entries, and the entries' indices, ascending in each bucket."""
    small = len(buckets) and int(buckets.max()) < 1 << 16
    order = np.argsort(buckets.astype(np.uint16) if small else buckets, kind="stable")
    edges = np.append(np.flatnonzero(first_of_groups(buckets[order])), len(order))
    return buckets[order[edges[:-1]]], edges, order


def by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each bucket that occurs, the ascending indices of its entries."""
    found, edges, order = in_buckets(buckets)
    for b, lo, hi in zip(found.tolist(), edges[:-1], edges[1:], strict=True):
        yield b, order[lo:hi]


def first_of_groups(sorted_keys: np.ndarray) -> np.ndarray:
    """True where a sorted array takes a new value."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return new


def put_entries(at: np.ndarray, key: np.ndarray, wide: bool, marked: np.ndarray, count: np.ndarray) -> bytes:
    """A packet: positions, the low 4 or 5 bytes of their keys, marks, and counts where they are not one."""
    multi = count > 1
    wider = ((key >> U(32)) & U(255)).astype(np.uint8) if wide else b""
    return put(put_gaps(at), (key & U(0xFFFFFFFF)).astype("<u4"), wider, np.packbits(marked), put(np.packbits(multi), count[multi]) if multi.any() else b"")


def get_entries(data: bytes) -> tuple[np.ndarray, np.ndarray, bool, np.ndarray, np.ndarray]:
    at, low, wide, marks, counts = get(data)
    at = get_gaps(at)
    n = len(at)
    key = np.frombuffer(low, "<u4").astype(U)
    if wide:
        key |= np.frombuffer(wide, np.uint8).astype(U) << U(32)
    count = np.ones(n, np.uint8)
    if counts:
        m, values = get(counts)
        count[np.unpackbits(np.frombuffer(m, np.uint8), count=n).view(bool)] = np.frombuffer(values, np.uint8)
    return at, key, bool(wide), np.unpackbits(np.frombuffer(marks, np.uint8), count=n).view(bool), count


def cut(raw: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """The bytes of each group of an array, between two edges."""
    data = raw.tobytes()
    return [data[a:b] for a, b in pairwise((raw.itemsize * edges).tolist())]


def all_gaps(edges: np.ndarray, at: np.ndarray) -> list[bytes]:
    """`put_gaps` of every group; none is empty."""
    start, n = edges[:-1], np.diff(edges)
    gaps = np.diff(at, prepend=0)
    gaps[start] = at[start]
    size = {most: n + np.add.reduceat(gaps // most, start) for most in (255, 65535)}
    narrow = size[255] <= 2 * size[65535]
    out = np.empty(len(n), object)
    for most, width, tag, mine in ((255, "<u1", b"\1", narrow), (65535, "<u2", b"\2", ~narrow)):
        own = gaps[np.repeat(mine, n)]
        raw = np.full(int(size[most][mine].sum()), most, width)
        raw[np.cumsum(own // most + 1) - 1] = own % most
        out[mine] = [tag + x for x in cut(raw, np.append(0, np.cumsum(size[most][mine])))]
    return out.tolist()


def bit_places(n: np.ndarray) -> np.ndarray:
    """Where the bits of groups of n lie when each group begins a byte."""
    size = (n + 7) // 8
    return np.arange(n.sum()) + np.repeat(8 * (np.cumsum(size) - size) - (np.cumsum(n) - n), n)


def all_bits(edges: np.ndarray, bits: np.ndarray) -> list[bytes]:
    """`np.packbits` of every group."""
    n = np.diff(edges)
    ends = np.append(0, np.cumsum((n + 7) // 8))
    spread = np.zeros(8 * ends[-1], bool)
    spread[bit_places(n)] = bits
    return cut(np.packbits(spread), ends)


def all_entries(edges: np.ndarray, at: np.ndarray, key: np.ndarray, wide: bool, marked: np.ndarray, count: np.ndarray) -> list[bytes]:
    """`put_entries` of every group, at a cost that hardly grows with their number."""
    multi = count > 1
    some = np.append(0, np.cumsum(multi))[edges]
    counts = [put(m, c) if c else b"" for m, c in zip(all_bits(edges, multi), cut(count[multi], some), strict=True)]
    return list(map(put, all_gaps(edges, at), *all_keys(edges, key, wide), all_bits(edges, marked), counts))


def all_keys(edges: np.ndarray, key: np.ndarray, wide: bool) -> tuple:
    """The low 4 bytes of every group's keys, and the fifth ones."""
    low = cut((key & U(0xFFFFFFFF)).astype("<u4"), edges)
    return low, cut((key >> U(32)).astype(np.uint8), edges) if wide else repeat(b"", len(low))


def by_width(packets: list[list[bytes]], gaps: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Packets, those of narrow gaps first, with the positions in all of them and how many each has; `gaps` says which part holds them."""
    packets = [p for width in (1, 2) for p in packets if p[gaps][0] == width]
    at, n = [], []
    for width, most in ((1, 255), (2, 65535)):
        mine = [p[gaps] for p in packets if p[gaps][0] == width]
        raw = np.frombuffer(b"".join([p[1:] for p in mine]), f"<u{width}")
        stop = np.cumsum([(len(p) - 1) // width for p in mine], dtype=np.int64)
        real = raw != most
        each = np.diff(np.append(0, np.cumsum(real))[stop], prepend=0)
        total = np.append(0, np.cumsum(raw, dtype=np.int64))
        at.append(total[1:][real] - np.repeat(total[np.append(0, stop)[: len(mine)]], each))
        n.append(each)
    return packets, np.concatenate(at), np.concatenate(n)


def joined_keys(packets: list[list[bytes]], low: int) -> tuple[np.ndarray, bool]:
    """Keys of packets, and whether they have 5 bytes: all of an exchange have, or none."""
    key = np.frombuffer(b"".join([p[low] for p in packets]), "<u4").astype(U)
    wider = np.frombuffer(b"".join([p[low + 1] for p in packets]), np.uint8)
    if len(wider):
        key |= wider.astype(U) << U(32)
    return key, len(wider) > 0


def joined_bits(raw: list[bytes], n: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(raw), np.uint8))[bit_places(n)].view(bool)


class Gathered:
    """What a map task holds until it flushes: keys with their position, mark and group, and a table of rows."""

    def __init__(self) -> None:
        self.words, self.keys, self.at, self.marked, self.docs, self.tables = 0, [], [], [], [], []

    def add(self, n_words: int, keys: np.ndarray, at: np.ndarray, marked: np.ndarray, tables: list[np.ndarray]) -> None:
        """tables: columns of the rows' table; the first is the doc key, the second the row's length in positions."""
        self.keys.append(keys)
        self.at.append(at + self.words)
        self.marked.append(marked)
        self.tables.append(tables)
        self.words += n_words

    def flush(self, flush: int, bits: int, wide: bool) -> list[tuple]:
        keys, at, marked = (np.concatenate(x) for x in (self.keys, self.at, self.marked))
        # Not a stable sort, which takes several times as long: a key's first place is looked for after it.
        order = np.argsort(keys)
        new = first_of_groups(keys[order])
        starts = np.flatnonzero(new)
        rep = np.minimum.reduceat(order, starts) if len(starts) else order
        sizes = np.diff(np.append(starts, len(order)))
        any_mark = np.logical_or.reduceat(marked[order], starts) if len(starts) else np.zeros(0, bool)
        rep_of = np.repeat(rep, sizes)
        again = order != rep_of
        others, rep_of = order[again], rep_of[again]
        by_place = np.argsort(rep)
        rep, any_mark = rep[by_place], any_mark[by_place]
        count = np.minimum(sizes, 255).astype(np.uint8)[by_place]
        rows = []
        key = keys[rep]
        buckets, edges, order = in_buckets((key >> U(64 - bits)).astype(np.int64))
        if len(buckets):
            packets = all_entries(edges, at[rep[order]], key[order], wide, any_mark[order], count[order])
            rows = list(zip(buckets.tolist(), repeat(flush), repeat(ENTRIES), packets))  # noqa: B905
        table = [np.concatenate(c) for c in zip(*self.tables, strict=True)]
        back = np.argsort(others)
        rows.append((flush % (1 << bits), flush, DOCS, put(put_gaps(at[others[back]]), at[rep_of[back]].astype("<u4"), *table)))
        self.__init__()
        return rows


def sender(gather: Callable[[pa.RecordBatch], Iterator[tuple]], bits: int, wide: bool = False, flush_words: int = FLUSH_WORDS):
    """A mapInArrow function: gather gives arguments of Gathered.add for slices of a batch."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, part = Gathered(), 0, TaskContext.get().partitionId()
        for b in batches:
            for piece in gather(b):
                held.add(*piece)
                if held.words >= flush_words:
                    yield batch(held.flush((part << 24) + n, bits, wide))
                    n += 1
        if held.tables:
            yield batch(held.flush((part << 24) + n, bits, wide))

    return send


def answer(table: pa.Table) -> pa.Table:
    """A bucket: for each flush, the positions whose key another row, place or flush has too."""
    slot = table["slot"][0].as_py()
    rows, packets = [], []
    for flush, kind, data in zip(*(table[c].to_pylist() for c in ("flush", "kind", "data")), strict=True):
        if kind == DOCS:
            rows.append((slot, flush, DOCS, data))
            continue
        # A bucket of the second level gets packets of many flushes at once.
        several = zip(np.frombuffer((held := get(data))[0], "<i8").tolist(), held[1:], strict=True) if flush < 0 else ((flush, data),)
        packets.extend([*get(one), mine] for mine, one in several)
    if packets:
        packets, gi, n = by_width(packets, 0)
        rem, wide = joined_keys(packets, 1)
        marked = joined_bits([p[3] for p in packets], n)
        count = np.ones(len(rem), np.uint8)
        multi = [get(p[4]) if p[4] else (b"", b"") for p in packets]
        some = np.array([len(v) for _, v in multi]) > 0
        if some.any():
            at = np.flatnonzero(np.repeat(some, n))
            count[at[joined_bits([m for m, _ in multi if m], n[some])]] = np.frombuffer(b"".join([v for _, v in multi]), np.uint8)
        packet = np.repeat(np.arange(len(packets), dtype=np.int32), n)
        order = np.argsort(rem)
        starts = np.flatnonzero(first_of_groups(rem[order]))
        sizes = np.diff(np.append(starts, len(order)))
        total = np.repeat(np.add.reduceat(count[order], starts, dtype=np.int64), sizes)
        mark = np.repeat(np.logical_or.reduceat(marked[order], starts), sizes)
        hit = total > 1
        back = order[hit]
        total, mark = total[hit], mark[hit]
        sort = np.argsort(back)
        back, total, mark = back[sort], np.minimum(total[sort], 255).astype(np.uint8), mark[sort]
        first = np.flatnonzero(first_of_groups(packet[back])) if len(back) else back
        if len(first):
            edges, k = np.append(first, len(back)), rem[back]
            answers = map(put, repeat(struct.pack("<i", slot)), all_gaps(edges, gi[back]), *all_keys(edges, k, wide), all_bits(edges, mark), cut(total, edges))
            rows.extend((slot, packets[p][-1], ENTRIES, data) for p, data in zip(packet[back[first]].tolist(), answers, strict=True))
    return pa.Table.from_batches([batch(rows)])


def splitter(bits: int):
    """A mapInArrow function between the levels: packets by the next bits of their keys, those of many flushes together.

    Rows are (slot, sub, flush, kind, data); a flush of -1 stands for many.
    """
    shift = U(40 - (bits - COARSE_BITS))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0

        def out():
            rows = [(slot, sub, -1, ENTRIES, put(np.array(flushes, "<i8"), *packets)) for (slot, sub), (flushes, packets) in held.items()]
            held.clear()
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _SPLIT.types, strict=True)], schema=_SPLIT)

        for b in batches:
            for slot, flush, kind, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if kind == DOCS:
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((slot, 0, flush, kind, data), _SPLIT.types, strict=True)], schema=_SPLIT)
                    continue
                at, key, wide, marked, count = get_entries(data)
                for sub, mine in by_bucket((key >> shift).astype(np.int64)):
                    flushes, packets = held.setdefault((slot, sub), ([], []))
                    flushes.append(flush)
                    packets.append(put_entries(at[mine], key[mine], wide, marked[mine], count[mine]))
                    size += len(packets[-1]) + 100
                if size >= GATHERED:
                    yield out()
                    size = 0
        yield out()

    return split


_SPLIT = pa.schema([("slot", pa.int32()), ("sub", pa.int32()), *list(_ARROW)[1:]])


class Repeated:
    """A flush with its answers: by position the key (0: not repeated), whether marked and how often; the rows' table."""

    def __init__(self, table: pa.Table) -> None:
        answers = []
        for kind, data in zip(table["kind"].to_pylist(), table["data"].to_pylist(), strict=True):
            if kind == DOCS:
                others, rep_of, *self.columns = get(data)
            else:
                answers.append(get(data))
        self.doc = np.frombuffer(self.columns[0], "<i8")
        self.length = np.frombuffer(self.columns[1], "<i8")
        self.first = np.concatenate([[0], np.cumsum(self.length)])
        n = int(self.first[-1])
        self.key, self.marked, self.count = np.zeros(n, U), np.zeros(n, bool), np.zeros(n, np.uint8)
        if answers:
            answers, at, each = by_width(answers, 1)
            slot = np.frombuffer(b"".join([a[0] for a in answers]), "<i4").astype(U) + U(1)
            self.key[at] = joined_keys(answers, 2)[0] | np.repeat(slot << U(40), each)
            self.marked[at] = joined_bits([a[4] for a in answers], each)
            self.count[at] = np.frombuffer(b"".join([a[5] for a in answers]), np.uint8)
        others, rep_of = get_gaps(others), np.frombuffer(rep_of, "<u4")
        self.key[others], self.marked[others], self.count[others] = self.key[rep_of], self.marked[rep_of], self.count[rep_of]


def exchange(df: DataFrame, gather: Callable[[pa.RecordBatch], Iterator[tuple]], bits: int, wide: bool = False) -> DataFrame:
    """PACKETS by flush: each flush's table of rows and the answers of all buckets."""
    if bits <= FINE_BITS:
        return df.mapInArrow(releasing(sender(gather, bits, wide)), PACKETS).groupBy("slot").applyInArrow(answer, PACKETS)
    # 5 bytes a key, so that the second level has bits to cut by; few partitions, so that a task gathers whole packets.
    sent = df.mapInArrow(releasing(sender(gather, COARSE_BITS, True)), PACKETS).repartition(1 << COARSE_BITS, "slot")
    cut = sent.mapInArrow(splitter(bits), "slot int, sub int, flush long, kind int, data binary")
    return cut.groupBy("slot", "sub").applyInArrow(answer, PACKETS)
