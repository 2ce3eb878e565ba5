"""Operator 10, n-gram Jaccard join: count-vector R-tree.

1. Two sets that link share, in the order of any hash, l of the first
   n - ceil(0.75 n) + l of either.  A first packed exchange (`repeats`) of so
   many, about a third, says how many of them other documents send; a
   document with fewer than such a pair shares has no link and is done.
   For the rest a second one tells each which of all its shingles others of
   them have, and how many.  A pair that links shares at least three quarters
   of either set, so a document with fewer repeated shingles has no link; of
   the others only the repeated shingles can be shared.
2. Documents with equal sets (128-bit digest) are one class; classes go on.
3. Rarest shingles first, two sets that link share one of their first
   n - ceil(0.75 n) + 1.  Classes that share such a shingle form a group.
4. In each group every class is first held against the least one.  Groups
   that still hold several components (one of those with equal members) are
   searched with an R-tree: shingles hashed into 1024 coordinates give a point
   of counts; the sum of coordinate minima of two points, or of a point and a
   node's upper corner, bounds the overlap.  Surviving pairs are verified on
   the sets.  A group first gives twice as many pairs as it has members, then
   only edges of a spanning forest, and the search goes on until no surviving
   pair of two components is untested, so no link that could join two
   components is lost and no group gives all its pairs.
5. Only members outside a group's largest component look for partners.  Where
   they are more than SPLIT, the group is split: linked sets share three
   shingles at least, and the first l they share, in the common order, are
   among the first n - ceil(0.75 n) + l of either, so members meet again by
   their next shingle, and by the next but one.  What is left is searched in
   cells of bounded size.

Defined results: null texts and texts without words have no shingles and no
links; texts of fewer words than a shingle have their whole word sequence as
one; each row gives a row; a null doc_id sorts before all others; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams, repeats
from .components import components
from .grams import U
from .memory import releasing
from .store import settled, swept
from .substring_dedup import NULL_KEY

SHINGLE = 5
#: A set of n shingles sends 1 + n // SIFTED more than may differ from a linked set.
SIFTED = 12
#: Documents that the second exchange picks by a broadcast of their keys, at most; of more than these it takes all.
FEW = 1 << 20
#: Links: DEN * shared >= NUM * union.
NUM, DEN = 75, 100
DIMENSIONS = 1024
LEAF = 32
BLOCK = 1024
#: Pairs a group gives per member before it only gives spanning edges.
FREE = 2
#: Members outside its largest component that a group may have before it is split, and by how many shingles at most.
SPLIT, DEPTH = 4096, 3
#: Rows of one search task, about.
SEARCHED = 8192
_SET = 7  # bytes of a shingle's key
WORD = 7  # bytes of a word and what follows it, about


def _least(n):
    """How many shingles of n a linked set shares at least."""
    return -(-NUM * n // DEN)


def _margin(n):
    return 1 + n // SIFTED


def _gather(k: int, sift: bool = False):
    """Arguments of Gathered.add for slices of a batch; sift: only each set's first shingles in the order of their keys, mixed so that buckets are even."""

    def gather(b: pa.RecordBatch) -> Iterator[tuple]:
        ids, text = np.asarray(b.column(0)), grams.as_text(b.column(1))
        part = TaskContext.get().partitionId()
        for lo, hi in grams.slices(text):
            w = grams.words(text[lo:hi], lower=True)
            n = np.diff(w.first)
            row_of_word = grams.row_of(w.first)
            keys, rows = [], []
            for m in range(1, k + 1):
                g = grams.kgrams(w.hash, m, seed=20)
                row = row_of_word[: len(g)]
                fits = np.flatnonzero((row == row_of_word[m - 1 :][: len(g)]) & (True if m == k else n[row] == m)) if len(g) else np.empty(0, np.int64)
                keys.append(g[fits])
                rows.append(row[fits])
            key, row = np.concatenate(keys), np.concatenate(rows)
            order = np.argsort(key)
            order = order[np.argsort(row[order].astype(np.uint16) if hi - lo < 65536 else row[order], kind="stable")]
            key, row = key[order], row[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
            key, row = key[new], row[new]
            first = np.searchsorted(row, np.arange(hi - lo + 1))
            with np.errstate(over="ignore"):
                sums = [np.concatenate([np.zeros(1, U), np.cumsum(grams.mix(key ^ c), dtype=U)]) for c in grams.stream(5, 2)]
                digests = [(s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums]
            # A node is a row: where it was read, so that rows that share a doc_id stay apart.
            node = np.arange(gather.rows, gather.rows + hi - lo, dtype=np.int64) + (part << 40)
            gather.rows += hi - lo
            n = np.diff(first)
            tables = [node, n.astype("<i8"), *digests, ids[lo:hi].astype("<i8")]
            if sift:
                sent = np.minimum(n, n - _least(n) + _margin(n))
                key = grams.mix(key[np.arange(len(key)) - first[row] < sent[row]])
                tables = [node, sent.astype("<i8"), *tables[2:], tables[1]]
            yield len(key), key, np.arange(len(key)), np.zeros(len(key), bool), tables

    gather.rows = 0
    return gather


def pack_keys(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_SET].tobytes()


def unpack_keys(packed: bytes) -> np.ndarray:
    raw = np.zeros((len(packed) // _SET, 8), np.uint8)
    raw[:, :_SET] = np.frombuffer(packed, np.uint8).reshape(-1, _SET)
    return raw.view("<u8").ravel()


_KNOWN = "doc_key long, n long, d1 long, d2 long, may boolean"


def _sifted(table: pa.Table) -> pa.Table:
    """A flush of the first exchange: its documents, and whether they may link."""
    r = repeats.Repeated(table)
    d1, d2, doc_key, n = (np.frombuffer(c, "<i8") for c in r.columns[2:])
    held = np.diff(np.concatenate([[0], np.cumsum(r.key != 0)])[r.first])
    empty = n == 0
    may = (held >= _margin(_least(n))) & ~empty
    return pa.table({"doc_key": doc_key, "n": n, "d1": np.where(empty, r.doc, d1), "d2": np.where(empty, -1, d2), "may": may})


_DOC = "node long, doc_key long, n long, d1 long, d2 long, shingles binary"


def _repeated(table: pa.Table) -> pa.Table:
    """A flush: its documents, with their repeated shingles, rarest first, if those may link."""
    r = repeats.Repeated(table)
    d1, d2, doc_key = (np.frombuffer(c, "<i8") for c in r.columns[2:])
    held = np.concatenate([[0], np.cumsum(r.key != 0)])[r.first]
    may = (DEN * np.diff(held) >= NUM * r.length) & (r.length > 0)
    sets = []
    for i in range(len(r.doc)):
        if not may[i]:
            sets.append(None)
            continue
        key, count = r.key[r.first[i] : r.first[i + 1]], r.count[r.first[i] : r.first[i + 1]]
        key, count = key[key != 0], count[key != 0]
        sets.append(pack_keys(key[np.lexsort((key, count))]))
    empty = r.length == 0
    return pa.table(
        {"node": r.doc, "doc_key": doc_key, "n": r.length, "d1": np.where(empty, r.doc, d1), "d2": np.where(empty, -1, d2), "shingles": pa.array(sets, pa.binary())}
    )


def needed(n_a, n_b):
    """Twice-scaled test of a link: shared * this[1] >= this[0]."""
    return NUM * (n_a + n_b), NUM + DEN


_ENTRY = "key long, node long, at int, depth int"


def _prefix(n: int, packed: bytes, depth: int) -> int:
    """How many of a set's repeated shingles hold the first `depth` that it shares with a linked set."""
    return max(0, min(n - _least(n) + depth - (n - len(packed) // _SET), len(packed) // _SET))


def _entries(keys: list, nodes: list, places: list, depth: list) -> pa.RecordBatch:
    columns = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, nodes, places, depth)]
    return pa.RecordBatch.from_arrays([pa.array(columns[0].astype(np.int64)), pa.array(columns[1].astype(np.int64)), pa.array(columns[2].astype(np.int32)), pa.array(columns[3].astype(np.int32))], names=["key", "node", "at", "depth"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, at, depth) for the shingles of which linked sets must share one."""
    for b in batches:
        parts = [], [], [], []
        for node, n, packed in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            p = _prefix(n, packed, 1)
            for part, x in zip(parts, (unpack_keys(packed[: p * _SET]).view(np.int64), np.full(p, node), np.arange(p), np.ones(p, np.int64)), strict=True):
                part.append(x)
        yield _entries(*parts)


def _deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of groups to be split, by node: one for each later shingle that may be the next shared one."""
    for b in batches:
        parts = [], [], [], []
        for node, n, packed, hot in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            tokens = unpack_keys(packed)
            for e in hot:
                later = np.arange(e["at"] + 1, _prefix(n, packed, e["depth"] + 1))
                with np.errstate(over="ignore"):
                    key = grams.mix(tokens[later] * U(0x9E3779B97F4A7C15) + grams.mix(np.array([e["key"]], np.int64).view(U)))
                for part, x in zip(parts, (key.view(np.int64), np.full(len(later), node), later, np.full(len(later), e["depth"] + 1)), strict=True):
                    part.append(x)
        yield _entries(*parts)


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n, point): counts of a set's shingles by hashed coordinate."""
    for b in batches:
        points = []
        for packed in b.column(2).to_pylist():
            at = grams.mix(unpack_keys(packed)) >> U(64 - DIMENSIONS.bit_length() + 1)
            count = np.bincount(at.astype(np.int64), minlength=DIMENSIONS)
            points.append(count.astype("<u1" if count.max(initial=0) < 256 else "<u4").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(points, pa.binary())], names=["node", "n", "point"])


class RTree:
    """Points packed by size into leaves; each node keeps its upper corner and its sizes' range."""

    def __init__(self, n: np.ndarray, points: np.ndarray) -> None:
        self.order = np.lexsort((points[:, 0], n))
        self.n, self.points = n[self.order], points[self.order]
        at = np.arange(0, len(n), LEAF)
        self.levels = [(np.maximum.reduceat(self.points, at), np.minimum.reduceat(self.n, at), np.maximum.reduceat(self.n, at))]
        while len(self.levels[-1][1]) > LEAF:
            top, least, most = self.levels[-1]
            at = np.arange(0, len(least), LEAF)
            self.levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)))

    def search(self, n: int, point: np.ndarray) -> np.ndarray:
        """Indices of all points whose set may link with a set of n shingles at `point`."""
        at = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, least, most = self.levels[depth]
            low, scale = needed(n, least[at])
            at = at[(np.minimum(top[at], point).sum(1) * scale >= low) & (DEN * most[at] >= NUM * n) & (DEN * n >= NUM * least[at])]
            size = len(self.levels[depth - 1][1]) if depth else len(self.n)
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()  # the points or nodes below
            at = at[at < size]
        low, scale = needed(n, self.n[at])
        at = at[(np.minimum(self.points[at], point).sum(1) * scale >= low) & (DEN * self.n[at] >= NUM * n) & (DEN * n >= NUM * self.n[at])]
        return self.order[at]


def spanning_pairs(node, n, points, label, left, right, refuted) -> list[tuple[int, int]]:
    """Edges of a spanning forest over the components of surviving pairs that are not refuted yet."""
    up: dict = {}

    def root(x):
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    pairs: list[tuple[int, int]] = []
    if not len(left) or not len(right):
        return pairs
    tree = RTree(n[right], points[right])
    free = FREE * (len(left) + len(right))
    for q in left:
        for c in right[tree.search(n[q], points[q])]:
            a, b = root(label[q]), root(label[c])
            if a != b and node[c] not in refuted[q]:
                if len(pairs) >= free:
                    up[max(a, b)] = min(a, b)
                pairs.append((min(node[q], node[c]), max(node[q], node[c])))
    return pairs


def _search(table: pa.Table) -> pa.Table:
    """Cells of groups: surviving pairs of different components.  role: 1 looks for partners, 2 may be one, 3 both."""
    t = table.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending")])
    key, i, j, node, n, label, role = (t[c].to_numpy() for c in ("key", "i", "j", "node", "n", "label", "role"))
    points = np.stack([np.frombuffer(x, "<u1" if len(x) == DIMENSIONS else "<u4").astype(np.int32) for x in t["point"].to_pylist()])
    refuted = [set(x or ()) for x in t["refuted"].to_pylist()]
    cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    pairs = set()
    for lo, hi in zip(cut, np.append(cut[1:], len(key)), strict=True):
        rows = np.arange(lo, hi)
        pairs.update(spanning_pairs(node, n, points, label, rows[role[rows] & 1 > 0], rows[role[rows] & 2 > 0], refuted))
    u, v = zip(*sorted(pairs), strict=True) if pairs else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _open_groups(labelled: DataFrame) -> DataFrame:
    """The groups of several components: key, m members, s outside the largest component, `mass`."""
    by_label = labelled.groupBy("key", "label").agg(F.count("*").alias("m"), F.max("depth").alias("depth"), F.bit_xor(F.xxhash64("node")).alias("s1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("s2"))
    largest = F.max(F.struct("m", "label"))
    groups = by_label.groupBy("key").agg(
        F.count("*").alias("labels"), F.sum("m").alias("m"), largest.alias("mass"), F.max("depth").alias("depth"), F.bit_xor("s1").alias("s1"), F.bit_xor("s2").alias("s2")
    )
    return groups.filter("labels > 1").select("key", "m", (F.col("m") - F.col("mass.m")).alias("s"), F.col("mass.label").alias("mass"), "depth", "s1", "s2")


def _cells(labelled: DataFrame, groups: DataFrame) -> DataFrame:
    """Every member of an open group in the cells (i, j) where block i of those who look meets block j of all members."""
    spread = labelled.select("key", "node", "label").join(groups, "key")
    spread = spread.withColumn("rows", F.expr(f"cast(ceil(s / {BLOCK}) as int)")).withColumn("columns", F.expr(f"cast(ceil(m / {BLOCK}) as int)"))
    spread = spread.withColumn("i0", F.expr("cast(pmod(xxhash64(node, 7), rows) as int)")).withColumn("j0", F.expr("cast(pmod(xxhash64(node), columns) as int)"))
    looks = "transform(sequence(0, columns - 1), c -> named_struct('i', i0, 'j', c, 'role', 1 + if(c = j0, 2, 0)))"
    found = "transform(sequence(0, rows - 1), r -> named_struct('i', r, 'j', j0, 'role', 2))"
    cells = F.expr(f"if(label = mass, {found}, concat({looks}, filter({found}, x -> x.i <> i0)))")
    return spread.select("key", "node", "label", F.inline(cells))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = []
        for n_u, n_v, s_u, s_v in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True):
            shared = len(np.intersect1d(unpack_keys(s_u), unpack_keys(s_v), assume_unique=True))
            ok.append(DEN * shared >= NUM * (n_u + n_v - shared))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], names=["u", "v", "ok"])


def _verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """u, v, ok: the exact test on the sets."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("shingles").alias(f"s_{x}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "n_u", "n_v", "s_u", "s_v")
    return settled(both.mapInArrow(releasing(_verify), "u long, v long, ok boolean"))


def jaccard_join(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of 0.75 or more.

    docs: doc_id long, text string.  Returns doc_id, n_shingles, component_id
    (least doc_id that links reach), class_id (least doc_id with the same set).
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY))
    swept(docs.sparkSession)
    rows = docs.select(key.alias("doc_key"), F.col("text").cast("string").alias("text"))
    bits = repeats.bucket_bits(docs.select("doc_id", "text"))
    known = settled(repeats.exchange(rows, _gather(shingle, sift=True), max(7, bits - 2)).groupBy("flush").applyInArrow(_sifted, _KNOWN))
    swept(docs.sparkSession)
    passed = known.filter("may")
    n, shingles = passed.agg(F.count("*"), F.sum("n")).first()
    if n <= FEW:
        # Rows that share a key with one that passed come along.
        rows = rows.join(F.broadcast(passed.select("doc_key").distinct()), "doc_key", "left_semi")
        bits = repeats.bits_of(WORD * (shingles or 0))
    # Half as many buckets as texts are dealt to: a bucket holds keys only, and packets, which are flushes times buckets, have each their own cost.
    documents = settled(repeats.exchange(rows, _gather(shingle), max(7, bits - 1), wide=True).groupBy("flush").applyInArrow(_repeated, _DOC))
    swept(docs.sparkSession)
    may_link = documents.filter(F.col("shingles").isNotNull())
    classes = settled(
        may_link.groupBy("d1", "d2").agg(F.min("node").alias("node"), F.first("n").alias("n"), F.first("shingles").alias("shingles"), F.min("doc_key").alias("class_key"))
    )
    entries = settled(classes.select("node", "n", "shingles").mapInArrow(releasing(_prefixes), _ENTRY))
    groups = entries.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("m")).filter("m > 1")
    pairs = entries.join(groups, "key").filter("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v")).distinct()
    tested = more = _verified(pairs, classes)
    labels = None
    points = classes.select("node", "n", "shingles").mapInArrow(releasing(_points), "node long, n long, point binary")
    while True:
        if labels is None or not more.filter("ok").isEmpty():
            labels = settled(components(tested.filter("ok").select("u", "v")))
        labelled = entries.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        open_groups = settled(_open_groups(labelled))
        large = open_groups.filter(f"s > {SPLIT} and depth < {DEPTH}").select("key")
        if not large.isEmpty():
            hot = entries.join(large, "key").groupBy("node").agg(F.collect_list(F.struct("key", "at", "depth")).alias("hot"))
            split = classes.select("node", "n", "shingles").join(hot, "node").mapInArrow(_deeper, _ENTRY)
            entries = settled(entries.join(open_groups.select("key"), "key").join(large, "key", "left_anti").unionByName(split))
            more = more.limit(0)
            continue
        # Groups of equal members are searched once.  They are split each: a pair meets by the shingles that it shares first.
        open_groups = open_groups.groupBy("m", "s1", "s2").agg(F.min(F.struct("key", "s", "mass")).alias("one")).select("m", "one.*")
        refuted = tested.filter("not ok")
        refuted = refuted.select("u", "v").union(refuted.select("v", "u")).groupBy(F.col("u").alias("node")).agg(F.collect_set("v").alias("refuted"))
        size = open_groups.agg(F.sum(F.expr(f"m * ceil(s / {BLOCK}) + s * ceil(m / {BLOCK})"))).first()[0] or 0
        searched = _cells(labelled, open_groups).join(points, "node").join(refuted, "node", "left").withColumn("slot", F.expr(f"pmod(xxhash64(key, i, j), {max(64, size // SEARCHED)})"))
        found = settled(searched.groupBy("slot").applyInArrow(_search, "u long, v long").distinct())
        if found.isEmpty():
            break
        more = _verified(found, classes)
        tested = settled(tested.union(more))
    component = (
        classes.select("d1", "d2", "node", "class_key").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    )
    least = component.groupBy("label").agg(F.min("class_key").alias("component_key"))
    component = component.join(least, "label").select("d1", "d2", "class_key", "component_key")
    real = lambda c: F.when(F.col(c) != NULL_KEY, F.col(c))
    return (
        known.select("doc_key", "n", "d1", "d2")
        .join(component, ["d1", "d2"], "left")
        .select(
            real("doc_key").alias("doc_id"),
            F.col("n").alias("n_shingles"),
            F.expr(f"nullif(coalesce(component_key, doc_key), {NULL_KEY})").alias("component_id"),
            F.expr(f"nullif(coalesce(class_key, doc_key), {NULL_KEY})").alias("class_id"),
        )
    )
