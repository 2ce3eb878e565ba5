"""Operator 6, toxicity: a linear-chain conditional random field.

A token's features are its word and the word's first 4, 6 and 8 bytes, so
inflected forms share weight.  Labels mark documents, so tokens are labelled
first: where a feature stands in toxic documents of the training sample far
more often than in others (log-odds with a prior, over its standard
deviation), the tokens of toxic documents that have it offend.  Copies in the
sample count once.  A two-state chain (feature weights, a bias and
transitions) is trained on these token labels by gradient ascent in numpy.
Forward and backward passes over whole texts give each token's marginal; their
maximum, sum and density give the document's score by a logistic fit, and
tokens of at least even odds give the spans.

The training sample is bounded: MAX_TOXIC and MAX_CLEAN labelled documents at
most, those of least hashed doc_id, none longer than MAX_CHARS, and of either
kind no more than TOXIC_CHARS and CLEAN_CHARS together.  Of their segments of
SEGMENT words, those in which no word leans to toxic documents teach next to
nothing, and one in eight of them is taken.  Scoring reads every whole text,
in one pass without a shuffle.

Defined results: null counts as empty; a text without words gets the score of
no evidence; rows without labels never train; a document with several labels
counts as toxic if any says so, and with several texts teaches by the least of
them; without any labels of one kind all scores are
0; each row gives a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grams
from .grams import U
from .memory import release, releasing
from .store import swept

MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 1500, 3000, 50_000
TOXIC_CHARS, CLEAN_CHARS = 1_500_000, 3_000_000
#: Weights that the chain keeps at most, and bits of the table that says whether a feature may have one.
MAX_FEATURES, TABLE_BITS = 1 << 16, 23
PREFIXES = (4, 6, 8)
THRESHOLD = 0.7
#: How much a word must lean to toxic documents to label tokens: the part of what a word of all toxic and no other documents would.
LEAN = 0.58
#: Log-odds that a word must have besides: one of a language that more toxic documents are in leans surely, but little.
RATIO = 1.5
SEGMENT = 64
ROUNDS = 120
SCHEMA = "doc_id long, score double, predicted int, n_offending long, spans string"


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def _steps(first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each position t, the sequences (longest first) that reach it and their token there."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    start, counts = first[:-1][order], n[order]
    reach = len(n) - np.searchsorted(counts[::-1], np.arange(int(counts[0]) if len(counts) else 0), "right")
    for t, k in enumerate(reach):
        yield t, k, start[:k] + t


def marginals(score: np.ndarray, first: np.ndarray, trans: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginal of state 1 of every token, and (if asked) summed pair marginals, of many sequences at once.

    score: log-odds of state 1 by token; first: where each sequence starts (and
    the end); trans[i, j]: transition weights.  Ratios of the two states carry
    all there is, so each pass needs one number a token.
    """
    a = np.exp(trans)
    lift = np.exp(np.clip(score, -30, 30))
    alpha, beta = np.empty_like(lift), np.ones_like(lift)
    steps = list(_steps(first))
    r = np.empty(0)
    for t, k, at in steps:
        r = lift[at] if t == 0 else lift[at] * (a[0, 1] + a[1, 1] * r[:k]) / (a[0, 0] + a[1, 0] * r[:k])
        alpha[at] = r
    b = np.ones(int(steps[0][1]) if steps else 0)
    for (_, _, _), (_, k, after) in zip(reversed(steps[:-1]), reversed(steps[1:]), strict=True):
        x = lift[after] * b[:k]
        b[:k] = (a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x)
        beta[after - 1] = b[:k]
    odds = alpha * beta
    if not pairs:
        return odds / (1 + odds), None
    inner = np.ones(len(score), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    at = np.flatnonzero(inner)
    x, y = alpha[at - 1], lift[at] * beta[at]
    cell = np.stack([np.full(len(at), a[0, 0]), a[0, 1] * y, a[1, 0] * x, a[1, 1] * x * y])
    joint = (cell / cell.sum(0)).sum(1).reshape(2, 2) if len(at) else np.zeros((2, 2))
    return odds / (1 + odds), joint


def features(text: pa.Array) -> tuple[grams.Words, list[np.ndarray]]:
    """The words of a slice and, for each feature, the hash that every word has."""
    w = grams.words(text, grams.ALNUM, lower=True)
    size = w.end - w.start
    out = [w.hash]
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    data = np.append(fold[w.data], np.zeros(max(PREFIXES), np.uint8))
    head = np.zeros(len(w.start), U)
    for j in range(max(PREFIXES)):
        head |= np.where(size > j, data[w.start + j], 0).astype(U) << U(8 * j)
        if j + 1 in PREFIXES:
            out.append(grams.mix(head ^ U(0x5851F42D4C957F2D * (j + 1) & 0xFFFFFFFFFFFFFFFF)))
    return w, out


def _without_copies(text: pa.Array) -> np.ndarray:
    """Rows that share none of three least shingle hashes with an earlier row."""
    w = grams.words(text, grams.ALNUM, lower=True)
    g = grams.kgrams(w.hash, 3)
    seen, keep = set(), []
    for i, (lo, hi) in enumerate(zip(w.first[:-1], np.maximum(w.first[1:] - 2, w.first[:-1]), strict=True)):
        marks = {(s, int(grams.mix(g[lo:hi] ^ c).min())) for s, c in enumerate(grams.stream(9, 3))} if hi > lo else {(i, i)}
        if not marks & seen:
            keep.append(i)
        seen |= marks
    return np.array(keep, np.int64)


class Tagger:
    """Weights of the chain and of the document score."""

    def __init__(self) -> None:
        self.keys, self.weights, self.bias, self.trans = np.empty(0, U), np.empty(0), -5.0, np.zeros((2, 2))
        self.fit = np.array([-50.0, 0.0, 0.0, 0.0])

    def train(self, texts: list[str], toxic: np.ndarray, share: float) -> Tagger:
        """share: how many of all labelled documents are toxic, for the score's prior."""
        if not 0 < toxic.sum() < len(toxic):
            self.fit[0] = 50.0 if toxic.sum() else -50.0
            return self
        text = grams.as_text(pa.array(texts, pa.large_string()))
        keep = _without_copies(text)
        text, toxic = text.take(pa.array(keep)), toxic[keep]
        w, columns = features(text)
        self.chain(w.first, columns, toxic)
        x = self.evidence(marginals(self.scores(columns), w.first, self.trans, pairs=False)[0], w.first)
        y = toxic.astype(float)
        worth = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
        fit, pull = np.zeros(x.shape[1]), np.array([1e-6] + [0.02] * (x.shape[1] - 1))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ fit, -40, 40)))
            h = (x * (worth * p * (1 - p))[:, None]).T @ x + np.diag(pull)
            fit += np.clip(np.linalg.solve(h, x.T @ (worth * (y - p)) - pull * fit), -3, 3)
        self.fit = fit
        return self

    def chain(self, first: np.ndarray, columns: list[np.ndarray], toxic: np.ndarray) -> Tagger:
        """Labels the tokens of the sample and trains the chain on them."""
        doc = grams.row_of(first)
        bad_doc = toxic[doc] > 0
        n_bad, n_good = toxic.sum() + 1, len(toxic) - toxic.sum() + 1
        lean = np.zeros(len(doc))
        ids = []
        for column in columns:
            used, at = np.unique(column, return_inverse=True)
            once = np.unique(at + doc * len(used))
            bad = np.bincount(once % len(used), toxic[once // len(used)], len(used)) + 0.5
            good = np.bincount(once % len(used), minlength=len(used)) - bad + 1.0
            ratio = np.log(bad / n_bad) - np.log(good / n_good)
            z = np.where(ratio >= RATIO, ratio / np.sqrt(1 / bad + 1 / good), 0.0)
            np.maximum(lean, z[at], out=lean)
            ids.append((used, at.astype(np.int32)))
        least = LEAN * np.log((n_bad - 0.5) / n_bad * n_good / 0.5) / np.sqrt(1 / (n_bad - 0.5) + 1 / 0.5)
        offends = (lean >= least) & bad_doc
        cuts = np.concatenate([np.arange(lo, hi, SEGMENT) for lo, hi in zip(first[:-1], first[1:], strict=True)] + [first[-1:]])
        worth = np.maximum.reduceat(lean, cuts[:-1]) >= least / 2
        worth[::8] = True
        inside = np.repeat(worth, np.diff(cuts))
        cuts = np.concatenate([[0], np.cumsum(np.diff(cuts)[worth])])
        offends_in = offends[inside]
        first_of = np.zeros(len(offends_in), bool)
        first_of[cuts[:-1]] = True
        at = np.flatnonzero(~first_of)
        goal = np.array([offends_in.sum(), (offends_in[at] & ~offends_in[at - 1]).sum(), (offends_in[at] & offends_in[at - 1]).sum()], float)
        sets = []
        for used, where in ids:
            kept, where = np.unique(where[inside], return_inverse=True)
            sets.append([used[kept], where, np.zeros(len(kept)), np.full(len(kept), 1e-6), np.bincount(where, offends_in, len(kept))])
        small, small_square = np.array([-4.0, 0.0, 0.0]), np.full(3, 1e-6)
        for _ in range(ROUNDS):
            score = sum(weight[where] for _, where, weight, _, _ in sets) + small[0]
            m, pairs = marginals(score, cuts, np.array([[0.0, small[1]], [0.0, small[2]]]))
            for _, where, weight, square, target in sets:
                g = target - np.bincount(where, m, len(weight)) - 0.02 * weight
                square += g * g
                weight += 0.4 * g / np.sqrt(square)
            g = goal - np.array([m.sum(), pairs[0, 1], pairs[1, 1]]) - 0.01 * small
            small_square += g * g
            small += 0.3 * g / np.sqrt(small_square)
        keys, weights = np.concatenate([x[0] for x in sets]), np.concatenate([x[2] for x in sets])
        best = np.sort(np.argsort(-np.abs(weights), kind="stable")[:MAX_FEATURES])
        best = best[np.argsort(keys[best])]
        self.keys, self.weights, self.bias, self.trans = keys[best], weights[best], small[0], np.array([[0.0, small[1]], [0.0, small[2]]])
        return self

    def table(self) -> np.ndarray:
        """A bit for each feature that has a weight."""
        bits = np.zeros(1 << TABLE_BITS, bool)
        bits[(self.keys >> U(64 - TABLE_BITS)).astype(np.int64)] = True
        return bits

    def scores(self, columns: list[np.ndarray], table: np.ndarray | None = None) -> np.ndarray:
        """Log-odds of every token before its neighbours count."""
        table = self.table() if table is None else table
        out = np.full(len(columns[0]), self.bias)
        if len(self.keys):
            for column in columns:
                at = np.flatnonzero(table[(column >> U(64 - TABLE_BITS)).astype(np.int64)])
                place = np.minimum(np.searchsorted(self.keys, column[at]), len(self.keys) - 1)
                out[at] += np.where(self.keys[place] == column[at], self.weights[place], 0.0)
        return out

    @staticmethod
    def evidence(m: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = np.diff(first)
        full = np.flatnonzero(n)
        top, total = np.zeros(len(n)), np.zeros(len(n))
        if len(full):
            top[full], total[full] = np.maximum.reduceat(m, first[full]), np.add.reduceat(m, first[full])
        return np.stack([np.ones(len(n)), top, np.log1p(total), np.sqrt(total / (n + 1.0))], 1)

    def score(self, m: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(m, first) @ self.fit, -40, 40)))


#: Tokens whose chains run side by side: bounds the memory of a task.
TOKENS = 400_000


def _groups(tagger: Tagger, table: np.ndarray, text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows with their scores, the marginals of their tokens, and where each row's tokens start."""
    scores, firsts, begin, tokens = [], [np.zeros(1, np.int64)], 0, 0
    for lo, hi in grams.slices(text, 2 << 20):
        w, columns = features(text[lo:hi])
        scores.append(tagger.scores(columns, table))
        firsts.append(w.first[1:] + tokens)
        tokens += len(w.start)
        if tokens >= TOKENS or hi == len(text):
            first = np.concatenate(firsts)
            m, _ = marginals(np.concatenate(scores), first, tagger.trans, pairs=False)
            yield begin, hi, tagger.score(m, first), m, first
            scores, firsts, begin, tokens = [], [np.zeros(1, np.int64)], hi, 0


def _spans(text: pa.Array, m: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """How many tokens of each row offend, and their start:end code points."""
    hot = np.flatnonzero(m >= 0.5)
    row = np.searchsorted(first, hot, "right") - 1
    spans = [""] * len(text)
    for i in np.unique(row):
        one = text[int(i) : int(i) + 1]
        w = grams.words(one, grams.ALNUM, lower=True)
        points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
        at = hot[np.searchsorted(row, i) : np.searchsorted(row, i, "right")] - first[i]
        spans[i] = ",".join(f"{s}:{e}" for s, e in zip(points[w.start[at]], points[w.end[at]], strict=True))
    return np.bincount(row, minlength=len(text)), spans


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger: Tagger = shared.value
        table = tagger.table()
        for b in batches:
            text = grams.as_text(b.column(1))
            for lo, hi, value, m, first in _groups(tagger, table, text):
                n, spans = _spans(text[lo:hi], m, first)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[lo:hi].cast(pa.int64()), pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(spans, pa.string())],
                    names=["doc_id", "score", "predicted", "n_offending", "spans"],
                )

    return score


def _filter(shared, column: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger: Tagger = shared.value
        table = tagger.table()
        for b in batches:
            for lo, hi, value, _, _ in _groups(tagger, table, grams.as_text(b.column(column))):
                yield b.slice(lo, hi - lo).filter(pa.array(value < THRESHOLD))

    return keep


def train(docs: DataFrame, labels: DataFrame) -> Tagger:
    """A tagger from the bounded sample of labelled documents outside the held-out fold."""
    key = F.xxhash64("doc_id")
    known = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))
    counts = {r["toxic"]: r["n"] for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = texts.select("doc_id", F.length("text").alias("size")).filter(f"size <= {MAX_CHARS}")
    sized = known.join(sizes, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("size").alias("size"))
    chosen = []
    for kind, n, room in (("toxic > 0", MAX_TOXIC, TOXIC_CHARS), ("toxic <= 0", MAX_CLEAN, CLEAN_CHARS)):
        for r in sized.filter(kind).orderBy(key, "doc_id").limit(n).collect():
            room -= r["size"]
            if room >= 0:
                chosen.append((r["doc_id"], int(r["toxic"] > 0)))
    sample = docs.sparkSession.createDataFrame(chosen, "doc_id long, toxic int")
    rows = texts.filter(f"length(text) <= {MAX_CHARS}").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")).orderBy("doc_id").toPandas()
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    tagger = Tagger().train(rows["text"].tolist(), rows["toxic"].to_numpy(), share)
    del rows
    release()
    return tagger


def score_toxicity(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id, score, predicted, n_offending, spans (start:end code points of offending tokens)."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(releasing(_scorer(shared)), SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Trains on labels outside the held-out fold and scores every document."""
    scored = score_toxicity(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "n_offending", "spans")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, whose score is below the threshold.  No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    swept(docs.sparkSession)
    return docs.mapInArrow(releasing(_filter(shared, docs.columns.index("text"))), docs.schema)
