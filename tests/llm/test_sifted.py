"""The Jaccard join's first exchange sends a part of the shingles and loses no link."""

import random

import numpy as np
import pyarrow as pa
import pytest

from wayloom.llm import jaccard_join as jj


def _linked(a, b):
    return 100 * len(a & b) >= 75 * len(a | b)


def _sets(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _texts(rng):
    """Texts of all lengths with one that just links or just doesn't, and a line that many share."""
    out = []
    for i in range(60):
        words = [f"w{rng.randrange(10**9)}" for _ in range(rng.choice([3, 4, 5, 9, 20, 60, 300]))]
        a = " ".join(words)
        keep = round(len(words) * rng.choice([0.8, 0.86, 0.87, 0.9, 1.0]))
        out += [a, " ".join(words[:keep] + [f"v{rng.randrange(10**9)}" for _ in range(len(words) - keep)]), a + " one line that very many of the texts share"]
    return [*out, "", None]


def test_no_link_is_lost(spark, monkeypatch):
    rows = list(enumerate(_texts(random.Random(3))))
    sets = [_sets(t or "") for _, t in rows]
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and _linked(sets[i], sets[j]):
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    expected = [(i, len(s), up[i]) for i, s in enumerate(sets)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for few in (jj.FEW, 0):
        monkeypatch.setattr(jj, "FEW", few)
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jj.jaccard_join(docs).collect())
        assert got == expected


def test_a_third_is_sent_and_the_rest_only_of_what_may_link(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(200)) for _ in range(40)]

    class Task:
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(jj.TaskContext, "get", staticmethod(Task))
    b = pa.record_batch({"id": pa.array(range(40), pa.int64()), "text": texts})
    sizes = [sum(n for n, *_ in jj._gather(5, **how)(b)) for how in ({}, {"sift": True})]
    assert sizes[0] == 40 * 196 and sizes[1] == 40 * (196 - 147 + 17)
    monkeypatch.undo()
    # Of forty texts and a copy only the pair reaches the second exchange.
    seen = []
    settle = jj.settled
    monkeypatch.setattr(jj, "settled", lambda df, *a: (out := settle(df, *a), "shingles" in out.columns and "doc_key" in out.columns and seen.append(out.count()))[0])
    jj.jaccard_join(spark.createDataFrame([*enumerate(texts), (40, texts[7] + " x")], "doc_id long, text string")).collect()
    assert seen == [2]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 11, 12, 13, 100, 1000])
def test_linked_sets_share_the_margin(n):
    """The fewest shingles that two linked sets share are at least what either must hold to pass."""
    for m in range(n, 2 * n + 2):
        shared = int(np.ceil(75 * (n + m) / 175))
        if shared <= min(n, m) and _linked(set(range(n)), set(range(n - shared, n - shared + m))):
            assert shared >= jj._least(m) and min(jj._margin(n), jj._margin(m)) >= jj._margin(jj._least(m))
