"""Stages of the corpus pipeline, each against a plain version on its own input."""

import hashlib
import re
import string

import corpus_pipeline
from wayloom.llm import toxicity


def lower(t):
    return (t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_each_stage(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").cache()
    stages = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}
    assert list(stages) == ["toxicity", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding and decoding"]

    kept = stages["toxicity"](spark, docs, data)
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{data}/labels.parquet")).collect()
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in scored if not r.predicted}

    best = {}
    for i, r in rows.items():
        best[lower(r.text)] = max(best.get(lower(r.text), i), i)
    kept = stages["exact dedup"](spark, docs, data)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(best.values())

    sets = {i: shingles(r.text) for i, r in rows.items()}
    label = {i: i for i in sets}
    where: dict = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    near = {(a, b) for v in where.values() for a in v for b in v if a < b}
    links = [(a, b) for a, b in near if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]
    for _ in sets:
        if all(label[a] == label[b] for a, b in links):
            break
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    kept = stages["n-gram Jaccard join"](spark, docs, data)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in label if label[i] == i}

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    items = [words(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + min(10, len(w))]) for w in items if w for i in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(w) for w in windows}
    clean = {i for i, r in rows.items() if not any(tuple(w[j : j + m]) in windows for w in [words(r.text)] for m in sizes for j in range(len(w) - m + 1))}
    kept = stages["benchmark decontamination"](spark, docs, data)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == clean

    coded = {r.doc_id: r for r in stages["SentencePiece encoding and decoding"](spark, docs, data).collect()}
    assert all(r.round_trip and r.text_sha256 == hashlib.sha256(rows[i].text.encode()).hexdigest() and len(r.ids) == r.n_tokens for i, r in coded.items())


def test_run(spark, data):
    found = corpus_pipeline.run(spark, data).collect()
    assert 0 < len(found) < spark.read.parquet(f"{data}/documents.parquet").count() and all(r.round_trip for r in found)


def test_stages_decide_by_row(spark, data, tmp_path):
    """Null and repeated doc_ids: unrelated rows of a key stay, near copies and contaminated ones go."""
    item = next(r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect() if len(r.text.split()) >= 10)
    text = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    rows = [(None, text("a")), (None, text("a") + " more"), (None, text("b")), (5, text("c")), (5, text("d")), (4, text("c") + " more"), (None, f"{text('p')} {item}"), (7, f"{text('q')} {item}"), (7, text("e"))]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    made.repartition(3).write.parquet(str(tmp_path / "docs"))
    stages = dict(corpus_pipeline.STAGES)
    for docs in (made, spark.read.parquet(str(tmp_path / "docs"))):
        kept = sorted((tuple(r) for r in stages["n-gram Jaccard join"](spark, docs, data).collect()), key=repr)
        # Of two near copies without doc_id either may stay.
        assert [r for r in kept if not (r[1] or "").startswith("a0 ")] == sorted([r for r in rows[2:] if r != rows[3]], key=repr) and len(kept) == len(rows) - 2
        kept = stages["benchmark decontamination"](spark, docs, data).collect()
        assert sorted(map(tuple, kept), key=repr) == sorted([r for r in rows if item not in r[1]], key=repr)
