"""The ten operators: rows of SQL, brute-force versions, and rows that are null, empty, very long, tied or repeated."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayloom.llm import chat_format, decontaminate, exact_dedup, html_extract, jaccard_join, language_id, pii, queries, repeats, sentencepiece_codec, substring_dedup, toxicity

LONG = " ".join(f"word{i}" for i in range(4000))
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, LONG), (7, LONG + " tail"), (8, LONG), (8, LONG), (None, "no id"), (9, "x" * 50_000),
    (10, "é ß 漢字 🙂 a@b.co 1.2.3.4"), (11, "\x00\x7f"),
]


def odd(spark):
    """Odd rows with extra columns whose names operators use inside."""
    rows = [(i, t, "a", 1, 2) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, row int, doc_key int")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, data, duck, same, name):
    assert same(queries.QUERIES[name](spark, data).toPandas(), duck.execute(queries.ORACLE_SQL[name]).fetchdf())


def ids(df):
    return sorted((r.doc_id is not None, r.doc_id or 0) for r in df.select("doc_id").collect())


def test_every_row_gives_a_row(spark):
    d, want = odd(spark), sorted((i is not None, i or 0) for i, _ in ODD)
    bench = spark.createDataFrame([("i", "one"), (None, "no id"), ("n", None)], "item_id string, text string")
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    for found in (
        substring_dedup.substring_dedup(d),
        language_id.language_id(d),
        sentencepiece_codec.sentencepiece(d, columns=()),
        toxicity.toxicity(d, labels),
        exact_dedup.exact_dedup(d),
        decontaminate.decontaminate(d, bench),
        pii.find_pii(d),
        jaccard_join.jaccard_join(d),
    ):
        assert ids(found) == want


def test_empty_tables(spark):
    d = empty(spark)
    bench = spark.createDataFrame([], "item_id string, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    conversations = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for found in (
        substring_dedup.substring_dedup(d),
        chat_format.read_back(chat_format.format_chat(conversations)),
        language_id.language_id(d),
        html_extract.html_extract(pages),
        sentencepiece_codec.sentencepiece(d),
        toxicity.toxicity(d, labels),
        exact_dedup.exact_dedup(d),
        decontaminate.decontaminate(d, bench),
        pii.find_pii(d),
        jaccard_join.jaccard_join(d),
    ):
        assert found.count() == 0


def test_substring_dedup_keeps_the_first_of_overlapping_repeats(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(2, " ".join(words[5:45])), (1, " ".join(words[:30])), (3, " ".join(["a"] * 50)), (4, " ".join(words[10:29]))]
    seen, want = set(), {}
    for i, t in sorted(rows):
        w = t.split()
        gone = set()
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone |= set(range(s, s + 20))
            seen.add(key)
        want[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == want


def test_chat_round_trip_and_windows(spark):
    rows = [(1, t, ("system", "user", "assistant", "tool: x", None)[0 if t == 0 else 1 + t % 4], f"turn {t} \\ ### </turn> " + "w " * (t * 7 % 60)) for t in range(60)]
    rows += [(2, 0, "user", None), (2, 1, "assistant", "ok"), (None, 0, "assistant", "lost"), (2, 1, "assistant", "ok")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat_format.format_chat(d).orderBy("conv_id", "window").collect()
    mine = [w for w in windows if w.conv_id == 1]
    assert len(mine) > 2 and all(w.text.startswith("### System: ") and w.tokens <= chat_format.BUDGET + 70 for w in mine)
    turns = [t[:2] for w in mine for t in chat_format.parse(w.text)[w.n_repeated :]]
    assert turns == [(r or "", t) for _, _, r, t in rows[:60]]
    loss = [chat_format.unescape(w.text[x.start : x.end]) for w in mine for x in w.loss]
    assert loss == [t for _, _, r, t in rows[:60] if r == "assistant"]
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chat(d)).collect()}
    assert back[2].n_turns == 3 and back[2].loss_chars == 4 and back[None].loss_chars == 4


def test_language_of_held_out_documents(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    found = language_id.language_id(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in found)
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.95
    none = language_id.identify(spark.createDataFrame([(1, None), (2, "12 34"), (3, "")], "doc_id long, text string"), None).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_samples_are_bounded_and_do_not_depend_on_repeats_or_order(spark, data, monkeypatch):
    d = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    first = d.filter("lang = 'en' and text is not null").limit(1)
    often = d.union(first.crossJoin(spark.range(300)).drop("id")).repartition(5)
    seen = []
    for module, name in ((language_id, "Network"), (toxicity, "Tagger")):
        made = getattr(module, name)
        monkeypatch.setattr(made, "train", lambda self, x, *a, f=made.train: (seen.append(x), f(self, x, *a))[1])
    for docs in (d, often):
        language_id.train(docs)
        toxicity.train(docs, labels.repartition(3))
    assert np.array_equal(seen[0], seen[2]) and seen[1] == seen[3]
    monkeypatch.setattr(language_id, "SAMPLE", 6)
    assert language_id.train(d) is not None and len(seen[-1]) <= 6 * language_id.WINDOWS_EACH
    monkeypatch.setattr(toxicity, "CLEAN_CHARS", 5000)
    toxicity.train(d, labels)
    assert sum(map(len, seen[-1])) <= 5000 + sum(map(len, seen[1])) and len(seen[-1]) < len(seen[1])


def test_html_blocks():
    page = html_extract.Page
    assert page("<body><nav>n</nav><article><h1>T</h1><p>a  <b>b</b>\n&amp; c<p>d<aside>s</aside></article><footer>f</footer>").blocks == ["T", "a b & c", "d"]
    assert page("<ul><li>a<li>b</ul><div class=cookie-notice>no</div><form>x</form>").blocks == ["a", "b"]
    for broken in ("<", "<a", "<!-- x", "<script>if (a<b)", '<p title="a > b', "</p></div>", "&#xzz; &amp"):
        page(broken)
    assert page('<p title="a > b">q').blocks == ["q"]


def test_site_template_goes_and_copies_of_articles_stay(spark):
    rows = [(i, f"http://h.example/{i}", f"<div>Welcome</div><div><p>own text {i} that is long enough</p></div>") for i in range(8)]
    rows += [(10 + i, f"http://c.example/{i}", "<div><p>the same article on every page</p></div>") for i in range(8)]
    rows += [(30, None, None), (31, "odd url", ""), (32, "http://one.example", "<div>Welcome</div>")]
    got = {r.page_id: r.text for r in html_extract.html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "own text 3 that is long enough" and got[12] == "the same article on every page"
    assert got[30] == got[31] == "" and got[32] == "Welcome"


def test_sentencepiece_is_the_librarys_and_reads_back():
    import random

    import sentencepiece

    with open(sentencepiece_codec.MODEL, "rb") as f:
        codec = sentencepiece_codec.Codec(sentencepiece_codec.Model(f.read()))
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    r = random.Random(3)
    texts = ["", " ", "  a\n\nb ", "x" * 3000] + ["".join(r.choice("aeiou thnrs  \n\t.,éöß漢🙂") for _ in range(r.randint(1, 60))) for _ in range(600)]
    for t in texts:
        packed = np.frombuffer(codec.encode(t), "<i4").tolist()
        assert packed == library.encode(t) and codec.decode(packed) == t
    marked = "▁a▁ ▁"
    assert codec.decode(np.frombuffer(codec.encode(marked), "<i4").tolist()) == marked


def test_neighbours_join_as_the_models_merges_say():
    import random

    with open(sentencepiece_codec.MODEL, "rb") as f:
        codec = sentencepiece_codec.Codec(sentencepiece_codec.Model(f.read()))
    r = random.Random(5)
    pieces = [p for p in codec.id if 1 <= len(p) <= 8]
    pairs = [(r.choice(pieces), r.choice(pieces)) for _ in range(4000)]
    # Pieces that end where others of the vocabulary go on.
    pairs += [(p[:k], p[k:]) for p in r.sample(pieces, 2000) for k in range(1, len(p)) if p[:k] in codec.id and p[k:] in codec.id]
    assert all(codec.joins(a, b) == (codec.merged(a + b) == [a, b]) for a, b in pairs)
    assert {codec.joins(a, b) for a, b in pairs} == {True, False}


def test_viterbi_finds_the_best_path_of_a_unigram_model():
    pieces = [("<unk>", 0.0, 2), ("a", -1.0, 1), ("b", -1.5, 1), ("ab", -2.2, 1), ("ba", -2.6, 1), ("aba", -2.9, 1)]
    model = sentencepiece_codec.Model.__new__(sentencepiece_codec.Model)
    model.kind, model.dummy, model.pieces, model.unknown = sentencepiece_codec.UNIGRAM, False, pieces, 0
    codec = sentencepiece_codec.Codec(model)
    score = {p: s for p, s, _ in pieces[1:]}
    for text in map("".join, itertools.product("ab", repeat=6)):
        best = max(sum(score[p] for p in parts) for parts in splits(text, score))
        assert abs(sum(pieces[i][1] for i in codec.viterbi(text)) - best) < 1e-9


def splits(text, known):
    if not text:
        yield []
    for i in range(1, len(text) + 1):
        if text[:i] in known:
            for rest in splits(text[i:], known):
                yield [text[:i], *rest]


def test_chain_marginals_are_exact():
    r = np.random.default_rng(0)
    score, first, trans = r.normal(size=9), np.array([0, 4, 4, 9]), r.normal(size=(2, 2))
    got, pairs = toxicity.marginals(score, first, trans)
    want, both = [], np.zeros((2, 2))
    for a, b in ((0, 4), (4, 9)):
        z, sums, joint = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            e = np.exp(sum(score[a + i] * v for i, v in enumerate(y)) + sum(trans[p, q] for p, q in zip(y[:-1], y[1:], strict=True)))
            z, sums = z + e, sums + e * np.array(y)
            for p, q in zip(y[:-1], y[1:], strict=True):
                joint[p, q] += e
        want += list(sums / z)
        both += joint / z
    assert np.allclose(got, want) and np.allclose(pairs, both)


def test_toxicity_of_held_out_documents(spark):
    base = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    found = toxicity.toxicity(d, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in found)
    toxic, clean = [r.score for r in found if r.toxic], [r.score for r in found if not r.toxic]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.85
    assert np.mean([r.predicted for r in found if not r.toxic]) < 0.03
    assert np.mean([r.predicted for r in found if r.toxic]) > 0.8
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    for r in found:
        spans = [tuple(map(int, s.split(":"))) for s in r.spans.split(",") if s]
        assert len(spans) == r.n_offending and all(re.fullmatch(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", texts[r.doc_id][a:b]) for a, b in spans)
    kept = toxicity.reject_toxic(d, labels)
    assert kept.columns == d.columns and 0 < kept.count() < d.count()


def test_offending_spans_are_the_tokens_of_even_odds(spark):
    """Marginals of a hand-made chain, token by token over the whole text."""
    import math

    tagger = toxicity.Tagger()
    bad = toxicity.features(pa.array(["vile"], pa.large_string()))[1][0]
    tagger.keys, tagger.weights, tagger.bias, tagger.trans = bad, np.array([4.0]), -2.0, np.array([[0.0, 0.0], [0.0, 1.5]])
    tagger.fit = np.array([-2.0, 4.0, 0.0, 0.0])
    text = "é fine, VILE vile.  so🙂 vile"
    words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    score = [2.0 if w == "vile" else -2.0 for _, _, w in words]
    z, on = 0.0, [0.0] * len(words)
    for y in itertools.product((0, 1), repeat=len(words)):
        e = math.exp(sum(s for s, v in zip(score, y, strict=True) if v) + 1.5 * sum(p & q for p, q in itertools.pairwise(y)))
        z += e
        for i, v in enumerate(y):
            on[i] += e * v
    got = toxicity.score_toxicity(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), tagger).collect()
    assert {r.doc_id: r.spans for r in got} == {1: ",".join(f"{a}:{b}" for (a, b, _), m in zip(words, on, strict=True) if m / z >= 0.5), 2: ""}
    assert abs(got[0].score - 1 / (1 + math.exp(2 - 4 * max(on) / z))) < 1e-9


def test_exact_dedup_of_ties_and_cases(spark):
    rows = [(1, "Straße A"), (2, "straße a"), (3, "STRASSE A"), (4, "É"), (5, "é"), (6, None), (7, ""), (7, ""), (None, "Straße a")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.exact_dedup(d).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(1, 2, 3), (2, 2, 3), (None, 2, 3), (3, 3, 1), (4, 4, 1), (5, 5, 1), (6, 7, 3), (7, 7, 3)}
    assert sum(r.kept for r in got) == 5
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(d).collect()) == [2, 3, 4, 5, 7]
    plan = exact_dedup.exact_dedup(d)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_decontamination_of_short_and_shared_items(spark):
    item = " ".join(f"k{i}" for i in range(12))
    bench = spark.createDataFrame([(1, item), (2, "Hello there"), (3, item), (4, None), (5, "...")], "item_id int, text string")
    d = spark.createDataFrame([(1, f"a b {item.upper()} c"), (2, "x hello, THERE y"), (3, " ".join(item.split()[:9])), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.decontaminate(d, bench).collect()}
    assert got == {1: (15, 12, ["1", "3"]), 2: (4, 2, ["2"]), 3: (9, 0, []), 4: (0, 0, [])}


def plain_pii(t):
    """The contract's expressions, as they stand."""
    t, out = t or "", []

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if c > "4" else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    tests = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    )
    for k, (pattern, passes) in enumerate(tests):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, t) if passes(m[0])]
    out.sort()
    names = ("email", "ip", "card", "phone")
    return [sum(o[1] == k for o in out) for k in range(4)] + [hashlib.sha256(",".join(f"{names[k]}:{s}:{e}" for s, k, e in out).encode()).hexdigest()]


def test_pii_is_what_the_plain_expressions_give(spark, data):
    import random

    r = random.Random(1)
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{data}/documents.parquet").collect()]
    for i in range(1500):
        rows.append((10_000 + i, "".join(r.choice(("aZ09._%+-@ .-12345()é\n", "0123456789 -.+@a")[i % 2]) for _ in range(r.choice((5, 40, 200))))))
    rows += [(20_000, "4111 1111 1111 1111"), (20_001, None), (20_002, "1." * 3000), (20_003, "a@b" + ".c" * 5000), (20_004, "1 " * 5000), (20_005, "+1" + "(" * 5000)]
    got = {x.doc_id: [x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256] for x in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == plain_pii(t) for i, t in rows)


def test_pii_adds_validated_kinds(spark):
    rows = [(1, "GB82 WEST 1234 5698 7654 32"), (2, "GB82 WEST 1234 5698 7654 33"), (3, "my ssn is 123-45-6789"), (4, "lot 123-45-6789")]
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "iban:0:27", 2: "", 3: "ssn:10:21", 4: ""}


def test_jaccard_components_of_chains_copies_and_short_texts(spark):
    import random

    r = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    rows, doc = [], words
    for i in range(12):  # a chain: neighbours link, ends do not
        rows.append((100 - i, " ".join(doc)))
        doc = doc[4:] + [f"n{i}_{j}" for j in range(4)]
    passage = [f"p{i}" for i in range(60)]
    rows += [(200 + i, " ".join(passage + [f"q{i}_{j}" for j in range(r.randrange(5, 60))])) for i in range(25)]
    rows += [(300, "a b"), (301, "A B"), (302, "a"), (303, ""), (304, None), (305, "a b c d e"), (306, " ".join(words)), (307, "a b c")]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets, label = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] & sets[b] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == {i: (len(sets[i]), label[i]) for i in sets}


def test_r_tree_search_loses_no_pair_that_may_link():
    r = np.random.default_rng(1)
    n = r.integers(5, 60, 200)
    points = np.stack([np.bincount(r.integers(0, 16, k), minlength=16) for k in n])
    tree = jaccard_join.RTree(n, points)
    for q in range(0, 200, 7):
        low, scale = jaccard_join.needed(n[q], n)
        want = np.flatnonzero((np.minimum(points, points[q]).sum(1) * scale >= low) & (100 * n >= 75 * n[q]) & (100 * n[q] >= 75 * n))
        assert sorted(tree.search(n[q], points[q])) == want.tolist()


def test_scores_do_not_depend_on_how_rows_are_dealt(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    rows = lambda x: sorted(map(tuple, substring_dedup.substring_dedup(x).collect()))
    assert rows(d) == rows(d.repartition(7, F.col("doc_id")))
    assert pa.types.is_string(pa.string())


def test_substring_dedup_tells_rows_of_one_doc_id_apart(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (1, text("a")), (2, text("c")), (3, text("c")), (3, text("d")), (3, text("e")), (4, text("e")), (5, text("f")), (5, text("f"))]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    want = [(None, text("a")), (None, text("b")), (1, ""), (2, text("c")), (3, ""), (3, text("d")), (3, text("e")), (4, ""), (5, text("f")), (5, "")]
    assert sorted(((r.doc_id, r.kept_text) for r in got), key=repr) == sorted(want, key=repr)


def test_html_reads_attributes_one_by_one():
    page = html_extract.Page
    for kept in ('href="/hidden-cave"', 'title="a hidden gem"', 'href="/x?id=related"', 'data-id="share"', "title='class=ad'", 'data-class="ad" x', "href=/a?class=promo", 'alt = "role=search" b', 'title="it\'s hidden"'):
        assert page(f"<section {kept}>text</section>").blocks == ["text"], kept
    for gone in ("hidden", "HIDDEN=''", 'class="x ad"', "id=share", "class = 'a promo'", 'role="search"', 'style="display: none"', 'title="a" hidden', 'a="x"class="ad"', 'aria-hidden=true', 'href=/x class=ad', "title='a' id = \"related\""):
        assert page(f"<section {gone}>text</section>").blocks == [], gone


def test_copies_of_articles_keep_headings_and_lists(spark):
    article = "<h1>Heading</h1><p>the first paragraph of an article that many pages hold</p><ul><li>one</ul><blockquote>said</blockquote><table><tr><td>cell</table><p>and a last paragraph {}</p>"
    box = "<div>Read on</div>"
    rows = [(i, f"http://a.example/{i}", f"<main>{article.format('x' * (i % 2))}{box}</main>") for i in range(8)]
    rows += [(10 + i, f"http://a.example/o{i}", f"<article><h2>Own {i}</h2><p>own text {i} that is long enough</p>{box}</article>") for i in range(8)]
    rows += [(20 + i, f"http://b.example/{i}", f"<main><div>Always here</div><p>own text {i} that is long enough</p></main>") for i in range(8)]
    got = {r.page_id: r.text.split("\n") for r in html_extract.html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # The copies keep all but the box, which other articles of the host have too.
    assert got[0] == ["Heading", "the first paragraph of an article that many pages hold", "one", "said", "cell", "and a last paragraph"] and got[1][:5] == got[0][:5] and len(got[1]) == 6
    assert got[12] == ["Own 2", "own text 2 that is long enough"] and got[23] == ["own text 3 that is long enough"]


@pytest.mark.parametrize("keep", ["largest", "least"])
def test_texts_that_share_a_digest_are_told_apart_by_their_bytes(spark, data, keep):
    """Digests of three bits: every one holds many texts."""
    d = spark.read.parquet(f"{data}/documents.parquet").limit(120)
    d = d.union(d.limit(40).select(F.expr("doc_id + 100000").alias("doc_id"), *d.columns[1:]))
    rows = lambda bits: sorted(map(tuple, exact_dedup.exact_dedup(d, keep, bits).collect()))
    assert rows(3) == rows(64) and any(r[2] > 1 for r in rows(64))


def test_levels_compact_with_later_runs(spark):
    run = lambda ids: exact_dedup.flush(spark.createDataFrame([(i, 100 + i, f"text {i % 3}") for i in ids], "doc_key long, row long, text string"))
    whole = exact_dedup.compact(run(range(9)), keep="least")
    parts = exact_dedup.compact(exact_dedup.compact(run(range(4)), keep="least"), run(range(4, 9)), keep="least")
    assert sorted(whole.collect()) == sorted(parts.collect()) and {r.stays.doc_key for r in whole.collect()} == {0, 1, 2}


def test_a_full_filter_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_FILTER_BITS", 10)
    d = odd(spark)
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_dedup(d).collect()} >= {(5, 5), (4, 5), (6, 8), (8, 8)}
    assert exact_dedup.drop_copies(d).count() == len({(t or "").lower() for _, t in ODD})


@pytest.mark.parametrize("bits", [7, 16])
def test_exchanges_of_one_and_two_levels_give_the_same_rows(spark, data, monkeypatch, bits):
    monkeypatch.setattr(repeats, "bucket_bits", lambda df: bits)
    d = spark.read.parquet(f"{data}/documents.parquet")
    got = [sorted(map(tuple, f(d).collect())) for f in (substring_dedup.substring_dedup, jaccard_join.jaccard_join)]
    monkeypatch.undo()
    assert got == [sorted(map(tuple, f(d).collect())) for f in (substring_dedup.substring_dedup, jaccard_join.jaccard_join)]


def test_split_groups_lose_no_link(spark, monkeypatch):
    """Texts that share passages, some of which link: limits so small that groups are split twice and searched in many cells."""
    import random

    monkeypatch.setattr(jaccard_join, "SPLIT", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    r = random.Random(11)
    passages = [[f"p{k}_{i}" for i in range(16)] for k in range(9)]
    rows = []
    families = [r.sample(range(9), 4) for _ in range(20)]
    for i in range(60):
        own = [w for k in families[i % 20] for w in passages[k]]
        if i >= 20:
            own[r.randrange(len(own))] = "x"
        rows.append((i, " ".join(own)))

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}

    sets, label = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    split = []
    settle = jaccard_join.settled
    monkeypatch.setattr(jaccard_join, "settled", lambda df, *a: (split.append(df.columns == ["key", "node", "at", "depth"]), settle(df, *a))[1])
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in got} == label and len(links) > 5
    assert sum(split) >= 2
