"""The training-data operators against libraries and brute force."""

import hashlib
import itertools
import html
import math
import os
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from estuarine.llm import htmltext, linededup, lm, neardup, nndescent, packing, qualityrules, sentencepieces, suffixdedup, tokencounts
from estuarine.llm.common import tokenizer_path
from estuarine.llm.suffixes import permuted_prefixes, suffix_array
from estuarine.llm.unionfind import components
from tests.llm import helpers

os.environ["TOKENIZERS_PARALLELISM"] = "false"
SF = "/root/testdata/sf0.001"
WORDS, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"
LONG = " ".join(f"word{i} and the rest" for i in range(9000))
SHARED = "A passage that several documents share word for word, long enough to be found again anywhere it is put. " * 3
#: Null ids, null, empty and long texts, repeated rows, ties, special strings, odd white space and scripts.
EDGES = [
    (1, "A plain text with a few words."), (1, "A plain text with a few words."), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, LONG), (None, "No id here, but words."), (None, None),
    (7, "<|endoftext|> inside, <s> and </s> too"), (8, "ΣΊΣΥΦΟΣ İstanbul ﬁne é ▁ x▁y"), (9, "tabs\tand\x1cother\x85spaces here  two"), (10, "don't it's we'll 12 345 ...!!! 'S"),
    (11, "中文 и кириллица 🙂🙂"), (12, "x" * 700), (13, "start " + SHARED + " end"), (14, "another " + SHARED + " finish"), (15, "ab" * 400), (16, "a\0b"),
]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def edges(spark):
    """The odd rows, with more columns whose names the operators use for themselves."""
    rows = [(i, t, None if i == 3 else "s", i, "k", True, i) for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n long, key string, kept boolean, id long")


@pytest.fixture(scope="module")
def empty(edges):
    return edges.limit(0)


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# 1 quality rules


def test_quality_base(spark, documents, texts):
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1")
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for r in qualityrules.quality_rules(documents, labels).collect():
        want = helpers.base_rules(texts[r["doc_id"]])
        assert tuple(r[c] for c in cols) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_quality_verdict(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = qualityrules.quality_rules(docs, labels.filter("quality = 1")).join(labels, "doc_id").filter("not base_failed").collect()
    good, bad = [r for r in got if r["quality"] == 1], [r for r in got if r["quality"] == 0]
    assert all(r["kept"] for r in good)
    assert sum(r["kept"] for r in bad) < 0.2 * len(bad)


def test_quality_ratio(spark):
    """The mean log ratio, by hand."""
    docs = spark.createDataFrame([(i, "good words only here " * 3) for i in range(3)] + [(i, f"junk{i} ## junk ## " * 4) for i in range(3, 6)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in qualityrules.quality_rules(docs, docs.filter("doc_id < 3")).collect()}
    assert got[0]["llr"] > 0 > got[4]["llr"] and got[0]["llr"] == got[1]["llr"]


def test_quality_edges(edges, empty):
    got = qualityrules.quality_rules(edges, edges.filter("doc_id = 5"), keep=("source", "id"))
    want = sorted([(i, *helpers.base_rules(t)) for i, t in EDGES], key=repr)
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    assert "id" in got.columns
    nothing = qualityrules.quality_rules(edges, empty)
    assert all(r["llr"] == 0 and r["kept"] != r["base_failed"] for r in nothing.collect())
    assert qualityrules.quality_rules(empty, empty).count() == 0


# 2 packing, 3 token counts


def library_ids(text):
    from tokenizers import Tokenizer

    global _library
    if "_library" not in globals():
        _library = Tokenizer.from_file(tokenizer_path(WORDS))
    return _library.encode(text or "", add_special_tokens=False).ids


def check_packed(rows, ids, window=4096):
    """Every id in one piece, sequences without gaps, no padding needed."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(ids)
    for doc, got in pieces.items():
        full, at = np.array(ids[doc], "<u4"), 0
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(full)
            assert r["ids_crc32"] == zlib.crc32(full[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(full)
    total = 0
    for got in sequences.values():
        at = 0
        for r in sorted(got, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == window or at & (at - 1) == 0 and at < window
        total += at
    assert sorted(sequences) == list(range(len(sequences)))
    return sequences


def test_packing(documents, texts):
    ids = {i: [*library_ids(t), 2] for i, t in texts.items()}
    rows = packing.pack(documents, tokenizer_path(WORDS), chunk=2000).collect()
    sequences = check_packed(rows, ids)
    share = Counter()
    for r in rows:
        share[r["source"]] += r["length"]
    total = sum(share.values())
    for s, got in sequences.items():
        if sum(r["length"] for r in got) == 4096:  # every window has the mixture of the whole
            here = Counter()
            for r in got:
                here[r["source"]] += r["length"]
            assert all(abs(here[k] - 4096 * v / total) <= 2 for k, v in share.items()), s


def test_packing_targets(spark):
    """Unequal targets hold until a queue runs dry; then the others share its part."""
    docs = spark.createDataFrame([(i, "one two three four five " * 9, "a" if i % 3 else "b") for i in range(300)], "doc_id long, text string, source string")
    rows = packing.pack(docs, tokenizer_path(WORDS), window=256, targets={"a": 0.25, "b": 0.75}, chunk=500).collect()
    by = defaultdict(Counter)
    for r in rows:
        by[r["sequence_id"]][r["source"]] += r["length"]
    assert all(abs(by[w]["b"] - 192) <= 1 for w in range(20))
    assert set(by[max(by)]) == {"a"}
    check_packed(rows, {i: [*library_ids("one two three four five " * 9), 2] for i in range(300)}, 256)


def test_packing_edges(edges, empty):
    ids = {}
    for i, t in EDGES:
        ids[i] = [*library_ids(t), 2]
    rows = [r for r in packing.pack(edges, tokenizer_path(WORDS)).collect() if r["doc_id"] not in (1, None)]
    for doc in {i for i, _ in EDGES} - {1, None}:
        assert sum(r["length"] for r in rows if r["doc_id"] == doc) == len(ids[doc])
    assert packing.pack(empty, tokenizer_path(WORDS)).count() == 0


def test_token_counts(documents, texts, edges, empty):
    got = tokencounts.token_counts(documents, tokenizer_path(WORDS))
    assert rows_of(got, "doc_id", "n_tokens") == sorted([(i, len(library_ids(t))) for i, t in texts.items()], key=repr)
    got = tokencounts.token_counts(edges, tokenizer_path(WORDS), limit=5)
    want = [(i, len((t or "").encode()), n := len(library_ids(t)), n > 5) for i, t in EDGES]
    assert rows_of(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert tokencounts.token_counts(empty, tokenizer_path(WORDS)).count() == 0


# 4 language model


def test_language_model(spark, edges, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").union(edges.select("doc_id", "text"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    out = [lm.score(docs, held_out, most=m).collect() for m in (1_000_000, 2000)]
    words, train, counts = [], [], Counter()
    for r in docs.collect():
        words.append((r["doc_id"], [*(r["text"] or "").encode().lower().split(), b""]))
        if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1:
            counts.update(words[-1][1])
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)) for i, w in words), key=repr)
    for got in out:
        assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got), key=repr) == want
    held = [r for r in out[0] if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # the model predicts unseen texts better
    assert np.allclose(sorted(r["score"] for r in out[0]), sorted(r["score"] for r in out[1]))
    assert lm.score(empty, held_out).count() == 0
    alone = lm.score(edges, F.lit(True)).collect()
    assert all(abs(r["base_score"]) < 1e-6 and r["n_known"] == 0 for r in alone)


def test_language_model_is_fitted_to_all_triples():
    """A triple far too rare to be drawn moves the model, and the order of the table doesn't."""
    rng = np.random.default_rng(4)
    triple, count = np.arange(0, lm.CLASSES**3, 997), rng.integers(10**6, 10**7, len(range(0, lm.CLASSES**3, 997)))
    base, back = lm.LogBilinear().fit(triple, count, steps=20), lm.LogBilinear().fit(triple[::-1], count[::-1], steps=20)
    more = lm.LogBilinear().fit(np.append(triple, 12_345), np.append(count, 1), steps=20)
    assert np.array_equal(base.log10_table(), back.log10_table())
    assert not np.array_equal(base.vectors, more.vectors)
    assert more.log10_table()[12_345] > base.log10_table()[12_345]


def test_language_model_is_normalised():
    model = lm.LogBilinear().fit(np.array([5, 700, 9_000, 123_456]), np.array([10, 5, 3, 8]), steps=20)
    table = 10 ** model.log10_table().reshape(-1, lm.CLASSES)
    assert np.allclose(table.sum(1), 1)


# 5 main text


def test_main_text_of_pages(spark):
    for r in htmltext.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), "page_id").collect():
        inside = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = re.split(r"</?(?:p|h1|br)\b[^>]*>", inside)
        want = " ".join(" ".join(" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks).split())
        assert r["text"] == want and r["n_chars"] == len(want)


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""), ("<p>", ""), ("plain words only", "plain words only"), ("<div>" * 3000 + "deep enough to read" + "</div>" * 10, "deep enough to read"),
        ("<body><nav><a href=x>Home</a></nav><div class='content'><h2>Title</h2><p>First &amp; long paragraph, with   space.</p><p>Second one, <b>bold</b> and <a href=y>linked</a>.</p></div>"
         "<div id=sidebar><p>Side text</p></div><div class='comments'><p>I disagree with all of it!</p></div><footer>(c)</footer>", "Title First & long paragraph, with space. Second one, bold and linked."),
        ("<main><p>Body text here, some words.<form><input value='a>b'><p>Form</p></form><script>var x='<p>no</p>'</script><style>p{}</style><p title=\"a > b\">Next.</main><aside>Aside</aside>", "Body text here, some words. Next."),
        ("<article><p>One<!-- <p>hidden</p> --> two<br>three</p><section class='comment-list'><p>Comment</p></section></article>", "One two three"),
    ],
)
def test_main_text(page, text):
    assert htmltext.main_text(page) == text


@pytest.mark.parametrize("tag, name", [("section", "id='social-structure'"), ("section", "id='related-work'"), ("div", "id='header-files'"), ("div", "class='social-structure'"), ("p", "id='notice-of-change'")])
def test_main_text_keeps_slugs(tag, name):
    words = "Groups of the species live together and share their food over the whole of the year."
    assert htmltext.main_text(f"<article><h2 id='navigation-and-trade'>Trade</h2><p>{words}</p><{tag} {name}>{words}</{tag}><div class='share-buttons'><a href=x>Send it</a></div></article>") == f"Trade {words} {words}"


def test_main_text_in_a_form():
    """A page that stands in one form keeps its article and loses the controls; a small form goes."""
    words = "The river rose by two metres in the night and the bridge was closed to all traffic until noon. " * 4
    small = '<form class="x"><p>Write to us about this page if you wish.</p><input name="q"><button>Send</button></form>'
    page = f'<html><body><form id="aspnetForm"><nav>Home</nav><div><h1>Flood</h1><p>{words}</p><p>{words}</p><select><option>One</option></select></div></form></body></html>'
    text = " ".join(["Flood", words.strip(), words.strip()])
    assert htmltext.main_text(page) == text
    assert htmltext.main_text(f"<body><div><h1>Flood</h1><p>{words}</p><p>{words}</p>{small}</div></body>") == text


def test_main_text_of_unmatched_ends():
    """End tags without a start under many open elements take linear time."""
    start = time.monotonic()
    n = 100_000
    assert htmltext.main_text("<div><p>" + "<b>" * n + "one two three " + "</i>" * n + "</div>") == "one two three"
    assert time.monotonic() - start < 20


def test_main_text_edges(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (2, None, ""), (None, "v", "<article><p>Text</p></article>")], "page_id long, url string, html string")
    assert rows_of(htmltext.extract(pages), "page_id", "url", "text", "n_chars") == sorted([(1, "u", "", 0), (2, None, "", 0), (2, None, "", 0), (None, "v", "Text", 4)], key=repr)
    assert htmltext.extract(pages.limit(0)).count() == 0


# 6 vectors


def true_links(x, threshold=0.98):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    return near


def test_near_vectors(spark):
    """A saturated group, pairs, copies and strays, in two labels."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(1, 32))
    x = np.concatenate([rng.normal(size=(600, 32)), centre + 0.05 * rng.normal(size=(700, 32))])
    x = np.concatenate([x, x[:40] + 0.03 * rng.normal(size=(40, 32)), x[100:130]]).astype(np.float32)
    label = np.where(np.arange(len(x)) % 5 == 0, 1, 0)
    rows = [(int(i), v.tolist(), int(t), 0) for i, (v, t) in enumerate(zip(x, label, strict=True))]
    heard = []
    got = {r["vec_id"]: r for r in nndescent.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, component int"), report=heard.append).collect()}
    hit = total = 0
    for t in (0, 1):
        at = np.flatnonzero(label == t)
        near = true_links(x[at].astype(float))
        want = helpers.roots(at.tolist(), [(int(at[i]), int(at[j])) for i, j in np.argwhere(near)])
        for k, i in enumerate(at.tolist()):
            total += near[k].sum()
            hit += min(got[i]["n_links"], near[k].sum())
            assert got[i]["n_links"] <= near[k].sum()
            assert got[i]["component_id"] == want[i] and got[i]["kept"] == (want[i] == i)
    assert hit >= 0.99 * total and heard[-1] >= 0.99


def test_near_vectors_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [2.0, 0.0], 0), (4, [1.0, 0.0], None), (5, None, 0), (6, [], 0), (7, [0.0, 0.0], 0), (8, [nan, 1.0], 0), (9, [inf, 1.0], 0), (10, [None, 1.0], 0), (None, [1.0, 0.0], 0), (11, [1.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = rows_of(nndescent.near_vectors(table), "vec_id", "n_links", "component_id", "kept")
    assert got == sorted([(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 3, 1, False), *((i, 0, i, True) for i in range(4, 12)), (None, 0, None, True)], key=repr)
    assert nndescent.near_vectors(table.limit(0)).count() == 0


# 7 lines


def test_lines(documents, texts):
    got = {(r["id"], r["pos"]): r for r in linededup.line_components(documents).collect()}
    lines = {(i, k): x for i, t in texts.items() for k, y in enumerate((t or "").split("\n")) if (x := re.sub(r"[\x20\x09-\x0D]+", " ", y).strip(" "))}
    assert set(got) == set(lines)
    sets = {x: frozenset(x.lower()[i : i + 12] for i in range(max(1, len(x.lower()) - 11))) for x in set(lines.values())}
    names = sorted(sets, key=lambda x: len(sets[x]))
    pairs = [(a, b) for i, a in enumerate(names) for b in itertools.takewhile(lambda b: 0.8 * len(sets[b]) <= len(sets[a]), names[i + 1 :]) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = helpers.roots(names, pairs)
    true, found = defaultdict(set), defaultdict(set)
    for k, x in lines.items():
        true[root[x]].add(k)
        found[got[k]["component"]].add(k)
    assert all(len({root[lines[k]] for k in g}) == 1 for g in found.values())  # nothing joined wrongly
    assert len(true) <= len(found) <= len(true) + max(1, len(pairs) // 20)
    for g in found.values():
        assert [k for k in g if got[k]["kept"]] == [min(g)]


def test_lines_edges(spark, edges, empty):
    far = "The quick brown fox jumps over the lazy dog while many other animals watch it from the green hill and wonder about the weather, which had been warm and dry for several weeks until yesterday when heavy rain fell over all of the valley"
    docs = spark.createDataFrame([(1, f"{far}\n\nOwn line of one.\n{far}", "x"), (2, far.replace("lazy", "sleepy"), "x"), (3, f"Other things stand here.\n{far}!", "x"), (4, None, "x"), (5, "", "x"), (None, far, "x")], "doc_id long, text string, id string")
    got = {r["doc_id"]: r["text"] for r in linededup.dedupe_lines(docs).collect()}
    assert got == {1: f"{far}\n\nOwn line of one.", 3: "Other things stand here.", 4: None, 5: ""}
    out = linededup.dedupe_lines(edges)
    assert out.columns == edges.columns and out.count() == len(EDGES) - 2  # the second of the long texts goes, and of those that share a passage (similarity 0.832)
    assert linededup.dedupe_lines(empty).count() == 0


def test_lines_without_blanks(spark):
    """Characters after the 12th of a word count as all others do."""
    rng = np.random.default_rng(4)
    tail = lambda n: "".join(map(chr, rng.integers(0x4E00, 0x9000, n)))
    same, link = tail(120), "https://www.example.org/"
    texts = [link + "a-first-page-about-rivers", link + "quite-another-thing/2024/index.html", "水文观测记录一二三四五六" + tail(80), "水文观测记录一二三四五六" + tail(80), same, tail(6) + same]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in linededup.dedupe_lines(docs).collect()} == {0, 1, 2, 3, 4}


def test_lines_of_documents_without_a_name_of_their_own(spark):
    """Documents without id, and different texts under one id, lose only lines that stand elsewhere."""
    line = lambda n: f"Line number {n * n * 7919} tells of {'abcdefghij'[n % 10] * (n + 5)} and of {n * 104_729} other things."
    texts = [(None, [1, 2]), (None, [3, 4, 1]), (None, [5, 6]), (7, [8, 9]), (7, [10, 8, 11]), (7, [10, 12]), (8, [9])]
    rows = [(i, "\n".join(map(line, x)), [n], n) for n, (i, x) in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, gone array<int>, __gone int")
    marks = [r for r in linededup.line_components(docs).collect() if r["kept"]]
    assert len({(r["id"], r["row"], r["pos"]) for r in marks}) == len({r["component"] for r in marks}) == 11
    out = linededup.dedupe_lines(docs)
    assert out.columns == docs.columns
    got = [(r["__gone"], x) for r in out.collect() for x in r["text"].split("\n")]
    copies = {r[3] for r in rows if r[3] == 3}
    for n in range(1, 13):
        if n != 7:
            holders = [k for k, x in got if x == line(n)]
            assert len(set(holders)) == 1 and (len(holders) == 1 or set(holders) == copies)
    assert all((k, line(n)) in got for k, n in ((0, 2), (1, 3), (1, 4), (2, 5), (2, 6), (4, 11), (5, 12)))


def chained_lines():
    """Chains of three lines: neighbours at about 0.87, the ends at about 0.76."""
    rng = np.random.default_rng(9)
    out = []
    for _ in range(60):
        one = "".join(map(chr, rng.integers(0x4E00, 0x9000, 191)))
        two = one[13:] + "".join(map(chr, rng.integers(0x4E00, 0x9000, 13)))
        out.append((one, two, two[13:] + "".join(map(chr, rng.integers(0x4E00, 0x9000, 13)))))
    return out


def test_lines_in_chains(spark):
    """Links between two lines of a band count, also if neither is its smallest line."""
    chains = chained_lines()
    docs = spark.createDataFrame([(3 * i + k, x) for i, c in enumerate(chains) for k, x in enumerate(c)], "doc_id long, text string")
    got = {r["id"]: r for r in linededup.line_components(docs).collect()}
    sigs = dict(docs.select("doc_id", F.slice(linededup.shingle_hashes(F.col("text")), 1, 4)).collect())
    share = lambda a, b: len(set(sigs[a]) & set(sigs[b])) >= 2
    for i in range(0, 3 * len(chains), 3):
        want = helpers.roots([i, i + 1, i + 2], [p for p in ((i, i + 1), (i + 1, i + 2)) if share(*p)])
        assert [got[i + k]["component"] for k in range(3)] == [min(got[j]["name"] for j in want if want[j] == want[i + k]) for k in range(3)]


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(i, i + 1) for i in range(1, 300)] + [tuple(map(int, p)) for p in rng.integers(400, 700, (200, 2))] + [(1000, i) for i in range(1001, 1200)]
    nodes = sorted({x for p in pairs for x in p} | {5000})
    got = components(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(pairs, "a long, b long"))
    assert {r["id"]: r["component"] for r in got.collect()} == helpers.roots(nodes, pairs)


# 8 sentencepiece


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))


def test_sentencepieces(documents, texts, edges, empty, library):
    def want(i, t):
        ids = [*library.encode(t or ""), 2]
        return i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()

    cols = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert rows_of(sentencepieces.encode(documents, tokenizer_path(PIECES)), *cols) == sorted([want(i, t) for i, t in texts.items()], key=repr)
    assert rows_of(sentencepieces.encode(edges, tokenizer_path(PIECES)), *cols) == sorted([want(i, t) for i, t in EDGES], key=repr)
    full = sentencepieces.encode(edges, tokenizer_path(PIECES), with_ids=True).filter("doc_id = 9").first()
    assert full["ids"] == [*library.encode(EDGES[11][1]), 2] and full["decoded"] == EDGES[11][1]
    assert sentencepieces.encode(empty, tokenizer_path(PIECES)).count() == 0


def test_sentencepiece_words(library):
    """Random strings over few letters and runs of spaces, in both merge routes."""
    rng = np.random.default_rng(0)
    model = sentencepieces.PieceModel(tokenizer_path(PIECES))
    for n in [*range(1, 40), 500, 3000]:
        text = "".join(rng.choice(list("aeinst  é\n0"), n))
        for long in (0, 200):
            assert [i for w in model.encode_words(model.words(text), long) for i in w] == library.encode(text)


# 9 near duplicates


def test_near_duplicates(spark, edges, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = helpers.near_duplicates([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    for r in neardup.near_duplicates(docs).collect():
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    named = [(i, t) for i, t in EDGES if i is not None]
    want = helpers.near_duplicates(named)
    got = rows_of(neardup.near_duplicates(edges), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted([(i, *want[i], want[i][1] == i) for i, _ in named] + [(None, 4, None, True), (None, 0, None, True)], key=repr)
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    """Hundreds of variants of one text, each near some others, and chains."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(300):
        w = list(base)
        for k in rng.choice(120, int(rng.integers(1, 9)), replace=False):
            w[k] = f"x{i}y{k}"
        docs.append((i, " ".join(w)))
    for i in range(40):  # each step replaces more of the text
        docs.append((1000 + i, " ".join(f"z{k}" if k >= 2 * i else f"q{k}" for k in range(100))))
    want = helpers.near_duplicates(docs)
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: c for i, (_, c) in want.items()}


# 10 suffix arrays


def test_suffix_array():
    rng = np.random.default_rng(1)
    for _ in range(150):
        x = rng.integers(97, 97 + int(rng.integers(1, 5)), int(rng.integers(1, 80))).astype(np.uint8)
        b = bytes(x)
        order = sorted(range(len(b)), key=lambda i: b[i:])
        assert suffix_array(x).tolist() == order
        common = permuted_prefixes(x, np.array(order), np.zeros(len(x), bool), 1000)
        for i, j in zip(order, order[1:], strict=False):
            assert common[j] == len(os.path.commonprefix([b[i:], b[j:]]))


@pytest.mark.parametrize("split", [4096, 4])
def test_repeated_strings(documents, edges, empty, split, monkeypatch):
    spans = suffixdedup.repeated_spans
    monkeypatch.setattr(suffixdedup, "repeated_spans", lambda t, n: spans(t, n, split=split))
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    for table in (documents, edges):
        rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
        want = [(i, *x) for (i, _), x in zip(rows, helpers.repeated([t for _, t in rows]), strict=True)]
        assert rows_of(suffixdedup.dedupe(table, keep=("key", "id") if table is edges else ()), *cols) == sorted(want, key=repr)
    assert suffixdedup.dedupe(empty).count() == 0


def test_anchors_take_bounded_memory():
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 123, 2000, dtype=np.uint8)) for _ in range(2000)]
    tracemalloc.start()
    found = suffixdedup.Anchors(200).segments(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found[0]) and most < 150_000_000


def test_anchors_of_long_texts():
    """A text of several pieces has all its windows once, under the anchors of a text in one piece."""
    rng = np.random.default_rng(6)
    text = bytes(rng.integers(97, 101, 3 * suffixdedup.PIECE + 777, dtype=np.uint8))
    _, start, size, anchor, _ = suffixdedup.Anchors(200).segments([text])
    assert start[0] == 0 and (start[1:] == start[:-1] + size[:-1] - 199).all() and start[-1] + size[-1] == len(text)
    middle = suffixdedup.PIECE - 1000
    _, part, length, other, _ = suffixdedup.Anchors(200).segments([text[middle : middle + 2000]])
    whole = lambda at, n, names, low: {w: int(a) for s, m, a in zip(at, n, names, strict=True) for w in range(low + s, low + s + m - 199)}
    everywhere = whole(start.tolist(), size.tolist(), anchor, 0)
    assert all(everywhere[w] == a for w, a in whole(part.tolist(), length.tolist(), other, middle).items())


def test_equal_segments_need_no_suffix_array(spark, monkeypatch):
    """Copies of whole texts are found without a shard; texts that share a part meet in one."""
    rng = np.random.default_rng(8)
    a, b, c, d = (bytes(rng.integers(97, 123, 3000, dtype=np.uint8)).decode() for _ in range(4))
    dealt, cut = [], suffixdedup._cut
    monkeypatch.setattr(suffixdedup, "_cut", lambda rows: dealt.append(rows.count()) or cut(rows))
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    for texts in ([a, a, b, b, b, c], [a, b[:1000] + a[500:1500] + b[2000:], c, c, d]):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        want = [(i, *r) for i, r in enumerate(helpers.repeated(texts))]
        assert rows_of(suffixdedup.dedupe(docs), *cols) == sorted(want, key=repr)
    assert dealt[0] == 0 and dealt[1] > 0


def test_windows_of_a_common_anchor_are_not_listed(spark, monkeypatch):
    """Texts with a common phrase in different surroundings are dealt by a second hash, not compared by lists of their windows."""
    rng = np.random.default_rng(9)
    word = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    phrase, some = word(150), [word(300) for _ in range(6)]
    texts = [word(300) + phrase + word(300) for _ in range(60)] + [some[i % 6][: 200 + i] + phrase + some[i % 5] for i in range(24)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans, compare, sizes = suffixdedup.repeated_spans, suffixdedup._compare, []

    def counted(segments, length, block):
        found = compare(segments, length, block)
        sizes.append((found.count(), segments.count()))
        return found

    monkeypatch.setattr(suffixdedup, "repeated_spans", lambda t, n: spans(t, n, split=4))
    monkeypatch.setattr(suffixdedup, "_compare", counted)
    want = [(i, *r) for i, r in enumerate(helpers.repeated(texts))]
    assert rows_of(suffixdedup.dedupe(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)
    made, given = sizes[0]
    assert 0 < made <= given < 60 * len(texts)


def test_repeated_strings_under_one_id(spark):
    """Different texts under one id, or without id, lose only strings of their own that repeat."""
    rng = np.random.default_rng(12)
    text = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    shared = text(400)
    rows = [(1, text(500) + shared + text(500)), (1, text(1400)), (None, shared + text(300)), (None, text(900)), (2, text(700))]
    want = [(i, *x) for (i, _), x in zip(rows, helpers.repeated([t for _, t in rows]), strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(suffixdedup.dedupe(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)


def test_line_blocks_without_the_smallest_line(spark, monkeypatch):
    """A band's smallest line was compared with all others of the band and meets none of them again in blocks."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    texts = []
    for _ in range(60):
        head = word(90)
        texts += [head + word(30), head + word(30)]
    seen, blocks = [], linededup.block_links

    def counted(members, *args):
        seen.append(members.groupBy("band").count().agg(F.max("count")).first()[0] or 0)
        return blocks(members, *args)

    monkeypatch.setattr(linededup, "block_links", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = linededup.line_components(docs).collect()
    assert sum(r.kept for r in marks) == len(texts)
    assert seen == [1]


def test_texts_go_only_to_blocks_where_lines_are_compared(spark, monkeypatch):
    """Lines of a band that have none of like size stay out of the block comparison; those that have are all compared."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    head, tail, dealt, write = word(90), word(400), [], linededup.materialize

    def counted(df):
        out = write(df)
        if {"i", "j", "sig"} <= set(out.columns):
            dealt.append({r[0] for r in out.select("name").collect()})
        return out

    monkeypatch.setattr(linededup, "materialize", counted)
    alone = [head + word(n) for n in (0, 60, 150, 300, 500, 800, 1200)]
    families = [head + x + word(4) for x in (tail, tail[:200] + word(1) + tail[201:], word(200), word(200)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(alone + families)), "doc_id long, text string")
    marks = {r["id"]: r for r in linededup.line_components(docs).collect()}
    assert len(dealt) == 1 and not dealt[0] & {marks[i]["name"] for i in (0, 1, 5, 6)}
    sets = [frozenset(x[i : i + 12] for i in range(len(x) - 11)) for x in alone + families]
    like = [(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    root = helpers.roots(range(len(sets)), like)
    assert len({marks[i]["component"] for i in marks}) == len(set(root.values()))


def test_signature_is_the_smallest_hashes(spark):
    """The four smallest different hashes, also of lines that repeat themselves or have few; one look at the hashes below a limit does for most."""
    rng = random.Random(8)
    lines = ["".join(rng.choices("abcdefghij klmnop\u00e9\u4e2d", k=rng.randrange(1, 400))) for _ in range(400)]
    lines += ["a" * n for n in (1, 12, 500)] + ["ab cd " * n for n in (1, 3, 90)] + ["x" * 300 + "".join(rng.choices("abc", k=9))]
    rows = spark.createDataFrame(list(enumerate(lines)), "id int, line string")
    whole = F.slice(linededup.shingle_hashes(F.col("line")), 1, 4)
    assert rows.filter(linededup.signature(F.col("line"), 4) != whole).count() == 0
