"""BPE, fingerprints, packing and HTML extraction against brute force."""

import base64
import hashlib
import html
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import byte_bpe, fingerprints, html_text, packing
from tidelog.llm.tables import table

public = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.TreeBpe.load(public.path(byte_bpe.VOCABULARY), public.PATTERN)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path(byte_bpe.VOCABULARY), "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abing the's 12!?\n\t\xa0é日🙂<|>")) | st.characters(codec="utf-8"), max_size=120))
def test_bpe_equals_library(bpe, reference, text):
    ids = bpe.encode(text)
    assert ids == reference.encode_ordinary(text) and bpe.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 4000, "!" * 3000 + "?" * 3000, " " * 5000, "\n" * 3000, "abcdefghijklmnop" * 800, "é" * 3000])
def test_bpe_long_runs(bpe, reference, text):
    assert bpe.encode(text) == reference.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=60), st.binary(min_size=1, max_size=60))
def test_join_is_the_encoding_of_the_whole(bpe, a, b):
    assert bpe.join(bpe.encode_piece(a), bpe.encode_piece(b)) == bpe.merged(a + b)


def test_bpe_small_caches(bpe, reference, monkeypatch):
    for name in ("CACHE_CHUNKS", "CACHE_PIECES", "CACHE_WINDOWS"):
        monkeypatch.setattr(byte_bpe, name, 3)
    text = "some words here, and more words there; again words."
    assert bpe.encode(text) == reference.encode_ordinary(text)


def test_bpe_operator(spark, reference):
    rows = [(1, None), (2, ""), (3, "hello <|endoftext|> world"), (3, "again")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = byte_bpe.round_trip(frame.withColumnRenamed("text", "body").selectExpr("doc_id", "body", "'x' AS ids"), text="body").collect()
    assert sorted((r["doc_id"], r["body"] or "", r["ids"], bytes(r["decoded"])) for r in found) == sorted((i, t or "", reference.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    two = byte_bpe.decode(byte_bpe.encode(frame)).collect()
    assert [bytes(r["decoded"]).decode() for r in two] == [t or "" for _, t in rows] and byte_bpe.encode(frame.limit(0)).count() == 0


def test_bpe_query(spark, sf_dir, reference):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}
    for r in byte_bpe.op3_byte_bpe(spark, sf_dir).collect():
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


# --- fingerprints -------------------------------------------------------------


def brute_digits(text):
    """One text, one character after another."""
    steps, sums, time, anchor = fingerprints.jumps(), np.zeros(fingerprints.GROUPS), 0, np.uint64(fingerprints.SEED)
    points = np.array([ord(c) for c in text], dtype="<u4")
    if len(points) == 0:
        return np.zeros(fingerprints.GROUPS, np.int8)
    first, anchors, context = fingerprints.stretches(points, np.array([0]))
    starts = dict(zip(first.tolist(), anchors, strict=True))
    for i, p in enumerate(points.tolist()):
        if i in starts:
            time, anchor = 0, starts[i]
        h = fingerprints.mixed(np.array([anchor]) + np.array([time], np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + context[i : i + 1])[0]
        sums[int(h % np.uint64(fingerprints.GROUPS))] += (int(h >> np.uint64(40)) & 1) * 2 - 1
        time += int(steps[time % fingerprints.TIMES * fingerprints.SYMBOLS + p % fingerprints.SYMBOLS])
    return np.sign(sums).astype(np.int8)


def test_walks_in_lockstep():
    texts = ["", "a", "some text " * 40, "x" * 700, "🙂é日本" * 60, "other words in a row " * 15]
    found = fingerprints.text_digits(texts)
    for text, row in zip(texts, found, strict=True):
        assert (row == brute_digits(text)).all()
        assert (fingerprints.from_text(fingerprints.to_text(row)) == row).all()


def test_likeness_falls_with_edits():
    rng = np.random.default_rng(0)
    words = [f"w{rng.integers(1000)}" for _ in range(400)]
    base = fingerprints.text_digits([" ".join(words)])
    near = []
    for k in (0, 2, 20, 200, 400):
        edited = list(words)
        for i in rng.permutation(400)[:k]:
            edited[i] = f"e{rng.integers(100000)}"
        near.append(float(fingerprints.likeness(base, fingerprints.text_digits([" ".join(edited)]))[0]))
    assert near[0] == 1.0 and near[1] > 0.6 and near[1] > near[2] > near[3] >= 0 and near[4] < 0.1


def fingerprint_brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [t or "" for _, t in rows]
    out = []
    for (i, _), a, b in zip(rows, texts, texts[1:] + texts[:1], strict=True):
        h = len(a) // 2
        edited = a[: len(a) - h] + b[:h]
        own, edit, after = (fingerprints.text_digits([x]) for x in (a, edited, b))
        out.append((i, len(a), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.to_text(own[0]), fingerprints.to_text(edit[0]), round(float(fingerprints.likeness(own, edit)[0]), 9), round(float(fingerprints.likeness(own, after)[0]), 9)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "ab"), (2, "")], [(i * 7 % 50, f"text {i} " * (i % 9)) for i in range(50)] + [(3, "again"), (3, "again"), (None, "no id"), (60, "long " * 5000)]])
def test_compare_with_next(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = fingerprints.compare_with_next(docs).collect()
    assert sorted([(r[0], *r[1:5], round(r[5], 9), round(r[6], 9)) for r in found], key=repr) == fingerprint_brute(rows)


def test_fingerprint_query(spark, sf_dir):
    rows = fingerprints.op4_fingerprints(spark, sf_dir).toPandas()
    assert rows.near_edited.mean() > rows.near_next.mean() + 0.15 and len(rows) == table(spark, sf_dir, "documents").count()


def test_near_pairs(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 300)) for _ in range(40)]
    texts += [t.replace(t.split(" ")[5], "edited", 1) for t in texts[:20]] + texts[:5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = fingerprints.fingerprint(docs)
    pairs = {(r["a"], r["b"]) for r in fingerprints.near_pairs(prints).collect()}
    by_id = {r["doc_id"]: r["fingerprint"] for r in prints.collect()}
    planted = {tuple(sorted((by_id[i], by_id[40 + i]))) for i in range(20) if by_id[i] != by_id[40 + i]}
    assert len(planted & pairs) >= 0.9 * len(planted) and len(pairs) <= len(planted) + 2


@pytest.mark.parametrize("block", [1024, 20])
def test_near_pairs_of_mixed_buckets(spark, monkeypatch, block):
    """Short bands, so that unrelated fingerprints share every bucket: no pair of a bucket goes uncompared, in one block or many."""
    monkeypatch.setattr(fingerprints, "DIGITS", 4)
    monkeypatch.setattr(fingerprints, "BLOCK", block)
    rng = np.random.default_rng(6)
    digits = rng.integers(-1, 2, (1500, fingerprints.GROUPS)).astype(np.int8)
    digits = np.concatenate([digits, np.where(rng.random((300, fingerprints.GROUPS)) < 0.1, rng.integers(-1, 2, (300, fingerprints.GROUPS)), digits[:300]).astype(np.int8)])
    chosen = np.random.default_rng(fingerprints.SEED + 1).permutation(fingerprints.GROUPS)[: fingerprints.BANDS * 4].reshape(-1, 4)
    prints, expected = [fingerprints.to_text(d) for d in digits], {}
    for i, own in enumerate(digits):
        rest = digits[i + 1 :]
        near = fingerprints.likeness(np.broadcast_to(own, rest.shape), rest)
        shared = (rest[:, chosen] == own[chosen]).all(2).any(1)
        expected |= {tuple(sorted((prints[i], prints[j + i + 1]))): near[j] for j in np.flatnonzero((near >= fingerprints.NEAR) & shared)}
    frame = spark.createDataFrame([(p,) for p in prints], "fingerprint string")
    found = fingerprints.near_pairs(frame).collect()
    assert len(expected) >= 290 and len(found) == len(expected) and {(r["a"], r["b"]): r["near"] for r in found} == expected


# --- packing ------------------------------------------------------------------


def fewest(items, capacity):
    """The optimum by trying every way, for a few items."""
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in {b: j for j, b in enumerate(bins)}.values():
            if bins[k] + items[i] <= capacity:
                go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def test_bin_completion_is_optimal_on_small_cases():
    rng = np.random.default_rng(3)
    for _ in range(60):
        items = sorted(rng.integers(1, 40, rng.integers(1, 9)).tolist(), reverse=True)
        plan = packing.bin_completion(Counter(items), 50)
        assert sum((Counter({k: n * c for k, c in Counter(p).items()}) for p, n in plan), Counter()) == Counter(items)
        assert all(sum(p) <= 50 for p, _ in plan) and sum(n for _, n in plan) == fewest(items, 50)


def test_best_fit_decreasing_is_no_worse_than_completion():
    rng = np.random.default_rng(4)
    counts = Counter(rng.integers(1, 2048, 3000).tolist())
    done, first = (sum(n for _, n in f(counts, 2048)) for f in (packing.bin_completion, packing.best_fit_decreasing))
    assert packing.lower_bound(counts, 2048) <= done <= first


@pytest.mark.parametrize("times", [1, 7, 1000])
def test_bin_completion_finds_fillings_of_short_pieces(times):
    """The filling of 1100 without waste, 500 + 448, starts with the eighth length that fits."""
    counts = dict.fromkeys((1100, 700, 698, 690, 680, 670, 658, 500, 448), times)
    plan = packing.bin_completion(counts, 2048)
    assert sum(n for _, n in plan) == 3 * times
    assert sum((Counter({k: n * c for k, c in Counter(p).items()}) for p, n in plan), Counter()) == Counter(counts)


def test_fillings_are_all_undominated_ones():
    rng = np.random.default_rng(7)
    for _ in range(100):
        counts = Counter(rng.integers(1, 20, rng.integers(1, 9)).tolist())
        lengths, room = sorted(counts, reverse=True), int(rng.integers(1, 40))
        found = [p for p in packing.fillings(counts, lengths, room) if p is not None]
        assert [sum(p) for p in found] == sorted((sum(p) for p in found), reverse=True) and len(set(found)) == len(found)
        ways = {w for n in range(sum(counts.values()) + 1) for w in itertools.combinations(sorted(counts.elements(), reverse=True), n) if sum(w) <= room}
        assert set(found) <= ways
        for way in ways:
            assert any(packing.dominates(p, way) for p in found)


def test_dominance():
    assert packing.dominates((10,), (4, 6)) and not packing.dominates((4, 6), (10,)) and packing.dominates((5, 5), (5, 4))


def check_places(rows, capacity=packing.CAPACITY):
    used = defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


def test_packing_query(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path(packing.VOCABULARY))
    rows = packing.op6_packing(spark, BIG).collect()
    sequences = check_places(rows)
    total = sum(r["length"] for r in rows)
    assert sequences <= 1.02 * -(-total // packing.CAPACITY) + 1
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, BIG, "documents").collect()}
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert by_doc.keys() == texts.keys()
    for i, text in texts.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        expected = [(n, a, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for n, a in enumerate(range(0, len(ids), 2048)) for p in [ids[a : a + 2048]]]
        assert sorted(by_doc[i]) == expected


def test_packing_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "word " * 5000), (3, "x"), (4, "İstanbul\x1cΣΑΣ don't <|endoftext|> ﬁ  a　b")], "doc_id long, text string")
    rows = packing.pack_documents(docs).collect()
    check_places(rows)
    assert sorted((r["length"] for r in rows if r["doc_id"] in (1, 2))) == [1, 1, 1] and len([r for r in rows if r["doc_id"] is None]) == 3
    assert packing.pack_documents(docs.limit(0)).count() == 0
    odd = docs.selectExpr("doc_id", "text", "'x' AS slice", "1 AS number", "2 AS offset")
    lengths = packing.pieces(odd).selectExpr("*", "'x' AS slice", "1 AS number", "2 AS offset")
    assert packing.pack(lengths).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "slice", "number", "sequence_id", "offset"] and len(check_places(packing.pack(lengths).collect()) and rows) == len(rows)
    kept = packing.pieces(docs.filter("doc_id = 3"), keep_ids=True).first()
    assert kept["ids"][-1] == 0 and len(kept["ids"]) == kept["length"]


def test_chunk_tokenizer_small_cache(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE_CHUNKS", 4)
    own, tokenizer = packing.ChunkTokenizer(public.path(packing.VOCABULARY)), Tokenizer.from_file(public.path(packing.VOCABULARY))
    for text in ["The cat, the dog; THE end.", "éclair Über straße, déjà!", "a's don't 12ab ab12 x́", "", "  ", "End.<|endoftext|>Start <|startoftext|>, <|ENDOFTEXT|> ok", "<|endoftext|>", "日本 <|endoftext|>é", "The cat"]:
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


# --- html ---------------------------------------------------------------------


def test_pages(spark):
    pages = {r["page_id"]: r["html"] for r in table(spark, BIG, "pages").collect()}
    for r in html_text.op9_html_text(spark, BIG).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        expected = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:h1|p|br)>", " \n ", article))).split())
        assert r["text"] == expected and r["n_chars"] == len(expected)


BOX = "<html><body><header><h1>Site</h1></header>{}<footer>c</footer></body></html>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b <b>c</b>d<br>e", "a b cd e"), ("<script>x</script><style>y</style>", ""), ("<" * 500, "<" * 500),
        (BOX.format("<div id=c><h2>Title</h2><p>A long enough paragraph of text stands here.</p><p>Ok.</p></div><div class=sidebar>s</div>"), "Title A long enough paragraph of text stands here. Ok."),
        (BOX.format("<article><p>Body of it, one sentence long.</p><div class='comments'><p>A reader's comment that is rather long indeed.</p></div><aside>x</aside><form>f</form></article>"), "Body of it, one sentence long."),
        (BOX.format("<div class='has-sidebar'><article>In.<p>Here</article></div><div role=alert>n</div><div hidden>h</div>"), "In. Here"),
        (BOX.format("<div class='cookie-notice'>We use cookies on this site, lots of them, all the time.</div><main>Main &lt;text&gt;&#33;</main>"), "Main <text>!"),
        ("<article>a&nbsp;b\n\n c</article", "a b c"), ("<article>x<!-- no --> y</article>", "x y"),
    ],
)
def test_html_cases(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("sizes", [(9, 2), (2, 9), (9, 1, 1), (20, 1)])
def test_html_articles_over_siblings(sizes):
    """All parts of an article without <article> stay, however little of it they hold."""
    parts = [[f"Paragraph {i} of part {k}, a sentence long enough to be dense text of the article itself." for i in range(n)] for k, n in enumerate(sizes)]
    body = "".join("<div class=part>" + "".join(f"<p>{t}</p>" for t in part) + "</div>" for part in parts)
    page = BOX.format(f"<div class=post>{body}</div><div class=sidebar>s</div>")
    assert html_text.main_text(page) == " ".join(itertools.chain(*parts))


LONG = "A sentence that is long enough to be dense text of the article itself."


@pytest.mark.parametrize("element", ["section id=discussion", "section id='related-work'", "h2 id='promotion-and-relegation'", "div class=response", "div id=ad-hoc-methods", "p class='menu-prices'"])
def test_html_article_keeps_its_sections(element):
    tag = element.split()[0]
    assert html_text.main_text(BOX.format(f"<article><p>{LONG}</p><{element}>{LONG}</{tag}></article>")) == f"{LONG} {LONG}"


@pytest.mark.parametrize("element", ["section id=comments", "div class='ad'", "div class='post ad-slot'", "section class=ad", "div id=disqus_thread", "div class='comment-list'", "ul class='share-buttons'", "div class=sidebar"])
def test_html_article_drops_adverts_and_comments(element):
    tag = element.split()[0]
    assert html_text.main_text(BOX.format(f"<article><p>{LONG}</p><{element}>{LONG}</{tag}></article>")) == LONG


@pytest.mark.parametrize("element", ["section id=discussion", "h2 id='related-work'"])
def test_html_titles_outside_articles(element):
    tag = element.split()[0]
    assert html_text.main_text(BOX.format(f"<div><p>{LONG}</p><{element}>{LONG}</{tag}></div>")) == f"{LONG} {LONG}"


def test_html_operator(spark):
    pages = spark.createDataFrame([(1, None, "keep"), (2, "<p>x", None)], "page_id long, html string, text string")
    assert sorted((r["page_id"], r["text"]) for r in html_text.extract(pages).collect()) == [(1, ""), (2, "x")]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_gaussian_keeps_the_level():
    assert np.allclose(html_text.smoothed(np.full(5, 3.0)), 3.0) and len(html_text.smoothed(np.array([1.0]))) == 1


def test_slices_cover_all():
    from tidelog.llm.arrow_columns import slices

    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(["x" * (i * 100) for i in range(10)])], names=["i", "t"])
    assert list(itertools.chain.from_iterable(s.column(0).to_pylist() for s in slices(batch, 1, 500))) == list(range(10))


def test_words_of_the_subject():
    """Classes and ids that speak of an article's subject don't lose its text."""
    long = " ".join(["The quarterly figures were better than anyone had thought, and the price rose all day."] * 6)
    menu = '<nav><a href="/">Home</a></nav><div class="cookie-banner">We use cookies.</div>'
    assert html_text.main_text(f'<body>{menu}<div class="share-price"><p>{long}</p><p>{long}</p></div><div class="comments"><p>{long}</p></div></body>') == f"{long} {long}"
    assert html_text.main_text(f'<body>{menu}<main><p>{long}</p><section id="social"><p>{long}</p></section></main></body>') == f"{long} {long}"
    assert html_text.main_text(f'<body><article><div class="search-results-text"><p>{long}</p></div><p>{long}</p></article></body>') == f"{long} {long}"
    assert html_text.main_text(f'<body><div class="post"><p>{long}</p></div><div class="sidebar"><p>{long}</p></div></body>') == long
