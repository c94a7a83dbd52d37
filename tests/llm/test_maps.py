"""Operators that work row by row: byte-level BPE, HTML extraction, language, toxicity, decontamination."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratabox.llm import byte_bpe, decontaminate, html_extract, lang_id, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted string"


def docs_of(spark, texts, langs=None):
    """Documents with extra columns whose names clash with those of results."""
    rows = [(k, t, langs[k] if langs else None, "s", None, None, None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# --- byte-level BPE


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def tiktoken_of(vocabulary):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=vocabulary[1], mergeable_ranks=byte_bpe.load_ranks(vocabulary[0]), special_tokens={})


def test_bpe_equals_the_library(vocabulary, tiktoken_of):
    rng, codec = random.Random(5), byte_bpe.Codec(*vocabulary, limit=50)
    texts = ["".join(rng.choice("abcdeiorstnéü 漢字\n\t 12!?' 🙂") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts += ["", " " * 4000 + "x", "a" * 6000, "ab" * 3000, "é" * 3000, "<|endoftext|>", "don't we'll"]
    for t in texts:
        assert codec.encode(t) == tiktoken_of.encode_ordinary(t)
        assert codec.decode(codec.encode(t)) == t.encode()


def test_bpe_merges_leftmost_least_pair(vocabulary):
    """Against merging by a plain scan."""
    ranks, rng = byte_bpe.load_ranks(vocabulary[0]), random.Random(2)
    for _ in range(300):
        piece = bytes(rng.choice(b"aaabethion") for _ in range(rng.randint(2, 40)))
        tokens = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min((ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(tokens, tokens[1:]))) if len(tokens) > 1 else (1 << 60, 0)
            if best[0] == 1 << 60:
                break
            tokens[best[1] : best[1] + 2] = [tokens[best[1]] + tokens[best[1] + 1]]
        if piece not in ranks:
            assert byte_bpe.encode_piece(piece, ranks) == [ranks[t] for t in tokens]


def test_bpe_query_rows(spark, vocabulary, tiktoken_of):
    texts = [None, "", "hello  world", "hello  world", "x" * 5000]
    got = {r["doc_id"]: r for r in byte_bpe.token_digests(docs_of(spark, texts), *vocabulary).collect()}
    for k, t in enumerate(texts):
        ids = tiktoken_of.encode_ordinary(t or "")
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.token_digests(docs_of(spark, []), *vocabulary).count() == 0
    back = byte_bpe.decode_ids(byte_bpe.encode_texts(docs_of(spark, texts), *vocabulary), *vocabulary)
    assert [r["text"] for r in back.orderBy("doc_id").collect()] == [t or "" for t in texts]


# --- HTML

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head {n}</h1><p>First &amp; <b>bold</b>{n}<p>Second<br>line&nbsp;{n}<div class="box">Same on every page</div><ul><li>one {n}<li>two</ul>
<section class="comments"><p>A reader says</p></section></article>
<aside>Side</aside><form><input><label>Mail</label></form><footer>&copy; all</footer></body></html>"""


def test_html_article(spark):
    """Of a host with one page the markup alone tells."""
    rows = [(1, "http://h/x", PAGE.format(n=1))]
    got = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).first()["text"]
    assert got == "Head 1 First & bold1 Second line 1 Same on every page one 1 two"
    assert html_extract.main_text(None, None, frozenset()) == ""


def test_html_tree_alone_decides(spark):
    """Names say nothing here: what is the same on a host's pages goes, what is new on each stays; without the tree's verdict all stays."""
    page = "<body><div class=q1>Zum Anfang</div><div class=q2><p>Text {n} of page {n}</p><p>and more {n}</p></div><div class=q3><span>Alle Rechte</span></div></body>"
    rows = [(k, f"http://names.example/{k}", page.format(n=k)) for k in range(9)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Text {k} of page {k} and more {k}" for k in range(9)}
    assert html_extract.main_text(rows[0][1], rows[0][2], frozenset()) == "Zum Anfang Text 0 of page 0 and more 0 Alle Rechte"


def test_html_importance_by_hand(spark):
    """Importance against the entropies computed directly."""
    pages = [("a", "x"), ("a", "y"), ("b", "z"), ("a", "w")]  # a box with a or b, a paragraph that differs
    rows = [(k, "http://i.example/", f"<body><div class=k>{box}</div><p>{text}</p></body>") for k, (box, text) in enumerate(pages)]
    got = sorted(r["importance"] for r in html_extract.importance(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    box = -(3 / 4 * math.log(3 / 4, 4) + 1 / 4 * math.log(1 / 4, 4))
    assert np.allclose(got, [0.9 * box, 0.9])  # the body's children are the same on all pages: presentation adds nothing


def test_html_deep_and_repeated(spark):
    """Nesting costs nothing but its elements; repeated rows are extracted each."""
    deep = "<div>" * 30_000 + "deep text" + "</div>" * 30_000
    rows = [(1, "http://deep.example/", deep)] * 3 + [(2, "http://deep.example/", "<b>" * 30_000 + "bold")]
    got = [(r["page_id"], r["text"]) for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got) == [(1, "deep text")] * 3 + [(2, "bold")]


@pytest.mark.parametrize("html", ["<", "<p", "<div class='a>b", "<p>a</b></div>c", "<script>never closed", "<!-- open", "<td>a<td>b", "&#xD800;&#0;x", "<a " * 2000, "<div>" * 3000 + "deep"])
def test_html_broken(html):
    html_extract.main_text("u", html, frozenset())


def test_html_site_style(spark):
    """A box that repeats on a host's pages goes; what differs stays; other hosts are judged apart."""
    rows = [(k, f"http://one.example/{k}", PAGE.format(n=k), "x") for k in range(12)] + [(50, "http://two.example/", PAGE.format(n=50), "x"), (51, None, None, "x"), (52, "http://one.example/e", "", "x")]
    rows += [(60 + k, f"http://div.example/{k}", f"<body><div class=top>Welcome here</div><div class=main>Text number {k} with words</div></body>", "x") for k in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")
    got = {r["page_id"]: r for r in html_extract.extract_main_text(pages).collect()}
    assert got[3]["text"] == "Head 3 First & bold3 Second line 3 one 3 two" and got[3]["n_chars"] == len(got[3]["text"])
    assert "Same on every page" in got[50]["text"]
    assert (got[51]["text"], got[51]["n_chars"], got[52]["text"]) == ("", 0, "")
    assert got[64]["text"] == "Text number 4 with words"
    joined = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(pages, broadcast_nodes=0).collect()}
    assert joined == {k: r["text"] for k, r in got.items()}
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0


def test_html_article_is_only_evidence(spark):
    """Text beside a marked article stays where its node says much; a marked paragraph that says the same on all pages goes."""
    page = "<body><article><p>Read our best stories</p></article><div class=story>Main text {n} of this page</div><div class=strip>All rights kept</div></body>"
    rows = [(k, f"http://teaser.example/{k}", page.format(n=k)) for k in range(10)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Main text {k} of this page" for k in range(10)}


def test_html_copies_are_one_page(spark):
    """Equal pages of a host are each extracted as one alone would be."""
    page = "<body><div class=main>The only text</div><ul><li>with items</ul></body>"
    rows = [(k, f"http://copy.example/{k}", page) for k in range(5)] + [(9, "http://copy.example/9", page.replace("only", "other"))] + [(10 + k, "http://twice.example/", page) for k in range(2)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert {got[k] for k in (10, 11)} == {"The only text with items"}
    assert all("The only text" in got[k] for k in range(5)) and "The other text" in got[9]


# --- language

WORDS = {"aa": "kalu mira tosa belo nari".split(), "bb": "schtrump gewitz kroft blenz harg".split()}


def lang_docs(n=120):
    rng = random.Random(3)
    texts, langs = [], []
    for k in range(n):
        lang = "aa" if k % 2 else "bb"
        texts.append(" ".join(rng.choice(WORDS[lang]) + rng.choice(WORDS[lang])[:2] for _ in range(30)))
        langs.append(lang)
    return texts, langs


def test_language(spark):
    texts, langs = lang_docs()
    texts += [None, "", "123 !!! ...", " ".join(["kalumi"] * 3 + ["gewitzkr schtrumpbl"] * 40)]
    langs += [None, "aa", None, None]
    got = {r["doc_id"]: r for r in lang_id.predict_languages(docs_of(spark, texts, langs)).collect()}
    for k in range(120):
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1)
        assert got[k]["lang_pred"] == langs[k] and 0.5 < got[k]["score"] <= 1
    assert [(got[k]["lang_pred"], got[k]["score"]) for k in (120, 121, 122)] == [("und", 0.0)] * 3
    assert got[123]["lang_pred"] == "bb"
    none = lang_id.predict_languages(docs_of(spark, texts[:4])).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert lang_id.predict_languages(docs_of(spark, [])).count() == 0


def test_forward_backward_is_exact():
    """Against summing over all label sequences."""
    import itertools

    rng = np.random.default_rng(1)
    lengths, L = np.array([4, 1, 3]), 3
    moves, first, evidence = rng.random((L, L)) + 0.1, np.full(L, 1 / L), rng.random((8, L)) + 0.1
    take, sizes, _ = lang_id.packed(lengths)
    got = np.empty_like(evidence)
    got[take] = lang_id.forward_backward(evidence[take], moves, first, sizes)[0]
    at = 0
    for n in lengths:
        want = np.zeros((n, L))
        for path in itertools.product(range(L), repeat=int(n)):
            p = np.prod([evidence[at + i, s] for i, s in enumerate(path)]) * np.prod([moves[a, b] for a, b in zip(path, path[1:])])
            for i, s in enumerate(path):
                want[i, s] += p
        assert np.allclose(got[at : at + n], want / want.sum(1, keepdims=True))
        at += n


# --- toxicity


def toxic_rows(n=600):
    rng = random.Random(9)
    plain = [f"{a}{b}" for a in ("the", "an", "re", "ing", "or", "sta") for b in ("tion", "er", "ou", "le", "nd", "rin", "ma")]
    texts, toxic = [], []
    for k in range(n):
        words = [rng.choice(plain) for _ in range(40)]
        bad = k % 4 == 0
        if bad:
            words[rng.randrange(40)] = rng.choice(["idiot", "moron", "worthless"])
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return texts, toxic


def test_toxicity(spark):
    texts, toxic = toxic_rows()
    hidden = ["theer an 1d10t thend", "ingou i d i o t restae", "anle m0r0n!!! thema", "stale idiiiiot andou", "orer w-o-r-t-h-l-e-s-s ale", "anle wor7hl3ss thema"]
    clean = ["theer a tion thend 2024 x y", None, "", "!!! ???", "stand 12:30 (re) - orrin"]
    docs = docs_of(spark, texts + hidden + clean)
    labels = spark.createDataFrame([(k, 1, t) for k, t in enumerate(toxic)] + [(None, 1, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_texts(docs, labels).collect()}
    assert all(got[k]["predicted"] == t for k, t in enumerate(toxic))
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in got)
    n = len(texts)
    assert [got[n + k]["predicted"] for k in range(len(hidden))] == [1] * len(hidden)
    assert [got[n + len(hidden) + k]["predicted"] for k in range(len(clean))] == [0] * len(clean)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if not r["predicted"]}
    assert {r["score"] for r in toxicity.score_texts(docs.limit(3), labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_texts(docs.limit(0), labels).count() == 0


# --- decontamination


def brute_hits(text, items):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, named = terms(text), set(), set()
    for name, item in items:
        own = terms(item)
        for i in range(max(1, len(own) - 7) if own else 0):
            w = own[i : i + 8]
            for at in range(len(words) - len(w) + 1):
                if words[at : at + len(w)] == w:
                    hit.update(range(at, at + len(w)))
                    named.add(str(name))
    return len(words), len(hit), sorted(named)


def test_decontamination(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["a", "b", "c", "dé", "e1"])
    items = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 3, 8, 12])))) for k in range(14)] + [(None, "a b c"), (None, "b b"), (3, "c c c"), (40, None)]
    texts = ["-".join(word() for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", "x " + (items[3][1] or "") + " y", "a " * 3 + "c c c " * 4000]
    benchmark = spark.createDataFrame([(n, t, "t", 1) for n, t in items], "item_id long, text string, term string, row int")
    rows = list(enumerate(texts)) + [(5, texts[5]), (5, "a b c dé"), (None, texts[7])]
    docs = spark.createDataFrame([(i, t, 1, "n", 2) for i, t in rows], "doc_id long, text string, row int, name string, leaked_doc int")
    got = Counter(map(tuple, decontaminate.find_contamination(docs, benchmark).collect()))
    want = Counter()
    for i, t in rows:
        n, hit, names = brute_hits(t, [(n if n is not None else "", x) for n, x in items])
        ids = sorted({x for x in names if x})
        want[i, n, hit, len(names), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(names) >= 2] += 1
    assert got == want
    kept = decontaminate.drop_contaminated(docs, benchmark)
    clean = lambda t: len(brute_hits(t, [(n if n is not None else "", x) for n, x in items])[2]) < 2
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter((i, t) for i, t in rows if clean(t))
    assert kept.columns == docs.columns
    assert decontaminate.find_contamination(docs, benchmark.limit(0)).agg(F.max("n_hit")).first()[0] == 0
    assert decontaminate.find_contamination(docs.limit(0), benchmark).count() == 0


def test_postings_are_complete(spark):
    """The written index holds every token that a phrase of the benchmark could hold, at its place."""
    from stratabox.llm.common import Scratch, WordHashes

    texts, items = ["red green blue red", "blue red", "one two", None], ["green blue", "red"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) key", "text")
    kept = decontaminate.filter_of(spark.createDataFrame([(x,) for x in items], "text string"), False)
    documents, postings = decontaminate.index(docs, Scratch(spark, "t"), kept)
    names = {int(np.uint64(h).view(np.int64)): w for w, h in ((w, WordHashes()[w]) for w in b"red green blue one two".split())}
    ids = {r["row"]: r["doc_id"] for r in documents.collect()}
    got = {(names[r["term"]], ids[r["row"]]): r["at"] for r in postings.collect()}
    assert got == {(b"red", 0): [0, 3], (b"green", 0): [1], (b"blue", 0): [2], (b"red", 1): [1]}


def test_proximity(spark):
    docs = docs_of(spark, ["red x green y blue", "red x x x x x x x x x green blue", None])
    benchmark = spark.createDataFrame([(1, "blue green red")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.find_near(docs, benchmark, 4).collect()] == [(0, "1")]


def test_proximity_is_exact(spark):
    rng = random.Random(4)
    words = "red green blue gray pink".split()
    texts = [" ".join(rng.choice([*words, "x", "y", "z"]) for _ in range(rng.randint(0, 25))) for _ in range(40)]
    items = [" ".join(rng.sample(words, rng.randint(1, 4))) for _ in range(6)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.find_near(docs_of(spark, texts), benchmark, 3).collect())
    for d, t in enumerate(texts):
        at = {w: [k for k, x in enumerate(t.split()) if x == w] for w in words}
        for i, item in enumerate(items):
            own = item.split()
            least = min(len(at[w]) for w in own)
            near = {any(all(any(abs(p - q) <= 3 for q in at[o]) for o in own) for p in at[w]) for w in own if len(at[w]) == least}
            if len(near) == 1:  # where several terms are rarest, either may be started from
                assert got[d, str(i)] == near.pop()


# --- decoding against exhaustive search


def test_decoder_finds_the_least_cost():
    """Viterbi against every reading of short tokens."""
    counts = toxicity.trigrams(["the cat sat on the mat and an idiot ate it all", "leet style is not nice at all"] * 3)
    decoder = toxicity.Decoder(counts)

    def cost(text, channel):
        a = b = 0
        total = channel
        for c in text:
            if c == " ":
                if b:
                    total += decoder.costs[a][b][0]
                    a, b = b, 0
            else:
                k = toxicity.class_of(c)
                total += decoder.costs[a][b][k]
                a, b = b, k
        return total + (decoder.costs[a][b][0] if b else 0.0)

    for token in ("1d10t", "id!ot", "c.a.t", "caaat", "l33t", "a t e", "aal!", "$at", "t-h-e", "ooo"):
        arcs, readings = [x for x, _ in decoder.arcs(token)], []

        def walk(at, text, channel, arcs=arcs, readings=readings, token=token):
            if at == len(token):
                readings.append(cost(text, channel))
                return
            for j, out, c in arcs[at]:
                walk(j, text + out, channel + c)

        walk(0, "", 0.0)
        assert math.isclose(decoder.read(token)[1], min(readings), rel_tol=1e-9), token


def test_decoder_writes_out_long_readings(monkeypatch):
    counts = toxicity.trigrams(["the cat sat on the mat and an idiot ate it all"] * 3)
    decoder = toxicity.Decoder(counts)
    rng = random.Random(2)
    long = "".join(rng.choice("c4t1d0.s-aaa") for _ in range(3000))
    whole = decoder.read(long)
    monkeypatch.setattr(toxicity, "SETTLE", 7)
    assert decoder.read(long) == whole
    for token in ("a" * 50_000, "-" * 50_000, "1" * 50_000, "id" + "." * 50_000 + "iot"):
        assert len(decoder.read(token)[0]) < 50


def test_trigrams_in_pieces(monkeypatch):
    texts = ["Some words, and more words", "x", "", "the end of it"]
    whole = toxicity.trigrams(texts)
    monkeypatch.setattr(toxicity, "PIECE", 5)
    assert (toxicity.trigrams(texts) == whole).all()


# --- language: what counts as a letter, long texts


def test_language_letters_and_pieces():
    field = lang_id.fit([(t, lang) for t, lang in zip(*lang_docs(60), strict=True)])
    predictor = lang_id.Predictor(field)
    langs, scores = predictor.predict(["² ½", "①②", "Ⅷ", "12 ... !", None, "kalu mira"] + ["kalu mira", "kalu mira"])
    assert langs[:5] == ["und"] * 5 and scores[:5] == [0.0] * 5 and langs[5] == langs[6] == langs[7] == "aa"
    long = " ".join(f"w{k}" for k in range(100_000))
    got = lang_id.pieces_of(long).split()
    assert len(got) == lang_id.PIECES * lang_id.PIECE and got[0] == "w0" and got[-1] == "w99999"
    assert lang_id.pieces_of("one two") == "one two"
