"""Extraction, quality, personal data and toxicity against plain Python, with nulls, ties, repeats and long texts."""

import collections
import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortpanel.llm import extraction, pii, quality, toxicity
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def chain():
    return extraction.trained()


def test_extraction_held_out(chain):
    wrong = total = 0
    for blocks, labels in extraction.labelled_pages(150, seed=99):
        wrong += sum(a != b for a, b in zip(chain.decode(blocks), labels))
        total += len(labels)
    assert wrong / total < 0.02


def test_extraction_of_unseen_layouts():
    """Roots and boilerplate of a fold are in no training page; some folds are far from all the others."""
    wrong = [extraction.unseen_layouts(fold, n_pages=300) for fold in range(4)]
    assert max(wrong) < 0.25 and sorted(wrong)[1] < 0.08, wrong


def small_chain():
    maker = extraction.labelled_pages(12, seed=3)
    return [(blocks[:7], labels[:7]) for blocks, labels in maker if blocks]


def score_of(chain, blocks, labels):
    emitted = [chain.bias + sum(chain.emission.get(f, 0.0) for f in extraction.features(b)) for b in blocks]
    total = chain.begin[labels[0]] + chain.end[labels[-1]] + sum(e for e, y in zip(emitted, labels) if y)
    return total + sum(chain.move[a][b] for a, b in zip(labels, labels[1:]))


def test_viterbi_equals_enumeration():
    r = random.Random(4)
    for blocks, _ in small_chain():
        chain = extraction.Chain(
            {f: r.uniform(-1, 1) for b in blocks for f in extraction.features(b)}, r.uniform(-1, 1), [[r.uniform(-2, 2) for _ in "ab"] for _ in "ab"], [r.uniform(-1, 1), r.uniform(-1, 1)], [r.uniform(-1, 1), r.uniform(-1, 1)]
        )
        best = max(itertools.product((0, 1), repeat=len(blocks)), key=lambda y: score_of(chain, blocks, y))
        assert [int(x) for x in chain.decode(blocks)] == list(best)


def test_likelihood_equals_enumeration():
    pages = small_chain()
    data = extraction.arrays(pages)
    r, k = np.random.default_rng(1), len(data.names)
    w = r.normal(size=k + 9)
    chain = extraction.Chain({f: w[c] for f, c in data.names.items()}, w[k], w[k + 1 : k + 5].reshape(2, 2), w[k + 5 : k + 7], w[k + 7 :])
    want = 0.0
    for blocks, labels in pages:
        scores = [score_of(chain, blocks, y) for y in itertools.product((0, 1), repeat=len(blocks))]
        want += np.logaddexp.reduce(scores) - score_of(chain, blocks, [int(x) for x in labels])
    value, gradient = extraction.likelihood(w, data)
    assert value == pytest.approx(want)
    for c in [*r.choice(k, 12), *range(k, k + 9)]:
        step = np.zeros_like(w)
        step[c] = 1e-5
        slope = (extraction.likelihood(w + step, data)[0] - extraction.likelihood(w - step, data)[0]) / 2e-5
        assert gradient[c] == pytest.approx(slope, abs=1e-5)


def named(n):
    return "".join(f"<div class={''.join(chr(97 + int(c)) for c in str(i))}>x" for i in range(n))


LONG = {
    "open tags": "<a " * 350_000, "nested": "<div>x " * 150_000, "declarations": "<!" * 500_000, "quotes": '<a " > " ' * 110_000, "items": "<div>" * 60_000 + "<li>x" * 60_000,
    "end tags": "<div>" * 100_000 + "</p>" * 100_000, "raw": "<script>" + "</script " * 110_000, "names": named(50_000), "apostrophes": "<a '" * 250_000 + ">", "numbers": "&#" + "9" * 1_000_000 + ";",
    "comments": "<!--" * 250_000, "long value": '<a title="' + "x" * 1_000_000 + '">y', "paragraphs": "<p>x" * 250_000, "links": "<a href='x'>y</a>" * 60_000,
}


def steps(page, chain):
    """Lines of the operator's code that reading and decoding a page takes."""
    import sys

    n = 0

    def line(frame, event, arg):
        nonlocal n
        n += event == "line"
        return line

    before = sys.gettrace()
    sys.settrace(lambda frame, event, arg: line if frame.f_code.co_filename == extraction.__file__ else None)
    try:
        chain.text(page)
    finally:
        sys.settrace(before)
    return n


@pytest.mark.parametrize("name", LONG)
def test_long_pages_take_linear_time(chain, name):
    """Steps grow with the page; the whole page is read within a time that no scan of its rest at each tag would meet."""
    import time
    import tracemalloc

    page = LONG[name]
    few, more = (steps(page[: len(page) // k], chain) for k in (64, 16))
    assert more < 5 * few + 1000  # sixteen times if quadratic
    began = time.process_time()
    chain.text(page)
    assert time.process_time() - began < 40
    tracemalloc.start()
    extraction.leaf_blocks(page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6


def test_odd_markup():
    text = lambda page: [b.text for b in extraction.leaf_blocks(page)]
    assert text('<p title="a>b">x<p title=">y') == ["x", "y"] and text("1 < 2 <b>3</b> <4") == ["1 < 2 3 <4"]
    assert text("<p>a<!-- <p> -->b<!---->c<!-- d") == ["abc"] and text("<script>x</scripty>y</script >z") == ["z"]
    assert text("&#65;&#0000000066;&#x43; &#99999999999; &amp;lt; &nope;") == ["ABC � &lt; &nope;"]
    path = lambda page: [[e.tag for e in b.element.path()] if b.element else [] for b in extraction.leaf_blocks(page)]
    assert path("<ul><li>a<ul><li>b<li>c</ul>d<li>e</ul>") == [["li", "ul"], ["li", "ul", "li", "ul"], ["li", "ul", "li", "ul"], ["li", "ul"], ["li", "ul"]]
    assert path("<table><tr><td>a<td>b<tr><td><p>c<th>d</table>e<p>f</nav>") == [["td", "tr", "table"]] * 2 + [["p", "td", "tr", "table"], ["th", "tr", "table"], [], ["p"]]
    once = extraction.leaf_blocks("<div class='a b'><div class=a><p>x")[0]
    assert sorted(f for e in once.element.path() for f in e.fresh) == ["in:div", "in:p", "name:a", "name:b"]


ONE, TWO, HEAD = "The water rose in the night. By morning the lower fields were gone, but nobody was hurt.", "It fell again after a week. The fields came back slowly.", "The river in spring"
MENU = "<nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav>"
ARTICLE = f"<article><h1>{HEAD}</h1><p>{ONE}</p>%s<p>{TWO}</p></article>"
WHOLE = [HEAD, ONE, TWO]
#: Pages of shapes that no generated page has whole, and their main text.
WRITTEN = {
    "self-closed script": (f"<title>T</title>{MENU}" + ARTICLE % "<script src=/x/>window.track = 1; load(1);</script>", WHOLE),
    "self-closed quoted script": (MENU + ARTICLE % '<script src="x"/>var y=1;</script>', WHOLE),
    "self-closed style": (MENU + ARTICLE % "<style/>p {color: red}</style>", WHOLE),
    "self-closed svg": (MENU + ARTICLE % "<svg width=1 /><math/>", WHOLE),
    "svg": (MENU + ARTICLE % "<svg><text>label of the drawing</text></svg>", WHOLE),
    "noscript": (MENU + ARTICLE % "<noscript><p>Please turn on scripts to read this page.</p></noscript>", WHOLE),
    "textarea": (MENU + ARTICLE % "<textarea>your text <p>here</textarea>", WHOLE),
    "select": (MENU + ARTICLE % "<select><option>one day<option>two days</select>", WHOLE),
    "button": (MENU + ARTICLE % "<button><span>Press me now</span></button>", WHOLE),
    "unclosed button": (MENU + "<div><button>Press</div>" + ARTICLE % "", WHOLE),
    "form": (MENU + ARTICLE % "<form><label>Mail</label><input><button>Send</button></form>", WHOLE),
    "thread by another name": (MENU + ARTICLE % "" + '<section id="disqus_thread"><p>Ann says: what a nice post, I liked it a lot.</p><p>Bob wrote: me too, thank you.</p></section>', WHOLE),
    "responses": (ARTICLE % "" + "<div class=responses><h3>2 responses</h3><p>Ann says: what a nice post.</p><p>Bob says: me too.</p></div>", WHOLE),
    "unnamed containers": (f"<body><div><div><p>{ONE}</p><p>{TWO}</p></div><div><p>Leave a reply. I like this post, said Bob.</p></div></div>", [ONE, TWO]),
    "no title": (f"<body>{MENU}<main><p>{ONE}</p><p>{TWO}</p></main><footer>&copy; 2020 The Paper</footer>", [ONE, TWO]),
    "no markup": (f"{ONE} {TWO}", [f"{ONE} {TWO}"]),
    "table": (f"<table><tr><td><ul><li><a href=/>Home</a></ul><td class=text><p>{ONE}<p>{TWO}</table>", [ONE, TWO]),
    "notice": ('<div id="cookie-notice">We use cookies. <a href=/p>Privacy</a></div>' + ARTICLE % "", WHOLE),
    "sidebar": (ARTICLE % "" + "<aside><h3>More</h3><p>Read our paper every day.</p></aside>", WHOLE),
    "advert": (ARTICLE % '<div class="ad">Buy two boats and pay for one.</div>', WHOLE),
    "references": (ARTICLE.replace("night.", "night &amp; day&#46;") % "<!-- a > b -->", [HEAD, ONE.replace("night.", "night & day."), TWO]),
}


@pytest.mark.parametrize("name", WRITTEN)
def test_written_pages(chain, name):
    page, want = WRITTEN[name]
    assert chain.text(page).split("\n") == want


def test_extraction_pages(spark, chain):
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var x='</p>';</script></head><body><nav><ul><li><a href=/a>Home page</a></ul></nav><!-- ad -->"
        '<div class="ad">Buy it now, it is good.</div><article><h1>A &amp; B</h1><p><b>One\n  two.<br>three<p>Four &lt;five&gt;.</p><section class="comments"><p>Nice article, thanks.</p></section></article><footer>&copy; me &middot; all</footer>'
    )
    rows = [(1, page, "x"), (2, None, "x"), (3, "", "x"), (1, page, "x"), (4, "<p>" * 3000 + "<article><p>" + "long words here. " * 5000, "x"), (5, "<div <p <!-- <script>", "x")]
    got = extraction.extract(spark.createDataFrame(rows, "page_id int, html string, text string"), chain).collect()
    texts = collections.defaultdict(list)
    for r in got:
        texts[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert texts[1] == ["A & B\nOne two. three\nFour <five>."] * 2 and texts[2] == texts[3] == [""]
    assert texts[4] == [("long words here. " * 5000).strip()]
    assert extraction.extract(spark.createDataFrame([], "page_id int, html string"), chain).count() == 0


def repeated(words):
    seen = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return len({i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)})


def test_quality_figures(spark):
    r = random.Random(3)
    texts = [None, "", " \t\n", "a b c", "a a a a", "x\nx\n\nx \nx", "#|&<> é\u2003b"] + [" ".join(r.choices("ab", k=n)) for n in (5, 40, 3000)] + ["\n".join(r.choices(["a b", "c", ""], k=50))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for row in quality.base_figures(df).collect():
        t = texts[row["doc_id"]] or ""
        words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        assert row["n_words"] == len(words) and row["word_chars"] == sum(map(len, words)) and row["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert row["n_dup_lines"] == len(lines) - len(set(lines)) and row["n_repeat_words"] == repeated(words), t[:40]


def test_binomial_tail(spark):
    from math import comb

    cases = [(0, 10), (3, 200), (12, 1000), (40, 3000)]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p"))
    for k, n, p in df.collect():
        assert p == pytest.approx(sum(comb(n, i) * 0.02**i * 0.98 ** (n - i) for i in range(k + 1)), rel=1e-9)


def test_quality_cutoffs(spark):
    good = [(i, " ".join(f"w{i}x{k}" for k in range(60)), "en") for i in range(1500)]
    bad = [(5000 + i + 500 * (lang is None), " ".join(f"w{i}x{k}###" for k in range(60)), lang) for i in range(5) for lang in ("en", None)]
    extra = [(9000, None, "en"), (9000, None, "en"), (9001, "long words " * 100_000, "en")]
    docs = spark.createDataFrame(good + bad + extra, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("kept", "stratum", "n_words", "held")})
    labels = spark.createDataFrame([(i, 1) for i in range(1500)] + [(7, None), (None, 1)], "doc_id long, quality int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == len(good) + len(bad) + 3 and all(r["stratum"] == r["held"] == "clash" for r in got)
    kept = {(r["doc_id"], r["lang"]): r["kept"] for r in got}
    assert all(kept[i, "en"] for i in range(1500)) and not kept[5000, "en"] and kept[5500, None]  # no labels, no cutoff
    assert not kept[9000, "en"] and not kept[9001, "en"]
    assert quality.judge(docs.limit(0), labels).count() == 0
    # cutoffs and verdicts word by word, with the binomial sum in full
    tables = {"documents": docs.select("doc_id", "text", "lang").where("doc_id < 9000").toPandas(), "labels": labels.toPandas()}
    con = duckdb.connect()
    for name, pdf in tables.items():
        con.register(name, pa.Table.from_pandas(pdf))
    want = con.sql(f"SELECT doc_id, lang, kept FROM ({quality.ORACLE_SQL}) JOIN documents USING (doc_id)").fetchall()
    assert {(i, lang): k for i, lang, k in want} == {x: k for x, k in kept.items() if x[0] < 9000}


def test_quality_of_repeated_ids(spark):
    """Rows of one labelled id give one held-out row, the same one in every order."""
    rows = [(i % 300, " ".join(f"w{i}x{k}{'#' * (i % 2)}" for k in range(60)), "en") for i in range(600)]
    labels = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    verdicts = [sorted((r["doc_id"], r["n_symbols"], r["kept"]) for r in quality.judge(d, labels).collect()) for d in (docs, docs.repartition(5, "text"))]
    assert verdicts[0] == verdicts[1]


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(text):
    digits = lambda x: re.sub("[^0-9]", "", x)
    luhn = lambda x: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(x))) % 10 == 0
    rules = (("email", EMAIL, lambda m: True), ("ip", IP, lambda m: all(int(x) <= 255 for x in m.split("."))), ("card", CARD, lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", PHONE, lambda m: 10 <= len(digits(m)) <= 15))
    found = sorted((m.start(), k, f"{n}:{m.start()}:{m.end()}") for k, (n, p, ok) in enumerate(rules) for m in p.finditer(text) if ok(m[0]))
    return ",".join(x[2] for x in found)


def test_base_spans(spark):
    r = random.Random(5)
    texts = ["".join(r.choices("ab1@. +-()4\x01é", k=r.randint(0, 60))) for _ in range(400)]
    texts += ["a@b.c_d@e.f", "4242 4242-42424242", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.003.4", "+1 (555) 010-9999.", "é" * 50 + " x@y.zz", "1 " * 8000, "9" * 20000, "a." * 9000 + "@b.c", "a@" + "b." * 5000 + "c", "x@y.z " * 700]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for row in df.select("i", pii.listed(pii.base_spans(F.col("text"))).alias("s")).collect():
        assert row["s"] == base(texts[row["i"]]), texts[row["i"]][:60]


def test_terms_and_sanitised(spark):
    rows = [(i, f"the office of Zorbix wrote to jim@corp.example.com about the {w} again", "x") for i, w in enumerate(["tea", "cup", "pot", "pan"])]
    rows += [(10 + i, f"the office said the {w} is about to leave again", "x") for i, w in enumerate("abcdefghijklmnopqrstuvwxyz" * 8)]
    rows += [(500, None, "x"), (None, "Zorbix, alone", "x"), (0, rows[0][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string")
    got = pii.with_spans(docs).select("doc_id", "text", pii.listed(F.col("spans")).alias("s"), F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("h")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = r["text"] or ""
        at = text.find("Zorbix")
        assert r["h"] == hashlib.sha256(base(text).encode()).hexdigest()
        assert ("generalised" in r["s"] or "removed" in r["s"]) == (at >= 0)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert clean[500] is None and "Zorbix" not in clean[None] and "[EMAIL]" in clean[1] and "@" not in clean[1] and clean[10] == rows[4][1]
    assert pii.with_spans(docs.limit(0)).count() == 0


def test_terms_of_rare_entities(spark):
    common = [(100 + i, f"the office said w{i}x is about to leave again with the other people of the street") for i in range(300)]
    # one value in one text; values of one domain in two texts; the same text copied is no more evidence than once
    rows = [(1, "the office of Zorbix is with ann@one.example.org again"), (2, "the other street of Quibble said bob@two.example.org again"), (3, "Quibble is about to leave the office with eve@two.example.org again")]
    rows += [(10 + i, "Mumblet said to cy@three.example.org the office") for i in range(60)] + [(90, "Mumblet is about to leave"), (91, "Mumblet said the street")]
    got = {r["term"]: r["kind"] for r in pii.disclosures(spark.createDataFrame(rows + common, "doc_id int, text string")).collect()}
    assert got == {"zorbix": "generalised", "quibble": "generalised"}
    copies = pii.disclosures(spark.createDataFrame([r for r in rows if r[0] < 90] + common, "doc_id int, text string")).collect()
    assert {r["term"]: r["kind"] for r in copies} == {"zorbix": "generalised", "quibble": "generalised", "mumblet": "generalised"}


def test_context_words_are_whole(spark):
    gap = " 1" * 300 + "\n" * 300
    text = f"Outside one two three four five six seven Farleft{gap} éann@one.example.orgé {gap}Farright two three four five six seven {'z' * 400} beyond"
    common = [(100 + i, "one two three four five six seven") for i in range(300)]
    docs = spark.createDataFrame([(1, text)] + [(i, f"{w} w{i}") for i, w in common], "doc_id int, text string")
    assert {r["term"] for r in pii.disclosures(docs).collect()} == {"farleft", "farright", "z" * 400}


def test_toxicity_equals_a_plain_model(spark):
    """Scores of a small table by counts and gradient steps written out plainly."""
    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdef", k=3))
    rows = [(" ".join(word() for _ in range(12)) + (" zzz" if i % 3 == 0 and i % 7 else ""), int(i % 3 == 0)) for i in range(60)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"), min_chi=0, bits=14)
    grams = [set(toxicity.ngrams(t, 14).tolist()) for t, _ in rows]
    names = sorted(set().union(*grams))
    x = np.array([[g in found for g in names] for found in grams], float)
    y = np.array([toxic for _, toxic in rows], float)
    pos, neg = (x[y == 1].sum(0) + 1) / (y.sum() + 2), (x[y == 0].sum(0) + 1) / ((1 - y).sum() + 2)
    scaled = x * np.log(pos / neg)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, b = np.zeros(len(names)), 0.0
    for _ in range(30000):
        error = share * (1 / (1 + np.exp(-(scaled @ w + b))) - y)
        w, b = w - 0.2 * (scaled.T @ error + toxicity.RIDGE * w), b - 0.2 * error.sum()
    plain = 1 / (1 + np.exp(-(scaled @ w + b)))
    got = np.array([model.score(t) for t, _ in rows])
    assert np.abs(got - plain).max() < 1e-3 and ((got > 0.5) == (plain > 0.5)).all()


def test_toxicity(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choices("etaoinshrdlu", k=r.randint(2, 8)))
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            words[r.randrange(40)] = "grumblex" + word()
        rows.append((i, " ".join(words), "clash"))
        labels.append((i, int(toxic)))
    rows += [(1000, None, "clash"), (1001, "", "clash"), (1002, "fine words " * 5000, "clash"), (None, "grumblexa", "clash"), (0, rows[0][1], "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("predicted", F.lit("clash")).withColumn("toxic", F.lit("clash"))
    got = toxicity.classify(docs, spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 for x in got)
    held = [x for x in got if x["doc_id"] is not None and x["doc_id"] < 400]
    assert np.mean([x["predicted"] == (x["doc_id"] % 4 == 0) for x in held]) > 0.97
    by = {x["doc_id"]: x for x in got}
    assert by[1000]["score"] == by[1001]["score"] and not by[1002]["predicted"] and by[None]["predicted"]
    assert all(x["toxic"] == "clash" for x in got) and toxicity.classify(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0
    none = toxicity.classify(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.agg(F.max("predicted")).first()[0] == 0
    assert spark.createDataFrame([(5,), (None,)], "d long").select(toxicity.held_out(F.col("d"))).collect()[1][0]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_leaf_blocks_never_fail(page):
    extraction.leaf_blocks("<div>" + page + "</div><p>" + page)
