"""Mixing, packing, near-duplicates, search, URL rules, archives and the pipeline against plain Python."""

import collections
import gzip
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from cohortpanel.llm import archives, common, mixing, neardup, packing, search, urls
from cohortpanel.llm import shingles as shingles_of
from cohortpanel.llm.common import word_array
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def water(sizes, weights, cap):
    left, full = float(sum(sizes)), set()
    while True:
        open_ = [i for i in range(len(sizes)) if i not in full]
        level = (left - sum(cap * sizes[i] for i in full)) / sum(weights[i] for i in open_) if open_ else 0
        over = {i for i in open_ if weights[i] * level > cap * sizes[i]}
        if not over:
            return [cap * s if i in full else weights[i] * level for i, s in enumerate(sizes)]
        full |= over


def test_mixing(spark):
    r = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 40))), s, "x") for i, s in enumerate(r.choices(["a", "b", "B", "é", None, "z"], [50, 1, 3, 9, 2, 1], k=600))]
    rows += [(None, "a b", "a", "x"), (7, None, "a", "x"), (3, rows[3][1], rows[3][2], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = mixing.mix(docs, F.size(word_array(F.col("text"))), run_rows=100).toPandas()
    assert len(got) == len(rows)
    names = sorted({x[2] for x in rows if x[2] is not None}, key=lambda s: s.encode()) + [None]
    size = [sum(len((x[1] or "").split()) for x in rows if x[2] == n) for n in names]
    want = water(size, [1 + i % 3 for i in range(len(names))], 3)
    for n, s, t in zip(names, size, want):
        part = got[got["source"].isna()] if n is None else got[got["source"] == n]
        assert part["source_size"].iloc[0] == s and part["target"].iloc[0] == pytest.approx(t)
        assert abs(part["taken"].sum() - t) <= 10 and (part["taken"] <= 3 * part["size"]).all()
    again = mixing.mix(docs.repartition(7), F.size(word_array(F.col("text"))), run_rows=100).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert sorted(got[key].astype(str).values.tolist()) == sorted(again[key].astype(str).values.tolist())
    told = mixing.repeated(mixing.mix(docs, F.size(word_array(F.col("text"))))).select(F.size(word_array(F.col("text"))).alias("n")).agg(F.sum("n")).first()[0]
    assert told == mixing.mix(docs, F.size(word_array(F.col("text")))).agg(F.sum("taken")).first()[0]
    assert mixing.mix(docs.limit(0), F.lit(1)).count() == 0


def test_mixing_of_long_texts(spark):
    docs = spark.createDataFrame([(1, "w " * 300_000, "a"), (2, "w " * 100, "a"), (3, "w " * 50, "b")], "doc_id int, text string, source string")
    got = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix(docs, F.size(word_array(F.col("text")))).collect()}
    # b stops at three times its 50 words
    assert got[1][0] == 300_000 and got[3] == (50, 150) and got[1][1] + got[2][1] == 300_000


def test_documents_without_words_are_repeated(spark):
    rows = [(i, "a b", "x") for i in range(4)] + [(10, None, "x"), (11, "", "x"), (12, " \n", "x")] + [(20 + i, "c d e f", "y") for i in range(4)] + [(30, None, "y"), (40, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    # 24 words, half of them from each of x (8 words: one and a half epochs) and y (16: three quarters); z has none
    mixed = mixing.mix(docs, F.size(word_array(F.col("text"))), weights=(1.0, 1.0, 1.0))
    got = [(r["doc_id"], r["text"]) for r in mixing.repeated(mixed).collect() if r["doc_id"] in (10, 11, 12, 30, 40)]
    assert sorted(got, key=str) == sorted([(10, None), (11, ""), (12, " \n")], key=str)


def test_first_fit_decreasing():
    r = np.random.default_rng(0)
    for sizes in (r.integers(1, 101, 300), np.full(7, 100), np.array([60, 50, 40, 50]), np.array([], int)):
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        free, expected = [], {}
        for i in np.argsort(-sizes, kind="stable"):
            k = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
            if k == len(free):
                free.append(100)
            expected[i] = (k, 100 - free[k])
            free[k] -= sizes[i]
        assert [(bins[i], offsets[i]) for i in range(len(sizes))] == [expected[i] for i in range(len(sizes))]


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    r = random.Random(4)
    texts = [None, "", "It's 42 <|endoftext|>x", "É ΟΔΟΣ.\x0bf\u0301i ﬁ"] + [" ".join("".join(r.choices("abcdeé.", k=r.randint(1, 9))) for _ in range(r.choice((3, 80, 3000)))) for _ in range(60)]
    rows = [(2**60 + i, t, "x") for i, t in enumerate(texts)] + [(None, "null id", "x"), (2**60 + 2, texts[2], "x")]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, offset string"), group_pieces=20).cache()
    want = collections.Counter()
    for k, t, _ in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), 2048):
            want[k, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()), len(ids)] += 1
    assert collections.Counter(tuple(r)[:5] for r in found.collect()) == want
    got = found.drop("doc_id").toPandas()
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part["offset"].tolist() == [0, *part["length"].cumsum()[:-1]] and part["length"].sum() <= 2048
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_packing_deals_repeated_and_long_documents_out(spark):
    rows = [(None, None)] * 500 + [(1, "a b " * 40_000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), group_pieces=50)
    assert got.count() == 500 + -(-80_001 // 2048)
    assert got.groupBy(F.shiftright("sequence_id", 40)).count().agg(F.max("count")).first()[0] < 120


@pytest.mark.parametrize("vocabulary", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokenizer_equals_whole_texts(vocabulary):
    words = packing.WordTokenizer(vocabulary)
    assert words.by_words == (vocabulary == packing.VOCABULARY)
    texts = ["It's 42%% <|endoftext|>x", "É ΟΔΟΣ.\x0bf\u0301i ﬁ", "a\x1cb c\u2028d 'll I'LL don't", "", None, "ÀÉ!? İstanbul ſt ß"]
    for t, ids in zip(texts, words.ids(texts)):
        assert ids.tolist() == words.encoder.encode(t or "", add_special_tokens=False).ids, t


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def test_shingle_sets_equal_words(monkeypatch):
    r = random.Random(2)
    texts = ["".join(r.choices("ABab \n\té", k=r.randint(0, 50))) for _ in range(400)] + [None, "", " \x0b", "x" * 5000, None, "a B " * 300]
    column = pa.array(texts).slice(3)
    for piece in (1 << 18, 7, 64):
        monkeypatch.setattr(shingles_of, "PIECE", piece)
        for n in (1, 4):
            seen = {}
            for t, got in zip(texts[3:], shingles_of.shingle_sets(column, n)):
                want = frozenset(shingles(t, n))
                assert len(got) == len(want) and (got[1:] > got[:-1]).all()
                assert seen.setdefault(want, got.tobytes()) == got.tobytes()
            assert len(set(seen.values())) == len(seen)


def test_with_facts_splits_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    rows = [(7, k) for k in range(60)] + [(k % 9 + 10, k) for k in range(40)]
    facts = collections.Counter(k for k, _ in rows)
    got = common.with_facts(spark.createDataFrame(rows, "key int, v int"), spark.createDataFrame([(k, n) for k, n in facts.items() if k != 12], "key int, n long"), "key", "n", len(rows)).collect()
    assert sorted(map(tuple, got)) == sorted((k, v, facts[k]) for k, v in rows if k != 12)


def test_near_duplicates_of_one_hub(spark):
    """A family larger than a block, whose members are linked with the hub or only with one another."""
    r = random.Random(5)
    words = ["".join(r.choices("abcdefgh", k=6)) for _ in range(3000)]
    root = words[:120]
    rows = [(i, " ".join(root[:60] + [words[200 + i]] + root[60:])) for i in range(90)]
    far = [root[k] if k % 9 else words[1000 + k] for k in range(120)]
    rows += [(500 + i, " ".join(far[:80] + [words[600 + i]] + far[80:])) for i in range(50)] + [(900, " ".join(words[2000:2100]))]
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=4, block=16).collect()}
    sets = {i: shingles(t, 4) for i, t in rows}
    want = {i: i for i in sets}
    for _ in range(4):
        for a, b in itertools.permutations(sets, 2):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                want[a] = min(want[a], want[b])
    assert got == want and len(set(want.values())) == 3


def test_near_duplicates(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choices("abcdefgh", k=5)) for _ in range(400)]
    rows, passage = [], r.choices(vocabulary, k=60)
    root = r.choices(vocabulary, k=150)
    for i in range(240):
        kind = i % 6
        words = list(root) if kind < 2 else r.choices(vocabulary, k=r.choice((3, 8, 40, 300)))
        if kind < 2:
            for _ in range(r.randint(0, 9)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
        if kind == 3:
            words = words + passage
        rows.append((i, " ".join(words).title() if kind == 1 else " ".join(words), "x"))
    rows += [(1000 + i, rows[i][1], "x") for i in range(0, 60, 7)] + [(2000, None, "x"), (2001, "", "x"), (2002, " ", "x"), (5, rows[5][1], "x"), (None, rows[6][1], "x"), (2003, "one two", "x"), (2004, "ONE two", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = neardup.near_duplicates(docs, n=4, block=16).collect()
    assert len(got) == len(rows)
    sets = [shingles(t, 4) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), 10**9))
    want = collections.Counter((i, len(sets[k]), least.get(find(k)), i == least.get(find(k))) for k, (i, _, _) in enumerate(rows))
    assert collections.Counter(map(tuple, got)) == want
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        neardup.near_duplicates(docs, percent=70)


def test_top_k(spark):
    r = np.random.default_rng(3)
    vectors = [(int(i), [float(x) for x in np.round(r.normal(size=24), 1)]) for i in range(300)]
    vectors += [(300, None), (350, [1.0, None] + [0.0] * 22), (400, [float("nan")] * 24), (450, [float("inf")] + [0.0] * 23), (500, []), (550, [1.0, 2.0]), (551, [3.0, 4.0]), (None, [1.0] * 24), (600, vectors[1][1]), (601, vectors[1][1]), (50, vectors[50][1])]
    vectors += [(100, [-9.0] * 24), (700, [0.5] * 24), (700, [0.5, 0.25] * 12)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, embedding array<double>, rank string, q int")
    got = {(q, k): (i, s) for q, k, i, s in search.top_k(df, F.col("vec_id") % 50 == 0, candidates=64, queries=4).collect()}
    fine = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all()]
    want = {}
    asked = {}
    for i, v in fine:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, v), v, key=list)
    for q, v in asked.items():
        best = sorted((-int(v @ w), i) for i, w in fine if i != q and len(w) == len(v))[:5]
        want |= {(q, k): (i, -s) for k, (s, i) in enumerate(best, 1)}
    assert got == want
    assert search.top_k(df.limit(0), F.lit(True)).count() == 0


def test_url_rules(spark):
    given = ["http://a.example.NET/en/x?q#f", "https://example.net", "x://example.net/en", "http://sub.example.com/de/", "http://site.org/fr/1", "http://notexample.com/de/", None, "", "no scheme", "http://a?b://c/", "http://é.net:80/", "http://net/", "A://B://net/x"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(given)], "page_id int, url string, rule string")

    def judge(u):
        rest = (u or "").partition("://")[2] if u and "://" in u else ""
        host = rest[: min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))]
        path = rest[len(host) :]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
        host = host.translate(LOWER)
        fits = [(h.count("."), len(p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[2:] if fits else (None, "allow")))

    for found in (urls.judge(df), urls.judge(df, max_broadcast=0)):
        assert found.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
        assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found.collect()} == {i: judge(u) for i, u in enumerate(given)}
    odd = urls.Trie([("a.b", "/x", "block"), ("b", "/x/y/long", "allow"), ("b", "/", "allow"), ("b", "/", "block")])
    assert odd.find("z.a.b", "/xylophone") == ("a.b/x", "block") and odd.find("b", "/x/y/longer") == ("b/x/y/long", "allow") and odd.find("b", "/q") == ("b/", "block")


ARCS = [archives.ArcRecord("http://a/ b\n", "1.2.3.4", "20200102030405", "text/html", "-", b"HTTP/1.1 200 OK\r\n\r\nbody\nhttp://x 1 2 3 4"), archives.ArcRecord("http://c", "1.2.3.4", "20200102030405", "text/plain", "f", b"")]


def test_url_rules_by_trie_and_join_agree(spark):
    r = random.Random(7)
    label, segment = lambda: r.choice(["a", "B", "c", "É", ""]), lambda: r.choice(["x", "xy", "X", ""])
    host = lambda n: ".".join(label() for _ in range(n))
    path = lambda n: "/".join([""] + [segment() for _ in range(n)])
    rules = [(host(r.randint(1, 3)), path(r.randint(0, 3)), r.choice(["allow", "block"])) for _ in range(60)] + [("Example.NET", "/", "block"), ("example.net", "/", "allow")]
    given = [f"h://{host(r.randint(1, 4))}{path(r.randint(0, 4))}" for _ in range(400)] + [None, "", "h://", "http://a.example.net/x", "http://EXAMPLE.net/"] + ["h://" + "a." * 3000 + "c/" + "x/" * 3000]
    df = spark.createDataFrame([(i % 350, u, "x", "y") for i, u in enumerate(given)], "page_id int, url string, host string, verdict string")
    trie, join = (sorted(map(tuple, urls.judge(df, rules, "none", max_broadcast=n).collect()), key=str) for n in (1000, 0))
    assert trie == join and len(trie) == len(given) and {x[-1] for x in trie} == {"allow", "block", "none"}

    def plainly(u):
        rest = (u or "").partition("://")[2]
        h, slash, p = rest.partition("/")
        h = h.translate(LOWER)
        fits = [(g.count("."), len(q), v == "block") for g, q, v in rules for g in [g.translate(LOWER)] if h and (h == g or h.endswith("." + g)) and (slash + p).startswith(q)]
        return "none" if not fits else "block" if max(fits)[2] else "allow"

    assert all(x[-1] == plainly(x[1]) for x in trie)
    for n in (1000, 0):
        assert urls.judge(df.limit(0), rules, max_broadcast=n).count() == 0
    with pytest.raises(ValueError):
        urls.judge(df.select(F.col("url").alias("host")), url="host")


def test_arc_versions():
    for version in (1, 2):
        data = archives.arc_version_block(version, "n", "20200102030405") + b"".join(archives.arc_record(version, r) for r in ARCS)
        got = list(archives.read_arc(data))
        assert [r.content for r in got] == [r.content for r in ARCS] and got[0].url == "http://a/ b%0A"
        assert [r.content for r in archives.read_arc(data[:-2])] == [ARCS[0].content]  # its last line is cut off
    warc = archives.to_warc(ARCS[0])
    (head, block), = archives.read_warc(warc, False)
    assert head["WARC-Date"] == "2020-01-02T03:04:05Z" and block == ARCS[0].content and head["WARC-Type"] == "response" and "WARC-Filename" not in head
    assert len(list(archives.read_warc(gzip.compress(warc) + gzip.compress(warc), True))) == 2
    (again, nothing), = archives.read_warc(archives.to_warc(ARCS[0], archives.Original(head["WARC-Record-ID"], "http://o", "20190102030405")), False)
    assert again["WARC-Type"] == "revisit" and again["WARC-Refers-To"] == head["WARC-Record-ID"] and again["WARC-Refers-To-Date"] == "2019-01-02T03:04:05Z"
    assert again["WARC-Refers-To-Target-URI"] == "http://o" and nothing == b"HTTP/1.1 200 OK\r\n\r\n" and again["WARC-Payload-Digest"] == head["WARC-Payload-Digest"]


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("broken", [b"word\n", b"\n\n", b"http://x 1.2.3.4 20200102030405 text/html\n", b"http://x 1.2.3.4 20200102030405 text/html many\n", b"http://x 1 2 3 4\n", b"http://x 1.2.3.4 20200102030405 text/html 999999\n"])
def test_broken_arc_records_cost_themselves_alone(version, broken):
    one, two = (archives.arc_record(version, r) for r in ARCS)
    for head in (archives.arc_version_block(version, "n", "20200102030405"), b"filedesc://n 0.0.0.0 20200102030405 text/plain " + (b"" if version == 1 else b"200 - - 0 - ") + b"0\n\n"):
        got = list(archives.read_arc(head + one + broken + two))
        assert [r.content for r in got] == [r.content for r in ARCS] and (version == 1 or got[1].filename == "f")


def test_warc_bundles():
    r = random.Random(3)
    records = [archives.ArcRecord(f"http://{k}", "-", "20200102030405", "text/html", "-", b"HTTP/1.1 200 OK\r\n\r\n" + r.randbytes(n)) for k, n in enumerate([10, 5000, 40_000, 0, 300, 17 << 20])]
    files = list(archives.bundles(((x, None) for x in records), limit=20_000))
    assert len(files) == 2 and all(f[-1] == 0 for f in files)
    found = [list(archives.read_warc(f, True)) for f in files]
    assert [block for f in found for head, block in f[1:]] == [x.content for x in records]
    assert all(f[0][0]["WARC-Type"] == "warcinfo" and {h["WARC-Warcinfo-ID"] for h, _ in f[1:]} == {f[0][0]["WARC-Record-ID"]} for f in found)
    import io

    plain = io.BytesIO(files[0])
    with gzip.GzipFile(fileobj=plain) as whole:
        assert whole.read().count(b"WARC/1.0\r\n") == 4


def test_archives_round_trip(spark, tmp_path):
    body = "é\r\n\r\nWARC/1.0\r\n" * 100
    rows = [(1, "http://a", body), (9, "http://b\n", body), (4, None, body), (None, "n", body), (2, "http://c d", None), (3, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "x" * 300_000), (3, "u", ""), (None, None, "y" * 2000), (None, None, "y" * 2000)]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    pages = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "page_id long, url string, html string, record_type string, digest string, response string")
    got = collections.Counter(map(tuple, archives.round_trip(pages).select(*names).collect()))
    want = collections.Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if h == body and i != 9 else "response", 9 if h == body and i != 9 else None] += 1
    assert got == want
    assert archives.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    (tmp_path / "arcs").mkdir()
    data = archives.arc_version_block(1, "n", "20200102030405") + b"".join(archives.arc_record(1, r) for r in ARCS)
    (tmp_path / "arcs" / "a.arc").write_bytes(data)
    (tmp_path / "arcs" / "b.arc.gz").write_bytes(gzip.compress(data))
    archives.convert_arcs(spark, str(tmp_path / "arcs"), str(tmp_path / "warcs"))
    read = archives.read_archives(spark, str(tmp_path / "warcs")).collect()
    assert sorted(r["record_type"] for r in read) == ["resource", "resource", "response", "response"]


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(6)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(2, 7))) for _ in range(3000)]
    rows, labels = [], []
    for i in range(240):
        text = r.choices(words, k=80)
        if i % 5 == 0:
            text[3:5] = ["grumblexa", "grumblexo"]
            labels.append((i, 1, 1))
        else:
            labels.append((i, 1, 0))
        rows.append((i, " ".join(text), "en", f"s{i % 3}", 0))
    rows += [(500 + i, rows[i][1], "en", "s0", 0) for i in range(1, 4)] + [(600, "write to jim@corp.example.com now " + rows[7][1][::-1], "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    clean, left = {i for i in range(240) if i % 5} | {501, 502, 503, 600}, set(kept["toxicity"]["doc_id"])
    assert left <= clean and len(left) >= len(clean) - 4  # a model of 240 short rows may miss a few clean ones
    assert set(kept["near_duplicates"]["doc_id"]) == {i for i in left if i - 500 not in left}
    assert not kept["personal_data"]["text"].str.contains("@").any() and len(kept["personal_data"]) == len(kept["near_duplicates"])
    assert (kept["personal_data"]["n_chars"] == kept["personal_data"]["text"].str.len()).all()
    total = lambda x: x["text"].str.split().str.len().sum()
    assert abs(total(kept["mixing"]) - total(kept["personal_data"])) <= 3
    assert set(kept["packing"]["doc_id"]) == set(kept["mixing"]["doc_id"])


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and clashing columns; then an empty table."""
    r = random.Random(9)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(2, 7))) for _ in range(500)]
    text = lambda n: " ".join(r.choices(words, k=n))
    long = text(20_000)
    rows = [(i, text(60), "en", f"s{i % 2}", 1) for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \n", "en", None, 0), (None, None, None, None, None), (None, text(50), "en", "s1", 0), (103, long, "en", "s1", 0), (104, long + " x", "en", "s1", 0)]
    rows += [rows[3], rows[3], rows[40]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clash = {c: F.lit("clash") for c in ("score", "predicted", "kept", "key", "size", "target", "taken", "base", "spans", "_kept", "_source", "_mark", "start", "toxic", "component_id")}
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, schema).withColumns(clash)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path)).cache()
        found = got.collect()
        ids = [x["doc_id"] for x in found]
        if name == "toxicity":
            assert ids.count(100) == 2 and len(found) >= 40
        if name == "near_duplicates":
            assert ids.count(3) == 1 and ids.count(100) == 1 and 103 in ids and 104 not in ids and len(set(ids)) == 45 and ids.count(None) == 2
        if name == "personal_data":
            assert len(found) == len(rows) and {x["text"] for x in found if x["doc_id"] == 100} == {None}
        if name == "packing":
            want = sum(-(-n // 2048) for n in [x["doc_tokens"] for x in found if x["start"] == 0])
            assert len(found) == want and sum(x["start"] == 0 for x in found) == len(rows)
        else:
            assert got.columns == corpus_pipeline.COLUMNS
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
