"""Cross-tokenizer alignment against the definition, text by text."""

import collections
import hashlib
import random

import numpy as np
import pytest

from cohortpanel.llm import alignment


@pytest.fixture(scope="module")
def tokens():
    return alignment.tokenizers(alignment.VOCABULARY_A, alignment.VOCABULARY_B)


def ends(lengths, ids):
    return np.cumsum([int(lengths[i]) for i in ids]).tolist()


def plainly(texts, a, b):
    """Rows of the contract, by sets of ends."""
    found, in_docs = [], collections.Counter()
    for t in texts:
        x, y = (a.plain.encode(" " + t, add_special_tokens=False).ids, b.model.encode(t)) if t else ([], [])
        if not t or b.joined(y) != (" " + t).encode():
            found.append(None)
            continue
        ends_a, ends_b = ends(a.lengths, x), ends(b.lengths, y)
        assert ends_a[-1] == ends_b[-1] == len((" " + t).encode())
        groups, p, q = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            u, v = ends_a.index(cut) + 1, ends_b.index(cut) + 1
            groups.append((x[p:u], y[q:v]))
            p, q = u, v
        links = collections.Counter((i, j) for u, v in groups for i in u for j in v)
        in_docs.update(links.keys())
        found.append((x, y, groups, links))
    top = collections.defaultdict(int)
    for (i, _), n in in_docs.items():
        top[i] = max(top[i], n)
    rows = []
    for one in found:
        if one is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        x, y, groups, links = one
        spelt = ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in groups)
        best = sum(n for k, n in links.items() if in_docs[k] == top[k[0]])
        rows.append((len(x), len(y), len(groups), sum(links.values()), best, sum(n * in_docs[k] for k, n in links.items()), hashlib.sha256(spelt.encode()).hexdigest()))
    return rows


def odd_texts():
    r = random.Random(3)
    texts = [None, "", "▁a", "<|endoftext|> <s>", "   ", "a  b\n\n c\t", "数据 漢字かな交じり文", "🤦🏼‍♂️" * 50, " x", "͸ Ⅷ ﬁ", "\x00\x1c \x85", "don't 12 1234"]
    texts += ["".join(r.choices("ab \n\t.,1é▂漢🤦'sABC", k=r.randint(1, 60))) for _ in range(200)]
    return texts + [" ".join(r.choices(["alpha", "beta's", "Ünï", "12.5", "x_y", "\n"], k=800)), texts[5], texts[5]]


@pytest.mark.parametrize("hot", [alignment.HOT_PAIRS, 40, 0])
def test_alignment_equals_the_definition(spark, tokens, hot):
    """With the counts of all, of some and of no pairs broadcast."""
    texts = odd_texts()
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, pairs string")
    got = {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in alignment.cross_alignment(docs, hot_pairs=hot).collect()}
    assert got == dict(enumerate(plainly(texts, *tokens)))


def test_empty_table_and_rows_without_id(spark, tokens):
    docs = spark.createDataFrame([(None, "same words"), (None, "same words"), (1, "same words")], "doc_id long, text string")
    assert alignment.cross_alignment(docs.limit(0)).collect() == []
    rows = alignment.cross_alignment(docs).collect()
    assert len(rows) == 3 and {r["count_sum"] for r in rows} == {3 * rows[0]["n_links"]}


def test_pieces_of_long_texts_have_the_tokens_of_the_whole(tokens, monkeypatch):
    a, b = tokens
    r = random.Random(5)
    for text in ["".join(r.choices("ab \n\t.,1é漢'sABC", k=3000)), "x" * 5000, " " * 300 + "a b", " ".join(["word"] * 900) + " "]:
        whole = tuple(x.tolist() for x in alignment.tokens_of(text, a, b))
        assert whole == (a.plain.encode(" " + text, add_special_tokens=False).ids, b.model.encode(text))
        parts = list(alignment.pieces(text, 50))
        assert " ".join(parts) == text
        monkeypatch.setattr(alignment, "pieces", lambda t, parts=parts: iter(parts))
        assert tuple(x.tolist() for x in alignment.tokens_of(text, a, b)) == whole
        monkeypatch.undo()


def test_groups_of_long_runs_without_cuts():
    """Ends that never meet make one leaf, wherever the next cut is; rounds grow with the logarithm of the run."""
    a = np.r_[np.arange(1, 40_001, 2), 50_000, 50_001, 50_003]
    b = np.r_[np.arange(2, 40_002, 2), 50_000, 50_002, 50_003]
    first_a, first_b = alignment.groups(a, b, np.array([0]), np.array([0]))
    assert first_a.tolist() == [0, 20_001] and first_b.tolist() == [0, 20_001]
    r = np.random.default_rng(1)
    for _ in range(200):
        n = int(r.integers(1, 300))
        a, b = (np.append(np.flatnonzero(r.random(n) < r.choice([0.05, 0.5, 0.95])) + 1, n + 1) for _ in range(2))
        cuts = np.intersect1d(a, b)
        first_a, first_b = alignment.groups(a, b, np.array([0]), np.array([0]))
        assert first_a.tolist() == [0, *(np.searchsorted(a, cuts)[:-1] + 1)] and first_b.tolist() == [0, *(np.searchsorted(b, cuts)[:-1] + 1)]


def test_links_of_large_groups(monkeypatch):
    r = np.random.default_rng(2)
    ids_a, ids_b = r.integers(0, 5, 60), r.integers(0, 4, 50)
    first_a, first_b, doc = np.array([0, 1, 30, 59]), np.array([0, 20, 21, 49]), np.array([0, 0, 1, 1])
    whole = [x.tolist() for x in alignment.links(ids_a, ids_b, first_a, first_b, doc, 4, 20)]
    monkeypatch.setattr(alignment, "LINKS", 25)
    assert [x.tolist() for x in alignment.links(ids_a, ids_b, first_a, first_b, doc, 4, 20)] == whole
    want = collections.Counter()
    for g in range(4):
        end_a, end_b = (first_a.tolist() + [60])[g + 1], (first_b.tolist() + [50])[g + 1]
        want.update(int(doc[g] * 20 + x * 4 + y) for x in ids_a[first_a[g] : end_a] for y in ids_b[first_b[g] : end_b])
    assert dict(zip(*whole)) == dict(want)
