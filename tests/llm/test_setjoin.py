"""The Jaccard join against all pairs."""

import collections
import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortpanel.llm import neardup, setjoin
from cohortpanel.llm.common import small_batches
from cohortpanel.llm.shingles import shingle_sets

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=4):
    words = (text or "").translate(LOWER).split()
    return {tuple(words)} if 0 < len(words) < n else {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def plainly(rows, percent):
    """(id, size, component) of all rows by comparing all pairs."""
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), 10**9))
    return collections.Counter((i, len(sets[k]), least.get(root(k)) if sets[k] else i) for k, (i, *_) in enumerate(rows))


def corpus(seed):
    """Unrelated texts, families around roots at all distances near the threshold, common passages and odd rows."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefgh", k=5)) for _ in range(500)]
    roots, passage, rows = [r.choices(vocabulary, k=k) for k in (9, 12, 25, 60, 150, 400)], r.choices(vocabulary, k=60), []
    for i in range(300):
        words = list(r.choice(roots)) if i % 2 else r.choices(vocabulary, k=r.choice((2, 7, 12, 40, 300)))
        if i % 2:
            for _ in range(r.randint(0, 1 + len(words) // 50)):
                at = r.randrange(len(words))
                words[at : at + r.randint(0, 2)] = r.choices(vocabulary, k=r.randint(0, 2))
        if i % 5 == 0:
            words = words + passage
        rows.append((i, (" " if i % 3 else "\n").join(words).title() if i % 7 == 1 else " ".join(words), "x"))
    rows += [(1000 + i, rows[i][1], "x") for i in range(0, 60, 7)] + [(2000, None, "x"), (2001, "", "x"), (2002, " ", "x"), (5, rows[5][1], "x"), (5, rows[7][1], "x"), (None, rows[7][1], "x"), (2003, "one two", "x"), (2004, "ONE two", "x")]
    return rows


@pytest.mark.parametrize("percent, costs", [(85, {}), (85, {"most": 2, "local": 4, "pack": 300}), (70, {"most": 4, "local": 9, "pack": 2000}), (95, {"most": 1})])
def test_join_equals_all_pairs(spark, percent, costs):
    """With usual costs, and with contents that are costly, or hot, from a few sets on."""
    rows = corpus(percent)
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = collections.Counter(map(tuple, setjoin.jaccard_components(docs, percent=percent, block=16, **costs).collect()))
    assert got == plainly(rows, percent)
    assert len({k for k, _, c in got if c is not None}) > len({c for _, _, c in got}) > 100


def test_empty_table(spark):
    assert setjoin.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        setjoin.jaccard_components(spark.createDataFrame([], "doc_id long, text string"), percent=100)


def keys(scheme, a, lower):
    _, value, tag = scheme.entries([a], lower)
    return value, tag


@pytest.mark.parametrize("percent", [60, 85, 90])
def test_linked_sets_meet_whatever_is_left_out(percent):
    """Pairs at the threshold share a looked-up key with each choice of contents to leave out, for sets of all sizes."""
    r = np.random.default_rng(percent)
    scheme = setjoin.Scheme(3000, percent)
    for _ in range(600):
        n = int(r.integers(1, 60) if r.random() < 0.7 else r.integers(60, 2000))
        large = np.unique(r.integers(-(2**62), 2**62, n + 1))[:n]
        # as many differences as the threshold allows, dealt to both sides
        union = n + int(r.integers(0, 4))
        gone = int(union * (100 - percent) // 100)
        added = min(union - n, gone)
        small = np.sort(np.concatenate([r.permutation(large)[gone - added :], r.integers(-(2**62), 2**62, added)]))
        both = len(np.intersect1d(large, small))
        if not both or 100 * both < percent * len(np.union1d(large, small)) or np.array_equal(large, small):
            continue
        if len(small) > len(large):
            large, small = small, large
        met = False
        for lower in (False, True):
            value, tag = keys(scheme, large, lower)
            index, own = keys(scheme, small, False)
            freq = r.integers(1, 200, len(value))
            used = setjoin.allocated(value.view(np.int64), tag, freq, int(scheme.deletions(scheme.needed(np.array([len(large)])))[0]), most=20).view(np.uint64)
            # cheap contents of whole segments always meet; those with a deletion among them if one looks them up
            cheap = value[(tag & setjoin.PROBE != 0) & (tag & setjoin.DELETED == 0) & (freq <= 20)]
            whole = index[own & setjoin.DELETED == 0]
            met |= bool(np.intersect1d(used, index).size or np.intersect1d(cheap, whole).size)
        assert met, (n, both)


def test_partners_are_in_the_same_band_or_the_next():
    for percent in (50, 70, 85, 99):
        scheme = setjoin.Scheme(20_000, percent)
        band = np.searchsorted(scheme.low, np.arange(1, 20_001), side="right") - 1
        least = -(-percent * np.arange(1, 20_001) // 100)
        assert ((band - band[least - 1]) <= 1).all()


def test_allocation_keeps_the_pigeonhole():
    tags = np.array([0, 1, 2, 3]) | setjoin.PROBE
    gone = np.array([0, 0, 1]) | setjoin.PROBE | setjoin.DELETED
    values, freqs = np.arange(7), np.array([5, 900, 800, 700, 3, 4, 100])
    used = set(setjoin.allocated(values, np.concatenate([tags, gone]), freqs, 2, most=20).tolist())
    # the content of segment 1 goes for the neighbourhood of segment 0 (cost 7), whose own content is looked up too
    assert used == {0, 2, 3, 4, 5}


def test_hot_contents_stay_out_of_their_bucket():
    value = np.array([7] * 100 + list(range(100, 150)), np.uint64) << np.uint64(40)
    cls, tag = np.arange(150), np.full(150, setjoin.PROBE)
    batch = setjoin.packed(value, cls, tag, 64, 0, local=10).to_pydict()
    entries = sum(len(v) // 8 for v, b, m in zip(batch["value"], batch["bucket"], batch["marks"]) if b >= 0 and not m)
    hot = sum(len(v) // 8 for v, b in zip(batch["value"], batch["bucket"]) if b < 0)
    counts = [int.from_bytes(c, "little") for c, m in zip(batch["cls"], batch["marks"]) if m]
    assert (entries, hot, counts) == (50, 100, [100])


def test_parities_bound_differences():
    """Never more bits than elements differ, whatever the sizes; unrelated sets differ in far more than linked ones may."""
    r = np.random.default_rng(4)
    for _ in range(200):
        a = np.unique(r.integers(-(2**62), 2**62, int(r.integers(1, 900))))
        b = np.unique(np.concatenate([a[: int(r.integers(0, len(a) + 1))], r.integers(-(2**62), 2**62, int(r.integers(1, 900)))]))
        size = np.array([len(a), len(b)])
        x, y = (np.frombuffer(setjoin.parity(s), "<u8") for s in (a, b))
        least = min(len(x), len(y))
        apart = int(np.bitwise_count(setjoin.folded(x, least) ^ setjoin.folded(y, least)).sum())
        assert apart <= len(np.setxor1d(a, b))
        linked = 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
        fits = setjoin.few_apart([setjoin.parity(a), setjoin.parity(b)], size, np.array([0]), np.array([1]), 85)
        assert fits[0] or not linked


def test_components_in_one_task_and_by_stars_agree(spark):
    r = random.Random(8)
    links = spark.createDataFrame([(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(400, k) for k in range(401, 440)], "a long, b long")
    found = [sorted((x["node"], x["component"]) for x in neardup.components(links, few).collect() if x["node"] != x["component"]) for few in (0, 10_000)]
    assert found[0] == found[1]


def families(k):
    """Sets of eight families around one text; families differ too much for a link, members of one in their last words."""
    r = random.Random(3)
    base, rows = [f"w{i}" for i in range(64)], []
    for i in range(k):
        words = list(base)
        for at in (8 + 6 * (i % 8), 11 + 6 * (i % 8)):
            words[at] = f"x{i % 8}y{at}"
        words[-1 - r.randrange(3)] = f"z{i}"
        rows.append((i, " ".join(words)))
    return rows


def test_sets_of_a_large_list_are_dealt_a_few_times(spark, monkeypatch):
    """Lists of many components and of many blocks of full sets are dealt to few pairs of blocks of parities."""
    dealt, rows = setjoin.dealt, []

    def counted(members, *args):
        rows.append((members.count(), (found := dealt(members, *args)).count()))
        return found

    monkeypatch.setattr(setjoin, "dealt", counted)
    docs = spark.createDataFrame(families(100), "doc_id long, text string")
    got = collections.Counter(map(tuple, setjoin.jaccard_components(docs, block=2).collect()))
    assert got == plainly(families(100), 85)
    ((sets, placed),) = rows
    assert sets and placed <= 6 * sets, rows


@pytest.mark.parametrize("kind", [0, 1])
def test_tiles_have_all_open_pairs(kind):
    """Of a block with itself and of two blocks, sorted rows in several batches."""
    sets = list(shingle_sets(pa.array([t for _, t in families(60)]), 4))
    rows = {"pivot": np.zeros(60, np.int64), "kind": np.full(60, kind, np.int32), "i": np.full(60, 2, np.int32), "j": np.full(60, 2 + kind, np.int32), "cls": np.arange(60), "side": np.arange(60) % 3 == 0, "n": np.array([len(s) for s in sets]), "root": np.arange(60) // 9, "bits": [setjoin.parity(s, 8) for s in sets]}
    table = pa.table({c: pa.array(v) for c, v in rows.items()})
    left, right = setjoin.near_pairs(rows["side"], kind == 0, rows["n"], rows["root"], rows["bits"], 85)
    want, got = {tuple(sorted(p)) for p in zip(left.tolist(), right.tolist())}, set()
    tiled = pa.Table.from_batches(setjoin.possible(85, block=7, tiled=True)(iter(table.to_batches(13)))).to_pandas()
    for (_, _, i, j), part in tiled.groupby(setjoin.ORDER):
        assert len(part) <= 14 and i // setjoin.TILES == 2 and j // setjoin.TILES == 2 + kind
        alone = kind == 0 and i == j
        got |= {tuple(sorted((a, b))) for a, x in zip(part["cls"], part["side"]) for b, y in zip(part["cls"], part["side"]) if a != b and (alone or (not x and y))}
    assert want and want <= got
    forest = pa.Table.from_batches(setjoin.possible(85, forests=True, block=7)(iter(table.to_batches(13)))).to_pandas()
    joins = lambda pairs: sorted(map(sorted, setjoin.forest_of([(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))])))
    assert set(map(tuple, forest.to_numpy().tolist())) <= want and len(forest) == len(joins(sorted(want)))
    kept = pa.Table.from_batches(setjoin.possible(85, block=7)(iter(table.to_batches(13)))).to_pandas()
    assert set(kept["cls"]) == {x for p in want for x in p}


def peak(work):
    """Bytes that Python and NumPy take at most during ``work``, beyond what they had."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_buckets_are_read_one_after_the_other():
    """A batch of many buckets is not copied whole."""
    r = np.random.default_rng(3)
    entries = lambda b: (b, False, r.integers(0, 1 << 62, 4000).astype("<u8").tobytes(), r.integers(0, 1 << 40, 4000).astype("<i8").tobytes(), np.full(4000, setjoin.PROBE, "<u4").tobytes())
    rows = [entries(b) for b in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "marks", "value", "cls", "tag"])
    assert peak(lambda: list(setjoin.gathered([batch]))) < batch.nbytes / 4


def test_jobs_of_the_join_have_small_arrow_batches(spark, monkeypatch):
    name, limits = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before, saved = spark.conf.get(name), setjoin.saved

    def noted(df):
        limits.append(int(spark.conf.get(name).rstrip("b")))
        return saved(df)

    monkeypatch.setattr(setjoin, "saved", noted)
    docs = spark.createDataFrame([(i, f"a{i % 3} b c d e") for i in range(9)], "doc_id long, text string")
    assert setjoin.jaccard_components(docs).count() == 9
    assert limits and max(limits) <= 4 << 20
    assert spark.conf.get(name) == before


def test_small_batches_bound_what_a_task_gets(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(64, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 17).alias("text"))
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    with small_batches(spark, 1 << 20):
        got = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
    assert len(got) > 4 and max(got) <= 2 << 20 and sum(got) >= 64 << 17
    own = spark.conf.get(name)
    for given in ("1000", "64MB"):  # a smaller limit, and one with a unit, are the user's own
        spark.conf.set(name, given)
        with pytest.raises(ZeroDivisionError), small_batches(spark):
            assert spark.conf.get(name) == given
            1 / 0
        assert spark.conf.get(name) == given
    spark.conf.set(name, own)
