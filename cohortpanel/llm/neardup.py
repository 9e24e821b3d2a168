"""Near-duplicates: bottom-k sketches of one hash function, inverted lists, union-sketch estimates, exact Jaccard.

1. A document's word shingles become 64-bit hashes; its sketch is the k smallest. Documents of equal sets form a class.
2. Inverted lists of sketch values hold classes. Two linked classes share at least ``need`` sketch values, so if each is
   listed only under its ``|sketch| - need + 1`` rarest values, they still meet (prefix filter). What many documents
   share by chance is common, hence late in this order, and mostly not listed at all.
3. Each value names a pivot, the class of its list whose sketch is the most common. Lists of one pivot are one group, so
   the many lists of a large family of copies fall together and its pairs are looked at once.
4. Every class of a group is compared with its pivot, first by sketches (the union's bottom-k estimates Jaccard), then on
   full sets. Classes linked with the pivot are of one component, so pairs among them need no look.
5. What is left of a group is cut into blocks, compared with one another and with the blocks of linked classes in the
   same two steps. Tasks return links that span the linked classes, not all of them: nothing quadratic leaves a task.
6. Links are contracted to components by alternating star operations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_slices, bounded_broadcast, checkpointed, table, with_facts
from .shingles import shingle_sets

SHINGLE_WORDS, THRESHOLD = 5, 80  # percent
SKETCH = 32
#: Sketch values that two full sketches of linked sets share at least; fewer has a chance of about 3e-9 a pair.
NEED = 11
#: Estimates below this rule a link out; at Jaccard 0.8 a sketch of 32 gives one with a chance of about 2e-8.
LOW = 0.36
#: Classes in a block, and shingles of their full sets; a task holds two blocks.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Keys that the members of a group of several blocks are dealt to where they meet the group's size.
SALTS = 64
#: Ids of documents whose full sets are made are broadcast up to this many; beyond, their texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def digest(shingles: np.ndarray) -> bytes | None:
    """Of a full set; null for the empty set."""
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def sketches(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, n_shingles, same, sketch): ``same`` is a digest of the full set, null for the empty set."""

    def make(batches):
        for batch in batches:
            for part in arrow_slices(batch, "text"):
                sets = list(shingle_sets(part["text"], n))
                kept = [s[:SKETCH] for s in sets]
                ends = np.cumsum([0, *map(len, kept)], dtype=np.int32)
                sketch = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept)))
                yield pa.RecordBatch.from_arrays([part["key"], pa.array([len(s) for s in sets], pa.int64()), pa.array(map(digest, sets), pa.binary()), sketch], ["key", "n_shingles", "same", "sketch"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(make, "key long, n_shingles long, same binary, sketch array<long>")


def needed(n: Column) -> Column:
    """Sketch values a class shares at least with each class it is linked with: 3/4 of a set that is all in its sketch
    (its partner has at most 5/4 of its size), NEED of others."""
    return F.when(n <= SKETCH, F.least(F.lit(NEED), F.ceil(n * 0.75))).otherwise(NEED).cast("int")


def listed(classes: DataFrame, total: int) -> DataFrame:
    """(value, cls, total, n): classes under the rarest values of their sketches, for values that two classes have at least.

    Values of one class alone are its rarest; they are counted, not carried along. ``total``: number of classes.
    """
    spread = classes.select("cls", "n", F.explode("sketch").alias("value"))
    common = spread.groupBy("value").agg(F.count("*").alias("freq")).where("freq > 1")
    ranked = with_facts(spread, common, "value", "freq", total * SKETCH).groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("freq", "value"))).alias("shared"))
    alone = F.least(F.col("n"), F.lit(SKETCH)).cast("int") - F.size("shared")
    ranked = ranked.withColumn("total", F.aggregate("shared", alone.cast("long"), lambda a, x: a + x["freq"]))
    prefix = F.slice("shared", F.lit(1), F.greatest(F.lit(0), F.size("shared") - needed(F.col("n")) + 1))
    return ranked.select("cls", "total", "n", F.explode(prefix).alias("v")).select(F.col("v.value").alias("value"), "cls", "total", "n")


def grouped(lists: DataFrame, total: int) -> DataFrame:
    """(pivot, cls, n): lists put together by their pivots; groups of one class are left out."""
    pivots = lists.groupBy("value").agg(F.max_by("cls", F.struct("total", -F.col("cls"))).alias("pivot"), F.count("*").alias("k")).where("k > 1")
    return with_facts(lists, pivots, "value", "k", total * SKETCH).select("pivot", "cls", "n").distinct()


def blocks_of(members: DataFrame, side: Column, block: int, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``members`` with ``left`` and ``right``, the blocks of the rows of its group with and without ``side``, and ``b``,
    the row's own block. Groups of several blocks are few; their members are salted to meet them."""
    count = lambda cond: F.ceil(F.greatest(F.count_if(cond) / block, F.sum(F.when(cond, F.col("n")).otherwise(0)) / shingles)).cast("int")
    members = members.withColumn("_side", side)
    sizes = members.groupBy("pivot").agg(count(F.col("_side")).alias("left"), count(~F.col("_side")).alias("right"))
    large = sizes.where("left > 1 OR right > 1").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = members.withColumn("_salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")).join(large, ["pivot", "_salt"], "left").drop("_salt")
    # no hot group is among the others
    rest = met.where("left IS NULL").drop("left", "right").join(sizes, "pivot")
    both = met.where("left IS NOT NULL").unionByName(rest)
    return both.withColumn("b", F.pmod(F.xxhash64(F.lit(1), "cls"), F.when(F.col("_side"), F.col("left")).otherwise(F.col("right"))).cast("int")).drop("_side")


def star(members: DataFrame, block: int) -> DataFrame:
    """(pivot, kind, i, j, cls, side): every class once in a block of its group, and the pivot (side) in each of them."""
    placed = blocks_of(members, F.col("cls") != F.col("pivot"), block)
    hub = F.col("cls") == F.col("pivot")
    at = F.explode(F.when(hub, F.sequence(F.lit(0), F.col("left") - 1)).otherwise(F.array("b")))
    return placed.select("pivot", F.lit(2).alias("kind"), at.alias("i"), F.lit(0).alias("j"), "cls", hub.alias("side"))


def dealt(members: DataFrame, linked: DataFrame, block: int, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(pivot, kind, i, j, cls, side): what ``linked`` (pivot, cls) leaves over, once for every pair of blocks i <= j of its
    own (kind 0) and every block of linked classes (kind 1: i of the rest, j of the linked, side True)."""
    marked = members.where("cls <> pivot").join(linked.select("pivot", "cls", F.lit(True).alias("done")), ["pivot", "cls"], "left").withColumn("open", F.col("done").isNull())
    placed = blocks_of(marked, F.col("open"), block, shingles).where("left > 0")
    other = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    place = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    among = F.transform(other(F.col("left")), lambda o: place(0, F.least("b", o), F.greatest("b", o), F.col("b") > o))
    beside = F.transform(other(F.col("right")), lambda o: place(1, F.col("b"), o, F.lit(False)))
    facing = F.transform(other(F.col("left")), lambda o: place(1, o, F.col("b"), F.lit(True)))
    return placed.select("pivot", "cls", F.explode(F.when(F.col("open"), F.concat(among, beside)).otherwise(facing)).alias("at")).select("pivot", "at.kind", "at.i", "at.j", "cls", "at.side")


ORDER = ["pivot", "kind", "i", "j"]


def by_group(batches, keys: list[str]):
    """Whole groups out of batches that are sorted by ``keys``; a group may lie across batches."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        code = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
        cuts = np.flatnonzero(code)
        if held and (held[-1][keys].iloc[-1] == pdf[keys].iloc[0]).all():
            cuts = cuts[1:]
        edges = [0, *cuts[cuts > 0].tolist(), len(pdf)]
        if held and not (len(cuts) and cuts[0] == 0):
            held.append(pdf.iloc[: edges[1]])
            edges = edges[1:]
        for a, b in zip(edges, edges[1:]):
            if held:
                yield pd.concat(held) if len(held) > 1 else held[0]
            held = [pdf.iloc[a:b]]
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def common_values(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of sorted distinct arrays that are not empty."""
    if len(x) < len(y):
        x, y = y, x
    return int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted distinct arrays, by a product of 0/1 matrices over the values both sides have."""
    if len(a) == 1 or len(b) == 1 or len(a) * len(b) <= 4:
        return np.array([[common_values(x, y) for y in b] for x in a], dtype=np.int64)
    va, vb = np.concatenate(a), np.concatenate(b)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    shared = np.intersect1d(va, vb)
    total = np.zeros((len(a), len(b)), dtype=np.float32)
    ca, cb = np.searchsorted(shared, va), np.searchsorted(shared, vb)
    ka, kb = np.zeros(len(va), bool), np.zeros(len(vb), bool)
    if len(shared):
        ka, kb = shared[np.minimum(ca, len(shared) - 1)] == va, shared[np.minimum(cb, len(shared) - 1)] == vb
    step = 4096
    for at in range(0, len(shared), step):  # bounded matrices whatever the sets
        width = min(step, len(shared) - at)
        ma, mb = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        ia, ib = ka & (ca >= at) & (ca < at + width), kb & (cb >= at) & (cb < at + width)
        ma[ra[ia], ca[ia] - at] = 1
        mb[rb[ib], cb[ib] - at] = 1
        total += ma @ mb.T
    return total.astype(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard by the bottom-k of the union of two sketches: the share of it that both hold."""
    union = np.union1d(a, b)[: max(len(a), len(b))]
    return np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union)


def sides(pdf: pd.DataFrame):
    """Rows of the two blocks; a pair of a block with itself has one side only."""
    if pdf["kind"].iloc[0] == 0 and pdf["i"].iloc[0] == pdf["j"].iloc[0]:
        return pdf, pdf, True
    side = pdf["side"].to_numpy(bool)
    return pdf[~side], pdf[side], False


def survivors(percent: int):
    """Keep the classes of each pair of blocks that have a partner whose sketch and size do not rule the link out."""

    def survive(pdf: pd.DataFrame):
        a, b, same = sides(pdf)
        if not len(a) or not len(b) or (same and len(a) < 2):
            return None
        xs, ys = [np.asarray(x) for x in a["sketch"]], [np.asarray(y) for y in b["sketch"]]
        shared = overlaps(xs, ys)
        if same:
            np.fill_diagonal(shared, 0)
        na, nb = a["n"].to_numpy()[:, None], b["n"].to_numpy()[None, :]
        fits = (shared >= np.minimum(a["need"].to_numpy()[:, None], b["need"].to_numpy()[None, :])) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
        if len(a) <= 32 and len(b) <= 32 or len(b) == 1:
            for i, j in zip(*np.nonzero(fits)):
                fits[i, j] = estimate(xs[i], ys[j]) >= LOW
        left, right = fits.any(axis=1), fits.any(axis=0)
        kept = a[left | right] if same else pd.concat([a[left], b[right]])
        return kept[[*ORDER, "cls", "side"]] if len(kept) > 1 else None

    return lambda batches: _batched(by_group(batches, ORDER), survive)


def _batched(groups, work, rows: int = 4096):
    held, n = [], 0
    for pdf in groups:
        out = work(pdf)
        if out is not None and len(out):
            held.append(out)
            n += len(out)
        if n >= rows:
            yield pd.concat(held)
            held, n = [], 0
    if held:
        yield pd.concat(held)


def spanning(a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the same classes as all of ``linked`` do, at most one less than there are classes."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked)):
        x, y = root(int(a[i])), root(int(b[j]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((int(a[i]), int(b[j])))
    return out


def confirmed(percent: int):
    """Links (a, b) of each pair of blocks on full sets; with a pivot as the one side, all of its links (cls, pivot)."""

    def confirm(pdf: pd.DataFrame):
        a, b, same = sides(each_once(pdf))
        if not len(a) or not len(b) or (same and len(a) < 2):
            return None
        xs, ys = [np.asarray(x) for x in a["full"]], [np.asarray(y) for y in b["full"]]
        both = overlaps(xs, ys)
        union = np.array([len(x) for x in xs])[:, None] + np.array([len(y) for y in ys])[None, :] - both
        linked = 100 * both >= percent * union
        if same:
            linked = np.triu(linked, 1)
        return pd.DataFrame(spanning(a["cls"].to_numpy(), b["cls"].to_numpy(), linked), columns=["a", "b"], dtype="int64")

    return lambda batches: _batched(by_group(batches, ORDER), confirm)


#: Links that one task joins; more are contracted by many.
FEW_LINKS = 200_000


def joined_links(batches):
    """(node, component) of links (u, v) of one partition, by union-find."""
    links = pd.concat([pdf for pdf in batches] or [pd.DataFrame({"u": [], "v": []}, dtype="int64")])
    names, codes = np.unique(links.to_numpy(dtype=np.int64), return_inverse=True)
    codes, parent = codes.reshape(-1, 2), list(range(len(names)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in codes.tolist():
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    roots = np.array([root(x) for x in range(len(names))], dtype=np.int64)
    moved = roots != np.arange(len(names))
    yield pd.DataFrame({"node": names[moved], "component": names[roots[moved]]})


def components(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(node, component) of the nodes of links (a, b) that have a smaller one in reach, the smallest: by alternating
    large-star and small-star steps, or in one task if there are at most ``few`` links."""
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = state(edges)
    if before[0] <= few:
        return checkpointed(edges.coalesce(1).mapInPandas(joined_links, "node long, component long"))
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("k"))
        # a hub's links stay where they are
        large = with_facts(both.where("v > u"), least, "u", "k", 2 * before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
        small = with_facts(large, least, "u", "k", before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = checkpointed(small)
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def beside(docs: DataFrame, key: str, text: str, n: int, classes: DataFrame, kept: DataFrame, brief=None) -> DataFrame:
    """The pairs of blocks ``kept`` (ORDER, cls, side and others) with the sizes of their sets (n) and the sets (full), made
    anew from the texts and sorted by ORDER. ``classes``: cls, same (digest of the set), id (a document that has it).
    With ``brief``, which makes bytes of a set, these (bits) are there in place of the sets."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    column, kind = ("full", "array<long>") if brief is None else ("bits", "binary")

    def full(batches):
        seen: set[bytes] = set()  # repeated rows once a task
        for batch in batches:
            for part in arrow_slices(batch, "text"):
                sets = [(s, d) for s in shingle_sets(part["text"], n) if (d := digest(s)) not in seen and not seen.add(d)]
                sizes, names, shown = [len(s) for s, _ in sets], [d for _, d in sets], [s for s, _ in sets]
                if brief is None:
                    ends = np.cumsum([0, *map(len, shown)], dtype=np.int32)
                    made = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *shown])))
                else:
                    made = pa.array([brief(s) for s in shown], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), made], ["same", "n", column])

    wanted = checkpointed(kept.select("cls").distinct().join(classes.select("cls", "same", "id"), "cls"))
    ids = bounded_broadcast(wanted.select("id").distinct(), BROADCAST_IDS)
    sources = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(ids, "id", "left_semi").select("text")
    sets = sources.mapInArrow(full, f"same binary, n long, {column} {kind}").join(wanted.select("cls", "same"), "same")
    faced = kept.join(sets.select("cls", "n", column), "cls").select(*ORDER, *[c for c in kept.columns if c not in ORDER], "n", column)
    return faced.repartition(parts, *ORDER).sortWithinPartitions(*ORDER)


def each_once(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of several tasks for one class count once."""
    place = pdf["cls"].to_numpy() * 2 + pdf["side"].to_numpy(bool)
    return pdf if len(np.unique(place)) == len(place) else pdf[~pd.Series(place).duplicated().to_numpy()]


def links_on_sets(docs: DataFrame, key: str, text: str, n: int, classes: DataFrame, kept: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the pairs of blocks ``kept`` on full sets."""
    return checkpointed(beside(docs, key, text, n, classes, kept).mapInPandas(confirmed(percent), "a long, b long"))


def with_components(base: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """``base`` (key, n_shingles, same) with component_id, the least id of the documents that ``links`` between classes join;
    that of documents without a set is their own. Texts of many copies meet their component by a broadcast, and what has
    no set meets nothing."""
    joined = classes.select("cls", "same", "id", "copies").join(components(links), F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("component", "cls"))
    joined = checkpointed(joined.select("same", "id", "copies", "root"))
    least = joined.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("k"))
    member = checkpointed(with_facts(joined, least, "root", "k", joined.count()).select("same", "component_id", "copies"))
    own = base.where("same IS NOT NULL").select("key", "n_shingles", "same")
    found = with_facts(own, member, "same", "copies", own.count())
    return found.select("key", "n_shingles", "component_id").unionByName(base.where("same IS NULL").select("key", "n_shingles", F.col("key").alias("component_id")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE_WORDS, percent: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row; kept marks the smallest id of each component.

    ``percent`` (80 or more, which the sketch bounds assume) is the least Jaccard similarity of a link. Null and empty
    texts have no shingles and are linked with nothing: component_id is their own id. Ids must be integers; rows of one
    id with different texts are linked by their texts alone, repeated rows share a component and are kept alike. Rows
    without id are kept only if their component has no id; texts that only such rows have are linked with equal ones alone.
    Very long texts are hashed in pieces; a task of full sets holds two blocks of about BLOCK_SHINGLES shingles, or one
    longer text. Other columns of docs are not looked at, whatever their names. An empty table gives no rows.
    """
    if percent < THRESHOLD:
        raise ValueError("sketch bounds hold from 80 percent on")
    # a stated number, as partitions of few bytes may hold much work
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = checkpointed(sketches(docs, key, text, n))
    classes = base.where("same is not null").groupBy("same").agg(F.min("key").alias("id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = checkpointed(classes.withColumn("cls", F.monotonically_increasing_id()))
    total = classes.count()
    members = checkpointed(grouped(checkpointed(listed(classes, total)), total))

    def links_of(pairs: DataFrame) -> DataFrame:
        """Links (a, b) of pairs of blocks: sketches first, then the full sets of what they leave."""
        paired = pairs.join(classes.select("cls", "n", needed(F.col("n")).alias("need"), "sketch"), "cls")
        paired = paired.select(*ORDER, "cls", "side", "n", "need", "sketch").repartition(parts, *ORDER).sortWithinPartitions(*ORDER)
        kept = checkpointed(paired.mapInPandas(survivors(percent), "pivot long, kind int, i int, j int, cls long, side boolean"))
        return links_on_sets(docs, key, text, n, classes, kept, percent)

    hubs = links_of(star(members, block))
    rest = links_of(dealt(members, hubs.select(F.col("b").alias("pivot"), F.col("a").alias("cls")), block))
    out = with_components(base, classes, hubs.unionByName(rest)).withColumn("kept", F.col("key").eqNullSafe(F.col("component_id")))
    return out.select(F.col("key").alias(key), "n_shingles", "component_id", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), n=4)


#: Words lower-cased by A-Z alone, as the shingles are; lists joined by their shingles, and the least id reachable.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     '), ' '), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') || ' ' || len(w) ELSE array_to_string(w[i : i + 3], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id AS doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m.y, d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) m ON m.x = d.doc_id
"""
