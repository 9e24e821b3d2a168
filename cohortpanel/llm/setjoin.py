"""Jaccard join of word-shingle sets by partitioning the universe of shingles, exact whatever the sets.

1. Sets of r and s elements with Jaccard similarity of p percent or more differ in at most (100 - p)(r + s) / (100 + p)
   elements. Sizes fall into bands; a band's scheme hashes the universe into segments, one more than sets of the band and
   partners of theirs can differ in. A set looks at the first of them, one more than it can differ in from a smaller
   partner; of as many segments of any pair at least one is without a difference (pigeonhole).
2. Each set is indexed under the content of its segments in its own band's scheme, and looked up in its own and in the next
   smaller band's. Of the first few segments it is indexed under its one-deletion neighbourhoods too: contents without one
   of their elements, by which contents that differ in one element meet.
3. Costs decide what is looked up: the content of a segment that many sets have (an empty one, or one element of a common
   passage) is left out by a set that looks up a one-deletion neighbourhood instead. That finds one difference more, so
   the pigeonhole stands: differences that are to be outlasted stay one fewer than what is looked up.
4. Sets that meet are compared with the least of their list, the pivot, first by parities: a set's elements toggle bits at
   hashed places, so two sets differ in at least as many elements as their bits do. What may be linked is verified on full
   sets, each set with its first pivot, then with those that are not in its component yet.
5. In lists with sets of other components than the pivot's these are compared with the rest of the list, in blocks: by
   parities, by parities of more bits, and on full sets; of each block the pairs that would join most come first, and what
   they have not joined after. Parities are short, so their blocks are wide ones, whose tiles a task looks at in turn: a
   list has few pairs of blocks, and only tiles with pairs that are still open become blocks of full sets. Links are
   contracted to components.

Keys are dealt to buckets of about BUCKET entries as packed numbers. A content that a batch of sets has LOCAL times or more
stays out of its bucket, which is told its count alone; such rows are dealt at random and joined with their counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_slices, bounded_broadcast, checkpointed, saved, small_batches, table, with_facts
from .neardup import BLOCK, BLOCK_SHINGLES, BROADCAST_IDS, ORDER, beside, components, dealt, digest, links_on_sets, star, with_components
from .shingles import _mixed, shingle_sets

SHINGLE_WORDS, THRESHOLD = 4, 85  # percent
#: Largest size of a band to its smallest, in percent (more where the threshold asks for it).
BAND = 150
#: One in so many segments has its one-deletion neighbourhoods indexed, two at least.
DELETION_SHARE = 24
#: Contents of more sets are costly.
CHEAP = 32
#: Entries that a bucket has about, entries that a task packs at once, and sets of such a pack that make a content a hot one.
BUCKET, PACK, LOCAL = 1 << 18, 1 << 20, 64
#: Bits of the parities of a set of n elements: the least power of two from 64 that is n or more; of fine ones so many times.
LEAST_BITS, FINE = 64, 8
#: Blocks of parities are so many times as large as blocks of full sets; shingles of the sets of one; tiles it has at most.
WIDE, WIDE_SHINGLES, TILES = 16, 1 << 22, 1 << 15
#: Bits of a tag, above the segment's number: looked up in the smaller band's scheme; of a deletion; to be looked up.
LOWER, DELETED, PROBE = 1 << 30, 1 << 29, 1 << 28
#: Bytes of text whose keys a task makes at once, about.
KEYED_BYTES = 1 << 20
PACKED = "bucket int, marks boolean, value binary, cls binary, tag binary"
#: ``list`` names a list of three sets or more.
FOUND = "pivot long, cls long, list long, value long, tag long, freq long"


def differences(r: np.ndarray, percent: int) -> np.ndarray:
    """Elements in which a set of r and one of at most r linked with it differ at most."""
    return (100 - percent) * 2 * r // (100 + percent)


class Scheme:
    """Bands of sizes up to ``largest`` and their numbers of segments."""

    def __init__(self, largest: int, percent: int):
        self.percent, low, high = percent, [1], []
        while True:
            high.append(max(low[-1] * BAND // 100, low[-1] * 100 // percent))
            if high[-1] >= largest:
                break
            low.append(high[-1] + 1)
        self.low, self.high = np.array(low), np.array(high)
        self.segments = self.needed(self.high * 100 // percent)

    def needed(self, r: np.ndarray) -> np.ndarray:
        """Segments a set of r looks at for smaller partners: one more than the differences."""
        return differences(r, self.percent) + 1

    @staticmethod
    def deletions(segments: np.ndarray) -> np.ndarray:
        return np.maximum(np.minimum(2, segments), segments // DELETION_SHARE)

    def entries(self, sets: list[np.ndarray], lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(set, value, tag) of all keys of the sets in their own band's scheme, or in the next smaller band's."""
        n = np.array([len(s) for s in sets], dtype=np.int64)
        band = np.searchsorted(self.low, n, side="right") - 1 - lower
        looked = self.needed(n)  # as the larger of a pair
        kept = looked if lower else self.needed(n * 100 // self.percent)  # as the smaller one too
        use = (n > 0) & (band >= 0) & (kept > 1)  # where nothing may differ, equal sets are one class already
        if lower:
            use &= -(-self.percent * n // 100) <= self.high[np.maximum(band, 0)]
        at = np.flatnonzero(use)
        if not len(at):
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
        band, looked, kept = band[at], looked[at], kept[at]
        elements = np.concatenate([sets[k] for k in at.tolist()]).view(np.uint64)
        of = np.repeat(np.arange(len(at)), n[at])
        segment = ((_mixed(elements ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(24)) % self.segments[band].astype(np.uint64)[of]).astype(np.int64)
        inside = segment < kept[of]
        elements, of, segment = _mixed(elements[inside]), of[inside], segment[inside]
        # a content's value is a sum over its elements, so a deletion is a difference; empty contents are 0
        first = np.cumsum(kept) - kept
        place = first[of] + segment
        order = np.argsort(place, kind="stable")
        ends = place[order]
        begin = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]]) if len(ends) else np.empty(0, np.int64)
        sums = np.zeros(int(kept.sum()), np.uint64)
        sums[ends[begin]] = np.add.reduceat(elements[order], begin) if len(begin) else 0
        whose = np.repeat(np.arange(len(at)), kept)
        number = np.arange(len(sums)) - first[whose]
        salt = _mixed((band[whose].astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64) + np.uint64(1))
        plain = _mixed(sums + salt)
        tags = number + (LOWER if lower else 0)
        shown = number < looked[whose]
        near = segment < self.deletions(kept)[of]
        gone = place[near]
        without = _mixed(sums[gone] - elements[near] + salt[gone])
        number_of, set_of = segment[near], of[near]
        probed = number_of < self.deletions(looked)[set_of]
        gone_tags = number_of + DELETED + (LOWER if lower else 0) + np.where(probed, PROBE, 0)
        tags = tags + np.where(shown, PROBE, 0)
        return at[np.concatenate([whose, set_of])], np.concatenate([plain, without]), np.concatenate([tags, gone_tags])


def packed(value: np.ndarray, cls: np.ndarray, tag: np.ndarray, buckets: int, place: int, local: int = LOCAL):
    """PACKED rows: entries by buckets of their values; of contents of ``local`` sets their counts (``marks``) and, at random
    places, rows."""
    order = np.argsort(value, kind="stable")
    value, cls, tag = value[order], cls[order], tag[order]
    del order
    begin = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    count = np.diff(np.append(begin, len(value)))
    hot = count >= local
    spread = np.repeat(hot, count)
    rows = []

    def row(bucket, marks, v, c, t):
        rows.append((bucket, marks, v.astype("<u8").tobytes(), c.astype("<i8").tobytes(), t.astype("<u4", copy=False).tobytes()))

    bucket_of = lambda v: ((v >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    for marks, v, c, t, own in ((False, value, cls, tag, ~spread), (True, value[begin[hot]], count[hot], np.zeros(int(hot.sum()), np.int64), np.ones(int(hot.sum()), bool))):
        if len(v):
            b = bucket_of(v)
            cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(b)]):
                at = x + np.flatnonzero(own[x:y])
                at = at[np.argsort(c[at], kind="stable")]  # by class: compresses better
                if len(at):
                    row(int(b[x]), marks, v[at], c[at], t[at])
            del b
    v, c, t = value[spread], cls[spread], tag[spread]
    for k, x in enumerate(range(0, len(v), 1 << 14)):
        row(-1 - (place + k) % 9973, False, v[x : x + (1 << 14)], c[x : x + (1 << 14)], t[x : x + (1 << 14)])
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], schema=pa.schema([("bucket", pa.int32()), ("marks", pa.bool_()), ("value", pa.binary()), ("cls", pa.binary()), ("tag", pa.binary())])) if rows else None


def met(value: np.ndarray, cls: np.ndarray, tag: np.ndarray, marked: np.ndarray, counts: np.ndarray, most: int = CHEAP) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Of a bucket: (pivot, cls, list) of cheap contents (list 0: of two sets), and rows (value, cls, tag, freq) of costly ones, of hot ones (one row
    without cls has the count) and of those that a deletion has too. Contents of one set, or without one that is indexed as
    a whole, are left out."""
    order = np.lexsort((cls, value))
    value, cls, tag = value[order], cls[order], tag[order]
    names = np.unique(marked)
    extra = np.zeros(len(names), np.int64)
    np.add.at(extra, np.searchsorted(names, marked), counts)
    begin = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.empty(0, np.int64)
    size = np.diff(np.append(begin, len(value)))
    of = np.repeat(np.arange(len(begin)), size)
    whole, own = tag & DELETED == 0, tag & LOWER == 0
    total = lambda mask: np.bincount(of[mask], minlength=len(begin))
    n_whole, n_own, n_probe = total(whole), total(own), total(tag & PROBE != 0)
    hot = np.isin(value[begin], names) if len(begin) else np.empty(0, bool)
    useful = (size > 1) & (n_whole > 0) & (n_own > 0) & (n_probe > 0)
    cheap = useful & ~hot & (size <= most)
    rows = hot | (useful & ~cheap) | (cheap & (n_whole < size))
    pairs = cheap & (n_whole > 1)
    mine = pairs[of] & whole
    pivot = np.full(len(begin), np.iinfo(np.int64).max)
    np.minimum.at(pivot, of[mine], cls[mine])
    # equal lists have equal names
    names_of = np.zeros(len(begin), np.uint64)
    np.add.at(names_of, of[mine], _mixed(cls[mine].astype(np.uint64) + np.uint64(1)))
    names_of = np.where(n_whole > 2, (names_of | np.uint64(1)).view(np.int64), 0)
    met_pairs = np.stack([pivot[of[mine]], cls[mine], names_of[of[mine]]], axis=1)
    freq = size.copy()
    freq[hot] += extra[np.searchsorted(names, value[begin[hot]])] if hot.any() else 0
    mine = rows[of]
    table = {"value": value[mine], "cls": cls[mine], "tag": tag[mine], "freq": freq[of[mine]]}
    whole_count = dict(zip(names.tolist(), extra.tolist()))
    for v, f in zip(value[begin[hot]].tolist(), freq[hot].tolist()):
        whole_count[v] = f
    if whole_count:
        facts = (np.array(list(whole_count), np.uint64), np.full(len(whole_count), -1), np.zeros(len(whole_count), np.int64), np.array(list(whole_count.values())))
        table = {c: np.concatenate([x, y]) for (c, x), y in zip(table.items(), facts)}
    return met_pairs, table


def gathered(batches, most: int = CHEAP):
    """FOUND rows of PACKED rows sorted by their buckets; contents of more than ``most`` sets are costly."""
    held, bucket, pairs = [], None, []
    schema = pa.schema([(c.split()[0], pa.int64()) for c in FOUND.split(", ")])

    def rows_of(entries, marks):
        join = lambda k, kind: np.frombuffer(b"".join(e[k] for e in entries), kind)
        value, cls, tag = join(0, "<u8"), join(1, "<i8"), join(2, "<u4").astype(np.int64)
        marked, counts = np.frombuffer(b"".join(e[0] for e in marks), "<u8"), np.frombuffer(b"".join(e[1] for e in marks), "<i8")
        found, rows = met(value, cls, tag, marked, counts, most)
        if len(found):
            pairs.append(np.unique(found, axis=0) if len(found) < 1 << 16 else found)
        return rows

    def batch_of(rows):
        n = len(rows["value"])
        null = pa.nulls(n, pa.int64())
        cls = pa.array(rows["cls"], pa.int64(), mask=rows["cls"] < 0)
        freq = pa.array(rows["freq"], pa.int64()) if "freq" in rows else null
        return pa.RecordBatch.from_arrays([null, cls, null, pa.array(rows["value"].view(np.int64)), pa.array(rows["tag"], pa.int64()), freq], schema=schema)

    def pair_batch():
        found = np.unique(np.concatenate(pairs), axis=0)
        pairs.clear()
        null = pa.nulls(len(found), pa.int64())
        return pa.RecordBatch.from_arrays([*(pa.array(found[:, k]) for k in range(3)), null, null, null], schema=schema)

    def finished():
        entries, marks = [h[1:] for h in held if not h[0]], [h[1:] for h in held if h[0]]
        held.clear()
        rows = rows_of(entries, marks)
        if len(rows["value"]):
            yield batch_of(rows)
        if sum(map(len, pairs)) > 1 << 19:
            yield pair_batch()

    for batch in batches:
        # a row's bytes are copied as it comes, not the batch's
        for b, marks, value, cls, tag in (tuple(batch[c][k].as_py() for c in ("bucket", "marks", "value", "cls", "tag")) for k in range(batch.num_rows)):
            if b < 0:  # hot rows meet their counts later
                rows = {"value": np.frombuffer(value, "<u8"), "cls": np.frombuffer(cls, "<i8"), "tag": np.frombuffer(tag, "<u4").astype(np.int64)}
                yield batch_of(rows)
                continue
            if b != bucket and held:
                yield from finished()
            bucket = b
            held.append((marks, value, cls, tag))
    if held:
        yield from finished()
    if pairs:
        yield pair_batch()


def allocated(values: np.ndarray, tags: np.ndarray, freqs: np.ndarray, deletions: int, most: int = CHEAP) -> np.ndarray:
    """Values that one set looks up in one scheme, of those that are costly or have deletions.

    Costly contents, the most frequent first, are left out for the cheapest one-deletion neighbourhood that is not used
    yet, of another segment, as long as that one has fewer sets.
    """
    probe, segment, gone = tags & PROBE != 0, tags & (PROBE - 1), tags & DELETED != 0
    costs = np.zeros(deletions, np.int64)
    np.add.at(costs, segment[probe & gone], freqs[probe & gone])
    whole = np.flatnonzero(probe & ~gone)
    whole = whole[np.argsort(-freqs[whole], kind="stable")]
    order = np.argsort(costs, kind="stable").tolist()
    left_out, taken = set(), set()
    for k in whole.tolist():
        if freqs[k] <= most or not order:
            break
        own = int(segment[k])
        if own in taken:
            continue  # its neighbourhood is looked up, for which it must be
        free = next((s for s in order if s != own), None)
        if free is None or costs[free] >= freqs[k]:
            break
        order.remove(free)
        if own in order:
            order.remove(own)
        taken.add(free)
        left_out.add(k)
    use = [k for k in whole.tolist() if k not in left_out and (freqs[k] > most or int(segment[k]) in taken)]
    return values[np.concatenate([np.array(use, np.int64), np.flatnonzero(probe & gone & np.isin(segment, list(taken)))]).astype(np.int64)]


KEPT = "pivot long, kind int, i int, j int, cls long, side boolean"


def parity(elements: np.ndarray, times: int = 1) -> bytes:
    """Bits that the elements toggle, as bytes; of as many bits as the size of the set asks for, times a power of two."""
    bits = max(LEAST_BITS, 1 << (max(len(elements), 1) - 1).bit_length()) * times
    places = _mixed(elements.view(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(bits - 1)
    return np.packbits(np.bincount(places.astype(np.int64), minlength=bits) & 1 == 1, bitorder="little").tobytes()


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """Parities of fewer bits: halves toggle one another, as the place of an element is its hash's last bits."""
    while len(words) > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def shingle_rows(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, n_shingles, same, bits): ``same`` is a digest of the set, null for the empty set; ``bits`` its parities."""

    def make(batches):
        for batch in batches:
            for part in arrow_slices(batch, "text"):
                sets = list(shingle_sets(part["text"], n))
                rows = [part["key"], pa.array([len(s) for s in sets], pa.int64()), pa.array(map(digest, sets), pa.binary()), pa.array([parity(s) for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(rows, ["key", "n_shingles", "same", "bits"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(make, "key long, n_shingles long, same binary, bits binary")


def candidates(docs: DataFrame, key: str, text: str, n: int, classes: DataFrame, percent: int, most: int = CHEAP, local: int = LOCAL, pack: int = PACK) -> DataFrame:
    """(pivot, cls, list): classes that meet under a key that one of them looks up, with the least of them; the pivot is a
    row of its own. ``list`` (not 0) tells apart who met whom, where there are three or more."""
    spark = docs.sparkSession
    figures = classes.agg(F.max("n"), F.sum("n")).first()
    scheme = Scheme(max(figures[0] or 1, 1), percent)
    buckets = max(64, (figures[1] or 0) // 3 // BUCKET)
    known = bounded_broadcast(classes.select("id", "same", "cls"), BROADCAST_IDS)
    # rows of one id may have several texts: their digests say whose they are
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(known, "id")

    def make(batches):
        held, n_held, place, seen = [], 0, 0, set()

        def flushed():
            columns = [np.concatenate([h[k] for h in held]) for k in range(3)]
            held.clear()
            return packed(*columns, buckets, int(columns[1][0]) + place, local)

        for batch in batches:
            for part in arrow_slices(batch, "text", KEYED_BYTES):
                sets, cls, want = list(shingle_sets(part["text"], n)), part["cls"].to_pylist(), part["same"].to_pylist()
                mine = [k for k, s in enumerate(sets) if digest(s) == want[k] and not (cls[k] in seen or seen.add(cls[k]))]  # repeated rows once
                own = np.array([cls[k] for k in mine], np.int64)
                sets = [sets[k] for k in mine]
                for lower in (False, True):
                    of, value, tag = scheme.entries(sets, lower)
                    if len(of):
                        held.append((value, own[of], tag.astype(np.uint32)))
                        n_held += len(of)
                if n_held >= pack:
                    out = flushed()
                    n_held, place = 0, place + 1
                    if out is not None:
                        yield out
        if held and (out := flushed()) is not None:
            yield out

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt_out = texts.mapInArrow(make, PACKED).repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = saved(dealt_out.mapInArrow(lambda batches: gathered(batches, most), FOUND))
    counts = found.where("value IS NOT NULL AND cls IS NULL").groupBy("value").agg(F.max("freq").alias("freq"))
    hot = found.where("value IS NOT NULL AND cls IS NOT NULL AND freq IS NULL").select("value", "cls", "tag")
    rows = found.where("value IS NOT NULL AND cls IS NOT NULL AND freq IS NOT NULL").select("value", "cls", "tag", "freq")
    rows = saved(rows.unionByName(with_facts(hot, counts, "value", "freq", hot.count())).dropDuplicates(["value", "cls", "tag"]))
    n_rows = rows.count()

    def allocate(batches):
        for batch in batches:
            n_of, items = batch["n"].to_numpy(), batch["items"]
            ends = items.offsets.to_numpy()
            flat = items.values
            value, tag, freq = (flat.field(c).to_numpy() for c in ("value", "tag", "freq"))
            d = scheme.deletions(scheme.needed(n_of))
            out = [allocated(value[x:y], tag[x:y], freq[x:y], int(k), most) for x, y, k in zip(ends.tolist(), ends[1:].tolist(), d.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *out]))], ["value"])

    # a class has no more rows than its segments and their deletions
    by_class = rows.groupBy("cls", F.col("tag").bitwiseAND(LOWER).alias("role")).agg(F.collect_list(F.struct("value", "tag", "freq")).alias("items")).join(classes.select("cls", "n"), "cls")
    active = by_class.select("n", "items").mapInArrow(allocate, "value long").distinct()
    lists = rows.groupBy("value").agg(F.min("cls").alias("pivot"), F.count("*").alias("k")).where("k > 1").join(active, "value", "left_semi")
    costly = with_facts(rows.select("value", "cls"), checkpointed(lists), "value", "k", n_rows).select("pivot", "cls", F.col("value").alias("list"))
    return found.where("pivot IS NOT NULL").select("pivot", "cls", "list").unionByName(costly).distinct()


def few_apart(bits: list[bytes], n: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets (places left, right) have few enough differences in their parities to be linked."""
    words = [np.frombuffer(b, "<u8") for b in bits]
    size = np.array([len(w) for w in words])
    least, fits = np.minimum(size[left], size[right]), np.zeros(len(left), bool)
    for w in np.unique(least).tolist():
        at = np.flatnonzero(least == w)
        names, codes = np.unique(np.concatenate([left[at], right[at]]), return_inverse=True)
        rows = np.stack([folded(words[k], w) for k in names.tolist()])
        step = max(1, (1 << 20) // w)  # bounded scratch
        for x in range(0, len(at), step):
            part = slice(x, x + step)
            i, j = codes[: len(at)][part], codes[len(at) :][part]
            apart = np.bitwise_count(rows[i] ^ rows[j]).sum(axis=1, dtype=np.int64)
            fits[at[part]] = (100 + percent) * apart <= (100 - percent) * (n[left[at[part]]] + n[right[at[part]]])
    return fits


def near_pairs(side: np.ndarray, same: bool, n: np.ndarray, root: np.ndarray, bits: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of the sets of a pair of blocks that may be linked."""
    if same:
        left, right = np.triu_indices(len(n), 1)
    else:
        left, right = (x.ravel() for x in np.meshgrid(np.flatnonzero(~side), np.flatnonzero(side), indexing="ij"))
    fits = (root[left] != root[right]) & (100 * np.minimum(n[left], n[right]) >= percent * np.maximum(n[left], n[right]))
    left, right = left[fits], right[fits]
    fits = few_apart(bits, n, left, right, percent) if len(left) else np.zeros(0, bool)
    return left[fits], right[fits]


def tiles(side: np.ndarray, same: bool, n: np.ndarray, block: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """(s, t, places, side, same) of the pairs of tiles of a pair of blocks: tiles have ``block`` sets or about BLOCK_SHINGLES
    shingles at most."""

    def cut(places: np.ndarray) -> list[np.ndarray]:
        full = np.maximum(np.arange(len(places)) // block, np.cumsum(n[places]) // BLOCK_SHINGLES)
        return np.split(places, np.flatnonzero(np.diff(full)) + 1)

    if same:
        parts = cut(np.arange(len(n)))
        pairs = [(s, t, parts[s], parts[t]) for s in range(len(parts)) for t in range(s, len(parts))]
    else:
        pairs = [(s, t, a, b) for s, a in enumerate(cut(np.flatnonzero(~side))) for t, b in enumerate(cut(np.flatnonzero(side)))]
    for s, t, a, b in pairs:
        if same and s == t:
            yield s, t, a, np.zeros(len(a), bool), True
        else:
            yield s, t, np.concatenate([a, b]), np.arange(len(a) + len(b)) >= len(a), False


def forest_of(pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Of pairs of places, given as arrays, those that join as much as all of them do."""
    parent: dict[int, int] = {}

    def end(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for left, right in pairs:
        for i, j in zip(left.tolist(), right.tolist()):
            x, y = end(i), end(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((i, j))
    return out


def possible(percent: int, forests: bool = False, block: int = BLOCK, tiled: bool = False):
    """Keep the sets of each pair of blocks that have a partner of another component with few enough differences in their
    parities, and with a size that a linked one may have; with ``forests`` (pivot, cls), pairs that join as much as all such
    pairs of the two blocks; if ``tiled``, for each pair of tiles (of ``block`` sets at most) its own, as a pair of blocks.
    Batches are sorted by ORDER; a pair of blocks may lie across them."""

    def kept(batches):
        held = []
        for batch in batches:
            held.append(batch)
            keys = [batch[c].to_numpy() for c in ORDER]
            if batch.num_rows and any(k[0] != k[-1] for k in keys):
                whole = pa.Table.from_batches(held).combine_chunks()
                last = np.flatnonzero(np.any([np.diff(whole[c].to_numpy()) != 0 for c in ORDER], axis=0))[-1] + 1
                yield from chosen(whole.slice(0, last))
                held = whole.slice(last).to_batches()
        if held:
            yield from chosen(pa.Table.from_batches(held).combine_chunks())

    def chosen(rows: pa.Table):
        keys = [rows[c].to_numpy() for c in ORDER]
        cuts = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1 if len(rows) else []
        side, n, root = rows["side"].to_numpy(), rows["n"].to_numpy(), rows["root"].to_numpy()
        cls, bits = rows["cls"].to_numpy(), rows["bits"].to_pylist()
        out, kept = [], np.zeros(len(rows), bool)

        def pairs_of(once, same):
            """(s, t, left, right, side) of the pairs of tiles that have pairs of places."""
            for s, t, at, beyond, alone in tiles(side[once], same, n[once], block):
                at = once[at]
                left, right = near_pairs(beyond, alone, n[at], root[at], [bits[k] for k in at.tolist()], percent)
                if len(left):
                    yield s, t, at[left], at[right], not alone

        for x, y in zip([0, *cuts], [*cuts, len(rows)]):
            if y - x > 1:
                same = keys[1][x] == 0 and keys[2][x] == keys[3][x]
                once = x + np.sort(np.unique(cls[x:y] * 2 + side[x:y], return_index=True)[1])  # several tasks may have made one
                if forests:
                    joined = np.array(forest_of((left, right) for *_, left, right, _ in pairs_of(once, same)), np.int64).reshape(-1, 2)
                    out.append(np.sort(cls[joined], axis=1))
                elif tiled:
                    for s, t, left, right, two in pairs_of(once, same):
                        left, right = np.unique(left), np.unique(right)
                        at = np.concatenate([left, right]) if two else np.union1d(left, right)
                        tile = np.broadcast_to([keys[0][x], keys[1][x], keys[2][x] * TILES + s, keys[3][x] * TILES + t], (len(at), 4))
                        out.append(np.column_stack([tile, cls[at], (np.arange(len(at)) >= len(left)) & two]))
                else:
                    for *_, left, right, _ in pairs_of(once, same):
                        kept[left] = kept[right] = True
        if kept.any():
            out.append(np.column_stack([*(k[kept] for k in keys), cls[kept], side[kept]]))
        found = np.concatenate(out) if out else np.empty((0, 0))
        if len(found):
            names, kinds = (["pivot", "cls"], [pa.int64()] * 2) if forests else ([*ORDER, "cls", "side"], [pa.int64(), *[pa.int32()] * 3, pa.int64(), pa.bool_()])
            yield pa.RecordBatch.from_arrays([pa.array(found[:, k]).cast(kind) for k, kind in enumerate(kinds)], names)

    return kept


def near(pairs: DataFrame, facts: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """What ``possible`` leaves of pairs of blocks (ORDER, cls, side); ``facts``: cls, n, bits, root (its component so far)."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    faced = pairs.join(facts, "cls").select(*ORDER, "cls", "side", "n", "bits", "root").repartition(parts, *ORDER).sortWithinPartitions(*ORDER)
    return saved(faced.mapInArrow(possible(percent, block=block), KEPT))


def rooted(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(cls, root): components of all classes."""
    return saved(classes.select("cls").join(components(links), F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("component", "cls").alias("root")))


def links_of(docs: DataFrame, key: str, text: str, n: int, classes: DataFrame, members: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) that join the components of all links among ``members`` (pivot, cls, list)."""
    verified = lambda pairs: links_on_sets(docs, key, text, n, classes, pairs, percent)
    around = members.select("pivot", "cls").distinct().join(classes.select("cls", "n"), "cls")
    facts = classes.select("cls", "n", "bits")
    hubs = near(star(around, block), facts.withColumn("root", F.col("cls")), percent)
    # a block keeps its pivot with any of the others; each set is verified with its first pivot at first
    spokes = saved(hubs.where("NOT side").select("pivot", "cls"))
    first = spokes.groupBy("cls").agg(F.min("pivot").alias("pivot"))
    links = verified(saved(paired(first)))
    roots = rooted(classes, links)
    later = spokes.join(first, ["cls", "pivot"], "left_anti").join(roots, "cls")
    counts = spokes.groupBy("pivot").agg(F.count("*").alias("k"))
    ends = counts.join(roots.select(F.col("cls").alias("pivot"), F.col("root").alias("_at")), "pivot")
    later = with_facts(later, ends, "pivot", "k", spokes.count()).where("root <> _at").select("pivot", "cls")
    links = links.unionByName(verified(saved(paired(later))))
    # lists in which not all are of the pivot's component; the pivot has been compared with all
    listed = members.where("list <> 0").join(roots, "cls")
    heads = listed.where("cls = pivot").select("list", F.col("root").alias("_at")).dropDuplicates(["list"])
    sizes = listed.groupBy("list").agg(F.count("*").alias("k"), (F.min("root") != F.max("root")).alias("mixed")).join(heads, "list")
    mixed = saved(sizes.where("mixed").select("list", "k", "_at"))
    open_ = saved(with_facts(listed.where("cls <> pivot").select("list", "cls", "root"), mixed, "list", "k", members.count()))
    rest = open_.join(classes.select("cls", "n"), "cls").select(F.col("list").alias("pivot"), "cls", "n")
    done = open_.where("root = _at").select(F.col("list").alias("pivot"), "cls")
    left = near(dealt(rest, done, WIDE * block, WIDE_SHINGLES), facts.join(roots, "cls"), percent, block)
    fine = lambda pairs, roots: beside(docs, key, text, n, classes, pairs.join(roots, "cls"), brief=lambda s: parity(s, FINE))
    # pairs of one list are those of many: those that join most come first, each once
    joining = saved(fine(left, roots).mapInArrow(possible(percent, forests=True, block=block), "pivot long, cls long").distinct())
    links = links.unionByName(verified(saved(paired(joining))))
    roots = rooted(classes, links)
    left = near(left, facts.join(roots, "cls"), percent, block)
    return links.unionByName(verified(saved(fine(left, roots).mapInArrow(possible(percent, block=block, tiled=True), KEPT))))


def paired(spokes: DataFrame) -> DataFrame:
    """Pairs of blocks (ORDER, cls, side) of pivots with their sets."""
    hubs = spokes.select("pivot", F.col("pivot").alias("cls")).distinct()
    return star(spokes.select("pivot", "cls").unionByName(hubs).withColumn("n", F.lit(1 << 12)), BLOCK)  # about 256 sets a block


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE_WORDS, percent: int = THRESHOLD, block: int = BLOCK, **costs: int) -> DataFrame:
    """(key, n_shingles, component_id) of every row: components of sets whose Jaccard similarity is ``percent`` or more.

    A set is that of the distinct n-word shingles of a whole text, A-Z lower-cased; fewer words are one shingle. Null and
    empty texts have no shingles and are linked with nothing: component_id is their own id. Ids must be integers; rows of
    one id with different texts are linked by their texts alone, repeated rows share a component. Texts that only rows
    without id have are linked with equal ones alone; their component_id is null. Very long texts are hashed in pieces and
    joined whole. Other columns are not looked at, whatever their names. An empty table gives no rows. ``costs`` (most,
    local, pack) change the work, not the result.
    """
    if not 50 <= percent < 100:
        raise ValueError("percent must be from 50 to 99")
    with small_batches(docs.sparkSession):
        base = saved(shingle_rows(docs, key, text, n))
        groups = base.where("same IS NOT NULL").groupBy("same")
        classes = groups.agg(F.min("key").alias("id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"))
        classes = saved(classes.withColumn("cls", F.monotonically_increasing_id()))
        members = saved(candidates(docs, key, text, n, classes, percent, **costs))
        links = links_of(docs, key, text, n, classes, members, percent, block)
        return with_components(base, classes, links).select(F.col("key").alias(key), "n_shingles", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Sets joined by their shingles, and the least id reachable by links.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     '), ' '), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') || ' ' || len(w) ELSE array_to_string(w[i : i + 3], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id AS doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) m ON m.x = d.doc_id
"""
