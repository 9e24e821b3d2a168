"""Alignment of two tokenizers' tokens of the same texts, by divide and conquer at shared cuts, and the links it makes.

1. Tokens of both are placed by their ends in bytes. A cut is a byte at which a token of each ends; a document's last byte
   is one. An interval between cuts is cut at the common end nearest to its middle token, found by bisection of the other
   side's ends, and both halves are treated alike; an interval without such an end is a leaf, a group. Intervals of all
   documents of a batch are treated level by level, so numpy does the work of a level at once.
2. Every pair of an A and a B token of a group is a link. A document's links are kept as its distinct pairs of ids with
   how often each is linked; the corpus-wide count of a pair is the number of documents that hold it.
3. Counts of the most frequent pairs, at most HOT_PAIRS of them, are broadcast; rows of the others, each in few documents,
   meet their counts by a join.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_slices, checkpointed, shared_folder, table

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs of ids whose counts are broadcast, about 17 bytes each.
HOT_PAIRS = 2_000_000
#: Bytes of text that are aligned at once; longer texts are tokenised in pieces of about this many characters.
SLICE_BYTES = PIECE_CHARS = 1 << 20
#: Links that are expanded at once.
LINKS = 1 << 22
#: Between words both tokenizers end a token: neither merges across a single space after a character other than white space.
_GAP = re.compile(r"(?<=\S) (?=\S)")
#: Beyond it letters may be newer than the tables of one of two libraries.
_NEW = re.compile("[^\x00-ӿ]")
COLUMNS = "row long, key long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of about ``size`` characters that both tokenizers treat alone as they do within the text; each
    but the first lacks the space before it. A word of any length stays whole."""
    at = 0
    while len(text) - at > size and (gap := _GAP.search(text, at + size)):
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:] if at else text


class ByteTokens:
    """Tokens of a byte-level vocabulary file, without special ones."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = public_tokenizers.path(vocabulary)
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        letters = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}
        with open(path, encoding="utf-8") as file:
            ranks = {bytes(map(letters.__getitem__, entry)): i for entry, i in json.load(file)["model"]["vocab"].items() if all(c in letters for c in entry)}
        special = {t.content.encode() for t in self.plain.get_added_tokens_decoder().values()}
        ranks = {entry: i for entry, i in ranks.items() if entry not in special}
        self.fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = self.plain.get_vocab_size()
        self.lengths = np.zeros(self.size, np.int64)
        for entry, i in ranks.items():
            self.lengths[i] = len(entry)

    def encode(self, text: str) -> list[int]:
        return self.plain.encode(text, add_special_tokens=False).ids if _NEW.search(text) else self.fast.encode_ordinary(text)

    def joined(self, ids: list[int]) -> bytes:
        return self.fast.decode_bytes(ids)


class PieceTokens:
    """Tokens of a piece model with byte fallback, which puts a space before each text."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
        self.size = self.model.vocab_size()
        spelt = lambda i, p: bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
        self.bytes = [spelt(i, self.model.id_to_piece(i)) for i in range(self.size)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def tokenizers(a: str, b: str) -> tuple[ByteTokens, PieceTokens]:
    return ByteTokens(a), PieceTokens(b)


def tokens_of(text: str | None, a: ByteTokens, b: PieceTokens) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids of a space and the text by both; None where there is no text or the ids don't spell it."""
    if not text:
        return None
    left, right = [], []
    for piece in pieces(text):
        want = " " + piece
        x, y = a.encode(want), b.encode(piece)
        want = want.encode()
        if a.joined(x) != want or b.joined(y) != want:
            return None
        left.append(np.array(x, np.int64))
        right.append(np.array(y, np.int64))
    return (left[0], right[0]) if len(left) == 1 else (np.concatenate(left), np.concatenate(right))


def ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of the ranges first..last (none where last < first), and which range each is of."""
    n = np.maximum(last - first + 1, 0)
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of], of


def middle_cuts(a: np.ndarray, b: np.ndarray, i0: np.ndarray, i1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval of the tokens i0..i1-1 of A the inner end nearest to its middle that is one of B's, as its places
    in a and b; -1 where there is none. Ends are looked for outwards from the middle, twice as many in each round."""
    cut_a, cut_b = np.full(len(i0), -1), np.full(len(i0), -1)
    middle, open_, near, far = (i0 + i1 - 2) // 2, np.arange(len(i0)), 0, 1
    while len(open_):
        m, low, high = middle[open_], i0[open_], i1[open_] - 2
        probes, of = ranges(np.maximum(m - far + 1, low), np.minimum(m - near, high))
        if near:
            right, of_right = ranges(np.maximum(m + near, low), np.minimum(m + far - 1, high))
            probes, of = np.concatenate([probes, right]), np.concatenate([of, of_right])
        at = np.searchsorted(b, a[probes])  # bisection
        hit = b[at] == a[probes]
        probes, of, at = probes[hit], of[hit], at[hit]
        best = np.lexsort((np.abs(probes - m[of]), of))
        first = best[np.r_[True, np.diff(of[best]) > 0]] if len(best) else best
        cut_a[open_[of[first]]], cut_b[open_[of[first]]] = probes[first], at[first]
        open_ = open_[(cut_a[open_] < 0) & ((m - far >= low) | (m + far <= high))]
        near, far = far, 2 * far
    return cut_a, cut_b


def groups(a: np.ndarray, b: np.ndarray, starts_a: np.ndarray, starts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of the first token of each group, in order. ``a`` and ``b`` are ends of tokens, growing over all
    texts; the texts begin at ``starts_a`` and ``starts_b`` and end together."""
    i0, i1, j0, j1 = starts_a, np.append(starts_a[1:], len(a)), starts_b, np.append(starts_b[1:], len(b))
    leaves = []
    while len(i0):
        inner = (i1 - i0 > 1) & (j1 - j0 > 1)
        leaves.append((i0[~inner], j0[~inner]))
        i0, i1, j0, j1 = i0[inner], i1[inner], j0[inner], j1[inner]
        cut_a, cut_b = middle_cuts(a, b, i0, i1)
        cut = cut_a >= 0
        leaves.append((i0[~cut], j0[~cut]))
        i0, i1, j0, j1, cut_a, cut_b = i0[cut], i1[cut], j0[cut], j1[cut], cut_a[cut] + 1, cut_b[cut] + 1
        i0, i1, j0, j1 = np.r_[i0, cut_a], np.r_[cut_a, i1], np.r_[j0, cut_b], np.r_[cut_b, j1]
    first_a, first_b = (np.concatenate([leaf[k] for leaf in leaves]) for k in (0, 1)) if leaves else (starts_a, starts_b)
    order = np.argsort(first_a, kind="stable")
    return first_a[order], first_b[order]


def counted(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their times added up."""
    keys, times = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def links(ids_a: np.ndarray, ids_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, doc: np.ndarray, size_b: int, space: int) -> tuple[np.ndarray, np.ndarray]:
    """doc * space + pair of all links, distinct and in order, with how often each is linked; pair is a * size_b + b.

    At most LINKS of them are expanded at once; of a group with more, its distinct ids are paired, with the product of how
    often each stands in it.
    """
    n_a, n_b = np.diff(np.append(first_a, len(ids_a))), np.diff(np.append(first_b, len(ids_b)))
    n = n_a * n_b
    keys, times = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for g in np.flatnonzero(n > LINKS).tolist():
        (x, nx), (y, ny) = (np.unique(ids[f[g] : f[g] + k[g]], return_counts=True) for ids, f, k in ((ids_a, first_a, n_a), (ids_b, first_b, n_b)))
        keys.append((doc[g] * space + x[:, None] * size_b + y[None, :]).ravel())
        times.append((nx[:, None] * ny[None, :]).ravel())
    usual = np.flatnonzero(n <= LINKS)
    chunk = np.cumsum(n[usual]) // LINKS
    for part in np.split(usual, np.flatnonzero(np.diff(chunk)) + 1):
        k, of = ranges(np.zeros(len(part), np.int64), n[part] - 1)
        g = part[of]
        pair = ids_a[first_a[g] + k // n_b[g]] * size_b + ids_b[first_b[g] + k % n_b[g]]
        key, many = np.unique(doc[g] * space + pair, return_counts=True)
        keys.append(key)
        times.append(many)
    return counted(keys, times)


@functools.lru_cache(maxsize=2)
def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0..size-1, to the right, and how many there are."""
    width, ids = len(str(size - 1)), np.arange(size)
    cells = np.stack([(ids // 10**p) % 10 + 48 for p in range(width - 1, -1, -1)], axis=1).astype(np.uint8)
    return cells, np.maximum(1, np.ceil(np.log10(ids + 1)).astype(np.int64)) if width > 1 else np.ones(size, np.int64)


def group_digests(ids_a: np.ndarray, ids_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, doc_groups: np.ndarray, size: int) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` of each text; ``doc_groups`` are the places of the texts' first groups."""
    cells, width = _digits(size)
    span = cells.shape[1]
    n, g_a, g_b = len(ids_a) + len(ids_b), np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    g_a[first_a[1:]], g_b[first_b[1:]] = 1, 1
    end_a, end_b = np.append(first_a[1:], len(ids_a)), np.append(first_b[1:], len(ids_b))
    place_a = np.arange(len(ids_a)) + first_b[np.cumsum(g_a)]  # after all B tokens of earlier groups
    place_b = np.arange(len(ids_b)) + end_a[np.cumsum(g_b)]
    ids, after = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[place_a], ids[place_b] = ids_a, ids_b
    after[place_a[end_a - 1]], after[place_b[end_b - 1]] = ord("|"), ord(";")
    drawn = np.concatenate([cells[ids], after[:, None]], axis=1)
    shown = np.arange(span)[None, :] >= span - width[ids][:, None]
    data = drawn[np.concatenate([shown, np.ones((n, 1), bool)], axis=1)].tobytes()
    ends = np.cumsum(width[ids] + 1)
    starts = np.append(first_a[doc_groups] + first_b[doc_groups], n)  # tokens before each text
    at = np.append(0, ends)[starts].tolist()
    return [hashlib.sha256(data[x : y - 1]).hexdigest() for x, y in zip(at, at[1:])]


def aligned(texts: list[str | None], a: ByteTokens, b: PieceTokens) -> dict[str, list]:
    """n_a, n_b, n_groups, n_links, groups_sha256, pairs and times of each text."""
    space = a.size * b.size
    found = [tokens_of(t, a, b) for t in texts]
    with_tokens = [k for k, f in enumerate(found) if f is not None]
    out = {c: [0] * len(texts) for c in ("n_a", "n_b", "n_groups", "n_links")} | {"groups_sha256": [""] * len(texts)}
    out |= {c: [np.empty(0, np.int64)] * len(texts) for c in ("pairs", "times")}
    if not with_tokens:
        return out
    ids_a, ids_b = (np.concatenate([found[k][s] for k in with_tokens]) for s in (0, 1))
    starts_a, starts_b = (np.cumsum([0] + [len(found[k][s]) for k in with_tokens])[:-1] for s in (0, 1))
    first_a, first_b = groups(np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b]), starts_a, starts_b)
    doc_groups = np.searchsorted(first_a, starts_a)
    n_groups = np.diff(np.append(doc_groups, len(first_a)))
    doc = np.repeat(np.arange(len(with_tokens)), n_groups)
    keys, times = links(ids_a, ids_b, first_a, first_b, doc, b.size, space)
    n_links = np.add.reduceat(np.diff(np.append(first_a, len(ids_a))) * np.diff(np.append(first_b, len(ids_b))), doc_groups)
    cuts = np.searchsorted(keys, np.arange(len(with_tokens) + 1) * space)
    digests = group_digests(ids_a, ids_b, first_a, first_b, doc_groups, max(a.size, b.size))
    for d, k in enumerate(with_tokens):
        out["n_a"][k], out["n_b"][k], out["n_groups"][k], out["n_links"][k] = len(found[k][0]), len(found[k][1]), int(n_groups[d]), int(n_links[d])
        out["groups_sha256"][k] = digests[d]
        out["pairs"][k], out["times"][k] = keys[cuts[d] : cuts[d + 1]] - d * space, times[cuts[d] : cuts[d + 1]]
    return out


def alignments(docs: DataFrame, key: str, text: str, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B) -> DataFrame:
    """COLUMNS of each row, written as a table in the shared folder; ``row`` numbers the rows."""

    def make(batches):
        a, b = tokenizers(vocabulary_a, vocabulary_b)
        for batch in batches:
            for part in arrow_slices(batch, "text", SLICE_BYTES):
                got = aligned(part["text"].to_pylist(), a, b)
                lists = {}
                for name, kind in (("pairs", pa.int64()), ("times", pa.int32())):
                    ends = np.cumsum([0, *map(len, got[name])], dtype=np.int32)
                    lists[name] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got[name])).cast(kind))
                counts = [pa.array(got[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
                names = [c.split()[0] for c in COLUMNS.split(", ")]
                yield pa.RecordBatch.from_arrays([part["row"], part["key"], *counts, pa.array(got["groups_sha256"], pa.string()), lists["pairs"], lists["times"]], names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    path = f"{shared_folder(docs.sparkSession)}/alignments"
    rows.mapInArrow(make, COLUMNS).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def pair_counts(found: DataFrame, size_b: int) -> DataFrame:
    """(pair, docs, best): in how many rows each pair of ids is linked, and whether that is the most of its A id. An A id
    has at most as many pairs as B has ids."""
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    most = F.max("docs").over(Window.partitionBy(F.call_function("div", F.col("pair"), F.lit(size_b))))
    return counts.withColumn("best", F.col("docs") == most)


def frequent_from(counts: DataFrame, bound: int) -> int:
    """The least power of two (or 0) such that at most ``bound`` pairs are in that many rows or more."""
    steps = counts.groupBy(F.floor(F.log2("docs")).cast("int").alias("p")).agg(F.count("*").alias("n")).collect()  # 63 rows at most
    at_least = 0
    for step in sorted(steps, key=lambda s: -s["p"]):
        at_least += step["n"]
        if at_least > bound:
            return 2 ** (step["p"] + 1)
    return 0


def cross_alignment(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row.

    Null and empty texts, and those that the ids of either tokenizer don't spell (a text that holds U+2581), have no
    tokens: zeros and ''. Long texts are tokenised in pieces and aligned whole. Each row counts for the corpus-wide counts,
    repeated rows and those without key too. Other columns are not looked at, whatever their names. An empty table gives
    no rows.
    """
    spark = docs.sparkSession
    found = alignments(docs, key, text, vocabulary_a, vocabulary_b)
    counts = checkpointed(pair_counts(found, tokenizers(vocabulary_a, vocabulary_b)[1].size))
    least = frequent_from(counts, hot_pairs)
    hot = counts.where(F.col("docs") >= least).toPandas().sort_values("pair")  # at most hot_pairs rows
    known = spark.sparkContext.broadcast((hot["pair"].to_numpy(np.int64), hot["docs"].to_numpy(np.int64), hot["best"].to_numpy(bool)))

    def rated(batches):
        pair, n_docs, best = known.value
        for batch in batches:
            ends, pairs, times = batch["pairs"].offsets.to_numpy().astype(np.int64), batch["pairs"].flatten().to_numpy(), batch["times"].flatten().to_numpy().astype(np.int64)
            ends = ends - ends[0]
            at = np.minimum(np.searchsorted(pair, pairs), max(len(pair) - 1, 0))
            met = pair[at] == pairs if len(pair) else np.zeros(len(pairs), bool)
            weight = np.where(met, times, 0) if len(pair) else np.zeros(len(pairs), np.int64)
            total = lambda x: np.diff(np.append(0, np.cumsum(x))[ends])
            n_best, count_sum = (total(weight * f[at]) if len(pair) else np.zeros(batch.num_rows, np.int64) for f in (best, n_docs))
            rest = np.append(0, np.cumsum(~met))[ends].astype(np.int32)
            left = [pa.ListArray.from_arrays(pa.array(rest), pa.array(x[~met])) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(n_best), pa.array(count_sum), *left], [*kept, "n_best", "count_sum", "pairs", "times"])

    kept = ["row", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    out = found.mapInArrow(rated, "row long, key long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pairs array<long>, times array<long>")
    if least:
        out = checkpointed(out)
        open_ = out.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times").join(counts.where(F.col("docs") < least), F.col("pairs") == F.col("pair"))
        more = open_.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("docs")).alias("_sum"))
        out = out.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))})
    return out.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_alignment(table(spark, sf_dir, "documents").select("doc_id", "text"))
