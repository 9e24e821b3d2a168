"""Packing tokenised documents into fixed-length sequences: first-fit decreasing in randomised groups."""

from __future__ import annotations

import itertools
import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, arrow_slices, checkpointed, table

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Pieces a group of first-fit decreasing holds about.
GROUP_PIECES = 8192
#: Bytes of words whose ids a Python worker remembers, about; and what a word takes beside its characters.
CACHE_BYTES, WORD_BYTES = 144 << 20, 320
#: Bytes of text that are encoded at once.
SLICE_BYTES = 1 << 20
#: The normaliser and pre-tokeniser that let words be encoded by themselves.
BY_WORDS = (
    ["NFC", "Replace", "Lowercase"], r"\s+", " ",
    ["Split", "ByteLevel"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "Removed", True, False, False,
)

_WORD = re.compile(f"[^{re.escape(SPACE)}]+")
_CONTROL = re.compile("[\x1c-\x1f]")
_PLAIN = re.compile(r"([a-zà-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


class WordTokenizer:
    """Ids of a whole text from the ids of its words.

    The vocabulary drops white space and never merges across it, so ids of white-space-separated words, each encoded by
    itself, are those of the text. A word of lower-cased Latin letters with ASCII punctuation after them is two pieces,
    which the vocabulary never merges either; the model alone encodes them, as nothing is left to normalise. Other words
    are one piece, encoded in full. Ids are kept as little-endian 32-bit numbers, so a text's are its words' joined.
    All this holds for the steps named in BY_WORDS; texts are encoded in full by vocabularies that have others.
    """

    def __init__(self, vocabulary: str, cache_bytes: int = CACHE_BYTES):
        import public_tokenizers
        from tokenizers import Tokenizer

        path = public_tokenizers.path(vocabulary)
        self.encoder, self.by_words = Tokenizer.from_file(path), steps_of(path) == BY_WORDS
        self.tokenize, self.cache_bytes = self.encoder.model.tokenize, cache_bytes
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the vocabulary
        others = [b for b in range(256) if b not in set(plain)]
        self.byte = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.clear()

    def clear(self):
        self.word: dict[str, bytes] = {}
        self.piece: dict[str, bytes] = {"": b""}  # stems and tails of words
        self.bytes = 0

    def piece_ids(self, piece: str) -> bytes:
        found = self.piece.get(piece)
        if found is None:
            spelt = piece if piece.isascii() else "".join(map(self.byte.__getitem__, piece.encode()))
            found = self.piece[piece] = packed([t.id for t in self.tokenize(spelt)])
        return found

    def learn(self, words: list[str]):
        word_ids, piece_ids, plain, rest = self.word, self.piece_ids, _PLAIN.fullmatch, []
        for word in words:
            match = plain(word) or plain(word.lower())
            if match is None:
                rest.append(word)
                continue
            stem, tail = match.groups()
            word_ids[word] = piece_ids(stem) + piece_ids(tail) if tail else piece_ids(stem)
        for word, encoding in zip(rest, self.encoder.encode_batch_fast(rest, add_special_tokens=False)):
            word_ids[word] = packed(encoding.ids)
        self.bytes += sum(map(len, words)) + WORD_BYTES * len(words)

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text. The memory is emptied between calls once it holds more than ``cache_bytes``."""
        if not self.by_words:
            return [np.array(e.ids, "<u4") for e in self.encoder.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        if self.bytes > self.cache_bytes:
            self.clear()
        # str.split knows the tokenizer's white space and four control characters that are none to it
        split = [(_WORD.findall(t) if _CONTROL.search(t) else t.split()) if t else [] for t in texts]
        fresh = set(itertools.chain.from_iterable(split)).difference(self.word)
        if fresh:
            self.learn(list(fresh))
        return [np.frombuffer(b"".join(map(self.word.__getitem__, words)), "<u4") for words in split]


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def steps_of(path: str) -> tuple:
    """What of a vocabulary file BY_WORDS names; empty where it has other steps."""
    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    try:
        norms, splits = described["normalizer"]["normalizers"], described["pre_tokenizer"]["pretokenizers"]
        return (
            [n["type"] for n in norms], norms[1]["pattern"]["Regex"], norms[1]["content"],
            [p["type"] for p in splits], splits[0]["pattern"]["Regex"], splits[0]["behavior"], splits[0]["invert"], splits[1]["add_prefix_space"], splits[1]["use_regex"],
        )
    except (KeyError, TypeError, IndexError):
        return ()


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(vocabulary: str, cache_bytes: int = CACHE_BYTES) -> WordTokenizer:
    if vocabulary not in _tokenizers:
        _tokenizers[vocabulary] = WordTokenizer(vocabulary)
    _tokenizers[vocabulary].cache_bytes = cache_bytes
    return _tokenizers[vocabulary]


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin (from 0) and offset of each item, all at most ``capacity``.

    Leaves of a tournament tree are bins, each node holds the largest free space below it; going left whenever the left
    child has room finds the first bin that fits in log(bins) steps. Full items open bins of their own. Ties keep order.
    """
    order = np.argsort(-sizes, kind="stable")
    full = int((sizes == capacity).sum())
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    bins[order[:full]] = np.arange(full)
    rest = order[full:].tolist()
    leaves = 1
    while leaves < max(1, len(rest)):
        leaves *= 2
    free = [capacity] * (2 * leaves)
    for item in rest:
        size, node = int(sizes[item]), 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        bins[item], offsets[item] = full + node - leaves, capacity - free[node]
        free[node] -= size
        while node > 1:
            node //= 2
            left, right = free[2 * node], free[2 * node + 1]
            free[node] = left if left > right else right
    return bins, offsets


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens): each document's ids and ``end_id``, cut every ``capacity`` ids."""
    kind = dict(docs.dtypes)[key]
    names = ["key", "start", "length", "ids_crc32", "doc_tokens"]

    def cut(batches):
        words = tokenizer(vocabulary, cache_bytes)
        try:
            for batch in batches:
                for part in arrow_slices(batch, "text", SLICE_BYTES):
                    out = []
                    for row, ids in enumerate(words.ids(part["text"].to_pylist())):
                        ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                        out += [(row, s, min(capacity, len(ids) - s), zlib.crc32(ids[s : s + capacity].tobytes()), len(ids)) for s in range(0, len(ids), capacity)]
                    rows, *figures = (pa.array(c, pa.int64()) for c in zip(*out))
                    yield pa.RecordBatch.from_arrays([part["key"].take(rows), *figures], names)
        finally:
            words.clear()  # workers outlive their task

    schema = "key string, start long, length long, ids_crc32 long, doc_tokens long"
    cut_up = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(cut, schema)
    return cut_up.select(F.col("key").cast(kind).alias(key), *names[1:])


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, seed: int = 11, group_pieces: int = GROUP_PIECES, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Pieces of all documents with sequence_id and offset: gapless sequences of at most ``capacity`` ids.

    Pieces, written once, are dealt to groups of about ``group_pieces`` by a seeded hash of all of them and of their
    place in what was written, so neither one long document nor repeated rows make a large group; each group is packed
    by itself. Its pieces are taken in (length, key, start, crc) order. Null text: only the end id. Null keys and
    repeated rows are documents of their own. An empty table gives no rows. Other columns of docs are dropped, whatever
    their names. ``cache_bytes`` bounds the words that a Python worker remembers, which changes nothing but its speed.
    """
    kind = dict(docs.dtypes)[key]
    cut = pieces(docs, key, text, capacity, vocabulary, cache_bytes=cache_bytes).withColumn("key", F.col(key).cast("string"))
    cut = checkpointed(cut.select("key", "start", "length", "ids_crc32", "doc_tokens"))
    groups = max(1, -(-cut.count() // group_pieces))

    def place(group, pdf):
        pdf = pdf.sort_values(["length", "key", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), capacity)
        return pdf.drop(columns="_group").assign(sequence_id=(int(group[0]) << 40) + bins, offset=offsets)

    schema = "key string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    deal = F.pmod(F.xxhash64(F.lit(seed), "key", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))
    placed = cut.withColumn("_group", deal).groupBy("_group").applyInPandas(place, schema)
    return placed.select(F.col("key").cast(kind).alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
