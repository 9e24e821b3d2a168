"""Toxicity scores: a linear classifier on character n-grams that naive Bayes log-count ratios scale.

Counts and each gradient of the fit are made in tasks over the training rows; the driver holds a vector of the weights.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_slices, checkpointed, table

SIZES = (3, 4, 5, 6)
#: n-grams are hashed to 2**BUCKET_BITS buckets.
BUCKET_BITS = 20
#: Bound of the fit: labelled documents, those of the smallest hash of doc_id.
MAX_TRAIN_ROWS = 20_000
#: Least chi-square of a feature with the label: the 0.1 % level, at every size. 0 keeps all n-grams.
MIN_CHI = 10.83
#: Weight of the squared weights in the loss. The fit ends when the gradient's norm is this share of the first one's;
#: STEPS only ends a fit that doesn't get there.
RIDGE, CLOSE, STEPS = 2e-4, 1e-4, 1000
FIT_TASKS = 16
CHUNK = 1 << 12
HOLD_OUT = 5

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is a multiple of five; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HOLD_OUT == 0, F.lit(True))


def ngrams(text: str | None, bits: int = BUCKET_BITS) -> np.ndarray:
    """Buckets of all character n-grams of the whole text, repeats included; letters only, lower case, words edged by spaces."""
    flat = " " + _NOT_LETTERS.sub(" ", (text or "").lower()).strip() + " "
    codes = np.frombuffer(flat.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    found = []
    hashed = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(SIZES) + 1):
        if len(codes) < n:
            break
        hashed = hashed[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        if n in SIZES:
            mixed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            found.append((mixed >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(found) if found else np.empty(0, dtype=np.int64)


@dataclass
class Model:
    """``place`` maps a bucket to its feature or -1; ``weight`` holds weight times log-count ratio."""

    place: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int = BUCKET_BITS

    def score(self, text: str | None) -> float:
        if not len(self.weight):
            return float(1 / (1 + np.exp(-self.bias)))
        z = self.bias + float(self.weight[present(self.place, text, self.bits)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def present(place: np.ndarray, text: str | None, bits: int = BUCKET_BITS) -> np.ndarray:
    """Features that the text holds, each once."""
    found = place[ngrams(text, bits)]
    return np.unique(found[found >= 0])


def counted(train: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """(bucket, pos, neg): documents of each class that hold an n-gram of the bucket, for all buckets that some document holds."""
    buckets = 1 << bits
    chunk = min(CHUNK, buckets)

    def count(batches):
        sums = np.zeros((2, buckets), dtype=np.int32)
        for batch in batches:
            for part in arrow_slices(batch, "text"):
                for text, toxic in zip(part["text"].to_pylist(), part["toxic"].to_pylist()):
                    sums[toxic, np.unique(ngrams(text, bits))] += 1
        if sums.any():
            ends = pa.array(np.arange(0, buckets + 1, chunk, dtype=np.int32))
            neg, pos = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in sums)
            yield pa.RecordBatch.from_arrays([pa.array(range(buckets // chunk), pa.int64()), neg, pos], ["chunk", "neg", "pos"])

    def add(key, pdf):
        pos, neg = np.sum(np.stack(pdf["pos"].to_list()), axis=0), np.sum(np.stack(pdf["neg"].to_list()), axis=0)
        keep = np.flatnonzero(pos + neg)
        return pd.DataFrame({"bucket": keep + key[0] * chunk, "pos": pos[keep], "neg": neg[keep]})

    parts = train.mapInArrow(count, "chunk long, neg array<int>, pos array<int>")
    return parts.groupBy("chunk").applyInPandas(add, "bucket long, pos long, neg long")


def fit(train: DataFrame, min_chi: float = MIN_CHI, bits: int = BUCKET_BITS, steps: int = STEPS) -> Model:
    """Fit on rows (text, toxic). What reaches the driver is bounded by the 2**bits buckets, not by the rows."""
    train = checkpointed(train.repartition(FIT_TASKS))
    n = {int(r["toxic"]): r["count"] for r in train.groupBy("toxic").count().collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    place = np.full(1 << bits, -1, dtype=np.int32)
    if not n_pos or not n_neg:
        return Model(place, np.empty(0), 30.0 if n_pos else -30.0, bits)
    a, b = F.col("pos").cast("double"), F.col("neg").cast("double")
    total = float(n_pos + n_neg)
    gap = a * n_neg - b * n_pos
    chi = total * gap * gap / (n_pos * n_neg * (a + b) * (total - a - b + 1))
    best = counted(train, bits).where(chi >= min_chi).toArrow().to_pandas().sort_values("bucket")
    if best.empty:
        return Model(place, np.empty(0), float(np.log(n_pos / n_neg)), bits)
    place[best["bucket"].to_numpy()] = np.arange(len(best))
    ratio = np.log((best["pos"].to_numpy() + 1.0) / (n_pos + 2.0)) - np.log((best["neg"].to_numpy() + 1.0) / (n_neg + 2.0))
    shared = train.sparkSession.sparkContext.broadcast(place)

    def select(batches):
        for batch in batches:
            for part in arrow_slices(batch, "text"):
                held = [present(shared.value, x, bits).astype("<u4").tobytes() for x in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["toxic"], pa.array(held, pa.binary())], ["toxic", "features"])

    rows = checkpointed(train.mapInArrow(select, "toxic int, features binary"))
    share = {1: 0.5 / n_pos, 0: 0.5 / n_neg}
    weights = minimised(lambda w: loss(rows, ratio, w, share), np.zeros(len(best) + 1), steps)
    return Model(place, weights[:-1] * ratio, float(weights[-1]), bits)


def loss(rows: DataFrame, scale: np.ndarray, w: np.ndarray, share: dict[int, float], ridge: float = RIDGE) -> tuple[float, np.ndarray]:
    """Ridge logistic loss of weights (the last one is the bias) on presence times ``scale``, and its gradient. Rows of a
    class weigh ``share``. A task sends one vector, so the driver gets FIT_TASKS of them whatever the rows."""
    shared = rows.sparkSession.sparkContext.broadcast((w[:-1] * scale, float(w[-1])))

    def partial(batches):
        weights, bias = shared.value
        value, grad = 0.0, np.zeros(len(weights) + 1)
        for batch in batches:
            for toxic, packed in zip(batch["toxic"].to_pylist(), batch["features"].to_pylist()):
                held = np.frombuffer(packed, "<u4")
                z = bias + weights[held].sum()
                value += share[toxic] * np.logaddexp(0, -z if toxic else z)
                error = share[toxic] * (1 / (1 + np.exp(-np.clip(z, -700, 700))) - toxic)
                grad[held] += error  # no feature is twice in a row
                grad[-1] += error
        yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([grad.tobytes()], pa.binary())], ["value", "grad"])

    parts = rows.mapInArrow(partial, "value double, grad binary").collect()
    shared.destroy()
    grad = np.sum([np.frombuffer(p["grad"]) for p in parts], axis=0)
    grad[:-1] = grad[:-1] * scale + ridge * w[:-1]
    return sum(p["value"] for p in parts) + ridge / 2 * float(w[:-1] @ w[:-1]), grad


def minimised(f, x: np.ndarray, steps: int, memory: int = 10, close: float = CLOSE) -> np.ndarray:
    """The least of a smooth convex function by L-BFGS with halved steps; ends when the gradient's norm is at most ``close``
    of what it was at first."""
    value, grad = f(x)
    enough = close * np.linalg.norm(grad)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.linalg.norm(grad) <= enough:
            break
        way, parts = -grad, []
        for s, y in reversed(moves):
            part = (s @ way) / (s @ y)
            parts.append(part)
            way = way - part * y
        if moves:
            s, y = moves[-1]
            way = way * ((s @ y) / (y @ y))
        else:
            way = way / max(1e-12, np.linalg.norm(grad))
        for (s, y), part in zip(moves, reversed(parts)):
            way = way + s * (part - (y @ way) / (s @ y))
        slope, step = float(grad @ way), 1.0
        for _ in range(20):
            new_value, new_grad = f(x + step * way)
            if new_value <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            return x
        s, y = step * way, new_grad - grad
        if s @ y > 1e-12:
            moves = [*moves[1 - memory :], (s, y)]
        x, value, grad = x + s, new_value, new_grad
    return x


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of labelled documents that are not held out; of more than ``max_rows``, those of the smallest hash.

    Null labels are no labels; a document labelled twice is toxic if one label says so. Rows of one id give one row, with
    the least of their texts.
    """
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = checkpointed(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (0 to 1, of the text alone) and predicted, replacing columns of those names; null and empty texts
    score the bias. Rows stay as they are, repeated or not; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        model, batch = shared.value, pa.RecordBatch.from_arrays([texts], ["text"])
        return pa.array([model.score(x) for part in arrow_slices(batch, "text") for x in part["text"].to_pylist()], pa.float64())

    return docs.withColumn("score", score("text")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Fit on the labelled documents that are not held out, then score every document. Without labels of both classes the
    score is constant (0 where nothing is known to be toxic). Texts of any length count and are scored in full."""
    return scored(docs, fit(training_rows(docs, labels, max_rows)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return classify(docs, labels).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
