"""Weighted distances between z-scored samples, as edges i < j."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import FEATURE_WEIGHTS
from ..functions.normalize import finite_or_zero
from .metrics import MAPPED, mapped

#: Samples in a block; a task holds two.
BLOCK = 512
#: Samples in a block whose pairs come in the order of their distance, how many such blocks a table has at least, and rows that
#: leave a task at once.
WIDE, WIDE_BLOCKS, ROWS = 4096, 8, 1 << 18
#: Samples of one block whose distances to the other are summed at once.
TILE = 64
#: Parts that blocks are dealt to at least, as far as there are blocks, and blocks in a part at most.
PARTS, PART = 8, 16
METRICS = ("euclidean", "squaredeuclidean", "cityblock", "chebychev", "cosine", "hamming", "jaccard", "minkowski", *MAPPED)


def exponent(metric: str) -> float:
    """That of ``minkowski``, 2, or of ``minkowski:p``."""
    return float(metric.partition(":")[2] or 2)


def check_metric(metric: str) -> None:
    """Accepts the names of METRICS and ``minkowski:p`` with an exponent of at least 1."""
    name, colon, power = metric.partition(":")
    if name not in METRICS or (colon and name != "minkowski"):
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")
    try:
        fits = not colon or 1 <= float(power) < float("inf")
    except ValueError:
        fits = False
    if not fits:
        raise ValueError(f"the exponent of {metric!r} must be a number of at least 1")


def exploded(vectors: DataFrame) -> DataFrame:
    return vectors.select("sample_idx", "id", F.posexplode("features").alias("pos", "x")).withColumn("x", finite_or_zero(F.col("x")))


def feature_stats(long: DataFrame) -> DataFrame:
    return long.groupBy("pos").agg(F.avg("x").alias("_mean"), F.stddev_samp("x").alias("_sd"))


def zscores(vectors: DataFrame) -> DataFrame:
    """(sample_idx, id, pos, z): each feature by its mean and sample deviation; 0 where it does not vary."""
    long = exploded(vectors)
    stats = feature_stats(long)
    z = F.when(F.coalesce(F.col("_sd"), F.lit(0.0)) > 0, (F.col("x") - F.col("_mean")) / F.col("_sd")).otherwise(0.0)
    return long.join(F.broadcast(stats), "pos").select("sample_idx", "id", "pos", z.alias("z"))


def weights_for(width: int, given: tuple[float, ...] | None) -> tuple[float, ...]:
    """The given weights if their number fits, else the defaults for thirteen features, else ones."""
    if given is not None and len(given) == width:
        return tuple(map(float, given))
    if width == len(FEATURE_WEIGHTS):
        return tuple(FEATURE_WEIGHTS.values())
    if given is not None:
        warnings.warn(f"{len(given)} weights for {width} features: all weigh 1", stacklevel=2)
    return (1.0,) * width


def weighted_vectors(vectors: DataFrame, weights: tuple[float, ...] | None = None) -> DataFrame:
    """(sample_idx, id, v): z-scores times weights, in feature order. Means and deviations, as many as there are features,
    are carried to the rows, which stay whole and where they are."""
    width = vectors.select(F.max(F.size("features"))).first()[0] or 0
    w = F.array(*[F.lit(x) for x in weights_for(width, weights)])
    order = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("_sd", F.lit(0.0)).alias("sd"), F.col("_mean").alias("mean"))))
    stats = feature_stats(exploded(vectors)).agg(order.alias("_stats"))
    z = lambda x, k: F.when(F.get("_stats", k)["sd"] > 0, (finite_or_zero(x) - F.get("_stats", k)["mean"]) / F.get("_stats", k)["sd"]).otherwise(0.0) * F.get(w, k)
    return vectors.where(F.size("features") > 0).join(F.broadcast(stats)).select("sample_idx", "id", F.transform("features", z).alias("v"))


def _add(out: np.ndarray, gap: np.ndarray, x: np.ndarray, y: np.ndarray, metric: str, power: float, either: np.ndarray | None) -> None:
    """One coordinate's share of the distances of a tile; ``gap`` is scratch."""
    if metric in ("hamming", "jaccard"):
        out += x != y
        if either is not None:
            either += (x != 0) | (y != 0)
        return
    np.subtract(x, y, out=gap)
    if power == 2 and metric != "chebychev":
        np.multiply(gap, gap, out=gap)
    else:
        np.abs(gap, out=gap)
        if metric == "chebychev":
            np.maximum(out, gap, out=out)
            return
        if power == 3:  # a general power takes many times as long
            np.multiply(gap, gap * gap, out=gap)
        elif power != 1:
            np.power(gap, power, out=gap)
    out += gap


def pairwise(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all rows of a and b by a plain metric. Differences are taken outright, so equal rows have distance 0
    exactly. hamming: share of coordinates that differ; jaccard: among those that are not 0 in both, no number without any."""
    if metric == "cosine":
        norm = np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None, :]
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(norm > 0, 1 - (a @ b.T) / norm, np.nan)
    out = np.zeros((len(a), len(b)))
    either = np.zeros_like(out) if metric == "jaccard" else None
    power = exponent(metric) if metric.startswith("minkowski") else {"cityblock": 1.0}.get(metric, 2.0)
    for first in range(0, len(a), TILE):  # a tile and its differences stay in a core's cache
        x = np.ascontiguousarray(a[first : first + TILE].T)
        for start in range(0, len(b), BLOCK):
            part = slice(first, first + TILE), slice(start, start + BLOCK)
            tile, y, gap = out[part], b[start : start + BLOCK], np.empty(out[part].shape)
            for k in range(a.shape[1]):
                _add(tile, gap, x[k][:, None], y[:, k][None, :], metric, power, None if either is None else either[part])
    if metric == "hamming":
        return out / max(1, a.shape[1])
    if metric == "jaccard":
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(either > 0, out / either, np.nan)
    if metric == "euclidean" or metric.startswith("minkowski"):
        return np.sqrt(out, out=out) if power == 2 else np.power(out, 1 / power, out=out)
    return out


def packed(points: DataFrame, blocks: int, apart: bool = False) -> DataFrame:
    """(b, points): a row for each of ``blocks`` blocks b of (b, sample_idx, v); each point is dealt once. ``apart``: blocks are
    dealt by ranges, about one a part."""
    parts = blocks if apart else min(blocks, max(PARTS, -(-blocks // PART)))
    rows = points.select("b", F.struct("sample_idx", "v").alias("point"))
    return (rows.repartitionByRange(parts, "b") if apart else rows.repartition(parts, "b")).groupBy("b").agg(F.collect_list("point").alias("points")).coalesce(parts)


def faced(left: DataFrame, right: DataFrame, fits: Column) -> DataFrame:
    """Pairs of rows of packed blocks. A task reads one part of either side, so no block is copied for its partners: what is
    dealt is linear in the points, whatever the number of pairs."""
    return left.join(right.hint("shuffle_replicate_nl"), fits)


def points_of(column: pa.ListArray, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and vectors of a packed block, in the order of their numbers."""
    points = column[row].values
    v = points.field("v")
    if len(set(v.value_lengths().to_pylist())) > 1:
        raise ValueError("vectors differ in their number of features")
    numbers, whole = points.field("sample_idx").to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(len(points), -1)
    order = np.argsort(numbers, kind="stable")
    return numbers[order], whole[order]


def whole_batch(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(d, pa.float64())], ["i", "j", "d"])


def half_up(d: np.ndarray, digits: int) -> np.ndarray:
    """d, not below 0, with so many digits after the point, as Spark's round gives it: halves of its decimal text go up."""
    x = d * 10.0**digits
    with np.errstate(invalid="ignore"):
        low = np.floor(x)
        out = np.where(x - low < 0.5, low, low + 1) / 10.0**digits
        unsure = ~(np.abs(x - low - 0.5) > x * 2.0**-50) | ~(x < 2.0**40)  # the product's rounding may count
    for k in np.flatnonzero(unsure):
        value = float(d.flat[k])
        exact = Decimal(repr(value)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, Context(prec=400)) if np.isfinite(value) else value
        out.flat[k] = float(exact)
    return out


def by_distance(left: np.ndarray, right: np.ndarray, d: np.ndarray, same: bool, digits: int | None) -> Iterator[pa.RecordBatch]:
    """All pairs of two blocks, or of one with itself, in the order of their distance, which has ``digits`` if given."""
    flat, bits = d.ravel(), d.size.bit_length()
    if digits is not None and flat.max(initial=0.0) * 10.0**digits < 2.0 ** (63 - bits):
        whole = np.empty(d.size, np.uint64)  # with a pair's place in one number, which sorts faster than places by distance
        for first in range(0, d.size, ROWS):
            last = min(d.size, first + ROWS)
            whole[first:last] = (np.rint(flat[first:last] * 10.0**digits).astype(np.uint64) << np.uint64(bits)) | np.arange(first, last, dtype=np.uint64)
        whole.sort()
        place = lambda k: (whole[k] & np.uint64((1 << bits) - 1)).astype(np.int64)
    else:
        order = flat.argsort()
        place = lambda k: order[k]
    for first in range(0, d.size, ROWS):
        at = place(slice(first, first + ROWS))
        i, j = left[at // len(right)], right[at % len(right)]
        if same:
            keep = i < j
            at, i, j = at[keep], i[keep], j[keep]
        yield whole_batch(np.minimum(i, j), np.maximum(i, j), flat[at])


def distances(vectors: DataFrame, metric: str = "euclidean", block: int = BLOCK, wide: int | None = None, digits: int | None = None) -> DataFrame:
    """(i, j, d) for all i < j. The work is dealt as pairs of blocks of ``block`` samples, so a task's memory does not grow
    with their number, and what is shuffled is the samples alone. The result is quadratic by what it is; the tree
    (``operators.tree``) does without it.

    ``digits``: distances are rounded to so many, as by Spark's round. ``wide``: tables of more than WIDE_BLOCKS blocks of so
    many samples are dealt in these, and the pairs of two of them come in the order of their distance. Many neighbours are
    equal then, once rounded, and files of the rows are smaller, although i and j take more.
    """
    check_metric(metric)
    vectors, metric = mapped(vectors, metric)
    n = vectors.count()
    in_order = wide is not None and n > WIDE_BLOCKS * wide
    blocks = max(1, -(-n // (wide if in_order else block)))
    rows = packed(vectors.select(F.pmod("sample_idx", F.lit(blocks)).cast("int").alias("b"), "sample_idx", "v"), blocks, in_order)
    pairs = faced(rows.toDF("p", "left"), rows.toDF("q", "right"), F.col("p") <= F.col("q"))

    def measure(batches):
        for batch in batches:
            for row, (p, q) in enumerate(zip(batch["p"].to_pylist(), batch["q"].to_pylist())):
                (left, a), (right, b) = points_of(batch["left"], row), points_of(batch["right"], row)
                d = pairwise(a, b, metric)
                for part in np.array_split(d, max(1, d.size // ROWS)) if digits is not None else ():
                    part[:] = half_up(part, digits)
                if in_order:
                    yield from by_distance(left, right, d, p == q, digits)
                    continue
                i, j = np.broadcast_to(left[:, None], d.shape), np.broadcast_to(right[None, :], d.shape)
                if p == q:
                    keep = i < j
                    i, j, d = i[keep], j[keep], d[keep]
                yield whole_batch(np.minimum(i, j).ravel(), np.maximum(i, j).ravel(), d.ravel())

    return pairs.mapInArrow(measure, "i int, j int, d double")


def minmax(x: str, within: list[str]):
    """Scaled to [0, 1] within the group; 0 where all are equal."""
    over = Window.partitionBy(*within)
    low, high = F.min(x).over(over), F.max(x).over(over)
    return F.when(high > low, (F.col(x) - low) / (high - low)).otherwise(0.0)
