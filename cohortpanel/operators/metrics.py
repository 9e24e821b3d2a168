"""Metrics that need more than two points: each becomes a plain one on vectors that are mapped first.

The moments of all vectors are summed in tasks; the driver holds a matrix of the vectors' width, never a vector's row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The plain metric that a mapped one is measured by.
MAPPED = {"seuclidean": "euclidean", "mahalanobis": "euclidean", "correlation": "cosine", "spearman": "cosine"}


def moments(vectors: DataFrame) -> tuple[float, np.ndarray, np.ndarray] | None:
    """How many vectors ``v`` there are, their mean, and the sums of products of their differences from it; None without any."""

    def scatter(batches):
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf["v"].to_list())
                whole = np.concatenate([np.ones((len(v), 1)), v], axis=1)  # with a column of ones: counts and sums too
                yield pd.DataFrame({"place": np.arange(whole.shape[1] ** 2), "x": (whole.T @ whole).ravel()})

    sums = vectors.select("v").mapInPandas(scatter, "place long, x double").groupBy("place").agg(F.sum("x").alias("x")).orderBy("place").collect()  # the square of the width
    if not sums:
        return None
    width = round(len(sums) ** 0.5)
    both = np.array([r["x"] for r in sums]).reshape(width, width)
    n, mean = both[0, 0], both[0, 1:] / both[0, 0]
    return n, mean, both[1:, 1:] - n * np.outer(mean, mean)


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1 within a row; equal values share the mean of theirs."""
    _, place, counts = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2)[place]


def _centred(v: np.ndarray) -> np.ndarray:
    centred = v - v.mean(axis=1, keepdims=True)
    centred[(v == v[:, :1]).all(axis=1)] = 0.0  # a constant row has no direction, whatever its mean is rounded to
    return centred


def _mapping(vectors: DataFrame, metric: str) -> Callable[[np.ndarray], np.ndarray]:
    if metric == "correlation":
        return _centred
    if metric == "spearman":
        return lambda v: _centred(np.apply_along_axis(average_ranks, 1, v))
    found = moments(vectors)
    if found is None:
        return lambda v: v
    n, mean, scatter = found
    covariance = scatter / max(1.0, n - 1)
    if metric == "seuclidean":
        spread = np.sqrt(np.clip(np.diag(covariance), 0, None))
        varies = spread > 1e-12 * np.maximum(1.0, np.abs(mean))
        scale = np.where(varies, 1 / np.where(varies, spread, 1.0), 0.0)
        return lambda v: v * scale
    values = np.linalg.eigvalsh(covariance)
    if values[0] <= values[-1] * len(values) * np.finfo(float).eps:
        raise ValueError(f"mahalanobis needs a covariance of full rank; that of {n:.0f} vectors of width {len(values)} is not")
    whitening = np.linalg.inv(np.linalg.cholesky(covariance))
    return lambda v: v @ whitening.T


def mapped(vectors: DataFrame, metric: str) -> tuple[DataFrame, str]:
    """The vectors (sample_idx, v) such that the plain metric returned with them gives the named one; others as they are.

    seuclidean: by sample deviations; coordinates that do not vary count nothing. mahalanobis: whitened by the Cholesky
    factor of the covariance, which must have full rank. correlation: centred rows. spearman: centred ranks; a row without
    variation has a distance that is no number from every other, as in cosine.
    """
    if metric not in MAPPED:
        return vectors, metric
    change = _mapping(vectors, metric)

    def apply(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(v=list(change(np.stack(pdf["v"].to_list()).astype(float))))

    return vectors.select("sample_idx", "v").mapInPandas(apply, "sample_idx int, v array<double>"), MAPPED[metric]
