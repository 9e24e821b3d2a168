"""H0 persistence: the barcode is the minimum spanning tree of the distances; a threshold on deaths gives raw clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TopologyConfig
from ..functions.components import components, meet
from ..functions.lineage import table
from ..functions.placing import Ordered, numbered, ordered
from .distance import check_metric
from .tree import spanning_tree

#: Edges that one task labels; more are contracted by many.
SMALL = 500_000


def tree_of(vectors: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(i, j, d): the minimum spanning tree of (sample_idx, v)."""
    check_metric(metric)
    return spanning_tree(vectors, metric)


def deaths(tree: DataFrame) -> Ordered:
    """The tree's edges in the order of their deaths, over ranges: bars, percentiles and gaps all follow from it."""
    return ordered(tree, "d", "i", "j", value="d")


def barcode(tree: DataFrame) -> DataFrame:
    """(bar, birth, death): deaths in order, then one bar that never ends."""
    order = deaths(tree)
    finite = order.numbered("bar").select(F.col("bar").cast("int").alias("bar"), F.lit(0.0).alias("birth"), F.col("d").alias("death"))
    return finite.unionByName(tree.sparkSession.createDataFrame([(order.size + 1, 0.0, float("inf"))], "bar int, birth double, death double"))


def percentiles(order: Ordered, wanted: list[float]) -> dict[float, float]:
    """Percentiles of deaths by the midpoint rule (the k-th of n stands at 100 (k - 0.5) / n), from one order; 0 without deaths."""
    n = order.size
    places = {p: max(1.0, min(n * (p / 100) + 0.5, float(n))) for p in wanted}
    at = order.values_at("d", [k for h in places.values() for k in (int(h), min(int(h) + 1, n))]) if n else {}
    return {p: at[int(h)] + (h - int(h)) * (at[min(int(h) + 1, n)] - at[int(h)]) if n else 0.0 for p, h in places.items()}


def _one(tree: DataFrame, value: float) -> DataFrame:
    return tree.sparkSession.createDataFrame([(float(value),)], "threshold double")


def percentile_threshold(tree: DataFrame, percentile: float) -> DataFrame:
    """One row ``threshold``: the percentile of deaths."""
    return _one(tree, percentiles(deaths(tree), [percentile])[percentile])


def gap_threshold(tree: DataFrame) -> DataFrame:
    """One row ``threshold``: the lower end of the first largest gap between deaths; a single death is its own threshold; 0
    without deaths."""
    return _one(tree, deaths(tree).largest_gap("d") or 0.0)


def threshold(tree: DataFrame, config: TopologyConfig) -> DataFrame:
    return percentile_threshold(tree, config.percentile) if config.rule == "percentile" else gap_threshold(tree)


def raw_clusters(samples: DataFrame, tree: DataFrame, epsilon: DataFrame, small: int = SMALL) -> DataFrame:
    """(sample_idx, raw_cluster): components of distances up to the threshold, numbered by their smallest member.

    Tree edges connect what all edges up to the threshold connect. Up to ``small`` of them are labelled in one task; more
    are contracted, and clusters numbered by the order of their first members.
    """
    short = tree.join(F.broadcast(epsilon)).where(F.col("d") <= F.col("threshold")).select("i", "j")
    edges = short.unionByName(samples.select(F.col("sample_idx").alias("i"), F.col("sample_idx").alias("j")))
    if edges.limit(small + 1).count() <= small:
        return edges.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(_label, "sample_idx int, raw_cluster int")
    found = components(edges.select(F.col("i").alias("a"), F.col("j").alias("b")))
    least = found.groupBy("root").agg(F.min("node").alias("_first"), F.count("*").alias("k"))
    named = meet(found, table(numbered(least, "raw_cluster", "_first")), "root", found.count())
    return named.select(F.col("node").alias("sample_idx"), F.col("raw_cluster").cast("int").alias("raw_cluster"))


def _label(pdf: pd.DataFrame) -> pd.DataFrame:
    from .families import connect

    nodes, codes = np.unique(np.concatenate([pdf["i"].to_numpy(), pdf["j"].to_numpy()]), return_inverse=True)
    root = connect(codes[: len(pdf)], codes[len(pdf) :])
    return pd.DataFrame({"sample_idx": nodes, "raw_cluster": np.unique(root, return_inverse=True)[1] + 1})


def merge_events(tree: DataFrame) -> DataFrame:
    """(step, epsilon, left, right, merged): which groups each death joins."""

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: dict[int, list[int]] = {}
        out = []
        for step, row in enumerate(pdf.sort_values(["d", "i", "j"]).itertuples(), 1):
            a, b = groups.setdefault(row.i, [row.i]), groups.setdefault(row.j, [row.j])
            merged = sorted(a + b)
            out.append((step, row.d, sorted(a), sorted(b), merged))
            for x in merged:
                groups[x] = merged
        return pd.DataFrame(out, columns=["step", "epsilon", "left", "right", "merged"])

    return tree.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(trace, "step int, epsilon double, left array<int>, right array<int>, merged array<int>")
