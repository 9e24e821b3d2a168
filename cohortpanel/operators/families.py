"""Families of peptides: connected components of "share a run of k characters"."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.components import components, meet
from ..functions.lineage import table
from ..functions.normalize import kmers


def peptide_kmers(peptides: DataFrame, k: int) -> DataFrame:
    """(..., peptide, kmer): a row for each distinct window of each peptide."""
    return peptides.withColumn("kmer", F.explode(kmers(F.col("peptide"), k)))


def overlap_pairs(peptides: DataFrame, k: int) -> DataFrame:
    """(a, b), a < b: pairs of distinct peptides that share a window, by an equi-join on windows."""
    grams = peptide_kmers(peptides.select("peptide").distinct(), k)
    left, right = grams.select(F.col("peptide").alias("a"), "kmer"), grams.select(F.col("peptide").alias("b"), "kmer")
    return left.join(right, "kmer").where("a < b").select("a", "b").distinct()


def star_edges(peptides: DataFrame, k: int, within: str) -> DataFrame:
    """(within, a, b): each peptide with the least peptide of each of its windows; linear in the windows, where all pairs
    of a window would be quadratic. Peptides without any partner are joined with themselves."""
    grams = peptide_kmers(peptides.select(within, "peptide").distinct(), k)
    least = F.min("peptide").over(Window.partitionBy(within, "kmer"))
    edges = grams.select(within, F.col("peptide").alias("a"), least.alias("b")).distinct()
    return edges.unionByName(peptides.select(within, F.col("peptide").alias("a"), F.col("peptide").alias("b"))).distinct()


def connect(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component of each node 0..n-1 of edges (a, b), as its smallest node."""
    parent = list(range(int(max(a.max(initial=-1), b.max(initial=-1))) + 1))
    for x, y in zip(a.tolist(), b.tolist()):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
    for x in range(len(parent)):
        parent[x] = parent[parent[x]]
    return np.array(parent, dtype=np.int64)


#: Distinct peptides of a sample whose families one task finds; those of larger samples are contracted by many.
SMALL = 200_000


def peptide_families(peptides: DataFrame, k: int, within: str = "file_name", small: int = SMALL) -> DataFrame:
    """(within, peptide, family): the least peptide of its family names it. Short peptides are families of their own.

    The windows are joined by Spark. A task holds the star edges of one sample, at most one a window of a distinct peptide,
    if the sample has ``small`` distinct peptides or fewer; the families of a larger one are components of the whole graph.
    """
    return _families(table(peptides.select(within, "peptide").distinct()), k, within, small)


def _families(peptides: DataFrame, k: int, within: str, small: int) -> DataFrame:
    """The same of distinct peptides, however many rows hold them."""
    large = peptides.groupBy(within).agg(F.count("*").alias("n")).where(F.col("n") > small).select(within)
    if large.limit(1).count():
        large = F.broadcast(table(large))  # fewer than one in ``small`` of all peptides
        node = lambda c: F.struct(F.col(within), F.col(c).alias("peptide"))
        found = components(star_edges(peptides.join(large, within, "left_semi"), k, within).select(node("a").alias("a"), node("b").alias("b")))
        least = found.groupBy("root").agg(F.min("node.peptide").alias("family"), F.count("*").alias("k"))
        named = meet(found, least, "root", found.count()).select(F.col(f"node.{within}").alias(within), "node.peptide", "family")
        return named.unionByName(_families(peptides.join(large, within, "left_anti"), k, within, small))

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        names, codes = np.unique(np.concatenate([pdf["a"].to_numpy(dtype=object), pdf["b"].to_numpy(dtype=object)]), return_inverse=True)
        root = connect(codes[: len(pdf)], codes[len(pdf) :])
        return pd.DataFrame({within: pdf[within].iloc[0], "peptide": names, "family": names[root]})

    return star_edges(peptides, k, within).groupBy(within).applyInPandas(label, f"{within} string, peptide string, family string")
