"""Figures of each sample, from rows (file_name, identity, peptide, mhc, rank_el)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import FEATURES
from ..functions.lineage import cut
from ..functions.placing import numbered
from .families import peptide_families

#: Keeps ln(p + EPS) finite.
EPS = 2.0**-52
SAMPLE = "file_name"


def cells(rows: DataFrame) -> DataFrame:
    """(file_name, peptide, mhc, n, best, identity): rows, least rank and identity of each peptide and allele of a sample.

    All counts derive from it, so distinct ones need no expansion and a large sample is spread over its peptides.
    """
    return rows.groupBy(SAMPLE, "peptide", "mhc").agg(F.count("*").alias("n"), F.min("rank_el").alias("best"), F.max("identity").alias("identity"))


def per_peptide(cells: DataFrame) -> DataFrame:
    """(file_name, peptide, alleles, best, n, identity)"""
    return cells.groupBy(SAMPLE, "peptide").agg(F.count("mhc").alias("alleles"), F.min("best").alias("best"), F.sum("n").alias("n"), F.max("identity").alias("identity"))


def per_allele(cells: DataFrame) -> DataFrame:
    """(file_name, mhc, n)"""
    return cells.groupBy(SAMPLE, "mhc").agg(F.sum("n").alias("n"))


def _basic(peptides: DataFrame, alleles: DataFrame) -> DataFrame:
    counts = peptides.groupBy(SAMPLE).agg(F.max("identity").alias("identity"), F.sum("n").alias("num_rows"), F.count("peptide").alias("num_unique_peptides"))
    counts = counts.join(alleles.groupBy(SAMPLE).agg(F.count("mhc").alias("num_unique_HLAs_hit")), SAMPLE)
    return counts.withColumn("rows_per_unique_peptide", F.col("num_rows") / F.greatest(F.col("num_unique_peptides"), F.lit(1)))


def basic_counts(rows: DataFrame) -> DataFrame:
    """Rows (those without rank too), distinct peptides and alleles, and rows for each peptide."""
    found = cells(rows)
    return _basic(per_peptide(found), per_allele(found))


#: Ranks in a bucket of the search for the median are less than one part of this apart.
BUCKETS = 64


def medians(rows: DataFrame) -> DataFrame:
    """(file_name, median_rank): exact. Ranks are counted in buckets, and only those of the bucket or two that hold the
    middle are sorted, so a large sample isn't sorted in one task."""
    bucket = F.when(F.isnan("rank_el"), F.lit((1 << 63) - 1)).otherwise(F.floor(F.col("rank_el") * BUCKETS))
    ranks = rows.where("rank_el IS NOT NULL").select(SAMPLE, "rank_el", bucket.alias("_bucket"))
    counts = ranks.groupBy(SAMPLE, "_bucket").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(SAMPLE)
    counts = counts.withColumn("_upto", F.sum("_n").over(whole.orderBy("_bucket"))).withColumn("_all", F.sum("_n").over(whole))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor((F.col("_all") + 2) / 2)
    middle = counts.where((F.col("_upto") >= low) & (F.col("_upto") - F.col("_n") < high)).select(SAMPLE, "_bucket", low.alias("_low"), high.alias("_high"), (F.col("_upto") - F.col("_n")).alias("_before"))
    inside = ranks.join(middle, [SAMPLE, "_bucket"])
    inside = inside.withColumn("_place", F.min("_before").over(whole) + F.row_number().over(whole.orderBy("rank_el")))
    return inside.where((F.col("_place") >= F.col("_low")) & (F.col("_place") <= F.col("_high"))).groupBy(SAMPLE).agg(F.avg("rank_el").alias("median_rank"))


def rank_stats(rows: DataFrame) -> DataFrame:
    """Least, mean and exact median rank and the sample deviation, 0 for one rank; null without ranks."""
    deviation = F.when(F.count("rank_el") > 0, F.coalesce(F.stddev_samp("rank_el"), F.lit(0.0)))
    plain = rows.groupBy(SAMPLE).agg(F.min("rank_el").alias("best_rank"), F.avg("rank_el").alias("mean_rank"), deviation.alias("rank_std"))
    return plain.join(medians(rows), SAMPLE, "left").select(SAMPLE, "best_rank", "mean_rank", "median_rank", "rank_std")


def top_ranks(rows: DataFrame) -> DataFrame:
    """Means of the three and five least ranks, of fewer where there are fewer."""
    order = Window.partitionBy(SAMPLE).orderBy("rank_el")
    least = rows.where("rank_el is not null").select(SAMPLE, "rank_el").withColumn("n", F.row_number().over(order)).where("n <= 5")
    return least.groupBy(SAMPLE).agg(F.avg(F.when(F.col("n") <= 3, F.col("rank_el"))).alias("mean_top3_rank"), F.avg("rank_el").alias("mean_top5_rank"))


def _promiscuity(peptides: DataFrame) -> DataFrame:
    return peptides.groupBy(SAMPLE).agg(
        F.avg("alleles").alias("peptide_promiscuity_mean"), F.max("alleles").alias("peptide_promiscuity_max"), F.avg(F.length("peptide")).alias("mean_peptide_length"), F.avg("best").alias("mean_best_rank_per_peptide")
    )


def promiscuity(rows: DataFrame) -> DataFrame:
    """Alleles hit by each peptide (mean and maximum), mean length of the distinct peptides, mean of their best ranks."""
    return _promiscuity(per_peptide(cells(rows)))


def _entropy(alleles: DataFrame) -> DataFrame:
    share = F.col("n") / F.sum("n").over(Window.partitionBy(SAMPLE))
    return alleles.withColumn("p", share).groupBy(SAMPLE).agg((-F.sum(F.col("p") * F.ln(F.col("p") + EPS))).alias("hla_entropy"))


def entropy(rows: DataFrame) -> DataFrame:
    """Entropy of the rows over alleles, in nats."""
    return _entropy(rows.groupBy(SAMPLE, "mhc").agg(F.count("*").alias("n")))


def _family_stats(peptides: DataFrame, k: int) -> DataFrame:
    families = peptide_families(peptides, k, SAMPLE).join(peptides.select(SAMPLE, "peptide", "best"), [SAMPLE, "peptide"])
    sizes = families.groupBy(SAMPLE, "family").agg(F.count("*").alias("size"), F.min("best").alias("best"))
    shared = F.coalesce(F.sum(F.when(F.col("size") > 1, F.col("size"))), F.lit(0)) / F.sum("size")
    return sizes.groupBy(SAMPLE).agg(
        F.count("*").alias("num_peptide_families"), F.max("size").alias("largest_peptide_family_size"), shared.alias("frac_peptides_in_family_size_gt_1"), F.avg("best").alias("mean_best_rank_per_family")
    )


def family_stats(rows: DataFrame, k: int = 7) -> DataFrame:
    """Number of families, size of the largest, share of peptides in families of two or more, mean of families' best ranks."""
    return _family_stats(per_peptide(cells(rows)), k)


def sample_features(rows: DataFrame, k: int = 7) -> DataFrame:
    """A row for each sample with all figures. Rows are read once and kept, and counted once; all else derives from that."""
    kept = cut(rows.select(SAMPLE, "identity", "peptide", "mhc", "rank_el"))
    found = cut(cells(kept))
    peptides, alleles = cut(per_peptide(found)), per_allele(found)
    parts = [_basic(peptides, alleles), rank_stats(kept), top_ranks(kept), _promiscuity(peptides), _entropy(alleles), _family_stats(peptides, k)]
    return reduce(lambda a, b: a.join(b, SAMPLE, "left"), parts)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def feature_vectors(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sample_idx, id, features) in file order for samples whose thirteen features are finite, and the names of the others."""
    doubles = F.array(*[F.col(c).cast("double") for c in FEATURES])
    whole = F.forall(doubles, lambda x: finite(x))
    order = [c for c in ("file_ordinal",) if c in features.columns] + [SAMPLE]
    good = numbered(features.where(whole), "sample_idx", *order)
    return good.select(F.col("sample_idx").cast("int").alias("sample_idx"), F.col(SAMPLE).alias("id"), doubles.alias("features")), features.where(~whole).select(SAMPLE, F.lit("a feature is not finite").alias("reason"))
