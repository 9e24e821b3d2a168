"""Sample figures over arriving rows: an extension for cohorts that grow while they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import allele_name, number

INPUT = "file_name string, identity string, peptide string, mhc string, rank_el string, arrived timestamp"


def rows_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of Parquet rows (INPUT) that are put into ``folder``."""
    raw = spark.readStream.schema(INPUT).parquet(folder)
    return raw.withColumns({"mhc": allele_name(F.col("mhc")), "rank_el": number(F.col("rank_el"))})


def running_counts(rows: DataFrame, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Rows, ranks, least and mean rank and about how many peptides and alleles, by sample and window; rows later than
    ``delay`` are left out, so the state stays bounded."""
    return rows.withWatermark("arrived", delay).groupBy(F.window("arrived", window), "file_name").agg(
        F.count("*").alias("num_rows"), F.count("rank_el").alias("num_ranks"), F.min("rank_el").alias("best_rank"), F.avg("rank_el").alias("mean_rank"),
        F.approx_count_distinct("peptide").alias("approx_unique_peptides"), F.approx_count_distinct("mhc").alias("approx_unique_hlas"),
    )
