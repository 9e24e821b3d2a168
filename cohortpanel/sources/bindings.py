"""Prediction tables, one CSV a sample, read together; rows keep their place."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import allele_name, file_key, number, trimmed
from ..functions.placing import numbered
from .ragged_csv import read_records

REQUIRED = ("Identity", "Peptide", "MHC", "%Rank_EL")
#: File names that begin so are results, not samples.
EXCLUDED = ("group_",)
SCHEMA = "file_name string, file_ordinal int, row_ordinal long, identity string, peptide string, mhc string, rank_el double"


@dataclass
class Bindings:
    """``rows``: rows of valid samples (SCHEMA); ``skipped``: (file_name, reason)."""

    rows: DataFrame
    skipped: DataFrame


def list_samples(spark: SparkSession, folder: str, excluded: tuple[str, ...] = EXCLUDED, limit: int | None = None) -> DataFrame:
    """(path, file_name, file_ordinal) of the CSV files in name order; an error if there are none. Reads no content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path")
    files = files.withColumn("file_name", F.regexp_extract("path", r"([^/]*)$", 1))
    for prefix in excluded:
        files = files.where(~F.col("file_name").startswith(prefix))
    files = numbered(files, "file_ordinal", "file_name").withColumn("file_ordinal", F.col("file_ordinal").cast("int"))
    files = files.where(F.col("file_ordinal") <= limit) if limit else files
    if files.limit(1).count() == 0:
        raise FileNotFoundError(f"no sample files in {folder}")
    return files


def read_rows(spark: SparkSession, folder: str, excluded: tuple[str, ...] = EXCLUDED, required: tuple[str, ...] = REQUIRED, limit: int | None = None) -> DataFrame:
    """Raw rows of all sample files: file_name, file_ordinal, row_ordinal, header (the file's own), problem, and the required
    columns as text. Each file has one row more, without row_ordinal, for its header or what is wrong with it."""
    files = list_samples(spark, folder, excluded, limit)
    rows = read_records(spark, folder, files).join(files.drop("path"), "file_name")
    wanted = [F.get("cells", (F.array_position("header", c) - 1).cast("int")).alias(c) for c in required]
    return rows.select("file_name", "file_ordinal", "row_ordinal", "header", "problem", *wanted)


def read_bindings(spark: SparkSession, folder: str, typing: DataFrame | None = None, excluded: tuple[str, ...] = EXCLUDED, limit: int | None = None) -> Bindings:
    """Valid samples' rows, and why others are skipped: a file that is no CSV, a missing column, no rows, a blank allele or peptide, several
    identities, no numeric rank, or, where ``typing`` (file_key, file_stem, alleles) is given, no typed allele among the rows."""
    raw = read_rows(spark, folder, excluded, REQUIRED, limit)
    missing = F.array_except(F.array(*[F.lit(c) for c in REQUIRED]), "header")
    rows = raw.select(
        "file_name", "file_ordinal", "row_ordinal", "problem", missing.alias("_missing"), trimmed(F.col("Identity")).alias("identity"), F.col("Peptide").alias("peptide"),
        allele_name(F.col("MHC")).alias("mhc"), number(F.col("`%Rank_EL`")).alias("rank_el"),
    )
    rows = keep_typed(rows, typing) if typing is not None else rows.withColumn("_typed", F.lit(True))
    return validated(rows)


def keep_typed(rows: DataFrame, typing: DataFrame) -> DataFrame:
    """Mark rows whose allele is typed for their sample: by full file name first, by stem otherwise; no typed alleles, no filter."""
    names = rows.select("file_name").distinct().withColumns({"_key": file_key(F.col("file_name")), "_stem": file_key(F.col("file_name"), True)})
    full = typing.select(F.col("file_key").alias("_key"), F.col("alleles").alias("_full")).dropDuplicates(["_key"])
    stem = typing.select(F.col("file_stem").alias("_stem"), F.col("alleles").alias("_by_stem")).dropDuplicates(["_stem"])
    found = names.join(full, "_key", "left").join(stem, "_stem", "left").select("file_name", F.coalesce("_full", "_by_stem").alias("_alleles"), (F.col("_full").isNull() & F.col("_by_stem").isNull()).alias("_untyped"))
    typed = (F.size("_alleles") == 0) | F.array_contains("_alleles", F.col("mhc"))
    return rows.join(found, "file_name").withColumn("_typed", F.when(F.col("_untyped"), F.lit(None)).otherwise(typed)).drop("_alleles", "_untyped")


def validated(rows: DataFrame) -> Bindings:
    kept = F.col("_typed") & F.col("row_ordinal").isNotNull()
    facts = rows.groupBy("file_name").agg(
        F.max("problem").alias("problem"), F.max(F.size("_missing")).alias("missing"), F.max(F.array_join("_missing", ", ")).alias("names"), F.count("row_ordinal").alias("n"), F.count_if(kept).alias("kept"), F.max(F.col("_typed").isNull().cast("int")).alias("untyped"),
        F.count_if(kept & (F.col("mhc") == "")).alias("blank"), F.count_if(kept & (F.coalesce(trimmed(F.col("peptide")), F.lit("")) == "")).alias("no_peptide"),
        F.count_distinct(F.when(kept, F.col("identity"))).alias("ids"), F.count_if(kept & F.col("rank_el").isNotNull()).alias("ranks"),
    )
    reason = (
        F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("missing") > 0, F.concat(F.lit("missing column: "), F.col("names"))).when(F.col("n") == 0, "no rows").when(F.col("untyped") == 1, "no typing")
        .when(F.col("blank") > 0, "blank MHC").when(F.col("kept") == 0, "no rows remain after the allele filter").when(F.col("no_peptide") > 0, "blank peptide")
        .when(F.col("ids") != 1, "not exactly one identity").when(F.col("ranks") == 0, "no numeric rank")
    )
    judged = facts.select("file_name", reason.alias("reason"))
    good = judged.where("reason is null").select("file_name")
    valid = rows.where(kept).join(good, "file_name", "left_semi").select("file_name", "file_ordinal", "row_ordinal", "identity", "peptide", "mhc", "rank_el")
    return Bindings(valid, judged.where("reason is not null"))


def first_column(df: DataFrame, candidates: list[str]) -> str | None:
    """The first of ``candidates`` that the table has."""
    return next((c for c in candidates if c in df.columns), None)


def require_columns(df: DataFrame, names: list[str]) -> None:
    absent = [c for c in names if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")


def feature_rows(df: DataFrame, order: str) -> DataFrame:
    """Rows (sample_idx, id, features) of a direct feature matrix; ids default to case_1, case_2, ..."""
    indexed = numbered(df, "sample_idx", order).withColumn("sample_idx", F.col("sample_idx").cast("int"))
    name = F.col("id").cast(T.StringType()) if "id" in df.columns else F.concat(F.lit("case_"), F.col("sample_idx"))
    return indexed.select("sample_idx", name.alias("id"), F.transform("features", lambda x: x.cast("double")).alias("features"))
