"""Allele typing tables without header: a file name and six alleles a row."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.normalize import allele_name, file_key

COLUMNS = ("FileName", "HLA1", "HLA2", "HLA3", "HLA4", "HLA5", "HLA6")


def read_typing(spark: SparkSession, path: str) -> DataFrame:
    """(file_key, file_stem, alleles): alleles normalised, blanks and repeats dropped; a file's first row counts."""
    if path.lower().endswith((".xlsx", ".xls")):
        folder, name = os.path.split(path)
        if os.path.exists(os.path.join(folder, f"~${name}")):
            raise RuntimeError(f"{name} is open in another program")
        raw = spark.createDataFrame(pd.read_excel(path, header=None, dtype=str).astype(object).where(lambda x: x.notna(), None))
    else:
        raw = spark.read.option("header", False).csv(path)
    if len(raw.columns) < len(COLUMNS):
        raise ValueError(f"a typing table needs {len(COLUMNS)} columns")
    return typing_lookup(raw.select(*[F.col(c).alias(n) for c, n in zip(raw.columns, COLUMNS)]).withColumn("_at", F.monotonically_increasing_id()), "_at")


def typing_lookup(table: DataFrame, order: str) -> DataFrame:
    alleles = F.array_distinct(F.filter(F.array(*[allele_name(F.col(c)) for c in COLUMNS[1:]]), lambda x: x != ""))
    keyed = table.select(file_key(F.col("FileName")).alias("file_key"), file_key(F.col("FileName"), True).alias("file_stem"), alleles.alias("alleles"), F.col(order).alias("_order")).where("file_key != ''")
    first = F.row_number().over(Window.partitionBy("file_key").orderBy("_order"))
    return keyed.withColumn("_n", first).where("_n = 1").drop("_n", "_order")
