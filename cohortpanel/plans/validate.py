"""Checks at the boundaries of stages; each raises ValueError with what is wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _none(df: DataFrame, condition, what: str) -> None:
    if df.where(condition).limit(1).count():
        raise ValueError(what)


def labels(df: DataFrame, column: str) -> DataFrame:
    """Positive and consecutive from 1."""
    found = df.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count_distinct(column).alias("n"), F.count_if(F.col(column).isNull()).alias("missing")).first()
    if found["missing"] or (found["n"] and (found["low"] != 1 or found["high"] != found["n"])):
        raise ValueError(f"{column} must be 1, 2, ... without gaps")
    return df


def vectors(df: DataFrame) -> DataFrame:
    """At least two samples, equal widths, distinct ids, finite features."""
    found = df.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_distinct(F.size("features")).alias("widths")).first()
    if found["n"] < 2:
        raise ValueError("at least two valid samples are needed")
    if found["ids"] != found["n"] or found["widths"] != 1:
        raise ValueError("ids must differ and vectors be of one width")
    return df


def history(df: DataFrame, by: list[str], most: int) -> DataFrame:
    """Steps 1, 2, ... up to ``most``, peptides distinct, coverage in [0, 1]."""
    cover = ["cumulative_patient_coverage", "cumulative_hla_coverage"]
    for c in cover:
        _none(df, (F.col(c) < -1e-9) | (F.col(c) > 1 + 1e-9), f"{c} must lie in [0, 1]")
    per = df.groupBy(*by).agg(F.count("*").alias("n"), F.max("step").alias("last"), F.count_distinct("step").alias("steps"), F.count_distinct("peptide").alias("peptides"))
    _none(per, (F.col("n") != F.col("last")) | (F.col("n") != F.col("steps")) | (F.col("n") != F.col("peptides")) | (F.col("n") > most), "steps must count up, peptides differ, panels keep to their limit")
    return df


def panel_input(rows: DataFrame) -> DataFrame:
    """Rows of samples, peptides and alleles to pick panels from: at least one, none of them blank."""
    if not rows.limit(1).count():
        raise ValueError("panels need at least one row of predictions")
    for c in ("file_name", "peptide", "mhc"):
        _none(rows, F.col(c).isNull() | (F.trim(c) == ""), f"{c} must not be blank")
    return rows


def picked_within(history: DataFrame, items: DataFrame, by: list[str]) -> DataFrame:
    """Panels pick among the peptides of their own group, and a family's number goes with one family in its group: ``items``
    (by, peptide) are those of the groups."""
    if history.select(*by, "peptide").join(items.select(*by, "peptide"), [*by, "peptide"], "left_anti").limit(1).count():
        raise ValueError("a panel holds a peptide that its group doesn't have")
    _none(history, F.col("family_id").isNull() | (F.col("family_id") < 1), "families must be numbered from 1")
    counted = history.groupBy(*by).agg(F.count_distinct("family_id").alias("n"), F.max("num_families_represented").alias("said"))
    _none(counted, "n <> said", "the number of families must be that of the picked peptides")
    return history


def audit(mapping: DataFrame, events: DataFrame) -> DataFrame:
    """At least a first and a last event, steps that count up from 1; practical groups consecutive, a row a sample."""
    found = events.agg(F.count("*").alias("n"), F.count_distinct("step").alias("steps"), F.max("step").alias("last"), F.min_by("stage", "step").alias("first"), F.max_by("stage", "step").alias("end")).first()
    if found["n"] < 2 or (found["first"], found["end"]) != ("initial", "final"):
        raise ValueError("an audit needs a first and a last event")
    if found["steps"] != found["n"] or found["last"] != found["n"]:
        raise ValueError("steps of an audit must count up from 1")
    if mapping.count() != mapping.select("sample_idx").distinct().count():
        raise ValueError("an audit's mapping needs one row a sample")
    return labels(mapping, "practical_group")


def union_identity(unions: DataFrame, picks: DataFrame) -> DataFrame:
    """The union of all modes holds the peptides that panels picked, and no other."""
    a, b = unions.where("mode = 'all'").select("peptide"), picks.select("peptide").distinct()
    if a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count():
        raise ValueError("the union differs from the panels' peptides")
    return unions
