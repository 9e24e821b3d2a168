"""Panels of the whole cohort, of raw clusters and of practical groups in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import PanelConfig, PopulationConfig
from ..operators.panel import binders, cells, greedy_panels
from ..operators.population import group_mixtures
from ..sources.bindings import first_column

MODES = {
    "global": ("all", "main", "global_honest_practical", "global", "robustness"),
    "honest": ("all", "main", "global_honest_practical", "honest"),
    "practical": ("all", "main", "global_honest_practical", "practical", "robustness"),
}
KEY = ["mode", "group", "label"]


#: Columns that raw labels are taken from, the first that is there; practical ones fall back on those.
RAW_LABELS = ("raw_cluster", "group_label", "cluster")


def assignments(samples: DataFrame, run_mode: str = "all", min_group_size: int = 1) -> DataFrame:
    """(mode, group, label, file_name, did_run, skip_reason) from (file_name, raw_cluster, practical_group).

    Raw labels may be named otherwise (RAW_LABELS); without practical groups the raw ones stand for them. Practical groups
    below the minimum size are listed, not run."""
    raw = first_column(samples, RAW_LABELS)
    if raw is None:
        raise ValueError(f"samples need one of {', '.join(RAW_LABELS)}")
    samples = samples.withColumn("raw_cluster", F.col(raw))
    samples = samples if "practical_group" in samples.columns else samples.withColumn("practical_group", F.col("raw_cluster"))
    if run_mode not in {m for names in MODES.values() for m in names}:
        raise ValueError(f"unknown run mode {run_mode!r}")
    parts = []
    for mode, group, label in (("global", F.lit(0), F.lit("Global cohort")), ("honest", F.col("raw_cluster"), F.concat(F.lit("Honest raw Group "), "raw_cluster")), ("practical", F.col("practical_group"), F.concat(F.lit("Practical Group "), "practical_group"))):
        if run_mode in MODES[mode]:
            parts.append(samples.select(F.lit(mode).alias("mode"), group.cast("int").alias("group"), label.alias("label"), "file_name"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    size = F.count("*").over(Window.partitionBy("mode", "group"))
    small = (F.col("mode") == "practical") & (size < min_group_size)
    return out.withColumn("did_run", ~small).withColumn("skip_reason", F.when(small, F.concat(F.lit("group below the minimum size of "), F.lit(min_group_size))))


def run_suite(rows: DataFrame, assigned: DataFrame, config: PanelConfig) -> DataFrame:
    """(mode, group, label, HISTORY): all panels; binder rows are read once, and their cells joined with the groups of
    the files."""
    chosen = assigned.where("did_run").select(*KEY, "file_name")
    return greedy_panels(cells(binders(rows, config.rank_threshold)).join(chosen, "file_name"), config, KEY)


def reference_metrics(rows: DataFrame, assigned: DataFrame, history: DataFrame, reference: DataFrame, panel: PanelConfig = PanelConfig(), config: PopulationConfig = PopulationConfig()) -> DataFrame:
    """Population figures of the panels: (mode, group, label, num_files, num_selected_peptides, and those of
    ``group_mixtures``), for each group whose selected peptides hit an allele in its own binder rows."""
    chosen = assigned.where("did_run").select(*KEY, "file_name")
    picked = history.select(*KEY, "peptide").distinct()
    pairs = binders(rows, panel.rank_threshold).select("file_name", "peptide", "mhc").distinct().join(chosen, "file_name").join(picked, [*KEY, "peptide"], "left_semi").select(*KEY, "peptide", "mhc").distinct()
    found = group_mixtures(pairs, reference, KEY, config)
    return all_results(assigned, history).drop("did_run").join(found, KEY)


def selected_by_group(history: DataFrame) -> DataFrame:
    return history.select(*KEY, "step", "peptide")


def unions(history: DataFrame) -> DataFrame:
    """(mode, ordinal, peptide): distinct peptides of each mode, and of all (mode ``all``), in order of mode, group and step."""
    rank = F.when(F.col("mode") == "global", 0).when(F.col("mode") == "honest", 1).otherwise(2)
    both = history.withColumn("_r", rank)
    both = both.select("mode", "_r", "group", "step", "peptide").unionByName(both.select(F.lit("all").alias("mode"), "_r", "group", "step", "peptide"))
    first = both.groupBy("mode", "peptide").agg(F.min(F.struct("_r", "group", "step")).alias("_first"))
    return first.select("mode", F.row_number().over(Window.partitionBy("mode").orderBy("_first", "peptide")).alias("ordinal"), "peptide")


def all_results(assigned: DataFrame, history: DataFrame) -> DataFrame:
    """(mode, group, label, num_files, num_selected_peptides, did_run)"""
    files = assigned.groupBy(*KEY).agg(F.count_distinct("file_name").alias("num_files"), F.max("did_run").alias("did_run"))
    picks = history.groupBy(*KEY).agg(F.count("*").alias("n"))
    return files.join(picks, KEY, "left").select(*KEY, "num_files", F.coalesce("n", F.lit(0)).alias("num_selected_peptides"), "did_run")


def summary(assigned: DataFrame, history: DataFrame) -> DataFrame:
    """One row: groups of each kind and peptides of each union."""
    groups = assigned.agg(F.count_distinct(F.when(F.col("mode") == "honest", F.col("group"))).alias("num_honest_groups"), F.count_distinct(F.when(F.col("mode") == "practical", F.col("group"))).alias("num_practical_groups"))
    one = lambda m: F.count_distinct(F.when(F.col("mode") == m, F.col("peptide"))).alias(f"num_{m}_peptides")
    return groups.join(history.agg(one("global"), one("honest"), one("practical"), F.count_distinct("peptide").alias("num_union_peptides")))
