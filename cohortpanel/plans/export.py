"""Results as files, context columns and reports."""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FEATURE_WEIGHTS, PanelConfig, PopulationConfig
from ..operators.metrics import moments
from ..operators.panel import binders, peptide_scores

log = logging.getLogger("cohortpanel")

#: Tables of a full export, by file name.
TABLES = (
    "run_info", "parsed_feature_summary", "skipped_files", "tda_raw_clusters", "tda_practical_groups", "tda_barcode", "tda_summary", "optimization_selected_peptides",
    "optimization_selection_history", "optimization_peptide_features", "optimization_reference_metrics", "robustness_summary",
)


def flat(df: DataFrame) -> DataFrame:
    """Arrays as texts, which CSV can hold."""
    return df.select(*[F.array_join(F.col(c).cast("array<string>"), ";").alias(c) if kind.startswith("array<") else F.col(c) for c, kind in df.dtypes])


def export(tables: dict[str, DataFrame], folder: str, kind: str = "csv") -> dict[str, str]:
    """Write each known table below ``folder``; a failure is logged and the rest goes on. Returns names and paths written."""
    written = {}
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(f"unknown export table {name!r}")
        path = f"{folder}/{name}"
        try:
            out = flat(df) if kind == "csv" else df
            out.write.mode("overwrite").option("header", True).format(kind).save(path)
            written[name] = path
        except Exception as error:  # noqa: BLE001  one table's failure must not cost the others
            log.warning("could not write %s: %s", path, error)
    return written


def tables_of(analysis, panel: PanelConfig = PanelConfig(), skipped: DataFrame | None = None, reference: DataFrame | None = None, population: PopulationConfig = PopulationConfig(), robustness: DataFrame | None = None, info: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The tables of a full export of a ``workflow.Analysis``; those whose input is not given are left out."""
    from . import suite

    spark, groups = analysis.rows.sparkSession, analysis.topology
    context = lambda df: with_context(df, analysis.assigned)
    bound = binders(analysis.rows, panel.rank_threshold).join(analysis.assigned.where("did_run").select(*suite.KEY, "file_name"), "file_name")
    config = groups.config
    described = {"threshold_rule": config.rule, "chosen_percentile": config.percentile, "distance_metric": config.metric, "weights": " ".join(map(str, config.weights or FEATURE_WEIGHTS.values()))}
    failed = analysis.not_finite.select(F.col("file_name"), "reason")
    tables = {
        "run_info": spark.createDataFrame([{"program": "cohortpanel", **(info or {})}]).withColumn("exported_at", F.current_timestamp()),
        "parsed_feature_summary": analysis.features,
        "skipped_files": failed if skipped is None else skipped.select("file_name", "reason").unionByName(failed),
        "tda_raw_clusters": analysis.samples.select("file_name", "raw_cluster"),
        "tda_practical_groups": analysis.samples,
        "tda_barcode": groups.barcode(),
        "tda_summary": groups.threshold.withColumns({k: F.lit(v) for k, v in described.items()}),
        "optimization_selected_peptides": context(suite.selected_by_group(analysis.history)),
        "optimization_selection_history": context(analysis.history),
        "optimization_peptide_features": context(peptide_scores(bound, panel.rank_threshold, suite.KEY)),
    }
    if reference is not None:
        tables["optimization_reference_metrics"] = suite.reference_metrics(analysis.rows, analysis.assigned, analysis.history, reference, panel, population)
    if robustness is not None:
        tables["robustness_summary"] = robustness
    return tables


def with_context(df: DataFrame, assigned: DataFrame) -> DataFrame:
    """Rows keyed by mode, group and label with the names of the files of their group, joined by semicolons."""
    files = assigned.groupBy("mode", "group", "label").agg(F.array_join(F.sort_array(F.collect_set("file_name")), ";").alias("input_files"))
    return df.join(files, ["mode", "group", "label"], "left")


def union_with_blanks(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both, by column name; what one lacks is an empty text."""
    names = [*a.columns, *[c for c in b.columns if c not in a.columns]]
    texts = lambda df: df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in names])
    return texts(a).unionByName(texts(b))


def principal_components(weighted: DataFrame, k: int = 2) -> DataFrame:
    """(sample_idx, pc1..pck) of weighted vectors, centred. The scatter matrix is summed in tasks, so the driver holds one of
    the vectors' width alone; of a component's loadings the one of the largest size is positive."""

    found = moments(weighted)
    if found is None:
        return weighted.select("sample_idx", *[F.lit(0.0).alias(f"pc{i + 1}") for i in range(k)])
    _, mean, scatter = found
    loadings = np.linalg.eigh(scatter)[1][:, ::-1][:, :k].T
    loadings *= np.sign(loadings[np.arange(len(loadings)), np.abs(loadings).argmax(axis=1)])[:, None]
    array = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    score = lambda load: F.aggregate(F.zip_with(F.zip_with("v", array(mean), lambda x, m: x - m), array(load), lambda x, w: x * w), F.lit(0.0), lambda t, x: t + x)
    none = [F.lit(0.0)] * max(0, k - len(loadings))
    return weighted.select("sample_idx", *[c.alias(f"pc{i + 1}") for i, c in enumerate([*map(score, loadings), *none])])


def report(df: DataFrame, rows: int = 50) -> str:
    """A plain table of the first rows, numbers to six significant digits."""
    head = df.limit(rows).collect()
    text = lambda v: f"{v:.6g}" if isinstance(v, float) else ", ".join(map(str, v)) if isinstance(v, list) else "" if v is None else str(v)
    cells = [df.columns] + [[text(v) for v in r] for r in head]
    widths = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in cells)
