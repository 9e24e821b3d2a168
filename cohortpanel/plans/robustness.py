"""How far results change when settings do: a grid of runs compared with the baseline.

All runs share one spanning tree, one set of raw clusters for each percentile and one set of binders for each threshold.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PANEL_WEIGHTS, PanelConfig, TopologyConfig
from ..functions.lineage import cut
from ..functions.text import clip, normalised, weight_label

MODES = {0: "none", 1: "fast", 2: "standard", 3: "full"}
#: Fixed values: (weight raised, by how much, weights lowered by equal parts), the first three for standard runs.
SHIFTS = (
    ("patient", 0.08, ("binding", "redundancy")),
    ("hla", 0.08, ("novelty", "redundancy")),
    ("novelty", 0.06, ("redundancy",)),
    ("binding", 0.10, ("patient", "prevalence")),
    ("prevalence", 0.10, ("novelty", "redundancy")),
    ("redundancy", 0.10, ("patient", "novelty")),
)
SAME = 1e-12


@dataclass(frozen=True)
class Run:
    run_id: int
    label: str
    percentile: float
    rank_threshold: float
    max_peptides: int
    weights: tuple[float, ...]


def parse_mode(mode: int | str) -> str:
    """A mode's name from its number or name."""
    name = MODES.get(int(mode)) if str(mode).isdigit() else str(mode).strip().lower()
    if name not in MODES.values():
        raise ValueError(f"unknown robustness mode {mode!r}")
    return name


def weight_sets(base: dict[str, float], level: str) -> list[tuple[float, ...]]:
    """The base as it is, then shifted sets that sum to 1; equal ones once."""
    sets = [tuple(base[n] for n in PANEL_WEIGHTS)]
    for raised, by, lowered in SHIFTS[: 3 if level == "partial" else None]:
        shifted = dict(base)
        shifted[raised] += by
        for name in lowered:
            shifted[name] = max(0.0, shifted[name] - by / len(lowered))
        new = normalised([shifted[n] for n in PANEL_WEIGHTS])
        if all(max(abs(a - b) for a, b in zip(new, old)) >= SAME for old in sets):
            sets.append(new)
    return sets


def grid(mode: int | str, topology: TopologyConfig = TopologyConfig(), panel: PanelConfig = PanelConfig()) -> list[Run]:
    """Baseline first, then the runs of the mode, none equal to the baseline."""
    mode = parse_mode(mode)
    pct, thr, most, base = topology.percentile, panel.rank_threshold, panel.max_peptides, tuple(panel.weights[n] for n in PANEL_WEIGHTS)
    runs = [("baseline", pct, thr, most, base)]
    percents = sorted({clip(pct + x, 1, 99) for x in (-10, 0, 10)})
    if mode in ("fast", "standard"):
        runs += [(f"percentile {p:.2f}", p, thr, most, base) for p in percents if p != pct]
    if mode == "standard":
        runs += [(f"EL rank {t:.2f}", pct, t, most, base) for t in sorted({clip(thr + x, 0.1, 100) for x in (-7.7, 0, 7.3)}) if t != thr]
        runs += [(f"max peptides {m}", pct, thr, m, base) for m in sorted({max(1, most + x) for x in (-2, 0, 2)}) if m != most]
        runs += [(f"weights {weight_label(w)}", pct, thr, most, w) for w in weight_sets(panel.weights, "partial")[1:]]
    if mode == "full":
        options = product(percents, sorted({thr, 40.0}), sorted({most, most + 2}), weight_sets(panel.weights, "full"))
        runs += [("full cartesian", *o) for o in options if o != (pct, thr, most, base)]
    return [Run(k, *r) for k, r in enumerate(runs)]


def grid_table(spark: SparkSession, runs: list[Run]) -> DataFrame:
    rows = [(r.run_id, r.label, float(r.percentile), float(r.rank_threshold), int(r.max_peptides), [float(w) for w in r.weights], weight_label(r.weights)) for r in runs]
    return spark.createDataFrame(rows, "run_id int, label string, percentile double, rank_threshold double, max_peptides int, weights array<double>, weight_label string")


def estimate_seconds(mode: int | str, grouping_seconds: float, panel_seconds: float) -> float:
    return len(grid(mode)) * (grouping_seconds + panel_seconds)


def jaccard(a, b):
    """Of two arrays as sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def agreement(labels: DataFrame) -> DataFrame:
    """(run_id, num_groups, group_sizes, same_num_groups, assignment_exact_match, assignment_agreement) from (run_id,
    sample_idx, label): label numbers are compared sample by sample with run 0."""
    base = labels.where("run_id = 0").select("sample_idx", F.col("label").alias("base"))
    per = labels.join(base, "sample_idx").groupBy("run_id").agg(F.avg((F.col("label") == F.col("base")).cast("double")).alias("assignment_agreement"))
    sizes = labels.groupBy("run_id", "label").agg(F.count("*").alias("n")).groupBy("run_id").agg(F.count("*").alias("num_groups"), F.sort_array(F.collect_list("n"), False).alias("group_sizes"))
    first = sizes.where("run_id = 0").select(F.col("num_groups").alias("_base"))
    return per.join(sizes, "run_id").join(first).select("run_id", "num_groups", "group_sizes", (F.col("num_groups") == F.col("_base")).alias("same_num_groups"), (F.col("assignment_agreement") == 1).alias("assignment_exact_match"), "assignment_agreement")


def panel_agreement(panels: DataFrame) -> DataFrame:
    """(run_id, num_selected_peptides, peptide_jaccard, peptide_set_exact_match) from (run_id, peptides)."""
    base = panels.where("run_id = 0").select(F.col("peptides").alias("_base"))
    exact = F.sort_array("peptides") == F.sort_array("_base")
    return panels.join(base).select("run_id", F.size("peptides").alias("num_selected_peptides"), jaccard(F.col("peptides"), F.col("_base")).alias("peptide_jaccard"), exact.alias("peptide_set_exact_match"))


def stability(runs: DataFrame, labels: DataFrame, panels: DataFrame) -> DataFrame:
    """The summary of all runs; a run is stable with as many groups and a Jaccard similarity of at least 0.8."""
    out = runs.join(agreement(labels), "run_id").join(panel_agreement(panels), "run_id")
    return out.withColumn("stable_overall", F.col("same_num_groups") & ((F.col("peptide_jaccard") >= 0.8) | F.col("peptide_set_exact_match")))


def overall(summary: DataFrame) -> DataFrame:
    """Counts and shares over all runs, the baseline among them."""
    share = lambda c: F.avg(F.col(c).cast("double")).alias(f"fraction_{c}")
    return summary.agg(F.count("*").alias("num_runs"), F.count_if("stable_overall").alias("num_stable"), share("stable_overall"), share("same_num_groups"), share("assignment_exact_match"), share("peptide_set_exact_match"), F.avg("peptide_jaccard").alias("mean_peptide_jaccard"))


def run_with(functions: tuple[Callable, Callable], data, mode: int | str, topology: TopologyConfig = TopologyConfig(), panel: PanelConfig = PanelConfig()) -> list[dict]:
    """The same sweep with functions of one's own: ``functions[0](data, topology)`` and ``functions[1](data, panel, grouping)``
    run once for each setting; results come with their seconds."""
    out = []
    for run in grid(mode, topology, panel):
        began = time.time()
        grouping = functions[0](data, replace(topology, percentile=run.percentile))
        chosen = functions[1](data, replace(panel, rank_threshold=run.rank_threshold, max_peptides=run.max_peptides, weights=dict(zip(PANEL_WEIGHTS, run.weights))), grouping)
        out.append({"run": run, "grouping": grouping, "panel": chosen, "elapsed_sec": time.time() - began})
    return out


def sweep(rows: DataFrame, vectors: DataFrame, runs: list[Run], topology: TopologyConfig = TopologyConfig(), panel: PanelConfig = PanelConfig()) -> DataFrame:
    """Summary of all runs: raw clusters for each percentile, panels of the whole cohort and of the clusters for each setting.

    Runs share their work, so none has seconds of its own; ``elapsed_sec`` is the whole sweep's, dealt out evenly.
    """
    began = time.time()
    from ..operators.distance import weighted_vectors
    from ..operators.panel import binders, cells, greedy, panel_items
    from ..operators.topology import deaths, percentiles, raw_clusters, tree_of

    spark = rows.sparkSession
    tree = cut(tree_of(cut(weighted_vectors(vectors, topology.weights)), topology.metric))
    samples = vectors.select("sample_idx", "id")
    by_percent = None
    wanted = sorted({r.percentile for r in runs})
    for p, value in percentiles(deaths(tree), wanted).items():
        part = raw_clusters(samples, tree, spark.createDataFrame([(value,)], "threshold double")).withColumn("percentile", F.lit(float(p)))
        by_percent = part if by_percent is None else by_percent.unionByName(part)
    by_percent = cut(by_percent)
    table = grid_table(spark, runs)
    labels = table.select("run_id", "percentile").join(by_percent, "percentile").select("run_id", "sample_idx", F.col("raw_cluster").alias("label"))
    groups = by_percent.join(samples, "sample_idx").select("percentile", F.col("raw_cluster").alias("group"), F.col("id").alias("file_name"))
    groups = groups.unionByName(groups.withColumn("group", F.lit(0)))
    key = ["percentile", "rank_threshold", "group"]
    items = None
    for t in sorted({r.rank_threshold for r in runs}):
        bound = cells(binders(rows, t)).withColumn("rank_threshold", F.lit(float(t))).join(groups, "file_name")
        part = panel_items(bound, t, key)
        items = part if items is None else items.unionByName(part)
    # panels of one setting differ in length alone: the longest holds the others as its beginnings
    longest = table.groupBy("percentile", "rank_threshold", "weights").agg(F.max("max_peptides").alias("most"))
    work = cut(items).join(longest, ["percentile", "rank_threshold"])

    def pick(name, pdf):
        weights = dict(zip(PANEL_WEIGHTS, pdf["weights"].iloc[0]))
        config = replace(panel, max_peptides=int(pdf["most"].iloc[0]), rank_threshold=float(name[1]), weights=weights)
        out = greedy(pdf.sort_values("ordinal"), config)[["step", "peptide"]]
        return out.assign(percentile=name[0], rank_threshold=name[1], group=name[2], weights=[list(name[3])] * len(out))

    picks = work.groupBy(*key, "weights").applyInPandas(pick, "step int, peptide string, percentile double, rank_threshold double, group int, weights array<double>")
    chosen = table.join(picks, ["percentile", "rank_threshold", "weights"]).where(F.col("step") <= F.col("max_peptides"))
    panels = cut(table.select("run_id").join(chosen.groupBy("run_id").agg(F.sort_array(F.collect_set("peptide")).alias("peptides")), "run_id", "left").withColumn("peptides", F.coalesce("peptides", F.array().cast("array<string>"))))
    return stability(table, labels, panels).withColumn("elapsed_sec", F.lit((time.time() - began) / len(runs)))


