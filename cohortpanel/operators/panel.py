"""Peptide scores of each group and greedy panels that balance coverage, binding, prevalence, novelty and redundancy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PanelConfig
from ..functions.lineage import cut
from ..functions.normalize import binding_strength
from .distance import minmax
from .families import connect
from .ordering import PLACE, stable_index

GROUP = "panel_group"
HISTORY = (
    "step int, peptide string, family_id int, incremental_patient_coverage double, incremental_hla_coverage double, family_novelty_score double, redundancy_penalty double,"
    " patient_term double, hla_term double, binding_term double, prevalence_term double, family_novelty_term double, redundancy_term double, total_score double,"
    " cumulative_patient_coverage double, cumulative_hla_coverage double, num_families_represented int"
)


def binders(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows whose rank lies strictly below the threshold; missing ranks never do."""
    return rows.where(F.col("rank_el").isNotNull() & ~F.isnan("rank_el") & (F.col("rank_el") < threshold))


def cells(bound: DataFrame, keys: tuple[str, ...] = ("file_name", "peptide", "mhc")) -> DataFrame:
    """(keys..., rank_el, file_ordinal, row_ordinal): the least rank and the first place of binder rows of one file, peptide and
    allele. Scores, covers and orders of first appearance are the same from these, and they are as many as there are
    such cells, however many rows a cell has."""
    found = bound.groupBy(*keys).agg(F.min("rank_el").alias("rank_el"), F.min(F.struct(*PLACE)).alias("_first"))
    return found.select(*keys, "rank_el", *[F.col(f"_first.{c}").alias(c) for c in PLACE])


def peptide_scores(bound: DataFrame, threshold: float, within: list[str] = [GROUP]) -> DataFrame:  # noqa: B006
    """(within..., peptide, ordinal, static_patient_coverage, static_hla_coverage, binding_score, prevalence_score), each
    scaled to [0, 1] in its group. ``bound``: binder rows with the group columns; a file is a patient."""
    totals = bound.groupBy(*within).agg(F.count_distinct("file_name").alias("_files"), F.count_distinct("mhc").alias("_hlas"))
    best = bound.groupBy(*within, "peptide", "mhc").agg(F.max(binding_strength(F.col("rank_el"), threshold)).alias("b"))
    binding = best.groupBy(*within, "peptide").agg(F.avg("b").alias("binding"), F.count("*").alias("hlas"))
    patients = bound.groupBy(*within, "peptide").agg(F.count_distinct("file_name").alias("files"))
    raw = patients.join(binding, [*within, "peptide"]).join(totals, within).select(*within, "peptide", (F.col("files") / F.col("_files")).alias("pc"), (F.col("hlas") / F.col("_hlas")).alias("hc"), "binding")
    scaled = raw.select(
        *within, "peptide", minmax("pc", within).alias("static_patient_coverage"), minmax("hc", within).alias("static_hla_coverage"), minmax("binding", within).alias("binding_score"), minmax("pc", within).alias("prevalence_score")
    )
    return scaled.join(stable_index(bound, "peptide", "ordinal", within), [*within, "peptide"])


def families_of(peptides: list[str], k: int) -> np.ndarray:
    """Family of each peptide, numbered from 1 by first appearance."""
    first: dict[str, int] = {}
    a, b = [], []
    for i, p in enumerate(peptides):
        a.append(i), b.append(i)
        for s in range(len(p) - k + 1):
            a.append(i), b.append(first.setdefault(p[s : s + k], i))
    return np.unique(connect(np.array(a, int), np.array(b, int)), return_inverse=True)[1] + 1


def greedy(items: pd.DataFrame, config: PanelConfig) -> pd.DataFrame:
    """The panel of one group from its peptides in first-appearance order (peptide, patients, hlas, binding_score, prevalence_score).

    Every step takes the peptide of the highest score, the earliest of those equal to twelve digits; scores may be negative. A panel of k
    peptides is the beginning of one of more. Memory is linear in the pairs of peptides with patients, alleles and windows.
    """
    n = len(items)
    peptides = items["peptide"].tolist()
    family = families_of(peptides, config.family_overlap)
    members = [np.unique(np.concatenate([np.asarray(x, int) for x in items[c]])) for c in ("patients", "hlas")]
    cover = [[np.searchsorted(universe, np.asarray(x, int)) for x in items[c]] for c, universe in zip(("patients", "hlas"), members)]
    covering = []  # the peptides of each patient and allele, one behind another
    for sets, universe in zip(cover, members):
        member = np.concatenate(sets)
        order = np.argsort(member, kind="stable")
        covering.append((np.repeat(np.arange(n), [len(x) for x in sets])[order], np.searchsorted(member[order], np.arange(len(universe) + 1))))
    holders: dict[str, list[int]] = {}
    k = config.redundancy_overlap
    for i, p in enumerate(peptides):
        for s in range(len(p) - k + 1):
            holders.setdefault(p[s : s + k], []).append(i)
    w = config.weights
    open_ = [np.ones(len(u), bool) for u in members]
    gain = [np.array([len(x) for x in sets]) for sets in cover]
    free, redundant = np.ones(n, bool), np.zeros(n)
    seen: set[int] = set()
    binding, prevalence = items["binding_score"].to_numpy(float), items["prevalence_score"].to_numpy(float)
    out = []
    for step in range(1, min(config.max_peptides, n) + 1):
        patient, hla = gain[0] / len(members[0]), gain[1] / len(members[1])
        novelty = np.array([f not in seen for f in family], float)
        terms = [w["patient"] * patient, w["hla"] * hla, w["binding"] * binding, w["prevalence"] * prevalence, w["novelty"] * novelty, w["redundancy"] * redundant]
        score = ((((terms[0] + terms[1]) + terms[2]) + terms[3]) + terms[4]) - terms[5]
        best = int(np.argmax(np.where(free, score.round(12), -np.inf)))  # sums differ in their last digits from run to run
        free[best] = False
        seen.add(int(family[best]))
        for c in (0, 1):
            peptides_of, starts = covering[c]
            for x in cover[c][best][open_[c][cover[c][best]]].tolist():
                open_[c][x] = False
                gain[c][peptides_of[starts[x] : starts[x + 1]]] -= 1
        before = redundant[best]
        for s in range(len(peptides[best]) - k + 1):
            redundant[holders[peptides[best][s : s + k]]] = 1
        done = [1 - o.sum() / len(o) for o in open_]
        out.append((step, peptides[best], int(family[best]), float(patient[best]), float(hla[best]), float(novelty[best]), float(before), *(float(t[best]) for t in terms), float(score[best]), float(done[0]), float(done[1]), len(seen)))
    return pd.DataFrame(out, columns=[c.split()[0] for c in HISTORY.split(",")])


def panel_items(bound: DataFrame, threshold: float, within: list[str] = [GROUP]) -> DataFrame:  # noqa: B006
    """Rows that ``greedy`` needs: peptide scores with the numbers of the patients and alleles each peptide has."""
    bound = cut(cells(bound, (*within, "file_name", "peptide", "mhc")))
    files = stable_index(bound, "file_name", "_file", None).withColumnRenamed("_file", "_f")
    hlas = stable_index(bound, "mhc", "_hla", None).withColumnRenamed("_hla", "_h")
    coded = bound.join(files, "file_name").join(hlas, "mhc")
    sets = coded.groupBy(*within, "peptide").agg(F.collect_set("_f").alias("patients"), F.collect_set("_h").alias("hlas"))
    return peptide_scores(bound, threshold, within).join(sets, [*within, "peptide"])


def greedy_panels(bound: DataFrame, config: PanelConfig, within: list[str] = [GROUP]) -> DataFrame:  # noqa: B006
    """(within..., HISTORY): the panels of all groups, each by itself; groups without binders have none.

    Steps of a group follow one another, so a task holds one group's distinct peptides with their cover.
    """
    kinds = dict(bound.dtypes)

    def pick(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = greedy(pdf.sort_values("ordinal"), config)
        for name, value in zip(within, key):
            out[name] = value
        return out

    schema = f"{HISTORY}, " + ", ".join(f"{c} {kinds[c]}" for c in within)
    return panel_items(bound, config.rank_threshold, within).groupBy(*within).applyInPandas(pick, schema)


def all_files(rows: DataFrame, group: str = "all") -> DataFrame:
    return rows.withColumn(GROUP, F.lit(group))


def first_pick(bound: DataFrame, config: PanelConfig, within: list[str] = [GROUP]) -> DataFrame:  # noqa: B006
    """(within..., peptide, total_score) of each panel's first step, without a kernel: nothing is covered or chosen yet."""
    w = config.weights
    totals = bound.groupBy(*within).agg(F.count_distinct("file_name").alias("_files"), F.count_distinct("mhc").alias("_hlas"))
    cover = bound.groupBy(*within, "peptide").agg(F.count_distinct("file_name").alias("files"), F.count_distinct("mhc").alias("hlas")).join(totals, within)
    scored = peptide_scores(bound, config.rank_threshold, within).join(cover, [*within, "peptide"])
    total = w["patient"] * F.col("files") / F.col("_files") + w["hla"] * F.col("hlas") / F.col("_hlas") + w["binding"] * F.col("binding_score") + w["prevalence"] * F.col("prevalence_score") + w["novelty"]
    scored = scored.withColumn("total_score", F.round(total, 9))
    return scored.groupBy(*within).agg(F.max_by("peptide", F.struct("total_score", -F.col("ordinal"))).alias("peptide"), F.max("total_score").alias("total_score"))


