"""Exact figures of samples whose rows arrive in any order, kept as state between batches.

A sample's state is its totals, its peptides (alleles and least rank of each), its pairs of peptide and allele and its
alleles' rows, each an entry of its own in the state store: a batch reads and writes the entries of its own rows alone, so
neither the sample nor its peptides are ever in memory together. Samples without rows for a while are closed by a timer.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.features import EPS

FIGURES = (
    "file_name string, closed boolean, num_rows long, num_unique_peptides long, num_unique_HLAs_hit long, rows_per_unique_peptide double, best_rank double, mean_rank double, rank_std double,"
    " peptide_promiscuity_mean double, peptide_promiscuity_max long, mean_peptide_length double, mean_best_rank_per_peptide double, hla_entropy double"
)
TOTALS = (
    "rows long, ranks long, mean double, m2 double, best double, peptides long, pairs long, most long, letters long, ranked long, bests double, timer long"
)
#: The state of a sample without rows.
NOTHING = (0, 0, 0.0, 0.0, math.inf, 0, 0, 0, 0, 0, 0.0, 0)


class SampleFigures(StatefulProcessor):
    """Figures of one sample after each batch that has rows of it, and once more when it is closed."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", TOTALS)
        self.peptides = handle.getMapState("peptides", "peptide string", "alleles long, best double")
        self.pairs = handle.getMapState("pairs", "peptide string, mhc string", "n long")
        self.alleles = handle.getMapState("alleles", "mhc string", "n long")

    def handleInputRows(self, key, rows, timerValues):
        state = dict(zip([c.split()[0] for c in TOTALS.split(", ")], self.totals.get() if self.totals.exists() else NOTHING))
        latest = 0
        for pdf in rows:
            latest = max(latest, int(pdf["arrived"].max().timestamp() * 1000))
            self._add(state, pdf)
        if state["timer"]:
            self.handle.deleteTimer(state["timer"])
        state["timer"] = max(state["timer"], latest + self.idle_ms)
        self.handle.registerTimer(state["timer"])
        self.totals.update(tuple(state.values()))
        yield self._figures(key[0], state, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state = dict(zip([c.split()[0] for c in TOTALS.split(", ")], self.totals.get()))
        yield self._figures(key[0], state, True)
        for kept in (self.totals, self.peptides, self.pairs, self.alleles):
            kept.clear()

    def _add(self, state: dict, pdf: pd.DataFrame) -> None:
        ranks = pdf["rank_el"].dropna()
        state["rows"] += len(pdf)
        if len(ranks):  # two sets of ranks as one, by their means and squared deviations
            n, mean, m2 = len(ranks), float(ranks.mean()), float(((ranks - ranks.mean()) ** 2).sum())
            both, apart = state["ranks"] + n, mean - state["mean"]
            state["m2"] += m2 + apart * apart * state["ranks"] * n / both
            state["mean"] += apart * n / both
            state["ranks"] = both
            state["best"] = min(state["best"], float(ranks.min()))
        fresh: dict[str, int] = {}
        for (peptide, mhc), n in pdf.groupby(["peptide", "mhc"]).size().items():
            known = self.pairs.getValue((peptide, mhc))[0] if self.pairs.containsKey((peptide, mhc)) else 0
            fresh[peptide] = fresh.get(peptide, 0) + (not known)
            self.pairs.updateValue((peptide, mhc), (known + int(n),))
        for mhc, n in pdf.groupby("mhc").size().items():
            known = self.alleles.getValue((mhc,))[0] if self.alleles.containsKey((mhc,)) else 0
            self.alleles.updateValue((mhc,), (known + int(n),))
        for peptide, best in pdf.groupby("peptide")["rank_el"].min().items():
            if self.peptides.containsKey((peptide,)):
                alleles, before = self.peptides.getValue((peptide,))
            else:
                alleles, before = 0, math.inf
                state["peptides"] += 1
                state["letters"] += len(peptide)
            after = before if pd.isna(best) else min(before, float(best))
            if after != before:
                state["ranked"] += before == math.inf
                state["bests"] += after - (0.0 if before == math.inf else before)
            alleles += fresh.get(peptide, 0)
            state["pairs"] += fresh.get(peptide, 0)
            state["most"] = max(state["most"], alleles)
            self.peptides.updateValue((peptide,), (alleles, after))

    def _figures(self, name: str, state: dict, closed: bool) -> pd.DataFrame:
        n, peptides = state["rows"], state["peptides"]
        shares = [v[0] / n for _, v in self.alleles.iterator()]
        deviation = math.sqrt(state["m2"] / (state["ranks"] - 1)) if state["ranks"] > 1 else 0.0 if state["ranks"] else None
        row = (
            name, closed, n, peptides, len(shares), n / max(peptides, 1), state["best"] if state["ranks"] else None, state["mean"] if state["ranks"] else None, deviation,
            state["pairs"] / peptides, state["most"], state["letters"] / peptides, state["bests"] / state["ranked"] if state["ranked"] else None, -sum(p * math.log(p + EPS) for p in shares),
        )
        return pd.DataFrame([row], columns=[c.split()[0] for c in FIGURES.split(", ")])


def running_figures(rows: DataFrame, delay: str = "1 hour", idle_minutes: int = 24 * 60) -> DataFrame:
    """FIGURES of each sample after each batch, from a stream of rows (streaming.incremental.INPUT, typed).

    They equal those of ``operators.features`` over all rows so far, in whatever order these come. Rows later than ``delay``
    are left out, as are those without peptide or allele. A sample without rows for ``idle_minutes`` of event time is given
    once more as closed, and its state goes. The session needs the RocksDB state store.
    """
    whole = rows.where("peptide IS NOT NULL AND mhc IS NOT NULL AND file_name IS NOT NULL").withWatermark("arrived", delay)
    processor = SampleFigures(idle_minutes * 60_000)
    return whole.select("file_name", "peptide", "mhc", F.col("rank_el").cast("double").alias("rank_el"), "arrived").groupBy("file_name").transformWithStateInPandas(processor, FIGURES, "Update", "EventTime")
