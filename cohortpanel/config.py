"""Settings with their defaults; every field may be replaced with ``dataclasses.replace``."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Features in vector order with their distance weights.
FEATURE_WEIGHTS = {
    "num_unique_peptides": 0.80,
    "num_unique_HLAs_hit": 0.90,
    "mean_rank": 1.20,
    "best_rank": 1.10,
    "rank_std": 0.90,
    "peptide_promiscuity_mean": 0.90,
    "mean_best_rank_per_peptide": 1.10,
    "hla_entropy": 0.85,
    "rows_per_unique_peptide": 0.75,
    "num_peptide_families": 1.00,
    "largest_peptide_family_size": 1.00,
    "frac_peptides_in_family_size_gt_1": 0.95,
    "mean_best_rank_per_family": 1.15,
}
FEATURES = tuple(FEATURE_WEIGHTS)

#: Terms of the panel score with their weights.
PANEL_WEIGHTS = {"patient": 0.30, "hla": 0.20, "binding": 0.20, "prevalence": 0.10, "novelty": 0.15, "redundancy": 0.15}


@dataclass(frozen=True)
class TopologyConfig:
    metric: str = "euclidean"
    weights: tuple[float, ...] | None = None
    rule: str = "percentile"  # or largest_gap
    percentile: float = 75.0
    merge_singletons: bool = False
    min_group_size: int = 1
    max_group_size: int | None = None  # None: no limit

    def __post_init__(self):
        if self.rule not in ("percentile", "largest_gap"):
            raise ValueError(f"unknown threshold rule {self.rule!r}")
        if not 0 <= self.percentile <= 100:
            raise ValueError("percentile must lie in [0, 100]")
        if self.min_group_size < 1 or (self.max_group_size is not None and self.max_group_size < self.min_group_size):
            raise ValueError("group sizes must be positive, the minimum at most the maximum")


@dataclass(frozen=True)
class PanelConfig:
    max_peptides: int = 20
    rank_threshold: float = 32.7
    family_overlap: int = 7
    redundancy_overlap: int = 7
    weights: dict[str, float] = field(default_factory=lambda: dict(PANEL_WEIGHTS))

    def __post_init__(self):
        if self.max_peptides < 1 or self.rank_threshold <= 0 or self.family_overlap < 1 or self.redundancy_overlap < 1:
            raise ValueError("panel limits must be positive")
        if set(self.weights) != set(PANEL_WEIGHTS) or any(not w >= 0 or w == float("inf") for w in self.weights.values()):
            raise ValueError(f"weights must be finite and not negative, for each of {sorted(PANEL_WEIGHTS)}")


@dataclass(frozen=True)
class PopulationConfig:
    weight_mode: str = "sample_size"  # or equal
    hit_mode: str = "multiplicity"  # or binary_per_allele
    tolerance: float = 1e-9
    min_loci: int = 2
    loci: tuple[str, ...] = ("A", "B", "C")
    top_alleles: int = 10

    def __post_init__(self):
        if self.weight_mode not in ("sample_size", "equal") or self.hit_mode not in ("multiplicity", "binary_per_allele"):
            raise ValueError("unknown population weight mode or hit mode")
