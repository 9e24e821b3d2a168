"""From rows to groups and panels: the whole analysis as lazily built frames."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PanelConfig, TopologyConfig
from ..functions.lineage import cut
from ..operators.distance import check_metric, distances, weighted_vectors
from ..operators.features import feature_vectors, sample_features
from ..operators.grouping import grouping_audit, practical_groups
from ..operators.metrics import mapped
from ..operators.panel import binders, cells
from ..operators.topology import barcode, merge_events, raw_clusters, threshold, tree_of
from ..sources.bindings import require_columns
from . import suite, validate

log = logging.getLogger("cohortpanel")


@dataclass
class Topology:
    samples: DataFrame
    edges: DataFrame
    tree: DataFrame
    threshold: DataFrame
    labels: DataFrame  # sample_idx, id, raw_cluster
    config: TopologyConfig
    weighted: DataFrame  # sample_idx, v, mapped for the metric
    metric: str  # the plain one that the mapped vectors are measured by

    def barcode(self) -> DataFrame:
        return barcode(self.tree)

    def merge_events(self) -> DataFrame:
        return merge_events(self.tree)

    def mapping(self) -> DataFrame:
        return practical_groups(self.edges, self.labels, self.config)

    def audit(self) -> DataFrame:
        return grouping_audit(self.edges, self.labels, self.config)

    def warnings(self, mapping: DataFrame | None = None) -> DataFrame:
        """(practical_group, size, warning): groups that regrouping left out of their limits, as its steps ran out or no merge
        or split could help."""
        sizes = (self.mapping() if mapping is None else mapping).groupBy("practical_group").agg(F.count("*").alias("size"))
        low, high = self.config.min_group_size, self.config.max_group_size
        said = F.when(F.col("size") < low, f"group is below the minimum size of {low}")
        said = said if high is None else said.when(F.col("size") > high, f"group is above the maximum size of {high}")
        return sizes.withColumn("warning", said).where("warning IS NOT NULL")


def topology(vectors: DataFrame, config: TopologyConfig = TopologyConfig()) -> Topology:
    """Tree, threshold and raw clusters of (sample_idx, id, features). The tree comes from the distances without keeping
    them; ``edges`` measures them anew, in the same blocks and so to the same numbers, for who needs all."""
    vectors = cut(vectors)
    check_metric(config.metric)
    plain = cut(weighted_vectors(vectors, config.weights))
    weighted, metric = mapped(plain, config.metric)
    weighted = plain if weighted is plain else cut(weighted)
    edges = distances(weighted, metric)
    tree = cut(tree_of(weighted, metric))
    epsilon = cut(threshold(tree, config))
    samples = vectors.select("sample_idx", "id")
    return Topology(samples, edges, tree, epsilon, cut(samples.join(raw_clusters(samples, tree, epsilon), "sample_idx")), config, weighted, metric)


@dataclass
class Analysis:
    rows: DataFrame
    features: DataFrame
    not_finite: DataFrame
    topology: Topology
    samples: DataFrame  # file_name, raw_cluster, practical_group
    assigned: DataFrame
    history: DataFrame


def analyse(rows: DataFrame, topology_config: TopologyConfig = TopologyConfig(), panel: PanelConfig = PanelConfig(), run_mode: str = "all", checked: bool = True) -> Analysis:
    """The whole analysis of prediction rows. ``checked`` holds every stage's result against what the next one needs and
    raises ValueError where it fails."""
    if checked:
        require_columns(rows, ["file_name", "identity", "peptide", "mhc", "rank_el"])
    features = sample_features(rows)
    features = cut(features)
    vectors, bad = feature_vectors(features)
    vectors = cut(vectors)
    if checked:
        validate.vectors(vectors)
    groups = topology(vectors, topology_config)
    mapping = cut(groups.mapping())
    samples = cut(mapping.select(F.col("id").alias("file_name"), "raw_cluster", "practical_group"))
    if checked:
        validate.audit(mapping, cut(groups.audit()))
        validate.panel_input(rows)
        validate.labels(samples, "raw_cluster")
        validate.labels(samples, "practical_group")
        for row in groups.warnings(samples).collect():  # a row a group out of its limits
            log.warning("practical group %s of %s files: %s", row["practical_group"], row["size"], row["warning"])
    assigned = cut(suite.assignments(samples, run_mode, topology_config.min_group_size))
    history = cut(suite.run_suite(rows, assigned, panel))
    if checked:
        validate.history(history, suite.KEY, panel.max_peptides)
        bound = cells(binders(rows, panel.rank_threshold)).join(assigned.where("did_run").select(*suite.KEY, "file_name"), "file_name")
        validate.picked_within(history, bound, suite.KEY)
        validate.union_identity(suite.unions(history), suite.selected_by_group(history))
    return Analysis(rows, features, bad, groups, samples, assigned, history)
