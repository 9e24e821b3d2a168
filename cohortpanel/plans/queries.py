"""Queries over the test tables, one for each family of operators, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import PANEL_WEIGHTS, PanelConfig, TopologyConfig
from ..functions.lineage import cut
from ..operators import distance, families, features, panel, population, topology
from ..operators.grouping import audit_summary
from ..sources import testdata
from . import export, robustness, suite, workflow

TAU = PanelConfig().rank_threshold
LIMITS = TopologyConfig(merge_singletons=True, min_group_size=3, max_group_size=20)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without -0; counts as long."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, digits) + F.lit(0.0)
        elif isinstance(f.dataType, T.IntegerType):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def _rows(spark, d):
    return testdata.bindings(spark, d)


def _sample(df: DataFrame) -> DataFrame:
    return rounded(df.withColumnRenamed("file_name", "sample").drop("identity"))


def _vectors(spark, d):
    return cut(features.feature_vectors(cut(features.sample_features(_rows(spark, d))))[0])


def _embedding_vectors(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    return rows.select((F.col("vec_id") + 1).cast("int").alias("sample_idx"), F.col("vec_id").cast("string").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))


def _wide_pairs(spark, d, metric):
    """All pairs, rounded in the tasks that measure them."""
    pairs = distance.distances(distance.weighted_vectors(_embedding_vectors(spark, d)), metric, wide=distance.WIDE, digits=6)
    return pairs.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "d")


def _topology(spark, d, config=TopologyConfig()):
    return workflow.topology(_vectors(spark, d), config)


def _bound(spark, d):
    rows = panel.binders(_rows(spark, d), TAU)
    one = rows.withColumn(panel.GROUP, F.lit("all")).unionByName(rows.withColumn(panel.GROUP, F.col("file_name")))
    return one


def _metrics(spark, d):
    pairs = panel.binders(_rows(spark, d), 2.0).select("peptide", "mhc").distinct()
    return population.PopulationMetrics(cut(pairs), cut(testdata.reference_panel(spark, d)))


def grouping_trail(spark, d):
    """Every step of regrouping, its lists as texts."""
    lists = ("raw_groups", "groups_before", "groups_after", "affected", "affected_ids", "sizes_before", "sizes_after")
    return rounded(_topology(spark, d, LIMITS).audit().withColumns({c: F.array_join(c, ";") for c in lists}).drop("reason"))


def grouping_summary(spark, d):
    """Counts of the trail, with the last sizes as a text."""
    done = _topology(spark, d, LIMITS)
    return rounded(audit_summary(cut(done.mapping()), cut(done.audit())).withColumn("final_sizes", F.array_join("final_sizes", ";")))


def _shares(pmf: DataFrame) -> DataFrame:
    """Nine digits; shares that end with a 5 behind them go up, whatever order they were summed in."""
    return rounded(pmf.withColumn("p", F.col("p") + 1e-12), 9)


def hla_filtered_rows(spark, d):
    typed = population.common_alleles(testdata.reference_panel(spark, d)).where("rank <= 3").select(F.concat(F.lit("HLA-"), "allele").alias("mhc"))
    return rounded(_rows(spark, d).join(typed, "mhc", "left_semi").groupBy("identity", "mhc").agg(F.count("*").alias("n"), F.min("rank_el").alias("best")))


def robustness_grid(spark, d):
    """Runs of the full sweep with how many rows bind at their thresholds, which are few and counted in one pass."""
    grid = robustness.grid("full")
    runs = robustness.grid_table(spark, grid)
    limits = sorted({float(x.rank_threshold) for x in grid})
    below = F.explode(F.array(*[F.struct(F.lit(t).alias("rank_threshold"), F.col(f"n{k}").alias("num_binders")) for k, t in enumerate(limits)])).alias("x")
    used = _rows(spark, d).agg(*[F.count_if(F.col("rank_el") < t).alias(f"n{k}") for k, t in enumerate(limits)]).select(below).select("x.*")
    weights = [F.get("weights", i).alias(f"w_{n}") for i, n in enumerate(PANEL_WEIGHTS)]
    return rounded(runs.join(used, "rank_threshold").select("run_id", "percentile", "rank_threshold", "max_peptides", *weights, "num_binders"))


def panel_jaccard(spark, d):
    """The panel of each sample compared with that of the whole cohort."""
    picks = panel.greedy_panels(_bound(spark, d), PanelConfig()).groupBy(panel.GROUP).agg(F.collect_set("peptide").alias("p"))
    picks = cut(picks)
    base = picks.where("panel_group = 'all'").select(F.col("p").alias("q"))
    return rounded(picks.join(base).select(panel.GROUP, robustness.jaccard(F.col("p"), F.col("q")).alias("jaccard"), (F.sort_array("p") == F.sort_array("q")).alias("exact")))


def merge_trace(spark, d):
    """Merges with their members as texts."""
    lists = {c: F.array_join(c, ";") for c in ("left", "right", "merged")}
    return rounded(_topology(spark, d).merge_events().withColumns(lists))


def suite_results(spark, d):
    rows = cut(_rows(spark, d))
    analysis = workflow.analyse(rows, LIMITS)
    return suite.unions(analysis.history)


def suite_population_metrics(spark, d):
    """Population figures of the panels of the cohort and of each raw cluster, which stand for the practical groups too."""
    rows = cut(_rows(spark, d))
    samples = _topology(spark, d).labels.select(F.col("id").alias("file_name"), "raw_cluster")
    assigned = cut(suite.assignments(samples))
    history = cut(suite.run_suite(rows, assigned, PanelConfig()))
    return rounded(suite.reference_metrics(rows, assigned, history, testdata.reference_panel(spark, d)))


def sweep_fast(spark, d):
    rows = cut(_rows(spark, d))
    return rounded(robustness.sweep(rows, _vectors(spark, d), robustness.grid("fast")).drop("weights", "weight_label", "group_sizes", "elapsed_sec"))


def sweep_full(spark, d):
    rows = cut(_rows(spark, d))
    return rounded(robustness.overall(robustness.sweep(rows, _vectors(spark, d), robustness.grid("full"))))


QUERIES = {
    "binders": lambda s, d: rounded(panel.binders(_rows(s, d), TAU).select("identity", "peptide", "mhc", "rank_el")),
    "hla_filtered_rows": hla_filtered_rows,
    "sample_basic_counts": lambda s, d: _sample(features.basic_counts(_rows(s, d))),
    "sample_rank_stats": lambda s, d: _sample(features.rank_stats(_rows(s, d))),
    "sample_top_ranks": lambda s, d: _sample(features.top_ranks(_rows(s, d))),
    "sample_promiscuity": lambda s, d: _sample(features.promiscuity(_rows(s, d))),
    "sample_entropy": lambda s, d: _sample(features.entropy(_rows(s, d))),
    "peptide_kmers": lambda s, d: families.peptide_kmers(_rows(s, d).select("peptide").distinct(), 7),
    "kmer_overlap_pairs": lambda s, d: families.overlap_pairs(_rows(s, d).select("peptide"), 7),
    "peptide_families": lambda s, d: families.peptide_families(_rows(s, d), 7).withColumnRenamed("file_name", "sample"),
    "sample_family_stats": lambda s, d: _sample(features.family_stats(_rows(s, d))),
    "sample_features": lambda s, d: _sample(features.sample_features(_rows(s, d))),
    "feature_zscores": lambda s, d: rounded(distance.zscores(_vectors(s, d)).select(F.col("id").alias("sample"), "pos", "z")),
    "sample_distances": lambda s, d: rounded(distance.distances(distance.weighted_vectors(_vectors(s, d)))),
    "embedding_distances": lambda s, d: _wide_pairs(s, d, "euclidean"),
    "sample_distances_seuclidean": lambda s, d: rounded(distance.distances(distance.weighted_vectors(_vectors(s, d)), "seuclidean")),
    "sample_distances_correlation": lambda s, d: rounded(distance.distances(distance.weighted_vectors(_vectors(s, d)), "correlation")),
    "embedding_distances_spearman": lambda s, d: rounded(distance.distances(distance.weighted_vectors(_embedding_vectors(s, d)), "spearman")),
    "embedding_distances_minkowski": lambda s, d: _wide_pairs(s, d, "minkowski:3"),
    "h0_barcode": lambda s, d: rounded(_topology(s, d).barcode().select("bar", "birth", "death")),
    "h0_threshold_pct": lambda s, d: rounded(_topology(s, d).threshold),
    "h0_threshold_gap": lambda s, d: rounded(_topology(s, d, TopologyConfig(rule="largest_gap")).threshold),
    "raw_clusters": lambda s, d: rounded(_topology(s, d).labels.select("sample_idx", F.col("id").alias("sample"), "raw_cluster")),
    "merge_events": merge_trace,
    "embedding_barcode": lambda s, d: rounded(topology.barcode(cut(topology.tree_of(cut(distance.weighted_vectors(_embedding_vectors(s, d))))))),
    "practical_groups": lambda s, d: _topology(s, d, LIMITS).mapping(),
    "grouping_audit": grouping_trail,
    "grouping_audit_summary": grouping_summary,
    "peptide_scores": lambda s, d: rounded(panel.peptide_scores(_bound(s, d), TAU)),
    "greedy_first_pick": lambda s, d: rounded(panel.first_pick(_bound(s, d), PanelConfig())),
    "greedy_panel": lambda s, d: rounded(panel.greedy_panels(_bound(s, d), PanelConfig())),
    "suite_unions": suite_results,
    "panel_jaccard": panel_jaccard,
    "suite_population_metrics": suite_population_metrics,
    "allele_panel_global": lambda s, d: rounded(population.common_alleles(testdata.reference_panel(s, d))),
    "allele_panel_region": lambda s, d: rounded(population.common_alleles(population.restricted(testdata.reference_panel(s, d), "region", " europe "))),
    "locus_hit_pmf": lambda s, d: _shares(_metrics(s, d).locus_pmf),
    "population_hit_pmf": lambda s, d: _shares(_metrics(s, d).pmf),
    "population_metrics": lambda s, d: rounded(_metrics(s, d).populations()),
    "mixture_metrics": lambda s, d: rounded(_metrics(s, d).mixture()),
    "robustness_grid": robustness_grid,
    "robustness_fast": sweep_fast,
    "robustness_full": sweep_full,
    "sample_feature_pca": lambda s, d: rounded(export.principal_components(distance.weighted_vectors(_vectors(s, d)))),
}
