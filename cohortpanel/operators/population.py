"""Common-allele panels and hit-count distributions of populations, from allele frequency tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import PopulationConfig
from ..functions.lineage import cut
from ..functions.normalize import allele_name, fraction, frequency_from_carriers, number, trimmed


def restricted(panel: DataFrame, column: str, choice: str) -> DataFrame:
    """Rows of one region or ancestry, without regard to case and outer spaces; ``All ...`` keeps all rows, no row is an error."""
    if choice.strip().lower().startswith("all "):
        return panel
    kept = panel.where(F.lower(trimmed(F.col(column))) == choice.strip().lower())
    if kept.limit(1).count() == 0:
        raise ValueError(f"no rows for {column} {choice!r}")
    return kept


def common_alleles(panel: DataFrame, config: PopulationConfig = PopulationConfig()) -> DataFrame:
    """(locus, allele, mean_allele_frequency, num_rows, effective_weight, rank): the most frequent alleles of each locus.

    Frequencies weigh by sample size where a positive one is known, else alike. Equals go by weight, then by name.
    """
    rows = panel.where("allele IS NOT NULL AND locus IS NOT NULL AND allele_frequency IS NOT NULL AND NOT isnan(allele_frequency)")
    rows = rows.withColumn("locus", F.upper(trimmed(F.col("locus")))).where(F.col("locus").isin(*config.loci)).withColumn("allele", trimmed(F.col("allele")))
    w, f = F.col("sample_size"), F.col("allele_frequency")
    weighted = F.sum(F.when(w > 0, f * w)) / F.sum(F.when(w > 0, w))
    pooled = rows.groupBy("locus", "allele").agg(
        F.coalesce(weighted, F.avg(f)).alias("mean_allele_frequency"), F.count("*").alias("num_rows"), F.coalesce(F.sum(F.when(w > 0, w)), F.count("*").cast("double")).alias("effective_weight")
    )
    order = Window.partitionBy("locus").orderBy(F.desc("mean_allele_frequency"), F.desc("effective_weight"), "allele")
    return pooled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.top_alleles)


def hit_counts(pairs: DataFrame, mode: str = "multiplicity", within: list[str] = []) -> DataFrame:  # noqa: B006
    """(within..., allele, hit_count) from (within..., peptide, mhc): distinct peptides that hit an allele, or 1."""
    hits = pairs.select(*within, "peptide", allele_name(F.col("mhc")).alias("allele")).where("allele != ''").distinct()
    return hits.groupBy(*within, "allele").agg((F.count("*") if mode == "multiplicity" else F.lit(1).cast("long")).alias("hit_count"))


def cleaned(panel: DataFrame, config: PopulationConfig = PopulationConfig()) -> DataFrame:
    """(population, locus, allele, frequency, sample_size): frequencies as shares, taken from carriers where missing, the
    highest of repeated rows. A share out of [0, 1] by more than the tolerance is an error when rows are read."""
    given = fraction(number(F.col("allele_frequency")))
    if "individuals_frequency" in panel.columns:
        given = F.coalesce(given, frequency_from_carriers(fraction(number(F.col("individuals_frequency")))))
    size = number(F.col("sample_size")) if "sample_size" in panel.columns else F.lit(None).cast("double")
    rows = panel.select(trimmed(F.col("population").cast("string")).alias("population"), F.upper(trimmed(F.col("locus"))).alias("locus"), allele_name(F.col("allele")).alias("allele"), given.alias("f"), size.alias("sample_size"))
    rows = rows.where("population != '' AND locus != '' AND allele != '' AND f IS NOT NULL")
    bad = (F.col("f") < -config.tolerance) | (F.col("f") > 1 + config.tolerance)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("allele frequency out of [0, 1]: "), F.col("f")))).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("f"))))
    return rows.groupBy("population", "locus", "allele").agg(F.max(checked).alias("frequency"), F.max("sample_size").alias("sample_size"))


def locus_pmf(clean: DataFrame, hits: DataFrame) -> DataFrame:
    """(population, locus, h, p): hits of a genotype at a locus. Alleles without hits are one, with the mass that the table
    leaves out; two different alleles hit as often as both do, a homozygote once."""
    named = clean.join(hits, "allele", "left").groupBy("population", "locus", F.coalesce("hit_count", F.lit(0)).alias("h"), F.when(F.col("hit_count") > 0, F.col("allele")).alias("allele")).agg(F.sum("frequency").alias("f"))
    total = named.groupBy("population", "locus").agg(F.sum("f").alias("known"))
    rest = total.select("population", "locus", F.lit(0).cast("long").alias("h"), F.lit(None).cast("string").alias("allele"), F.greatest(F.lit(0.0), 1 - F.col("known")).alias("f"))
    mass = named.unionByName(rest).groupBy("population", "locus", "h", "allele").agg(F.sum("f").alias("f"))
    whole = Window.partitionBy("population", "locus")
    return genotypes(mass.withColumn("f", F.col("f") / F.sum("f").over(whole)), ["population", "locus"])


def genotypes(mass: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., h, p) from the shares f of alleles (keys..., h, allele): hits of two alleles drawn at random."""
    mass = mass.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("h", F.col("allele").asc_nulls_first())))
    other = mass.select(*keys, F.col("k").alias("_k"), F.col("h").alias("_h"), F.col("f").alias("_f"))
    same = F.col("k") == F.col("_k")
    h = F.when(same, F.col("h")).otherwise(F.col("h") + F.col("_h"))
    p = F.when(same, F.col("f") * F.col("_f")).otherwise(2 * F.col("f") * F.col("_f"))
    pairs = mass.join(other, keys).where("k <= _k").select(*keys, h.alias("h"), p.alias("p"))
    return pairs.groupBy(*keys, "h").agg(F.sum("p").alias("p"))


def convolved(loci: DataFrame, start: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """(keys..., h, p): the distributions (keys..., locus, h, p) of the named loci convolved, from a point mass at 0 for each
    row of ``start``; a locus that is missing adds nothing."""
    acc = start.select(*keys).distinct().withColumns({"h": F.lit(0).cast("long"), "p": F.lit(1.0)})
    for name in names:
        step = loci.where(F.col("locus") == name).select(*keys, F.col("h").alias("h2"), F.col("p").alias("p2"))
        joined = acc.join(step, keys, "left").withColumns({"h2": F.coalesce("h2", F.lit(0)), "p2": F.coalesce("p2", F.lit(1.0))})
        acc = joined.groupBy(*keys, (F.col("h") + F.col("h2")).alias("h")).agg(F.sum(F.col("p") * F.col("p2")).alias("p"))
    return acc


def loci_of(clean: DataFrame) -> list[str]:
    return sorted(r["locus"] for r in clean.select("locus").distinct().collect())


def population_pmf(loci: DataFrame, clean: DataFrame) -> DataFrame:
    """(population, h, p): the distributions of the panel's loci convolved; a locus that a population lacks adds nothing."""
    return convolved(loci, clean, loci_of(clean), ["population"])


def group_mixtures(pairs: DataFrame, panel: DataFrame, within: list[str], config: PopulationConfig = PopulationConfig()) -> DataFrame:
    """(within..., num_hit_hlas, num_reference_populations, coverage_percent, expected_hits, conditional_mean_hits, pc90) of
    the weighted mixture of all populations, for each group of (within..., peptide, mhc) that hits an allele.

    Groups meet the panel on the alleles that they hit; loci and populations where they hit none have no hits for sure
    and are left out of the work: what is missing of a mixture's mass is its share of no hits.
    """
    hits = cut(hit_counts(pairs, config.hit_mode, within))
    clean = cut(cleaned(panel, config))
    known = clean.groupBy("population", "locus").agg(F.greatest(F.lit(1.0), F.sum("frequency")).alias("total"))
    keys = [*within, "population", "locus"]
    named = hits.join(clean.select("population", "locus", "allele", "frequency"), "allele").join(known, ["population", "locus"])
    named = named.select(*keys, F.col("hit_count").alias("h"), "allele", (F.col("frequency") / F.col("total")).alias("f"))
    rest = named.groupBy(*keys).agg((1 - F.sum("f")).alias("f")).select(*keys, F.lit(0).cast("long").alias("h"), F.lit(None).cast("string").alias("allele"), "f")
    loci = cut(genotypes(named.unionByName(rest), keys))
    pmf = convolved(loci, loci, loci_of(clean), [*within, "population"])
    mixed = pmf.where("h > 0").join(population_weights(clean, config.weight_mode), "population").groupBy(*within, "h").agg(F.sum(F.col("p") * F.col("weight")).alias("p"))
    groups = hits.groupBy(*within).agg(F.count("*").alias("num_hit_hlas"))
    none = groups.select(*within).join(mixed.groupBy(*within).agg(F.sum("p").alias("_some")), within, "left")
    whole = mixed.unionByName(none.select(*within, F.lit(0).cast("long").alias("h"), F.greatest(F.lit(0.0), 1 - F.coalesce("_some", F.lit(0.0))).alias("p")))
    return groups.withColumn("num_reference_populations", F.lit(clean.select("population").distinct().count())).join(_moments(whole, within), within)


def _moments(pmf: DataFrame, by: list[str]) -> DataFrame:
    """coverage_percent, expected_hits, conditional_mean_hits and pc90 (most hits that at least 90 % have)."""
    tail = F.sum("p").over(Window.partitionBy(*by).orderBy(F.desc("h")))
    grouped = pmf.withColumn("tail", tail)
    grouped = grouped.groupBy(*by) if by else grouped.groupBy()
    sums = grouped.agg(
        F.sum(F.when(F.col("h") == 0, F.col("p"))).alias("p0"), F.sum(F.col("h") * F.col("p")).alias("expected_hits"), F.coalesce(F.max(F.when(F.round("tail", 12) >= 0.9, F.col("h"))), F.lit(0)).alias("pc90")
    )
    covered = F.greatest(F.lit(0.0), 1 - F.coalesce("p0", F.lit(0.0)))
    return sums.select(*by, (100 * covered).alias("coverage_percent"), "expected_hits", F.when(covered > 0, F.col("expected_hits") / covered).otherwise(0.0).alias("conditional_mean_hits"), "pc90")


def population_weights(clean: DataFrame, mode: str) -> DataFrame:
    """(population, weight), summing to 1: by the largest sample size, 1 where it is missing or not positive, or alike."""
    size = F.max("sample_size")
    raw = clean.groupBy("population").agg((F.when(size > 0, size).otherwise(1.0) if mode == "sample_size" else F.lit(1.0)).alias("w"))
    return raw.select("population", (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("weight"))


#: Columns that a reference panel must have.
REQUIRED = ("population", "locus", "allele", "allele_frequency")


class PopulationMetrics:
    """Frames of one evaluation; ``did_evaluate`` is false where nothing is hit, a table is empty or lacks a column.

    All loci of the panel count. Alleles of loci other than A, B and C get no prefix: hits and panel must name them alike.
    """

    def __init__(self, pairs: DataFrame, panel: DataFrame, config: PopulationConfig = PopulationConfig()):
        self.config = config
        spark = pairs.sparkSession
        if not {"peptide", "mhc"} <= set(pairs.columns):
            pairs = spark.createDataFrame([], "peptide string, mhc string")
        if not set(REQUIRED) <= set(panel.columns):
            panel = spark.createDataFrame([], "population string, locus string, allele string, allele_frequency double, sample_size double")
        self.hits = hit_counts(pairs, config.hit_mode)
        self.clean = cleaned(panel, config)
        self.locus_pmf = cut(locus_pmf(self.clean, self.hits))
        self.pmf = cut(population_pmf(self.locus_pmf, self.clean))
        self.weights = population_weights(self.clean, config.weight_mode)

    @property
    def did_evaluate(self) -> bool:
        return self.hits.limit(1).count() > 0 and self.clean.limit(1).count() > 0

    def populations(self) -> DataFrame:
        """(population, weight, coverage_percent, expected_hits, conditional_mean_hits, pc90)"""
        return self.weights.join(_moments(self.pmf, ["population"]), "population")

    def mixture_pmf(self) -> DataFrame:
        return self.pmf.join(self.weights, "population").groupBy("h").agg(F.sum(F.col("p") * F.col("weight")).alias("p"))

    def mixture(self) -> DataFrame:
        """One row of the weighted mixture of all populations."""
        return _moments(self.mixture_pmf(), [])

    def result(self) -> DataFrame:
        """One row: did_evaluate, num_hit_hlas, num_reference_populations and the mixture's figures; zeros where nothing is
        evaluated."""
        if not self.did_evaluate:
            zero = "false AS did_evaluate, 0L AS num_hit_hlas, 0L AS num_reference_populations, 0D AS coverage_percent, 0D AS expected_hits, 0D AS conditional_mean_hits, 0L AS pc90"
            return self.clean.sparkSession.range(1).selectExpr(*zero.split(", "))
        counts = self.hits.agg(F.lit(True).alias("did_evaluate"), F.count("*").alias("num_hit_hlas")).join(self.clean.agg(F.count_distinct("population").alias("num_reference_populations")))
        return counts.join(self.mixture())

    def warnings(self) -> DataFrame:
        """(population, warning): few loci, loci of fewer than two alleles or whose known mass exceeds 1, sample sizes that are
        missing or not positive, and weights that are alike as no population has a size."""
        known = self.clean.groupBy("population", "locus").agg(F.sum("frequency").alias("mass"), F.count_distinct("allele").alias("alleles"), F.max("sample_size").alias("size"))
        per = known.groupBy("population").agg(
            F.count("*").alias("loci"), F.max("mass").alias("mass"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("alleles") < 2, F.col("locus")))), ", ").alias("sparse"), F.max("size").alias("size")
        )
        sized = F.lit(self.config.weight_mode == "sample_size" and not self.clean.where("sample_size > 0").limit(1).count())
        said = F.array(
            F.when(F.col("loci") < self.config.min_loci, F.lit("few loci")), F.when(F.col("mass") > 1 + self.config.tolerance, F.lit("frequencies of a locus sum to more than 1")), F.when(F.col("size") <= 0, F.lit("sample size not positive")),
            F.when(F.col("size").isNull() & F.lit(self.config.weight_mode == "sample_size"), F.lit("sample size missing, weighs 1")),
            F.when(F.col("sparse") != "", F.concat(F.lit("fewer than two alleles of locus "), F.col("sparse"))), F.when(sized, F.lit("no sample sizes: populations weigh alike")),
        )
        return per.select("population", F.explode(F.filter(said, lambda x: x.isNotNull())).alias("warning"))
