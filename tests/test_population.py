import pytest

from cohortpanel.config import PopulationConfig
from cohortpanel.operators.population import PopulationMetrics, common_alleles, group_mixtures, restricted
from pyspark.sql import functions as F

PANEL = "population string, locus string, allele string, allele_frequency double, individuals_frequency double, sample_size double"


def metrics(spark, pairs, rows, **config):
    made = spark.createDataFrame([(p, l, a, f, i, n) for p, l, a, f, i, n in rows], PANEL)
    return PopulationMetrics(spark.createDataFrame(pairs, "peptide string, mhc string"), made, PopulationConfig(**config))


A = [("PEP1", "HLA-A*01:01")]
MIX = [("Pop1", "A", "A*01:01", 0.5, None, 100.0), ("Pop2", "A", "A*01:01", 0.1, None, 300.0)]


@pytest.mark.parametrize(
    ("pairs", "rows", "config", "expected"),
    [
        (A, [("Pop1", "A", "A*01:01", 0.2, 36.0, 100.0), ("Pop1", "A", "A*02:01", 0.8, None, 100.0)], {}, (36, 0.36, 1, 0)),
        (A, [("Pop1", "A", "A*01:01", None, 36.0, 100.0)], {}, (36, 0.36, 1, 0)),
        ([("PEP1", "A*01:01"), ("PEP2", "B*07:02")], [("Pop1", "A", "A*01:01", 0.5, None, 10.0), ("Pop1", "B", "B*07:02", 0.5, None, 10.0)], {}, (93.75, 1.5, 1.6, 1)),
        ([("PEP1", "A*01:01"), ("PEP2", "A*02:01")], [("Pop1", "A", "A*01:01", 0.5, None, 10.0), ("Pop1", "A", "A*02:01", 0.5, None, 10.0)], {}, (100, 1.5, 1.5, 1)),
        (A, MIX, {}, (100 * (0.25 * 0.75 + 0.75 * 0.19), None, None, 0)),
        (A, MIX, {"weight_mode": "equal"}, (100 * (0.75 + 0.19) / 2, None, None, 0)),
        ([("PEP1", "A*01:01"), ("PEP2", "A*01:01")], MIX[:1], {}, (75, 1.5, 2, 0)),
        ([("PEP1", "A*01:01"), ("PEP2", "A*01:01")], MIX[:1], {"hit_mode": "binary_per_allele"}, (75, 0.75, 1, 0)),
    ],
)
def test_closed_forms(spark, pairs, rows, config, expected):
    found = metrics(spark, pairs, rows, **config)
    row = found.mixture().first()
    for value, want in zip((row["coverage_percent"], row["expected_hits"], row["conditional_mean_hits"], row["pc90"]), expected):
        assert want is None or value == pytest.approx(want, abs=1e-10)
    assert sum(r["p"] for r in found.mixture_pmf().collect()) == pytest.approx(1)


def test_all_loci_of_the_panel(spark):
    rows = [("Pop1", "A", "A*01:01", 0.5, None, 100.0), ("Pop1", "DRB1", "DRB1*01:01", 0.5, None, 100.0), ("Pop2", "DRB1", "DRB1*01:01", 0.1, None, 300.0), ("Pop3", "DQB1", "DQB1*02:01", 0.5, None, 100.0)]
    found = metrics(spark, [("PEP1", "HLA-A*01:01"), ("PEP2", "DRB1*01:01")], rows)
    got = {r["population"]: (r["coverage_percent"], r["expected_hits"]) for r in found.populations().collect()}
    assert got["Pop1"] == pytest.approx((93.75, 1.5)) and got["Pop2"] == pytest.approx((19, 0.19)) and got["Pop3"] == pytest.approx((0, 0))
    assert sum(r["p"] for r in found.mixture_pmf().collect()) == pytest.approx(1)
    assert found.mixture().first()["coverage_percent"] == pytest.approx(0.2 * 93.75 + 0.6 * 19)


def test_group_mixtures_equal_single_evaluations(spark):
    rows = [("Pop1", "A", "A*01:01", 0.5, None, 100.0), ("Pop1", "A", "A*02:01", 0.7, None, 100.0), ("Pop1", "DRB1", "DRB1*01:01", 0.5, None, 100.0), ("Pop2", "DRB1", "DRB1*01:01", 0.1, None, 300.0), ("Pop3", "B", "B*07:02", 0.5, None, None)]
    reference = spark.createDataFrame(rows, PANEL)
    pairs = {"x": [("P1", "HLA-A*01:01"), ("P2", "A*01:01"), ("P2", "A*02:01"), ("P3", "DRB1*01:01")], "y": [("P1", "B*07:02")], "z": [("P1", "C*01:02")], "none": [("P1", "")]}
    table = spark.createDataFrame([(g, p, m) for g, items in pairs.items() for p, m in items], "g string, peptide string, mhc string")
    names = ["num_hit_hlas", "num_reference_populations", "coverage_percent", "expected_hits", "conditional_mean_hits", "pc90"]
    for mode in ("multiplicity", "binary_per_allele"):
        config = PopulationConfig(hit_mode=mode)
        got = {r["g"]: tuple(r[n] for n in names) for r in group_mixtures(table, reference, ["g"], config).collect()}
        assert set(got) == {"x", "y", "z"}
        for g, found in got.items():
            one = PopulationMetrics(table.where(F.col("g") == g).drop("g"), reference, config).result().first()
            assert found == pytest.approx(tuple(one[n] for n in names)), g
    nothing = PopulationMetrics(table.where("g = 'none'"), reference).result().first()
    assert not nothing["did_evaluate"] and nothing["coverage_percent"] == 0
    assert not PopulationMetrics(table.drop("mhc"), reference).result().first()["did_evaluate"]
    assert PopulationMetrics(table, reference.drop("locus")).result().first()["num_hit_hlas"] == 0


def test_errors_and_warnings(spark):
    with pytest.raises(Exception, match="out of"):
        metrics(spark, A, [("Pop1", "A", "A*01:01", 250.0, None, 1.0)]).mixture()
    found = metrics(spark, A, [("Pop1", "A", "A*01:01", 0.8, None, 0.0), ("Pop1", "A", "A*02:01", 0.7, None, 0.0)])
    assert {r["warning"] for r in found.warnings().collect()} == {"few loci", "frequencies of a locus sum to more than 1", "sample size not positive", "no sample sizes: populations weigh alike"}
    assert not metrics(spark, [("PEP", "")], MIX).did_evaluate


def test_common_alleles(spark):
    rows = [("A", "A*01:01", 0.1, 100.0, "Europe"), ("A", "A*01:01", 0.4, 300.0, "Asia"), ("a ", "A*02:01", 0.3, None, "Asia"), ("B", "B*07:02", 0.2, 0.0, "Asia"), ("X", "X*1", 0.9, 1.0, "Asia"), ("A", None, 0.9, 1.0, "Asia")]
    panel = spark.createDataFrame(rows, "locus string, allele string, allele_frequency double, sample_size double, region string")
    got = {r["allele"]: (r["mean_allele_frequency"], r["effective_weight"]) for r in common_alleles(panel).collect()}
    assert got["A*01:01"] == pytest.approx((0.325, 400)) and got["A*02:01"] == (0.3, 1) and got["B*07:02"] == (0.2, 1) and len(got) == 3
    assert restricted(panel, "region", " europe ").count() == 1 and restricted(panel, "region", "All Regions").count() == 6
    with pytest.raises(ValueError):
        restricted(panel, "region", "nowhere")
