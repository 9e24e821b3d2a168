import pytest

from cohortpanel.config import PANEL_WEIGHTS
from cohortpanel.functions.text import duration, normalised
from cohortpanel.plans import robustness
from pyspark.sql import functions as F


def test_grid_sizes():
    assert [len(robustness.grid(m)) for m in ("fast", 2, "full")] == [3, 10, 84]
    assert len({(r.percentile, r.rank_threshold, r.max_peptides, r.weights) for r in robustness.grid("full")}) == 84
    with pytest.raises(ValueError):
        robustness.grid("other")
    assert sum(robustness.weight_sets(PANEL_WEIGHTS, "full")[3]) == pytest.approx(1)


def test_own_functions():
    runs = robustness.run_with((lambda data, t: [1, 1], lambda data, p, g: [f"PEP{p.max_peptides}"]), None, "standard")
    assert len(runs) == 10 and {r["panel"][0] for r in runs} == {"PEP20", "PEP18", "PEP22"}


def test_comparison(spark):
    labels = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 1, 2), (1, 2, 2)], "run_id int, sample_idx int, label int")
    got = {r["run_id"]: r for r in robustness.agreement(labels).collect()}
    assert got[0]["assignment_exact_match"] and got[1]["assignment_agreement"] == 0.5 and not got[1]["same_num_groups"] and got[1]["group_sizes"] == [2]
    pairs = spark.createDataFrame([([], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [r[0] for r in pairs.select(robustness.jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, pytest.approx(1 / 3)]


def test_texts():
    assert duration(3725) == "1 h 2 min 5 s" and normalised([1, -1, 1]) == (0.5, 0, 0.5)
    with pytest.raises(ValueError):
        normalised([0, -1])
