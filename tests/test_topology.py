import math
import random

import numpy as np
import pandas as pd
import pytest

from cohortpanel.config import TopologyConfig
from cohortpanel.operators import grouping, topology
from cohortpanel.operators import tree as tree_module
from cohortpanel.operators.distance import distances, pairwise, weighted_vectors
from cohortpanel.plans import validate
from cohortpanel.plans.workflow import topology as analyse_topology


def vectors(spark, xs):
    return spark.createDataFrame([(i + 1, f"c{i + 1}", [float(v) for v in np.atleast_1d(x)]) for i, x in enumerate(xs)], "sample_idx int, id string, features array<double>")


def tree(spark, deaths):
    return spark.createDataFrame([(1, k + 2, float(d)) for k, d in enumerate(deaths)], "i int, j int, d double")


def test_three_points(spark):
    done = analyse_topology(vectors(spark, [0, 1, 10]), TopologyConfig(percentile=50))
    sd = np.std([0, 1, 10], ddof=1)
    bars = [r["death"] for r in done.barcode().orderBy("bar").collect()]
    assert bars == pytest.approx([1 / sd, 9 / sd, math.inf])
    assert done.threshold.first()[0] == pytest.approx((1 / sd + 9 / sd) / 2)
    assert [r["raw_cluster"] for r in done.labels.orderBy("sample_idx").collect()] == [1, 1, 2]
    events = done.audit().orderBy("step").collect()
    assert (events[0]["stage"], events[-1]["stage"]) == ("initial", "final") and len(events) >= 2
    validate.audit(done.mapping(), done.audit())
    merges = done.merge_events().orderBy("step").collect()
    assert [m["merged"] for m in merges] == [[1, 2], [1, 2, 3]]


def test_thresholds(spark):
    pct = lambda d, p: topology.percentile_threshold(tree(spark, d), p).first()[0]
    gap = lambda d: topology.gap_threshold(tree(spark, d)).first()[0]
    assert pct([1, 2, 3], 75) == 2.75 and pct([1, 2, 3], 0) == 1 and pct([1, 2, 3], 100) == 3 and pct([], 75) == 0
    assert gap([1, 2, 10]) == 2 and gap([5]) == 5 and gap([1, 2, 3]) == 1 and gap([]) == 0


def test_tree_is_minimal(spark):
    points = np.random.default_rng(1).normal(size=(60, 3))
    edges = distances(weighted_vectors(vectors(spark, points)), block=16)
    assert edges.count() == 60 * 59 // 2
    z = (points - points.mean(0)) / points.std(0, ddof=1)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    seen, best, expected = {0}, d[0].copy(), []
    while len(seen) < 60:
        k = min((k for k in range(60) if k not in seen), key=lambda k: best[k])
        expected.append(best[k])
        seen.add(k)
        best = np.minimum(best, d[k])
    got = sorted(r["d"] for r in topology.tree_of(weighted_vectors(vectors(spark, points))).collect())
    assert got == pytest.approx(sorted(expected))


def plain_tree(x, metric):
    i, j = np.triu_indices(len(x), 1)
    d = pairwise(x, x, metric)[i, j]
    found = tree_module.spanning_forest(pd.DataFrame({"i": i + 1, "j": j + 1, "d": d}))
    return sorted(zip(found["i"], found["j"]))


@pytest.mark.parametrize("kind", ["clusters", "ties"])
def test_tree_measures_few_pairs(spark, kind):
    """The tree of all pairs from some of them: clustered points leave most pairs of blocks unmeasured."""
    r = np.random.default_rng(2)
    x = {
        "clusters": np.concatenate([r.normal(size=(24, 3)) * 0.1 + c for c in r.uniform(-20, 20, size=(8, 3))]),
        "ties": np.repeat(r.integers(0, 4, size=(15, 2)), 3, axis=0).astype(float),
    }[kind]
    metric = {"clusters": "euclidean", "ties": "cityblock"}[kind]
    rows = spark.createDataFrame([(k + 1, [float(v) for v in row]) for k, row in enumerate(x)], "sample_idx int, v array<double>")
    found = tree_module.PrunedTree(rows, metric, block=15, pivots=16)
    assert sorted((q["i"], q["j"]) for q in found.tree.collect()) == plain_tree(x, metric)
    every = len(x) * (len(x) - 1) // 2
    assert found.measured <= every and (kind != "clusters" or found.measured < every / 3), (found.measured, every)


def test_clusters_of_many_edges_equal_those_of_one_task(spark):
    r = random.Random(4)
    samples = spark.createDataFrame([(k,) for k in range(1, 121)], "sample_idx int")
    tree = spark.createDataFrame([(k, r.randrange(1, k), r.random()) for k in range(2, 121)], "j int, i int, d double")
    epsilon = spark.createDataFrame([(0.8,)], "threshold double")
    labels = lambda small: sorted(map(tuple, topology.raw_clusters(samples, tree, epsilon, small).collect()))
    assert labels(10) == labels(1000) and len({c for _, c in labels(10)}) > 5


def test_constant_features_and_metrics(spark):
    same = weighted_vectors(vectors(spark, [[1, 2], [1, 4]]))
    assert all(r["v"][0] == 0 for r in same.collect())
    for metric in ("cityblock", "chebychev", "squaredeuclidean"):
        assert distances(same, metric).first()["d"] == pytest.approx({"cityblock": 2**0.5, "chebychev": 2**0.5, "squaredeuclidean": 2}[metric])
    with pytest.raises(ValueError):
        distances(same, "other")


def run(xs, **config):
    x = np.array(xs, float)
    d = np.abs(x[:, None] - x[None])
    return grouping.Regrouping(d, np.arange(1, len(x) + 1) if config.pop("apart", False) else np.ones(len(x), int), [str(v) for v in xs], TopologyConfig(**config))


def test_regrouping():
    assert run([0, 1, 10, 11, 30], apart=True, merge_singletons=True).labels.tolist() == [1, 1, 2, 2, 2]
    halves = run([0, 1, 10, 11], max_group_size=2)
    assert halves.labels.tolist() == [1, 1, 2, 2] and [e[2] for e in halves.events].count("split") == 1
    stuck = run([0, 1, 2, 30], min_group_size=2, max_group_size=3)  # 3 + 1 is merged straight back until the limit
    assert stuck.labels.tolist() == [1, 1, 1, 1] and [e[2] for e in stuck.events].count("split") == 50
    assert run([0, 1], apart=True, min_group_size=5).labels.tolist() == [1, 1]
    assert halves.reason(0) == "split_large_group:split" and run([0], apart=True).reason(0) == "unchanged"


def test_average_linkage_split():
    x = np.array([0.0, 0.4, 5.0, 5.3, 5.9])
    second, score = grouping.split(np.abs(x[:, None] - x[None]), 1, 3)
    assert second.tolist() == [False, False, True, True, True] and score == 1


def test_steps_say_what_they_moved():
    """Singletons are merged, then the small group they made: those that are joined stay unchanged."""
    x = np.array([0.0, 1.0, 10.0, 11.0, 12.0, 30.0])
    raw = np.array([1, 2, 3, 3, 3, 4])
    done = grouping.Regrouping(np.abs(x[:, None] - x[None]), raw, list("abcdef"), TopologyConfig(merge_singletons=True, min_group_size=3))
    assert [done.reason(i) for i in range(6)] == ["merge_small_group:merge;repair_small_group:merge", "repair_small_group:merge", "unchanged", "unchanged", "unchanged", "merge_small_group:merge"]
    events = [dict(zip([c.split()[0] for c in grouping.EVENT.split(",")], e)) for e in done.events]
    merges = [e for e in events if e["action"] == "merge"]
    assert [(e["affected_ids"], e["raw_groups"], e["groups_before"], e["groups_after"], e["min_size"]) for e in merges] == [
        (["a"], [1], [1], [1], 2), (["f"], [4], [3], [2], 2), (["a", "b"], [1, 2], [1], [1], 3),
    ]
    assert [e["distance_evidence"] for e in merges] == pytest.approx([1, 19, 15.25])
    assert (events[0]["min_size"], events[-1]["affected"], events[-1]["sizes_after"]) == (3, [1, 2, 3, 4, 5, 6], [6])


def test_split_scores_add_up_how_far_sizes_are_out_of_bounds():
    x = np.array([0.0, 0.1, 5.0, 5.1, 5.2, 5.3, 5.4, 5.5])
    d = np.abs(x[:, None] - x[None])
    assert grouping.split(d, 1, 3)[1] == 3_000_004 and grouping.split(d, 4, 6)[1] == 2_000_004
    x = np.array([0.0, 5.0, 5.1, 5.2, 5.3])
    assert grouping.split(np.abs(x[:, None] - x[None]), 3, np.inf)[1] == 2_000_003


def plain_distance(x, a, b, metric):
    """By the definition of the metric, one pair at a time."""
    if metric == "seuclidean":
        sd = x.std(axis=0, ddof=1)
        return math.sqrt(sum(((a[k] - b[k]) / sd[k]) ** 2 for k in range(len(a)) if sd[k] > 0))
    if metric == "mahalanobis":
        return math.sqrt((a - b) @ np.linalg.solve(np.cov(x.T), a - b))
    if metric == "spearman":
        a, b = (np.array([sum(y < v for y in z) + (sum(y == v for y in z) + 1) / 2 for v in z]) for z in (a, b))
    if metric in ("correlation", "spearman"):
        return 1 - np.corrcoef(a, b)[0, 1]
    if metric == "hamming":
        return np.mean(a != b)
    if metric == "jaccard":
        return sum(a != b) / sum((a != 0) | (b != 0))
    p = float(metric.partition(":")[2] or 2)
    return sum(abs(a - b) ** p) ** (1 / p)


def placed_rows(spark, x):
    return spark.createDataFrame([(k + 1, [float(v) for v in row]) for k, row in enumerate(x)], "sample_idx int, v array<double>")


@pytest.mark.parametrize("metric", ["seuclidean", "mahalanobis", "correlation", "spearman", "hamming", "jaccard", "minkowski", "minkowski:1", "minkowski:3"])
def test_metrics_equal_their_definitions(spark, metric):
    """On whole numbers with ties and zeros, in blocks; the tree of one is that of all its pairs."""
    x = np.random.default_rng(5).integers(-2, 4, size=(24, 5)).astype(float)
    x[:, 0] += 1  # away from rows of zeros alone
    x[3], x[3, 0] = x[4], 9
    rows = placed_rows(spark, x)
    got = {(r["i"], r["j"]): r["d"] for r in distances(rows, metric, block=12).collect()}
    assert len(got) == 24 * 23 // 2
    for (i, j), d in got.items():
        assert d == pytest.approx(plain_distance(x, x[i - 1], x[j - 1], metric), abs=1e-9), (i, j)
    if metric != "minkowski:3":
        return
    total = sum(r["d"] for r in tree_module.spanning_tree(rows, metric, block=12).collect())
    best = tree_module.spanning_forest(pd.DataFrame([(i, j, d) for (i, j), d in got.items()], columns=["i", "j", "d"]))
    assert total == pytest.approx(best["d"].sum(), abs=1e-9)


def test_odd_vectors_of_metrics(spark):
    flat = np.array([[1.0, 2, 5], [1, 2, 7], [1, 4, 9], [1, 1, 1]])  # the first coordinate does not vary, the last row neither
    with pytest.raises(ValueError, match="full rank"):
        distances(placed_rows(spark, flat), "mahalanobis")
    found = {(r["i"], r["j"]): r["d"] for r in distances(placed_rows(spark, flat), "seuclidean").collect()}
    assert found[1, 2] == pytest.approx(2 / flat[:, 2].std(ddof=1))
    for metric in ("correlation", "spearman"):
        d = {(r["i"], r["j"]): r["d"] for r in distances(placed_rows(spark, flat), metric).collect()}
        assert math.isnan(d[1, 4]) and not math.isnan(d[1, 2])
    empty = placed_rows(spark, flat).limit(0)
    for metric in ("seuclidean", "mahalanobis", "spearman", "jaccard"):
        assert distances(empty, metric).count() == 0
    for wrong in ("minkowski:0.5", "minkowski:x", "minkowski:inf", "cosine:2"):
        with pytest.raises(ValueError):
            distances(placed_rows(spark, flat), wrong)


def test_analysis_by_a_mapped_metric(spark):
    x = np.random.default_rng(8).normal(size=(12, 3))
    done = analyse_topology(vectors(spark, x), TopologyConfig(metric="mahalanobis", percentile=60))
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    pairs = pd.DataFrame([(i + 1, j + 1, plain_distance(z, z[i], z[j], "mahalanobis")) for i in range(12) for j in range(i + 1, 12)], columns=["i", "j", "d"])
    bars = [r["death"] for r in done.barcode().orderBy("bar").collect()][:-1]
    assert bars == pytest.approx(sorted(tree_module.spanning_forest(pairs)["d"]))
