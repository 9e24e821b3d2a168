import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortpanel.operators import families, panel, tree
from cohortpanel.operators.distance import distances, half_up, pairwise, weighted_vectors


def table_of(spark, points):
    return spark.createDataFrame([(k + 1, f"c{k + 1}", [float(x) for x in p]) for k, p in enumerate(points)], "sample_idx int, id string, features array<double>").repartition(3)


def shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_pairs_deal_each_vector_once(spark):
    wrote = []
    for n in (256, 1024):
        rows = distances(weighted_vectors(table_of(spark, np.random.default_rng(n).normal(size=(n, 8)))), block=8)
        before = shuffled(spark)
        assert rows.count() == n * (n - 1) // 2
        wrote.append(shuffled(spark) - before)
    assert wrote[1] < 8 * wrote[0]  # four times the vectors; sixteen times where each goes to every block


@pytest.mark.parametrize("metric, power", [("euclidean", 2), ("minkowski:3", 3), ("minkowski:2.5", 2.5), ("cityblock", 1)])
def test_pairs_over_many_blocks(spark, metric, power):
    points = np.random.default_rng(7).normal(size=(70, 5))
    points[3], points[:, 4] = points[40], 2.0
    z = points - points.mean(0)
    z[:, :4] /= points[:, :4].std(0, ddof=1)
    z[:, 4] = 0
    found = {(r["i"], r["j"]): r["d"] for r in distances(weighted_vectors(table_of(spark, points)), metric, block=9).collect()}
    whole = (np.abs(z[:, None] - z[None]) ** power).sum(-1) ** (1 / power)
    assert found == pytest.approx({(i + 1, j + 1): whole[i, j] for i in range(70) for j in range(i + 1, 70)}) and found[4, 41] == 0


def test_repeated_rows_stay_in_one_task(spark):
    rows = spark.createDataFrame([("s", "ABCDEFGH" + "XY"[k % 2]) for k in range(60)] + [("t", "QRSTUVW")], "file_name string, peptide string")
    made = []
    label, families.components = families.components, lambda edges: made.append(edges) or label(edges)
    try:
        found = {tuple(r) for r in families.peptide_families(rows, 7, small=5).collect()}
    finally:
        families.components = label
    assert found == {("s", "ABCDEFGHX", "ABCDEFGHX"), ("s", "ABCDEFGHY", "ABCDEFGHX"), ("t", "QRSTUVW", "QRSTUVW")}
    assert not made  # two distinct peptides, whatever the number of rows


def test_panels_from_cells(spark):
    some = [("f%d" % (k % 3), k % 3, k, "PEPTIDEA%s" % "KLM"[k % 2], "HLA-A*0%d:01" % (k % 4), float(1 + k % 5)) for k in range(40)]
    rows = spark.createDataFrame(some * 3, "file_name string, file_ordinal int, row_ordinal long, peptide string, mhc string, rank_el double")
    found = panel.cells(rows)
    assert found.count() == len({(r[0], r[3], r[4]) for r in some}) < len(some)
    one = lambda x: sorted(map(tuple, panel.peptide_scores(panel.all_files(x), 10.0).collect()))
    assert one(found) == one(rows)
    items = lambda x: sorted((r["peptide"], r["ordinal"], sorted(r["patients"]), sorted(r["hlas"]), r["binding_score"]) for r in panel.panel_items(panel.all_files(x), 10.0).collect())
    assert items(found) == items(rows)


def test_forest_of_blocks_with_ties():
    draw = np.random.default_rng(0)
    for _ in range(60):
        n, m = draw.integers(1, 20, 2)
        points = draw.integers(0, 4, (n + m, 2)).astype(float)
        numbers = draw.permutation(500)[: n + m]
        left, right = np.sort(numbers[:n]), np.sort(numbers[n:])
        for same in (False, True):
            other, at = (left, points[:n]) if same else (right, points[n:])
            d = pairwise(points[:n], at, "euclidean")
            edges = [(min(a, b), max(a, b), d[x, y]) for x, a in enumerate(left) for y, b in enumerate(other) if not same or a < b]
            whole = tree.spanning_forest(pd.DataFrame(edges, columns=["i", "j", "d"]))
            got = sorted(zip(*(x.tolist() for x in tree.block_forest(left, other, d, same))))
            assert got == sorted(map(tuple, whole.astype(object).to_numpy().tolist()))


@pytest.mark.parametrize("metric", ["euclidean", "minkowski:3"])
def test_pairs_in_order_of_distance(spark, metric):
    """All pairs of large tables, rounded alike, with equal distances beside each other."""
    rows = placed(spark, np.random.default_rng(9).normal(size=(1200, 4)))
    plain = distances(rows, metric, block=140).withColumn("d", F.round("d", 2)).toPandas()
    found = distances(rows, metric, block=140, wide=140, digits=2).toPandas()
    changes = lambda x: int((np.diff(x["d"]) != 0).sum())
    assert changes(found) < len(found) / 10 < len(found) / 2 < changes(plain)
    both = [x.sort_values(["i", "j"]).reset_index(drop=True) for x in (plain, found)]
    assert len(found) == 1200 * 1199 // 2 and both[0].equals(both[1])


def test_rounding_is_that_of_spark(spark):
    r = np.random.default_rng(11)
    x = np.concatenate([r.uniform(0, 30, 3000), r.integers(0, 10**8, 3000) / 1e7, r.integers(0, 10**6, 500) / 64, [0, 5e-7, 1.0000005, 2.5e-7, 1e12, 123456789.1234565, 1e300, np.inf, np.nan]])
    asked = [row[0] for row in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert half_up(x, 6).tolist() == pytest.approx(asked, rel=0, abs=0, nan_ok=True)


def placed(spark, points):
    return spark.createDataFrame([(k + 1, [float(x) for x in p]) for k, p in enumerate(points)], "sample_idx int, v array<double>").repartition(3)


def every_pair(points, metric):
    i, j = np.triu_indices(len(points), 1)
    return pd.DataFrame({"i": i + 1, "j": j + 1, "d": pairwise(points, points, metric)[i, j]})


def rows_of(edges):
    return sorted(map(tuple, edges.astype(object).to_numpy().tolist()))


def test_tree_without_clusters_measures_few_pairs(spark):
    """In many dimensions no block is far from another, yet few pairs of points are within what is known of the tree."""
    points = np.random.default_rng(3).normal(size=(900, 24))
    found = tree.PrunedTree(placed(spark, points), "euclidean", block=16)
    every = every_pair(points, "euclidean")
    assert rows_of(found.tree.toPandas()) == rows_of(tree.spanning_forest(every))
    assert found.measured < len(every) / 20, (found.measured, len(every))


@pytest.mark.parametrize("metric", ["euclidean", "squaredeuclidean"])
@pytest.mark.parametrize("kind", ["ties", "clusters", "far", "huge"])
def test_tree_by_bounds(spark, metric, kind):
    r = np.random.default_rng(4)
    points = {
        "ties": lambda: np.repeat(r.integers(0, 4, size=(70, 2)), 3, axis=0),
        "clusters": lambda: np.concatenate([r.normal(size=(30, 3)) * 0.1 + c for c in r.uniform(-20, 20, size=(7, 3))]),
        "far": lambda: np.concatenate([r.normal(size=(200, 3)), r.normal(size=(3, 3)) * 1e9, np.zeros((7, 3))]),
        "huge": lambda: np.concatenate([r.normal(size=(200, 2)) * 1e-150, r.normal(size=(8, 2)) * 1e200]),  # squares are not finite
    }[kind]().astype(float)
    with np.errstate(over="ignore", invalid="ignore"):
        found = tree.PrunedTree(placed(spark, points), metric, block=4)
        assert rows_of(found.tree.toPandas()) == rows_of(tree.spanning_forest(every_pair(points, metric)))
    assert found.n_blocks > tree.PART


def test_bounds_of_a_tree():
    r = np.random.default_rng(5)
    for _ in range(30):
        n = int(r.integers(2, 40))
        points, numbers, blocks = r.integers(0, 5, (n, 2)).astype(float), r.permutation(500)[:n], r.integers(0, 4, n)
        x, y = tree.short_tree(points)
        edges = pd.DataFrame({"i": numbers[x], "j": numbers[y], "d": tree.outright(points[x], points[y], "euclidean")})
        longest = np.full((n, n), np.inf)
        longest[x, y] = longest[y, x] = edges["d"]
        np.fill_diagonal(longest, 0)
        for k in range(n):
            longest = np.minimum(longest, np.maximum(longest[:, [k]], longest[[k]]))
        found = tree.reached(edges, pd.DataFrame({"sample_idx": numbers, "b": blocks}))
        roots = found[found["place"] >= 0].sort_values("place")
        root = {b: k for k, b in zip(roots.index, roots["b"])}
        assert found["reach"].tolist() == [longest[k, root[b]] for k, b in enumerate(blocks)]
        steps = roots["step"].to_numpy()
        for k, p in enumerate(roots.index):
            assert [steps[k:m].max(initial=0.0) for m in range(k, len(roots))] == longest[p, roots.index[k:]].tolist()


def test_distances_one_by_one_are_those_of_blocks():
    r = np.random.default_rng(6)
    for n in (0, 1, 2, 3, 9, 40):
        for width in (1, 7, 64, 200):
            a, b = r.normal(size=(n, width)), r.normal(size=(n, width))
            for metric in ("euclidean", "squaredeuclidean"):
                assert tree.outright(a, b, metric).tolist() == np.diag(pairwise(a, b, metric)).tolist()
