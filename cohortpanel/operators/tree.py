"""The minimum spanning tree of points in a metric, without measuring all pairs.

1. Points are ordered by their nearest pivot and its distance and cut into blocks, each around one pivot. A block keeps the least and largest
   distance of its points from each pivot, which bounds distances to other blocks from below (triangle inequality).
2. A pair of blocks that is measured leaves its own minimum spanning forest: no other of its pairs is in the tree. No pair
   of blocks is measured twice, and most pairs of a clustered table never.
3. Rounds (Boruvka): each component takes the least edge that leaves it. Known edges bound it from above, so only pairs of
   blocks whose lower bound is within what one of their components has found are measured before. Components are then
   contracted; each round leaves half as many or fewer.

Euclidean distances of many points take a shorter way, as rounds measure all pairs where points have no clusters: a spanning
tree of each part of the points and a few that all parts share bounds every other edge of the whole tree (no edge is longer
than the longest on the path between its ends). A matrix product finds the pairs within that bound, and only these, few of
all, are measured outright, by the metric itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.components import components
from ..functions.lineage import cut, table
from ..functions.placing import numbered
from .distance import PART, faced, packed, pairwise, points_of, whole_batch
from .families import connect
from .metrics import mapped

EDGE = "i int, j int, d double"
#: Points in a block; a task holds two.
BLOCK = 512
#: Points that distances are bounded by, each the farthest from those before among a sample of so many.
PIVOTS, SAMPLE = 32, 1024
#: Metrics with a triangle inequality, by themselves or by way of another whose order is the same: (metric, power).
BOUNDED = {"euclidean": ("euclidean", 1), "squaredeuclidean": ("euclidean", 2), "cityblock": ("cityblock", 1), "chebychev": ("chebychev", 1), "hamming": ("hamming", 1)}
#: Lower bounds are lowered by this share, for rounding.
SLACK = 1e-9
#: Intervals of the first pivot's distances in which pairs of blocks are looked for.
SLICES = 256
#: Edges at which a task merges the forests it has found, and up to which one task finds the forest of all or joins components.
MERGE = 1 << 20
#: Metrics that go by squares, which a matrix product gives but for rounding.
SQUARES = {"euclidean": 2, "squaredeuclidean": 1}
#: Pairs within their bound, for each point of two blocks, from which on the blocks are measured whole.
DENSE = 16


def bounded(metric: str) -> tuple[str, int] | None:
    """The entry of BOUNDED, to which every exponent of minkowski belongs."""
    return (metric, 1) if metric.startswith("minkowski") else BOUNDED.get(metric)


def spanning_forest(edges: pd.DataFrame) -> pd.DataFrame:
    """The minimum spanning forest of edges (i, j, d); equal distances go by i, then j. Boruvka rounds over whole columns."""
    edges = edges.iloc[np.lexsort((edges["j"], edges["i"], edges["d"]))]  # no numbers last
    nodes, codes = np.unique(np.concatenate([edges["i"].to_numpy(), edges["j"].to_numpy()]), return_inverse=True)
    x, y, place, take = codes[: len(edges)], codes[len(edges) :], np.arange(len(edges)), []
    least, away = np.empty(len(nodes), np.int64), np.empty(len(nodes), np.int64)
    while len(place := place[open_ := x != y]):
        x, y = x[open_], y[open_]
        least[:] = len(edges)
        for ends, others in ((x, y), (y, x)):  # the first edge of each component is written last
            first = np.full(len(nodes), len(place))
            first[ends[::-1]] = np.arange(len(place))[::-1]
            has = np.flatnonzero(first < len(place))
            has = has[place[first[has]] < least[has]]
            least[has], away[has] = place[first[has]], others[first[has]]
        joined = least < len(edges)
        parent = np.where(joined, away, np.arange(len(nodes)))
        both = joined & (parent[parent] == np.arange(len(nodes))) & (parent > np.arange(len(nodes)))  # two that chose the same edge
        parent[both] = np.flatnonzero(both)
        take.append(np.unique(least[joined]))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        x, y = parent[x], parent[y]
    return edges.iloc[np.sort(np.concatenate(take)) if take else []]


def block_forest(left: np.ndarray, right: np.ndarray, d: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The minimum spanning forest (i, j, d) of all pairs of two blocks, or of one with itself; numbers ascend, d is (left,
    right). Boruvka rounds over the matrix: as numbers ascend, the first least entry of a row or column is the least by
    d, i, j too. Distances that are no numbers, or not finite, go by the edges' order as everywhere."""
    if not np.isfinite(d).all():
        i, j = np.broadcast_to(left[:, None], d.shape), np.broadcast_to(right[None, :], d.shape)
        keep = i < j if same else np.ones(d.shape, bool)
        found = spanning_forest(pd.DataFrame({"i": np.minimum(i, j)[keep], "j": np.maximum(i, j)[keep], "d": d[keep]}))
        return found["i"].to_numpy(), found["j"].to_numpy(), found["d"].to_numpy()
    n, m = d.shape
    x_of, y_of = np.arange(n), np.arange(m) + (0 if same else n)
    numbers = left if same else np.concatenate([left, right])
    root, d, out = np.arange(len(numbers)), d.copy(), []
    while True:
        d[root[x_of][:, None] == root[y_of][None, :]] = np.inf
        to, least = d.argmin(axis=1), d.min(axis=1)
        a, b, least = x_of, y_of[to], least
        if not same:
            back = d.argmin(axis=0)
            a, b, least = np.concatenate([a, x_of[back]]), np.concatenate([b, y_of]), np.concatenate([least, d[back, np.arange(m)]])
        open_ = np.isfinite(least)
        a, b, least = a[open_], b[open_], least[open_]
        if not len(a):
            break
        i, j = np.minimum(numbers[a], numbers[b]), np.maximum(numbers[a], numbers[b])
        order = np.lexsort((j, i, least))
        taken = set()
        for ends in (root[a], root[b]):  # the least edge of each component, whichever end it has there
            taken.update(order[np.unique(ends[order], return_index=True)[1]].tolist())
        best: dict[int, int] = {}
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        for k in taken:
            for r in (int(root[a[k]]), int(root[b[k]])):
                if r not in best or place[k] < place[best[r]]:
                    best[r] = k
        parent = np.arange(len(numbers))

        def end(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for k in sorted(set(best.values()), key=lambda k: place[k]):
            x, y = end(int(root[a[k]])), end(int(root[b[k]]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((i[k], j[k], least[k]))
        root = np.array([end(int(x)) for x in root])
    i, j, d = zip(*out) if out else ((), (), ())
    return np.array(i, np.int64), np.array(j, np.int64), np.array(d, float)


def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The forest of the edges of several ones."""
    i, j, d = (np.concatenate(x) for x in zip(*parts))
    found = spanning_forest(pd.DataFrame({"i": i, "j": j, "d": d}))
    return found["i"].to_numpy(), found["j"].to_numpy(), found["d"].to_numpy()


def reached(edges: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
    """(sample_idx, b, reach, place, step) of points (sample_idx, b), all of which the edges connect: how long the longest edge is
    on the path to the root of the point's block, in the spanning tree of the edges. Roots have places, so that the longest
    edge between two of them is the longest of the steps from the one to the next, from the first place to the second's.

    Components are strung together as they join, so the longest edge between two points is the longest step between their
    places on the string."""
    edges = edges.sort_values(["d", "i", "j"], kind="stable")
    numbers = np.unique(points["sample_idx"].to_numpy())
    n = len(numbers)
    x_of, y_of = np.searchsorted(numbers, edges["i"].to_numpy()).tolist(), np.searchsorted(numbers, edges["j"].to_numpy()).tolist()
    parent, last, after, length = list(range(n)), list(range(n)), [-1] * n, [np.inf] * n  # a component's root is its first point
    for x, y, d in zip(x_of, y_of, edges["d"].tolist()):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[y], after[last[x]], length[last[x]], last[x] = x, y, d, last[y]
    k, order = 0, [0] * n
    while parent[k] != k:
        k = parent[k]
    for at in range(n):
        order[at], k = k, after[k]
    order, place = np.array(order), np.empty(n, np.int64)
    place[order] = np.arange(n)
    steps = np.array(length)[order]
    steps[np.isnan(steps)] = np.inf
    place = place[np.searchsorted(numbers, points["sample_idx"].to_numpy())]
    reach, root = np.zeros(len(place)), np.zeros(len(place), bool)
    for rows in points.groupby("b").indices.values():
        rows = rows[np.argsort(place[rows])]
        between = np.maximum.reduceat(steps, place[rows])[:-1]
        far = np.zeros((len(rows), len(rows)))
        for k in range(len(rows) - 1):
            far[k, k + 1 :] = np.maximum.accumulate(between[k:])
        far += far.T
        best = int(far.sum(axis=1).argmin())
        reach[rows], root[rows[best]] = far[best], True
    roots = np.flatnonzero(root)[np.argsort(place[root])]
    step = np.full(len(place), np.inf)
    step[roots] = np.maximum.reduceat(steps, place[roots])
    return pd.DataFrame({"sample_idx": points["sample_idx"], "b": points["b"], "reach": reach, "place": np.where(root, place, -1), "step": step})


def short_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of a spanning tree's edges, near to the least by Euclidean distances (Prim, in single precision)."""
    x = ((v - v.mean(axis=0)) / (np.abs(v).max() or 1.0)).astype(np.float32)
    norm = (x * x).sum(axis=1)
    best, come, outside = np.full(len(x), np.inf, np.float32), np.zeros(len(x), np.int64), np.ones(len(x), bool)
    new = 0
    for _ in range(len(x) - 1):
        outside[new], best[new] = False, np.inf
        gap = np.maximum(norm + norm[new] - 2 * (x @ x[new]), 0)
        nearer = (gap < best) & outside
        best[nearer], come[nearer] = gap[nearer], new
        new = int(best.argmin())
        if not np.isfinite(best[new]):
            break  # what is left hangs on the first point
    return come[1:], np.arange(1, len(x))


def outright(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """The distances of rows of a from those of b, one by one: the numbers that ``pairwise`` gives."""
    gap = np.ascontiguousarray((a - b).T if len(a) != 1 else np.repeat(a - b, 2, axis=0).T)  # a single row would be summed in another order
    total = np.add.reduce(gap * gap, axis=0)[: len(a)]  # one coordinate after the other, as there
    return np.sqrt(total) if metric == "euclidean" else total


def raised(v: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Left and right factors of a product that gives squares of distances, lowered by more than its rounding in single
    precision: each of the terms is at most the norms' sum, and their errors at most their number times as much."""
    x = v / scale
    norm = (x * x).sum(axis=1)
    low, one = norm * (1 - 4 * (v.shape[1] + 16) * 2.0**-24) - 2.0**-100, np.ones(len(v))
    return np.column_stack([-2 * x, low, one]).astype(np.float32), np.column_stack([x, one, low]).astype(np.float32)


class Block:
    """The points of a block in the order of their numbers, with their reach, as factors and bounds."""

    def __init__(self, b: int, numbers: np.ndarray, v: np.ndarray, reach: np.ndarray, scale: float, power: int):
        self.b, self.numbers, self.v = b, numbers, v
        self.finite = bool(np.isfinite(v).all())
        self.left, self.right = raised(v, scale) if self.finite else (v, v)
        self.scale, self.power, self.most = scale, power, float(reach.max())
        self.limit = self.squared(reach)

    def squared(self, d: np.ndarray | float) -> np.ndarray:
        """The square of a bound, in the factors' scale and rounded up."""
        root = np.asarray(d, float) * (1 + SLACK) if self.power == 2 else np.sqrt(np.asarray(d, float)) * (1 + SLACK)
        with np.errstate(over="ignore", invalid="ignore"):
            return np.nextafter(((root / self.scale) ** 2).astype(np.float32), np.float32(np.inf))

    def within(self, other: Block, between: float, metric: str, scratch: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """All pairs (i, j, d) of both blocks, or of one with itself, that are within their bound, or their forest if they are
        very many, and how many were measured. ``scratch``: single precision, a number a pair each."""
        same, near = self.b == other.b, None
        if self.finite and other.finite:
            shape = len(self.v), len(other.v)
            square, upto = (x[: shape[0] * shape[1]].reshape(shape) for x in scratch)
            np.matmul(self.left, other.right.T, out=square)
            np.maximum(np.maximum(self.limit, self.squared(between))[:, None], other.limit[None, :], out=upto)
            near = square <= upto
            x, y = np.divmod(np.flatnonzero(np.triu(near, 1) if same else near), shape[1])
        if near is None or len(x) > DENSE * (len(self.v) + len(other.v)):
            every = len(self.v) * (len(self.v) - 1) // 2 if same else len(self.v) * len(other.v)
            return *block_forest(self.numbers, other.numbers, pairwise(self.v, other.v, metric), same), every
        i, j = self.numbers[x], other.numbers[y]
        return np.minimum(i, j), np.maximum(i, j), outright(self.v[x], other.v[y], metric), len(x)


def _points(column, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks, numbers and vectors of a part, by their numbers."""
    numbers, v = points_of(column, row)
    points = column[row].values
    order = np.argsort(points.field("sample_idx").to_numpy(), kind="stable")
    return points.field("b").to_numpy()[order], numbers, v


def gathered(forests: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The edges of several forests, without those that aren't in the forest of all, as far as MERGE edges show it."""
    held, n = [], 0
    for one in forests:
        held.append(one)
        n += len(one[0])
        if n > MERGE:
            held = [merged(held)]
            if len(held[0][0]) > MERGE // 2:
                yield whole_batch(*held.pop())
            n = sum(len(h[0]) for h in held)
    if held:
        yield whole_batch(*merged(held))


def _reaches(column: pa.ListArray, row: int) -> np.ndarray:
    points = column[row].values
    return points.field("reach").to_numpy()[np.argsort(points.field("sample_idx").to_numpy(), kind="stable")]


def _stacked(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["v"].to_list())


def _apart(points: np.ndarray, metric: str, n: int) -> np.ndarray:
    """Up to n of the points, the first and then always the farthest from those taken."""
    taken, off = [0], pairwise(points, points[:1], metric)[:, 0]
    while len(taken) < n and off.max() > 0:
        taken.append(int(off.argmax()))
        off = np.minimum(off, pairwise(points, points[taken[-1:]], metric)[:, 0])
    return points[taken]


class PrunedTree:
    """The tree of (sample_idx, v) and how it was found: ``tree`` (i, j, d), ``measured``, how many pairs of points were,
    without those that a product alone has ruled out."""

    def __init__(self, vectors: DataFrame, metric: str = "euclidean", block: int = BLOCK, pivots: int = PIVOTS):
        vectors, metric = mapped(vectors, metric)
        self.metric, self.block = metric, block
        self.blocks = self._placed(vectors, pivots)
        self.sizes = table(self.blocks.groupBy("b").agg(F.count("*").alias("n")))
        self.n_blocks, self.measured = self.sizes.count(), 0
        if self.metric in SQUARES and self.n_blocks > PART and self.n <= MERGE:
            self.tree = self._within()
            return
        self.packed = packed(self.blocks, self.n_blocks)
        own = self.sizes.select(F.col("b").alias("p"), F.col("b").alias("q"))
        self.known = self._measure(own)
        self.tree = self.known if self.n_blocks <= 1 else self._rounds()

    def _placed(self, vectors: DataFrame, pivots: int) -> DataFrame:
        """(sample_idx, v, near, b): ``near`` are the distances from the pivots, a few rows of the table."""
        n = self.n = vectors.count()
        own, pivots = bounded(self.metric) if n > self.block else None, min(pivots, -(-n // self.block) * 2)
        sample = vectors.orderBy(F.xxhash64("sample_idx"), "sample_idx").limit(SAMPLE).collect() if own else []  # SAMPLE rows
        points = _apart(np.array([r["v"] for r in sample], dtype=float), own[0], pivots) if sample else None
        self.width = 0 if points is None else len(points)
        few = sample[: self.block]
        self.shared = np.array([r["sample_idx"] for r in few], np.int32), np.array([r["v"] for r in few], float)

        def measured(batches):
            for pdf in batches:
                near = pairwise(_stacked(pdf), points, own[0]) if points is not None and len(pdf) else np.zeros((len(pdf), 0))
                best = near.argmin(axis=1) if near.shape[1] else np.zeros(len(pdf), int)
                yield pd.DataFrame({"sample_idx": pdf["sample_idx"], "v": pdf["v"], "near": list(near), "_pivot": best, "_off": near[np.arange(len(pdf)), best] if near.shape[1] else np.zeros(len(pdf))})

        placed = vectors.select("sample_idx", "v").mapInPandas(measured, "sample_idx int, v array<double>, near array<double>, _pivot int, _off double")
        placed = table(numbered(placed, "_place", "_pivot", "_off", "sample_idx", first=0))
        begins = placed.groupBy("_pivot").agg(F.min("_place").alias("_first"), F.ceil(F.count("*") / self.block).alias("_n")).orderBy("_pivot").collect()  # a row a pivot
        before = np.cumsum([0] + [r["_n"] for r in begins]).tolist()
        firsts = F.broadcast(vectors.sparkSession.createDataFrame([(r["_pivot"], r["_first"], int(k)) for r, k in zip(begins, before)], "_pivot int, _first long, _blocks int"))
        number = F.col("_blocks") + F.floor((F.col("_place") - F.col("_first")) / self.block)
        return table(placed.join(firsts, "_pivot").select("sample_idx", "v", "near", number.cast("int").alias("b")))

    def _measure(self, pairs: DataFrame) -> DataFrame:
        """Forests (i, j, d) of pairs of blocks (p <= q); no more than the points of two blocks leave a task."""
        pairs = table(pairs)
        weigh = pairs.join(self.sizes.select(F.col("b").alias("p"), F.col("n").alias("np")), "p").join(self.sizes.select(F.col("b").alias("q"), F.col("n").alias("nq")), "q")
        some = F.when(F.col("p") == F.col("q"), F.col("np") * (F.col("np") - 1) / 2).otherwise(F.col("np") * F.col("nq"))
        self.measured += int(weigh.agg(F.sum(some)).first()[0] or 0)
        metric = self.metric
        wanted = pairs.groupBy("p").agg(F.collect_set("q").alias("qs"))
        left = self.packed.toDF("p", "left").join(F.broadcast(wanted), "p")  # as many numbers as pairs of blocks
        met = faced(left, self.packed.toDF("q", "right"), F.array_contains("qs", F.col("q"))).select("p", "q", "left", "right")

        def forests(batches):
            for batch in batches:
                for row, (p, q) in enumerate(zip(batch["p"].to_pylist(), batch["q"].to_pylist())):
                    (i, a), (j, b) = points_of(batch["left"], row), points_of(batch["right"], row)
                    yield block_forest(i, j, pairwise(a, b, metric), p == q)

        return table(met.mapInArrow(lambda batches: gathered(forests(batches)), EDGE))

    def _within(self) -> DataFrame:
        """The tree by bounds from the spanning trees of parts, each of PART blocks, with the shared points; one task holds the
        edges of one tree."""
        metric, n_parts, (shared, among) = self.metric, -(-self.n_blocks // PART), self.shared
        part = F.floor(F.col("b") / PART).cast("int").alias("part")
        points = self.blocks.select(part, F.struct("b", "sample_idx", "v").alias("point")).repartition(n_parts, "part")
        parts = cut(points.groupBy("part").agg(F.collect_list("point").alias("points")))

        def trees(batches):
            for batch in batches:
                for row in range(batch.num_rows):
                    _, numbers, v = _points(batch["points"], row)
                    more = ~np.isin(shared, numbers)
                    numbers, v = np.concatenate([shared[more], numbers]), np.concatenate([among[more], v])
                    x, y = short_tree(v)
                    yield whole_batch(np.minimum(numbers[x], numbers[y]), np.maximum(numbers[x], numbers[y]), outright(v[x], v[y], metric))

        first = table(parts.select("points").mapInArrow(trees, EDGE))
        one = lambda df: df.withColumn("_all", F.lit(0)).groupBy("_all")
        bounds = one(first).cogroup(one(self.blocks.select("sample_idx", "b"))).applyInPandas(reached, "sample_idx int, b int, reach double, place long, step double")
        bounds = table(bounds)
        roots = bounds.where("place >= 0").orderBy("place").select("b", "step").collect()  # a row a block
        rank, steps = {r["b"]: k for k, r in enumerate(roots)}, np.array([r["step"] for r in roots])
        ends = {r["b"]: (np.array(r["low"]), np.array(r["high"])) for r in self._summaries().collect()}  # a row a block
        reaches = bounds.groupBy(part).agg(F.collect_list(F.struct("sample_idx", "reach")).alias("reaches"))
        sides = parts.join(F.broadcast(reaches), "part")  # a number a point, MERGE at most
        met = faced(sides.toDF("p", "left", "left_reaches"), sides.toDF("q", "right", "right_reaches"), F.col("p") <= F.col("q"))
        power, n_pairs, looked = bounded(metric)[1], self.block**2, self.blocks.sparkSession.sparkContext.accumulator(0)

        def apart(a: Block, b: Block) -> float:
            (low, high), (other_low, other_high) = ends[a.b], ends[b.b]
            return float((np.maximum(low - other_high, other_low - high) - (high + other_high) * SLACK).max(initial=0.0)) ** power * (1 - SLACK)

        def near(batches):
            scratch = np.empty(n_pairs, np.float32), np.empty(n_pairs, np.float32)
            for batch in batches:
                for row in range(batch.num_rows):
                    sides = [_points(batch[c], row) + (_reaches(batch[f"{c}_reaches"], row),) for c in ("left", "right")]
                    scale = float(max(np.abs(v).max(initial=0.0) * v.shape[1] ** 0.5 for _, _, v, _ in sides)) or 1.0
                    left, right = ([Block(int(k), numbers[b == k], v[b == k], reach[b == k], scale, SQUARES[metric]) for k in np.unique(b)] for b, numbers, v, reach in sides)
                    for a in left:
                        for b in right:
                            first, last = sorted((rank[a.b], rank[b.b]))
                            between = float(steps[first:last].max(initial=0.0))
                            if a.b <= b.b and not apart(a, b) > max(a.most, b.most, between):
                                i, j, d, n = a.within(b, between, metric, scratch)
                                looked.add(n)
                                yield i, j, d

        found = table(met.mapInArrow(lambda batches: gathered(near(batches)), EDGE))
        self.measured = looked.value + first.count()
        return _tree(found.unionByName(first))

    def _summaries(self) -> DataFrame:
        """(b, low, high): distances of each block's points from the pivots."""
        if not self.width:
            return self.blocks.select("b").distinct().withColumns({"low": F.array().cast("array<double>"), "high": F.array().cast("array<double>")})
        ends = self.blocks.select("b", F.posexplode("near").alias("k", "x")).groupBy("b", "k").agg(F.min("x").alias("low"), F.max("x").alias("high"))
        rows = ends.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("k", "low", "high"))).alias("e"))  # a row a pivot
        return rows.select("b", F.transform("e", lambda x: x["low"]).alias("low"), F.transform("e", lambda x: x["high"]).alias("high"))

    def _wanted(self, summaries: DataFrame, labels: DataFrame, best: DataFrame, done: DataFrame) -> DataFrame:
        """Pairs of blocks that are not measured yet and may hold an edge within what one of their components has found.

        They are looked for along the first pivot: a block reaches as far beyond its interval as its components' bounds.
        """
        at = self.blocks.select("sample_idx", "b").join(labels, "sample_idx").join(best.select("root", F.col("e.d").alias("upto")), "root", "left")
        reach = at.groupBy("b").agg(F.max(F.coalesce("upto", F.lit(float("inf")))).alias("reach"), F.min("root").alias("one"), F.max("root").alias("other"))
        metric = bounded(self.metric)
        reach = table(summaries.join(reach, "b").withColumn("single", F.when(F.col("one") == F.col("other"), F.col("one"))).withColumn("reach", F.pow("reach", F.lit(1.0 / metric[1])) if metric else F.col("reach")))
        if metric:
            line = reach.agg(F.min(F.get("low", F.lit(0))).alias("a"), F.max(F.get("high", F.lit(0))).alias("z")).first()
            step = ((line["z"] - line["a"]) or 1.0) / SLICES
            slice_of = lambda c: F.greatest(F.lit(0), F.least(F.lit(SLICES), F.floor((c - line["a"]) / step))).cast("int")
            low, high = F.get("low", F.lit(0)), F.get("high", F.lit(0))
            beyond = F.col("reach") * (1 + SLACK) + abs(line["z"]) * SLACK
            far = reach.withColumn("at", slice_of(low - beyond)).withColumn("s", F.explode(F.sequence("at", slice_of(F.least(high + beyond, F.lit(line["z"]))))))
            near = reach.withColumn("at", slice_of(low)).withColumn("s", F.explode(F.sequence("at", slice_of(high))))
        else:
            far = near = reach.withColumn("s", F.lit(0)).withColumn("at", F.lit(0))
        a = far.select("s", *[F.col(c).alias(f"a_{c}") for c in ("b", "low", "high", "reach", "single", "at")])
        z = near.select("s", *[F.col(c).alias(f"z_{c}") for c in ("b", "low", "high", "single", "at")])
        apart = F.aggregate(
            F.zip_with(F.arrays_zip(F.col("a_low"), F.col("a_high")), F.arrays_zip(F.col("z_low"), F.col("z_high")), lambda x, y: F.greatest(x["a_low"] - y["z_high"], y["z_low"] - x["a_high"])), F.lit(0.0), lambda m, x: F.greatest(m, x)
        )
        # a pair meets in the first slice that both have, and in no other
        pairs = a.join(z, "s").where((F.col("s") == F.greatest("a_at", "z_at")) & (F.col("a_b") != F.col("z_b")) & ~F.coalesce(F.col("a_single") == F.col("z_single"), F.lit(False)))
        pairs = pairs.select(F.least("a_b", "z_b").alias("p"), F.greatest("a_b", "z_b").alias("q"), (apart * (1 - SLACK)).alias("apart"), "a_reach", "a_single").join(done, ["p", "q"], "left_anti")
        within = pairs.where("apart <= a_reach AND a_reach < double('inf')").select("p", "q")
        # a component without any known edge starts with the pair that is nearest by its bound
        nearest = pairs.where("a_reach = double('inf')").groupBy("a_single").agg(F.min(F.struct("apart", "p", "q")).alias("x")).select("x.p", "x.q")
        return table(within.unionByName(nearest).distinct())

    def _rounds(self) -> DataFrame:
        points = self.blocks.select("sample_idx")
        labels = table(points.withColumn("root", F.col("sample_idx")))
        tree = self.known.limit(0)
        done = table(self.sizes.select(F.col("b").alias("p"), F.col("b").alias("q")))
        summaries = table(self._summaries())
        while True:
            if done.count() == self.n_blocks * (self.n_blocks + 1) // 2 and self.known.limit(MERGE + 1).count() <= MERGE:
                # no pair is left to measure: the rest of the tree is that of the known edges between components
                rest = _between(self.known, labels)
                return table(tree.unionByName(_forest_between(rest)))
            best = table(_least(_between(self.known, labels)))
            wanted = self._wanted(summaries, labels, best, done)
            if wanted.limit(1).count():
                self.known = table(self.known.unionByName(self._measure(wanted)))
                done = table(done.unionByName(wanted))
                continue
            if not best.limit(1).count():
                return tree
            picked = table(best.select("e.i", "e.j", "e.d", "e.ri", "e.rj").distinct())
            tree = table(tree.unionByName(picked.select("i", "j", "d")))
            ends = picked.select(F.col("ri").alias("a"), F.col("rj").alias("b"))
            joined = _joined(ends) if ends.limit(MERGE + 1).count() <= MERGE else components(ends)
            labels = table(labels.join(joined.select(F.col("node").alias("root"), F.col("root").alias("_new")), "root", "left").select("sample_idx", F.coalesce("_new", "root").alias("root")))
            # edges within a component are never taken, so they are dropped
            self.known = table(_between(self.known, labels).select("i", "j", "d"))


def _between(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with the components of both ends, where these differ."""
    left, right = labels.select(F.col("sample_idx").alias("i"), F.col("root").alias("ri")), labels.select(F.col("sample_idx").alias("j"), F.col("root").alias("rj"))
    return edges.join(left, "i").join(right, "j").where("ri <> rj").select("i", "j", "d", "ri", "rj")


def _forest_between(edges: DataFrame) -> DataFrame:
    """The minimum spanning forest (i, j, d) of edges between components, in one task; MERGE edges at most."""

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["d", "i", "j"], kind="stable")  # no numbers last
        taken = spanning_forest(pd.DataFrame({"i": pdf["ri"].to_numpy(), "j": pdf["rj"].to_numpy(), "d": np.arange(len(pdf))}))
        return pdf.iloc[taken["d"].to_numpy()][["i", "j", "d"]]

    return edges.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(forest, EDGE).withColumn("d", F.coalesce("d", F.lit(float("nan"))))


def _tree(edges: DataFrame) -> DataFrame:
    """The minimum spanning tree (i, j, d) of edges between MERGE points at most. Tasks see twice as many edges at once, and leave
    less than half of them, until one sees all."""
    edges = table(edges)
    while (n := edges.count()) > 2 * MERGE:
        forest = lambda batches: gathered((b["i"].to_numpy(), b["j"].to_numpy(), b["d"].to_numpy()) for b in batches)
        edges = table(edges.repartition(-(-n // (2 * MERGE))).mapInArrow(forest, EDGE))
    return table(edges.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda pdf: spanning_forest(pdf)[["i", "j", "d"]], EDGE).withColumn("d", F.coalesce("d", F.lit(float("nan")))))


def _joined(edges: DataFrame) -> DataFrame:
    """(node, root): components of edges (a, b), in one task; MERGE edges at most."""

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, codes = np.unique(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]), return_inverse=True)
        return pd.DataFrame({"node": nodes, "root": nodes[connect(codes[: len(pdf)], codes[len(pdf) :])]})

    return edges.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(label, "node int, root int")


def _least(crossing: DataFrame) -> DataFrame:
    """(root, e): the least edge that leaves each component, by d, i, j."""
    edge = F.struct("d", "i", "j", "ri", "rj")
    return crossing.select(F.explode(F.array("ri", "rj")).alias("root"), edge.alias("e")).groupBy("root").agg(F.min("e").alias("e"))


def spanning_tree(vectors: DataFrame, metric: str = "euclidean", block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(i, j, d) of the minimum spanning tree of (sample_idx, v); equal distances go by i, then j. Metrics without a bound
    (cosine, jaccard, correlation, spearman) measure all pairs of blocks, once. A distance that is no number is taken last."""
    return PrunedTree(vectors, metric, block, pivots).tree

