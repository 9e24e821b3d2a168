"""Exact top-k search by inner product: columnar branch-and-bound over blocks of vectors.

Vectors are dealt to candidate blocks and queries to query blocks by a hash; a task holds one block of each. Within it,
distances grow dimension block by dimension block in a vertical layout (one row of the matrix is one dimension). After
each block, what the remaining dimensions can add at most is bounded by the remaining masses (Cauchy-Schwarz), and only
candidates that can still reach a query's k-th best score stay, compacted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

K = 5
SCALE = 256
EVERY = 50
#: Rows of a candidate block and of a query block, about.
CANDIDATES, QUERIES = 4096, 1024
#: Dimensions that are added before candidates are bounded again.
STEP = 16


def quantised(vector: Column) -> Column:
    """floor(256 x) of each component as long; null for vectors that are null or hold a null, NaN or infinite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return F.when(vector.isNotNull() & ~F.exists(vector, bad), whole)


def top_of_block(ids: np.ndarray, vertical: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, step: int = STEP):
    """(query, vec_id, score) rows: each query's k best of the block (its own row left out), ties to the smaller id.

    ``vertical``: dimensions x candidates, ``queries``: queries x dimensions. Dimensions are taken in the order of the
    candidates' mass, so bounds close early. Float bounds are widened by more than their rounding error.
    """
    mass = (vertical.astype(float) ** 2).sum(axis=1)
    order = np.argsort(-mass, kind="stable")
    vertical, queries = vertical[order], queries[:, order]
    dims = len(vertical)
    cuts = list(range(0, dims, step)) + [dims]
    tail = lambda m: np.sqrt(np.cumsum((m.astype(float) ** 2)[::-1], axis=0)[::-1])
    c_tail, q_tail = np.vstack([tail(vertical), np.zeros(len(ids))]), np.hstack([tail(queries.T).T, np.zeros((len(queries), 1))])
    found = []
    for q in range(len(queries)):
        alive = np.flatnonzero(ids != query_ids[q])
        score = np.zeros(len(alive), dtype=np.int64)
        for a, b in zip(cuts, cuts[1:]):
            score += queries[q, a:b] @ (vertical[a:b] if len(alive) == len(ids) else vertical[a:b, alive])
            if b < dims and len(alive) > k:
                reach = c_tail[b, alive] * q_tail[q, b] * (1 + 1e-9) + 1
                low, high = score - reach, score + reach
                keep = high >= np.partition(low, len(low) - k)[len(low) - k]
                if not keep.all():
                    alive, score = alive[keep], score[keep]
        if len(alive) > k:  # all that reach the k-th score stay for the ties
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            alive, score = alive[keep], score[keep]
        best = np.lexsort((ids[alive], -score))[:k]
        found += [(query_ids[q], ids[alive[i]], score[i]) for i in best]
    return found


def top_k(vectors: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", vector: str = "embedding", candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest inner product for each row with ``is_query``.

    Rows are told apart by their id: a query's own id is no candidate of it, and a repeated row is a candidate as often
    as it is there. An id asked with several vectors asks with the least of them. Null ids and vectors that ``quantised``
    rejects take no part, empty vectors neither; a query meets only vectors of its own length. Fewer candidates than k:
    all of them; an empty table gives no rows. Components beyond 2**26 may overflow. Other columns are not looked at,
    whatever their names.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), quantised(F.col(vector)).alias("v"), is_query.alias("q"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).withColumn("n", F.size("v"))
    total = vectors.count()
    asked = max(1, vectors.where(is_query).count())
    c_blocks, q_blocks = max(1, -(-total // candidates)), max(1, -(-asked // queries))
    deal = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "id", "v"), F.lit(n)).cast("int")
    # a candidate goes to its block once for each query block, a query to its block once for each candidate block
    as_candidate = rows.select("n", deal(1, c_blocks).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"), F.lit(False).alias("q"), "id", "v")
    one = rows.where("q").groupBy("id").agg(F.min("v").alias("v")).withColumn("n", F.size("v"))
    as_query = one.select("n", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"), deal(2, q_blocks).alias("qb"), F.lit(True).alias("q"), "id", "v")

    def search(pdf):
        asked, block = pdf[pdf["q"]], pdf[~pdf["q"]]
        if asked.empty or block.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        vertical = np.ascontiguousarray(np.stack(block["v"].to_list()).astype(np.int64).T)
        found = top_of_block(block["id"].to_numpy(), vertical, np.stack(asked["v"].to_list()).astype(np.int64), asked["id"].to_numpy(), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    local = as_candidate.unionByName(as_query).groupBy("n", "cb", "qb").applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % EVERY == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
