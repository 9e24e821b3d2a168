"""Mixing sources to target weights by capped water-filling, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_broadcast, checkpointed, table, word_array

MAX_EPOCHS = 3
WEIGHTS = (1.0, 2.0, 3.0)
#: Documents that one ordered run of a source holds about; hot sources are split into many runs.
RUN_ROWS = 4096
#: Source tables up to this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def ranked(sources: DataFrame, key: str) -> DataFrame:
    """Add ``rank`` (from 0) in code-point order, null last, without sorting in one task.

    A range sort numbers rows within partitions; only the partitions' row counts meet in one window.
    """
    placed = checkpointed(
        sources.orderBy(F.col(key).asc_nulls_last())
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", 33))
        .withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_before") + F.col("_at")).drop("_id", "_part", "_at", "_before")


def water_fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Targets for rows (source, source_size, weight), as ``target``.

    Each round shares what clamped sources leave by weight among the others, clamps those that would go above
    ``max_epochs * source_size``, and ends when none does. The driver sees one row of totals a round.
    A source of weight 0 or null gets nothing unless it is clamped at 0 already; without any size every target is 0.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    weight = F.greatest(F.coalesce(F.col("weight"), F.lit(0.0)), F.lit(0.0))
    state = checkpointed(sources.withColumn("_w", weight).withColumn("_cap", cap).withColumn("_full", F.col("source_size") == 0))
    while True:
        totals = state.agg(
            F.sum("source_size").alias("all"),
            F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))), F.lit(0.0)).alias("used"),
            F.coalesce(F.sum(F.when(~F.col("_full"), F.col("_w"))), F.lit(0.0)).alias("open"),
        ).first()
        level = max(0.0, (totals["all"] or 0) - totals["used"]) / totals["open"] if totals["open"] else 0.0
        over = ~F.col("_full") & (F.col("_w") * F.lit(level) > F.col("_cap"))
        if state.where(over).limit(1).count() == 0:
            break
        state = checkpointed(state.withColumn("_full", F.col("_full") | over))
    return state.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * F.lit(level))).drop("_w", "_cap", "_full")


def seeded(key: Column, seed: int) -> Column:
    """A number from 0 to 2**60 that depends on the key and the seed alone, so reruns agree: digits of an MD5 sum."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key, F.lit("null"))).cast("binary")), 1, 15), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    size: Column,
    key: str = "doc_id",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    max_epochs: float = MAX_EPOCHS,
    seed: int = 7,
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words the mix takes of the document, repeats counted).

    Sources in code-point order (null last, a source of its own) weigh ``weights``, repeating. Every document of a
    source is taken ``floor(target / source_size)`` times whole. The rest of the epoch is sampled: within runs of
    about ``run_rows`` documents, in seeded order, whole documents are taken until the run's share is met; only the
    document at the edge is taken in part. So a source's taken words differ from its target by less than one word a
    run. Runs split a hot source over many tasks.

    Null keys and repeated rows: each row counts by itself; the size breaks ties, and equal rows are alike.
    Null sizes count 0. An empty table gives an empty result. Columns of docs are kept, but those named size,
    source_size, target or taken are replaced.
    """
    sized = docs.drop("source_size", "target", "taken").withColumn("size", F.coalesce(size, F.lit(0)).cast("long"))
    stats = sized.groupBy(F.col(source).alias("_source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    stats = ranked(stats, "_source").withColumn("weight", F.get(cycle, (F.col("rank") % len(weights)).cast("int")))
    plan = checkpointed(water_fill(stats, max_epochs).select("_source", "source_size", "target", "_rows"))
    sized = sized.drop("_source", "_rows", "_epochs", "_order", "_run", "_before", "_run_size")
    joined = sized.join(bounded_broadcast(plan, BROADCAST_SOURCES), F.col(source).eqNullSafe(F.col("_source")), "left")
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    order = seeded(F.col(key).cast("string"), seed)
    run = seeded(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("null")), "size"), seed + 1) % F.ceil(F.col("_rows") / run_rows)
    runs = Window.partitionBy("_source", "_run").orderBy("_order", "size", key)
    joined = joined.withColumn("_epochs", epochs).withColumn("_order", order).withColumn("_run", run)
    before = F.coalesce(F.sum("size").over(runs.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("size").over(Window.partitionBy("_source", "_run"))
    joined = joined.withColumn("_before", before).withColumn("_run_size", whole)
    times = F.floor("_epochs")
    share = F.round((F.col("_epochs") - times) * F.col("_run_size"))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), share - F.col("_before")))
    return joined.withColumn("taken", (times * F.col("size") + extra).cast("long")).drop("_source", "_rows", "_epochs", "_order", "_run", "_before", "_run_size")


def repeated(mixed: DataFrame, text: str = "text") -> DataFrame:
    """One row for each whole repetition that ``mix`` decided, and one for the part of an epoch, cut after its last word.

    Documents without words are repeated as often as their source is taken whole; of a part of an epoch they have no share.
    """
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(epochs).cast("int")
    words = F.slice(word_array(F.col(text)), 1, F.greatest(part, F.lit(1)).cast("int"))
    cut = F.when(part > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))
    return mixed.withColumn(text, F.explode(F.concat(F.array_repeat(F.col(text), whole), cut)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.size(word_array(F.col("text"))).alias("_size"))
    return mix(docs, F.col("_size")).select("doc_id", "size", "source_size", "target", "taken")


#: Sources of no size are full from the start; each round clamps what is above, as many rounds as there are sources at most.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '')) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS total, count(*) AS n, CAST(1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS DOUBLE) AS w FROM d GROUP BY source
), f AS (
  SELECT 0 AS k, source, total, n, w, total = 0 AS sated FROM s
  UNION ALL
  SELECT k + 1, source, total, n, w, sated OR w * level > 3 * total FROM (
    SELECT *, greatest(0.0, sum(total) OVER () - sum(CASE WHEN sated THEN 3 * total ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN sated THEN 0 ELSE w END) OVER (), 0) AS level
    FROM f WHERE k < (SELECT count(*) FROM s)
  )
), t AS (
  SELECT source, total, n, CASE WHEN sated THEN 3 * total ELSE w * (greatest(0.0, sum(total) OVER () - sum(CASE WHEN sated THEN 3 * total ELSE 0 END) OVER ()) / sum(CASE WHEN sated THEN 0 ELSE w END) OVER ()) END AS target
  FROM f WHERE k = (SELECT max(k) FROM f)
), r AS (
  SELECT d.doc_id, d.size, t.*, CASE WHEN total > 0 THEN target / total ELSE 0 END AS epochs,
         CAST('0x' || md5('7:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null'))[1:15] AS BIGINT) AS ord,
         CAST('0x' || md5('8:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || d.size)[1:15] AS BIGINT) % CAST(ceil(n / 4096.0) AS BIGINT) AS run
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, run ORDER BY ord, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior, sum(size) OVER (PARTITION BY source, run) AS run_size FROM r
)
SELECT doc_id, size, CAST(total AS BIGINT) AS source_size, target,
       CAST(floor(epochs) * size + greatest(0, least(size, round((epochs - floor(epochs)) * run_size) - prior)) AS BIGINT) AS taken
FROM p
"""
