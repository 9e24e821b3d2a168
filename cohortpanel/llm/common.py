"""What the training-data operators share: tables, checkpoints and native text measures."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words in every contract of this package.
SPACE = "\t\n\x0b\x0c\r "
#: Bytes of text that a Python task works on at once, about; Spark bounds the batches that it gets by bytes too.
TEXT_BYTES = 4 << 20
#: Bytes of an Arrow batch where tasks hold much beside it.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``. Where none is named, a session within one process
    (tests) gets one of its own; on a cluster that is an error, as executors would not share it."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cohortpanel-ckpt-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the folder the cluster names in ``spark.checkpoint.dir``."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder name below the shared checkpoint folder, for tables and archives written between jobs."""
    return f"{_checkpoint_folder(spark)}/{spark.sql('SELECT uuid()').first()[0]}"


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage by a compressed table in the shared folder, where rows are many."""
    path = f"{shared_folder(df.sparkSession)}/table"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> Iterator[None]:
    """Arrow batches of jobs that run meanwhile have about ``limit`` bytes at most, in place of Spark's 64 MB, which each
    task holds in the JVM and in its Python worker. Results don't depend on it; the session's own limit is put back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(name)
    given = re.fullmatch(r"(\d+)b?", own)  # with another unit it is left as the user has set it
    if given and int(given[1]) > limit:
        spark.conf.set(name, limit)
    try:
        yield
    finally:
        spark.conf.set(name, own)


def arrow_slices(batch: pa.RecordBatch, column: str, limit: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in slices of about ``limit`` bytes of a text column; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def word_array(text: Column) -> Column:
    """Maximal runs of characters other than the six spaces; null text has none."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACE, " " * len(SPACE))
    return F.array_remove(F.split(flat, " "), "")


def spaceless(text: Column) -> Column:
    """``translate`` drops the characters that have no counterpart."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` (already materialised) with a broadcast hint only if a count proves it small."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


#: Keys that ``with_facts`` broadcasts at most.
HOT_KEYS = 20_000


def with_facts(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined with ``facts``, one row a key with the ``count`` of rows that hold it, ``total`` or fewer in all.

    Keys with more than one part in HOT_KEYS of all rows are fewer than HOT_KEYS, so they are broadcast and their rows
    stay where they are; no key of the shuffle holds more.
    """
    heavy = F.col(count) * HOT_KEYS > F.lit(total)
    hot = F.broadcast(facts.where(heavy))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(facts.where(~heavy), key))
