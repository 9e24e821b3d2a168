"""First-appearance order, which the file order of the samples and the row order within them define."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.placing import numbered

PLACE = ("file_ordinal", "row_ordinal")


def stable_index(rows: DataFrame, item: str, name: str, within: list[str] | None = None) -> DataFrame:
    """(within..., item, name): distinct items numbered from 1 by first appearance, ties by the item itself."""
    within = within or []
    first = rows.groupBy(*within, item).agg(F.min(F.struct(*PLACE)).alias("_first"))
    if not within:
        return numbered(first, name, "_first", item).drop("_first")
    over = Window.partitionBy(*within).orderBy("_first", item)
    return first.withColumn(name, F.row_number().over(over)).drop("_first")
