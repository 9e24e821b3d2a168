"""Places of rows in an order over the whole table, without one task that sees all rows.

Rows are dealt to ranges of the order and sorted within them; what is known of all ranges (rows, first and last value) is a
row a range. Places, values at given places and gaps between neighbours follow from these.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut


@dataclass
class Ordered:
    """``rows``: the table with _range and _at (from 0) in it; ``ranges``: (_range, n, first, last) of ranges with rows, in
    order, one for each partition."""

    rows: DataFrame
    ranges: list[Row]

    @property
    def size(self) -> int:
        return sum(r["n"] for r in self.ranges)

    def _before(self) -> DataFrame:
        """(_range, _before): rows in the ranges before."""
        out, total = [], 0
        for r in self.ranges:
            out.append((r["_range"], total))
            total += r["n"]
        return F.broadcast(self.rows.sparkSession.createDataFrame(out, "_range long, _before long"))  # a row a partition

    def numbered(self, name: str, first: int = 1) -> DataFrame:
        """The table with each row's place, from ``first``."""
        return self.rows.join(self._before(), "_range").withColumn(name, F.col("_before") + F.col("_at") + first).drop("_range", "_at", "_before")

    def values_at(self, column: str, places: list[int]) -> dict[int, float]:
        """Values of ``column`` at places from 1, from the ranges that hold them."""
        wanted, total = [], 0
        for r in self.ranges:
            wanted += [(r["_range"], p - 1 - total, p) for p in set(places) if total < p <= total + r["n"]]
            total += r["n"]
        if not wanted:
            return {}
        held = F.lit(False)
        for k, at, _ in wanted:
            held = held | ((F.col("_range") == k) & (F.col("_at") == at))
        found = {(r["_range"], r["_at"]): r[column] for r in self.rows.where(held).select("_range", "_at", column).collect()}  # a row a place
        return {p: found[k, at] for k, at, p in wanted}

    def largest_gap(self, column: str) -> float | None:
        """The value below the largest gap between neighbours, the first of equal ones; the only value; None without rows.
        Gaps between ranges come from their ends."""
        if not self.ranges:
            return None
        beside = F.lead(column).over(Window.partitionBy("_range").orderBy("_at"))  # a range is within one task already
        inner = self.rows.withColumn("_gap", beside - F.col(column)).where("_gap IS NOT NULL")
        best = inner.agg(F.max_by(F.struct("_range", "_at", "_gap", F.col(column).alias("low")), F.struct("_gap", -F.col("_range"), -F.col("_at"))).alias("b")).first()["b"]
        gaps = [(-best["_gap"], best["_range"], best["_at"], best["low"])] if best else []
        gaps += [(a["last"] - b["first"], a["_range"], a["n"] - 1, a["last"]) for a, b in zip(self.ranges, self.ranges[1:])]
        return min(gaps)[3] if gaps else self.ranges[0]["first"]


def ordered(df: DataFrame, *by: str | Column, value: str | None = None) -> Ordered:
    """``df`` in the order of ``by``, which should leave no ties where places must not vary; ``value`` is the column whose
    first and last in each range are kept."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(df.repartitionByRange(parts, *by).sortWithinPartitions(*by))
    rows = rows.withColumn("_id", F.monotonically_increasing_id())  # the partition's number and the place in it
    rows = rows.withColumns({"_range": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")
    ends = [F.min_by(value, "_at").alias("first"), F.max_by(value, "_at").alias("last")] if value else []
    return Ordered(rows, rows.groupBy("_range").agg(F.count("*").alias("n"), *ends).orderBy("_range").collect())


def numbered(df: DataFrame, name: str, *by: str | Column, first: int = 1) -> DataFrame:
    """``df`` with each row's place in the order of ``by``."""
    return ordered(df, *by).numbered(name, first)
