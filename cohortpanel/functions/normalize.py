"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(x: Column) -> Column:
    """Without white space at either end, tabs and line ends included."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def allele_name(x: Column) -> Column:
    """Upper case without spaces and commas, prefixed ``HLA-`` where the locus stands first; null becomes empty."""
    bare = F.upper(F.regexp_replace(trimmed(F.coalesce(x, F.lit(""))), "[ ,]", ""))
    return F.when(bare.rlike(r"^[ABC]\*"), F.concat(F.lit("HLA-"), bare)).otherwise(bare)


def number(x: Column) -> Column:
    """A double from text, null where it is none; thousands separators are dropped, NaN is null, Inf stays."""
    text = F.regexp_replace(trimmed(x.cast("string")), ",", "")
    plain = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eEdD][+-]?\d+)?$")
    sign = F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(plain, F.expr("1D") * F.regexp_replace(text, "[dD]", "e").try_cast("double")).when(text.rlike(r"(?i)^[+-]?inf(inity)?$"), sign)


def fraction(x: Column) -> Column:
    """A share; values above 1 are percents."""
    return F.when(x > 1, x / 100).otherwise(x)


def frequency_from_carriers(share: Column) -> Column:
    """Allele frequency from the share of individuals that carry the allele."""
    return 1 - F.sqrt(F.greatest(F.lit(0.0), 1 - share))


def kmers(x: Column, k: int) -> Column:
    """Distinct windows of k characters; none where the text is shorter or null."""
    windows = F.transform(F.sequence(F.lit(1), F.length(x) - (k - 1)), lambda i: F.substring(x, i, F.lit(k)))
    return F.when(F.length(x) >= k, F.array_distinct(windows)).otherwise(F.array().cast("array<string>"))


def overlaps(a: Column, b: Column, k: int) -> Column:
    """Whether two texts share a run of k characters."""
    return F.arrays_overlap(kmers(a, k), kmers(b, k))


def file_key(x: Column, stem: bool = False) -> Column:
    """Lower case without folder, quotes and white space; ``stem`` also drops the last extension."""
    key = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\s\"']", ""), r"^.*[/\\]", ""))
    return F.regexp_replace(key, r"\.[^.]*$", "") if stem else key


def binding_strength(rank: Column, threshold: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - rank / F.lit(float(threshold)))


def finite_or_zero(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
