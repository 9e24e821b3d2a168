"""Quality rules whose cutoffs are risk-controlled on labelled documents, with DataFrame operations only.

Base figures of each whole text feed fixed rules; further rules compare ratios with cutoffs. A cutoff is used in a
stratum only if labelled good documents show, by an exact binomial test, that it rejects at most a set share of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, bounded_broadcast, checkpointed, spaceless, table, word_array

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50  # percent of words in repeated windows
#: Share of good documents that all cutoffs of a stratum may reject together, and the chance that this fails anywhere.
ALPHA, DELTA = 0.05, 0.05
#: Ratios (rejected above the cutoff) and their cutoffs from lax to strict, tested in this order.
RULES = {
    "symbol_ratio": (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.075, 0.05, 0.035),
    "dup_line_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "repeat_ratio": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2),
    "upper_ratio": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2),
}
#: Strata in one plan; more are joined by a shuffle instead of a broadcast.
BROADCAST_STRATA = 100_000


def base_figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rule ratios.

    Windows of three words are hashed, packed with their place and sorted in the row, so equal windows stand side by
    side; neighbours are then compared word by word. Where unequal windows share a packed prefix, or the place does not
    fit, the row takes the plain sort of (words, place) instead. Null or empty text: all zero.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    df = docs.withColumn("_w", word_array(F.col(text))).withColumn("_lines", lines)
    tight = spaceless(F.col(text))
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(tight).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_upper": F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long"),
        "_n_lines": F.size("_lines").cast("long"),
    })
    df = df.withColumn("n_repeat_words", repeat_words(F.col("_w")))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return df.withColumns({
        "symbol_ratio": share("n_symbols", "word_chars"),
        "dup_line_ratio": share("n_dup_lines", "_n_lines"),
        "repeat_ratio": share("n_repeat_words", "n_words"),
        "upper_ratio": share("_upper", "word_chars"),
    }).drop("_w", "_lines", "_upper", "_n_lines")


PLACE_BITS = 24


def repeat_words(words: Column) -> Column:
    """Number of words that lie in a window of three words found twice or more in the array."""
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    mask = F.lit(-1 << PLACE_BITS)

    def window(i):
        return [F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)]

    def covered(places: Column) -> Column:
        """Words in the windows that start at these places (sorted): three each, less what the next window takes up."""
        gaps = lambda ps: F.transform(ps, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(ps, k + 1) - p, F.lit(3))))
        return F.aggregate(bound(F.sort_array(places), gaps), F.lit(0), lambda acc, x: acc + x)

    packed = F.sort_array(F.transform(starts, lambda i: F.xxhash64(*window(i)).bitwiseAND(mask).bitwiseOR(i.cast("long"))))

    def from_packed(s: Column) -> Column:
        head = lambda v: v.bitwiseAND(mask)
        beside = F.filter(s, lambda v, k: (head(v) == head(F.get(s, k + 1))) | (head(v) == head(F.get(s, k - 1))))
        place = lambda v: v.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")

        def checked(b: Column) -> Column:
            mixed = F.exists(
                F.sequence(F.lit(0), F.size(b) - 2),
                lambda k: (head(F.get(b, k)) == head(F.get(b, k + 1))) & (F.struct(*window(place(F.get(b, k)))) != F.struct(*window(place(F.get(b, k + 1))))),
            )
            return F.when(mixed, plainly()).otherwise(covered(F.transform(b, place)))

        return bound(beside, lambda b: F.when(F.size(b) < 2, 0).otherwise(checked(b)))

    def plainly() -> Column:
        s = F.sort_array(F.transform(starts, lambda i: F.struct(F.struct(*[w.alias(n) for w, n in zip(window(i), "abc")]).alias("w"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda v, k: (v["w"] == F.get(s, k + 1)["w"]) | (v["w"] == F.get(s, k - 1)["w"]))
        return bound(s, lambda s: covered(F.transform(twice(s), lambda v: v["i"])))

    many = F.size(words) >= 1 << PLACE_BITS
    return F.when(F.size(words) < 4, 0).when(many, plainly()).otherwise(bound(packed, from_packed)).cast("long")


def bound(value: Column, body) -> Column:
    """``body(x)`` with x computed once, as a lambda's variable."""
    return F.get(F.transform(F.array(value), body), 0)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1 by Stirling's series at x + 8 (error below 1e-14)."""
    y = x + F.lit(8.0)
    series = (y - 0.5) * F.ln(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    product = F.lit(0.0)
    for k in range(8):
        product = product + F.ln(x + F.lit(float(k)))
    return series - product


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k <= n p, summed exactly from k downward until terms vanish (below 1e-17 of the first)."""
    n, k = n.cast("double"), k.cast("double")
    first = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    reach = F.least(k, F.ceil(F.sqrt(n) * 40) + 40).cast("int")
    steps = F.when(reach > 0, F.sequence(F.lit(0), reach - 1)).otherwise(F.array().cast("array<int>"))
    odds = (1 - p) / p
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc, j):
        i = k - j
        term = acc["term"] * i / (n - i + 1) * F.lit(odds)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    return F.least(F.lit(1.0), first * F.aggregate(steps, zero, add, lambda acc: acc["sum"]))


def risk_controlled(labelled: DataFrame, stratum: str, rules: dict = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff): the strictest cutoff of each rule that is safe in each stratum.

    ``labelled``: good documents (one row each) with the stratum and a column of each rule. H0 for a cutoff is "it
    rejects more than alpha / #rules of good documents"; its p-value is the exact binomial tail. Cutoffs of a rule are
    tested from lax to strict until the first that is not significant (fixed-sequence testing needs no correction
    along the sequence); over strata and rules the level is divided by Bonferroni. Without labels no cutoff is safe.
    """
    share = alpha / len(rules)
    counts = [F.sum((F.col(r) > F.lit(c)).cast("long")).alias(f"{r}@{i}") for r, cuts in rules.items() for i, c in enumerate(cuts)]
    per = labelled.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("n"), *counts)
    cells = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(float(c)).alias("cutoff"), F.col(f"{r}@{i}").alias("k")) for r, cuts in rules.items() for i, c in enumerate(cuts)])
    per = checkpointed(per.select("stratum", "n", F.explode(cells).alias("c")).select("stratum", "n", "c.*"))
    tests = max(1, per.select("stratum").distinct().count() * len(rules))
    p_value = F.when(F.col("k") <= F.col("n") * share, binomial_tail(F.col("k"), F.col("n"), share)).otherwise(1.0)
    order = Window.partitionBy("stratum", "rule").orderBy("step")
    safe = per.withColumn("p_value", p_value).withColumn("_ok", F.min((F.col("p_value") <= delta / tests).cast("int")).over(order)).where("_ok = 1")
    return safe.groupBy("stratum", "rule").agg(F.max_by("cutoff", "step").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, rules: dict = RULES, alpha: float = ALPHA, delta: float = DELTA, stratum: str = "lang") -> DataFrame:
    """``docs`` but its text, with the base figures, base_failed and kept.

    kept is false if the base rules fail or a ratio is above its stratum's cutoff; null strata form one of their own.
    Labels: doc_id and quality (1 good, 0 bad, null unknown); repeated labels count once, and a document that has both
    counts as good. Of labelled rows of one id the first in the order of stratum and ratios is held out. Rows are kept as
    they are, repeated or not, whatever their texts' length; an empty table gives an empty result. Columns that are named
    as the figures are replaced, all others kept.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *RULES, "base_failed", "kept"]
    figures = base_figures(docs.drop(*names)).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    small = checkpointed(figures.drop("text"))
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("_good")).where("_good = 1").select("doc_id")
    held = small.where(~F.col("base_failed")).select("doc_id", F.struct(F.col(stratum).alias("stratum"), *rules).alias("held")).join(good, "doc_id", "left_semi")
    held = held.groupBy("doc_id").agg(F.min("held").alias("held")).select("held.*")
    cutoffs = risk_controlled(held, "stratum", rules, alpha, delta).groupBy(F.col("stratum").alias("_stratum"))
    cutoffs = checkpointed(cutoffs.agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cut")))
    above = F.lit(False)
    for rule in rules:
        above = above | F.coalesce(F.col(rule) > F.col("_cut")[rule], F.lit(False))
    judged = small.join(bounded_broadcast(cutoffs, BROADCAST_STRATA), F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    return judged.withColumn("kept", ~F.col("base_failed") & ~above).drop("_stratum", "_cut")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_CUTOFFS = ", ".join(f"('{rule}', {step}, {float(cutoff)!r})" for rule, cuts in RULES.items() for step, cutoff in enumerate(cuts))
_SHARE, _RULE = ALPHA / len(RULES), "CASE rule " + " ".join(f"WHEN '{r}' THEN {r}" for r in RULES) + " END"
#: Figures word by word; cutoffs by the binomial sum in full.
ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
         list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: translate(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '') <> '') AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), rep AS (
  SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS word FROM win WHERE n > 1) GROUP BY doc_id
), g AS (
  SELECT d.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         len(lines) AS n_lines, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper
  FROM d LEFT JOIN rep USING (doc_id)
), h AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbol_ratio, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
         coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_ratio, coalesce(n_upper / nullif(word_chars, 0), 0) AS upper_ratio
  FROM g
), held AS (
  SELECT h.* FROM h JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1) USING (doc_id) WHERE NOT base_failed
), c(rule, step, cutoff) AS (VALUES {_CUTOFFS}),
k AS (SELECT lang, rule, step, cutoff, count(*) AS n, count(*) FILTER ({_RULE} > cutoff) AS k FROM held, c GROUP BY ALL),
p AS (
  SELECT *, CASE WHEN k > n * {_SHARE!r} THEN 1.0 ELSE
    list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_SHARE!r}) + (n - i) * ln(1 - {_SHARE!r})) FOR i IN range(0, k + 1)]) END AS p_value FROM k
), safe AS (
  SELECT lang, rule, step, cutoff, bool_and(p_value <= {DELTA!r} / (SELECT greatest(1, count(DISTINCT coalesce(lang, '-')) * {len(RULES)}) FROM held)) OVER (PARTITION BY lang, rule ORDER BY step) AS ok FROM p
), cut AS (SELECT lang, rule, max_by(cutoff, step) AS cutoff FROM safe WHERE ok GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM cut WHERE cut.lang IS NOT DISTINCT FROM h.lang AND {_RULE} > cut.cutoff) AS kept
FROM h
"""
