"""How filters of a corpus interact: what each removes in every order of application, and its Shapley share.

The removal game of a part of the corpus has v(S), the documents that fail at least one filter of S. Its potential is
P(S) = (v(S) + sum of P(S without i) over i in S) / |S|, P of nothing 0 (Hart and Mas-Colell), computed over all
coalitions from small to large. A filter's Shapley value is P(all) - P(all without it). Values are kept as whole numbers,
times n! for n filters: each is then the sum of the filter's removals over all n! orders. What a filter removes after the
filters B is v(B and it) - v(B), so all orders follow from the coalitions alone; documents are read once.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table, with_facts, word_array

#: Filters of a text by letter; COPY is the one that looks at all texts.
TEXT_FILTERS, COPY = "ABCD", "E"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 50, 65, 5  # words; percent of words; percent of code points


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails; null counts as empty.

    A: under 50 words; B: fewer than 65 % distinct words; C: more than 5 % of the code points are A-Z; D: holds any of
    ``#$%&*|``. Texts are looked at whole, whatever their length.
    """
    t = F.coalesce(text, F.lit(""))
    few = lambda w: F.when(F.size(w) < MIN_WORDS, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < MIN_DISTINCT * F.size(w), 2).otherwise(0)
    words = F.get(F.transform(F.array(word_array(text)), few), 0)
    upper = F.when(100 * F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long") > MAX_UPPER * F.length(t).cast("long"), 4).otherwise(0)
    return words + upper + F.when(t.rlike(r"[#$%&*|]"), 8).otherwise(0)


def failures(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail.

    A document fails E if its text is that of a smaller id anywhere. Rows without id are nobody's original and no copies;
    repeated rows of an id are originals or copies together. ``labels`` (key, quality, toxic): of several rows of one id
    any counts; documents without a label are neither good nor toxic. A null part is the part of the empty string.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_failures(F.col(text)).alias("mask"), F.unhex(F.sha2(t, 256)).alias("digest"))
    rows = rows.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))
    # rows without id would all meet in one task
    named = rows.where("id IS NOT NULL").join(marks, "id", "left").withColumns({"good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))})
    nameless = rows.where("id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    grouped = named.unionByName(nameless).withColumn("named", F.col("id").isNotNull()).groupBy("digest", "part", "mask", "good", "toxic", "named").agg(F.sum("n").alias("n"), first.alias("first"))
    grouped = checkpointed(grouped)
    least = grouped.groupBy("digest").agg(F.min("first.id").alias("least"), F.count("*").alias("k"))
    faced = with_facts(grouped, least, "digest", "k", grouped.count())
    fresh = F.when(~F.col("named"), F.col("n")).when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    dealt = F.explode(F.array(F.struct(F.col("mask"), fresh.alias("n")), F.struct((F.col("mask") + (1 << len(TEXT_FILTERS))).alias("mask"), (F.col("n") - fresh).alias("n"))))
    split = faced.select("part", "good", "toxic", dealt.alias("x")).select("part", "x.mask", "x.n", "good", "toxic")
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))


def coalition_values(tallies: Column, weight: str, n: int) -> Column:
    """v of each of the 2^n coalitions: the ``weight`` of tallies (structs with ``mask``) that fail any filter of it."""
    caught = lambda s: F.aggregate(tallies, F.lit(0).cast("long"), lambda a, x: a + F.when(x["mask"].bitwiseAND(s) != 0, x[weight]).otherwise(0))
    return F.transform(F.sequence(F.lit(0), F.lit((1 << n) - 1)), caught)


def potentials(values: Column, n: int) -> Column:
    """n! times the potential of each coalition, by the recursion over coalitions in the order of their numbers: all
    subsets of one have smaller numbers. Divisions leave no rest, as the denominators of P divide n!."""
    bits = F.array(*[F.lit(1 << i) for i in range(n)])

    def extended(known: Column, s: Column) -> Column:
        without = F.aggregate(F.filter(bits, lambda b: s.bitwiseAND(b) != 0), F.lit(0).cast("long"), lambda a, b: a + F.get(known, s - b))
        return F.concat(known, F.array(F.call_function("div", math.factorial(n) * F.get(values, s) + without, F.bit_count(s))))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << n) - 1)), F.array(F.lit(0).cast("long")), extended)


def audit(tallies: DataFrame, names: str = TEXT_FILTERS + COPY) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of (part, mask, n,
    good, toxic), for all orders of ``names``; a row of a mask for each part at least, of which any may be zero."""
    n, full = len(names), (1 << len(names)) - 1
    games = tallies.groupBy("part").agg(F.sum("n").alias("n"), F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("t"))  # at most 2^n masks
    games = games.select("part", "n", *[coalition_values(F.col("t"), c, n).alias(v) for c, v in (("n", "v"), ("good", "g"), ("toxic", "x"))])
    games = games.withColumn("p", potentials(F.col("v"), n))
    orders = F.array(*[F.lit("".join(o)) for o in itertools.permutations(names)])
    steps = games.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    bits = F.transform(F.split("filter_order", ""), lambda name: F.get(F.array(*[F.lit(1 << i) for i in range(n)]), F.instr(F.lit(names), name) - 1))
    steps = steps.withColumn("bits", bits).withColumn("bit", F.get("bits", F.col("step") - 1))
    steps = steps.withColumn("before", F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, b: a.bitwiseOR(b)))
    at = lambda values, s: F.get(F.col(values), s)
    after, others = F.col("before").bitwiseOR(F.col("bit")), F.lit(full) - F.col("bit")
    lost = lambda values: at(values, after) - at(values, F.col("before"))
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), (F.col("n") - at("v", after)).alias("kept"), lost("v").alias("removed"), (at("v", F.col("bit")) - lost("v")).alias("redundant"),
        (at("v", F.lit(full)) - at("v", others)).alias("unique_fails"), lost("g").alias("good_lost"), lost("x").alias("toxic_lost"), (at("p", F.lit(full)) - at("p", others)).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """The audit of the five filters on ``docs`` (key, text, part; other columns are not looked at, whatever their names).

    Null and empty texts fail A, and E after the first of them; long texts are read whole; ties and repeated rows as in
    ``failures``. An empty table gives no rows; empty labels give good_lost and toxic_lost of 0.
    """
    return audit(failures(docs, labels, key, text, part))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


#: Filters applied one after another in each order, to documents counted by what they fail.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '') AS w
  FROM documents
), f AS (
  SELECT d.doc_id, part,
         {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
          'D': regexp_matches(t, '[#$%&*|]'), 'E': d.doc_id > min(d.doc_id) OVER (PARTITION BY t)} AS fails,
         coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
  FROM d LEFT JOIN labels l ON l.doc_id = d.doc_id
), c AS (
  SELECT part, [x.k for x in [{'k': 'A', 'f': fails.A}, {'k': 'B', 'f': fails.B}, {'k': 'C', 'f': fails.C}, {'k': 'D', 'f': fails.D}, {'k': 'E', 'f': fails.E}] if x.f] AS failed,
         good, toxic, count(*) AS n
  FROM f GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step, filter_order[step] AS name, string_split(filter_order[: step - 1], '') AS earlier FROM orders, range(1, 6) r(step)
), r AS (
  SELECT part, filter_order, step, name, n, good, toxic, failed, list_contains(failed, name) AS fails, len(list_intersect(failed, earlier)) > 0 AS gone FROM c, steps
), s AS (
  SELECT part, filter_order, step, name,
         sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails AND len(failed) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN fails AND NOT gone AND good THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fails AND NOT gone AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM r GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, name))::BIGINT AS shapley FROM s
"""
