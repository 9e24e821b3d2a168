"""Personal data: patterns, and terms that reveal them by corpus co-occurrence, with DataFrame operations only.

Protected entities are the values that the patterns find, and pools of them: a mail domain, a network, the issuer of a
card, the prefix of a number. A term near an entity reveals it as far as it leaves little doubt about it:
-log2 P(entity | term) bits, smoothed towards the entity's base rate, by counts of distinct texts over the whole corpus.
No count is too small: one text leaves 0.58 bits, four leave 0.17. Terms below a threshold of doubt are disclosures
wherever they stand: generalised, or removed if they leave almost none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, checkpointed, table
from .quality import bound

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("generalised", "removed")
#: Texts at the entity's base rate that are added to a term's (Jeffreys' half); doubt in bits up to which a term is
#: generalised or removed; information on the entity, in bits above its base rate, at least.
PRIOR_TEXTS, GENERALISE_BITS, REMOVE_BITS, MIN_INFORMATION = 0.5, 1.0, 0.2, 3.0
#: Words on each side of an entity that are looked at.
CONTEXT_WORDS = 8
#: Tables of terms, and of documents with terms or copies, are broadcast up to these counts, joined by a shuffle beyond.
BROADCAST_TERMS, BROADCAST_DOCS = 200_000, 100_000

LETTERS = r"[\p{L}\p{M}]+"
#: Stands for a separator inside a number or host, so that loops run over one character class.
INNER = "\x01"


def cumulative(steps: Column, width: int = 256) -> Column:
    """Sums of what stands before each item, in blocks so that long arrays aren't copied for every item."""
    zero = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
    add = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))
    before = lambda xs: F.aggregate(xs, zero, add, lambda acc: acc["out"])
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(steps) / width).cast("int") - 1), lambda b: F.slice(steps, b * width + 1, F.lit(width)))

    def placed(bs: Column) -> Column:
        sums = F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x))
        return bound(before(sums), lambda offsets: F.flatten(F.transform(bs, lambda b, i: F.transform(before(b), lambda v: v + F.get(offsets, i)))))

    return F.when(F.size(steps) <= width, before(steps)).otherwise(bound(blocks, placed))


def matches(text: Column, pattern: str, original: Column | None = None) -> Column:
    """(start, end, value) of the pattern's matches in ``text``, in code points, end exclusive; values from ``original``,
    a text of the same places."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def built(pair: Column) -> Column:
        steps = F.transform(pair["found"], lambda m, i: F.length(F.get(pair["gaps"], i)) + F.length(m))

        def spans(starts: Column) -> Column:
            def one(m, i):
                start = F.get(starts, i) + F.length(F.get(pair["gaps"], i))
                value = m if original is None else F.substring(original, start + 1, F.length(m))
                return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), value.alias("value"))

            return F.transform(pair["found"], one)

        return bound(bound(steps, lambda s: cumulative(s)), spans)

    return bound(F.struct(found.alias("found"), gaps.alias("gaps")), built)


def luhn(digits: Column) -> Column:
    """Luhn's check of a string of digits: every second from the right is doubled."""
    figures = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    values = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """Sorted (start, order, kind, end, value) of e-mail addresses, ip addresses, cards and phone numbers.

    Patterns are the fixed ones of the contract, rewritten so that no start is tried twice: a match can't begin inside a
    run that its first class would have taken from further left, and separators between digits or host labels are
    replaced by one character, which the loops' classes hold.
    """
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    safe = F.translate(text, INNER, "\x02")
    hosts = F.regexp_replace(safe, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", INNER)
    cards = F.regexp_replace(safe, r"(?<=[0-9])[\x20-](?=[0-9])", INNER)
    local = r"[A-Za-z0-9._%+\x01-]"
    email = F.when(F.contains(text, F.lit("@")), matches(hosts, rf"(?:\G|(?<!{local})){local}++@[A-Za-z0-9-]+\x01[A-Za-z0-9\x01-]+", text)).otherwise(none)
    number = F.regexp_like(text, F.lit("[0-9]"))
    ip = F.when(number, matches(text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")).otherwise(none)
    card = F.when(number, matches(cards, r"[0-9][0-9\x01]+", text)).otherwise(none)
    phone = F.when(F.contains(text, F.lit("+")), matches(text, r"\+[0-9][\x20().0-9-]+[0-9]")).otherwise(none)
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")
    octet = r"0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])?"
    ip = F.filter(ip, lambda m: F.regexp_like(m["value"], F.lit(rf"^{octet}\.{octet}\.{octet}\.{octet}$")))
    card = F.filter(card, lambda m: F.length(digits(m["value"])).between(14, 19))
    card = F.filter(card, lambda m: luhn(digits(m["value"])))
    phone = F.filter(phone, lambda m: F.length(digits(m["value"])).between(10, 15))
    named = lambda k: lambda m: span(m["start"], k, KINDS[k], m["end"], m["value"])
    parts = [F.transform(a, named(k)) for k, a in enumerate((email, ip, card, phone))]
    return F.sort_array(F.concat(*parts))


def span(start: Column, order: int | Column, kind: str | Column, end: Column, value: Column) -> Column:
    order, kind = (F.lit(x) if not isinstance(x, Column) else x for x in (order, kind))
    return F.struct(start.alias("start"), order.alias("order"), kind.alias("kind"), end.alias("end"), value.alias("value"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def terms_of(text: Column) -> Column:
    """Distinct terms (runs of letters, lower case) of a whole text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}]+"), lambda x: x != ""))


def first_words(text: Column) -> Column:
    """The first whole words, however far off, after the rest of a word that the text begins with."""
    head = F.regexp_extract(text, r"^[\p{L}\p{M}]*+((?:[^\p{L}\p{M}]*+[\p{L}\p{M}]++){0,%d})" % CONTEXT_WORDS, 1)
    return F.regexp_extract_all(head, F.lit(LETTERS), F.lit(0))


def pool(kind: Column, value: Column) -> Column:
    """What values of a kind share: mail domain, first two octets, first six digits of a card, a phone number but its
    last seven digits."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    email, ip = F.substring_index(value, "@", -1), F.substring_index(value, ".", 2)
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", F.substring(digits, 1, 6)).otherwise(F.substring(digits, F.lit(1), F.length(digits) - 7))


def disclosures(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, kind): terms that reveal an entity. ``docs`` needs the text alone.

    Copies of a text are one piece of evidence. An entity's base rate is the lower of its shares of documents and of
    distinct texts, so copies make it no less worth protecting.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    mark = F.xxhash64(t)
    texts = checkpointed(docs.groupBy(mark.alias("mark")).agg(F.count("*").alias("copies")))
    total = texts.agg(F.count("*").alias("texts"), F.coalesce(F.sum("copies"), F.lit(0)).alias("docs")).first()
    copied = bounded_broadcast(texts.where("copies > 1"), BROADCAST_DOCS)
    near = docs.select(t.alias("t"), mark.alias("mark"), base_spans(t).alias("base")).where(F.size("base") > 0)
    near = near.withColumn("doc", F.monotonically_increasing_id()).select("doc", "mark", "t", F.explode("base").alias("s"))
    # both sides begin with the entity's own character there, so that a word it cuts is passed over as a whole
    left = F.transform(first_words(F.reverse(F.substring(F.col("t"), F.lit(1), F.col("s.start") + 1))), F.reverse)
    right = first_words(F.substring(F.col("t"), F.col("s.end"), F.length("t")))
    value = F.lower("s.value")
    entities = F.array(F.concat_ws(":", "s.kind", value), F.concat_ws(":", F.lit("pool"), "s.kind", pool(F.col("s.kind"), value)))
    pairs = near.select("doc", "mark", F.explode(entities).alias("entity"), F.transform(F.concat(left, right), F.lower).alias("terms"))
    pairs = checkpointed(pairs)
    with_entity = pairs.groupBy("entity").agg(F.count_distinct("mark").alias("entity_texts"), F.count_distinct("doc").alias("entity_docs"))
    both = pairs.select("mark", "entity", F.explode("terms").alias("term")).distinct().groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    both = checkpointed(both.join(with_entity, "entity"))
    asked = bounded_broadcast(both.select("term").distinct(), BROADCAST_TERMS)
    # counts are made before the join where the terms are too many to broadcast: partial sums are smaller than all words
    words = docs.select(t.alias("t"), mark.alias("mark")).join(copied, "mark", "left")
    words = words.select(F.explode(terms_of(F.col("t"))).alias("term"), (1 / F.coalesce("copies", F.lit(1))).alias("part"))
    small = both.select("term").distinct().limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    # a text's copies hold the same terms, so their parts sum to a whole number but for rounding
    with_term = (words.join(asked, "term", "left_semi") if small else words).groupBy("term").agg(F.round(F.sum("part")).alias("n_term"))
    base_rate = F.least(F.col("entity_texts") / F.lit(float(max(1, total["texts"]))), F.col("entity_docs") / F.lit(float(max(1, total["docs"]))))
    doubt = -F.log2((F.col("n_both") + PRIOR_TEXTS * base_rate) / (F.greatest(F.col("n_term"), F.col("n_both")) + PRIOR_TEXTS))
    information = -F.log2(base_rate) - doubt
    told = both.join(with_term, "term").withColumn("doubt", doubt).where((F.col("doubt") <= GENERALISE_BITS) & (information >= MIN_INFORMATION))
    best = told.groupBy("term").agg(F.min("doubt").alias("doubt"))
    return checkpointed(best.select("term", F.when(F.col("doubt") <= REMOVE_BITS, "removed").otherwise("generalised").alias("kind")))


def with_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``base`` (pattern spans) and ``spans`` (those and term spans that overlap none of them), both sorted.

    Null or empty texts have none. Repeated rows and null keys are told apart by their texts. Columns named base or
    spans are replaced.
    """
    docs = docs.drop("base", "spans")
    told = disclosures(docs.select(text), text)
    t = F.coalesce(F.col(text), F.lit(""))
    mark = F.xxhash64(t)
    found = docs.withColumn("base", base_spans(t))
    if told.limit(1).count() == 0:
        return found.withColumn("spans", F.col("base"))
    holders = docs.select(F.col(key).alias("_key"), mark.alias("_mark"), F.explode(terms_of(t)).alias("term"))
    holders = holders.join(bounded_broadcast(told, BROADCAST_TERMS), "term")
    holders = checkpointed(holders.groupBy("_key", "_mark").agg(F.map_from_entries(F.collect_set(F.struct("term", "kind"))).alias("_told")))
    found = found.withColumn("_mark2", mark).join(bounded_broadcast(holders, BROADCAST_DOCS), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_mark2") == F.col("_mark")), "left")

    def marked(all_terms: Column) -> Column:
        of = lambda m: F.col("_told")[F.lower(m["value"])]
        kept = F.filter(all_terms, lambda m: of(m).isNotNull() & ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
        return F.transform(kept, lambda m: span(m["start"], F.lit(len(KINDS)), of(m), m["end"], m["value"]))

    terms = F.when(F.col("_told").isNotNull(), marked(matches(t, LETTERS)))
    found = found.withColumn("spans", F.when(F.col("_told").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", terms))))
    return found.drop("_key", "_mark", "_mark2", "_told")


def sanitised(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span replaced: ``[EMAIL]`` and so on, ``[TERM]`` for generalised terms, nothing for removed
    ones. Overlapping spans are replaced together, by the first one's label. Null texts stay null."""
    found = with_spans(docs, key, text)
    label = lambda s: F.when(s["kind"] == "removed", "").when(s["kind"] == "generalised", "[TERM]").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    empty = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,end:int,label:string>>").alias("out"))

    def merge(acc, s):
        one = F.struct(s["start"].alias("start"), s["end"].alias("end"), label(s).alias("label"))
        last = F.get(acc["out"], F.size(acc["out"]) - 1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["label"].alias("label"))
        out = F.when(s["start"] >= acc["end"], F.concat(acc["out"], F.array(one))).otherwise(F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(wider)))
        return F.struct(F.greatest(acc["end"], s["end"]).alias("end"), out.alias("out"))

    t = F.col(text)

    def rebuilt(cuts: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(cuts, i - 1)["end"]).otherwise(0)
        pieces = F.transform(cuts, lambda c, i: F.concat(F.substring(t, before(i) + 1, c["start"] - before(i)), c["label"]))
        tail = F.substring(t, F.get(cuts, F.size(cuts) - 1)["end"] + 1, F.length(t))
        return F.concat(F.array_join(pieces, ""), tail)

    clean = F.when(F.size("spans") == 0, t).otherwise(bound(F.aggregate("spans", empty, merge, lambda acc: acc["out"]), rebuilt))
    return found.withColumn(text, clean).drop("base", "spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    total = F.size("base").cast("long").alias("n_personal")
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), total)


#: The contract's patterns as they are stated; words, entities and terms counted by plain grouping.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents),
hit AS (
  SELECT row, ord, kind, generate_subscripts(found, 1) AS i, unnest(found) AS v, unnest(gaps[1 : len(found)]) AS gap FROM (
    SELECT row, 0 AS ord, 'email' AS kind, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS found, string_split_regex(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS gaps FROM d
    UNION ALL SELECT row, 1, 'ip', regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), string_split_regex(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') FROM d
    UNION ALL SELECT row, 2, 'card', regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), string_split_regex(t, '[0-9]([\x20-]?[0-9])+') FROM d
    UNION ALL SELECT row, 3, 'phone', regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), string_split_regex(t, '\+[0-9][\x20().0-9-]+[0-9]') FROM d
    UNION ALL SELECT row, 4, 'word', regexp_extract_all(t, '[\p{L}\p{M}]+'), string_split_regex(t, '[\p{L}\p{M}]+') FROM d
  )
), placed AS (
  SELECT row, ord, kind, v, lower(v) AS low, regexp_replace(v, '[^0-9]', '', 'g') AS digits, CAST(sum(length(gap) + length(v)) OVER w - length(v) AS BIGINT) AS start, CAST(sum(length(gap) + length(v)) OVER w AS BIGINT) AS stop
  FROM hit WINDOW w AS (PARTITION BY row, ord ORDER BY i ROWS UNBOUNDED PRECEDING)
), word AS (SELECT row, low AS term, start, stop FROM placed WHERE ord = 4),
base AS (
  SELECT row, ord, kind, low, digits, start, stop FROM placed WHERE
    kind = 'email'
    OR (kind = 'ip' AND len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST('0' || ltrim(x, '0') AS INT), 256) > 255)) = 0)
    OR (kind = 'phone' AND length(digits) BETWEEN 10 AND 15)
    OR (kind = 'card' AND length(digits) BETWEEN 14 AND 19 AND list_sum([
         CASE WHEN k % 2 = 0 THEN CAST(reverse(digits)[k + 1] AS INT) ELSE CAST(reverse(digits)[k + 1] AS INT) * 2 - CASE WHEN CAST(reverse(digits)[k + 1] AS INT) > 4 THEN 9 ELSE 0 END END FOR k IN range(0, length(digits))]) % 10 = 0)
), entity AS (
  SELECT row, start, stop, unnest([kind || ':' || low, 'pool:' || kind || ':' || CASE kind WHEN 'email' THEN split_part(low, '@', -1) WHEN 'ip' THEN split_part(low, '.', 1) || '.' || split_part(low, '.', 2)
    WHEN 'card' THEN substr(digits, 1, 6) ELSE substr(digits, 1, length(digits) - 7) END]) AS entity FROM base
), near AS (
  SELECT row, entity, term FROM (
    SELECT e.row, entity, term, w.stop <= e.start AS before, row_number() OVER (PARTITION BY e.row, entity, e.start, e.stop, w.stop <= e.start ORDER BY CASE WHEN w.stop <= e.start THEN -w.stop ELSE w.start END) AS k
    FROM entity e JOIN word w ON w.row = e.row AND (w.stop <= e.start OR w.start >= e.stop)
  ) WHERE k <= 8
), sizes AS (SELECT count(DISTINCT t) AS texts, count(*) AS docs FROM d),
per AS (SELECT entity, count(DISTINCT t) / any_value(texts) AS by_texts, count(DISTINCT row) / any_value(docs) AS by_docs FROM entity JOIN d USING (row), sizes GROUP BY entity),
together AS (SELECT entity, term, count(DISTINCT t) AS n_both FROM near JOIN d USING (row) GROUP BY ALL),
terms AS (SELECT term, count(DISTINCT t) AS n_term FROM word JOIN d USING (row) WHERE term IN (SELECT term FROM together) GROUP BY term),
doubts AS (
  SELECT term, -log2((n_both + 0.5 * least(by_texts, by_docs)) / (greatest(n_term, n_both) + 0.5)) AS doubt, -log2(least(by_texts, by_docs)) AS bits FROM together JOIN per USING (entity) JOIN terms USING (term)
), told AS (SELECT term, CASE WHEN min(doubt) <= 0.2 THEN 'removed' ELSE 'generalised' END AS kind FROM doubts WHERE doubt <= 1 AND bits - doubt >= 3 GROUP BY term),
spans AS (
  SELECT row, start, ord, kind, stop FROM base
  UNION ALL SELECT w.row, w.start, 4, told.kind, w.stop FROM word w JOIN told USING (term) WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row = w.row AND b.start < w.stop AND w.start < b.stop)
), lists AS (
  SELECT row, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone, count(*) FILTER (ord < 4) AS n_personal,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord, stop) FILTER (ord < 4) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord, stop) AS spans
  FROM spans GROUP BY row
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_personal, 0) AS n_personal
FROM d LEFT JOIN lists USING (row)
"""
