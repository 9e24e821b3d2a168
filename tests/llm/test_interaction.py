"""The filter audit against filters applied one after another."""

import itertools
import random
import re

from cohortpanel.llm import interaction

SCHEMA = "doc_id long, text string, source string, n long"


def fails(rows):
    """Letters each row fails, in the order of rows."""
    least = {}
    for key, text, *_ in rows:
        if key is not None:
            least[text or ""] = min(key, least.get(text or "", key))
    out = []
    for key, text, *_ in rows:
        t = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        a, b = len(words) < 50, 100 * len(set(words)) < 65 * len(words)
        c, d = 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t))
        out.append({x for x, f in zip("ABCDE", (a, b, c, d, key is not None and key > least[t])) if f})
    return out


def plainly(rows, labels):
    found, want = fails(rows), {}
    for part in {r[2] or "" for r in rows}:
        own = [(f, labels.get(r[0], (0, 0))) for f, r in zip(found, rows) if (r[2] or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[0]]
                left = [x for x in left if name not in x[0]]
                alone = sum(f == {name} for f, _ in own)
                failing = sum(name in f for f, _ in own)
                want[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), alone, sum(q == 1 for _, (q, _) in gone), sum(t == 1 for _, (_, t) in gone)]
        for name in "ABCDE":
            total = sum(v[1] for (p, o, s), v in want.items() if p == part and o[s - 1] == name)
            for (p, o, s), v in want.items():
                if p == part and o[s - 1] == name:
                    v.append(total)
    return {k: tuple(v) for k, v in want.items()}


def test_audit_equals_filters_in_every_order(spark):
    r = random.Random(11)
    words = ["a", "b", "The", "café", "x#", "100%", "NEWS", "\x1cq", " z"]
    texts = [None, "", " ", "A" * 30] + [r.choice([" ", "\n", "\t"]).join(r.choices(words if r.random() < 0.5 else [f"w{i}" for i in range(300)], k=r.choice([3, 49, 50, 80]))) for _ in range(60)]
    rows = [(i, r.choice(texts), r.choice(["a", "b", None, ""]), 1) for i in r.sample(range(1000), 160)]
    rows += [rows[3], rows[3], (rows[5][0], rows[9][1], "a", 1), (None, rows[9][1], "b", 1), (None, "no id", "b", 1)]
    labels = {k: (r.choice([0, 1, None]), r.choice([0, 1, None])) for k in r.sample(range(1000), 500)}
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([(k, q, t) for k, (q, t) in labels.items()] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(x["part"], x["filter_order"], x["step"]): tuple(x)[3:] for x in interaction.filter_audit(docs, marks).collect()}
    assert got == plainly(rows, labels)
    assert {v[-3:-1] for v in ((0, *tuple(x)[3:]) for x in interaction.filter_audit(docs, marks.limit(0)).collect())} == {(0, 0)}
    assert interaction.filter_audit(docs.limit(0), marks).count() == 0


def test_one_text_of_a_third_of_all_rows_and_one_long(spark):
    rows = [(i, "copy", "a" if i % 2 else "b", 0) for i in range(3000)] + [(9000 + i, f"text {i}", "a", 0) for i in range(6000)] + [(20_000, "long Word " * 200_000, "c", 0)]
    got = interaction.failures(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert {(x["part"], x["mask"]): x["n"] for x in got if x["n"]} == {("b", 1): 1, ("b", 17): 1499, ("a", 17): 1500, ("a", 1): 6000, ("c", 2 + 4): 1}


def test_potentials_are_sums_of_the_definition(spark):
    """P by its recursion in fractions, for a game whose values are no sums."""
    from fractions import Fraction
    from math import factorial

    from pyspark.sql import functions as F

    r, n = random.Random(2), 4
    v = [0] + [r.randint(0, 99) for _ in range(2**n - 1)]
    p = [Fraction(0)]
    for s in range(1, 2**n):
        inside = [1 << i for i in range(n) if s >> i & 1]
        p.append((v[s] + sum(p[s - b] for b in inside)) / len(inside))
    got = spark.range(1).select(interaction.potentials(F.array(*[F.lit(x).cast("long") for x in v]), n).alias("p")).first()["p"]
    assert [Fraction(x, factorial(n)) for x in got] == p
