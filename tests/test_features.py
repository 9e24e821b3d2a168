import collections
import math
import random
import statistics

import pytest

from cohortpanel.config import FEATURES
from cohortpanel.functions.normalize import allele_name, file_key, kmers, number
from cohortpanel.operators import families, features
from cohortpanel.sources import bindings
from cohortpanel.sources.typing_table import read_typing
from pyspark.sql import functions as F


def write(folder, name, lines):
    (folder / name).write_text("\n".join(lines) + "\n")


def test_golden_sample(spark, tmp_path):
    write(tmp_path, "s1.csv", ["Identity,Peptide,MHC,%Rank_EL", "S1,ABCDEFG,HLA-A*01:01,1", "S1,XXABCDEFGY,HLA-A*02:01,3", "S1,CCCCCCC,HLA-A*01:01,5"])
    read = bindings.read_bindings(spark, str(tmp_path))
    row = features.sample_features(read.rows).first()
    expected = {
        "num_unique_peptides": 3, "num_unique_HLAs_hit": 2, "best_rank": 1, "mean_rank": 3, "rows_per_unique_peptide": 1, "num_peptide_families": 2, "largest_peptide_family_size": 2, "num_rows": 3,
        "median_rank": 3, "mean_top3_rank": 3, "mean_top5_rank": 3, "rank_std": 2, "peptide_promiscuity_mean": 1, "peptide_promiscuity_max": 1, "mean_peptide_length": 8, "mean_best_rank_per_peptide": 3,
        "hla_entropy": 0.636514, "frac_peptides_in_family_size_gt_1": 2 / 3, "mean_best_rank_per_family": 3,
    }
    for name, value in expected.items():
        assert row[name] == pytest.approx(value, abs=1e-6), name
    vectors, bad = features.feature_vectors(features.sample_features(read.rows))
    assert len(vectors.first()["features"]) == len(FEATURES) and bad.count() == 0


def test_skipped_samples(spark, tmp_path):
    head = "Identity,Peptide,MHC,%Rank_EL"
    write(tmp_path, "a.csv", [head, "S,PEP,a*02:01,1", "S,PEP2,A*02:01,bad"])
    write(tmp_path, "b.csv", [head, "S,PEP,A*02:01,1", "T,PEP,A*02:01,1"])
    write(tmp_path, "c.csv", [head, "S,PEP,,1"])
    write(tmp_path, "d.csv", [head, "S,PEP,A*02:01,bad"])
    write(tmp_path, "e.csv", ["Identity,Peptide,MHC", "S,PEP,A*02:01"])
    write(tmp_path, "f.csv", ["Score,%Rank_EL,MHC,Peptide,Identity", '1,"1,000",A*02:01,PEP,S'])
    write(tmp_path, "group_x.csv", [head, "S,PEP,A*02:01,1"])
    read = bindings.read_bindings(spark, str(tmp_path))
    reasons = {r["file_name"]: r["reason"] for r in read.skipped.collect()}
    assert reasons == {"b.csv": "not exactly one identity", "c.csv": "blank MHC", "d.csv": "no numeric rank", "e.csv": "missing column: %Rank_EL"}
    rows = {(r["file_name"], r["peptide"]): r for r in read.rows.collect()}
    assert set(rows) == {("a.csv", "PEP"), ("a.csv", "PEP2"), ("f.csv", "PEP")}
    assert rows["f.csv", "PEP"]["rank_el"] == 1000 and rows["a.csv", "PEP2"]["rank_el"] is None and rows["a.csv", "PEP"]["mhc"] == "HLA-A*02:01"
    counts = features.basic_counts(read.rows).where("file_name = 'a.csv'").first()
    assert counts["num_rows"] == 2
    assert features.entropy(read.rows).where("file_name = 'a.csv'").first()["hla_entropy"] == pytest.approx(0, abs=1e-12)
    with pytest.raises(FileNotFoundError):
        bindings.list_samples(spark, str(tmp_path), excluded=("a", "b", "c", "d", "e", "f", "group_"))


def test_typing(spark, tmp_path):
    samples = tmp_path / "in"
    samples.mkdir()
    for name in ("s1.csv", "S2.csv", "s3.csv"):
        write(samples, name, ["Identity,Peptide,MHC,%Rank_EL", "S,P1,A*02:01,1", "S,P2,B*07:02,2"])
    write(tmp_path, "typing.csv", ["S 1.CSV,A*02:01,,,,,", "s2.txt,B*07:02, b*07:02,,,,", "s1.csv,B*07:02,,,,,"])
    read = bindings.read_bindings(spark, str(samples), read_typing(spark, str(tmp_path / "typing.csv")))
    assert {(r["file_name"], r["peptide"]) for r in read.rows.collect()} == {("s1.csv", "P1"), ("S2.csv", "P2")}
    assert [r["reason"] for r in read.skipped.collect()] == ["no typing"]


def test_scalars(spark):
    df = spark.createDataFrame([(" a*02:01,\t", "1e3", "C:/x/S 1.Tar.CSV", "ABC")], "a string, n string, f string, p string")
    row = df.select(allele_name(F.col("a")), number(F.col("n")), file_key(F.col("f")), file_key(F.col("f"), True), kmers(F.col("p"), 7), kmers(F.col("p"), 2)).first()
    assert tuple(row) == ("HLA-A*02:01", 1000.0, "s1.tar.csv", "s1.tar", [], ["AB", "BC"])
    odd = spark.createDataFrame([("1d",), ("nan",), ("-Inf",), ("x",), (None,)], "n string").select(number(F.col("n")).alias("n"))
    assert [r["n"] for r in odd.collect()] == [None, None, -math.inf, None, None]


def test_medians_of_buckets(spark):
    r = random.Random(3)
    ranks = {f"s{n}": [round(r.choice((r.random(), 50 * r.random(), 3.0)), 3) for _ in range(n)] for n in (1, 2, 3, 10, 101, 500)} | {"same": [2.0] * 40, "apart": [0.0, 1e6]}
    rows = spark.createDataFrame([(s, x) for s, xs in ranks.items() for x in xs] + [("s3", None), ("empty", None)], "file_name string, rank_el double")
    got = {x["file_name"]: x["median_rank"] for x in features.medians(rows).collect()}
    assert got == {s: pytest.approx(statistics.median(xs)) for s, xs in ranks.items()}


def test_families_of_a_large_sample_equal_those_of_one_task(spark):
    """One sample above the bound has one family of most of its peptides."""
    r = random.Random(6)
    letters = "".join(r.choices("ACDEFGHIKL", k=300))
    rows = [("big.csv", letters[k : k + 9]) for k in range(0, 290, 2)] + [("big.csv", "".join(r.choices("MNPQRSTVWY", k=9))) for _ in range(40)] + [("big.csv", "SHORT")]
    rows += [("small.csv", p) for _, p in rows[::9]]
    peptides = spark.createDataFrame(rows, "file_name string, peptide string")
    found = lambda small: sorted(map(tuple, families.peptide_families(peptides, 7, small=small).collect()))
    assert found(50) == found(10_000) and max(collections.Counter(f for s, _, f in found(50) if s == "big.csv").values()) == 145


def test_csv_records_of_any_shape(spark, tmp_path):
    """Quoted commas, line ends and quotes, byte order marks, other encodings, ragged records; broken files have a reason."""
    head = "Identity,Peptide,MHC,%Rank_EL"
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + (head + ',Note\r\n\r\n"S","PEP", A*02:01 ,1,"two\nlines, one ""cell"""\r\nS,PEP2,A*02:01,2\r\n').encode())
    (tmp_path / "b.csv").write_bytes((head + "\nS\u00e9,PEP,A*02:01,1,more,than,the,header\n").encode("cp1252"))
    (tmp_path / "c.csv").write_text(head + '\nS,"PEP,A*02:01,1\n')
    (tmp_path / "d.csv").write_text("\n \n")
    (tmp_path / "e.csv").write_text(head + "\n")
    (tmp_path / "f.csv").write_text('Note,Identity,Peptide,MHC,"%Rank_EL"\n"' + "x" * 300_000 + '\n",S,PEP,A*02:01,3\n')
    read = bindings.read_bindings(spark, str(tmp_path))
    reasons = {r["file_name"]: r["reason"] for r in read.skipped.collect()}
    assert reasons.pop("c.csv").startswith("not CSV") and reasons == {"d.csv": "empty file", "e.csv": "no rows"}
    rows = sorted((r["file_name"], r["row_ordinal"], r["identity"], r["peptide"], r["mhc"], r["rank_el"]) for r in read.rows.collect())
    assert rows == [
        ("a.csv", 1, "S", "PEP", "HLA-A*02:01", 1.0), ("a.csv", 2, "S", "PEP2", "HLA-A*02:01", 2.0), ("b.csv", 1, "S\u00e9", "PEP", "HLA-A*02:01", 1.0), ("f.csv", 1, "S", "PEP", "HLA-A*02:01", 3.0),
    ]
