import pytest

from cohortpanel.config import PANEL_WEIGHTS, PanelConfig, TopologyConfig
from cohortpanel.operators import panel, population
from cohortpanel.plans import export, suite, validate, workflow

ROWS = "file_name string, file_ordinal int, row_ordinal long, identity string, peptide string, mhc string, rank_el double"


def rows(spark, items):
    return spark.createDataFrame([(f, int(f[-1]), k, f, p, m, r) for k, (f, p, m, r) in enumerate(items)], ROWS)


def data(spark):
    return rows(spark, [("f1", "PLOW", "HLA-A*01:01", 1.0), ("f1", "PHIGH", "HLA-A*01:01", 10.0), ("f2", "PLOW", "HLA-A*01:01", 2.0), ("f2", "POTHER", "HLA-B*07:02", 5.0), ("f2", "NONE", "HLA-B*07:02", None), ("f2", "EDGE", "HLA-B*07:02", 32.7)])


BINDING = PanelConfig(max_peptides=1, weights={k: float(k == "binding") for k in PANEL_WEIGHTS})


def test_binding_only(spark):
    bound = panel.all_files(panel.binders(data(spark), 32.7))
    scores = {r["peptide"]: r["binding_score"] for r in panel.peptide_scores(bound, 32.7).collect()}
    assert scores == pytest.approx({"PLOW": 1, "POTHER": 5 / 9, "PHIGH": 0})
    got = panel.greedy_panels(bound, BINDING).collect()
    assert [r["peptide"] for r in got] == ["PLOW"] and got[0]["cumulative_patient_coverage"] == 1 and got[0]["cumulative_hla_coverage"] == 0.5


def test_prefix_ties_and_empty(spark):
    items = [(f"f{i % 3}", "ABCDEFGH"[: 7 + i % 2] + chr(65 + i) if i < 3 else chr(70 + i) * 8, f"HLA-A*0{i % 2}:01", 1.0 + i % 4) for i in range(9)]
    bound = panel.all_files(panel.binders(rows(spark, items), 32.7))
    long = [r["peptide"] for r in panel.greedy_panels(bound, PanelConfig(max_peptides=5)).orderBy("step").collect()]
    assert [r["peptide"] for r in panel.greedy_panels(bound, PanelConfig(max_peptides=3)).orderBy("step").collect()] == long[:3]
    flat = PanelConfig(max_peptides=2, weights=dict.fromkeys(PANEL_WEIGHTS, 0.0))
    first = [r["peptide"] for r in panel.greedy_panels(bound, flat).orderBy("step").collect()]
    assert first == [items[0][1], items[3][1]]  # equal scores: the earliest in file order
    assert panel.greedy_panels(bound.where("false"), flat).count() == 0
    validate.history(panel.greedy_panels(bound, PanelConfig()), [panel.GROUP], 20)
    one = panel.first_pick(bound, PanelConfig()).first()
    assert one["peptide"] == long[0]


def test_suite(spark):
    samples = spark.createDataFrame([("f1", 1, 1), ("f2", 2, 1)], "file_name string, raw_cluster int, practical_group int")
    assigned = suite.assignments(samples)
    history = suite.run_suite(data(spark), assigned, BINDING)
    assert {(r["mode"], r["group"]): r["peptide"] for r in history.collect()} == {("global", 0): "PLOW", ("honest", 1): "PLOW", ("honest", 2): "PLOW", ("practical", 1): "PLOW"}
    unions = suite.unions(history)
    assert [r["peptide"] for r in unions.where("mode = 'all'").collect()] == ["PLOW"]
    validate.union_identity(unions, suite.selected_by_group(history))
    totals = suite.summary(assigned, history).first()
    assert (totals["num_honest_groups"], totals["num_practical_groups"], totals["num_union_peptides"]) == (2, 1, 1)
    small = suite.assignments(samples, "practical", min_group_size=3)
    assert not small.first()["did_run"] and suite.run_suite(data(spark), small, BINDING).count() == 0
    assert suite.all_results(assigned, history).count() == 4


def test_labels_fall_back(spark):
    raw = spark.createDataFrame([("f1", 1), ("f2", 2)], "file_name string, cluster int")
    got = {(r["mode"], r["group"]) for r in suite.assignments(raw).collect()}
    assert got == {("global", 0), ("honest", 1), ("honest", 2), ("practical", 1), ("practical", 2)}
    with pytest.raises(ValueError):
        suite.assignments(raw.select("file_name"))


def test_reference_metrics_of_the_suite(spark):
    samples = spark.createDataFrame([("f1", 1), ("f2", 2)], "file_name string, raw_cluster int")
    reference = spark.createDataFrame([("Pop", "A", "A*01:01", 0.5, 10.0), ("Pop", "B", "B*07:02", 0.5, 10.0)], "population string, locus string, allele string, allele_frequency double, sample_size double")
    assigned = suite.assignments(samples)
    two = PanelConfig(max_peptides=2, weights=BINDING.weights)
    got = {(r["mode"], r["group"]): (r["num_files"], r["num_selected_peptides"], r["num_hit_hlas"], r["coverage_percent"]) for r in suite.reference_metrics(data(spark), assigned, suite.run_suite(data(spark), assigned, two), reference, two).collect()}
    assert got["global", 0] == (2, 2, 2, pytest.approx(93.75)) and got["honest", 1] == (1, 2, 1, pytest.approx(75)) and got["practical", 2] == (1, 2, 2, pytest.approx(93.75))


def test_whole_analysis_and_its_tables(spark, tmp_path):
    letters = "ACDEFGHIKLMNPQRSTVWY"
    items = [(f"f{i}", "".join(letters[(i * 7 + k * 3 + j * (1 + k % 5)) % 20] for j in range(9)), f"HLA-{'ABC'[k % 3]}*0{1 + k % 4}:01", 0.5 + (i * 13 + k * 29) % 60) for i in range(5) for k in range(8 + i)]
    done = workflow.analyse(rows(spark, items), TopologyConfig(merge_singletons=True, min_group_size=2, max_group_size=3))
    reference = spark.createDataFrame([("Pop", "A", "A*01:01", 0.5, 10.0)], "population string, locus string, allele string, allele_frequency double, sample_size double")
    skipped = spark.createDataFrame([("bad.csv", "no rows")], "file_name string, reason string")
    tables = export.tables_of(done, skipped=skipped, reference=reference, robustness=skipped, info={"version": "1"})
    assert set(tables) == set(export.TABLES)
    written = export.export(tables, str(tmp_path))
    assert set(written) == set(tables)
    read = {name: spark.read.option("header", True).csv(path) for name, path in written.items()}
    assert read["optimization_selection_history"].where("input_files IS NULL").count() == 0 and read["skipped_files"].count() == 1
    assert read["tda_barcode"].count() == 5 and read["optimization_selected_peptides"].count() == done.history.count()
    with pytest.raises(ValueError):
        workflow.analyse(rows(spark, items[:8]))
    with pytest.raises(ValueError):
        workflow.analyse(rows(spark, items).drop("mhc"))


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], 0.123456789)], "a int, b array<int>, c double")
    written = export.export({"tda_summary": df}, str(tmp_path))
    assert spark.read.option("header", True).csv(written["tda_summary"]).first()["b"] == "1;2"
    assert "0.123457" in export.report(df)
    both = export.union_with_blanks(df.select("a"), df.select("c"))
    assert both.columns == ["a", "c"] and {r["a"] for r in both.collect()} == {"1", ""}


def test_each_rule_of_the_boundaries_has_a_breach(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    mapping = frame([(1, 1), (2, 2)], "sample_idx int, practical_group int")
    event = "step int, stage string"
    validate.audit(mapping, frame([(1, "initial"), (2, "final")], event))
    for events in ([(1, "initial")], [(1, "initial"), (2, "repair")], [(1, "initial"), (3, "final")], [(1, "initial"), (2, "x"), (2, "x"), (4, "final")]):
        with pytest.raises(ValueError):
            validate.audit(mapping, frame(events, event))
    with pytest.raises(ValueError):
        validate.audit(mapping.unionByName(mapping), frame([(1, "initial"), (2, "final")], event))
    predicted = "file_name string, peptide string, mhc string"
    validate.panel_input(frame([("f", "P", "A")], predicted))
    for bad in ([], [("f", "", "A")], [("f", "P", None)], [(" ", "P", "A")]):
        with pytest.raises(ValueError):
            validate.panel_input(frame(bad, predicted))
    picks = "mode string, peptide string, family_id int, num_families_represented int"
    items = frame([("global", "P"), ("global", "Q")], "mode string, peptide string")
    validate.picked_within(frame([("global", "P", 1, 1), ("global", "Q", 2, 2)], picks), items, ["mode"])
    for bad in ([("global", "Z", 1, 1)], [("honest", "P", 1, 1)], [("global", "P", 0, 1)], [("global", "P", None, 1)], [("global", "P", 1, 1), ("global", "Q", 1, 2)]):
        with pytest.raises(ValueError):
            validate.picked_within(frame(bad, picks), items, ["mode"])


def test_population_warnings(spark):
    panel = spark.createDataFrame([("P", "A", "A*01:01", 0.5, None), ("P", "B", "B*07:02", 0.3, None), ("P", "B", "B*08:01", 0.9, None)], "population string, locus string, allele string, allele_frequency double, sample_size double")
    said = {r["warning"] for r in population.PopulationMetrics(spark.createDataFrame([("X", "HLA-A*01:01")], "peptide string, mhc string"), panel).warnings().collect()}
    assert said == {"fewer than two alleles of locus A", "frequencies of a locus sum to more than 1", "sample size missing, weighs 1", "no sample sizes: populations weigh alike"}
