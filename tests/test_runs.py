import os

import pytest
from pyspark.sql import functions as F

from cohortpanel.config import TopologyConfig
from cohortpanel.operators.distance import distances
from cohortpanel.plans import runs
from cohortpanel.plans.workflow import Analysis, Topology


def analysis(spark, n):
    """A small analysis whose tables differ with n."""
    ids = spark.range(1, n + 1).select(F.col("id").cast("int").alias("sample_idx"), F.concat(F.lit("f"), "id").alias("id"))
    vectors = ids.select("sample_idx", F.array(F.col("sample_idx").cast("double"), F.lit(0.5)).alias("v"))
    tree = ids.where("sample_idx > 1").select((F.col("sample_idx") - 1).alias("i"), F.col("sample_idx").alias("j"), F.lit(1.0).alias("d"))
    config = TopologyConfig(metric="cityblock", percentile=60, weights=(1.0, 2.0))
    groups = Topology(ids, distances(vectors, "cityblock"), tree, spark.createDataFrame([(1.0,)], "threshold double"), ids.withColumn("raw_cluster", F.lit(1)), config, vectors, "cityblock")
    files = ids.select(F.col("id").alias("file_name"), F.lit(1).alias("raw_cluster"))
    return Analysis(files, files, files.limit(0), groups, files, files, files)


def test_a_saved_run_comes_back(spark, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        runs.load(spark, folder)
    first = runs.save(analysis(spark, 3), folder)
    second = runs.save(analysis(spark, 4), folder, {"sizes": spark.createDataFrame([("a", [1, 2])], "name string, sizes array<int>")})
    newest, oldest = runs.load(spark, folder), runs.load(spark, folder, first)
    assert newest.samples.count() == 4 and oldest.samples.count() == 3 and newest.not_finite.count() == 0
    assert newest.topology.config == analysis(spark, 4).topology.config
    assert newest.topology.edges.count() == 6 and newest.topology.edges.agg(F.max("d")).first()[0] == 3
    assert newest.topology.barcode().count() == 4
    assert spark.read.option("header", True).csv(f"{folder}/{second}/csv/sizes").first()["sizes"] == "1;2"
    assert {r["run_id"]: r["exported"] for r in runs.manifests(spark, folder).collect()} == {first: [], second: ["sizes"]}


def test_a_failed_run_leaves_the_one_before(spark, tmp_path):
    folder = str(tmp_path)
    kept = runs.save(analysis(spark, 3), folder)
    broken = analysis(spark, 5)
    broken.history = broken.history.select(F.raise_error(F.lit("lost")).cast("int").alias("x"))
    with pytest.raises(Exception, match="lost"):
        runs.save(broken, folder, run_id="again")
    assert os.path.exists(f"{folder}/again/rows") and runs.load(spark, folder).samples.count() == 3
    with pytest.raises(FileNotFoundError):
        runs.load(spark, folder, "again")
    runs.save(analysis(spark, 2), folder, run_id="again")
    assert runs.load(spark, folder).samples.count() == 2
    for taken in ("again", kept, "a/b"):
        with pytest.raises(ValueError):
            runs.save(analysis(spark, 2), folder, run_id=taken)


def test_a_run_that_lost_rows_is_refused(spark, tmp_path):
    folder = str(tmp_path)
    run_id = runs.save(analysis(spark, 3), folder)
    analysis(spark, 2).features.write.mode("overwrite").parquet(f"{folder}/{run_id}/features")
    with pytest.raises(ValueError, match="features"):
        runs.load(spark, folder)
