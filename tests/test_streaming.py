import random
from datetime import datetime, timedelta

import pytest

from cohortpanel.functions.normalize import allele_name, number
from cohortpanel.operators import features
from cohortpanel.streaming.incremental import INPUT, rows_stream, running_counts
from cohortpanel.streaming.running import running_figures
from pyspark.sql import functions as F


def test_running_counts(spark, tmp_path):
    at = datetime(2024, 1, 1, 12)
    spark.createDataFrame([("f1", "S", "PEP", "a*02:01", "1.5", at), ("f1", "S", "PEP", "A*02:01", "bad", at)], INPUT).write.parquet(str(tmp_path / "in"))
    query = running_counts(rows_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    row = spark.table("counts").first()
    assert (row["num_rows"], row["num_ranks"], row["best_rank"], row["approx_unique_hlas"]) == (2, 1, 1.5, 1)


def test_running_figures_equal_those_of_all_rows(spark, tmp_path):
    """Rows in any order, in several batches and with a restart between them, give the batch figures; idle samples close."""
    r = random.Random(12)
    at = datetime(2024, 1, 1, 12)
    rows = [(f"f{r.randrange(3)}", "S", "".join(r.choices("ACD", k=r.choice([3, 7]))), r.choice(["A*01:01", "A*02:01", "B*07:02"]), r.choice(["bad", str(round(r.uniform(0, 9), 3))]), at + timedelta(minutes=r.randrange(50))) for _ in range(400)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen = []

    def keep(batch, _):
        seen.extend(batch.collect())

    def arrive(part):
        spark.createDataFrame(part, INPUT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = running_figures(rows_stream(spark, str(tmp_path / "in")), "2 hours", 120).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()

    try:
        spark.createDataFrame([], INPUT).write.parquet(str(tmp_path / "in"))
        arrive(rows[:150])
        arrive(rows[150:])  # a new query from the state on disk
        last = {x["file_name"]: x.asDict() for x in seen}
        assert len(last) == 3 and not any(x["closed"] for x in seen)
        arrive([("late", "S", "CCC", "A*01:01", "1", at + timedelta(days=2))])
        arrive([("late", "S", "CCC", "A*01:01", "1", at + timedelta(days=2))])
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    typed = spark.createDataFrame(rows, INPUT).withColumns({"mhc": allele_name(F.col("mhc")), "rank_el": number(F.col("rank_el"))})
    for want in features.sample_features(typed).collect():
        got = last[want["file_name"]]
        for c in got:
            if c not in ("file_name", "closed"):
                assert got[c] == pytest.approx(want[c], abs=1e-9), c
    closed = {x["file_name"]: x for x in seen if x["closed"]}
    assert set(closed) == set(last) and all(closed[k]["num_rows"] == last[k]["num_rows"] for k in last)
