"""Runs kept below a folder, each whole or absent: tables first, a manifest last, and readers look at manifests alone.

``<folder>/<run_id>/<table>`` holds Parquet, ``<folder>/<run_id>/manifest`` one JSON row. A run that fails on the way has no
manifest, so runs before it stay the newest; runs are never written over.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..config import TopologyConfig
from ..operators.distance import distances
from .export import flat
from .workflow import Analysis, Topology

MANIFEST = "run_id string, finished_at string, metric string, config string, rows map<string,long>, exported array<string>"
OWN = ("rows", "features", "not_finite", "samples", "assigned", "history")
OF_TOPOLOGY = ("samples", "tree", "threshold", "labels", "weighted")


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each whole run; none where nothing was ever finished."""
    try:
        return spark.read.schema(MANIFEST).json(f"{folder}/*/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def save(analysis: Analysis, folder: str, exported: dict[str, DataFrame] | None = None, run_id: str | None = None) -> str:
    """Write the analysis, and ``exported`` tables as CSV, under a new run id, which is returned.

    A table that can't be written raises and leaves no manifest. The id of a whole run is refused; that of a failed one may
    be used again, and what it left is replaced. Distances of all pairs are not kept, they follow from the vectors.
    """
    spark = analysis.rows.sparkSession
    run_id = run_id or f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    if "/" in run_id or manifests(spark, folder).where(f"run_id = '{run_id}'").count():
        raise ValueError(f"run id {run_id!r} is taken, or holds a slash")
    base, rows = f"{folder}/{run_id}", {}
    tables = {n: getattr(analysis, n) for n in OWN} | {f"topology_{n}": getattr(analysis.topology, n) for n in OF_TOPOLOGY}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}")
        rows[name] = spark.read.schema(df.schema).parquet(f"{base}/{name}").count()  # from the files' footers
    for name, df in (exported or {}).items():
        flat(df).write.mode("overwrite").option("header", True).csv(f"{base}/csv/{name}")
    done = (run_id, datetime.now(timezone.utc).isoformat(), analysis.topology.metric, json.dumps(asdict(analysis.topology.config)), rows, sorted(exported or {}))
    spark.createDataFrame([done], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{base}/manifest")
    return run_id


def load(spark: SparkSession, folder: str, run_id: str | None = None) -> Analysis:
    """The analysis of a whole run, the newest if none is named. FileNotFoundError where there is none; ValueError where a
    table has another number of rows than its manifest says."""
    known = manifests(spark, folder)
    found = (known if run_id is None else known.where(known["run_id"] == run_id)).orderBy("finished_at", ascending=False).first()
    if found is None:
        raise FileNotFoundError(f"no whole run {run_id or ''} below {folder}")
    base, tables = f"{folder}/{found['run_id']}", {}
    for name, n in found["rows"].items():
        tables[name] = spark.read.parquet(f"{base}/{name}")
        if (here := tables[name].count()) != n:
            raise ValueError(f"table {name} of run {found['run_id']} has {here} rows, its manifest says {n}")
    given = json.loads(found["config"])
    config = TopologyConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
    parts = {n: tables[f"topology_{n}"] for n in OF_TOPOLOGY}
    groups = Topology(edges=distances(parts["weighted"], found["metric"]), config=config, metric=found["metric"], **parts)
    return Analysis(topology=groups, **{n: tables[n] for n in OWN})
