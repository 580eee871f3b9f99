"""What a run has finished: one small file for each table and stage, below the location of the database."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from loadwright.sources.commits import Store

_SCHEMA = "run_id STRING, `table` STRING, stage STRING, commit BIGINT"


def _store(spark: SparkSession, database: str) -> Store:
    return Store(spark, f"{spark.catalog.getDatabase(database).locationUri.rstrip('/')}/run_journal")


def record(spark: SparkSession, database: str, run_id: str, table: str, stage: str, commit: int = 0) -> None:
    """Note that ``stage`` of ``table`` is finished, and under which commit; noting it again changes nothing."""
    text = json.dumps({"run_id": run_id, "table": table, "stage": stage, "commit": commit})
    _store(spark, database).put_if_absent(f"{run_id}/{table}.{stage}.json", text)


def recorded(spark: SparkSession, database: str, run_id: str) -> dict[tuple[str, str], dict[str, Any]]:
    """(table, stage) -> entry of one run: few small files, read by the driver."""
    store = _store(spark, database)
    entries = [json.loads(store.read(f"{run_id}/{name}")) for name in store.names(run_id)]
    return {(e["table"], e["stage"]): e for e in entries}


def journal(spark: SparkSession, database: str) -> DataFrame:
    """run_id, table, stage and commit of all runs of a database."""
    store = _store(spark, database)
    if not [run for run in store.names() if not run.startswith("_")]:
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(_SCHEMA).json(f"{store.root}/*/*.json")
