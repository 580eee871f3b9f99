"""Intermediate results, kept in the folder the cluster shares.

Both ways outlive the loss of executors, and end the lineage of what is built on them.
"""

from __future__ import annotations

import gc
import tempfile
import time
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Ids are text of random digits: nothing repeats for snappy, but they take half the room in a code of their characters.
CODEC = "zstd"

_SETTING = "spark.checkpoint.dir"
_local_root: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session may go without one."""
    global _local_root
    root = spark.conf.get(_SETTING, None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError(f"{_SETTING} must name a folder that every executor reaches")
        _local_root = _local_root or tempfile.mkdtemp(prefix="loadwright-")
        root = _local_root
    return f"{root.rstrip('/')}/loadwright/{spark.conf.get('spark.app.id')}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid4().hex}"


def settle(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """Checkpoint ``df``: the quick way to end the lineage of a small frame in a loop.

    Returns the checkpointed frame and its row count as ``rows``, next to any further
    aggregates asked for, observed on the way.
    """
    spark = df.sparkSession
    if not spark.conf.get(_SETTING, None):
        spark.sparkContext.setCheckpointDir(scratch_root(spark))
    observed, seen = _observed(df, counts)
    done = observed.checkpoint()
    return done, _counts(seen, counts)


def _observed(df: DataFrame, counts: dict[str, Column]) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in counts.items())), seen


def _counts(seen: Observation, counts: dict[str, Column]) -> dict[str, int]:
    # a plan that is known to be empty reports nothing
    found = seen.get
    return {name: found.get(name) or 0 for name in ("rows", *counts)}


def cut(df: DataFrame, label: str, codec: str | None = CODEC, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """Write ``df`` as Parquet and read it back: as ``settle``, but columnar, for large frames.

    Without ``codec`` the session's is used.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    observed, seen = _observed(df, counts)
    observed.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path), _counts(seen, counts)


def release(df: DataFrame) -> None:
    """Have the shuffle files of finished jobs removed.

    Spark removes them when the driver has collected what stood for them, which a driver with a free heap does late.
    Listeners hold a job for a moment after its end, so it is asked for twice.
    """
    for pause in (0.5, 0):
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(pause)
