"""Tables in the session catalog: staging tables, key maps, clustered copies."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loadwright.functions.types import spark_type
from loadwright.operators.skew import hot_hashes, lookup_join
from loadwright.operators.staging import StagedColumn
from loadwright.sources.commits import (APPEND, PART, PARTS, REPLACE, Entry, columns_of, commit, field_list, live_folders,
                                        newest, version_store)
from loadwright.sources.scratch import CODEC

# How a staging table is prepared before rows are appended.
DROP_AND_RECREATE, CREATE_IF_MISSING = "drop_recreate", "create_if_missing"


def write_staging(df: DataFrame, name: str, columns: Sequence[StagedColumn],
                  mode: str = DROP_AND_RECREATE) -> DataFrame:
    """Prepare the staging table, then append the rows.

    Drop and recreate starts empty; create if missing keeps a table and its rows.
    """
    spark = df.sparkSession
    if mode not in (DROP_AND_RECREATE, CREATE_IF_MISSING):
        raise ValueError(f"unknown staging mode: {mode}")
    if mode == DROP_AND_RECREATE:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    fields = ", ".join(f"`{c.name}` {spark_type(c.sql_type)}" for c in columns)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({fields}) USING parquet OPTIONS (compression '{CODEC}')")
    df.select(*(c.name for c in columns)).write.insertInto(name)
    return spark.table(name)


def _same_shape(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` in the column order of the stored table, which gets the columns that are new."""
    stored = {f.name.lower(): f for f in spark.table(name).schema}
    given = {f.name.lower(): f for f in df.schema}
    lost = [f.name for key, f in stored.items() if key not in given]
    # whether inner fields may be null does not matter
    other = [f.name for key, f in stored.items()
             if key in given and given[key].dataType.simpleString() != f.dataType.simpleString()]
    if lost or other:
        raise ValueError(f"{name} would lose columns {lost} and change the type of {other}")
    added = [f for key, f in given.items() if key not in stored]
    if added:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in added)
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({fields})")
    return df.select(*(given[key].name for key in stored), *(f.name for f in added))


def _write_version(df: DataFrame, name: str, folder: str, key: str | None, buckets: int | None) -> int:
    """Write ``df`` into a folder beside the versions of ``name``, bucketed where asked for; returns the rows."""
    spark = df.sparkSession
    path = f"{version_store(spark, name).root}/{folder}"
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    if buckets:
        database = name.rpartition(".")[0]
        # files of a bucketed table can only be written through the catalog; dropping the name leaves them
        helper = f"{database + '.' if database else ''}writing_{folder}"
        spark.sql(f"CREATE TABLE {helper} ({field_list(columns_of(df))}) USING parquet OPTIONS (compression '{CODEC}') "
                  f"CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
        try:
            counted.repartitionById(buckets, F.pmod(F.hash(key), F.lit(buckets))).write.insertInto(helper)
        finally:
            spark.sql(f"DROP TABLE {helper}")
    else:
        counted.write.parquet(path, compression=CODEC)
    return _reported(seen, "rows")


def _reported(seen: Observation, what: str) -> int:
    try:
        return seen.get.get(what) or 0
    except Py4JJavaError:  # the planner found at run time that there are no rows, and dropped the observer with them
        return 0


def publish(df: DataFrame, name: str, key: str | None = None, buckets: int | None = None) -> DataFrame:
    """Replace the content of table ``name``: write a new version, then switch to it.

    Versions lie below the location of the database, so they outlive the application and its
    intermediate results.  ``df`` may read the table itself.  The old version stays where it is,
    so readers that have started are not disturbed; ``remove_old_versions`` deletes those.
    With ``buckets`` a new table is bucketed by ``key``; a stored one keeps the buckets it has.

    Columns that the stored table lacks are added to it; a column that is missing or has
    another type fails, and nothing is written.
    """
    spark = df.sparkSession
    if spark.catalog.tableExists(name):
        df = _same_shape(spark, df, name)
        last = newest(spark, name)[1] or {}
        key, buckets = last.get("key"), last.get("buckets")
    folder = uuid4().hex
    rows = _write_version(df, name, folder, key, buckets)
    commit(spark, name, lambda _: {"kind": REPLACE, "version": folder, "rows": rows, "columns": columns_of(df),
                                   "key": key, "buckets": buckets})
    return spark.table(name)


def stored_rows(spark: SparkSession, name: str) -> int | None:
    """How many rows a published table has, by its commits."""
    return (newest(spark, name)[1] or {}).get("rows")


def remove_old_versions(spark: SparkSession, name: str, keep: int = 1) -> int:
    """Delete the folders that the current state of a published table does not use, but for the ``keep - 1`` newest."""
    store = version_store(spark, name)
    live = live_folders(spark, name)
    ages = {folder: age for folder, age in store.ages().items() if folder not in live and not folder.startswith("_")}
    old = sorted(ages, key=lambda folder: -ages[folder])[keep - 1:]
    for folder in old:
        store.delete(folder)
    return len(old)


def _bucket_of(file: str) -> int | None:
    found = re.search(r"_(\d{5})(?:\..*)?$", file)
    return int(found[1]) if found else None


def accumulate_key_map(new: DataFrame, name: str, buckets: int | None = None) -> DataFrame:
    """Add the unseen keys of ``new`` to the stored map; the default for key maps.

    A new map gets ``buckets`` buckets by legacy_key, as many as the session has shuffle partitions if not given.
    Unseen keys are appended: of the stored files only those in buckets that ``new`` has keys for are read, and
    none is written again.  Two runs that add at the same time both keep all their keys; of a key that both add
    the first stays.  ``new`` is read again when another run comes first, so it should be a written frame, unique on
    its key.
    """
    spark = new.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def build(last: Entry | None) -> Entry | None:
        folder = uuid4().hex
        if last is None:
            rows = _write_version(new, name, folder, "legacy_key", buckets)
            return {"kind": REPLACE, "version": folder, "rows": rows, "columns": columns_of(new), "key": "legacy_key",
                    "buckets": buckets}
        store = version_store(spark, name)
        stored = [f for f in store.names(last["version"]) if f.endswith(".parquet")]
        key, n = last.get("key"), last.get("buckets")
        if n:
            touched = {r[0] for r in new.select(F.pmod(F.hash("legacy_key"), F.lit(n)).alias("b")).distinct().collect()}
            stored = [f for f in stored if _bucket_of(f) in touched]
        paths = [f"{store.root}/{last['version']}/{f}" for f in stored]
        unseen = new
        if paths:
            known = spark.read.schema("legacy_key STRING").parquet(*paths)
            unseen = lookup_join(new, known, ["legacy_key"], "left_anti")
        widened = _same_shape(spark, _filled(unseen, spark.table(name)), name)
        added = _write_version(widened, name, folder, key, n)
        if not added:
            store.delete(folder)
            return None
        files = [f for f in store.names(folder) if f.endswith(".parquet")]
        return last | {"kind": APPEND, "staged": folder, "files": files, "rows": last["rows"] + added,
                       "columns": columns_of(widened)}

    commit(spark, name, build)
    return spark.table(name)


def _filled(df: DataFrame, stored: DataFrame) -> DataFrame:
    """``df`` with nulls for columns that only the stored table has."""
    given = {c.lower() for c in df.columns}
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in stored.schema if f.name.lower() not in given})


def rebuild_key_map(new: DataFrame, name: str, buckets: int | None = None) -> DataFrame:
    """Replace the stored map, ids accumulated in earlier runs included; also joins the files that runs have added."""
    return publish(new, name, "legacy_key", buckets or int(new.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def add_parts(df: DataFrame, name: str, batch: str, open_rows: Column | None = None, whole: bool = False) -> tuple[DataFrame, int]:
    """Append ``df`` to a table of parts, one for each task that writes, named by ``batch``; ``whole`` drops all others.

    Returns the rows of the batch, with ``part``, and for how many of them ``open_rows`` holds.
    """
    spark = df.sparkSession
    marked = df.withColumn(PART, F.concat(F.lit(f"{batch}-"), F.lpad(F.spark_partition_id().cast("string"), 6, "0")))
    folder, n_open = _write_parts(marked, name, open_rows)
    parts = _parts_in(spark, name, folder)
    commit(spark, name, lambda _: {"kind": PARTS, "columns": columns_of(df), "parts": parts, "whole": whole})
    return spark.table(name).where(F.startswith(PART, F.lit(f"{batch}-"))), n_open


def rewrite_parts(name: str, spark: SparkSession, parts: Sequence[str], change: Callable[[DataFrame], DataFrame]) -> None:
    """Write the named parts again with their rows changed; all other parts keep their files.

    When another run commits meanwhile, the rows are read and changed again.
    """
    def build(last: Entry | None) -> Entry:
        rows = spark.table(name).where(F.col(PART).isin(list(parts)))
        changed = change(rows)
        folder, _ = _write_parts(changed.repartition(PART), name, None)
        return {"kind": PARTS, "columns": columns_of(changed.drop(PART)), "parts": _parts_in(spark, name, folder)}

    if parts:
        commit(spark, name, build)


def _write_parts(df: DataFrame, name: str, open_rows: Column | None) -> tuple[str, int]:
    spark, folder = df.sparkSession, uuid4().hex
    if spark.catalog.tableExists(name):
        df = _same_shape(spark, _filled(df, spark.table(name)), name)
    seen = Observation()
    marked = df.observe(seen, F.count_if(F.lit(False) if open_rows is None else open_rows).alias("open"))
    marked.write.partitionBy(PART).parquet(f"{version_store(spark, name).root}/{folder}", compression=CODEC)
    return folder, _reported(seen, "open")


def _parts_in(spark: SparkSession, name: str, folder: str) -> dict[str, str]:
    found = [f for f in version_store(spark, name).names(folder) if f.startswith(f"{PART}=")]
    return {f.split("=", 1)[1]: f"{folder}/{f}" for f in found}


class Clustered(NamedTuple):
    """A table split for co-located joins on ``key``: bucketed rows, and the rows of hot keys."""

    bucketed: str
    spread: str
    key: str
    hot: list[int]


def cluster_by_match_key(df: DataFrame, key: str, name: str, buckets: int,
                         hot: list[int] | None = None) -> Clustered:
    """Store ``df`` bucketed and sorted by a match key, so that joins on it need no shuffle.

    Rows of hot keys would fill one bucket; they go to a second table in their present
    partitioning.  Pass the ``hot`` list of the other side to split both sides alike.
    """
    spark = df.sparkSession
    if hot is None:
        hot = hot_hashes(df, [key])[0]
    is_hot = F.xxhash64(key).isin(hot) if hot else F.lit(False)
    names = name, f"{name}_spread"
    for table in names:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    (df.where(~is_hot).repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
     .format("parquet").saveAsTable(names[0]))
    df.where(is_hot).write.format("parquet").saveAsTable(names[1])
    return Clustered(*names, key, hot)


def clustered_lookup(rows: Clustered, entries: Clustered, spark: SparkSession) -> DataFrame:
    """Left join of two tables clustered alike, ``entries`` unique on its key.

    The bucketed parts meet bucket by bucket; hot rows meet their few entries by broadcast.
    """
    if rows.hot != entries.hot:
        raise ValueError("both sides must be split by the same hot keys")

    def joined(left: str, right: DataFrame) -> DataFrame:
        facts = spark.table(left)
        return facts.join(right, facts[rows.key] == right[entries.key], "left")

    near = joined(rows.bucketed, spark.table(entries.bucketed).hint("merge"))
    # as many entries as there are hot keys at most
    far = joined(rows.spread, F.broadcast(spark.table(entries.spread)))
    return near.unionByName(far)


def reset_staging(spark: SparkSession, tables: Iterable[str], key_maps: Iterable[str] = ()) -> None:
    """Empty staging tables, given in reverse load order.

    Key maps hold ids accumulated over many runs; they are emptied only where named.
    """
    for name in tables:
        spark.sql(f"TRUNCATE TABLE {name}")
    for name in key_maps:
        publish(spark.table(name).where("false"), name)


def teardown(spark: SparkSession, tables: Iterable[str], key_maps: Iterable[str] = ()) -> None:
    """Drop staging tables, given in reverse load order; key maps, with all their versions, only where named."""
    for name in tables:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for name in key_maps:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        version_store(spark, name).delete("")
