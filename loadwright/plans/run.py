"""Running a load plan: table by table, tier by tier, then the deferred update pass."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from uuid import uuid4

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadwright.operators.identity import has_key, with_row_identity
from loadwright.operators.keymap import build_key_map, key_map_conflicts, key_map_entries
from loadwright.operators.pending import is_open, open_links, parts_to_fill
from loadwright.operators.resolve import (deferred_polymorphic, deferred_update, link_status,
                                          resolve_lookups, resolve_polymorphic)
from loadwright.operators.skew import lookup_join
from loadwright.operators.staging import StagedColumn, checked_rows, split_checked
from loadwright.operators.waves import with_waves
from loadwright.options import PlanOptions
from loadwright.sources.commits import PART, newest
from loadwright.sources.journal import record, recorded
from loadwright.sources.scratch import CODEC, cut, new_path
from loadwright.sources.tables import (CREATE_IF_MISSING, DROP_AND_RECREATE, accumulate_key_map, add_parts, publish,
                                       rebuild_key_map, rewrite_parts, stored_rows, write_staging)

_KEY_MAP = "target_id string, legacy_key string"


@dataclass(frozen=True)
class TableLoad:
    """What one table needs: its rows, layout, match key, lookups and the loader.

    ``lookups`` names the target table of each lookup column, ``polymorphic`` the possible
    targets of each lookup whose target is named in its ``type`` companion.  ``load`` takes
    the resolved rows to the target system and returns them with the ``target_id`` the
    target gave each row.  It is called once for each wave of a table that refers to itself.
    """

    source: DataFrame
    columns: list[StagedColumn]
    match_key: str
    load: Callable[[DataFrame], DataFrame]
    lookups: Mapping[str, str] = field(default_factory=dict)
    polymorphic: Mapping[str, list[str]] = field(default_factory=dict)
    scales: Mapping[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class LoadedTables:
    """Per table: the rows this run loaded, its key map and what stays out of that, the rejects, and the
    name of its staging table; and the id under which the run can be continued.
    """

    loaded: dict[str, DataFrame] = field(default_factory=dict)
    key_maps: dict[str, DataFrame] = field(default_factory=dict)
    conflicts: dict[str, DataFrame] = field(default_factory=dict)
    rejects: dict[str, DataFrame] = field(default_factory=dict)
    staging: dict[str, str] = field(default_factory=dict)
    run_id: str = ""


def run_plan(spark: SparkSession, order: DataFrame, dropped: DataFrame, loads: Mapping[str, TableLoad],
             database: str, options: PlanOptions = PlanOptions(), parallel: int = 4,
             run_id: str | None = None) -> LoadedTables:
    """Load the tables of one environment in plan order, under the prefixes and modes of ``options``.

    ``order`` has (table, tier) and ``dropped`` (src, dst) of that environment: one row
    per job to start and per lookup to postpone.  Tables of a tier run side by side; a
    tier starts when all key maps of the one before are written.

    Each source is read once.  Rejects carry the match key and ``source_row``, a digest of the row and its number
    among equal rows.  Rows whose match key the stored key map has are not loaded again, nor are rows without a key
    whose digest and number an earlier run has loaded (``rows_<table>``).

    A table with a lookup to itself is loaded in waves along the first such lookup: the ids of a wave join the key map
    before the next one is resolved, against the wave before it.  Only links that open a ring wait for the deferred pass,
    and those of the rows from wave ``options.most_waves`` on, which are loaded together.

    ``loaded_<table>`` keeps the rows of all runs in parts.  Links that find no target stay in ``pending_<table>``, over
    runs; the deferred pass rewrites the parts with a link that can be filled now, and no others.

    What a table has finished is in the run journal of the database.  A run that was ended may be started again with its
    ``run_id``: finished steps are left out, and rows whose ids were published are not loaded again.
    """
    tiers: dict[int, list[str]] = {}
    for row in order.select("table", "tier").collect():
        tiers.setdefault(row["tier"], []).append(row["table"].lower())
    late = {(r["src"], r["dst"]) for r in dropped.select("src", "dst").collect()}
    run = run_id or uuid4().hex[:16]
    done = LoadedTables(run_id=run)
    finished = recorded(spark, database, run) if run_id else {}
    n_open: dict[str, int] = {}

    def finish(table: str, stage: str, name: str) -> None:
        record(spark, database, run, table, stage, newest(spark, name)[0])

    def map_name(table: str) -> str:
        return f"{database}.{options.key_map_prefix}{table.lower()}"

    def key_map(table: str) -> DataFrame:
        """The map of this run, or what earlier runs have stored."""
        if table.lower() in done.key_maps:
            return done.key_maps[table.lower()]
        known = spark.catalog.tableExists(map_name(table))
        return spark.table(map_name(table)) if known else spark.createDataFrame([], _KEY_MAP)

    def size(table: str) -> int | None:
        return stored_rows(spark, map_name(table)) if spark.catalog.tableExists(map_name(table)) else 0

    def postponed(table: str, target: str) -> bool:
        return target == table or (table, target) in late

    def resolved(rows: DataFrame, table: str) -> DataFrame:
        """All lookups but those to the table itself; postponed ones stay null."""
        job = loads[table]
        single = {c: t for c, t in job.lookups.items() if not postponed(table, t)}
        rows = resolve_lookups(rows, single, {t: key_map(t) for t in single.values()}, {t: size(t) for t in single.values()})
        for column, targets in job.polymorphic.items():
            known = {t: key_map(t) for t in targets if not postponed(table, t)}
            rows = resolve_polymorphic(rows, column, known, sizes={t: size(t) for t in known}) if known else rows
        return rows

    def with_all_links(rows: DataFrame, table: str) -> DataFrame:
        """Postponed lookups get their columns: no id, and unresolved where there is a key."""
        missing = [c for c in (*loads[table].lookups, *loads[table].polymorphic) if f"{c}_id" not in rows.columns]
        nothing = F.lit(None).cast("string")
        return rows.withColumns({
            name: column for c in missing
            for name, column in ((f"{c}_id", nothing), (f"{c}_status", link_status(F.col(c).cast("string"), nothing)))})

    def any_open(table: str) -> Column:
        return reduce(Column.__or__, (is_open(c) for c in (*loads[table].lookups, *loads[table].polymorphic)), F.lit(False))

    def not_loaded(rows: DataFrame, table: str, some_without_key: bool) -> DataFrame:
        """Rows that no run has loaded, with ``source_row`` for those without a key."""
        key, columns = loads[table].match_key, rows.columns
        keyed = rows.where(has_key(key)) if some_without_key else rows
        if spark.catalog.tableExists(map_name(table)):
            known = spark.table(map_name(table)).select(F.col("legacy_key").alias("_known"))
            keyed = keyed.withColumn("_known", F.col(key).cast("string"))
            keyed = lookup_join(keyed, known, ["_known"], "left_anti", right_rows=size(table)).select(*columns)
        keyed = keyed.withColumn("source_row", F.lit(None).cast("string"))
        if not some_without_key:
            return keyed
        others = with_row_identity(rows.where(~has_key(key)), columns, "source_row")
        ledger = f"{database}.rows_{table}"
        if spark.catalog.tableExists(ledger):
            known = spark.table(ledger).select(F.col("legacy_key").alias("source_row"))
            others = lookup_join(others, known, ["source_row"], "left_anti", right_rows=stored_rows(spark, ledger))
        return keyed.unionByName(others)

    def remember(loaded: DataFrame, table: str, entries: DataFrame, some_without_key: bool) -> None:
        """Add the ids of published rows to the key map, and of rows without a key to the ledger."""
        done.key_maps[table] = accumulate_key_map(entries, map_name(table), options.key_map_buckets)
        if some_without_key:
            ids, _ = cut(key_map_entries(loaded.where(F.col("source_row").isNotNull()), "target_id", "source_row"), "row-ids")
            accumulate_key_map(ids, f"{database}.rows_{table}", options.key_map_buckets)

    def load_one(table: str) -> None:
        job = loads[table]
        key, name = job.match_key, f"{database}.{options.staging_prefix}{table}"
        loaded_name, rejects_name = f"{database}.loaded_{table}", f"{database}.rejects_{table}"
        done.staging[table] = name
        if (table, "loaded") in finished:
            done.loaded[table] = spark.table(loaded_name).where(F.startswith(PART, F.lit(f"{run}-")))
            done.rejects[table] = spark.table(rejects_name)
            done.key_maps[table] = spark.table(map_name(table))
            done.conflicts[table] = key_map_conflicts(done.loaded[table], "target_id", key, done.key_maps[table], size(table))
            return
        wanted = {c.name.lower() for c in job.columns} | {key.lower()}
        source = job.source.select(*(c for c in job.source.columns if c.lower() in wanted))
        bad = F.size("_misfits") > 0
        checked, seen = cut(checked_rows(source, job.columns, job.scales), f"checked-{table}",
                            bad=F.count_if(bad), keyless=F.count_if(~has_key(key)))
        rejected = checked.where(bad)
        if seen["bad"]:
            rejected = with_row_identity(rejected, source.columns, "source_row")
        else:
            rejected = rejected.withColumn("source_row", F.lit(None).cast("string"))
        clean = split_checked(checked, job.columns, [], job.scales).clean
        if (table, "staged") not in finished:
            write_staging(clean, name, job.columns,
                          DROP_AND_RECREATE if options.staging_drop_recreate else CREATE_IF_MISSING)
            publish(rejected.select(key, "source_row", F.inline("_misfits")), rejects_name)
            if options.key_map_drop_recreate:
                for target in (map_name(table), f"{database}.rows_{table}"):
                    if spark.catalog.tableExists(target):
                        rebuild_key_map(spark.table(target).where("false"), target, options.key_map_buckets)
            finish(table, "staged", rejects_name)
        done.rejects[table] = spark.table(rejects_name)

        keyless = seen["keyless"] > 0
        batch = f"{run}-{uuid4().hex[:8]}"
        if (table, "staged") in finished and spark.catalog.tableExists(loaded_name):
            # rows that were published before the run was ended, whose ids may not be in the map yet
            before = spark.table(loaded_name).where(F.startswith(PART, F.lit(f"{run}-")))
            ids, _ = cut(key_map_entries(before, "target_id", key), "ids-again")
            remember(before, table, ids, keyless)
        rows = not_loaded(clean, table, keyless)
        links = [c for c, t in job.lookups.items() if t == table]
        # a run that starts anew replaces what is loaded; one that goes on with a table adds to it
        fresh = options.key_map_drop_recreate and (table, "staged") not in finished
        if links:
            _load_waves(table, rows, links, batch, keyless, fresh)
        else:
            ready = with_all_links(resolved(rows, table), table)
            loaded, n_open[table] = add_parts(job.load(ready), loaded_name, batch, any_open(table), whole=fresh)
            found = build_key_map(loaded, "target_id", key)
            remember(loaded, table, found.entries, keyless)
        done.loaded[table] = spark.table(loaded_name).where(F.startswith(PART, F.lit(f"{run}-")))
        # of a table that is loaded in waves, or in two goes, the map has the row that came first
        whole = not links and (table, "staged") not in finished
        done.conflicts[table] = found.conflicts if whole else key_map_conflicts(
            done.loaded[table], "target_id", key, done.key_maps[table], size(table))
        finish(table, "loaded", loaded_name)

    def _load_waves(table: str, rows: DataFrame, links: list[str], batch: str, keyless: bool, fresh: bool) -> None:
        job, name = loads[table], f"{database}.loaded_{table}"
        rows, _ = cut(rows, f"to-load-{table}")
        wave = F.least("_wave", F.lit(options.most_waves - 1))
        placed = resolved(with_waves(rows, job.match_key, links[0], "_wave").withColumn("_wave", wave), table)
        path = new_path(spark, f"waves-{table}")
        # ranges keep the rows of a wave together and split a large one
        placed.repartitionByRange("_wave", F.xxhash64(job.match_key)).write.partitionBy("_wave").parquet(path, compression=CODEC)
        stored = spark.read.schema(placed.schema).parquet(path)
        last = stored.agg(F.max("_wave")).first()[0] or 0
        earlier, n_earlier = key_map(table), size(table)
        for number in range(last + 1):
            part = stored.where(F.col("_wave") == number).drop("_wave")
            linked = resolve_lookups(part, dict.fromkeys(links, table), {table: earlier}, {table: n_earlier})
            ready = with_all_links(linked, table)
            loaded, waiting = add_parts(job.load(ready), name, f"{batch}w{number:06d}", any_open(table),
                                        whole=fresh and number == 0)
            n_open[table] = n_open.get(table, 0) + waiting
            earlier, seen = cut(key_map_entries(loaded, "target_id", job.match_key), f"wave-ids-{table}")
            n_earlier = seen["rows"]
            remember(loaded, table, earlier, keyless)

    def update_one(table: str) -> None:
        """Fill what can be filled now, of this run and of earlier ones."""
        job, name, waiting = loads[table], f"{database}.loaded_{table}", f"{database}.pending_{table}"
        if not job.lookups and not job.polymorphic or (table, "updated") in finished:
            return
        stored = spark.catalog.tableExists(waiting)
        # what an ended run has published is not counted
        if not stored and not run_id and not n_open.get(table):
            finish(table, "updated", name)
            return
        new = open_links(done.loaded[table], job.lookups, job.polymorphic)
        alive = spark.table(waiting).where(~F.startswith(PART, F.lit(f"{run}-"))) if stored else None
        if alive is not None and options.key_map_drop_recreate:
            alive = None
        links, seen = cut(new.unionByName(alive) if alive is not None else new, f"links-{table}")
        targets = {t.lower() for t in (*job.lookups.values(), *(t for ts in job.polymorphic.values() for t in ts))}
        parts = parts_to_fill(links, {t: key_map(t) for t in targets}, {t: size(t) for t in targets})

        def fill(rows: DataFrame) -> DataFrame:
            rows = deferred_update(rows, job.lookups, {t: key_map(t) for t in job.lookups.values()},
                                   {t: size(t) for t in job.lookups.values()})
            for column, ts in job.polymorphic.items():
                rows = deferred_polymorphic(rows, column, {t: key_map(t) for t in ts}, {t: size(t) for t in ts})
            return rows

        rewrite_parts(name, spark, parts, fill)
        changed = spark.table(name).where(F.col(PART).isin(parts)) if parts else None
        left = links.where(~F.col(PART).isin(parts)) if parts else links
        if changed is not None:
            left = left.unionByName(open_links(changed, job.lookups, job.polymorphic))
        publish(left, waiting)
        done.loaded[table] = spark.table(name).where(F.startswith(PART, F.lit(f"{run}-")))
        finish(table, "updated", name)

    with ThreadPoolExecutor(parallel) as pool:
        for tier in sorted(tiers):
            list(pool.map(inheritable_thread_target(spark)(load_one), tiers[tier]))
        list(pool.map(inheritable_thread_target(spark)(update_one), [t for tier in tiers.values() for t in tier]))
    for table, rows in done.loaded.items():
        done.loaded[table] = rows.drop(PART)
    return done
