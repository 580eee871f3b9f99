"""Plans that are kept: only environments whose documents have changed are planned again."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadwright.operators.skew import lookup_join
from loadwright.options import PlanOptions
from loadwright.plans.migrate import MigrationPlan, plan_migration
from loadwright.sources.scratch import cut
from loadwright.sources.snapshots import flatten_snapshot, read_snapshot
from loadwright.sources.tables import publish

# The frames of a plan that are kept, by the names of their tables.
KEPT: dict[str, Callable[[MigrationPlan], DataFrame]] = {
    "plan_columns": lambda p: p.columns,
    "plan_staging": lambda p: p.staging,
    "plan_key_maps": lambda p: p.key_maps,
    "plan_tiers": lambda p: p.tiers.tiers,
    "plan_dropped": lambda p: p.tiers.dropped,
    "plan_batches": lambda p: p.batches,
}


class Replanned(NamedTuple):
    """Environments by what became of them (org_key, state: new, changed, gone or unchanged), and the stored frames."""

    states: DataFrame
    frames: dict[str, DataFrame]


def environment_digests(spark: SparkSession, path: str, options: PlanOptions = PlanOptions()) -> DataFrame:
    """org_key and a digest of all its documents and of the options, in whatever order and files the documents lie.

    Documents are JSON lines.  They are read as text; of the JSON nothing but the environment's name is looked for.
    """
    lines = spark.read.text(path).select(F.get_json_object("value", "$.org_key").alias("org_key"), "value")
    # sums of two hashes do not depend on the order, and equal documents do not cancel out
    sums = [F.sum(h.cast("decimal(20, 0)")).cast("string") for h in (F.xxhash64("value"), F.xxhash64(F.lit(1), F.reverse("value")))]
    count = F.count(F.lit(1)).cast("string")
    return lines.groupBy("org_key").agg(F.md5(F.concat_ws("|", count, *sums, F.lit(repr(options)))).alias("digest"))


def replan(spark: SparkSession, path: str, database: str, options: PlanOptions = PlanOptions()) -> Replanned:
    """Bring the stored plan of a fleet in line with the documents under ``path``.

    The digests of all environments are compared with the stored ones.  Documents of new and changed environments
    are parsed and planned; of unchanged ones nothing is read past the digest, and their stored rows stay as they are.
    ``planned`` in the stored frames says in which replanning a row was made, from 1.  Other options change all digests.

    Digests are published last: a replanning that is ended is done again.
    """
    names = {name: f"{database}.{name}" for name in KEPT}
    known = f"{database}.plan_digests"
    now, _ = cut(environment_digests(spark, path, options), "digests")
    if spark.catalog.tableExists(known):
        before = spark.table(known)
        number = (before.agg(F.max("planned")).first()[0] or 0) + 1
    else:
        before, number = spark.createDataFrame([], "org_key string, digest string, planned int"), 1
    both = now.join(before.withColumnRenamed("digest", "old"), "org_key", "full")
    state = (F.when(F.col("old").isNull(), "new").when(F.col("digest").isNull(), "gone")
             .when(F.col("digest") != F.col("old"), "changed").otherwise("unchanged"))
    compared, seen = cut(both.select("org_key", "digest", "planned", state.alias("state")), "compared",
                         moved=F.count_if(F.col("state") != "unchanged"), to_plan=F.count_if(F.col("state").isin("new", "changed")))
    moved = compared.where("state <> 'unchanged'").select("org_key")
    if seen["moved"]:
        changed = compared.where("state IN ('new', 'changed')").select("org_key")
        documents = lookup_join(read_snapshot(spark, path), changed, ["org_key"], "left_semi", right_rows=seen["to_plan"])
        plan = plan_migration(flatten_snapshot(cut(documents, "changed-documents")[0]), options=options)
        for name, frame in KEPT.items():
            rows = frame(plan).withColumn("planned", F.lit(number))
            if spark.catalog.tableExists(names[name]):
                stays = lookup_join(spark.table(names[name]), moved, ["org_key"], "left_anti", right_rows=seen["moved"])
                rows = stays.unionByName(rows)
            publish(rows, names[name])
        is_moved = F.col("state") != "unchanged"
        publish(compared.where("state <> 'gone'").select(
            "org_key", "digest", F.when(is_moved, number).otherwise(F.col("planned")).cast("int").alias("planned")), known)
    return Replanned(compared.select("org_key", "state"), {name: spark.table(table) for name, table in names.items()})
