"""Several lookups of one row: what a broadcast finds is not shuffled for the lookups that need one."""

from collections import Counter

from pyspark.sql import functions as F

from loadwright.operators import skew
from loadwright.operators.resolve import resolve_lookups
from tests.helpers import plan_of, rows


def test_small_maps_are_joined_after_the_shuffles(spark, monkeypatch):
    monkeypatch.setattr(skew, "SMALL_ROWS", 10)
    staged = spark.range(200).select("id", F.when(F.col("id") % 7 != 0, F.col("id") % 100).alias("big"), (F.col("id") % 6).alias("small"))

    def entries(n):
        return spark.range(n).select(F.concat(F.lit(f"{n}/"), "id").alias("target_id"), F.col("id").cast("string").alias("legacy_key"))

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = resolve_lookups(staged, {"small": "s", "big": "b"}, {"s": entries(5), "b": entries(90)})
        plan = plan_of(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    ids = plan.index("small_id"), plan.index("SortMergeJoin")
    assert ids[0] < ids[1] and "small_id" not in plan[ids[1]:]

    def link(key, n):
        if key is None:
            return None, "empty"
        return (f"{n}/{key}", "resolved") if key < n else (None, "unresolved")

    want = [(i, None if i % 7 == 0 else i % 100, i % 6, *link(i % 6, 5), *link(None if i % 7 == 0 else i % 100, 90)) for i in range(200)]
    assert rows(found) == Counter(want)
    assert found.columns == ["id", "big", "small", "small_id", "small_status", "big_id", "big_status"]
