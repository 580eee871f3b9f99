"""Published tables outlive scratch, keep their columns, and continue over runs."""

import pytest
from pyspark.sql import functions as F

from loadwright.operators.skew import hot_hashes, lookup_join
from loadwright.options import PlanOptions
from loadwright.plans.scripts import create_statements
from loadwright.sources.scratch import scratch_root
from loadwright.sources.tables import accumulate_key_map, publish, remove_old_versions, teardown
from tests.helpers import rows


@pytest.fixture
def database(spark):
    spark.sql("CREATE DATABASE published")
    yield "published"
    spark.sql("DROP DATABASE published CASCADE")


def test_maps_outlive_scratch_and_grow_columns(spark, database):
    name = f"{database}.guid_account"
    accumulate_key_map(spark.createDataFrame([("i1", "k1")], "target_id string, legacy_key string"), name)
    accumulate_key_map(spark.createDataFrame([("i9", "k1", "x"), ("i2", "k2", "n2")],
                                             "target_id string, legacy_key string, name string"), name)
    place = spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Location'").first()["data_type"]
    home = spark.catalog.getDatabase(database).locationUri
    assert place.startswith(home) and scratch_root(spark).removeprefix("file:") not in place
    assert rows(spark.table(name)) == {("i1", "k1", None): 1, ("i2", "k2", "n2"): 1}
    assert remove_old_versions(spark, name) == 1 and remove_old_versions(spark, name) == 0
    assert spark.table(name).count() == 2
    teardown(spark, [], [name])
    assert not spark.catalog.tableExists(name)


def test_lost_or_retyped_columns_are_refused(spark, database):
    name = f"{database}.loaded"
    publish(spark.createDataFrame([(1, "a")], "id long, v string"), name)
    for bad in (spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(1, 2)], "id long, v int")):
        with pytest.raises(ValueError, match="would lose"):
            publish(bad, name)
    assert rows(publish(spark.createDataFrame([("b", 2)], "V string, ID long"), name)) == {(2, "b"): 1}


def test_as_many_hot_keys_as_qualify(spark):
    facts = spark.range(200_000).select((F.col("id") % 2000).alias("k"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 4000)
    try:
        assert len(hot_hashes(facts, ["k"])[0]) == 2000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("small_rows", [10**6, 0])
def test_maps_in_the_payload(spark, small_rows):
    left = spark.range(300).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"),
                                   F.create_map(F.lit("x"), "id").alias("m"))
    right = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    found = lookup_join(left, right, ["k"], small_rows=small_rows).select("k", "m.x", "v")
    assert rows(found) == rows(left.join(right, "k", "left").select("k", "m.x", "v"))


def test_sides_with_arrays_are_not_broadcast_by_rows(spark):
    right = spark.range(50).select(F.col("id").alias("k"), F.array("id").alias("v"))
    logical = lookup_join(spark.range(300).select(F.col("id").alias("k")), right, ["k"], hot=[], right_rows=50)
    assert "strategy=broadcast" not in logical._jdf.queryExecution().logical().toString()


def test_fixed_columns_get_no_index(spark):
    layout = spark.createDataFrame([("o", "account", 1, "x_legacyid", "INT", None), ("o", "account", 2, "ownerid", "INT", None)],
                                   "org_key string, table string, ordinal int, name string, sql_type string, comment string")
    entities = spark.createDataFrame([("o", "account", "Account", "A")],
                                     "org_key string, logical_name string, schema_name string, display_name string")
    batches = spark.createDataFrame([("o", "account", 1, 1)], "org_key string, table string, file_no int, pos int")
    options = PlanOptions(match_key_suffixes="id", index_match_keys=True, staging_prefix="50%_")
    text = create_statements(layout, entities, batches, options=options).first()["statement"]
    assert "IX_50%_Account_x_legacyid" in text and "IX_50%_Account_ownerid" not in text
