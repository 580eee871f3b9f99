"""Hot keys and big groups: the distributed ways give what the plain ones give."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loadwright.operators.skew import hot_hashes, lookup_join, number_rows, previous_in_group
from tests.helpers import plan_of, rows


@pytest.fixture(scope="module")
def facts(spark):
    """A third of the rows has one key, a sixth has none."""
    return spark.range(6000).select(
        "id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 6 == 1, None).otherwise(F.col("id") % 500).alias("k"),
        (F.col("id") % 2).cast("string").alias("part"))


@pytest.fixture(scope="module")
def entries(spark):
    return spark.range(0, 450).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"),
                                      (F.col("id") * 2).alias("w"))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_join(facts, entries, how):
    plain = facts.join(entries, ["k"], how)
    for small_rows in (1000, 0):
        got = lookup_join(facts, entries, ["k"], how, small_rows=small_rows)
        assert set(got.columns) == set(plain.columns)
        assert rows(got, *plain.columns) == rows(plain)


def test_lookup_join_on_two_keys(spark, facts, entries):
    wide = entries.crossJoin(spark.createDataFrame([("0",), ("1",)], "part string")).where("NOT (k = 7 AND part = '0')")
    plain = facts.join(wide, ["k", "part"], "left")
    assert rows(lookup_join(facts, wide, ["k", "part"], small_rows=0), *plain.columns) == rows(plain)


def test_hot_keys_are_found_and_taken_out_of_the_shuffle(spark, facts, entries):
    hot = hot_hashes(facts, ["k"])[0]
    expected = spark.sql("SELECT xxhash64(7L) AS a, xxhash64(CAST(NULL AS BIGINT)) AS b").first()
    assert expected.a in hot and expected.b in hot and len(hot) < 10
    plan = plan_of(lookup_join(facts, entries, ["k"], small_rows=0))
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan or "BroadcastHashJoin" in plan
    assert "_left_spread" in plan


def test_no_hot_keys_is_one_plain_join(facts, entries):
    assert "_left_spread" not in plan_of(lookup_join(facts, entries, ["k"], small_rows=0, hot=[]))


@pytest.mark.parametrize("big_group", [10**6, 50])
def test_number_rows(facts, big_group):
    want = facts.withColumn("n", F.row_number().over(Window.partitionBy("k", "part").orderBy("id")))
    assert rows(number_rows(facts, ["k", "part"], ["id"], "n", big_group=big_group)) == rows(want)


@pytest.mark.parametrize("big_group", [10**6, 50])
def test_previous_in_group(facts, big_group):
    data = facts.withColumn("x", F.when(F.col("id") % 5 != 0, F.col("id")))
    want = data.withColumn("p", F.lag("x").over(Window.partitionBy("k").orderBy("id")))
    assert rows(previous_in_group(data, ["k"], ["id"], "x", "p", big_group=big_group)) == rows(want)
