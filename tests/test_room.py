"""How what a run stores is written."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from loadwright.operators import keymap
from loadwright.plans.run import TableLoad, run_plan
from loadwright.operators.staging import StagedColumn
from tests.helpers import rows
from tests.test_runs import TEXT, plan
from workloads.fleet import new_database


def codecs(folder):
    files = glob.glob(f"{folder.removeprefix('file:')}/**/*.parquet", recursive=True)
    metas = [pq.ParquetFile(f).metadata for f in files]
    return {m.row_group(g).column(c).compression for m in metas for g in range(m.num_row_groups) for c in range(m.num_columns)}


def test_what_a_run_stores_is_compact(spark):
    database, people = new_database(spark), spark.range(500).selectExpr("md5(string(id)) AS k", "md5(string(id % 7)) AS boss")
    job = TableLoad(people, [StagedColumn("k", TEXT), StagedColumn("boss", TEXT)], "k",
                    lambda df: df.withColumn("target_id", F.md5("k")), {"boss": "people"})
    done = run_plan(spark, (order := plan(spark, "people")).tiers, order.dropped, {"people": job}, database)
    assert done.loaded["people"].count() == done.key_maps["people"].count() == 500
    home = spark.catalog.getDatabase(database).locationUri
    assert codecs(home) == {"ZSTD"}


def test_key_map_is_written_with_one_id_of_each_key(spark, monkeypatch):
    schemas, cut = {}, keymap.cut
    monkeypatch.setattr(keymap, "cut", lambda df, label, **how: schemas.update({label: df.schema}) or cut(df, label, **how))
    loaded = spark.createDataFrame([("t1", "a"), ("t2", "a"), ("t3", "b"), ("t3", "b"), ("t4", None), ("t5", "")], "id string, k string")
    found = keymap.build_key_map(loaded, "id", "k")
    assert schemas["key-map"].simpleString().count("string") == 2
    assert set(rows(found.entries, "target_id", "legacy_key")) == {("t1", "a"), ("t3", "b")}
    assert set(rows(found.conflicts)) == {("t2", "a", "t1", "duplicate"), ("t4", None, None, "missing"), ("t5", None, None, "missing")}
