"""Files for people and other tools: one folder per environment.

Ranges, not hashes, place the rows, so that a large environment is spread over several
part files, whose names sort in the order of their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_rows(df: DataFrame, path: str, *order: str, format: str = "csv") -> None:
    """Write a dictionary, plan or report under ``org_key=…``, each environment in the given order."""
    place = ["org_key", *order]
    writer = df.repartitionByRange(*place).sortWithinPartitions(*place).write.partitionBy("org_key")
    if format == "csv":
        writer = writer.option("header", True)
    writer.format(format).save(path)


def export_scripts(df: DataFrame, path: str, text: str, *order: str) -> None:
    """Write text rows as files under ``org_key=…/file_name=…``, in the given order."""
    place = ["org_key", "file_name", *order]
    (df.repartitionByRange(*place).sortWithinPartitions(*place)
     .select("org_key", "file_name", F.col(text).alias("value"))
     .write.partitionBy("org_key", "file_name").text(path))
