"""Identity of rows that have no match key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadwright.operators.skew import number_rows


def has_key(key: str) -> Column:
    """Rows that a key map can name: with a key that is neither null nor empty."""
    return F.coalesce(F.col(key).cast("string") != "", F.lit(False))


def with_row_identity(rows: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``: a digest of the given columns and the number of the row among rows equal in them.

    Equal rows are interchangeable, so the same rows get the same identities in every run, in whatever order and
    partitioning they are read.  Very many equal rows are numbered range by range.
    """
    digest = F.md5(F.to_json(F.struct(*(F.col(f"`{c}`") for c in columns)), {"ignoreNullFields": "false"}))
    placed = rows.withColumns({"_digest": digest, "_at": F.monotonically_increasing_id()})
    numbered = number_rows(placed, ["_digest"], ["_at"], "_copy")
    return numbered.withColumn(name, F.concat_ws("-", "_digest", "_copy")).drop("_digest", "_at", "_copy")
