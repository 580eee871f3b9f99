"""Conforming source rows to a staging layout."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadwright.functions.types import spark_type, text_limit


class StagedColumn(NamedTuple):
    name: str
    sql_type: str


class Split(NamedTuple):
    clean: DataFrame
    rejects: DataFrame


def table_columns(layout: DataFrame, org_key: str, table: str) -> list[StagedColumn]:
    """The columns of one table, in order: the schema of its staging job."""
    rows = (
        layout.where((F.col("org_key") == org_key) & (F.lower("table") == table.lower()))
        .select("ordinal", "name", "sql_type").collect())
    return [StagedColumn(r["name"], r["sql_type"]) for r in sorted(rows, key=lambda r: r["ordinal"])]


def _source_name(source: DataFrame, name: str) -> str | None:
    matches = [c for c in source.columns if c.lower() == name.lower()]
    if len(matches) > 1:
        raise ValueError(f"source columns differ only in case: {matches}")
    return matches[0] if matches else None


def _as_text(source: DataFrame, name: str, scales: Mapping[str, int]) -> Column:
    value = F.col(name)
    scale = {k.lower(): v for k, v in scales.items()}.get(name.lower())
    if scale is not None:
        value = value.try_cast(T.DecimalType(38, scale))
    return value.cast("string")


def _conformed(source: DataFrame, column: StagedColumn, scales: Mapping[str, int]) -> Column:
    name = _source_name(source, column.name)
    target = spark_type(column.sql_type)
    is_text = target == "STRING" or target.startswith("VARCHAR")
    kind = "STRING" if is_text else target
    if name is None:
        return F.lit(None).cast(kind)
    return _as_text(source, name, scales) if is_text else F.col(name).try_cast(kind)


def stage_rows(source: DataFrame, columns: Sequence[StagedColumn],
               scales: Mapping[str, int] | None = None) -> DataFrame:
    """The source in the shape of its staging table; one projection, no shuffle.

    Names match without case, missing columns become typed nulls, numbers and choices
    become text.  ``scales`` gives the decimal places of fractional numbers staged as
    text; the others keep their shortest form.  A value that does not fit its type
    becomes null here: split off the rejects first to keep it.
    """
    scales = scales or {}
    return source.select(*(_conformed(source, c, scales).alias(c.name) for c in columns))


_MISFIT = "array<struct<column: string, reason: string, value: string>>"


def _misfit(source: DataFrame, column: StagedColumn, scales: Mapping[str, int]) -> Column | None:
    """What is wrong with a value, null if it fits; None where nothing can be."""
    name = _source_name(source, column.name)
    target = spark_type(column.sql_type)
    if name is None:
        return None
    raw, limit = F.col(name), text_limit(column.sql_type)
    text = _as_text(source, name, scales)
    scaled = any(k.lower() == name.lower() for k in scales)
    if target == "STRING" or limit:
        if not limit and not scaled:
            return None
        wrong = F.when(raw.isNotNull() & text.isNull(), "type") if scaled else F.lit(None).cast("string")
        if limit:
            wrong = F.coalesce(wrong, F.when(F.char_length(text) > limit, "length"))
        shown = F.coalesce(text, raw.cast("string"))
    else:
        kept = raw.try_cast(target)
        wrong = F.when(raw.isNotNull() & kept.isNull(), "type")
        kind = source.schema[name].dataType
        if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            # a narrower type may round or cut: the value fits if the way back gives it again
            wrong = F.coalesce(wrong, F.when(raw != kept.try_cast(kind), "precision"))
        shown = raw.cast("string")
    return F.when(wrong.isNotNull(), F.struct(F.lit(column.name).alias("column"), wrong.alias("reason"), shown.alias("value")))


def checked_rows(source: DataFrame, columns: Sequence[StagedColumn], scales: Mapping[str, int] | None = None) -> DataFrame:
    """``source`` with ``_misfits``: one entry for each value that does not fit its column.

    Reasons are ``type``, ``length`` (in code points) and ``precision``: the target type would hold
    another value, as when a fraction goes into whole numbers or a time of day into a date.
    """
    found = [m for m in (_misfit(source, c, scales or {}) for c in columns) if m is not None]
    misfits = F.array_compact(F.array(*found)) if found else F.array()
    return source.withColumn("_misfits", misfits.cast(_MISFIT))


def split_checked(checked: DataFrame, columns: Sequence[StagedColumn], key_columns: Sequence[str],
                  scales: Mapping[str, int] | None = None) -> Split:
    """The two sides of ``checked_rows``; write those first if their source is dear to read."""
    fits = F.size("_misfits") == 0
    rejects = checked.where(~fits).select(*key_columns, F.inline("_misfits"))
    return Split(stage_rows(checked.where(fits), columns, scales), rejects)


def split_rejects(source: DataFrame, columns: Sequence[StagedColumn], key_columns: Sequence[str],
                  scales: Mapping[str, int] | None = None) -> Split:
    """Rows that fit their layout, staged, and one reject per value that does not fit.

    Rejects carry the key of the row, the column, the reason and the value as text.
    """
    return split_checked(checked_rows(source, columns, scales), columns, key_columns, scales)
