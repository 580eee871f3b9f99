"""Name comparison, ordering and labels.

Names compare without case.  Graph keys are lower-cased; sorting upper-cases, so that
``_`` comes after the letters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(name: Column | str) -> Column:
    """The key form of a name."""
    return F.lower(name)


def order_key(name: Column | str) -> Column:
    """The sort form of a name."""
    return F.upper(name)


def same_name(a: Column | str, b: Column | str) -> Column:
    """Case-insensitive equality that is false, not null, when a side is missing."""
    return F.coalesce(F.upper(a) == F.upper(b), F.lit(False))


def label(text: Column | str, fallback: Column) -> Column:
    """The localized text if there is any, else the fallback."""
    return F.coalesce(F.nullif(text if isinstance(text, Column) else F.col(text), F.lit("")), fallback)


def category(name: Column | str) -> Column:
    """Publisher prefix: the text before the first ``_``; ``oob`` without a prefix."""
    return F.when(F.instr(name, "_") > 1, F.substring_index(name, "_", 1)).otherwise(F.lit("oob"))


def joined_names(names: Column) -> Column:
    """An array of names as one text, in name order."""
    keyed = F.transform(names, lambda n: F.struct(F.upper(n).alias("key"), n.alias("name")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["name"]), ", ")
