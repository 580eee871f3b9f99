"""Settings of a plan."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PlanOptions:
    # The defaults a plan starts from.
    schema_name: str = "dbo"
    staging_prefix: str = "stage_"
    key_map_prefix: str = "guid_"
    batch_size: int = 40
    match_key_suffixes: str = "legacyid"
    dependency_exclusions: str = ""
    staging: bool = True
    key_maps: bool = True
    staging_drop_recreate: bool = True
    key_map_drop_recreate: bool = False
    index_match_keys: bool = False
    truncate: bool = False
    teardown: bool = False
    dictionary: bool = False
    diagram: bool = False
    # Buckets of a new key map; as many as the session has shuffle partitions if not given.
    key_map_buckets: int | None = None
    # Rows of one table that wait for more than this many others, one after the other, are loaded together.
    most_waves: int = 1000
