"""JSON, hashes, ids and small structures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = ("", "N/A", "n/a")


def content_hash(*columns: Column | str) -> Column:
    """M4: first 16 hex digits of a hash over a row's values."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256), 1, 16)


def opaque_id(prefix: str, *key: Column | str) -> Column:
    """M5: an id that follows from the natural key, so running again gives the same."""
    return F.concat(F.lit(prefix + "_"), content_hash(*key))


def parse_list(raw: Column, element: str = "string") -> Column:
    """M6: a JSON array, [] when missing or broken."""
    return F.coalesce(F.from_json(raw, f"array<{element}>"), F.array().cast(f"array<{element}>"))


def append(items: Column, value: Column, most: int | None = None) -> Column:
    """An array with one more entry, cut to the first ``most``."""
    out = F.array_append(F.coalesce(items, F.array().cast("array<string>")), value)
    return F.slice(out, 1, most) if most else out


def zip_marks(judges: Column, marks: Column) -> Column:
    """M8: judge -> mark, or null where the lengths differ (the list stays the truth then)."""
    return F.when(F.size(judges) == F.size(marks), F.map_from_arrays(judges, marks))


def na_to_null(c: Column) -> Column:
    """M10."""
    return F.when(~c.isin(*EMPTY), c)


def changed_fields(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """Map of field -> struct(from, to) for the fields that differ; nulls equal each other."""
    entries = [F.when(~old[k].eqNullSafe(new[k]), F.array(F.struct(F.lit(k).alias("key"), F.struct(old[k].cast("string").alias("from"), new[k].cast("string").alias("to")).alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:struct<from:string,to:string>>>")) for k in new]
    return F.map_from_entries(reduce(lambda a, b: F.concat(a, b), entries))
