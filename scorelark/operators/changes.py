"""Change capture between a run's rows and the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.jsons import changed_fields, content_hash
from .matching import first_by

# Fields whose change counts, and the guard against broken listings.
TRACKED = ["name", "normalized_name", "start_date", "end_date", "year", "city", "region", "country", "country_raw", "location_raw", "event_status", "confirmation_status", "hiatus", "website_url"]
GUARD_RATIO, GUARD_BASELINE, MAX_CHANGES = 0.7, 20, 500


class GuardTripped(RuntimeError):
    """A listing is too small to be believed."""


def check_guard(found: int, previous: int | None, force: bool = False, ratio: float = GUARD_RATIO) -> None:
    """No rows at all, or far fewer than in the last good run."""
    if force:
        return
    if found == 0:
        raise GuardTripped("0 events parsed; refusing to sync (use force to override)")
    if previous is not None and previous >= GUARD_BASELINE and found < previous * ratio:
        raise GuardTripped(f"parsed {found} events but the last successful run found {previous}")


def without_repeats(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, skipped): the first row of each series, start, end and country; missing values equal each other."""
    key = ["series_id", "start_date", "end_date", "country"]
    first = first_by(rows, key, ["row_index"])
    return first, rows.join(first.select("row_index"), "row_index", "left_anti")


def classify(new: DataFrame, current: DataFrame, tracked: list[str] = TRACKED, key: str = "id") -> DataFrame:
    """One row per event of either side: key, action, changed.

    ``new`` rows carry the key of the event they matched (null: none); ``current`` has active.  An unknown confirmation
    keeps the old one.  Actions: added, updated, reactivated, unchanged, unseen.
    """
    old = current.select(key, F.col("active").alias("_active"), *(F.col(c).alias("_" + c) for c in tracked))
    matched = new.where(F.col(key).isNotNull()).join(old, key, "left").withColumn("_seen", F.lit(True))
    values = {c: (F.when(F.col(c) == "unknown", F.col("_" + c)).otherwise(F.col(c)) if c == "confirmation_status" else F.col(c)) for c in tracked}
    changed = changed_fields({c: F.col("_" + c) for c in tracked}, values)
    known = matched.withColumn("changed", changed).select(key, F.when(F.col("_active").isNull(), "added").when(F.size("changed") > 0, "updated").when(~F.col("_active"), "reactivated").otherwise("unchanged").alias("action"), "changed")
    nothing = F.lit(None).cast("map<string,struct<from:string,to:string>>")
    added = new.where(F.col(key).isNull()).select(key, F.lit("added").alias("action"), nothing.alias("changed"))
    unseen = current.join(new.where(F.col(key).isNotNull()).select(key), key, "left_anti").select(key, F.lit("unseen").alias("action"), nothing.alias("changed"))
    return known.unionByName(added).unionByName(unseen)


def deactivated(unseen: DataFrame, today: Column) -> DataFrame:
    """Lifecycle of events that a run no longer lists: past if over, else missing_from_source."""
    life = F.when(F.col("end_date") < today, "past").otherwise("missing_from_source")
    return unseen.withColumns({"was_active": F.col("active"), "lifecycle_status": life, "active": F.lit(False)})


def observations(changes: DataFrame, rows: DataFrame, run_id: int, now: Column, key: str = "id") -> DataFrame:
    """History rows, only for what was added or changed, with the previous values."""
    wanted = changes.where(F.col("action").isin("added", "updated", "reactivated"))
    previous = F.when(F.col("action") != "added", F.transform_values("changed", lambda k, v: v["from"]))
    return wanted.join(rows, key).select(F.col(key).alias("event_id"), F.lit(run_id).alias("sync_run_id"), now.alias("observed_at"), content_hash(*[c for c in rows.columns if c != key]).alias("content_hash"), previous.alias("previous_values"))


def as_of(current: DataFrame, history: DataFrame, moments: list, tracked: list[str] = TRACKED, key: str = "id") -> DataFrame:
    """The catalog as it was at each of the ``moments``: as_of, and the columns of ``current``.

    ``history`` has event_id, observed_at, sync_run_id and previous_values, the old values of what changed (null: the event
    was new).  A field had the value that its first change after the moment replaced, and if there is none, the value
    of today; an event that was new later wasn't there.  All moments are answered in one pass: each change knows from its predecessor
    for which moments it holds.  Fields that aren't tracked have today's values.
    """
    times = F.array(*(F.lit(m) for m in moments)).cast("array<timestamp>")
    steps = history.where("previous_values IS NOT NULL").select(F.col("event_id").alias(key), "observed_at", "sync_run_id", F.explode("previous_values").alias("field", "old"))
    before = F.lag("observed_at").over(W.partitionBy(key, "field").orderBy("observed_at", "sync_run_id"))
    ranged = steps.withColumn("_before", before)
    holds = ranged.withColumn("as_of", F.explode(F.filter(times, lambda m: (m < F.col("observed_at")) & (F.col("_before").isNull() | (m >= F.col("_before"))))))
    patch = holds.groupBy(key, "as_of").agg(F.map_from_entries(F.collect_list(F.struct("field", "old"))).alias("_patch"))  # an entry for each field at most
    born = history.where("previous_values IS NULL").groupBy(F.col("event_id").alias(key)).agg(F.min("observed_at").alias("_born"))
    there = current.join(born, key, "left").withColumn("as_of", F.explode(times)).where(F.col("_born").isNull() | (F.col("_born") <= F.col("as_of")))
    old = there.join(patch, [key, "as_of"], "left")
    return old.select("as_of", *(F.when(F.map_contains_key("_patch", F.lit(c)), F.col("_patch")[c].cast(current.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in tracked else c for c in current.columns))


def counters(changes: DataFrame) -> DataFrame:
    """One row with the number of rows per action."""
    return changes.agg(*(F.count_if(F.col("action") == a).alias(a) for a in ("added", "updated", "reactivated", "unchanged", "unseen")))


def last_success(runs: DataFrame, source: str) -> DataFrame:
    """The newest good run of a source."""
    return runs.where((F.col("source") == source) & (F.col("status") == "success")).orderBy(F.desc("id")).limit(1)
