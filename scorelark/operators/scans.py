"""Polling rules over state tables (F14, F15, D5, ST2-ST7, W9, J25, S7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import is_fresh

# Time limits.
SHEET_RECENT_DAYS, SHEET_TTL, INDEX_TTL, REGISTRY_TTL = 14, "1 hour", "24 hours", "12 hours"
RECHECK, RECENT_RECHECK, RECENT_DAYS = "7 days", "20 hours", 21
MISS_LIMIT, LOOK_BACK, PENDING_DAYS, PENDING_RECHECK, SCAN_RECENT_DAYS = 40, 30, 400, "20 hours", 30
PROVIDER_SITE = r"(?i)(eepro\.com|scoring\.dance)"
WEBSITE_BATCH = 25


def sheet_is_fresh(status: Column, version: Column, wanted_version: Column, event_end: Column, fetched: Column, now: Column) -> Column:
    """ST3: read by today's reader, and either the event is over for two weeks or the copy is younger than an hour."""
    read = status.isin("parsed", "empty") & (version == wanted_version)
    old = F.datediff(now, event_end) > SHEET_RECENT_DAYS
    return F.coalesce(read, F.lit(False)) & (F.coalesce(old, F.lit(False)) | is_fresh(fetched, now, SHEET_TTL))


def index_is_fresh(fetched: Column, now: Column) -> Column:
    """ST4."""
    return is_fresh(fetched, now, INDEX_TTL)


def is_due(last_success: Column, interval: str, now: Column) -> Column:
    """ST2: never run, or long enough ago."""
    return last_success.isNull() | (last_success + F.expr(f"INTERVAL {interval}") <= now)


def websites_due(events: DataFrame, checks: DataFrame, now: Column, limit: int = WEBSITE_BATCH) -> DataFrame:
    """F14, F15, J7, O9, ST5: sites to look at again, newest events first; events of the last three weeks are looked at daily."""
    joined = events.where("website_url IS NOT NULL AND website_url <> '' AND merged_into IS NULL").where(F.col("start_date") <= F.to_date(now))
    joined = joined.where(~F.col("website_url").rlike(PROVIDER_SITE)).join(checks.select(F.col("event_id").alias("id"), "checked_at"), "id", "left")
    recent = F.coalesce("end_date", "start_date") >= F.date_sub(F.to_date(now), RECENT_DAYS)
    cut = F.when(recent, now - F.expr(f"INTERVAL {RECENT_RECHECK}")).otherwise(now - F.expr(f"INTERVAL {RECHECK}"))
    return joined.where(F.col("checked_at").isNull() | (F.col("checked_at") < cut)).orderBy(F.desc("start_date"), "id").limit(limit)


def numbers_to_recheck(known: DataFrame, pending: DataFrame, now: Column) -> DataFrame:
    """S7, ST6: numbers below the resume point: recent events, and those that had no results yet and were not asked for a day.

    known (n, start_date); pending (n, status, first_seen_at, last_checked_at).
    """
    begin = known.agg(F.greatest(F.lit(1), F.coalesce(F.max("n"), F.lit(0)) - LOOK_BACK).alias("begin"))
    recent = known.where(F.col("start_date") >= F.date_sub(F.to_date(now), SCAN_RECENT_DAYS)).select("n")
    waiting = pending.where((F.col("status") == "no_results") & (F.col("first_seen_at") >= now - F.expr(f"INTERVAL {PENDING_DAYS} days")) & (F.col("last_checked_at") < now - F.expr(f"INTERVAL {PENDING_RECHECK}"))).select("n")
    return recent.unionByName(waiting).distinct().join(begin, F.col("n") < F.col("begin")).select("n")


def walk(probes: DataFrame, begin: int, limit: int = MISS_LIMIT) -> DataFrame:
    """ST7, W9, J25: the probed numbers that a walk from ``begin`` visits: it ends with the ``limit``-th miss in a row.

    probes (n, hit); a number without a probe is a miss.  The walk ends after the first hit that has no other within
    ``limit`` after it, which a join over buckets finds without walking.
    """
    hits = probes.where(F.col("hit") & (F.col("n") >= begin)).select("n").distinct()
    # a hit goes on if another lies within ``limit`` after it: such hits share a bucket of that width or lie in the next
    bucket = F.floor(F.col("n") / limit)
    near = hits.select(F.col("n").alias("m"), bucket.alias("b"))
    goes_on = hits.withColumn("b", F.explode(F.array(bucket, bucket + 1))).join(near, "b").where((F.col("m") > F.col("n")) & (F.col("m") <= F.col("n") + limit)).select("n")
    ends = hits.join(goes_on, "n", "left_anti").select("n", F.lit(True).alias("end"))
    found = hits.select("n", F.lit(False).alias("end")).unionByName(ends).agg(F.min("n").alias("first"), F.min(F.when(F.col("end"), F.col("n"))).alias("last"))
    bound = found.select(F.when((F.col("first") - begin >= limit) | F.col("first").isNull(), F.lit(begin + limit - 1)).otherwise(F.col("last") + limit).alias("end"))
    return probes.where(F.col("n") >= begin).join(bound, F.col("n") <= F.col("end")).select("n", "hit")
