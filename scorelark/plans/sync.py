"""One synchronisation of the calendar (C15, ER1, ER2, U1-U5, U9)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsons import opaque_id
from ..functions.text import normalize_text
from ..operators import changes, occurrences
from ..session import written

SOURCE = "calendar"


def sync(rows: DataFrame, events: DataFrame, series: DataFrame, aliases: DataFrame, now: datetime, previous: int | None = None, force: bool = False) -> dict[str, DataFrame]:
    """New states of events, event_series and event_aliases, the changes, and skipped repeats.

    ``rows`` are parsed calendar rows (sources.html.calendar_events without errors) with confirmation_status.  The guard
    stops before anything is written.
    """
    rows = written(rows, "calendar")
    changes.check_guard(rows.count(), previous, force)
    stamp = F.lit(now)
    listed = rows.withColumn("row_id", F.col("row_index"))
    placed = occurrences.find_series(listed, series, aliases).withColumn("series_id", F.coalesce("series_id", opaque_id("ser", normalize_text(F.col("canonical_name")))))
    once, skipped = changes.without_repeats(placed)
    once = written(once.withColumn("year", F.year("start_date")), "listed")
    own = events.where(F.col("source") == SOURCE)
    match = written(occurrences.match_occurrences(once, own, occurrences.CALENDAR_DAYS, SOURCE).select("row_id", "id", "ambiguous"), "matches")
    new = once.join(match, "row_id", "left").withColumn("matched", F.col("id").isNotNull())
    log = changes.classify(new, own)
    fresh_id = opaque_id("evt", "series_id", "start_date", "country", "row_id")
    seen = new.withColumn("id", F.coalesce("id", fresh_id))
    old = own.select("id", F.col("first_seen_at").alias("_first"), F.col("created_at").alias("_created"), F.col("confirmation_status").alias("_conf"))
    joined = seen.join(old, "id", "left")
    value = {c: F.lit(None).cast(events.schema[c].dataType) for c in events.columns} | {c: F.col(c) for c in events.columns if c in seen.columns}
    value |= {
        "confirmation_status": F.when((F.col("confirmation_status") == "unknown") & F.col("_conf").isNotNull(), F.col("_conf")).otherwise(F.col("confirmation_status")),
        "active": F.lit(True), "lifecycle_status": F.lit("listed"), "source": F.lit(SOURCE), "date_precision": F.lit("day"), "last_seen_at": stamp, "last_synced_at": stamp, "updated_at": stamp,
        "first_seen_at": F.coalesce("_first", stamp), "created_at": F.coalesce("_created", stamp),
    }
    current = joined.select(*(value[c].cast(events.schema[c].dataType).alias(c) for c in events.columns))
    unseen = changes.deactivated(own.join(match.select("id"), "id", "left_anti"), F.to_date(stamp))
    gone = unseen.select(*events.columns)
    others = events.where(F.col("source") != SOURCE)
    names = once.select("series_id", F.explode("aliases").alias("alias")).withColumn("normalized_alias", normalize_text(F.col("alias"))).where("normalized_alias <> ''")
    all_series = series.unionByName(once.join(series.select(F.col("id").alias("series_id")), "series_id", "left_anti").groupBy("series_id").agg(F.min_by("canonical_name", "row_index").alias("canonical_name")).select(F.col("series_id").alias("id"), "canonical_name", normalize_text(F.col("canonical_name")).alias("normalized_name"), F.lit(SOURCE).alias("source"), stamp.alias("created_at"), stamp.alias("updated_at")).select(*series.columns))
    from ..sinks.tables import insert_ignore

    wanted = names.join(all_series.select(F.col("id").alias("series_id"), F.col("normalized_name").alias("_own")), "series_id").where("normalized_alias <> _own").select("series_id", "alias", "normalized_alias", F.lit(SOURCE).alias("source"), stamp.alias("created_at"))
    return {
        "events": current.unionByName(gone).unionByName(others),
        "event_series": all_series,
        "event_aliases": insert_ignore(aliases, wanted, ["series_id", "normalized_alias"], ["alias"]),
        "changes": log,
        "deactivated": unseen.where("was_active"),
        "skipped": skipped,
        "warnings": new.where("ambiguous"),
    }


