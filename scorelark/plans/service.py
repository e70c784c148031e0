"""Catalog queries as a service offers them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_event_name, tokens
from ..operators import dedupe, filters, matching, resolver
from ..operators.scans import sheet_is_fresh

MAX_LOOKUP = 10


def events(tables: dict[str, DataFrame], limit=filters.PAGE_DEFAULT, offset=0, **wanted) -> dict[str, DataFrame]:
    """A page of events and the size of the whole list."""
    view = filters.event_view(tables["events"], tables["event_series"], tables["event_aliases"], tables["provider_events"])
    rows = filters.event_list(view, tables["event_aliases"], tables["provider_events"], **wanted)
    return {"page": filters.page(rows, ["start_date", "name", "id"], limit, offset), "total": filters.page_total(rows)}


def event(tables: dict[str, DataFrame], event_id: str) -> DataFrame:
    """An event in detail, reached by its own id or that of one merged into it."""
    asked = tables["events"].where(F.col("id") == event_id).select("id")
    target = asked.join(dedupe.chain(tables["events"]).select(F.col("old").alias("id"), "new"), "id", "left").select(F.coalesce("new", "id").alias("id"), F.col("id").alias("requested_id"))
    view = filters.event_view(tables["events"], tables["event_series"], tables["event_aliases"], tables["provider_events"], tables["website_checks"], tables["event_external_refs"])
    return view.join(target, "id")


def series(tables: dict[str, DataFrame], series_id: str) -> dict[str, DataFrame]:
    """C3, O3, O4."""
    return {
        "series": tables["event_series"].where(F.col("id") == series_id),
        "aliases": tables["event_aliases"].where(F.col("series_id") == series_id).orderBy("created_at", "alias"),
        "events": filters.live(tables["events"]).where(F.col("series_id") == series_id).orderBy("start_date", "id"),
    }


def resolve(tables: dict[str, DataFrame], requests: DataFrame) -> DataFrame:
    """C4, ER6, ER7, F9, J9: status, confidence and event of each request (request_id, name, q_date, q_year, q_country, q_city)."""
    names = tables["event_aliases"].groupBy("series_id").agg(F.array_sort(F.collect_set("normalized_alias")).alias("alias_norms"))
    series_ = tables["event_series"].select(F.col("id").alias("series_id"), F.col("normalized_name").alias("series_norm"))
    e = filters.live(tables["events"]).select(F.col("id").alias("event_id"), "series_id", normalize_event_name(F.col("name")).alias("name_norm"), "start_date", "year", "country", "city")
    e = e.join(series_, "series_id").join(names, "series_id", "left").withColumn("alias_norms", F.coalesce("alias_norms", F.array().cast("array<string>")))
    q = requests.withColumn("q_name", normalize_event_name(F.col("name"))).drop("name")
    # a candidate shares a whole word with the request under one of its names, else no rule of the score can apply
    words = lambda c: F.explode(tokens(c))
    asked = q.select("request_id", words(F.col("q_name")).alias("word"))
    every = e.select("event_id", words(F.concat_ws(" ", "series_norm", "name_norm", F.array_join("alias_norms", " "))).alias("word")).distinct()
    pairs = asked.join(every, "word").select("request_id", "event_id").distinct()
    scored = resolver.score(pairs.join(q, "request_id").join(e, "event_id"))
    return resolver.answer(resolver.decide(q, resolver.candidates(scored)))


def search_sheets(entries: DataFrame, events_: DataFrame, name_norm: str, year: int | None = None) -> DataFrame:
    """Entries of a name with their event, newest first; with a year only events of it."""
    joined = entries.where(F.col("normalized_name") == name_norm).join(events_.select(F.col("id").alias("event_id"), F.col("name").alias("event_name"), "start_date"), "event_id", "left")
    joined = joined if year is None else joined.where(F.year("start_date") == filters.as_int(year, "year"))
    return joined.orderBy(F.desc_nulls_last("start_date"), "event_id", "sheet_url")


def coverage(provider_events: DataFrame, sheets: DataFrame) -> dict[str, DataFrame]:
    """providers' events and sheets, and the years indexed (by provider and key, K5)."""
    parsed = sheets.where("status = 'parsed'").select("provider", F.col("provider_event_key").alias("provider_key"), "url", "fetched_at")
    years = provider_events.select("provider", "provider_key", F.year("start_date").alias("year")).join(parsed, ["provider", "provider_key"], "left")
    return {
        "providers": provider_events.groupBy("provider").agg(F.count("*").alias("events"), F.min("start_date").alias("first"), F.max("start_date").alias("last")).orderBy("provider"),
        "sheets": sheets.groupBy("provider", "status").count().orderBy("provider", "status"),
        "years": years.groupBy("year").agg(F.count_distinct("provider", "provider_key").alias("events"), F.count_distinct("url").alias("sheets"), F.max("fetched_at").alias("last_indexed")).orderBy(F.desc_nulls_last("year")),
    }


def lookup(tables: dict[str, DataFrame], ids: list[str], name_norm: str, now) -> DataFrame:
    """Per asked event (ten at most) found, not_found, no_sheets or stale, with the number of the name's entries.

    The pages are the event's own or similar ones near its date (J14); stale sheets are to be fetched again (ST3).
    """
    if len(ids) > MAX_LOOKUP:
        raise filters.InvalidFilter(f"at most {MAX_LOOKUP} events")
    from ..sources.sheets import PARSER_VERSION

    e = tables["events"].where(F.col("id").isin(ids))
    names = e.select("id", normalize_event_name(F.col("name")).alias("name_norm")).unionByName(e.select("id", "series_id").join(tables["event_aliases"].select("series_id", "normalized_alias"), "series_id").select("id", F.col("normalized_alias").alias("name_norm")))
    pages = matching.pages_for_events(e, names, tables["provider_events"])
    sheets = pages.join(tables["scoresheet_sheets"].withColumnRenamed("provider_event_key", "provider_key").drop("event_id"), ["provider", "provider_key"]).join(e.select("id", "end_date"), "id")
    version = F.create_map(*(F.lit(x) for pair in PARSER_VERSION.items() for x in pair))[F.col("provider")]
    fresh = sheets.withColumn("fresh", sheet_is_fresh(F.col("status"), F.col("parser_version"), version, F.col("end_date"), F.col("fetched_at"), now))
    hits = fresh.join(tables["scoresheet_entries"].where(F.col("normalized_name") == name_norm).select(F.col("sheet_url").alias("url"), F.lit(1).alias("hit")), "url", "left")
    per = hits.groupBy("id").agg(F.count_distinct("url").alias("sheets"), F.bool_and("fresh").alias("fresh"), F.count("hit").alias("entries"))
    status = F.when(F.col("sheets").isNull(), "no_sheets").when(~F.col("fresh"), "stale").when(F.col("entries") > 0, "found").otherwise("not_found")
    return e.select("id", "name").join(per, "id", "left").select("id", "name", status.alias("status"), F.coalesce("entries", F.lit(0)).alias("entries"))


def health(runs: DataFrame) -> DataFrame:
    """The newest run of each source."""
    return matching.first_by(runs, ["source"], [F.desc("id")]).select("source", "id", "status", "started_at", "finished_at")
