"""Event list filters, paging and validation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clamp
from ..functions.places import country_filter
from ..functions.text import _py_normalize

PAGE_DEFAULT, PAGE_MAX = 50, 500
ENUMS = {
    "event_status": {"registry", "trial", "unknown"},
    "confirmation_status": {"confirmed", "unconfirmed", "unknown"},
    "lifecycle_status": {"listed", "past", "missing_from_source", "historical"},
}


class InvalidFilter(ValueError):
    """A filter value that can't be understood."""


def as_int(value, name: str) -> int:
    """F3."""
    try:
        return int(value)
    except (TypeError, ValueError):
        raise InvalidFilter(f"{name} must be an integer") from None


def as_bool(value) -> bool:
    """F6."""
    text = str(value).strip().lower()
    if text not in ("1", "true", "yes", "0", "false", "no"):
        raise InvalidFilter(f"not a boolean: {value!r}")
    return text in ("1", "true", "yes")


def as_enum(value, name: str) -> str:
    """F5."""
    if value not in ENUMS[name]:
        raise InvalidFilter(f"{name} must be one of {sorted(ENUMS[name])}")
    return value


def overlaps(start: Column, end: Column, since, until) -> Column:
    """inclusive; rows without dates drop."""
    return (end >= F.lit(since).cast("date")) & (start <= F.lit(until).cast("date"))


def live(events: DataFrame) -> DataFrame:
    """without events that were merged into others."""
    return events.where("merged_into IS NULL")


def search(events: DataFrame, aliases: DataFrame, term: str) -> DataFrame:
    """The term in the event's or series' name, or in any alias of the series."""
    words = _py_normalize(term)
    named = F.contains("normalized_name", F.lit(words)) | F.contains("series_norm", F.lit(words))
    by_alias = aliases.where(F.contains("normalized_alias", F.lit(words))).select("series_id").distinct().withColumn("_alias", F.lit(True))
    return events.join(by_alias, "series_id", "left").where(named | F.coalesce("_alias", F.lit(False))).drop("_alias")


def with_results(events: DataFrame, provider_events: DataFrame, available: bool = True) -> DataFrame:
    """Events that have (or lack) a provider's record."""
    return events.join(provider_events.where("event_id IS NOT NULL").select(F.col("event_id").alias("id")).distinct(), "id", "left_semi" if available else "left_anti")


def event_list(events: DataFrame, aliases: DataFrame | None = None, provider_events: DataFrame | None = None, **filters) -> DataFrame:
    """every filter that is given must hold.  ``events`` already carry series_norm."""
    out = live(events)
    if (year := filters.get("year")) is not None:
        out = out.where(F.col("year") == as_int(year, "year"))
    if country := country_filter(filters.get("country")):
        out = out.where(F.col("country") == country)
    for name in ENUMS:
        if filters.get(name) is not None:
            out = out.where(F.col(name) == as_enum(filters[name], name))
    if filters.get("active") is not None:
        out = out.where(F.col("active") == as_bool(filters["active"]))
    if filters.get("series_id"):
        out = out.where(F.col("series_id") == filters["series_id"])
    if filters.get("since"):
        out = out.where(F.col("end_date") >= F.lit(date.fromisoformat(filters["since"])))
    if filters.get("until"):
        out = out.where(F.col("start_date") <= F.lit(date.fromisoformat(filters["until"])))
    if filters.get("results_available") is not None:
        out = with_results(out, provider_events, as_bool(filters["results_available"]))
    return search(out, aliases, filters["q"]) if filters.get("q") else out


def page(rows: DataFrame, order: list, limit=PAGE_DEFAULT, offset=0) -> DataFrame:
    """O1: ``order`` must be total."""
    limit, offset = max(1, min(as_int(limit, "limit"), PAGE_MAX)), max(0, as_int(offset, "offset"))
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_total(rows: DataFrame) -> DataFrame:
    """A1."""
    return rows.agg(F.count("*").alias("total"))


def latest_runs(runs: DataFrame, limit=20) -> DataFrame:
    """O2: newest first, 1 to 200 of them."""
    return runs.orderBy(F.desc("id")).limit(max(1, min(as_int(limit, "limit"), 200)))


def equal_where(rows: DataFrame, **wanted) -> DataFrame:
    """equality on each column that is given."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def among(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """rows whose column is one of the keys."""
    return rows.join(keys.select(F.col(keys.columns[0]).alias(column)).distinct(), column, "left_semi")


def any_token(name: Column, tokens: list[str]) -> Column:
    """any token of more than two letters (or any at all, if none is that long) occurs in the name."""
    wanted = [t for t in tokens if len(t) > 2] or tokens
    return F.exists(F.array(*map(F.lit, wanted)), lambda t: F.contains(name, t))


def name_or_id(entries: DataFrame, name_norm: str, known_id: int | None) -> DataFrame:
    """the same name and no contradicting number, or the same number."""
    if known_id is None:
        return entries.where(F.col("normalized_name") == name_norm)
    same = F.col("registry_id") == known_id
    return entries.where(((F.col("normalized_name") == name_norm) & (F.col("registry_id").isNull() | same)) | same)


def mapped_marks(entries: DataFrame) -> DataFrame:
    """F11."""
    return entries.where("marks IS NOT NULL")


def compatible_countries(a: Column, b: Column) -> Column:
    """F16."""
    return a.isNull() | b.isNull() | (a == b)


def in_month(start: Column, end: Column, month: Column) -> Column:
    """``month`` is its first day."""
    return (F.trunc(start, "month") == month) | (F.trunc(end, "month") == month)


def in_year(start: Column, year: Column) -> Column:
    """F18, F20."""
    return F.year(start) == year


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rows with an error)."""
    return rows.where("error IS NULL"), rows.where("error IS NOT NULL")


def clamped(value: Column, low: int, high: int) -> Column:
    return clamp(value, low, high)


def event_view(events: DataFrame, series: DataFrame, aliases: DataFrame, provider_events: DataFrame, checks: DataFrame | None = None, refs: DataFrame | None = None) -> DataFrame:
    """Events with series name, aliases in order and whether results exist; with checks and refs the details too.

    All parts are joined once, never per row.
    """
    listed = aliases.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "alias"))).alias("_a"))
    out = events.join(series.select(F.col("id").alias("series_id"), "canonical_name", F.col("normalized_name").alias("series_norm")), "series_id").join(listed, "series_id", "left")
    has = provider_events.where("event_id IS NOT NULL").select(F.col("event_id").alias("id")).distinct().withColumn("_r", F.lit(True))
    out = out.join(has, "id", "left").withColumns({"aliases": F.coalesce(F.transform("_a", lambda x: x["alias"]), F.array().cast("array<string>")), "results_available": F.coalesce("_r", F.lit(False))})
    if checks is not None:
        out = out.join(checks.select(F.col("event_id").alias("id"), F.col("other_links").alias("website_links")), "id", "left")
    if refs is not None:
        own = refs.groupBy(F.col("event_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("source", "external_id", "url"))).alias("external_refs"))
        out = out.join(own, "id", "left")
    return out.drop("_a", "_r")


def match_context(view: DataFrame) -> DataFrame:
    """Search terms of an event: its names once each, in order, and the name with its year."""
    names = F.array_distinct(F.filter(F.concat(F.array("canonical_name", "name"), "aliases"), lambda n: n.isNotNull() & (n != "")))
    with_year = F.when(F.col("year").isNotNull(), F.array_append(names, F.concat_ws(" ", "canonical_name", F.col("year").cast("string")))).otherwise(names)
    return view.withColumn("search_terms", with_year)
