"""Schemas of the stored tables, and upgrades from one version of them to the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = 3

_STAMPS = "created_at timestamp, updated_at timestamp"
TABLES: dict[str, str] = {
    "event_series": f"id string, canonical_name string, normalized_name string, source string, {_STAMPS}",
    "events": (
        "id string, series_id string, name string, normalized_name string, start_date date, end_date date, year int, date_precision string, city string, region string, country string, country_raw string, "
        "location_raw string, event_status string, confirmation_status string, hiatus boolean, active boolean, lifecycle_status string, source string, website_url string, source_url string, raw_payload string, "
        f"content_hash string, merged_into string, first_seen_at timestamp, last_seen_at timestamp, last_synced_at timestamp, {_STAMPS}"
    ),
    "event_aliases": "series_id string, alias string, normalized_alias string, source string, created_at timestamp",
    "event_observations": "event_id string, sync_run_id long, source string, observed_at timestamp, content_hash string, raw_payload string, previous_values map<string,string>",
    "event_external_refs": "source string, external_id string, event_id string, url string, created_at timestamp",
    "series_external_refs": "source string, external_id string, series_id string, created_at timestamp",
    "sync_runs": "id long, source string, source_url string, started_at timestamp, finished_at timestamp, status string, records_found int, records_added int, records_updated int, records_unchanged int, records_deactivated int, records_skipped int, errors array<string>, warnings array<string>, changes array<string>, snapshot_path string",
    "registry_cache": "query string, payload string, fetched_at timestamp",
    "scoresheet_sheets": "url string, provider string, provider_event_key string, event_id string, title string, status string, entries int, content_hash string, error string, fetched_at timestamp, parser_version int",
    "scoresheet_entries": "sheet_url string, event_id string, provider string, section string, division string, round string, role string, competitor_name string, normalized_name string, partner_name string, bib string, place int, rank int, competed int, marks map<string,string>, marks_list array<string>, counts string, score double, advanced boolean, alternate string, registry_id long",
    "provider_events": "provider string, provider_key string, event_id string, name string, start_date date, end_date date, index_url string, links array<struct<title:string,url:string>>, fetched_at timestamp",
    "website_checks": "event_id string, website_url string, checked_at timestamp, status string, provider_links array<string>, other_links array<struct<text:string,href:string>>, error string",
    "judge_aliases": "alias_norm string, alias_name string, judge_key string, judge_name string, method string, confidence string, reason string, candidates array<string>, panels long, updated_at timestamp",
    "judge_overrides": "id long, action string, name_a string, name_b string, created_at timestamp",
    "provider_scan_state": "provider string, provider_key string, status string, first_seen_at timestamp, last_checked_at timestamp",
}
KEYS: dict[str, list[str]] = {
    "event_series": ["id"], "events": ["id"], "event_aliases": ["series_id", "normalized_alias"], "event_external_refs": ["source", "external_id"], "series_external_refs": ["source", "external_id"],
    "registry_cache": ["query"], "scoresheet_sheets": ["url"], "provider_events": ["provider", "provider_key"], "website_checks": ["event_id"], "judge_aliases": ["alias_norm"], "provider_scan_state": ["provider", "provider_key"],
}


def _precision(df: DataFrame) -> DataFrame:
    return df.withColumn("date_precision", F.lit("day"))


def _merged(df: DataFrame) -> DataFrame:
    return df.withColumn("merged_into", F.lit(None).cast("string"))


#: version reached -> table -> upgrade
UPGRADES: dict[int, dict[str, Callable[[DataFrame], DataFrame]]] = {2: {"events": _precision}, 3: {"events": _merged}}


def upgraded(table: str, df: DataFrame, version: int) -> DataFrame:
    """A table of an older version in today's shape: every upgrade since then, in order, once."""
    for v in range(version + 1, VERSION + 1):
        df = UPGRADES.get(v, {}).get(table, lambda x: x)(df)
    return df
