"""Single functions, filters and rules on the driver's rows (X*, D*, L*, M*, F*, U*, ST*, O*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, jsons, marks, numbers, places, text
from ..operators import changes, dedupe, filters, matching, occurrences, scans
from ..plans import service
from ..session import new_folder
from ..sinks import snapshots, tables
from ..sources import pages
from ..views import Registry, view

query = Registry()


def _case(c, values, *, n: int):
    """Values in turn by the remainder of a column."""
    out = None
    for i, v in enumerate(values):
        out = F.when(c % n == i, v) if out is None else out.when(c % n == i, v)
    return out


# ---------------------------------------------------------------- text
@query("q_hiatus", "SELECT p_partkey AS id, p_size % 3 <> 2 AS hiatus FROM part")
def hiatus(t):
    listed = F.concat("p_name", _case(F.col("p_size"), [" (Hiatus until 2027)", " - ON HIATUS", " hiatuses"], n=3))
    return t["part"].select(F.col("p_partkey").alias("id"), text.detect_hiatus(listed).alias("hiatus"))


@query("q_bibs", "SELECT p_partkey AS id, CAST(p_partkey AS STRING) AS leader, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS STRING) END AS follower FROM part")
def bibs(t):
    bib = F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("/"), F.col("p_size").cast("string"))).otherwise(""))
    return t["part"].select(F.col("p_partkey").alias("id"), text.split_bib(bib).alias("b")).select("id", "b.leader", "b.follower")


@query("q_role_names", "SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'leader' WHEN 1 THEN 'leader' WHEN 2 THEN 'follower' WHEN 3 THEN 'pro am' END AS role FROM part")
def role_names(t):
    return t["part"].select(F.col("p_partkey").alias("id"), text.role(_case(F.col("p_size"), ["LEADER", " lead", "Follow", "Pro-Am", " "], n=5)).alias("role"))


@query("q_clean_urls", "SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'https://a.example/' || p_partkey WHEN 1 THEN 'http://b.example' END AS url FROM part")
def clean_urls(t):
    raw = _case(F.col("p_size"), [F.concat(F.lit("http://https://a.example/"), F.col("p_partkey").cast("string")), F.lit("  http://b.example "), F.lit("  ")], n=3)
    return t["part"].select(F.col("p_partkey").alias("id"), text.clean_url(raw).alias("url"))


@query("q_flag_codes", "SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'DEU' WHEN 1 THEN 'FRA' ELSE 'USA' END AS code FROM part")
def flag_codes(t):
    k = F.col("p_size") % 3
    href = F.when(k == 0, "https://x.example/?a=1&country=deu").otherwise("https://x.example/?a=1")
    return t["part"].select(F.col("p_partkey").alias("id"), text.flag_code(href, F.when(k < 2, "/flags/fra.png?v=2"), F.lit(" usa ")).alias("code"))


@query("q_provider_urls", """
SELECT p_partkey AS id, 'https://scoring.dance/enUS/events/' || p_partkey AS english, CASE p_size % 3 WHEN 0 THEN 'https://eepro.com/results/2020/' WHEN 1 THEN 'https://scoring.dance/enUS/events/' || p_partkey || '/results/' ELSE 'https://scores.worlddanceregistry.com/' || p_partkey || '/rounds' END AS index_page FROM part""")
def provider_urls(t):
    key = F.col("p_partkey").cast("string")
    provider = _case(F.col("p_size"), ["eepro", "scoring_dance", "wdr"], n=3)
    return t["part"].select(F.col("p_partkey").alias("id"), text.to_english(F.concat(F.lit("https://scoring.dance/"), _case(F.col("p_size"), ["frFR", "deDE", "enUS"], n=3), F.lit("/events/"), key)).alias("english"), text.index_url(provider, key, F.lit(2020)).alias("index_page"))


@query("q_mark_codes", """
SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' WHEN 2 THEN 'A1' WHEN 3 THEN 'A2' WHEN 4 THEN 'A' ELSE '7' END AS by_word, CASE p_size % 6 WHEN 0 THEN 'Y' WHEN 1 THEN 'A1' WHEN 2 THEN 'A2' WHEN 3 THEN 'A3' WHEN 4 THEN 'N' END AS by_points FROM part""")
def mark_codes(t):
    word, points = _case(F.col("p_size"), ["Yes", "NO", "alt 1", "Alt2", "ALT", "7"], n=6), _case(F.col("p_size"), [10.0, 4.52, 4.3, 4.19, 0.01, 3.0], n=6)
    return t["part"].select(F.col("p_partkey").alias("id"), marks.mark_from_word(word).alias("by_word"), marks.mark_from_points(points).alias("by_points"))


@query("q_masked_names", "SELECT p_partkey AS id, p_size % 2 = 0 AS masked, 'rule ' || p_name AS rule FROM part")
def masked_names(t):
    return t["part"].select(F.col("p_partkey").alias("id"), text.is_masked(F.when(F.col("p_size") % 2 == 0, " *** ").otherwise(F.col("p_name"))).alias("masked"), text.strip_tags(F.concat(F.lit("<b>rule</b>"), "p_name", F.lit("<br/>"))).alias("rule"))


@query("q_places_disagree", """
SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'SWE' WHEN 1 THEN 'SWE' WHEN 2 THEN 'FRA' END AS country, s_suppkey % 4 = 0 AS warned FROM supplier""")
def places_disagree(t):
    k = F.col("s_suppkey")
    named, flag = _case(k, [F.lit("SWE"), F.lit("SWE"), F.lit(None).cast("string"), F.lit(None).cast("string")], n=4), _case(k, ["FRA", "SWE", "FRA", "BLANK"], n=4)
    return t["supplier"].select(k.alias("id"), places.country_of(named, flag).alias("c")).select("id", "c.country", F.col("c.warning").isNotNull().alias("warned"))


# ---------------------------------------------------------------- dates and values
@query("q_us_dates", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END AS d FROM orders")
def us_dates(t):
    raw = _case(F.col("o_orderkey"), [F.concat(F.lit("held at "), F.date_format("o_orderdate", "M/d/yyyy"), F.lit(" in town")), F.lit("at 13/45/2020"), F.date_format("o_orderdate", "MM/dd/yyyy")], n=3)
    return t["orders"].select(F.col("o_orderkey").alias("id"), dates.extract_us_date(raw).alias("d"))


@query("q_event_years", "SELECT id, start_date, CASE WHEN id % 2 = 0 THEN end_date ELSE start_date END AS end_date, CAST(year(start_date) AS INT) AS year, start_date >= DATE '1998-12-02' AS recent FROM events_view")
def event_years(t):
    e = view(t, "events_view").withColumn("y", dates.with_year(F.col("start_date"), F.when(F.col("id") % 2 == 0, F.col("end_date"))))
    return e.select("id", "y.start_date", "y.end_date", "y.year", (F.col("y.start_date") >= dates.cutoff(F.lit("1999-01-01").cast("date"), 30)).alias("recent"))


@query("q_clamped", "SELECT p_partkey AS id, greatest(least(p_size, 20), 5) AS size FROM part")
def clamped(t):
    return t["part"].select(F.col("p_partkey").alias("id"), numbers.clamp(F.col("p_size"), 5, 20).alias("size"))


_HASH = """substr(sha256('{"p_partkey":' || p_partkey || ',"p_name":' || CASE WHEN p_size % 2 = 0 THEN 'null' ELSE '"' || p_name || '"' END || '}'), 1, 16)"""


@query("q_content_hash", f"SELECT p_partkey AS id, {_HASH} AS hash, 'evt_' || {_HASH} AS opaque FROM part")
def content_hash(t):
    p = t["part"].withColumn("p_name", F.when(F.col("p_size") % 2 == 1, F.col("p_name")))
    return p.select(F.col("p_partkey").alias("id"), jsons.content_hash("p_partkey", "p_name").alias("hash"), jsons.opaque_id("evt", "p_partkey", "p_name").alias("opaque"))


@query("q_json_lists", "SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN p_brand || '|end' WHEN 1 THEN 'end' ELSE 'a|b' END AS items FROM part")
def json_lists(t):
    raw = _case(F.col("p_size"), [F.concat(F.lit('["'), "p_brand", F.lit('"]')), F.lit("broken"), F.lit('["a","b"]')], n=3)
    return t["part"].select(F.col("p_partkey").alias("id"), F.array_join(jsons.append(jsons.parse_list(raw), F.lit("end"), 2), "|").alias("items"))


@query("q_zip_marks", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_brand END AS first_mark FROM part")
def zip_marks(t):
    judges = F.array(F.lit("A"), F.lit("B"))
    listed = F.when(F.col("p_size") % 2 == 0, F.array("p_brand", F.lit("N"))).otherwise(F.array("p_brand"))
    return t["part"].select(F.col("p_partkey").alias("id"), jsons.zip_marks(judges, listed)["A"].alias("first_mark"))


@query("q_na_values", "SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN p_brand END AS value FROM part")
def na_values(t):
    return t["part"].select(F.col("p_partkey").alias("id"), jsons.na_to_null(_case(F.col("p_size"), [F.col("p_brand"), F.lit("N/A"), F.lit("")], n=3)).alias("value"))


@query("q_json_rows", """SELECT '{"id":' || n_nationkey || ',"name":"' || n_name || '","region":' || CASE WHEN n_regionkey % 2 = 0 THEN 'null' ELSE CAST(n_regionkey AS STRING) END || '}' AS json FROM nation""")
def json_rows(t):
    return snapshots.as_json(t["nation"].select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") % 2 == 1, F.col("n_regionkey")).alias("region")))


# ---------------------------------------------------------------- filters
@query("q_filters_typed", "SELECT id FROM events_view WHERE year = 1998 AND id % 2 = 1 AND series_id = 7 AND start_date <= DATE '1998-12-31' AND end_date >= DATE '1998-01-10'")
def filters_typed(t):
    e = view(t, "events_view").withColumns({"merged_into": F.lit(None).cast("long"), "active": F.col("id") % 2 == 0})
    return filters.event_list(e, year="1998", active="No", series_id=7, since="1998-01-10", until="1998-12-31").select("id")


@query("q_live_events", "SELECT id FROM events_view WHERE id % 5 <> 0 AND year = 1999 AND lifecycle_status = 'past'")
def live_events(t):
    e = view(t, "events_view").withColumn("merged_into", F.when(F.col("id") % 5 == 0, F.col("id") + 1))
    return filters.equal_where(filters.live(e), year=1999, lifecycle_status="past", country=None).select("id")


@query("q_among_keys", "SELECT id, series_id FROM events_view WHERE series_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def among_keys(t):
    keys = t["customer"].where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return filters.among(view(t, "events_view"), "series_id", keys).select("id", "series_id")


@query("q_compatible_countries", "SELECT s_suppkey AS id, s_suppkey % 3 = 0 OR s_nationkey < 13 OR s_nationkey = 20 AS fits FROM supplier")
def compatible_countries(t):
    s = t["supplier"]
    own, other = F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey")), F.when(F.col("s_nationkey") >= 13, F.lit(20))
    return s.select(F.col("s_suppkey").alias("id"), filters.compatible_countries(own, other).alias("fits"))


@query("q_month_or_year", "SELECT id, date_trunc('month', start_date) = DATE '1997-03-01' OR date_trunc('month', end_date) = DATE '1997-03-01' AS in_month, year(start_date) = 1997 AS in_year FROM events_view")
def month_or_year(t):
    return view(t, "events_view").select("id", filters.in_month(F.col("start_date"), F.col("end_date"), F.lit("1997-03-01").cast("date")).alias("in_month"), filters.in_year(F.col("start_date"), F.lit(1997)).alias("in_year"))


@query("q_bad_rows", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 = 0")
def bad_rows(t):
    rows = t["orders"].withColumn("error", F.when(F.col("o_orderkey") % 4 == 0, "unrecognized date"))
    good, bad = filters.quarantine(rows)
    return bad.join(good.select("o_orderkey"), "o_orderkey", "left_anti").select(F.col("o_orderkey").alias("id"))


@query("q_dates_agree", "SELECT id, id % 3 = 0 AND (id % 21) <= 10 AS agree FROM events_view")
def dates_agree(t):
    other = F.when(F.col("id") % 3 == 0, F.date_add("start_date", (F.col("id") % 21).cast("int")))
    return view(t, "events_view").select("id", matching.dates_agree(F.col("start_date"), other).alias("agree"))


@query("q_latest_runs", "SELECT o_orderkey AS id FROM orders ORDER BY id DESC LIMIT 200")
def latest_runs(t):
    return filters.latest_runs(t["orders"].select(F.col("o_orderkey").alias("id")), 999)


# ---------------------------------------------------------------- series, pages and sheets of events
def _series(t):
    s = t["customer"].select(F.col("c_custkey").alias("id"), F.col("c_name").alias("canonical_name"), text.normalize_text(F.col("c_name")).alias("normalized_name"), F.col("c_custkey").alias("created_at"))
    a = s.select(F.col("id").alias("series_id"), F.concat(F.lit("other name "), (F.col("id") % 50).cast("string")).alias("normalized_alias"))
    return s, a


@query("q_find_series", """
SELECT c_custkey AS row_id, CASE c_custkey % 3 WHEN 0 THEN c_custkey WHEN 1 THEN c_custkey % 50 END AS series_id FROM customer""")
def find_series(t):
    series, aliases = _series(t)
    c = F.col("c_custkey")
    rows = t["customer"].select(c.alias("row_id"), F.when(c % 3 == 0, F.col("c_name")).otherwise("unheard of").alias("canonical_name"), F.when(c % 3 == 1, F.array(F.concat(F.lit("Other-Name "), (c % 50).cast("string")))).otherwise(F.array(F.lit("abc"))).alias("aliases"))
    return occurrences.find_series(rows, series, aliases).select("row_id", "series_id")


@query("q_pages_for_events", """
WITH w AS (SELECT id, CASE WHEN id % 4 = 0 THEN id END AS event_id, 'k' || id AS provider_key, start_date + CAST(id % 6 AS INT) AS d, name FROM events_view)
SELECT e.id, w.provider_key FROM events_view e JOIN w ON w.event_id = e.id
UNION
SELECT e.id, w.provider_key FROM events_view e JOIN w ON w.name = e.name AND abs(date_diff('day', e.start_date, w.d)) <= 3 WHERE e.id % 4 <> 0""")
def pages_for_events(t):
    e = view(t, "events_view")
    named = F.col("name")
    own = e.select("id", "start_date")
    site = e.select(F.when(F.col("id") % 4 == 0, F.col("id")).alias("event_id"), F.lit("p").alias("provider"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("provider_key"), F.date_add("start_date", (F.col("id") % 6).cast("int")).alias("start_date"), named.alias("name"))
    return matching.pages_for_events(own, e.select("id", text.normalize_text(named).alias("name_norm")), site).select("id", "provider_key")


_WORDS_SQL = "list_distinct(list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''))"


@query("q_pages_half_alike", f"""
WITH e AS (SELECT p_partkey AS id, DATE '2026-01-01' + CAST(p_partkey % 300 AS INT) AS d, {_WORDS_SQL.format("p_name || ' ' || p_type")} AS w FROM part),
p AS (SELECT p_partkey AS key, DATE '2026-01-01' + CAST((p_partkey * 7) % 300 AS INT) AS d, {_WORDS_SQL.format("p_brand || ' the ' || p_name || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' ' || p_type END")} AS w FROM part)
SELECT e.id, p.key AS page FROM e JOIN p ON abs(date_diff('day', e.d, p.d)) <= 3 WHERE 2 * len(list_intersect(e.w, p.w)) >= len(list_distinct(list_concat(e.w, p.w)))""")
def pages_half_alike(t):
    """Names as they are: parts' names share their words with very many others."""
    p, k = t["part"], F.col("p_partkey")
    day = lambda n: F.date_add(F.lit("2026-01-01").cast("date"), (n % 300).cast("int"))
    own = p.select(k.alias("id"), day(k).alias("start_date"))
    names = p.select(k.alias("id"), text.normalize_text(F.concat_ws(" ", "p_name", "p_type")).alias("name_norm"))
    pages = p.select(F.lit(None).cast("long").alias("event_id"), F.lit("p").alias("provider"), k.alias("provider_key"), F.concat_ws(" ", "p_brand", F.lit("the"), "p_name", F.when(k % 3 != 0, F.col("p_type"))).alias("name"), day(k * 7).alias("start_date"))
    return matching.pages_for_events(own, names, pages).select("id", F.col("provider_key").alias("page"))


@query("q_search_sheets", """
SELECT l_orderkey AS event_id, l_linenumber AS line, c_name AS event_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_suppkey = 3 AND year(o_orderdate) = 1999""")
def search_sheets(t):
    entries = t["lineitem"].select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("line"), F.col("l_orderkey").cast("string").alias("sheet_url"), F.concat(F.lit("dancer "), F.col("l_suppkey").cast("string")).alias("normalized_name"))
    return service.search_sheets(entries, view(t, "events_view"), "dancer 3", 1999).select("event_id", "line", "event_name")


@query("q_coverage_providers", "SELECT o_orderpriority AS provider, count(*) AS events, min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last FROM orders GROUP BY 1")
def coverage_providers(t):
    o = t["orders"]
    events = o.select(F.col("o_orderpriority").alias("provider"), F.col("o_orderkey").alias("provider_key"), F.to_date("o_orderdate").alias("start_date"))
    sheets = t["lineitem"].select(F.lit("x").alias("provider"), F.col("l_orderkey").alias("provider_event_key"), F.lit("parsed").alias("status"), F.lit("u").alias("url"), F.col("l_shipdate").alias("fetched_at"))
    return service.coverage(events, sheets)["providers"]


def _catalog(t):
    """Tables of the service, of the driver's rows."""
    e = view(t, "events_view").withColumns({"merged_into": F.when(F.col("id") % 11 == 0, F.col("id") + 1), "city": F.lit(None).cast("string"), "active": F.col("id") % 2 == 0})
    s, _ = _series(t)
    aliases = s.select(F.col("id").alias("series_id"), F.concat(F.lit("AKA "), "canonical_name").alias("alias"), F.concat(F.lit("aka "), "normalized_name").alias("normalized_alias"), "created_at")
    provider = e.where("id % 3 = 0").select(F.col("id").alias("event_id"), F.lit("p").alias("provider"), F.col("id").cast("string").alias("provider_key"), "start_date", "name")
    return {"events": e, "event_series": s, "event_aliases": aliases, "provider_events": provider}


@query("q_service_events", "SELECT id, name, results_available FROM (SELECT id, name, start_date, id % 3 = 0 AS results_available FROM events_view WHERE year = 1997 AND id % 11 <> 0 AND id % 3 = 0) ORDER BY start_date, name, id LIMIT 20 OFFSET 10")
def service_events(t):
    return service.events(_catalog(t), limit="20", offset=10, year=1997, results_available="yes")["page"].select("id", "name", "results_available")


@query("q_service_series", "SELECT id, start_date FROM events_view WHERE series_id = 5 AND id % 11 <> 0")
def service_series(t):
    return service.series(_catalog(t), 5)["events"].select("id", "start_date")


@query("q_service_resolve", """
WITH q AS (SELECT id AS request_id, name, start_date + 1 AS q_date FROM events_view),
s AS (SELECT request_id, id AS event_id, start_date, CASE WHEN abs(date_diff('day', q_date, start_date)) <= 3 THEN 900 WHEN abs(date_diff('day', q_date, start_date)) <= 14 THEN 750 WHEN abs(date_diff('day', q_date, start_date)) > 60 THEN 400 ELSE 600 END AS score FROM q JOIN events_view e ON e.name = q.name WHERE id % 11 <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, start_date, event_id) AS n FROM s),
d AS (SELECT request_id, max(score) FILTER (n = 1) AS top, coalesce(max(score) FILTER (n = 2), 0) AS second, max(event_id) FILTER (n = 1) AS best FROM k GROUP BY 1)
SELECT q.request_id, CASE WHEN top IS NULL THEN 'not_found' WHEN top >= 700 AND top - second >= 150 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN top >= 700 AND top - second >= 150 THEN best END AS event_id FROM q LEFT JOIN d USING (request_id)""")
def service_resolve(t):
    null = F.lit(None)
    asked = view(t, "events_view").select(F.col("id").alias("request_id"), "name", F.date_add("start_date", 1).alias("q_date"), null.cast("int").alias("q_year"), null.cast("string").alias("q_country"), null.cast("string").alias("q_city"))
    # names of customers are one word, so that a request meets its own series only
    tables_ = _catalog(t)
    one = lambda df, *cs: df.withColumns({c: F.regexp_replace(c, "[# ]", "x") for c in cs})
    tables_ |= {"events": one(tables_["events"], "name"), "event_series": one(tables_["event_series"], "normalized_name"), "event_aliases": one(tables_["event_aliases"], "normalized_alias")}
    return service.resolve(tables_, one(asked, "name")).select("request_id", "status", "event_id")


_LOOKED = "(100, 101, 102, 103, 104, 105, 106, 107, 108, 109)"


@query("q_service_lookup", f"""
SELECT id, CASE WHEN id % 3 <> 0 THEN 'no_sheets' WHEN id % 2 = 0 THEN 'stale' WHEN id % 9 = 0 THEN 'found' ELSE 'not_found' END AS status, CASE WHEN id % 9 = 0 THEN 2 ELSE 0 END AS entries FROM events_view WHERE id IN {_LOOKED}""")
def service_lookup(t):
    c = _catalog(t)
    site = c["provider_events"].withColumn("provider", F.lit("wdr"))
    now = F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")
    sheets = site.select("provider", F.col("provider_key").alias("provider_event_key"), F.col("event_id"), F.concat(F.lit("u"), "provider_key").alias("url"), F.lit("parsed").alias("status"), F.when(F.col("event_id") % 2 == 0, 0).otherwise(1).alias("parser_version"), F.lit("2029-01-01 00:00:00").cast("timestamp_ntz").alias("fetched_at"))
    entries = sheets.where("event_id % 9 = 0").select(F.col("url").alias("sheet_url"), F.explode(F.array(F.lit("ann lee"), F.lit("ann lee"), F.lit("other"))).alias("normalized_name"))
    found = service.lookup(c | {"provider_events": site, "scoresheet_sheets": sheets, "scoresheet_entries": entries}, list(range(100, 110)), "ann lee", now)
    return found.select("id", "status", F.col("entries").cast("int").alias("entries"))


# ---------------------------------------------------------------- changes and polling
@query("q_observations", """
SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS old_status FROM orders WHERE o_orderkey % 3 <> 2""")
def observations(t):
    o = t["orders"]
    old = o.where("o_orderkey % 3 <> 1").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit(True).alias("active"))
    new = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "changed").otherwise(F.col("o_orderstatus")).alias("status"))
    log = changes.observations(changes.classify(new, old, ["status"]), new, 1, F.lit("2024-01-01").cast("date"))
    return log.select("event_id", F.col("previous_values")["status"].alias("old_status"))


@query("q_confirmation_kept", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'unchanged' ELSE 'updated' END AS action FROM orders")
def confirmation_kept(t):
    o = t["orders"].select(F.col("o_orderkey").alias("id"))
    old = o.withColumns({"confirmation_status": F.lit("confirmed"), "active": F.lit(True)})
    new = o.withColumn("confirmation_status", F.when(F.col("id") % 2 == 0, "unknown").otherwise("unconfirmed"))
    return changes.classify(new, old, ["confirmation_status"]).select("id", "action")


@query("q_guard", """
SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) >= 20 AND count(*) FILTER (o_orderstatus = 'O') < 0.7 * count(*) AS tripped FROM orders GROUP BY 1""")
def guard(t):
    """A listing of a year's open orders after one of all its orders."""
    rows = t["orders"].groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("before"), F.count_if(F.col("o_orderstatus") == "O").alias("found")).collect()  # one row per year

    def tripped(found: int, before: int) -> bool:
        try:
            changes.check_guard(found, before)
        except changes.GuardTripped:
            return True
        return False

    return t.spark.createDataFrame([(r["year"], tripped(r["found"], r["before"])) for r in rows], "year int, tripped boolean")


@query("q_sheet_freshness", """
SELECT o_orderkey AS id, o_orderstatus <> 'P' AND o_orderkey % 2 = 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0) AS fresh FROM orders""")
def sheet_freshness(t):
    k, now = F.col("o_orderkey"), F.lit("2024-03-01 12:00:00").cast("timestamp_ntz")
    status = F.when(F.col("o_orderstatus") == "P", "error").when(F.col("o_orderstatus") == "F", "parsed").otherwise("empty")
    end = F.when(k % 3 == 0, F.lit("2024-02-10").cast("date")).otherwise(F.lit("2024-02-25").cast("date"))
    fetched = F.when(k % 5 == 0, F.lit("2024-03-01 11:30:00").cast("timestamp_ntz")).otherwise(F.lit("2024-03-01 10:30:00").cast("timestamp_ntz"))
    return t["orders"].select(k.alias("id"), scans.sheet_is_fresh(status, k % 2, F.lit(0), end, fetched, now).alias("fresh"))


@query("q_due_runs", "SELECT user_id, max(ts) FILTER (event_type = 'signup') IS NULL OR max(ts) FILTER (event_type = 'signup') + INTERVAL 2 DAY <= TIMESTAMP '2024-01-29 00:00:00' AS due FROM events GROUP BY user_id")
def due_runs(t):
    last = t["events"].groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("last"))
    return last.select("user_id", scans.is_due(F.col("last"), "2 days", F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")).alias("due"))


@query("q_pending_numbers", """
SELECT DISTINCT event_id AS n FROM events WHERE event_id < (SELECT max(event_id) - 30 FROM events) AND (event_id % 10 = 0 OR (event_type = 'error' AND ts < TIMESTAMP '2024-01-29 04:00:00'))""")
def pending_numbers(t):
    e = t["events"]
    known = e.select(F.col("event_id").alias("n"), F.when(F.col("event_id") % 10 == 0, F.lit("2024-01-25").cast("date")).otherwise(F.lit("2023-10-01").cast("date")).alias("start_date"))
    pending = e.select(F.col("event_id").alias("n"), F.when(F.col("event_type") == "error", "no_results").otherwise("results").alias("status"), F.col("ts").alias("first_seen_at"), F.col("ts").alias("last_checked_at"))
    return scans.numbers_to_recheck(known, pending, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"))


# ---------------------------------------------------------------- tables
@query("q_cache_upsert", """
WITH o AS (SELECT user_id, max(ts) AS fetched_at, arg_max(event_id, ts) AS payload FROM events WHERE event_id % 2 = 0 GROUP BY user_id),
n AS (SELECT user_id, max(ts) AS fetched_at, arg_max(event_id, ts) AS payload FROM events WHERE event_id % 2 = 1 AND user_id % 3 <> 0 GROUP BY user_id)
SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.fetched_at, o.fetched_at) AS fetched_at, coalesce(n.payload, o.payload) AS payload FROM o FULL JOIN n ON n.user_id = o.user_id""")
def cache_upsert(t):
    """A cache of some of the events, into which others are put; a third of the users only stand in the old one."""
    rows = t["events"].select("user_id", F.col("ts").alias("fetched_at"), F.col("event_id").alias("payload"))
    held = rows.where("payload % 2 = 0").groupBy("user_id").agg(F.max("fetched_at").alias("fetched_at"), F.max_by("payload", "fetched_at").alias("payload"))
    return tables.upsert(held, rows.where("payload % 2 = 1 AND user_id % 3 <> 0"), ["user_id"], "fetched_at")


@query("q_versions", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders")
def versions(t):
    table = tables.Snapshots(t.spark, new_folder(t.spark, "versions"), buckets=4)
    o = t["orders"].select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    table.commit(o)
    table.merge(o.where("id % 5 = 0").withColumn("status", F.lit("new")), ["id"])
    table.vacuum()
    return table.read()


@query("q_replay", "SELECT md5(html) AS page FROM pages")
def replay(t):
    path = new_folder(t.spark, "saved")
    # a file per page, but no folder per page: making, moving and listing folders is done one by one on the driver
    dealt = t["pages"].repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "page_id")
    dealt.select(F.col("html").alias("value")).write.option("lineSep", "\u0001").option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path)
    return pages.replay(t.spark, path).select(F.md5(F.rtrim("html", F.lit("\u0001")).cast("binary")).alias("page"))


@query("q_repointed", "SELECT l_orderkey - CASE WHEN l_orderkey % 4 = 1 THEN 1 ELSE 0 END AS event_id, count(*) AS n FROM lineitem GROUP BY 1")
def repointed(t):
    merged = t["orders"].where("o_orderkey % 4 = 1").select((F.col("o_orderkey") - 1).alias("keep"), F.col("o_orderkey").alias("drop"))
    moved = dedupe.repoint(t["lineitem"].select(F.col("l_orderkey").alias("event_id")), merged)
    return moved.groupBy("event_id").agg(F.count("*").alias("n"))


@query("q_repointed_unique", "SELECT o_orderkey AS event_id, o_custkey AS checked_by FROM orders WHERE o_orderkey % 4 <> 1")
def repointed_unique(t):
    o = t["orders"]
    merged = o.where("o_orderkey % 4 = 1").select((F.col("o_orderkey") - 1).alias("keep"), F.col("o_orderkey").alias("drop"))
    return dedupe.repoint_unique(o.select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("checked_by")), merged, ["checked_by"])


@query("q_token_filter", "SELECT p_partkey AS id FROM part WHERE contains(p_name, 'ring') OR contains(p_name, 'small')")
def token_filter(t):
    return t["part"].where(filters.any_token(F.col("p_name"), ["of", "ring", "small"])).select(F.col("p_partkey").alias("id"))
