"""Change capture, upserts, polling rules, pages and streams (U*, ST*, SRC14-15, W6-W11)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import provider_of
from ..operators import changes, increments, matching, scans
from ..session import written
from ..sinks import snapshots, tables
from ..sources import pages as pg
from ..sources import registry as rg
from ..sources.html import lateral
from ..streaming import ingest
from ..views import Registry, view

query = Registry()
_TRACKED = ["name", "start_date", "status"]
_NEW = "SELECT o_orderkey AS id, 'n' || CAST(o_custkey AS STRING) AS name, CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_orderdate AS DATE) + 1 ELSE CAST(o_orderdate AS DATE) END AS start_date, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END AS status FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'"
_OLD = "SELECT o_orderkey AS id, 'n' || CAST(o_custkey AS STRING) AS name, CAST(o_orderdate AS DATE) AS start_date, o_orderstatus AS status, o_orderkey % 7 <> 2 AS active FROM orders WHERE o_orderdate < TIMESTAMP '2000-06-01'"


def _old_new(t):
    o, k = t["orders"], F.col("o_orderkey")
    name, d = F.concat(F.lit("n"), F.col("o_custkey").cast("string")).alias("name"), F.to_date("o_orderdate")
    new = o.where(F.col("o_orderdate") >= "1996-01-01").select(k.alias("id"), name, F.when(k % 6 == 0, F.date_add(d, 1)).otherwise(d).alias("start_date"), F.when(k % 9 != 0, F.col("o_orderstatus")).alias("status"))
    old = o.where(F.col("o_orderdate") < "2000-06-01").select(k.alias("id"), name, d.alias("start_date"), F.col("o_orderstatus").alias("status"), (k % 7 != 2).alias("active"))
    return old, new


@query("q_change_capture", f"""
WITH n AS ({_NEW}), o AS ({_OLD})
SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN 'unseen' WHEN o.id IS NULL THEN 'added' WHEN n.start_date <> o.start_date OR n.status IS DISTINCT FROM o.status THEN 'updated' WHEN NOT active THEN 'reactivated' ELSE 'unchanged' END AS action
FROM n FULL JOIN o ON n.id = o.id""")
def change_capture(t):
    old, new = _old_new(t)
    return changes.classify(new, old, _TRACKED).select("id", "action")


@query("q_change_fields", f"""
WITH n AS ({_NEW}), o AS ({_OLD})
SELECT n.id, CASE WHEN n.start_date <> o.start_date THEN CAST(o.start_date AS STRING) || '>' || CAST(n.start_date AS STRING) END AS start_change, n.status IS DISTINCT FROM o.status AS status_changed FROM n JOIN o ON n.id = o.id""")
def change_fields(t):
    old, new = _old_new(t)
    c = changes.classify(new, old, _TRACKED).where("action <> 'added' AND action <> 'unseen'")
    s = F.col("changed")["start_date"]
    return c.select("id", F.when(s.isNotNull(), F.concat_ws(">", s["from"], s["to"])).alias("start_change"), F.map_contains_key("changed", F.lit("status")).alias("status_changed"))


@query("q_change_counts", f"""
WITH n AS ({_NEW}), o AS ({_OLD}), c AS (SELECT CASE WHEN n.id IS NULL THEN 'unseen' WHEN o.id IS NULL THEN 'added' WHEN n.start_date <> o.start_date OR n.status IS DISTINCT FROM o.status THEN 'updated' WHEN NOT active THEN 'reactivated' ELSE 'unchanged' END AS a FROM n FULL JOIN o ON n.id = o.id)
SELECT count(*) FILTER (a = 'added') AS added, count(*) FILTER (a = 'updated') AS updated, count(*) FILTER (a = 'reactivated') AS reactivated, count(*) FILTER (a = 'unchanged') AS unchanged, count(*) FILTER (a = 'unseen') AS unseen FROM c""")
def change_counts(t):
    old, new = _old_new(t)
    return changes.counters(changes.classify(new, old, _TRACKED))


@query("q_deactivate", f"""
WITH n AS ({_NEW}), o AS ({_OLD}) SELECT id, CASE WHEN start_date < DATE '1999-01-01' THEN 'past' ELSE 'missing_from_source' END AS lifecycle_status FROM o WHERE id NOT IN (SELECT id FROM n) AND active""")
def deactivate(t):
    old, new = _old_new(t)
    gone = old.join(new.select("id"), "id", "left_anti").withColumn("end_date", F.col("start_date"))
    return changes.deactivated(gone, F.lit("1999-01-01").cast("date")).where("was_active").select("id", "lifecycle_status")


@query("q_in_source_dups", """
SELECT series_id, start_date, min(id) AS kept, count(*) - 1 AS skipped FROM events_view GROUP BY 1, 2, end_date, country HAVING count(*) > 1""")
def in_source_dups(t):
    e = view(t, "events_view").withColumn("row_index", F.col("id"))
    kept, skipped = changes.without_repeats(e)
    key = ["series_id", "start_date", "end_date", "country"]
    n = skipped.groupBy(*key).agg(F.count("*").alias("skipped"))
    return kept.select(*key, F.col("id").alias("kept")).join(n, key).select("series_id", "start_date", "kept", "skipped")


@query("q_upsert", f"""
WITH n AS ({_NEW}), o AS ({_OLD}) SELECT coalesce(n.id, o.id) AS id, coalesce(n.start_date, o.start_date) AS start_date, coalesce(n.status, o.status) AS status FROM n FULL JOIN o ON n.id = o.id""")
def upsert(t):
    old, new = _old_new(t)
    return tables.upsert(old.drop("active"), new, ["id"], keep_if_null=("status",)).select("id", "start_date", "status")


@query("q_insert_ignore", f"WITH n AS ({_NEW}), o AS ({_OLD}) SELECT id, start_date FROM o UNION ALL SELECT id, start_date FROM n WHERE id NOT IN (SELECT id FROM o)")
def insert_ignore(t):
    old, new = _old_new(t)
    return tables.insert_ignore(old.select("id", "start_date"), new.select("id", "start_date"), ["id"], ["start_date"])


@query("q_replace_sheets", "SELECT o_orderkey AS sheet_url, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE 'old' END AS v, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL")
def replace_sheets(t):
    e = t["lineitem"].select(F.col("l_orderkey").alias("sheet_url"), F.lit("old").alias("v"))
    read = t["orders"].where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("sheet_url"))
    out = tables.replace_sheets(e, e.join(read, "sheet_url", "left_semi").withColumn("v", F.lit("new")))
    return out.groupBy("sheet_url", "v").agg(F.count("*").alias("n"))


@query("q_scd2", """
SELECT series_id, id, start_date, lead(start_date) OVER (PARTITION BY series_id ORDER BY start_date, id) AS valid_to, lag(id) OVER (PARTITION BY series_id ORDER BY start_date, id) AS previous FROM events_view""")
def scd2(t):
    w = W.partitionBy("series_id").orderBy("start_date", "id")
    return view(t, "events_view").select("series_id", "id", "start_date", F.lead("start_date").over(w).alias("valid_to"), F.lag("id").over(w).alias("previous"))


_DAYS = ["2024-01-01 12:00:00", "2024-01-05 00:00:00", "2024-01-10 06:30:00", "2024-01-20 00:00:00", "2024-02-10 00:00:00"]


@query("q_as_of", f"""
WITH d AS (SELECT unnest([{", ".join(f"TIMESTAMP '{x}'" for x in _DAYS)}]) AS as_of)
SELECT as_of, user_id AS id, arg_max(event_type, (ts, event_id)) AS kind, CAST(arg_max(CAST(floor(value) AS BIGINT), (ts, event_id)) AS BIGINT) AS points, arg_max(coalesce(props, 'none'), (ts, event_id)) AS props
FROM d JOIN events ON ts <= as_of GROUP BY ALL""")
def as_of(t):
    """A user's events are the changes of one record; its history keeps what each of them replaced."""
    fields = ["kind", "points", "props"]
    rows = t["events"].select(F.col("user_id").alias("id"), "ts", "event_id", F.col("event_type").alias("kind"), F.floor("value").cast("long").alias("points"), F.coalesce("props", F.lit("none")).alias("props"))
    w = W.partitionBy("id").orderBy("ts", "event_id")
    old = {c: F.lag(F.col(c).cast("string")).over(w) for c in fields}
    changed = F.array_compact(F.array(*(F.when(~old[c].eqNullSafe(F.col(c).cast("string")), F.struct(F.lit(c).alias("key"), old[c].alias("value"))) for c in fields)))
    first = F.row_number().over(w) == 1
    history = rows.select(F.col("id").alias("event_id"), F.col("ts").alias("observed_at"), F.col("event_id").alias("sync_run_id"), F.when(~first, F.map_from_entries(changed)).alias("previous_values"))
    current = rows.groupBy("id").agg(*(F.max_by(c, F.struct("ts", "event_id")).alias(c) for c in fields))
    return changes.as_of(current, history, _DAYS, fields)


@query("q_kept_up_to_date", """
SELECT l_suppkey, l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_points, min(CAST(l_quantity AS BIGINT)) AS least_points, max(CAST(l_quantity AS BIGINT)) AS most_points
FROM lineitem WHERE NOT (l_orderkey % 10 < 9 AND (l_quantity > 48 OR l_linenumber = 1)) GROUP BY ALL""")
def kept_up_to_date(t):
    """Marks come in ten batches; each batch also takes back some of the one before, among them the largest."""
    k, keys = F.col("l_orderkey") % 10, ["l_suppkey", "l_returnflag"]
    back = (F.col("l_quantity") > 48) | (F.col("l_linenumber") == 1)
    marks = t["lineitem"].select(*keys, F.col("l_quantity").cast("long").alias("points"), k.alias("batch"), back.alias("back"))
    state = increments.summary(marks.where("false"), keys, ["points"])
    for b in range(10):
        come, go = marks.where(F.col("batch") == b), marks.where((F.col("batch") == b - 1) & F.col("back"))
        changes_ = come.withColumn("weight", F.lit(1)).unionByName(go.withColumn("weight", F.lit(-1)))
        there = marks.where((F.col("batch") == b) | ((F.col("batch") < b) & ~F.col("back")))
        state = written(increments.merged(state, changes_, there, keys, ["points"]), "summary")
    return state


@query("q_confirmed", """
SELECT id, CASE WHEN lifecycle_status = 'listed' THEN 'confirmed' ELSE 'unconfirmed' END AS confirmation_status FROM events_view""")
def confirmed(t):
    e = view(t, "events_view").select("id", F.col("id").cast("string").alias("normalized_name"), "start_date", F.when(F.col("id") % 2 == 0, F.col("country")).alias("country"), "lifecycle_status")
    return matching.confirmed(e, e.where("lifecycle_status = 'listed'")).select("id", "confirmation_status")


@query("q_latest_run", """
SELECT source, max(id) AS id FROM events_view GROUP BY source""")
def latest_run(t):
    from ..plans.service import health

    runs = view(t, "events_view").select("source", "id", F.lit("success").alias("status"), F.col("start_date").alias("started_at"), F.col("end_date").alias("finished_at"))
    return health(runs).select("source", "id")


@query("q_freshness", """
SELECT user_id, max(ts) AS last_ts, coalesce(TIMESTAMP '2024-01-30 00:00:00' - max(ts) < INTERVAL 24 HOUR, FALSE) AS fresh FROM events GROUP BY user_id""")
def freshness(t):
    last = t["events"].groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    now = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    return last.select("user_id", "last_ts", scans.index_is_fresh(F.col("last_ts"), now).alias("fresh"))


@query("q_recheck_due", """
SELECT id, start_date FROM events_view e LEFT JOIN (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 3 DAY AS checked_at FROM orders WHERE o_orderstatus <> 'P') w ON w.o_orderkey = e.id
WHERE start_date <= DATE '1998-01-01' AND (checked_at IS NULL OR checked_at < CASE WHEN end_date >= DATE '1997-12-11' THEN TIMESTAMP '1998-01-01' - INTERVAL 20 HOUR ELSE TIMESTAMP '1998-01-01' - INTERVAL 7 DAY END)
ORDER BY start_date DESC, id LIMIT 25""")
def recheck_due(t):
    e = view(t, "events_view").withColumns({"website_url": F.lit("https://a.example"), "merged_into": F.lit(None).cast("long")})
    checks = t["orders"].where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("event_id"), (F.col("o_orderdate") + F.expr("INTERVAL 3 DAYS")).alias("checked_at"))
    return scans.websites_due(e, checks, F.lit("1998-01-01").cast("timestamp_ntz")).select("id", "start_date")


@query("q_scan_gaps", """
WITH h AS (SELECT DISTINCT event_id AS n FROM events WHERE event_type = 'signup' AND event_id >= 100), g AS (SELECT n, lead(n) OVER (ORDER BY n) - n - 1 AS gap FROM h)
SELECT count(*) AS visited, max(event_id) AS last FROM events WHERE event_id >= 100 AND event_id <= (SELECT CASE WHEN min(n) - 100 >= 40 THEN 139 ELSE min(CASE WHEN gap >= 40 OR gap IS NULL THEN n END) + 40 END FROM g)""")
def scan_gaps(t):
    probes = t["events"].select(F.col("event_id").alias("n"), (F.col("event_type") == "signup").alias("hit"))
    return scans.walk(probes, 100).agg(F.count("*").alias("visited"), F.max("n").alias("last"))


@query("q_known_numbers", """
SELECT DISTINCT event_id AS n FROM events WHERE event_type = 'signup' AND event_id < (SELECT max(event_id) - 30 FROM events)""")
def known_numbers(t):
    e = t["events"]
    known = e.select(F.col("event_id").alias("n"), F.when(F.col("event_type") == "signup", F.lit("2024-01-25").cast("date")).alias("start_date"))
    pending = e.select(F.col("event_id").alias("n"), F.col("event_type").alias("status"), F.col("ts").alias("first_seen_at"), F.col("ts").alias("last_checked_at"))
    return scans.numbers_to_recheck(known, pending, F.lit("2024-01-30").cast("timestamp_ntz"))


@query("q_retention", "SELECT run_id FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS run_id FROM orders) ORDER BY run_id DESC LIMIT 14")
def retention(t):
    return snapshots.retained(t["orders"].select(F.to_date("o_orderdate").alias("run_id")))


@query("q_html_links", r"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages) SELECT page_id, count(*) AS n, count(DISTINCT href) AS different FROM a WHERE NOT starts_with(href, '#') AND NOT starts_with(href, 'mailto:') AND NOT starts_with(href, 'tel:') AND NOT starts_with(href, 'javascript:') GROUP BY 1""")
def html_links(t):
    links = lateral(t["pages"], "html_links", "html", "url", keep=["page_id"])
    return links.groupBy("page_id").agg(F.count("*").alias("n"), F.count_distinct("href").alias("different"))


@query("q_url_parts", r"""
SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\.', '') AS host, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages""")
def url_parts(t):
    return t["pages"].select("page_id", pg.host(F.col("url")).alias("host"), F.try_parse_url("url", F.lit("QUERY"), F.lit("page")).alias("page"))


@query("q_provider_links", """
SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'eepro' WHEN 1 THEN 'scoring_dance' END AS provider, CASE p_partkey % 3 WHEN 0 THEN 'e' || p_partkey WHEN 1 THEN CAST(p_partkey AS STRING) END AS key FROM part""")
def provider_links(t):
    k = F.col("p_partkey")
    s = k.cast("string")
    url = F.when(k % 3 == 0, F.concat(F.lit("https://eepro.com/results/e"), s, F.lit("/x.html"))).when(k % 3 == 1, F.concat(F.lit("https://scoring.dance/frFR/events/"), s, F.lit("/results/"))).otherwise("https://a.example/")
    return t["part"].select(k.alias("id"), provider_of(url).alias("p")).select("id", "p.provider", "p.key")


@query("q_registry_flatten", """
SELECT CAST(user_id AS VARCHAR) AS query, 'Leader' AS role, 'Style' AS style, event_type AS division, upper(event_type) AS division_abbr, strftime(ts, '%Y-%m') AS month, count(*) AS n, CAST(sum(CAST(floor(value) AS INT) % 16) AS BIGINT) AS points FROM events GROUP BY ALL""")
def registry_flatten(t):
    """Registry records built from the events table: one per user, one competition per event."""
    e = t["events"].withColumn("month", F.date_format("ts", "MMMM yyyy"))
    one = F.struct(F.lit("Leader").alias("role"), (F.floor("value").cast("int") % 16).alias("points"), F.lit("F").alias("result"), F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("name"), F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("url"), F.col("month").alias("date")).alias("event"))
    per = e.groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list(one)).alias("competitions"))
    div = F.struct(F.struct(F.col("event_type").alias("name"), F.upper("event_type").alias("abbreviation")).alias("division"), "competitions")
    maps = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("event_type").alias("k"), div.alias("v")))).alias("m"))
    raw = maps.select(F.col("user_id").cast("string").alias("query"), F.to_json(F.struct(F.col("user_id").alias("dancer_wsdcid"), F.struct(F.create_map(F.lit("Style"), "m").alias("placements")).alias("leader"), F.struct(F.array().cast("array<int>").alias("placements")).alias("follower"))).alias("payload"))
    return rg.placements(rg.responses(raw)).groupBy("query", "role", "style", "division", "division_abbr", "month").agg(F.count("*").alias("n"), F.sum("points").alias("points"))


@query("ext_daily", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_daily(t):
    return ingest.daily(t["events"]).select("day", "event_type", "n", F.round("total", 4).alias("total"))


@query("ext_session", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS "begin", max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def ext_session(t):
    return ingest.sessions(t["events"])


@query("ext_cube_points", "SELECT division, role, CAST(sum(points) AS BIGINT) AS points FROM awards_view GROUP BY CUBE (division, role)")
def ext_cube_points(t):
    return view(t, "awards_view").cube("division", "role").agg(F.sum("points").alias("points"))
