"""Scalar functions over the driver's texts and names (X*, D*, L*, M*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, jsons, places, text
from ..views import Registry, view

query = Registry()

_NORM = "trim(regexp_replace(replace(lower(strip_accents({0})), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
_SECTIONS = "CASE {0} % 7 WHEN 0 THEN 'Novice Jack & Jill Prelims (Leaders)' WHEN 1 THEN 'Strictly Swing Finals' WHEN 2 THEN 'Pro-Am Routine' WHEN 3 THEN 'All-In Semifinals' WHEN 4 THEN 'Open Final Results' WHEN 5 THEN 'All Stars J&J Quarterfinals Followers' END"


def _section(c):
    names = ["Novice Jack & Jill Prelims (Leaders)", "Strictly Swing Finals", "Pro-Am Routine", "All-In Semifinals", "Open Final Results", "All Stars J&J Quarterfinals Followers"]
    out = None
    for i, n in enumerate(names):
        out = F.when(c % 7 == i, n) if out is None else out.when(c % 7 == i, n)
    return out


@query("q_decomposed", "SELECT doc_id, sha256(strip_accents(text)) AS plain_sha256 FROM documents")
def decomposed(t):
    """X1 for whole texts of any script."""
    return t["documents"].select("doc_id", F.sha2(text.strip_accents_exact(F.col("text")).cast("binary"), 256).alias("plain_sha256"))


@query("q_normalize_text", f"SELECT doc_id, md5({_NORM.format('text')}) AS norm FROM documents")
def normalize_text(t):
    return t["documents"].select("doc_id", F.md5(text.normalize_text(F.col("text")).cast("binary")).alias("norm"))


@query("q_event_name", f"""
SELECT p_partkey AS id, {_NORM.format("p_name")} AS norm FROM part""")
def event_name(t):
    p = t["part"]
    listed = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, " 2024 (HIATUS until 2026)").otherwise(" on hiatus 1999"))
    return p.select(F.col("p_partkey").alias("id"), text.normalize_event_name(listed).alias("norm"))


@query("q_alias_split", """
SELECT p_partkey AS id, p_name AS canonical, p_name || ' aka ' || p_brand || '|' || p_brand AS aliases FROM part""")
def alias_split(t):
    p = t["part"].withColumn("s", text.split_event_name(F.concat_ws(" aka ", "p_name", "p_brand")))
    return p.select(F.col("p_partkey").alias("id"), "s.canonical", F.array_join("s.aliases", "|").alias("aliases"))


@query("q_short_alias", "SELECT p_partkey AS id, length(replace(split_part(p_name, ' ', 1), ' ', '')) <= 4 AS short FROM part")
def short_alias(t):
    return t["part"].select(F.col("p_partkey").alias("id"), text.is_short_alias(text.normalize_text(F.substring_index("p_name", " ", 1))).alias("short"))


@query("q_competition_type", f"""
SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'jack_and_jill' WHEN 1 THEN 'strictly' WHEN 2 THEN 'routine' WHEN 3 THEN 'all_in' WHEN 4 THEN 'other' WHEN 5 THEN 'jack_and_jill' ELSE 'jack_and_jill' END AS kind, {_SECTIONS.format("o_orderkey")} IS NULL AS missing FROM orders""")
def competition_type(t):
    o = t["orders"].withColumn("section", _section(F.col("o_orderkey")))
    return o.select(F.col("o_orderkey").alias("id"), text.competition_type(F.col("section")).alias("kind"), F.col("section").isNull().alias("missing"))


@query("q_division_label", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'Given' ELSE CASE o_orderkey % 7 WHEN 0 THEN 'Novice' WHEN 1 THEN 'Strictly Swing' WHEN 2 THEN 'Pro Am Routine' WHEN 3 THEN 'All In' WHEN 4 THEN 'Open' WHEN 5 THEN 'All Stars' ELSE 'Jack & Jill' END END AS label FROM orders""")
def division_label(t):
    o = t["orders"]
    given = F.when(F.col("o_orderkey") % 5 == 0, "Given")
    return o.select(F.col("o_orderkey").alias("id"), text.division_label(given, _section(F.col("o_orderkey"))).alias("label"))


@query("q_describe_title", """
SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'leader' WHEN 5 THEN 'follower' END AS role, CASE o_orderkey % 7 WHEN 0 THEN 'prelims' WHEN 1 THEN 'finals' WHEN 3 THEN 'semis' WHEN 4 THEN 'finals' WHEN 5 THEN 'quarters' END AS round,
CASE o_orderkey % 7 WHEN 0 THEN 'Novice' WHEN 3 THEN 'All-In' WHEN 4 THEN 'Open' WHEN 5 THEN 'All Star' END AS division FROM orders""")
def describe_title(t):
    o = t["orders"].withColumn("d", text.describe_title(_section(F.col("o_orderkey"))))
    return o.select(F.col("o_orderkey").alias("id"), "d.role", "d.round", "d.division")


@query("q_couples", """
SELECT c_custkey AS id, c_name AS leader, c_mktsegment AS follower FROM customer""")
def couples(t):
    c = t["customer"].withColumn("s", text.split_couple(F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, " and ").otherwise(" & "), "c_mktsegment")))
    return c.select(F.col("c_custkey").alias("id"), "s.leader", "s.follower")


@query("q_country_map", """
SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'SWE' WHEN 1 THEN 'USA' WHEN 2 THEN 'FRA' END AS code FROM nation""")
def country_map(t):
    k = F.col("n_nationkey") % 4
    name = F.when(k == 0, "Sverige").when(k == 1, "U. S. A.").when(k == 2, "fra").otherwise(F.col("n_name"))
    return t["nation"].select(F.col("n_nationkey").alias("id"), places.country_code(name).alias("code"))


@query("q_location", """
SELECT s_suppkey AS id, s_name AS city, CASE WHEN s_suppkey % 3 = 0 THEN 'GA' END AS region, CASE s_suppkey % 3 WHEN 0 THEN 'USA' WHEN 1 THEN 'FRA' END AS country FROM supplier""")
def location(t):
    k = F.col("s_suppkey") % 3
    raw = F.concat("s_name", F.when(k == 0, ", GA USA").when(k == 1, ", France,  france , N/A").otherwise(", TBD"))
    s = t["supplier"].withColumn("l", places.parse_location(raw))
    return s.select(F.col("s_suppkey").alias("id"), "l.city", "l.region", F.col("l.country_code").alias("country"))


@query("q_date_ranges", """
SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS start_date, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) ELSE CAST(o_orderdate AS DATE) + 5 END AS end_date FROM orders""")
def date_ranges(t):
    d = F.to_date("o_orderdate")
    far = F.concat(F.date_format(d, "MMM d, yyyy"), F.lit(" - "), F.date_format(d + 5, "MMM d, yyyy"))
    o = t["orders"].withColumn("r", dates.parse_date_range(F.when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "MMMM d, yyyy")).otherwise(far)))
    return o.select(F.col("o_orderkey").alias("id"), F.col("r.start").alias("start_date"), F.col("r.end").alias("end_date"))


@query("q_months", "SELECT o_orderkey AS id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders")
def months(t):
    return t["orders"].select(F.col("o_orderkey").alias("id"), dates.parse_month(F.date_format("o_orderdate", "MMMM yyyy")).alias("month"))


@query("q_dates_compatible", """
WITH e AS (SELECT *, start_date + 6 AS other FROM events_view)
SELECT id, CASE WHEN date_precision = 'year' THEN year(start_date) = year(other) WHEN date_precision = 'month' THEN date_trunc('month', start_date) = date_trunc('month', other) OR date_trunc('month', end_date) = date_trunc('month', other) ELSE TRUE END AS fits FROM e""")
def dates_compatible(t):
    e = view(t, "events_view").withColumn("other", F.date_add("start_date", 6))
    return e.select("id", dates.dates_compatible(F.col("start_date"), F.col("end_date"), F.col("date_precision"), F.col("other"), F.col("other"), F.lit("day")).alias("fits"))


@query("q_json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(t):
    return t["events"].select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("q_changed_fields", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'status' ELSE '' END AS fields FROM orders""")
def changed_fields(t):
    new = F.when(F.col("o_orderkey") % 2 == 0, "X").otherwise(F.col("o_orderstatus"))
    changed = jsons.changed_fields({"status": F.col("o_orderstatus"), "key": F.col("o_custkey")}, {"status": new, "key": F.col("o_custkey")})
    return t["orders"].select(F.col("o_orderkey").alias("id"), F.array_join(F.map_keys(changed), ",").alias("fields"))


@query("q_decimals", "SELECT l_orderkey AS id, l_linenumber AS line, l_quantity AS q, count(*) AS n FROM lineitem GROUP BY ALL")
def decimals(t):
    q = text.decimal(F.replace(F.col("l_quantity").cast("string"), F.lit("."), F.lit(",")), F.lit("scoring_dance"))
    return t["lineitem"].select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), q.alias("q")).groupBy("id", "line", "q").agg(F.count("*").alias("n"))
