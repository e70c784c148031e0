"""Marks, rounds, summaries, points, judges' figures (C8, C10, A*)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import marks as mk
from ..functions.numbers import half_even_div
from ..functions.text import result_label
from ..operators import judges as jd
from ..plans import dancer, service
from ..session import dealt
from ..views import Registry, view

query = Registry()


def _div(a: str, b: str) -> str:
    """Half-even integer division in SQL."""
    a, b = f"CAST({a} AS BIGINT)", f"CAST({b} AS BIGINT)"
    return f"CASE WHEN {b} > 0 THEN {a} // {b} + CASE WHEN 2 * ({a} % {b}) > {b} OR (2 * ({a} % {b}) = {b} AND ({a} // {b}) % 2 = 1) THEN 1 ELSE 0 END END"


_TENTHS = "CASE mark WHEN 'Y' THEN 100 WHEN 'A1' THEN 45 WHEN 'A2' THEN 43 WHEN 'A3' THEN 42 WHEN 'N' THEN 0 END"
_ROUNDS = f"""
m AS (SELECT *, {_TENTHS} AS t FROM marks_view),
r AS (SELECT competitor, year, role, event_key, round, count(t) AS n, sum(t) AS points, count(*) FILTER (mark = 'Y') AS yes, count(*) FILTER (mark LIKE 'A%') AS alt,
             count(*) FILTER (mark = 'N') AS no, bool_or(advanced) AS advanced, max(start_date) AS start_date FROM m WHERE round <> 'finals' GROUP BY ALL),
p AS (SELECT *, {_div("points * 10", "n")} AS pct FROM r),
f AS (SELECT competitor, year, role, event_key, min(place) AS place FROM m WHERE round = 'finals' GROUP BY ALL)"""
_KEY = ["competitor", "year", "role", "event_key", "round"]


def _rounds(t):
    """Callback rounds of the view, straight from its exploded marks."""
    m = view(t, "marks_view")
    agg = m.where("round <> 'finals'").groupBy(*_KEY).agg(*mk.callback_aggregates(F.col("mark")), F.bool_or("advanced").alias("advanced"), F.max("start_date").alias("start_date"))
    return agg.withColumn("pct_tenths", mk.callback_tenths(F.col("points_tenths"), F.col("judges_marking")))


def _finals(t):
    return view(t, "marks_view").where("round = 'finals'").groupBy("competitor", "year", "role", "event_key").agg(F.min("place").alias("place"))


@query("q_callback_summary", f"""
WITH {_ROUNDS},
a AS (SELECT competitor, year, role, count(*) AS callback_rounds, ({_div("sum(pct)", "count(*)")}) / 10 AS avg_callback_pct, CAST(sum(yes) AS BIGINT) AS yes, CAST(sum(alt) AS BIGINT) AS alt, CAST(sum(no) AS BIGINT) AS no FROM p GROUP BY ALL),
b AS (SELECT competitor, year, role, min(place) AS best_place FROM f GROUP BY ALL)
SELECT competitor, year, role, callback_rounds, avg_callback_pct, yes, alt, no, best_place FROM a LEFT JOIN b USING (competitor, year, role)""")
def callback_summary(t):
    """The flagship: one pass over the marks; rounds and finals come out of the same two aggregations."""
    owner, final = ["competitor", "year", "role"], F.col("round") == "finals"
    m = view(t, "marks_view").groupBy(*_KEY).agg(*mk.callback_aggregates(F.col("mark")), F.min(F.when(final, F.col("place"))).alias("place"))
    m = m.withColumn("pct", F.when(~final, mk.callback_tenths(F.col("points_tenths"), F.col("judges_marking"))))
    kinds = [F.sum(F.when(~final, F.col(c))).alias(c) for c in ("yes", "alt", "no")]
    out = m.groupBy(*owner).agg(F.count_if(~final).alias("callback_rounds"), F.sum("pct").alias("p"), *kinds, F.min("place").alias("best_place")).where("callback_rounds > 0")
    return out.select(*owner, "callback_rounds", (half_even_div(F.col("p"), F.col("callback_rounds")) / 10).alias("avg_callback_pct"), "yes", "alt", "no", "best_place")


@query("q_callback_rounds", f"""
WITH {_ROUNDS} SELECT competitor, event_key, role, round, n AS judges_marking, points / 10 AS callback_points, pct / 10 AS callback_pct, yes, alt, no FROM p""")
def callback_rounds(t):
    return _rounds(t).select("competitor", "event_key", "role", "round", "judges_marking", (F.col("points_tenths") / 10).alias("callback_points"), (F.col("pct_tenths") / 10).alias("callback_pct"), "yes", "alt", "no")


@query("q_mark_details", f"""
SELECT event_key, line, judge, CASE WHEN round = 'finals' THEN NULL ELSE CASE mark WHEN 'Y' THEN 'Yes' WHEN 'N' THEN 'No' ELSE 'Alt ' || mark[2:2] END END AS label,
CASE WHEN round = 'finals' THEN NULL WHEN mark = 'Y' THEN 'yes' WHEN mark = 'N' THEN 'no' ELSE 'alt' END AS kind, CASE WHEN round <> 'finals' THEN ({_TENTHS}) / 10 END AS points FROM marks_view""")
def mark_details(t):
    m = view(t, "marks_view").withColumn("d", F.explode(mk.mark_details(F.col("round"), F.create_map("judge", "mark"))))
    return m.select("event_key", "line", "d.judge", "d.label", "d.kind", "d.points")


@query("q_divisions", """
WITH m AS (SELECT *, CASE round WHEN 'prelims' THEN 0 WHEN 'quarters' THEN 1 WHEN 'semis' THEN 2 ELSE 3 END AS o FROM marks_view),
r AS (SELECT competitor, event_key, role, round, o, min(CASE WHEN round = 'finals' THEN place END) AS place FROM m GROUP BY ALL)
SELECT competitor, event_key, role, string_agg(round, '>' ORDER BY o) AS rounds, arg_max(round, o) AS furthest_round, min(place) AS final_place FROM r GROUP BY ALL""")
def divisions(t):
    m = view(t, "marks_view").groupBy("competitor", "event_key", "role", "round").agg(F.min(F.when(F.col("round") == "finals", F.col("place"))).alias("place"))
    null = F.lit(None).cast("string")
    e = m.select("*", F.lit("Novice").alias("division"), null.alias("section"), mk.round_order(F.col("round")).alias("seq"), *(null.alias(c) for c in ("bib", "partner_name", "alternate", "sheet_url")), *(F.lit(None).cast("int").alias(c) for c in ("rank", "competed")), F.lit(None).cast("double").alias("score"), F.lit(None).cast("boolean").alias("advanced"))
    d = dancer.divisions(e, ["competitor", "event_key"])
    return d.select("competitor", "event_key", "role", F.array_join(F.transform("rounds", lambda r: r["round"]), ">").alias("rounds"), "furthest_round", "final_place")


@query("q_progress_callbacks", f"""
WITH {_ROUNDS} SELECT competitor, event_key, role, round, pct / 10 AS callback_pct, row_number() OVER (PARTITION BY competitor ORDER BY start_date, event_key, role,
CASE round WHEN 'prelims' THEN 0 WHEN 'quarters' THEN 1 ELSE 2 END) AS n FROM p""")
def progress_callbacks(t):
    p = dancer.progress(_rounds(t), ["start_date", "event_key", "role", mk.round_order(F.col("round"))])
    return p.select("competitor", "event_key", "role", "round", (F.col("pct_tenths") / 10).alias("callback_pct"), F.col("n").cast("long").alias("n"))


@query("q_finals_merge", """
WITH s AS (SELECT event_key AS event_id, role, min(place) AS place FROM marks_view WHERE round = 'finals' GROUP BY ALL),
g AS (SELECT event_key AS event_id, role, points FROM awards_view)
SELECT event_id, role, place, g.points, CASE WHEN g.event_id IS NULL THEN 'scoresheets' ELSE 'scoresheets+registry' END AS source FROM s LEFT JOIN g USING (event_id, role)
UNION ALL SELECT event_id, role, CAST(CASE WHEN points > 0 THEN points END AS INT), points, 'registry' FROM g WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.event_id = g.event_id AND s.role = g.role)""")
def finals_merge(t):
    s = view(t, "marks_view").where("round = 'finals'").groupBy(F.col("event_key").alias("event_id"), "role").agg(F.min("place").alias("place")).withColumns({"division": F.lit("Novice"), "seq": F.lit(0), "round": F.lit("finals")})
    g = view(t, "awards_view").select(F.col("event_key").alias("event_id"), "role", F.lit("novice").alias("division"), "points", F.when(F.col("points") > 0, F.col("points").cast("string")).otherwise("F").alias("result"), F.col("event_key").alias("seq"))
    return dancer.finals(s, g).select("event_id", "role", "place", "points", "source")


@query("q_judge_breakdown", f"""
WITH m AS (SELECT *, CASE WHEN round <> 'finals' THEN {_TENTHS} END AS t, CASE WHEN round = 'finals' THEN place END AS p FROM marks_view)
SELECT judge, count(DISTINCT event_key) AS events_judged, count(t) AS callback_marks, count(*) FILTER (t = 100) AS yes, count(*) FILTER (t BETWEEN 1 AND 99) AS alt, count(*) FILTER (t = 0) AS no,
({_div("count(*) FILTER (t = 100) * 1000", "count(t)")}) / 10 AS yes_rate, ({_div("sum(t) * 10", "count(t)")}) / 100 AS avg_points, count(p) AS finals_judged, ({_div("sum(p) * 100", "count(p)")}) / 100 AS avg_finals_placement
FROM m GROUP BY judge""")
def judge_breakdown(t):
    m = view(t, "marks_view").withColumn("mark", F.when(F.col("round") == "finals", F.col("place").cast("string")).otherwise(F.col("mark")))
    aliases = t["supplier"].select(F.lower("s_name").alias("alias_norm"), F.lower("s_name").alias("judge_key"), F.col("s_name").alias("judge_name"), F.lit("exact").alias("method"))
    from ..functions.text import normalize_text

    aliases = aliases.withColumns({"alias_norm": normalize_text(F.col("alias_norm")), "judge_key": normalize_text(F.col("judge_key"))})
    b = dancer.judge_breakdown(m, aliases, [])
    return b.select("judge", "events_judged", "callback_marks", "yes", "alt", "no", "yes_rate", "avg_points", "finals_judged", "avg_finals_placement")


_SUMMARY = """
SELECT {cols}, coalesce(events_competed, 0) AS events_competed, coalesce(finals_made, 0) AS finals_made, coalesce(callback_rounds, 0) AS callback_rounds, coalesce(callback_rounds_advanced, 0) AS callback_rounds_advanced, best_final_place, advancement_rate, avg_callback_pct
FROM (SELECT {cols}, count(DISTINCT event_key) AS events_competed, count(pct) AS callback_rounds, count(*) FILTER (pct IS NOT NULL AND advanced) AS callback_rounds_advanced, ({rate}) / 10 AS advancement_rate, ({avg}) / 10 AS avg_callback_pct
      FROM (SELECT competitor, role, event_key, advanced, pct FROM p UNION ALL SELECT competitor, role, event_key, NULL, NULL FROM f) GROUP BY {cols})
FULL JOIN (SELECT {cols}, count(*) AS finals_made, min(place) AS best_final_place FROM f GROUP BY {cols}) USING ({cols})"""
_RATE = {"rate": _div("count(*) FILTER (pct IS NOT NULL AND advanced) * 1000", "count(*) FILTER (pct IS NOT NULL AND advanced IS NOT NULL)"), "avg": _div("sum(pct)", "count(pct)")}


def _summary(t, owner):
    r, f = _rounds(t), _finals(t).withColumn("points", F.lit(None).cast("long"))
    both = r.select("competitor", "role", "event_key", "advanced", "pct_tenths").unionByName(f.select("competitor", "role", "event_key", F.lit(None).cast("boolean").alias("advanced"), F.lit(None).cast("long").alias("pct_tenths")))
    return dancer.summary(both, f, owner).select(*owner, "events_competed", "finals_made", "callback_rounds", "callback_rounds_advanced", "best_final_place", "advancement_rate", "avg_callback_pct")


@query("q_summary", f"WITH {_ROUNDS} " + _SUMMARY.format(cols="competitor", **_RATE))
def summary(t):
    return _summary(t, ["competitor"])


@query("q_summary_by_role", f"WITH {_ROUNDS} " + _SUMMARY.format(cols="competitor, role", **_RATE))
def summary_by_role(t):
    return _summary(t, ["competitor", "role"])


@query("q_points_total", """
SELECT competitor, division, role, CAST(sum(points) AS BIGINT) AS points, count(*) AS results FROM awards_view GROUP BY GROUPING SETS ((competitor, division, role), (competitor))""")
def points_total(t):
    return dancer.points_total(view(t, "awards_view"), ["competitor"]).drop("total")


@query("q_points_by_division", "SELECT division, role, CAST(sum(points) AS BIGINT) AS points, count(*) AS results FROM awards_view GROUP BY ALL ORDER BY points DESC, division, role")
def points_by_division(t):
    return dancer.by_points(dancer.points_total(view(t, "awards_view"), [])).drop("total")


@query("q_roles_primary", """
WITH c AS (SELECT competitor, role, count(*) AS n FROM (SELECT DISTINCT competitor, role, event_key, round FROM marks_view) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY competitor ORDER BY n DESC, role) AS k FROM c)
SELECT competitor, max(role) FILTER (k = 1) AS primary_role, max(role) FILTER (k = 2) AS secondary_role, string_agg(role, ',' ORDER BY role) AS competed_roles FROM k GROUP BY competitor""")
def roles_primary(t):
    rounds = view(t, "marks_view").select("competitor", "role", "event_key", "round").distinct()
    none = rounds.select("competitor", "role", F.lit(0).alias("points")).limit(0)
    r = dancer.roles(rounds, none, ["competitor"])
    return r.select("competitor", "primary_role", "secondary_role", F.array_join("competed_roles", ",").alias("competed_roles"))


@query("q_roles_points", """
WITH c AS (SELECT competitor, role, count(*) AS n FROM (SELECT DISTINCT competitor, role, event_key, round FROM marks_view) GROUP BY ALL),
w AS (SELECT competitor, role, CAST(sum(points) AS BIGINT) AS points FROM awards_view GROUP BY ALL),
k AS (SELECT coalesce(c.competitor, w.competitor) AS competitor, coalesce(c.role, w.role) AS role, coalesce(points, 0) AS points, row_number() OVER (PARTITION BY coalesce(c.competitor, w.competitor) ORDER BY coalesce(n, 0) DESC, coalesce(c.role, w.role)) AS k
      FROM c FULL JOIN w ON w.competitor = c.competitor AND w.role = c.role)
SELECT competitor, max(role) FILTER (k = 1) AS primary_role, max(points) FILTER (k = 1) AS primary_points, max(role) FILTER (k = 2) AS secondary_role, max(points) FILTER (k = 2) AS secondary_points, string_agg(role, ',' ORDER BY role) AS competed_roles FROM k GROUP BY competitor""")
def roles_points(t):
    """Roles with the registry's points: of people who only danced, who only won points, and both."""
    rounds = view(t, "marks_view").select("competitor", "role", "event_key", "round").distinct()
    r = dancer.roles(rounds, view(t, "awards_view").select("competitor", "role", "points"), ["competitor"])
    return r.select("competitor", "primary_role", F.col("primary_points").cast("long").alias("primary_points"), "secondary_role", F.col("secondary_points").cast("long").alias("secondary_points"), F.array_join("competed_roles", ",").alias("competed_roles"))


@query("q_result_label", """
SELECT l_orderkey, l_partkey, CASE WHEN n % 100 BETWEEN 10 AND 20 THEN n || 'th' WHEN n % 10 = 1 THEN n || 'st' WHEN n % 10 = 2 THEN n || 'nd' WHEN n % 10 = 3 THEN n || 'rd' ELSE n || 'th' END AS label, count(*) AS c
FROM (SELECT l_orderkey, l_partkey, l_partkey % 130 AS n FROM lineitem) GROUP BY ALL""")
def q_result_label(t):
    return t["lineitem"].select("l_orderkey", "l_partkey", result_label(F.col("l_partkey") % 130).alias("label")).groupBy("l_orderkey", "l_partkey", "label").agg(F.count("*").alias("c"))


@query("q_panel_pairs", """
WITH s AS (SELECT DISTINCT l_orderkey, lower(s_name) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
n AS (SELECT l_orderkey, regexp_replace(n, '[^a-z0-9]+', ' ', 'g') AS n FROM s)
SELECT DISTINCT x.n AS a, y.n AS b FROM n x JOIN n y ON x.l_orderkey = y.l_orderkey AND x.n < y.n""")
def panel_pairs(t):
    return jd.together(jd.panels(_panel(t)))


def _panel(t):
    lines = t["lineitem"]
    l = dealt(lines, lines.count(), "l_orderkey").join(t["supplier"], F.col("s_suppkey") == F.col("l_suppkey"))  # noqa: E741
    return l.select(F.col("l_orderkey").alias("sheet_url"), F.lit("all").alias("section"), F.col("s_name").alias("judge"))


@query("q_panel_counts", """
SELECT regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g') AS name, s_name AS display, count(DISTINCT l_orderkey) AS panels FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL""")
def panel_counts(t):
    return jd.judges(jd.panels(_panel(t)))


_COVERAGE_PE = "SELECT o_orderpriority AS provider, o_orderkey AS provider_key, CAST(o_orderdate AS DATE) AS start_date FROM orders"


@query("q_provider_coverage", f"SELECT provider, count(*) AS events, min(start_date) AS first, max(start_date) AS last FROM ({_COVERAGE_PE}) GROUP BY provider")
def provider_coverage(t):
    return _coverage(t)["providers"]


@query("q_sheet_coverage", """
SELECT o_orderpriority AS provider, CASE WHEN l_returnflag = 'R' THEN 'parsed' WHEN l_returnflag = 'A' THEN 'empty' ELSE 'failed' END AS status, count(*) AS count FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL""")
def sheet_coverage(t):
    return _coverage(t)["sheets"]


@query("q_index_status", f"""
WITH pe AS ({_COVERAGE_PE}), s AS (SELECT o_orderpriority AS provider, l_orderkey AS provider_key, l_partkey AS url, l_shipdate AS fetched_at FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R')
SELECT CAST(year(start_date) AS INT) AS year, count(DISTINCT (pe.provider, pe.provider_key)) AS events, count(DISTINCT url) AS sheets, max(fetched_at) AS last_indexed
FROM pe LEFT JOIN s ON pe.provider = s.provider AND pe.provider_key = s.provider_key GROUP BY 1""")
def index_status(t):
    return _coverage(t)["years"]


def _coverage(t):
    from ..plans.service import coverage

    pe = t["orders"].select(F.col("o_orderpriority").alias("provider"), F.col("o_orderkey").alias("provider_key"), F.to_date("o_orderdate").alias("start_date"))
    status = F.when(F.col("l_returnflag") == "R", "parsed").when(F.col("l_returnflag") == "A", "empty").otherwise("failed")
    sheets = t["lineitem"].join(t["orders"], F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderpriority").alias("provider"), F.col("l_orderkey").alias("provider_event_key"), F.col("l_partkey").alias("url"), status.alias("status"), F.col("l_shipdate").alias("fetched_at"))
    return coverage(pe, sheets)


@query("q_providers", "SELECT DISTINCT o_orderpriority AS provider FROM orders ORDER BY 1")
def providers(t):
    pages = t["orders"].select(F.col("o_orderpriority").alias("provider"), F.col("o_orderkey").alias("provider_key"), F.to_date("o_orderdate").alias("start_date"))
    none = pages.select("provider", F.col("provider_key").alias("provider_event_key"), F.lit("parsed").alias("status"), F.lit("").alias("url"), F.col("start_date").alias("fetched_at")).where("false")
    return service.coverage(pages, none)["providers"].select("provider")


@query("q_round_ranks", """
SELECT event_key, role, judge, line, row_number() OVER (PARTITION BY event_key ORDER BY line, judge, mark, place, role) AS rank FROM marks_view""")
def round_ranks(t):
    w = W.partitionBy("event_key").orderBy("line", "judge", "mark", "place", "role")
    return view(t, "marks_view").select("event_key", "role", "judge", "line", F.row_number().over(w).cast("long").alias("rank"))
