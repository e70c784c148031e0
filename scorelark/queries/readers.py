"""Readers of pages, over pages that are written from the driver's rows (SRC5-SRC15, W6, W10, A22-A24, X19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import html, sheets
from ..sources import pages as pg
from ..views import Registry, view

query = Registry()


def _s(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _fmt(pattern: str, *columns):
    return F.format_string(pattern, *(_s(c) for c in columns))


def _joined(order: str, text):
    """All texts of a group in an order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), text.alias("v")))), lambda x: x["v"]), "")


@query("q_calendar", """
SELECT c_custkey AS run_id, o_orderkey AS listed, CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) + 2 AS end_date, 'Event' || n AS canonical_name, CASE WHEN n = '' THEN 'Event (EV )|EV' ELSE 'Event' || n || ' (EV' || trim(n) || ')|EV' || trim(n) END AS aliases,
       CASE WHEN o_orderkey % 2 = 0 THEN 'trial' ELSE 'unknown' END AS event_status, CASE o_orderkey % 3 WHEN 0 THEN 'DEU' WHEN 1 THEN 'FRA' ELSE 'USA' END AS country, o_orderkey % 3 = 0 AS warned,
       CASE WHEN o_orderkey % 5 = 0 THEN 'http://e' || o_orderkey || '.example' END AS website_url
FROM (SELECT *, CASE WHEN o_orderkey BETWEEN 1900 AND 2099 THEN '' ELSE ' ' || o_orderkey END AS n FROM orders) JOIN customer ON c_custkey = o_custkey""")
def calendar(t):
    """One calendar page per customer, with an event per order and a table of something else before; a number that looks like a year is no part of an event's names."""
    k = F.col("o_orderkey")
    d = F.to_date("o_orderdate")
    when = F.concat(F.date_format(d, "MMM d, yyyy"), F.lit(" - "), F.date_format(F.date_add(d, 2), "MMM d, yyyy"))
    link = F.when(k % 5 == 0, _fmt('<a href="http://http://e%s.example">Event %s (EV%s)</a>', k, k, k)).otherwise(_fmt("Event %s (EV%s)", k, k))
    place = F.when(k % 3 == 0, "Town, Germany").when(k % 3 == 1, "Ville, France").otherwise("City, GA")
    row = F.concat(F.lit("<tr><td>"), when, F.lit("<td>"), link, F.when(k % 2 == 0, " Trial Event").otherwise(""), F.lit("</td><td>"), place, F.when(k % 3 == 1, '<td><img src="/flags/FRA.png">').otherwise('<td><a href="?country=USA">x</a>'))
    head = "<table><tr><td>menu</td></tr></table><table><tr><th>Date</th><th>Event Name</th><th>Location</th><th>Country</th></tr>"
    page = t["orders"].groupBy(F.col("o_custkey").alias("run_id")).agg(F.concat(F.lit(head), _joined("o_orderkey", row), F.lit("</table>")).alias("html"))
    found = html.calendar_events(html.calendar_cells(page))
    return found.where("error IS NULL").select("run_id", F.regexp_extract("name", r"\(EV(\d+)\)", 1).try_cast("long").alias("listed"), "start_date", "end_date", "canonical_name", F.array_join("aliases", "|").alias("aliases"), "event_status", "country", F.col("warning").isNotNull().alias("warned"), "website_url")


@query("q_calendar_errors", "SELECT o_custkey AS run_id, count(*) AS bad FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def calendar_errors(t):
    row = F.concat(F.lit("<tr><td>"), F.when(F.col("o_orderstatus") == "P", "some day").otherwise(F.date_format("o_orderdate", "MMMM d, yyyy")), F.lit("</td><td>Party</td></tr>"))
    page = t["orders"].groupBy(F.col("o_custkey").alias("run_id")).agg(F.concat(F.lit("<table><tr><th>Date</th><th>Event</th></tr>"), _joined("o_orderkey", row), F.lit("</table>")).alias("html"))
    found = html.calendar_events(html.calendar_cells(page))
    return found.where("error IS NOT NULL").groupBy("run_id").agg(F.count("*").alias("bad"))


@query("q_year_index", """
SELECT o_custkey AS id, 's' || o_orderkey AS provider_key, 'Event ' || o_orderkey AS name, CAST(2 AS INT) AS n_links, 'A' || o_orderkey AS first_title FROM orders""")
def year_index(t):
    """A page per customer: each order is a header with two result links, one of them twice, and a link that is none."""
    k = F.col("o_orderkey")
    part = F.concat(F.lit("<p>"), F.date_format("o_orderdate", "MMMM d, yyyy"), _fmt(" - Event %s</p>", k), *(_fmt('<a href="/results/s%s/' + f + '.html">' + f.upper() + "%s</a>", k, k) for f in "aab"), F.lit('<a href="/about.html">About</a>'))
    page = t["orders"].groupBy("o_custkey").agg(_joined("o_orderkey", part).alias("html")).withColumn("url", _fmt("https://eepro.com/results/y%s/", "o_custkey"))
    found = html.year_index(page)
    return found.select(F.regexp_extract("url", r"/y(\d+)/", 1).cast("long").alias("id"), "provider_key", "name", F.size("links").alias("n_links"), F.get("links", F.lit(0))["title"].alias("first_title"))


_LINE = "l_orderkey AS event, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem"


def _lines(t):
    """Rows are dealt out once, for their numbers and their pages, into as many tasks as Spark shuffles into: reading pages takes long for few bytes."""
    from pyspark.sql import Window as W

    w = W.partitionBy("event").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    l = t["lineitem"].select(F.col("l_orderkey").alias("event"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")  # noqa: E741
    l = l.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "event")  # noqa: E741
    return l.select("event", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.row_number().over(w).alias("n"))


def _pages(t, row, head: str, tail: str, provider: str, title=None):
    found = _lines(t).groupBy("event").agg(F.concat(F.lit(head), _joined("n", row), F.lit(tail)).alias("html"))
    return found.select(F.lit(provider).alias("provider"), _s("event").alias("url"), (title if title is not None else F.lit(None).cast("string")).alias("title"), F.lit(None).cast("array<string>").alias("siblings"), "html")


@query("q_sheet_prelims_1", f"""
WITH l AS (SELECT {_LINE})
SELECT event, CAST(n AS INT) AS rank, 'Lead ' || part AS name, 'leader' AS role, 'Fol ' || supp AS partner, CAST(part AS STRING) AS bib, 'prelims' AS round, 'Novice' AS division, CASE part % 2 WHEN 0 THEN 'Y' ELSE 'A1' END AS mark, n = 1 AS advanced, CASE WHEN n = 2 THEN 'ALT1' END AS alternate FROM l
UNION ALL
SELECT event, CAST(n AS INT), 'Fol ' || supp, 'follower', 'Lead ' || part, CAST(supp AS STRING), 'prelims', 'Novice', CASE part % 2 WHEN 0 THEN 'Y' ELSE 'A1' END, n = 1, CASE WHEN n = 2 THEN 'ALT1' END FROM l""")
def sheet_prelims_1(t):
    mark, counts = F.when(F.col("part") % 2 == 0, "Y").otherwise("A1"), F.when(F.col("part") % 2 == 0, "1-0-1").otherwise("0-1-1")
    row = F.concat(_fmt("<tr><td>%s</td><td>Lead %s and Fol %s</td><td>", "n", "part", "supp"), mark, _fmt("</td><td>N</td><td>%s/%s</td><td>", "part", "supp"), counts, F.lit("</td><td>10.0</td><td>"), F.when(F.col("n") == 1, "X").otherwise(""), F.lit("</td><td>"), F.when(F.col("n") == 2, "ALT1").otherwise(""), F.lit("</td></tr>"))
    head = "<h2>Swing Time - 2026</h2><table><tr><td>Jack &amp; Jill Novice Prelims - 9 competed</td></tr><tr><td>Count</td><td>Competitor</td><td>Ann</td><td>Cy</td><td>BIB</td><td>Counts</td><td>Sum</td><td>Promote</td><td>Alt</td></tr>"
    e = sheets.sheet_entries(_pages(t, row, head, "</table>", "eepro"))
    return e.select(F.col("url").cast("long").alias("event"), "rank", "name", "role", "partner", "bib", "round", "division", F.col("marks")["Ann"].alias("mark"), "advanced", "alternate")


@query("q_sheet_finals_1", f"""
WITH l AS (SELECT {_LINE})
SELECT event, CAST(n AS INT) AS place, 'Dancer ' || part AS name, 'leader' AS role, CAST(1 + part % 9 AS STRING) AS mark, 'finals' AS round, 'Advanced' AS division FROM l""")
def sheet_finals_1(t):
    """The same as running text instead of a table."""
    row = F.concat(_fmt("<li>%s Dancer %s ", "n", "part"), _s(1 + F.col("part") % 9), F.lit(" 2 77 1-2</li>"))
    head = "<p>Division: Advanced Leaders Finals</p><p>Place Competitor J1 J2 BIB Sorted</p><ul>"
    e = sheets.sheet_entries(_pages(t, row, head, "</ul>", "eepro"))
    return e.select(F.col("url").cast("long").alias("event"), "place", "name", "role", F.get("marks_list", F.lit(0)).alias("mark"), "round", "division")


@query("q_sheet_prelims_2", f"""
WITH l AS (SELECT {_LINE})
SELECT event, CAST(n AS INT) AS rank, 'Name ' || part AS name, CASE part % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' ELSE 'A2' END AS mark, CAST(part % 50 AS DOUBLE) + 0.5 AS score, n = 1 AS advanced, supp + 1 AS registry_id, 'prelims' AS round, 'Winter ' || event AS event_title FROM l""")
def sheet_prelims_2(t):
    word = F.when(F.col("part") % 3 == 0, "yes").when(F.col("part") % 3 == 1, "No").otherwise("Alt 2")
    row = F.concat(F.lit('<tr data-state="'), F.when(F.col("n") == 1, "CB").otherwise("x"), _fmt('"><td>%s</td><td><a data-number="%s">Name %s</a></td><td>', "n", F.col("supp") + 1, "part"), word, _fmt("</td><td>%s,5</td></tr>", F.col("part") % 50))
    body = _pages(t, row, '<table><tr><th>Bib</th><th>Name</th><th title="Ann B (Head Judge)">AB</th><th>Σ</th></tr>', "</table>", "scoring_dance")
    e = sheets.sheet_entries(body.withColumn("html", F.concat(_fmt("<h1>Advanced J&amp;J prelim results - Winter %s</h1>", "url"), "html")))
    return e.select(F.col("url").cast("long").alias("event"), "rank", "name", F.col("marks")["Ann B"].alias("mark"), "score", "advanced", "registry_id", "round", "event_title")


@query("q_sheet_finals_2", f"""
WITH l AS (SELECT {_LINE}), d AS (SELECT event, count(DISTINCT n) AS competed FROM l GROUP BY 1)
SELECT event, CAST(competed AS INT) AS competed, CAST(n AS INT) AS place, 'L' || part AS name, 'leader' AS role, 'F' || supp AS partner, CAST(n AS STRING) AS bib FROM l JOIN d USING (event)
UNION ALL SELECT event, CAST(competed AS INT), CAST(n AS INT), 'F' || supp, 'follower', 'L' || part, NULL FROM l JOIN d USING (event)""")
def sheet_finals_2(t):
    row = _fmt("<tr><td>%s</td><td>L%s</td><td>F%s</td><td>1</td><td>%sth</td></tr>", "n", "part", "supp", "n")
    head = "<h1>Novice final - Winter</h1><table><tr><th>Bib</th><th>Leader</th><th>Follower</th><th>Ann</th><th>Placement</th></tr>"
    e = sheets.sheet_entries(_pages(t, row, head, "</table>", "scoring_dance"))
    return e.select(F.col("url").cast("long").alias("event"), "competed", "place", "name", "role", "partner", "bib")


@query("q_sheet_prelims_3", f"""
WITH l AS (SELECT {_LINE})
SELECT event, 'Name ' || part AS name, CAST(n AS INT) AS rank, CASE part % 4 WHEN 0 THEN 'Y' WHEN 1 THEN 'A1' WHEN 2 THEN 'N' ELSE '3.3' END AS mark, n = 1 AS advanced, 'Novice' AS division FROM l WHERE part % 5 <> 0""")
def sheet_prelims_3(t):
    points = F.when(F.col("part") % 4 == 0, "10").when(F.col("part") % 4 == 1, "4.5").when(F.col("part") % 4 == 2, "0").otherwise("3.3")
    row = F.concat(F.lit("<tr><td>"), F.when(F.col("n") == 1, "Y").otherwise("N"), _fmt("</td><td>%s</td><td>7</td><td>", "n"), F.when(F.col("part") % 5 == 0, "***").otherwise(_fmt("Name %s", "part")), F.lit("</td><td>"), points, F.lit("</td><td>1,000.5</td></tr>"))
    head = "<title>Chicago Classic - Scores</title><h3>Jack &amp; Jill - Novice - Prelim Round 1</h3><table><tr><th>Callback</th><th>#</th><th>Bib</th><th>Leader</th><th>Nino</th><th>Sum</th></tr>"
    e = sheets.sheet_entries(_pages(t, row, head, "</table>", "wdr"))
    return e.where("score = 1000.5").select(F.col("url").cast("long").alias("event"), "name", "rank", F.col("marks")["Nino"].alias("mark"), "advanced", "division")


@query("q_sheet_finals_3", f"""
WITH l AS (SELECT {_LINE})
SELECT event, CAST(n AS INT) AS place, 'L' || part AS name, 'leader' AS role, CAST(supp % 7 AS STRING) AS mark FROM l
UNION ALL SELECT event, CAST(n AS INT), 'F' || supp, 'follower', CAST(supp % 7 AS STRING) FROM l""")
def sheet_finals_3(t):
    row = _fmt("<tr><td>L%s</td><td>F%s</td><td>%s</td><td>%s</td><td>9</td></tr>", "part", "supp", "n", F.col("supp") % 7)
    head = "<h3>Jack &amp; Jill - Novice - Final</h3><table><tr><th>Leader</th><th>Follower</th><th>Final</th><th>A</th><th>1 - 1</th></tr>"
    e = sheets.sheet_entries(_pages(t, row, head, "</table>", "wdr"))
    return e.where("marks['1 - 1'] IS NULL").select(F.col("url").cast("long").alias("event"), "place", "name", "role", F.col("marks")["A"].alias("mark"))


@query("q_sheet_errors", "SELECT p_partkey AS part, CAST(count(*) AS BIGINT) AS errors FROM part GROUP BY 1")
def sheet_errors(t):
    body = "<h1>Odd - X</h1><table><tr><td>odd</td></tr></table>"
    one = lambda provider: t["part"].where(F.col("p_partkey") % 2 == int(provider == "wdr")).select(F.lit(provider).alias("provider"), _s("p_partkey").alias("url"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("array<string>").alias("siblings"), F.lit(body).alias("html"))
    found = sheets.sheet_entries(one("wdr").unionByName(one("scoring_dance")))
    return found.where("error IS NOT NULL AND name IS NULL").groupBy(F.col("url").cast("long").alias("part")).agg(F.count("*").alias("errors"))


@query("q_round_names", """
SELECT conv_id, turn, CASE WHEN total >= 2 AND turn = total THEN 'semis' WHEN total >= 3 AND turn = total - 1 THEN 'quarters' ELSE 'prelims' END AS round FROM (SELECT conv_id, turn + 1 AS turn, max(turn + 1) OVER (PARTITION BY conv_id) AS total FROM conversations)""")
def round_names(t):
    """Each conversation is a competition, each turn one of its prelim rounds."""
    c = t["conversations"].select("conv_id", (F.col("turn") + 1).alias("turn"))
    title = _fmt("Jack & Jill - C%s - Prelim Round %s", "conv_id", "turn")
    others = c.groupBy("conv_id").agg(F.collect_list(title).alias("siblings"))
    page = "<table><tr><th>Callback</th><th>#</th><th>Bib</th><th>Leader</th><th>Nino</th><th>Sum</th></tr><tr><td>Y</td><td>1</td><td>3</td><td>Joe</td><td>10</td><td>10</td></tr></table>"
    rows = c.join(others, "conv_id").select(F.lit("wdr").alias("provider"), _fmt("%s/%s", "conv_id", "turn").alias("url"), title.alias("title"), "siblings", F.lit(page).alias("html"))
    e = sheets.sheet_entries(rows)
    return e.select(F.split_part("url", F.lit("/"), F.lit(1)).cast("long").alias("conv_id"), F.split_part("url", F.lit("/"), F.lit(2)).cast("long").alias("turn"), "round")


@query("q_round_index", """
SELECT CAST(o_custkey AS STRING) AS number, 'Winter ' || o_custkey AS name, DATE '2025-01-23' AS start_date, CAST(count(*) AS INT) AS n_links FROM orders GROUP BY o_custkey""")
def round_index(t):
    """A page per customer with its orders as rounds in two languages, and links to another event's rounds."""
    link = F.concat(_fmt('<a href="/frFR/events/%s/results/%s.html">R</a>', "o_custkey", "o_orderkey"), _fmt('<a href="/enUS/events/%s/results/%s.html">S</a>', "o_custkey", "o_orderkey"))
    page = t["orders"].groupBy("o_custkey").agg(_joined("o_orderkey", link).alias("links"))
    page = page.select(_s("o_custkey").alias("number"), F.concat(_fmt("<h1>Winter %s results</h1><p>at 01/23/2025 in X</p>", "o_custkey"), "links", F.lit('<a href="/enUS/events/999999999/results/1.html">T</a>')).alias("html"))
    return sheets.round_index(page).select("number", "name", "start_date", F.size("links").alias("n_links"))


@query("q_round_majority", "SELECT 'e' || s_suppkey AS number, CAST(s_suppkey AS STRING) AS real FROM supplier")
def round_majority(t):
    """An event known by a name: most of its links carry its number."""
    page = t["supplier"].select(_fmt("e%s", "s_suppkey").alias("number"), F.concat(F.lit("<h1>X</h1>"), _fmt('<a href="/enUS/events/777777/results/1.html">A</a><a href="/enUS/events/%s/results/1.html">B</a><a href="/enUS/events/%s/results/2.html">C</a>', "s_suppkey", "s_suppkey")).alias("html"))
    return sheets.round_index(page).select("number", "real")


@query("q_round_meta", "SELECT s_suppkey AS id, 'Swing ' || s_name AS event_name, DATE '2024-02-03' AS start_date FROM supplier")
def round_meta(t):
    page = t["supplier"].select(_s("s_suppkey").alias("url"), _fmt("<h1>Novice final - Swing %s</h1><p>danced at 02/03/2024</p>", "s_name").alias("html"))
    return sheets.round_meta(page).select(F.col("url").cast("long").alias("id"), "event_name", "start_date")


@query("q_rounds_3", """
SELECT c_custkey AS id, 'Classic 2026' AS name, CAST(2026 AS INT) AS year, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 AS INT) AS ord, 'Round ' || o_orderkey AS title FROM orders JOIN customer ON c_custkey = o_custkey""")
def rounds_3(t):
    uuid = lambda c: F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(_s(c), 12, "0"))
    row = F.concat(_fmt("<tr><td>Round %s</td><td>", "o_orderkey"), *(F.concat(F.lit('<a href="/'), uuid("o_custkey"), F.lit("/rounds/"), uuid("o_orderkey"), F.lit('">open</a>')) for _ in range(2)), F.lit("</td></tr>"))
    page = t["orders"].groupBy("o_custkey").agg(F.concat(F.lit("<title>Classic 2026 - Scores</title><table>"), _joined("o_orderkey", row), F.lit("</table>")).alias("html")).withColumn("event_id", uuid("o_custkey"))
    found = html.lateral(page, "rounds_3", "html", "event_id", keep=["o_custkey"])
    return found.select(F.col("o_custkey").alias("id"), "name", "year", "ord", "title")


@query("q_crawl", """
SELECT s_suppkey AS id, 'eepro' AS provider, 'home' || s_suppkey AS key, NULL AS href FROM supplier
UNION ALL SELECT s_suppkey, 'scoring_dance', CAST(s_suppkey AS STRING), NULL FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey, 'other', NULL, 'http://pdf' || s_suppkey || '.example/scores.pdf' FROM supplier""")
def crawl(t):
    """A site per supplier: its home page leads to a provider, to a PDF and (every second one) to a page of its own with more."""
    k = F.col("s_suppkey")
    site = _fmt("http://www.s%s.example/", k)
    home = F.concat(F.lit('<a href="/results">Results</a><a href="mailto:x@y">m</a>'), _fmt('<a href="https://eepro.com/results/home%s/">old</a>', k), _fmt('<a href="http://pdf%s.example/scores.pdf">Scores</a>', k))
    inner = F.concat(_fmt('<a href="https://scoring.dance/enUS/events/%s/results/">2025</a>', k), F.lit('<a href="/">home</a>'))
    p = t["supplier"].select(site.alias("url"), home.alias("html")).unionByName(t["supplier"].where("s_suppkey % 2 = 0").select(F.concat(site, F.lit("results")).alias("url"), inner.alias("html")))
    found = pg.crawl(t["supplier"].select(site.alias("url")), p)
    return found.select(F.regexp_extract("start", r"//www\.s(\d+)\.", 1).cast("long").alias("id"), "provider", "key", "href")


@query("q_sheet_links", "SELECT p_partkey AS id, p_size % 4 IN (0, 2) AS readable FROM part")
def sheet_links(t):
    k = F.col("p_size") % 4
    url = F.when(k == 0, "http://a.example/x.HTML").when(k == 1, "http://a.example/x.pdf").otherwise("http://a.example/x")
    return t["part"].select(F.col("p_partkey").alias("id"), pg.is_sheet_link(url, F.when(k == 2, "wdr").otherwise("eepro")).alias("readable"))


@query("q_page_titles", r"""
SELECT page_id, regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)[1] IS NOT NULL AS titled FROM pages""")
def page_titles(t):
    return html.lateral(t["pages"], "page_text", "html", keep=["page_id"]).select("page_id", (F.size("titles") > 0).alias("titled"))
