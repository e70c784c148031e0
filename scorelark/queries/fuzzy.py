"""Nearest, interval and similarity joins; merging; resolving; judges (J12-J23, ER*, W2-W5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..operators import dedupe, judges, matching, occurrences, resolver
from ..views import Registry, view

query = Registry()


@query("q_nearest_occurrence", """
WITH l AS (SELECT id AS row_id, series_id, start_date + 9 AS d FROM events_view),
p AS (SELECT row_id, e.id AS event_id, abs(date_diff('day', d, start_date)) AS diff FROM l JOIN events_view e USING (series_id) WHERE abs(date_diff('day', d, start_date)) <= 21),
k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY diff, event_id) AS n, lead(diff) OVER (PARTITION BY row_id ORDER BY diff, event_id) AS next FROM p)
SELECT row_id, event_id, CAST(diff AS INT) AS diff, coalesce(diff = next, FALSE) AS ambiguous FROM k WHERE n = 1""")
def nearest_occurrence(t):
    e = view(t, "events_view")
    left = e.select(F.col("id").alias("row_id"), "series_id", F.date_add("start_date", 9).alias("d"))
    found = matching.nearest(left, e.select(F.col("id").alias("event_id"), "series_id", "start_date"), ["series_id"], "d", "start_date", 21, ["event_id"])
    return found.select("row_id", "event_id", "diff", "ambiguous")


@query("q_range_similarity", """
WITH a AS (SELECT id, start_date FROM events_view WHERE lifecycle_status = 'past'), b AS (SELECT id AS other, start_date AS d, source FROM events_view WHERE lifecycle_status = 'listed')
SELECT source, count(*) AS pairs, min(other) AS first FROM a JOIN b ON abs(date_diff('day', start_date, d)) <= 3 GROUP BY source""")
def range_similarity(t):
    e = view(t, "events_view")
    a = e.where("lifecycle_status = 'past'").select("id", "start_date")
    b = e.where("lifecycle_status = 'listed'").select(F.col("id").alias("other"), F.col("start_date").alias("d"), "source")
    return matching.met_in_time(a, b, "start_date", "d", 3, ["source"], "other")


_EDGE_SQL = """
SELECT a.id AS a, b.id AS b FROM events_view a JOIN events_view b ON a.series_id = b.series_id AND a.year = b.year AND a.source <> b.source AND (a.start_date < b.start_date OR (a.start_date = b.start_date AND a.id < b.id))
WHERE CASE WHEN a.date_precision = 'year' OR b.date_precision = 'year' THEN TRUE
      WHEN a.date_precision = 'month' OR b.date_precision = 'month' THEN date_trunc('month', a.start_date) IN (date_trunc('month', b.start_date), date_trunc('month', b.end_date)) OR date_trunc('month', a.end_date) IN (date_trunc('month', b.start_date), date_trunc('month', b.end_date))
      ELSE abs(date_diff('day', a.start_date, b.start_date)) <= 7 END"""


def _events(t):
    """The view with names that only the same customer shares: their numbers are too long to look like a year, which event names lose."""
    e = view(t, "events_view")
    return e.withColumn("name", F.concat(F.lit("c"), (F.col("series_id") + 10_000_000).cast("string"), F.lit("x"))).withColumns({"created_at": F.col("id"), "merged_into": F.lit(None).cast("long")})


@query("q_related_pairs", _EDGE_SQL)
def related_pairs(t):
    return dedupe.edges(_events(t))


#: Merging in order as a recursion: step k of a series takes its k-th edge, unless either end is gone.
_MERGES = f"""
g AS ({_EDGE_SQL}),
n AS (SELECT id, series_id, start_date, end_date, date_precision, CASE date_precision WHEN 'day' THEN 0 WHEN 'month' THEN 1 ELSE 2 END AS p FROM events_view),
o AS (SELECT x.series_id AS s, a, b, CASE WHEN (x.p, CAST(a AS VARCHAR), a) < (y.p, CAST(b AS VARCHAR), b) THEN a ELSE b END AS k_, CASE WHEN (x.p, CAST(a AS VARCHAR), a) < (y.p, CAST(b AS VARCHAR), b) THEN b ELSE a END AS d_,
             row_number() OVER (PARTITION BY x.series_id ORDER BY x.start_date, a, y.start_date, b) AS k FROM g JOIN n x ON x.id = a JOIN n y ON y.id = b),
r AS (SELECT DISTINCT s, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gone, CAST(NULL AS BIGINT) AS keep, CAST(NULL AS BIGINT) AS "drop" FROM o
      UNION ALL
      SELECT s, k, CASE WHEN hit THEN list_append(gone, d_) ELSE gone END, CASE WHEN hit THEN k_ END, CASE WHEN hit THEN d_ END
      FROM (SELECT r.s, o.k, r.gone, o.k_, o.d_, NOT list_contains(r.gone, o.a) AND NOT list_contains(r.gone, o.b) AS hit FROM r JOIN o ON o.s = r.s AND o.k = r.k + 1)),
m AS (SELECT keep, "drop" FROM r WHERE "drop" IS NOT NULL)"""


@query("q_dedupe", f'WITH RECURSIVE {_MERGES} SELECT keep, "drop" FROM m')
def q_dedupe(t):
    e = _events(t)
    return dedupe.merges(e, dedupe.edges(e)).select("keep", "drop")


@query("q_dedupe_events", f"""
WITH RECURSIVE {_MERGES},
t AS (SELECT "drop" AS old, keep AS new, 1 AS h FROM m UNION ALL SELECT t.old, m.keep, h + 1 FROM t JOIN m ON m."drop" = t.new WHERE h < 5),
f AS (SELECT old, arg_max(new, h) AS new FROM t GROUP BY old),
d AS (SELECT new AS id, min(p) AS p, arg_min(start_date, (p, id)) AS start_date, arg_min(date_precision, (p, id)) AS date_precision, max(CASE WHEN id % 2 = 0 THEN 'x' END) AS city FROM f JOIN n ON n.id = f.old GROUP BY new)
SELECT n.id, CASE WHEN d.p < n.p THEN d.start_date ELSE n.start_date END AS start_date, CASE WHEN d.p < n.p THEN d.date_precision ELSE n.date_precision END AS date_precision, coalesce(CASE WHEN n.id % 2 = 0 THEN 'x' END, d.city) AS city, TRUE AS active, CAST(NULL AS BIGINT) AS merged_into
FROM n LEFT JOIN d USING (id) WHERE n.id NOT IN (SELECT old FROM f)
UNION ALL SELECT n.id, start_date, date_precision, CASE WHEN n.id % 2 = 0 THEN 'x' END, FALSE, new FROM n JOIN f ON f.old = n.id""")
def dedupe_events(t):
    e = _events(t).withColumns({"active": F.lit(True), "website_url": F.lit(None).cast("string"), "city": F.when(F.col("id") % 2 == 0, "x"), "region": F.lit(None).cast("string")})
    return dedupe.merge_events(e, dedupe.merges(e, dedupe.edges(e))).select("id", "start_date", "date_precision", "city", "active", "merged_into")


@query("q_find_related", f"""
WITH g AS ({_EDGE_SQL}), p AS (SELECT a AS id, b AS other FROM g UNION ALL SELECT b, a FROM g),
k AS (SELECT p.id, other, row_number() OVER (PARTITION BY p.id ORDER BY CASE date_precision WHEN 'day' THEN 0 WHEN 'month' THEN 1 ELSE 2 END, other) AS n FROM p JOIN events_view e ON e.id = other)
SELECT id, other AS related_id FROM k WHERE n = 1""")
def find_related(t):
    e = _events(t)
    return matching.find_related(e, e)


@query("q_in_series_month", """
WITH r AS (SELECT id AS row_id, series_id, date_trunc('month', start_date + 20) AS month FROM events_view),
p AS (SELECT row_id, id, date_precision, count(*) OVER (PARTITION BY row_id) AS n, row_number() OVER (PARTITION BY row_id ORDER BY CASE WHEN date_precision = 'day' THEN 0 ELSE 1 END, id) AS k
      FROM r JOIN events_view e USING (series_id) WHERE date_trunc('month', start_date) = month OR date_trunc('month', end_date) = month)
SELECT row_id, id, n FROM p WHERE k = 1""")
def in_series_month(t):
    e = _events(t)
    r = e.select(F.col("id").alias("row_id"), "series_id", F.trunc(F.date_add("start_date", 20), "month").alias("month"))
    return occurrences.in_series_month(r, e)


_SCORED = """
q AS (SELECT id AS request_id, name AS q_name, start_date + 2 AS q_date, country AS q_country FROM events_view),
s AS (SELECT request_id, id AS event_id, start_date, (700 + CASE WHEN abs(date_diff('day', q_date, start_date)) <= 3 THEN 300 WHEN abs(date_diff('day', q_date, start_date)) <= 14 THEN 150 WHEN abs(date_diff('day', q_date, start_date)) > 60 THEN -200 ELSE 0 END) / 1000 AS score
      FROM q JOIN events_view e ON e.name = q.q_name),
k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, start_date, event_id) AS n FROM s WHERE score >= 0.3)"""


def _scored(t):
    """Every event asked for by its name, country and a date two days off, against all events of that name."""
    v, null = view(t, "events_view"), F.lit(None)
    norm = normalize_text(F.col("name"))
    q = v.select(F.col("id").alias("request_id"), norm.alias("q_name"), F.date_add("start_date", 2).alias("q_date"), null.cast("int").alias("q_year"), F.col("country").alias("q_country"), null.cast("string").alias("q_city"))
    e = v.select(norm.alias("series_norm"), norm.alias("name_norm"), F.col("id").alias("event_id"), "start_date", "year", "country", null.cast("string").alias("city"), F.array().cast("array<string>").alias("alias_norms"))
    return q, resolver.candidates(resolver.score(q.join(e, F.col("q_name") == F.col("series_norm"))))


@query("q_resolver_score", f"WITH {_SCORED} SELECT request_id, event_id, score, n FROM k WHERE n <= 5")
def resolver_score(t):
    return _scored(t)[1].select("request_id", "event_id", "score", F.col("n").cast("long").alias("n"))


@query("q_resolver_decision", f"""
WITH {_SCORED}, d AS (SELECT request_id, max(score) FILTER (n = 1) AS top, coalesce(max(score) FILTER (n = 2), 0) AS second, max(event_id) FILTER (n = 1) AS best FROM k GROUP BY 1)
SELECT q.request_id, CASE WHEN top IS NULL THEN 'not_found' WHEN top >= 0.7 AND round((top - second) * 1000) >= 150 THEN 'resolved' ELSE 'ambiguous' END AS status, top AS confidence,
CASE WHEN top >= 0.7 AND round((top - second) * 1000) >= 150 THEN best END AS event_id FROM q LEFT JOIN d USING (request_id)""")
def resolver_decision(t):
    q, ranked = _scored(t)
    return resolver.answer(resolver.decide(q, ranked)).select("request_id", "status", "confidence", "event_id")


def _judge_marks(t):
    """Panels of an order and supplier with names in three forms, few enough together that merging stays possible."""
    l = t["lineitem"].join(t["part"], F.col("p_partkey") == F.col("l_partkey"))  # noqa: E741
    first, second = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    name = F.when(F.col("l_partkey") % 3 == 0, F.col("p_name")).when(F.col("l_partkey") % 3 == 1, F.concat_ws(" ", F.substring(first, 1, 3), second)).otherwise(first)
    return l.select(F.col("l_orderkey").alias("sheet_url"), F.col("l_suppkey").alias("section"), name.alias("judge"))


@query("q_judge_candidates", """
WITH j AS (SELECT DISTINCT CASE l_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN substr(split_part(p_name, ' ', 1), 1, 3) || ' ' || split_part(p_name, ' ', 2) ELSE split_part(p_name, ' ', 1) END AS n
           FROM lineitem JOIN part ON p_partkey = l_partkey),
p AS (SELECT n, split_part(n, ' ', 1) AS f, CASE WHEN contains(n, ' ') THEN split_part(n, ' ', 2) END AS l FROM j),
k AS (SELECT x.n AS a, y.n AS b, x.l IS NOT NULL AND y.l IS NOT NULL AS full_, x.f AS fa, y.f AS fb FROM p x JOIN p y ON (x.l = y.l AND x.n < y.n) OR (x.l IS NOT NULL AND y.l IS NULL))
SELECT a, b, CASE WHEN NOT full_ THEN 'single' WHEN fa = fb THEN 'same' ELSE 'prefix' END AS kind FROM k
WHERE fa = fb OR (least(length(fa), length(fb)) >= 3 AND (starts_with(fa, fb) OR starts_with(fb, fa)))""")
def judge_candidates(t):
    return judges.candidates(judges.judges(judges.panels(_judge_marks(t))))


def _judged(t):
    """Marks and corrections by hand with known identities: per customer k two forms of one first name, and a third name.

    The forms share a panel if k is a multiple of 3, and are told apart by hand if it is one of 5; the third name is merged
    with the first by hand if k is a multiple of 7.
    """
    k = F.col("c_custkey")
    name = lambda first, last: F.concat(F.lit(first + " " + last), k.cast("string"))
    seat = lambda sheet, judge: F.struct(F.concat(F.lit(sheet), k.cast("string")).alias("sheet_url"), F.lit(0).alias("section"), judge.alias("judge"))
    michael, mike, solo = name("Michael", "S"), name("MIKE", "S"), name("Solo", "Z")
    seats = F.array(seat("a", michael), seat("b", michael), seat("c", mike), seat("d", solo))
    marks = t["customer"].select(F.inline(F.when(k % 3 == 0, F.array_append(seats, seat("a", mike))).otherwise(seats)))
    order = lambda n, action, other: F.struct((2 * k + n).alias("id"), F.lit(action).alias("action"), michael.alias("name_a"), other.alias("name_b"))
    orders = F.filter(F.array(F.when(k % 5 == 0, order(0, "separate", mike)), F.when(k % 7 == 0, order(1, "merge", solo))), lambda x: x.isNotNull())
    return judges.rebuild(marks, t["customer"].select(F.inline(orders)))


_JUDGED = """
j AS (SELECT c_custkey AS k, c_custkey % 3 = 0 OR c_custkey % 5 = 0 AS apart, c_custkey % 7 = 0 AS forced, 'michael s' || c_custkey AS m, 'mike s' || c_custkey AS n, 'solo z' || c_custkey AS o FROM customer),
a AS (SELECT m AS alias_norm, m AS judge_key, CASE WHEN forced THEN 'manual' WHEN apart THEN 'exact' ELSE 'nickname' END AS method, CAST(2 AS BIGINT) AS panels FROM j
      UNION ALL SELECT n, CASE WHEN apart THEN n ELSE m END, CASE WHEN apart THEN 'exact' ELSE 'nickname' END, CAST(CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) FROM j
      UNION ALL SELECT o, CASE WHEN forced THEN m ELSE o END, CASE WHEN forced THEN 'manual' ELSE 'exact' END, CAST(1 AS BIGINT) FROM j)"""


@query("q_judge_clusters", f"WITH {_JUDGED} SELECT alias_norm, judge_key, method, panels FROM a")
def judge_clusters(t):
    return _judged(t).select("alias_norm", "judge_key", "method", "panels")


@query("q_judge_list", f"WITH {_JUDGED} SELECT judge_key, CAST(sum(panels) AS BIGINT) AS panels, CAST(count(*) AS INT) AS n_names, FALSE AS needs_review FROM a GROUP BY 1")
def judge_list(t):
    return judges.judge_list(_judged(t)).select("judge_key", "panels", F.size("names").alias("n_names"), "needs_review")


def seats(t):
    """Panels of all orders: a part is a judge of one of 200 families, with one of eight first names and perhaps an initial; some go by the first name alone."""
    key = F.col("l_partkey").cast("int")
    first = F.get(F.array(*map(F.lit, ("Michael", "Mike", "Mick", "Christopher", "Chris", "Samantha", "Sam", "Elizabeth"))), key % 8)
    initial = F.when(key % 3 == 0, F.char(F.lit(65) + F.expr("CAST(l_partkey div 8 AS INT)") % 26))
    name = F.when(key % 50 == 7, first).otherwise(F.concat_ws(" ", first, initial, F.concat(F.lit("Fam"), (key % 200).cast("string"))))
    return t["lineitem"].select(F.col("l_orderkey").alias("sheet_url"), F.lit(0).alias("section"), name.alias("judge"))


@query("q_judge_panels")
def judge_panels(t):
    """No SQL: the scan is held against a plain version in the tests."""
    a = judges.rebuild(seats(t))
    return a.select("alias_norm", "judge_key", "method", "confidence", "panels", F.array_join("candidates", "|").alias("candidates"))


_LONE = "translate(reverse(lpad(CAST(c_custkey AS STRING), 8, '0')), '0123456789', 'abcdefghij')"


@query("q_judge_review", f"SELECT n AS name, n || ' Low|' || n || ' Z' AS candidates FROM (SELECT {_LONE} AS n FROM customer WHERE c_custkey % 3 <> 0)")
def judge_review(t):
    """A lone first name that fits two judges is left to people; of every third customer it has sat beside one of the two, and is the other."""
    name = F.expr(_LONE)
    seat = lambda sheet, who: F.struct(F.concat(F.lit(sheet), F.col("c_custkey").cast("string")).alias("sheet_url"), F.lit(0).alias("section"), who.alias("judge"))
    low, z = F.concat(name, F.lit(" Low")), F.concat(name, F.lit(" Z"))
    seats = F.array(seat("a", low), seat("b", z), seat("c", name))
    marks = t["customer"].select(F.inline(F.when(F.col("c_custkey") % 3 == 0, F.array_append(seats, seat("a", name))).otherwise(seats)))
    return judges.review_list(judges.rebuild(marks)).select("name", F.array_join("candidates", "|").alias("candidates"))


@query("q_occurrence_match", """
WITH RECURSIVE p AS (SELECT l.id AS row_id, l.series_id AS s, e.id, CAST(abs(date_diff('day', l.start_date + 4, e.start_date)) AS INT) AS diff FROM events_view l JOIN events_view e USING (series_id) WHERE abs(date_diff('day', l.start_date + 4, e.start_date)) <= 21),
c AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY row_id) AS k FROM (SELECT s, row_id, list({'diff': diff, 'id': id} ORDER BY diff, CAST(id AS VARCHAR), id) AS cand FROM p GROUP BY s, row_id)),
r AS (SELECT DISTINCT s, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS row_id, CAST(NULL AS BIGINT) AS id, CAST(NULL AS INT) AS diff, FALSE AS ambiguous FROM c
      UNION ALL
      SELECT s, k, CASE WHEN len(free) > 0 THEN list_append(taken, free[1].id) ELSE taken END, row_id, free[1].id, free[1].diff, free[1].diff > 0 AND len(free) > 1 AND coalesce(free[2].diff = free[1].diff, FALSE)
      FROM (SELECT r.s, c.k, r.taken, c.row_id, list_filter(c.cand, lambda x: NOT list_contains(r.taken, x.id)) AS free FROM r JOIN c ON c.s = r.s AND c.k = r.k + 1))
SELECT row_id, id, diff, ambiguous FROM r WHERE id IS NOT NULL""")
def occurrence_match(t):
    e = _events(t)
    rows = e.select(F.col("id").alias("row_id"), F.col("id").alias("row_index"), "series_id", F.date_add("start_date", 4).alias("start_date"), "country")
    return occurrences.match_occurrences(rows, e)


@query("q_import_events", """
WITH RECURSIVE w AS (SELECT o_orderkey AS row_id, o_custkey AS s, CAST(o_orderdate AS DATE) + 3 AS d, o_orderkey % 4 <> 0 AS exact FROM orders),
e AS (SELECT id, 'e' || id AS eid, series_id AS s, start_date, date_precision AS p FROM events_view),
p AS (SELECT row_id, s, id, eid, abs(date_diff('day', d, start_date)) AS diff FROM w JOIN e USING (s) WHERE exact AND abs(date_diff('day', d, start_date)) <= 7),
c AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY row_id) AS k FROM (SELECT s, row_id, list(eid ORDER BY diff, CAST(id AS VARCHAR), eid) AS cand FROM p GROUP BY s, row_id)),
r AS (SELECT DISTINCT s, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS BIGINT) AS row_id, CAST(NULL AS VARCHAR) AS eid FROM c
      UNION ALL
      SELECT s, k, CASE WHEN len(free) > 0 THEN list_append(taken, free[1]) ELSE taken END, row_id, free[1]
      FROM (SELECT r.s, c.k, r.taken, c.row_id, list_filter(c.cand, lambda x: NOT list_contains(r.taken, x)) AS free FROM r JOIN c ON c.s = r.s AND c.k = r.k + 1)),
mo AS (SELECT row_id, arg_min(eid, id) AS eid FROM w JOIN e ON e.s = w.s AND e.p = 'month' AND date_trunc('month', d) = date_trunc('month', start_date) WHERE exact GROUP BY 1),
ye AS (SELECT row_id, arg_min(eid, (CASE e.p WHEN 'day' THEN 0 WHEN 'month' THEN 1 ELSE 2 END, id)) AS eid FROM w JOIN e ON e.s = w.s AND year(d) = year(start_date) WHERE NOT exact GROUP BY 1),
f AS (SELECT w.*, coalesce(r.eid, mo.eid, ye.eid) AS hit FROM w LEFT JOIN (SELECT row_id, eid FROM r WHERE eid IS NOT NULL) r USING (row_id) LEFT JOIN mo USING (row_id) LEFT JOIN ye USING (row_id))
SELECT f.row_id, 's' || f.s AS series_id, 'known' AS series_status, coalesce(hit, 'evt_' || substr(sha256('{"series_id":"s' || f.s || '","start_date":"' || d || '"}'), 1, 16)) AS event_id, CASE WHEN hit IS NULL THEN 'created' ELSE 'matched' END AS status, coalesce(e.p = 'month' AND exact, FALSE) AS upgrade
FROM f LEFT JOIN e ON e.eid = hit""")
def import_events(t):
    e = _events(t).withColumn("series_id", F.concat(F.lit("s"), F.col("series_id").cast("string"))).withColumn("id", F.concat(F.lit("e"), F.col("id").cast("string")))
    series = t["customer"].select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("id"), normalize_text(F.col("c_name")).alias("normalized_name"), F.col("c_custkey").alias("created_at"))
    aliases = series.select(F.col("id").alias("series_id"), F.concat(F.lit("alias "), F.col("id")).alias("normalized_alias"))
    rows = t["orders"].join(t["customer"], F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderkey").alias("row_index"), F.col("c_name").alias("name"), F.col("c_name").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"), F.lit("import").alias("source"),
        F.date_add(F.to_date("o_orderdate"), 3).alias("start_date"), F.date_add(F.to_date("o_orderdate"), 5).alias("end_date"), F.when(F.col("o_orderkey") % 4 == 0, "year").otherwise("day").alias("date_precision"), F.lit(None).cast("string").alias("country"))
    return occurrences.import_events(rows, series, aliases, e).select("row_id", "series_id", "series_status", "event_id", "status", "upgrade")
