"""Readers of pages, sheets and registry records, on pages written for these tests."""

import datetime

from pyspark.sql import functions as F

from scorelark.sources import dom, html, pages, registry, sheets

CALENDAR = """
<html><body><table><tr><td>menu</td></tr></table>
<table><thead><tr><th>Date</th><th>Event Name</th><th>Event Location</th><th>Country</th></tr></thead><tbody>
<tr><td>Oct 1 - 5, 2026</td><td><a href="http://http://river.example">River Nights</a> Trial Event</td><td>Dresden, Germany</td><td><a href="https://x.example/?country=DEU"><img src="/flags/DEU.png"></a></td></tr>
<tr class="Unconfirmed"><td>Feb 4 - 7, 2027<td>Lake Open aka LO Registry Event<td>Waterloo, Ontario, Canada<td><img src="/flags/USA.png">
<tr><td>some day</td><td>Broken</td><td></td><td></td></tr>
<tr><td>Mar 1, 2027</td><td>Short row</td></tr>
</tbody></table></body></html>"""

YEAR = """<p>September 10-13, 2026 - Swing Time</p><ul><li><a href="/results/st2026/a.html">Prelims</a><li><a href="/results/st2026/a.html">Prelims</a></ul>
<b>July 30-Aug 2, 2026 – Dance Classic</b> <a href="/results/dc2026/b.pdf">All</a> <a href="/about.html">About</a> <a href="/results/st2026/c.html">Finals</a>"""

SHEET_1 = """<h2>Swing Time - 2026</h2><table>
<tr><td colspan=9>Jack &amp; Jill Novice Prelims - 2 competed<br>ties</td></tr>
<tr><td>Count</td><td>Competitor</td><td>Ann B</td><td>Cy D</td><td>BIB</td><td>Counts</td><td>Sum</td><td>Promote</td><td>Alt</td></tr>
<tr><td>1</td><td>Lee Ray and Kim Sun</td><td>Y</td><td>A1</td><td>7/8</td><td>1-1-0</td><td>14.5</td><td>X</td><td></td></tr>
<tr><td></td><td>Max Moe</td><td>N</td><td>N</td><td>9</td><td>0-0-2</td><td>0</td><td></td><td>ALT1</td></tr></table>
<p>Division: Novice Finals</p><table><tr><td>Place</td><td>Competitor</td><td>Ann B</td><td>Cy D</td><td>BIB</td><td>Sorted</td></tr>
<tr><td>1</td><td>Lee Ray &amp; Kim Sun</td><td>1</td><td>2</td><td>7</td><td>1-2</td></tr>
<tr><td>2</td><td>Bad</td><td>x</td><td>2</td><td>7</td><td>1-2</td></tr></table>"""

SHEET_2 = """<h1>Advanced J&J prelim results - Winter Swing</h1><table><tr><th><img alt="Bib Number"></th><th>Name</th><th title="Ann B (Head Judge)">AB</th><th>Σ</th></tr>
<tr data-state="CB"><td>4</td><td><a data-number="17901">Lee Ray</a></td><td>yes</td><td>10,0</td></tr><tr data-state="ALT1"><td>5</td><td>Kim</td><td>alt 2</td><td>4,3</td></tr></table>
<table><tr><th>Bib</th><th>Name</th><th>CD</th><th>∑</th></tr><tr><td>6</td><td>Sue</td><td>no</td><td>0</td></tr></table>"""

SHEET_2_FINAL = """<h1>Novice final - Winter Swing</h1><table><tr><th>Bib</th><th>Leader</th><th>Follower</th><th>Ann</th><th>Cy</th><th>Placement</th></tr>
<tr><td>4</td><td>Lee</td><td>Kim</td><td>1</td><td>3</td><td>2nd</td></tr></table>"""

SHEET_3 = """<html><head><title>Chicago Classic 2026 - Scores</title></head><h3>Jack &amp; Jill - Novice - Prelim Round 2</h3><table>
<tr><th>Callback</th><th>#</th><th>Bib</th><th>Leader</th><th>Nino</th><th>Sky</th><th>Sum</th></tr>
<tr><td>Y</td><td>1</td><td>3</td><td>Joe P</td><td>10</td><td>4.5</td><td>14.5</td></tr><tr><td>S3</td><td>2</td><td>4</td><td>***</td><td>0</td><td>0</td><td>0</td></tr></table>
<table><tr><th>Leader</th><th>Follower</th><th>Final</th><th>A</th><th>B</th><th>1-1</th></tr><tr><td>Joe</td><td>Ann</td><td>1</td><td>1</td><td>2</td><td>x</td></tr></table><table><tr><td>odd</td></tr></table>"""


def one(spark, kind, **row):
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kind}" for k in row))


def test_tree_repairs_unclosed_markup():
    page = dom.parse("<table><tr><td>a<td>b<tr><td>c</table><ul><li>x<li>y</ul><script>no</script><p>1<p>2<br>3")
    assert [[c.text() for c in r.own("td")] for r in page.all("tr")] == [["a", "b"], ["c"]]
    assert [x.text() for x in page.all("li")] == ["x", "y"] and "no" not in page.text() and page.all("p")[1].raw("\n").split("\n")[1].strip() == "3"


def test_calendar(spark):
    rows = html.calendar_events(html.calendar_cells(one(spark, "string", run_id="r", html=CALENDAR))).orderBy("row_index").collect()
    assert [r.name for r in rows] == ["River Nights", "Lake Open aka LO", "Broken", "Short row"]
    a, b, c, e = rows
    assert (a.event_status, a.country, a.website_url, a.city, a.start_date, a.end_date) == ("trial", "DEU", "http://river.example", "Dresden", datetime.date(2026, 10, 1), datetime.date(2026, 10, 5))
    assert (b.canonical_name, b.aliases, b.country, b.region, b.unconfirmed_hint) == ("Lake Open", ["Lake Open aka LO", "LO"], "CAN", "Ontario", True) and "disagrees" in b.warning
    assert c.error.startswith("unrecognized date") and e.error is None and e.location_raw is None
    assert html.calendar_cells(one(spark, "string", run_id="r", html="<table><tr><td>x</table>")).count() == 0


def test_year_index(spark):
    got = {r.provider_key: r for r in html.year_index(one(spark, "string", url="https://eepro.com/results/2026/", html=YEAR)).collect()}
    assert got["st2026"].name == "Swing Time" and [x.title for x in got["st2026"].links] == ["Prelims", "Finals"]
    assert got["dc2026"].date_raw == "July 30-Aug 2, 2026" and got["dc2026"].links[0].url == "https://eepro.com/results/dc2026/b.pdf"


def test_sheets(spark):
    rows = [("eepro", "1", None, None, SHEET_1), ("scoring_dance", "2", None, None, SHEET_2), ("scoring_dance", "3", None, None, SHEET_2_FINAL), ("wdr", "4", None, ["Jack & Jill - Novice - Prelim Round 1", "Jack & Jill - Novice - Prelim Round 2"], SHEET_3)]
    got = sheets.sheet_entries(spark.createDataFrame(rows, "provider string, url string, title string, siblings array<string>, html string")).collect()
    key = lambda r: (r.url, r.section_no if r.section_no is not None else 99, r.entry_no)
    first = sorted((r for r in got if r.url == "1" and r.name), key=key)
    assert [(r.name, r.role, r.partner, r.bib, r.round) for r in first] == [("Lee Ray", "leader", "Kim Sun", "7", "prelims"), ("Kim Sun", "follower", "Lee Ray", "8", "prelims"), ("Max Moe", None, None, "9", "prelims"), ("Lee Ray", "leader", "Kim Sun", "7", "finals"), ("Kim Sun", "follower", "Lee Ray", None, "finals")]
    assert first[0].marks == {"Ann B": "Y", "Cy D": "A1"} and first[0].advanced and first[0].score == 14.5 and first[0].competed == 2
    assert first[2].alternate == "ALT1" and first[2].advanced is False and first[3].place == 1
    assert len([r for r in got if r.url == "1" and r.error]) == 1
    second = sorted((r for r in got if r.url == "2"), key=key)
    assert [(r.name, r.role, r.advanced, r.alternate, r.registry_id, r.score) for r in second] == [("Lee Ray", "leader", True, None, 17901, 10.0), ("Kim", "leader", False, "ALT1", None, 4.3), ("Sue", "follower", None, None, None, 0.0)]
    assert second[0].marks == {"Ann B": "Y"} and second[1].marks == {"Ann B": "A2"} and second[0].event_title == "Winter Swing" and second[0].division == "Advanced"
    third = sorted((r for r in got if r.url == "3"), key=key)
    assert [(r.name, r.place, r.marks["Cy"]) for r in third] == [("Lee", 2, "3"), ("Kim", 2, "3")]
    fourth = sorted((r for r in got if r.url == "4" and r.name), key=key)
    assert [(r.name, r.round, r.state) for r in fourth] == [("Joe P", "semis", "Y"), ("Joe", "finals", None), ("Ann", "finals", None)] and fourth[0].marks == {"Nino": "Y", "Sky": "A1"}
    assert any("no known layout" in (r.error or "") for r in got if r.url == "4")


def test_round_titles():
    siblings = [f"J & J - Novice - Prelim Round {i}" for i in (1, 2, 3)]
    assert [sheets.describe_round(s, siblings)["round"] for s in siblings] == ["prelims", "quarters", "semis"]
    assert sheets.describe_round("Country Swing - Jack & Jill - Novice - Final")["division"] == "Country Swing Novice"
    assert sheets.describe_round("Pro Am Strictly Swing - Novice - Leaders - Final")["role"] == "leader"


def test_round_index(spark):
    page = '<h1>Winter Swing results</h1><p>at 01/23/2025 in X</p><a href="/frFR/events/195/results/1.html">A</a><a href="/enUS/events/195/results/1.html">B</a><a href="/enUS/events/7/results/9.html">C</a><a href="/enUS/events/195/results/2.html">D</a>'
    r = sheets.round_index(one(spark, "string", number="winter25", html=page)).first()
    assert (r.name, r.start_date, r.real, [x.title for x in r.links]) == ("Winter Swing", datetime.date(2025, 1, 23), "195", ["A", "D"])


def test_crawl(spark):
    rows = [
        ("http://www.a.example/", '<a href="/results">Results</a><a href="mailto:x">m</a><a href="https://eepro.com/results/a26/">old</a><a href="http://b.example/scores.pdf">Scores</a>'),
        ("http://www.a.example/results", '<a href="https://scoring.dance/enUS/events/44/results/">2025</a><a href="/">home</a>'),
    ]
    p = spark.createDataFrame(rows, "url string, html string")
    got = {(r.provider, r.key, r.href) for r in pages.crawl(p.limit(1), p).collect()}
    assert got == {("eepro", "a26", None), ("scoring_dance", "44", None), ("other", None, "http://b.example/scores.pdf")}
    ok = spark.createDataFrame([("http://a/x.pdf", "wdr"), ("http://a/x.html", "eepro"), ("http://a/x", "eepro"), ("http://a/x", "wdr")], "u string, p string").select(pages.is_sheet_link(F.col("u"), F.col("p"))).collect()
    assert [r[0] for r in ok] == [False, True, False, True]


def test_registry(spark):
    record = '{"dancer_wsdcid": 5, "dancer_first": "A", "dancer_last": "B", "short_dominate_role": "Leader", "dominate_required": "N/A", "leader": {"placements": {"WCS": {"NOV": {"division": {"name": "Novice", "abbreviation": "NOV"}, "competitions": [{"role": "leader", "points": 3, "result": 2, "event": {"id": 9, "name": "X", "date": "June 2025"}}, {"points": 1, "result": "F", "event": {"id": 8, "name": "Y", "date": "May 2026"}}]}}}}, "follower": {"placements": []}, "non_dominate_lookup": [{"message": "<b>rule</b>"}]}'
    raw = [("5", record), ("n", "[]"), ("c", '[{"wsdcid": 7, "first_name": "C"}, {"first_name": "no number"}]'), ("c2", '{"names": [{"wscid": 8}]}'), ("x", "<html>"), ("t", '{"type": "none"}'), ("z", None)]
    found = registry.responses(spark.createDataFrame(raw, "query string, payload string")).cache()
    assert {r.query: r.kind for r in found.collect()} == {"5": "dancer", "n": "none", "c": "candidates", "c2": "candidates", "x": "error", "t": "none", "z": "none"}
    assert sorted((r.query, r.registry_id) for r in registry.candidates(found).collect()) == [("c", 7), ("c2", 8)]
    who = registry.dancers(found).first()
    assert (who.registry_id, who.primary_role, who.level_required, who.secondary_rule) == (5, "Leader", None, "rule")
    got = registry.newest_first(registry.placements(found)).collect()
    assert [(r.role, r.result, r.points, r.month) for r in got] == [("leader", "F", 1, "2026-05"), ("leader", "2", 3, "2025-06")]


def test_fetching(spark):
    """Against a server of this test: cookies, charsets, errors that go away, refusals, forms, and nobody there."""
    import http.server
    import threading

    from scorelark.sources import fetch

    seen: dict[str, int] = {}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen[self.path] = seen.get(self.path, 0) + 1
            code = 503 if self.path == "/late" and seen[self.path] < 3 or self.path == "/down" else 404 if self.path == "/none" else 200
            body = {"/latin": "é".encode("latin-1"), "/cookie": str(self.headers.get("Cookie")).encode(), "/": b'<a href="/results">Results</a>', "/results": b'<a href="https://eepro.com/results/x26/">x</a>'}.get(self.path, "ü �".encode())
            self.send_response(code)
            self.send_header("Content-Type", "text/html; charset=iso-8859-1" if self.path == "/latin" else "text/html; charset=unheard-of")
            self.send_header("Set-Cookie", "a=1")
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self):
            sent = self.rfile.read(int(self.headers["Content-Length"])).decode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"<html>" if "q=bad" in sent else f'{{"sent": "{sent}"}}'.encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        asked = spark.createDataFrame([(f"{base}{p}",) for p in ("/latin", "/cookie", "/late", "/down", "/none")] + [("http://127.0.0.1:9/x",), ("no address",)], "url string").coalesce(1)
        got = {r.url.removeprefix(base): (r.body, r.status, r.attempts, r.error) for r in fetch.fetch(asked, 5, (0.01, 0.01)).collect()}
        assert got["/latin"] == ("é", 200, 1, None) and got["/cookie"][0] == "a=1" and got["/late"] == ("ü �", 200, 3, None)
        assert got["/down"] == (None, 503, 3, "http 503") and got["/none"] == (None, 404, 1, "http 404")
        assert got["http://127.0.0.1:9/x"][1:3] == (None, 3) and got["http://127.0.0.1:9/x"][3].startswith("network") and got["no address"][3].startswith("network")
        forms = spark.createDataFrame([("5", f"{base}/find", {"q": "5"}), ("b", f"{base}/find", {"q": "bad"})], "query string, url string, form map<string,string>")
        found = {r.query: (r.payload, r.error) for r in fetch.registry(fetch.fetch(forms, 5, ())).collect()}
        assert found == {"5": ('{"sent": "q=5"}', None), "b": (None, "registry did not answer with JSON")}
        lists = spark.createDataFrame([("r1", "full", f"{base}/ok"), ("r1", "second", f"{base}/none"), ("r2", "full", f"{base}/none")], "run_id string, kind string, url string")
        both = {r.run_id: (r.full, r.second, r.error) for r in fetch.calendar(fetch.fetch(lists, 5, ())).collect()}
        assert both == {"r1": ("ü �", None, None), "r2": (None, None, "http 404")}
        assert [(r.provider, r.key) for r in fetch.crawl(spark.createDataFrame([(f"{base}/",)], "url string"), timeout=5, pauses=()).collect()] == [("eepro", "x26")]
    finally:
        server.shutdown()


def test_pages_share_tags_but_not_texts():
    """Trees of plain pages come from one split, and shared ones only get new texts."""
    plain = "<table><tr><td>%s</td><td class='x'>%s &amp; b</td></tr></table>"
    first = [[c.text() for c in r.own("td")] for r in dom.parse(plain % (1, "a"), shared=True).all("tr")]
    second = [[c.text() for c in r.own("td")] for r in dom.parse(plain % (2, "c"), shared=True).all("tr")]
    assert (first, second) == ([["1", "a & b"]], [["2", "c & b"]])
    odd = ["<td title='a>b'>x", "<p>1 < 2", "<script>if (a<b) c()</script><p>x", "<title>a &amp; b</title>", "<td a/ b>x", "<!-- <td>y --><td>z", "x &#65", "</p x>y"]
    for page in [plain % (3, "d"), *odd]:
        tree, builder = dom._Tree(), None
        builder = dom._Builder(tree)
        builder.feed(page)
        builder.close()
        shown = lambda n: [c if isinstance(c, str) else (c.tag, c.attrs, shown(c)) for c in n.children]  # noqa: E731, B023
        assert shown(dom.parse(page)) == shown(dom.parse(page, shared=True)) == shown(tree.root)


def test_table_functions_take_batches(spark):
    """Rows travel in Arrow batches, numbers too large for their column are null, and pages of one event need one exchange."""
    import os

    import pytest

    from scorelark import catalogue

    big = SHEET_2.replace("17901", "9" * 30)
    got = sheets.sheet_entries(spark.createDataFrame([("scoring_dance", "2", None, None, big)], "provider string, url string, title string, siblings array<string>, html string"))
    assert [r.registry_id for r in got.orderBy("section_no", "entry_no").collect()] == [None, None, None]
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("needs the driver's tables")
    plan = catalogue.QUERIES["q_sheet_prelims_3"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "BatchEvalPythonUDTF" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_replayed_pages_are_files_of_few_folders(spark, tmp_path, monkeypatch):
    """A file per page, and no folder per page."""
    import os

    from scorelark import catalogue
    from scorelark.queries import details

    spark.createDataFrame([(i, f"<p>{i}\n</p>") for i in range(30)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(details, "new_folder", lambda *_: str(tmp_path / "saved"))
    assert catalogue.QUERIES["q_replay"](spark, str(tmp_path)).distinct().count() == 30
    assert len([f for f in os.listdir(tmp_path / "saved") if f.endswith(".txt")]) == 30


def test_calendar_pages_are_read_once_and_ranges_parsed_once(spark):
    """A join of the pages with their own header reads all of them twice, and a filter that is moved below the range parses it for each time it is named."""
    pages = spark.createDataFrame([(k, CALENDAR) for k in range(3)] + [(None, CALENDAR)], "run_id int, html string")
    found = html.calendar_events(html.calendar_cells(pages)).where("error IS NULL")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    assert not any("yyyy-M-d" in line for line in plan.split("\n") if "Filter" in line)
    assert sorted((r.run_id is None, r.name) for r in found.collect()) == sorted((k is None, n) for k in (0, 1, 2, None) for n in ("River Nights", "Lake Open aka LO", "Short row"))


def test_calendar_tables_inside_cells_and_columns_that_are_missing(spark):
    page = "<table><tr><td>menu<table><tr><td>x</table></table><table><tr><td>Event<td>DATE<tr><td>A<table><tr><td>Date<td>Event<tr><td>no<td>no</table><td>May 1, 2026<tr><th>Event<th>Date<tr><td>B</table><table><tr><th>Date<th>Event<tr><td>late<td>late</table>"
    rows = html.calendar_cells(one(spark, "string", run_id="r", html=page)).orderBy("row_index").collect()
    assert [(r.row_index, r.name_cell.split()[0], r.date_raw, r.location_raw, r.flag_text) for r in rows] == [(1, "A", "May 1, 2026", None, None), (3, "B", None, None, None)]


def test_year_index_reads_pages_once(spark):
    pages = spark.createDataFrame([("https://eepro.com/results/2026/", YEAR)], "url string, html string")
    found = html.year_index(pages)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_plain_links_are_joined_like_others():
    from urllib.parse import urljoin

    for base in ("https://a.example/x/y?z#f", "http://a.example", "ftp://a.example/x", "HTTP://A.example:80/", "", "//a.example/x", "file:///x"):
        for href in ("/results/s1/a.html", "/a/", "/", "/a//b", "/a/./b", "/a/../b", "/.a", "/a.", "/a?b", "/a;b", "/a#c", "//b.example/c", "x/y", "", "/ä", "/a\n"):
            assert html.absolute(base, href) == urljoin(base, href)
