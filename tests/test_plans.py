"""Whole plans: competitor analytics, the catalog service, a synchronisation in two days, jobs and streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from scorelark import schemas
from scorelark.operators import changes
from scorelark.plans import dancer, jobs, service, sync
from scorelark.sinks.tables import Snapshots
from scorelark.streaming import ingest


def d(s):
    return datetime.date.fromisoformat(s)


ENTRIES = "sheet_url string, event_id string, event_key string, event_name string, start_date date, section string, division string, round string, role string, normalized_name string, registry_id long, marks map<string,string>, bib string, partner_name string, rank int, place int, competed int, score double, advanced boolean, alternate string, city string, region string, country string"


def entry(url, event, date, round_, role, marks, place=None, advanced=None, name="ann lee"):
    return (url, event, event, event.upper(), d(date), None, "Novice", round_, role, name, None, marks, None, None, None, place, 20, None, advanced, None, None, None, None)


@pytest.fixture(scope="module")
def results(spark):
    rows = [
        entry("u1", "e1", "2026-01-10", "prelims", "follower", {"A": "Y", "B": "A1", "C": "N", "D": "Y"}, advanced=True), entry("u2", "e1", "2026-01-10", "finals", "follower", {"A": "3", "B": "1", "C": "2"}, place=2),
        entry("u3", "e2", "2026-03-01", "prelims", "follower", {"A": "N", "B": "A", "C": "A3"}, advanced=False), entry("u4", "e2", "2026-03-01", "prelims", "leader", {"A": "Y", "B": "Y"}), entry("u5", "e3", "2026-04-01", "prelims", "leader", {"A": "A"}), entry("u1", "e1", "2026-01-10", "prelims", "follower", {"A": "Y"}, name="other"),
    ]
    registry = spark.createDataFrame([("e1", "e1", "follower", "Novice", "2", 6, 1), ("e9", "e9", "follower", "Novice", "F", 1, 2)], "event_id string, event_key string, role string, division string, result string, points int, seq int")
    aliases = spark.createDataFrame([("a", "ann judge", "Ann Judge", "exact"), ("b", "ann judge", "Ann Judge", "needs_review")], "alias_norm string, judge_key string, judge_name string, method string")
    return dancer.results(spark.createDataFrame(rows, ENTRIES), "ann lee", None, registry, aliases)


def test_callbacks(results):
    got = {(r.event_key, r.role): (r.judges_marking, r.callback_points, r.callback_pct, r.yes, r.alt, r.no) for r in results["callbacks"].collect()}
    assert got[("e1", "follower")] == (4, 24.5, 61.2, 2, 1, 1)  # 61.25 goes to the even digit
    assert got[("e2", "follower")] == (2, 4.2, 21.0, 0, 1, 1) and got[("e2", "leader")] == (2, 20.0, 100.0, 2, 0, 0)
    assert got[("e3", "leader")] == (0, None, None, 0, 0, 0)


def test_summaries(results):
    s = results["summary"].first()
    assert (s.callback_rounds, s.callback_rounds_advanced, s.advancement_rate, s.avg_callback_pct) == (3, 1, 50.0, 60.7)
    assert (s.finals_made, s.best_final_place, s.best_final_label, s.points) == (2, 2, "2nd", 7)
    by = {r.role: r for r in results["summary_by_role"].collect()}
    assert by["follower"].avg_callback_pct == 41.1 and by["leader"].finals_made == 0 and by["leader"].best_final_label is None
    finals = {(r.event_id, r.source): (r.place, r.points, r.result_label) for r in results["finals"].collect()}
    assert finals == {("e1", "scoresheets+registry"): (2, 6, "2nd"), ("e9", "registry"): (None, 1, "Finalist")}
    roles = results["roles"].first()
    assert (roles.primary_role, roles.primary_points, roles.secondary_role, roles.competed_roles) == ("follower", 7, "leader", ["follower", "leader"])
    assert {(r.division, r.points, r.results) for r in results["points"].collect()} == {(None, 7, 2), ("Novice", 7, 2)}


def test_judges_are_one_person_under_two_names(results):
    j = {r.judge_key: r for r in results["judges"].collect()}
    a = j["ann judge"]
    assert (a.listed_as, a.events_judged, a.needs_review) == (["A", "B"], 3, True)
    assert (a.callback_marks, a.yes, a.alt, a.no, a.finals_judged, a.avg_finals_placement) == (5, 3, 1, 1, 2, 2.0) and a.yes_rate == 60.0 and a.avg_points == 6.9
    div = {(r.event_key, r.role): (r.furthest_round, r.final_place, len(r.rounds)) for r in results["divisions"].collect()}
    assert div[("e1", "follower")] == ("finals", 2, 2) and div[("e2", "leader")] == ("prelims", None, 1)


def empty(spark, table):
    return spark.createDataFrame([], schemas.TABLES[table])


CALENDAR = "row_index int, name string, normalized_name string, canonical_name string, aliases array<string>, event_status string, hiatus boolean, start_date date, end_date date, location_raw string, city string, region string, country string, country_raw string, website_url string, confirmation_status string"


def listing(spark, rows):
    return spark.createDataFrame([(i, n, n.lower(), n, al, "registry", False, d(a), d(b), None, None, None, c, None, None, conf) for i, (n, al, a, b, c, conf) in enumerate(rows)], CALENDAR)


def test_two_days(spark):
    day1 = [("River Nights", ["RN"], "2026-05-01", "2026-05-03", "USA", "confirmed"), ("River Nights", [], "2027-05-01", "2027-05-03", "USA", "confirmed"), ("Lake Open", [], "2026-02-01", "2026-02-02", "SWE", "confirmed"), ("Lake Open", [], "2026-02-01", "2026-02-02", "SWE", "confirmed"), ("Gone Fest", [], "2026-09-01", "2026-09-02", None, "confirmed"), ("Over Fest", [], "2026-03-01", "2026-03-02", None, "confirmed")]
    t1 = datetime.datetime(2026, 4, 1)
    one = sync.sync(listing(spark, day1), empty(spark, "events"), empty(spark, "event_series"), empty(spark, "event_aliases"), t1)
    assert one["events"].count() == 5 and one["skipped"].count() == 1 and one["event_series"].count() == 4 and one["event_aliases"].count() == 1
    assert changes.counters(one["changes"]).first().added == 5
    again = sync.sync(listing(spark, day1), one["events"], one["event_series"], one["event_aliases"], t1, previous=6)
    assert changes.counters(again["changes"]).first().unchanged == 5
    assert {r.id for r in again["events"].collect()} == {r.id for r in one["events"].collect()}
    day2 = [("River Nights", [], "2026-05-08", "2026-05-10", "USA", "unknown"), ("River Nights", [], "2027-05-01", "2027-05-03", "USA", "confirmed"), ("Lake Open", [], "2026-02-01", "2026-02-02", "SWE", "unconfirmed"), ("New One", [], "2026-10-10", "2026-10-11", None, "confirmed")]
    two = sync.sync(listing(spark, day2), one["events"], one["event_series"], one["event_aliases"], datetime.datetime(2026, 4, 2), previous=6)
    log = changes.counters(two["changes"]).first()
    assert (log.added, log.updated, log.unchanged, log.unseen) == (1, 2, 1, 2)
    moved = {r.start_date: r.id for r in one["events"].where("name = 'River Nights'").collect()}[d("2026-05-01")]
    after = {r.id: r for r in two["events"].collect()}
    assert after[moved].start_date == d("2026-05-08") and after[moved].confirmation_status == "confirmed"  # the id stays, the unknown list changes nothing
    life = {r.name: (r.active, r.lifecycle_status) for r in after.values()}
    assert life["Gone Fest"] == (False, "missing_from_source") and life["Over Fest"] == (False, "past")
    with pytest.raises(changes.GuardTripped):
        sync.sync(listing(spark, day2[:1]), one["events"], one["event_series"], one["event_aliases"], t1, previous=30)


@pytest.fixture(scope="module")
def catalog(spark):
    def table(name, rows, columns):
        df = spark.createDataFrame(rows, columns)
        have = {c.split()[0] for c in columns.split(", ")}
        return df.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in empty(spark, name).schema if f.name not in have))

    ev = [("e1", "s1", "River Nights", d("2026-05-01"), d("2026-05-03"), 2026, "day", "USA", "listed", True, None), ("e2", "s1", "River Nights", d("2027-05-01"), d("2027-05-03"), 2027, "day", "USA", "listed", True, None), ("e3", "s2", "Lake Open", d("2026-02-01"), d("2026-02-02"), 2026, "day", "SWE", "past", False, None), ("e4", "s2", "Lake Old", d("2026-02-01"), d("2026-02-02"), 2026, "day", "SWE", "past", False, "e3")]
    now = datetime.datetime(2026, 6, 1)
    return {
        "events": table("events", ev, "id string, series_id string, name string, start_date date, end_date date, year int, date_precision string, country string, lifecycle_status string, active boolean, merged_into string").withColumn("normalized_name", F.lower("name")),
        "event_series": table("event_series", [("s1", "River Nights", "river nights"), ("s2", "Lake Open", "lake open")], "id string, canonical_name string, normalized_name string"),
        "event_aliases": table("event_aliases", [("s1", "RN", "rn"), ("s2", "Big Lake Festival", "big lake festival")], "series_id string, alias string, normalized_alias string"),
        "provider_events": table("provider_events", [("eepro", "rn26", "e1", "River Nights", d("2026-05-01")), ("eepro", "lake", None, "Lake Open", d("2026-02-03"))], "provider string, provider_key string, event_id string, name string, start_date date"),
        "website_checks": table("website_checks", [("e1", "ok")], "event_id string, status string"),
        "event_external_refs": table("event_external_refs", [("eepro", "rn26", "e1")], "source string, external_id string, event_id string"),
        "scoresheet_sheets": table("scoresheet_sheets", [("u1", "eepro", "rn26", "parsed", 2, now), ("u2", "eepro", "lake", "parsed", 1, now)], "url string, provider string, provider_event_key string, status string, parser_version int, fetched_at timestamp"),
        "scoresheet_entries": table("scoresheet_entries", [("u1", "e1", "ann lee"), ("u9", None, "ann lee")], "sheet_url string, event_id string, normalized_name string"),
    }


def test_event_list(catalog):
    ids = lambda **k: [r.id for r in service.events(catalog, **k)["page"].collect()]
    assert ids() == ["e3", "e1", "e2"] and ids(year="2026", country="usa") == ["e1"] and ids(results_available="yes") == ["e1"] and ids(q="Big Lake!") == ["e3"]
    assert ids(since="2026-05-03", until="2026-12-31") == ["e1"] and ids(limit=1, offset=1) == ["e1"] and service.events(catalog, active="no")["total"].first().total == 1
    e = service.event(catalog, "e4").first()
    assert (e.id, e.requested_id, e.results_available, e.aliases) == ("e3", "e4", False, ["Big Lake Festival"])
    assert [r.id for r in service.series(catalog, "s1")["events"].collect()] == ["e1", "e2"]


def test_requests(spark, catalog):
    q = spark.createDataFrame([(1, "River Nights 2026", d("2026-05-02"), None, None, None), (2, "River Nights", None, None, None, None), (3, "RN", d("2026-05-01"), None, "USA", None), (4, "Nothing Known", None, None, None, None)], "request_id int, name string, q_date date, q_year int, q_country string, q_city string")
    got = {r.request_id: (r.status, r.event_id, r.ok) for r in service.resolve(catalog, q).collect()}
    assert got == {1: ("resolved", "e1", True), 2: ("ambiguous", None, False), 3: ("resolved", "e1", True), 4: ("not_found", None, True)}


def test_lookup_and_coverage(catalog):
    now = F.lit(datetime.datetime(2026, 6, 1, 0, 30))
    got = {r.id: (r.status, r.entries) for r in service.lookup(catalog, ["e1", "e2", "e3"], "ann lee", now).collect()}
    assert got == {"e1": ("found", 1), "e2": ("no_sheets", 0), "e3": ("stale", 0)}
    with pytest.raises(ValueError, match="at most"):
        service.lookup(catalog, list("abcdefghijk"), "x", now)
    years = {r.year: (r.events, r.sheets) for r in service.coverage(catalog["provider_events"], catalog["scoresheet_sheets"])["years"].collect()}
    assert years == {2026: (2, 2)}
    assert [r.event_name for r in service.search_sheets(catalog["scoresheet_entries"], catalog["events"], "ann lee").collect()] == ["River Nights", None]


def test_jobs():
    now = datetime.datetime(2026, 1, 1)
    runs = jobs.Runs()
    row = runs.begin("calendar", now)
    with pytest.raises(jobs.AlreadyRunning):
        runs.begin("calendar", now + datetime.timedelta(hours=1))
    runs.begin("calendar", now + datetime.timedelta(hours=3))
    assert row["status"] == "failed" and runs.interrupted(now) == 1
    done = jobs.run_steps(runs, "daily", [("a", lambda: 1), ("b", lambda: 1 / 0), ("c", lambda: 3)], lambda: now)
    assert done["status"] == "failed" and done["steps"]["c"] == {"ok": True, "result": 3} and "b: " in done["errors"][0]
    assert runs.due("daily", datetime.timedelta(days=1), now)
    jobs.run_steps(runs, "daily", [("a", lambda: 1)], lambda: now)
    assert not runs.due("daily", datetime.timedelta(days=1), now) and runs.due("daily", datetime.timedelta(days=1), now + datetime.timedelta(days=1))


def test_upgrades(spark):
    v1 = spark.createDataFrame([("a",)], "id string")
    assert schemas.upgraded("events", v1, 1).columns == ["id", "date_precision", "merged_into"] and schemas.upgraded("events", v1, 3).columns == ["id"]


def test_stream_corrects_what_came_before(spark, tmp_path):
    table, land = Snapshots(spark, f"{tmp_path}/t"), f"{tmp_path}/land"
    schema = "url string, html string, fetched_at timestamp"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(land)
    t = datetime.datetime
    put([("a", "old", t(2026, 1, 1)), ("b", "x", t(2026, 1, 1))])

    def run():
        ingest.upsert_stream(ingest.read_landing(spark, land, schema), table, ["url"], "fetched_at", f"{tmp_path}/cp").awaitTermination(120)
        return {r.url: r.html for r in table.read().collect()}

    assert run() == {"a": "old", "b": "x"}
    put([("a", "new", t(2026, 1, 3)), ("c", "y", t(2026, 1, 2))])
    assert run() == {"a": "new", "b": "x", "c": "y"} == run()


def test_stored_runs_outlive_the_program(spark, tmp_path):
    t = datetime.datetime
    one, two = jobs.StoredRuns(spark, f"{tmp_path}/runs"), jobs.StoredRuns(spark, f"{tmp_path}/runs")
    first = one.begin("calendar", t(2026, 1, 1, 8))
    with pytest.raises(jobs.AlreadyRunning):
        two.begin("calendar", t(2026, 1, 1, 9))
    other = two.begin("index", t(2026, 1, 1, 9))
    assert {first["id"], other["id"]} == {1, 2}
    taken = two.begin("calendar", t(2026, 1, 1, 10, 1))  # the first program never came back
    two.end(taken, t(2026, 1, 1, 11), "success", steps={"a": 1})
    later = jobs.StoredRuns(spark, f"{tmp_path}/runs")
    assert [(r["id"], r["source"], r["status"]) for r in later.rows] == [(1, "calendar", "failed"), (2, "index", "running"), (3, "calendar", "success")]
    assert later.interrupted(t(2026, 1, 2)) == 1 and not later.due("calendar", datetime.timedelta(days=1), t(2026, 1, 1, 12))
    again = jobs.StoredRuns(spark, f"{tmp_path}/runs")
    assert [r["status"] for r in again.rows] == ["failed", "failed", "success"]
    again.end(again.begin("index", t(2026, 1, 2, 1)), t(2026, 1, 2, 2), "success")


def test_a_stale_lock_is_taken_over_once(spark, tmp_path):
    """One program takes the lock over between the other's reading and writing."""
    t = datetime.datetime
    one, two, three = (jobs.StoredRuns(spark, f"{tmp_path}/runs") for _ in range(3))
    one.begin("calendar", t(2026, 1, 1, 8))
    write, ran = three._write, []

    def late(*args):
        if not ran:
            ran.append(two.begin("calendar", t(2026, 1, 1, 11)))
        return write(*args)

    three._write = late
    with pytest.raises(jobs.AlreadyRunning):
        three.begin("calendar", t(2026, 1, 1, 11))
    with pytest.raises(jobs.AlreadyRunning):
        one.begin("calendar", t(2026, 1, 1, 11, 5))
    two.end(ran[0], t(2026, 1, 1, 11, 30), "success")
    one.end(one.begin("calendar", t(2026, 1, 1, 11, 31)), t(2026, 1, 1, 11, 32), "success")


def test_rechecks_as_a_stream(spark, tmp_path):
    """In several batches with restarts between them: what has been sent out since its last check is what the batch rule chose at that moment, and all
    that it chooses now is among it; a late correction of an event's end moves its timer."""
    import random

    from pyspark.sql import functions as F

    from scorelark.operators import scans
    from scorelark.streaming import rechecks

    rng = random.Random(23)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "key string, checked_at timestamp, end_date date"
    start, land = datetime.datetime(2026, 3, 1, 12), str(tmp_path / "land")
    ends = {f"k{i}": start.date() + datetime.timedelta(days=rng.randint(-60, 10)) for i in range(25)} | {"none": None}
    told, log = {}, []
    for batch in range(4):
        now = start + datetime.timedelta(days=3 * batch)
        if batch == 2:
            ends["k0"] = now.date()  # a correction: the event is later than was thought
        rows = [(k, now + datetime.timedelta(minutes=rng.randint(-600, 0)), ends[k]) for k in ends if batch == 0 or k == "k0" and batch == 2 or rng.random() < 0.3]
        rows.append(("clock", now, None))
        log += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(land)
        stream = rechecks.rechecks(spark.readStream.schema(schema).parquet(land))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(180)
    now = start + datetime.timedelta(days=9)
    checked, end = {}, {}
    for k, at, e in log:
        if k not in checked or at >= checked[k]:
            checked[k], end[k] = at, e
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        told.setdefault(r.key, []).append((r.due_at, r.checked_at))
    sent = {k for k, v in told.items() if any(c == checked[k] for _, c in v)}
    events = spark.createDataFrame([(k, "http://x.example/" + k, None, datetime.date(2000, 1, 1), e) for k, e in end.items()], "id string, website_url string, merged_into string, start_date date, end_date date")
    # an event without an end counts by its start in the batch rule, long ago here
    due = scans.websites_due(events, spark.createDataFrame([(k, at) for k, at in checked.items()], "event_id string, checked_at timestamp"), F.lit(now).cast("timestamp"), 1000)
    due = {r.id for r in due.collect()}
    assert due <= sent and 3 < len(due) and len(sent) < len(checked)

    def chosen(k, at):
        """The batch rule at that moment."""
        recent = (end[k] or datetime.date(2000, 1, 1)) >= at.date() - datetime.timedelta(days=21)
        return checked[k] < at - (datetime.timedelta(hours=20) if recent else datetime.timedelta(days=7))

    # what is no longer due by now was so when it was sent out
    assert all(chosen(k, at + datetime.timedelta(milliseconds=1)) for k in sent for at, c in told[k] if c == checked[k])
    assert not any(chosen(k, now) for k in checked if k not in sent)
    assert any(len(v) > 1 for v in told.values())  # sent out again while nobody looked
    assert rechecks.due_at(0, None) == rechecks.RECHECK_MS and rechecks.due_at(0, 0) == rechecks.RECENT_MS
