"""Matching, merging, judges, changes, scans and sinks."""

import datetime
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from scorelark import session
from scorelark.operators import changes, components, dedupe, filters, increments, judges, matching, occurrences, paging, resolver, scans, trigrams
from scorelark.sinks import snapshots, tables


def d(s):
    return datetime.date.fromisoformat(s)


EVENTS = "id string, series_id string, name string, source string, start_date date, end_date date, date_precision string, created_at int, merged_into string, country string, website_url string, city string, region string, active boolean, year int"


def events(spark, rows):
    full = [(i, s, n, src, d(a), d(b), p, c, None, None, None, city, None, True, d(a).year) for i, s, n, src, a, b, p, c, city in rows]
    return spark.createDataFrame(full, EVENTS)


def test_filters_validate():
    assert filters.as_bool("YES") and not filters.as_bool(0) and filters.as_int("7", "x") == 7
    for bad in (lambda: filters.as_bool("maybe"), lambda: filters.as_int("x", "year"), lambda: filters.as_enum("zzz", "event_status")):
        with pytest.raises(filters.InvalidFilter):
            bad()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in parent}


def test_same_event_of_two_sources_is_merged_once(spark):
    e = events(spark, [
        ("a", "s1", "Swingtacular", "eepro", "2026-08-06", "2026-08-09", "day", 2, None),
        ("b", "s2", "Swingtacular: The Galactic Open", "registry", "2026-08-01", "2026-08-01", "month", 1, "Burlingame"),
        ("c", "s3", "WCS Festival", "calendar", "2026-10-15", "2026-10-17", "day", 3, None),
        ("d", "s3", "WCS Festival", "calendar", "2026-10-16", "2026-10-18", "day", 4, None),
        ("e", "s4", "Swingtacular", "wdr", "2027-01-02", "2027-01-03", "day", 5, None),
    ])
    merged = dedupe.merges(e, dedupe.edges(e))
    assert [(r.keep, r["drop"]) for r in merged.collect()] == [("a", "b")]
    after = dedupe.merge_events(e, merged)
    got = {r.id: r for r in after.collect()}
    assert got["b"].merged_into == "a" and not got["b"].active and got["a"].city == "Burlingame" and got["a"].date_precision == "day"
    assert dedupe.edges(after).count() == 0  # again: nothing left to do
    child = spark.createDataFrame([("b", 1), ("a", 2), ("z", 3)], "event_id string, n int")
    assert sorted((r.event_id, r.n) for r in dedupe.repoint(child, merged).collect()) == [("a", 1), ("a", 2), ("z", 3)]
    assert sorted((r.event_id, r.n) for r in dedupe.repoint_unique(child, merged, ["n"]).collect()) == [("a", 2), ("z", 3)]
    assert [(r.old, r.new) for r in dedupe.chain(after).collect()] == [("b", "a")]


def sequential_merges(nodes, edges):
    """A plain double loop over all pairs in order; nodes: (id, start_date, precision, source, created_at)."""
    order = [x[0] for x in sorted(nodes, key=lambda x: (x[1], x[0]))]
    rank = {x[0]: (matching.PRECISION_RANK[x[2]], matching.SOURCE_RANK[x[3]], x[4], x[0]) for x in nodes}
    met = set(edges) | {(b, a) for a, b in edges}
    later = {a: [] for a in order}
    place = {a: i for i, a in enumerate(order)}
    for a, b in met:
        if place[a] < place[b]:
            later[a].append(b)
    gone, out = set(), []
    for a in order:
        for b in sorted(later[a], key=place.__getitem__):
            if a not in gone and b not in gone:
                keep, drop = sorted((a, b), key=rank.__getitem__)
                gone.add(drop)
                out.append((keep, drop))
    return out


def merge_frames(spark, nodes, edges):
    return spark.createDataFrame(nodes, "id long, start_date string, date_precision string, source string, created_at string"), spark.createDataFrame(edges, "a long, b long")


def test_merges_are_the_sequential_scan(spark):
    """Many components of several kinds at once: dense and sparse graphs, hubs that stay or go, chains."""
    rng = random.Random(4)
    nodes, edges = [], []
    for k in range(120):
        n = rng.randint(2, 14)
        at = range(1000 * k, 1000 * k + n)
        nodes += [(i, str(rng.randint(1, 4)), rng.choice(["day", "month", "year"]), rng.choice(["calendar", "eepro", "registry"]), str(rng.randint(1, 3))) for i in at]
        shape = rng.choice(["sparse", "dense", "hub", "chain"])
        pairs = {"hub": [(at[0], b) for b in at[1:]], "chain": list(zip(at, at[1:], strict=False))}.get(shape) or [p for p in itertools.combinations(at, 2) if rng.random() < (0.8 if shape == "dense" else 0.3)]
        edges += [p if rng.random() < 0.5 else p[::-1] for p in pairs]
    hub = 10**6
    nodes += [(hub, "9", "month", "registry", "1")] + [(hub + i, str(rng.randint(1, 9)), rng.choice(["day", "year"]), "eepro", str(i)) for i in range(1, 3000)]
    edges += [(hub, hub + i) for i in range(1, 3000)] + [(hub + i, hub + i + 1) for i in range(1, 2000, 2)]
    got = dedupe.merges(*merge_frames(spark, nodes, edges + edges[:50])).orderBy("step").collect()
    expected = sequential_merges(nodes, edges)
    assert len(got) == len(expected) and {(r.keep, r["drop"]) for r in got} == set(expected)
    mine = [(r.keep, r["drop"]) for r in got if r.keep >= hub]
    assert mine == [p for p in expected if p[0] >= hub]  # in the published order


def test_merges_of_nothing(spark):
    assert dedupe.merges(*merge_frames(spark, [], [])).count() == 0
    assert dedupe.merges(*merge_frames(spark, [(1, "1", "day", "eepro", "1")], [(1, 1), (1, 7)])).count() == 0


def test_rows_are_numbered_in_order(spark):
    rng = random.Random(6)
    rows = [(rng.randint(0, 40), i) for i in range(500)]
    got = session.numbered(spark.createDataFrame(rows, "a int, b int").repartition(5), [F.desc("a"), "b"], "n").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.n)] == sorted(rows, key=lambda r: (-r[0], r[1])) and sorted(r.n for r in got) == list(range(1, 501))
    assert session.numbered(spark.createDataFrame([], "a int"), ["a"], "n").count() == 0


def test_a_frequent_key_is_cut_into_slots(spark):
    """A key with a third of all rows on both sides: the same pairs, and no place with more than a few times the pairs of the others."""
    rng = random.Random(2)
    key = lambda: "hot" if rng.random() < 0.33 else f"k{rng.randint(1, 60)}"
    left, right = ([(key(), i) for i in range(n)] for n in (900, 700))
    frames = spark.createDataFrame(left, "k string, a int"), spark.createDataFrame(right, "k string, b int")
    got = matching.even_join(*frames, ["k"], most=500)
    assert sorted(map(tuple, got.select("k", "a", "b").collect())) == sorted((k, a, b) for k, a in left for j, b in right if j == k)
    per = frames[0].groupBy("k").count().where("k = 'hot'").first()["count"] * frames[1].groupBy("k").count().where("k = 'hot'").first()["count"]
    assert per > 100 * 500  # so the hot key has more than a hundred slots, each of about 500 pairs


def test_related_pairs_of_names_with_a_word_that_a_third_have(spark):
    rng = random.Random(9)
    rows = []
    for i in range(240):
        words = [*(["gala"] if i % 3 == 0 else []), *rng.sample([f"w{k}" for k in range(30)], rng.randint(0 if i % 3 == 0 else 1, 2))]
        rows.append((f"e{i}", "s", " ".join(words).title(), rng.choice(["eepro", "wdr", "calendar"]), f"2026-0{rng.randint(1, 3)}-0{rng.randint(1, 9)}", "2026-04-01", rng.choice(["day", "month", "year"]), i, None))
    e = events(spark, rows)
    found = matching.related_pairs(e, e).select("a_id", "b_id")
    both = e.select(F.col("id").alias("a"), *(F.col(c).alias("a_" + c) for c in ("name", "source", "start_date", "end_date", "date_precision"))).crossJoin(e.select(F.col("id").alias("b"), *(F.col(c).alias("b_" + c) for c in ("name", "source", "start_date", "end_date", "date_precision"))))
    from scorelark.functions.dates import dates_compatible
    from scorelark.functions.text import names_related

    plain = both.where((F.col("a") != F.col("b")) & (F.col("a_source") != F.col("b_source")) & names_related(F.col("a_name"), F.col("b_name")) & dates_compatible(*(F.col(f"{p}_{c}") for p in "ab" for c in ("start_date", "end_date", "date_precision"))))
    assert sorted(map(tuple, found.collect())) == sorted((r.a, r.b) for r in plain.select("a", "b").collect()) and found.count() > 200


def test_related_event_prefers_precision_then_source(spark):
    e = events(spark, [("m", "s1", "River Nights", "registry", "2026-05-01", "2026-05-01", "month", 1, None), ("x", "s2", "River Nights Open", "eepro", "2026-05-08", "2026-05-10", "day", 3, None), ("y", "s3", "The River Nights", "calendar", "2026-05-09", "2026-05-10", "day", 4, None)])
    wanted = events(spark, [("w", "s", "River Nights", "manual", "2026-05-07", "2026-05-07", "day", 1, None)])
    assert [(r.id, r.related_id) for r in matching.find_related(wanted, e).collect()] == [("w", "y")]


def test_occurrences_are_taken_once_and_nearest(spark):
    e = events(spark, [("a", "s", "X", "calendar", "2026-05-01", "2026-05-02", "day", 1, None), ("b", "s", "X", "calendar", "2026-05-15", "2026-05-16", "day", 2, None)])
    rows = spark.createDataFrame([(1, 1, "s", d("2026-05-08"), None), (2, 2, "s", d("2026-05-02"), None), (3, 3, "s", d("2026-06-30"), None)], "row_id int, row_index int, series_id string, start_date date, country string")
    got = {r.row_id: (r.id, r["diff"], r.ambiguous) for r in occurrences.match_occurrences(rows, e).collect()}
    assert got == {1: ("a", 7, True), 2: ("b", 13, False)}


def test_occurrences_are_the_sequential_scan(spark):
    """Many series at once, one with most rows and competing dates, countries that don't fit, rows and events that tie."""
    rng = random.Random(17)
    start = d("2026-01-01")
    day = lambda: start + datetime.timedelta(days=rng.randint(0, 300))
    country = lambda: rng.choice([None, None, "USA", "CAN"])
    series = lambda: "s0" if rng.random() < 0.4 else f"s{rng.randint(1, 30)}"
    held = [(f"e{i}", series(), day(), rng.randint(1, 5), country()) for i in range(300)]
    listed = [(i, rng.randint(1, 300), series(), day(), country()) for i in range(500)]
    e = spark.createDataFrame([(i, s, "n", "calendar", a, a, "day", c, None, k, None, None, None, True, 2026) for i, s, a, c, k in held], EVENTS)
    rows = spark.createDataFrame(listed, "row_id int, row_index int, series_id string, start_date date, country string")
    expected, taken = {}, set()
    for row, _, s, a, k in sorted(listed, key=lambda r: (r[1], r[0])):
        free = sorted((abs((a - b).days), str(c), i) for i, t, b, c, l in held if t == s and i not in taken and abs((a - b).days) <= 21 and (k is None or l is None or k == l))  # noqa: E741
        if free:
            taken.add(free[0][2])
            expected[row] = (free[0][2], free[0][0], free[0][0] > 0 and len(free) > 1 and free[1][0] == free[0][0])
    got = {r.row_id: (r.id, r["diff"], r.ambiguous) for r in occurrences.match_occurrences(rows, e).collect()}
    assert got == expected and len(got) > 150


def test_series_short_alias_is_not_enough(spark):
    series = spark.createDataFrame([("s1", "the after party", 1), ("s2", "long name fest", 2)], "id string, normalized_name string, created_at int")
    aliases = spark.createDataFrame([("s1", "tap"), ("s2", "lnf festival")], "series_id string, normalized_alias string")
    rows = spark.createDataFrame([(1, "TAP", []), (2, "LNF Festival", []), (3, "The After Party", ["LNF Festival"]), (4, "New", ["Tap"])], "row_id int, canonical_name string, aliases array<string>")
    got = {r.row_id: r.series_id for r in occurrences.find_series(rows, series, aliases).collect()}
    assert got == {1: None, 2: "s2", 3: "s1", 4: None}


def test_import_and_registry_links(spark):
    e = events(spark, [("m", "s1", "River Nights", "registry", "2026-05-01", "2026-05-01", "month", 1, None), ("n", "s2", "Lake Open", "calendar", "2026-03-05", "2026-03-08", "day", 2, None)])
    series = spark.createDataFrame([("s1", "river nights", 1), ("s2", "lake open", 2)], "id string, normalized_name string, created_at int")
    aliases = spark.createDataFrame([("s1", "rivernights long")], "series_id string, normalized_alias string")
    rows = [(1, 1, "River Nights", "2026-05-20", "day"), (2, 2, "Lake Open", "2026-03-10", "day"), (3, 3, "Lake Open", "2026-09-09", "day"), (4, 4, "Lake Open", "2026-01-01", "year"), (5, 5, "Unheard Of", "2026-01-01", "day")]
    df = spark.createDataFrame([(i, k, n, n, [], "eepro", d(s), d(s), p, None) for i, k, n, s, p in rows], "row_id int, row_index int, name string, canonical_name string, aliases array<string>, source string, start_date date, end_date date, date_precision string, country string")
    got = {r.row_id: r for r in occurrences.import_events(df, series, aliases, e).collect()}
    assert (got[1].event_id, got[1].upgrade) == ("m", True) and got[2].event_id == "n" and got[4].event_id == "n"
    assert got[3].status == "created" and got[3].series_id == "s2" and got[5].series_status == "new" and got[5].event_id.startswith("evt_")
    refs = spark.createDataFrame([("registry", "77", "s2")], "source string, external_id string, series_id string")
    reg = spark.createDataFrame([(1, "77", "Renamed", "Renamed", [], d("2026-03-01")), (2, "5", "River Nights", "River Nights", [], d("2026-05-01")), (3, None, "", "", [], None), (4, "9", "Other", "Other", [], d("2020-01-01"))], "row_id int, external_id string, name string, canonical_name string, aliases array<string>, month date")
    links = {r.row_id: (r.series_id, r.event_id, r.status) for r in occurrences.link_registry(reg, refs, series, aliases, e).collect()}
    assert links[1] == ("s2", "n", "matched") and links[2] == ("s1", "m", "matched") and links[3] == (None, None, "unmatched") and links[4][2] == "created"


RESOLVE = "request_id int, q_name string, q_date date, q_year int, q_country string, q_city string, event_id string, series_norm string, name_norm string, alias_norms array<string>, start_date date, year int, country string, city string"


def test_resolver(spark):
    base = ("e1", "the after party", "the after party", ["tap", "after party aka tap"], d("2026-12-03"), 2026, "USA", "Irvine")
    cases = [
        ((1, "the after party", d("2026-12-04"), None, "USA", None), 1.0), ((2, "tap", None, None, None, None), 0.3), ((3, "tap", d("2026-12-03"), None, "USA", "irvine"), 0.75),
        ((4, "after party", None, 2026, None, None), 0.483), ((5, "the after party", d("2027-12-03"), None, None, None), 0.4), ((6, "something else", d("2026-12-03"), None, "USA", None), 0.0), ((7, "the after party", None, 2025, "CAN", None), 0.0),
    ]
    df = spark.createDataFrame([(*q, *base) for q, _ in cases], RESOLVE)
    got = {r.request_id: r.score for r in resolver.score(df).collect()}
    assert got == {q[0]: pytest.approx(s) for q, s in cases}
    ranked = resolver.candidates(resolver.score(df))
    status = {r.request_id: r.status for r in resolver.answer(resolver.decide(df.select("request_id"), ranked)).collect()}
    assert status == {1: "resolved", 2: "ambiguous", 3: "resolved", 4: "ambiguous", 5: "ambiguous", 6: "not_found", 7: "not_found"}
    two = df.where("request_id = 1").unionByName(df.where("request_id = 1").withColumn("event_id", F.lit("e2")))
    assert resolver.decide(df.select("request_id").where("request_id = 1"), resolver.candidates(resolver.score(two))).first().status == "ambiguous"


PANELS = [
    ("p1", ["Lisa M Picard", "Mike Smith", "Tren", "Chris Dumond", "Naomi"]), ("p2", ["Lisa Picard", "Michael Smith", "Trendlyon Veal", "Sam Vaden"]),
    ("p3", ["Christopher Dumond", "Sam Lee", "Samantha Lee", "Sam", "Naomi Uyama", "Naomi Other"]),
]


def judge_marks(spark, panels=PANELS):
    return spark.createDataFrame([(p, "s", n) for p, names in panels for n in names], "sheet_url string, section string, judge string")


def test_judges(spark):
    got = {r.alias_norm: r for r in judges.rebuild(judge_marks(spark)).collect()}
    assert got["lisa m picard"].judge_key == got["lisa picard"].judge_key == "lisa m picard" and got["lisa picard"].method == "middle_name"
    assert got["mike smith"].judge_key == got["michael smith"].judge_key and got["mike smith"].method == "nickname"
    assert got["chris dumond"].judge_key == got["christopher dumond"].judge_key
    assert got["tren"].judge_key == "trendlyon veal" and (got["tren"].method, got["tren"].confidence) == ("first_name_only", "medium")
    assert got["sam lee"].judge_key != got["samantha lee"].judge_key  # one panel
    assert got["naomi"].method == "needs_review" and got["naomi"].candidates == ["Naomi Other", "Naomi Uyama"]
    assert got["sam"].judge_key == "sam vaden"  # the Lees sat beside Sam
    over = spark.createDataFrame([(1, "separate", "Mike Smith", "Michael Smith"), (2, "merge", "Naomi", "Naomi Uyama")], "id int, action string, name_a string, name_b string")
    after = {r.alias_norm: r for r in judges.rebuild(judge_marks(spark), over).collect()}
    assert after["mike smith"].judge_key != after["michael smith"].judge_key and after["naomi"].judge_key == "naomi uyama" and after["naomi"].method == "manual"
    listed = {r.judge_key: r for r in judges.judge_list(judges.rebuild(judge_marks(spark))).collect()}
    assert listed["lisa m picard"].panels == 2 and len(listed["lisa m picard"]["names"]) == 2
    assert [r.name for r in judges.review_list(judges.rebuild(judge_marks(spark))).collect()] == ["Naomi"]


def sequential_identities(nodes, pairs, apart, forced):
    """One name after the other.  nodes: name -> (panels, display); forced: merges by hand in order."""
    cluster, how, review = {n: {n} for n in nodes}, {}, {}
    foe = {frozenset(p) for p in apart}
    clash = lambda a, b: any(frozenset((x, y)) in foe for x in cluster[a] for y in cluster[b])

    def join(a, b, kind):
        if cluster[a] is not cluster[b]:
            both = cluster[a] | cluster[b]
            for n in both:
                cluster[n] = both
            how.setdefault(a, kind)
            how.setdefault(b, kind)

    for a, b in forced:
        join(a, b, "manual")
    for a, b, kind in sorted(p for p in pairs if p[2] != "single"):
        if not clash(a, b):
            join(a, b, kind)
    for lone in sorted({b for _, b, kind in pairs if kind == "single"}):
        options = []
        for full in sorted(a for a, b, kind in pairs if kind == "single" and b == lone):
            if not clash(lone, full) and all(cluster[full] is not cluster[o] for o in options):
                options.append(full)
        if len(options) == 1:
            join(options[0], lone, "single")
        elif options:
            review[lone] = sorted(nodes[o][1] for o in options)
    out = {}
    for n, (panels, display) in nodes.items():
        best = max(cluster[n], key=lambda m: (m.count(" "), nodes[m][0], m))
        kind = how.get(n) if len(cluster[n]) > 1 else None
        open_ = n in review and len(cluster[n]) == 1
        out[n] = (display, best, nodes[best][1], "needs_review" if open_ else judges.METHODS.get(kind, "exact"), "low" if open_ else judges.REASONS[kind][0] if kind else "high", review.get(n), panels)
    return out


def identity_rows(df):
    return {r.alias_norm: (r.alias_name, r.judge_key, r.judge_name, r.method, r.confidence, r.candidates, r.panels) for r in df.collect()}


def test_identities_are_the_sequential_scan(spark):
    """Random graphs of candidates, panels and merges by hand, many at once, and a hub of 300 names."""
    rng = random.Random(12)
    nodes, pairs, apart, orders, number = {}, [], [], [], 0
    for k in range(60):
        full = [f"{chr(97 + i)}{'' if rng.random() < 0.7 else ' q'} f{k}" for i in range(rng.randint(2, 9))]
        lone = [f"{c}{k}" for c in "xyz"[: rng.randint(0, 3)]]
        nodes |= {n: (rng.randint(1, 4), n.title()) for n in full + lone}
        shape = rng.choice([0.2, 0.5, 1.0])
        pairs += [(*sorted(p), rng.choice(["same", "nickname", "prefix"])) for p in itertools.combinations(full, 2) if rng.random() < shape]
        pairs += [(f, s, "single") for f in full for s in lone if rng.random() < 0.5]
        apart += [tuple(sorted(p)) for p in itertools.combinations(full + lone, 2) if rng.random() < rng.choice([0, 0.1, 0.4])]
        for _ in range(rng.choice([0, 0, 1, 3])):
            a, b = rng.sample(full + lone, 2)
            number += 1
            orders.append((number, rng.choice(["merge", "separate"]), a, b))
    hub = ["a hub", *(f"b{i:03} hub" for i in range(300))]
    nodes |= {n: (1, n) for n in hub}
    pairs += [("a hub", n, "prefix") for n in hub[1:]] + [(x, y, "same") for x, y in itertools.combinations(hub[1:40], 2)]
    apart += [tuple(sorted(rng.sample(hub[1:], 2))) for _ in range(400)]
    apart = sorted(set(apart))
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    names = df([(n, p, d) for n, (p, d) in nodes.items()], "name string, panels long, display string")
    got = identity_rows(judges.identities(names, df(pairs, "a string, b string, kind string"), df(apart, "a string, b string"), df(orders, "id int, action string, name_a string, name_b string")))
    parted = set(apart) | {tuple(sorted(o[2:])) for o in orders if o[1] == "separate"}
    expected = sequential_identities(nodes, pairs, parted, [o[2:] for o in orders if o[1] == "merge"])
    assert {n: (got[n], x) for n, x in expected.items() if got[n] != x} == {} and len(got) == len(expected)
    assert len({x[3] for x in expected.values()}) == 7


def test_judges_of_all_panels(spark):
    """The registered query on all panels against the scan."""
    import os

    from scorelark.queries import fuzzy
    from scorelark.session import Tables

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("needs the driver's tables")
    marks = fuzzy.seats(Tables(spark, "/root/testdata/sf0.001"))
    shown = judges.panels(marks)
    names = judges.judges(shown)
    nodes = {r["name"]: (r.panels, r.display) for r in names.collect()}
    pairs = [tuple(r) for r in judges.candidates(names).select("a", "b", "kind").collect()]
    apart = {tuple(r) for r in judges.together(shown).collect()}
    expected = sequential_identities(nodes, pairs, apart, [])
    assert identity_rows(judges.rebuild(marks)) == expected
    assert len(pairs) > 100 and any(frozenset(p[:2]) in {frozenset(x) for x in apart} for p in pairs)


def test_no_cluster_holds_two_of_one_panel(spark):
    rng = random.Random(8)
    firsts, lasts = ["Sam", "Samantha", "Sammy", "Chris", "Christina", "Mike", "Michael"], ["Lee", "Ray"]
    names = [f"{f} {s}" for f in firsts for s in lasts] + firsts
    panels = [(f"p{i}", rng.sample(names, 3)) for i in range(8)]
    key = {r.alias_norm: r.judge_key for r in judges.rebuild(judge_marks(spark, panels)).collect()}
    for _, seats in panels:
        keys = [key[n.lower()] for n in seats]
        assert len(set(keys)) == len(keys)


def test_nearest_tells_ties(spark):
    left = spark.createDataFrame([(1, "s", d("2026-01-10"))], "k int, s string, x date")
    right = spark.createDataFrame([("a", "s", d("2026-01-08")), ("b", "s", d("2026-01-12")), ("c", "s", d("2026-03-01"))], "id string, s string, y date")
    r = matching.nearest(left, right, ["s"], "x", "y", 21, ["id"]).first()
    assert (r.id, r["diff"], r.ambiguous) == ("a", 2, True)


def test_nearest_is_the_best_of_all_pairs(spark):
    """Days that repeat on both sides, rows without a date, keys on one side only, several widths, one key with most rows."""
    rng = random.Random(3)
    day = lambda: None if rng.random() < 0.05 else d("2026-01-01") + datetime.timedelta(days=rng.randint(-40, 700))
    left = [(i, rng.choice("hhhhabx"), day()) for i in range(400)]
    right = [(rng.randint(1, 300), rng.choice("hhhhaby"), day(), i) for i in range(150)]
    frames = spark.createDataFrame(left, "k int, s string, x date"), spark.createDataFrame(right, "id int, s string, y date, n int")
    for days in (0, 1, 7, 21):
        expected = []
        for k, s, x in left:
            near = sorted((abs((x - y).days), i, n) for i, t, y, n in right if s == t and x and y and abs((x - y).days) <= days)
            if near:
                expected.append((k, near[0][0], near[0][1], near[0][2], len(near) > 1 and near[1][0] == near[0][0]))
        got = matching.nearest(*frames, ["s"], "x", "y", days, ["id", "n"])
        assert sorted((r.k, r["diff"], r.id, r.n, r.ambiguous) for r in got.collect()) == sorted(expected)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_pages_for_events(spark):
    e = spark.createDataFrame([("e1", d("2026-05-02")), ("e2", d("2026-05-02"))], "id string, start_date date")
    names = spark.createDataFrame([("e1", "x"), ("e2", "river nights open")], "id string, name_norm string")
    pe = spark.createDataFrame([("p", "1", "e1", "whatever", d("2026-01-01")), ("p", "2", None, "River Nights", d("2026-05-04")), ("p", "3", None, "River Nights", d("2026-05-09"))], "provider string, provider_key string, event_id string, name string, start_date date")
    assert sorted((r.id, r.provider_key) for r in matching.pages_for_events(e, names, pe).collect()) == [("e1", "1"), ("e2", "2")]


def test_rows_of_pages_for_events_never_pass_through_the_driver(spark):
    """Small tables too are joined without a broadcast, but for one row of sizes on each side: plans don't know how many rows names and days become."""
    n, first = 300, datetime.date(2026, 1, 1)
    day = lambda c: F.date_add(F.lit(first), (c % 40).cast("int"))
    name = lambda c: F.concat_ws(" ", F.concat(F.lit("a"), c % 5), F.concat(F.lit("b"), c % 7), F.when(c % 3 == 0, "open"))
    i = F.col("id")
    e = spark.range(n).select("id", day(i).alias("start_date"))
    names = spark.range(n).select("id", name(i).alias("name_norm"))
    pages = spark.range(n).select(F.when(i % 50 == 0, i).alias("event_id"), F.lit("p").alias("provider"), i.alias("provider_key"), name(i * 3 + 1).alias("name"), day(i * 7).alias("start_date"))
    found = matching.pages_for_events(e, names, pages)
    words = lambda k: {f"a{k % 5}", f"b{k % 7}", *(["open"] if k % 3 == 0 else [])}
    near = [(x, y) for x in range(n) if x % 50 for y in range(n) if abs(x % 40 - y * 7 % 40) <= 3 and 2 * len(words(x) & words(y * 3 + 1)) >= len(words(x) | words(y * 3 + 1))]
    assert sorted((r.id, r.provider_key) for r in found.collect()) == sorted([*((x, x) for x in range(0, n, 50)), *near])
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    sent = re.findall(r"BroadcastExchange (\w+)", plan)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and set(sent) == {"IdentityBroadcastMode"}


@pytest.mark.parametrize("least", [0.5, 0.7, 1.0])
def test_similar_names_are_those_of_all_pairs(spark, least):
    """Sets of all sizes, words that nearly all names have, equal and empty sets, several days."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    name = lambda: [*rng.sample(words, rng.choice([0, 1, 2, 3, 4, 6])), *(["open"] if rng.random() < 0.8 else [])]
    a, b = ([(i, rng.randint(1, 3), rng.sample(n := name(), len(n))) for i in range(m)] for m in (150, 120))
    got = matching.similar_names(spark.createDataFrame(a, "i int, day int, a_words array<string>"), spark.createDataFrame(b, "j int, day int, b_words array<string>"), ["day"], least)
    near = lambda x, y: len(x | y) > 0 and len(x & y) / len(x | y) >= least
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((i, j) for i, s, x in a for j, t, y in b if s == t and near(set(x), set(y)))


def test_names_of_a_common_word_are_dealt_out(spark, monkeypatch):
    """The word of all names is cut into slots where names meet the counts of their words."""
    monkeypatch.setattr(matching, "COMMON", 10)
    names = [(i, 1, ["open", f"a{i // 2}", f"b{i}"]) for i in range(200)]
    left, right = (spark.createDataFrame(names, f"{i} int, day int, {w} array<string>") for i, w in (("i", "a_words"), ("j", "b_words")))
    found = matching.similar_names(left, right, ["day"], 0.5)
    assert sorted((r.i, r.j) for r in found.collect()) == sorted((i, j) for i in range(200) for j in range(200) if i // 2 == j // 2)
    assert re.search(r"hashpartitioning\(word#\d+, _slot#\d+, \d+\)", found._jdf.queryExecution().executedPlan().toString())


def test_a_word_of_all_names_brings_nothing_together(spark):
    names = [(i, 1, ["open", "the", f"a{i}", f"b{i}", f"c{i}"]) for i in range(2000)]
    left = spark.createDataFrame(names, "i int, day int, a_words array<string>")
    right = spark.createDataFrame([(j, d_, x) for j, d_, x in names], "j int, day int, b_words array<string>")
    found = matching.similar_names(left, right, ["day"], 0.5)
    assert found.count() == 2000


def test_substrings_by_postings(spark):
    """Terms of all lengths, repeated characters and runs, ends of texts, several texts of one key, other characters."""
    rng = random.Random(41)
    texts = [("k" if i % 3 else "l", str(i % 50), "".join(rng.choice("abé ") for _ in range(rng.randint(0, 30)))) for i in range(90)] + [("k", "99", None), ("k", "98", "aaaaaaaa"), ("l", "97", "the galactic open")]
    postings = trigrams.build(spark.createDataFrame(texts, "kind string, key string, text string"))
    terms = ["a", "é", "ab", "aaa", "aaaa", "aaaaaaaa", "aaaaaaaaa", "galactic", "the galactic open", "n", "en", "zz", "abab", " a ", "z"] + ["".join(rng.choice("abé ") for _ in range(rng.randint(1, 6))) for _ in range(10)]
    for term in terms:
        got = sorted(tuple(r) for r in trigrams.find(postings, term).collect())
        assert got == sorted({(k, i) for k, i, t in texts if t and term in t}), term
    plan = trigrams.find(postings, "galactic")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan


def test_indexed_search_is_the_search(spark):
    e = spark.createDataFrame([(1, "s1", "river nights", "river"), (2, "s2", "lake open", "lake"), (3, "s3", "hill", "hill"), (4, None, "alone night", None)], "id int, series_id string, normalized_name string, series_norm string")
    aliases = spark.createDataFrame([("s3", "night hike"), ("s2", "loch")], "series_id string, normalized_alias string")
    postings = trigrams.build(trigrams.event_texts(e, aliases))
    for term in ("night", "lake", "loch", "ill", "zzz", "r", ""):
        assert sorted(r.id for r in trigrams.search(e, postings, term).collect()) == sorted(r.id for r in filters.search(e, aliases, term).collect()), term


def test_pages_of_a_clustered_table(spark):
    """Any page and any cursor, with dates that are missing or shared, reads few files and gives the rows of sort and offset."""
    rng = random.Random(5)
    order = ["start_date", "name", "id"]
    rows = [(i, rng.choice(["x", "y", None]), None if rng.random() < 0.1 else d("2026-01-01") + datetime.timedelta(days=rng.randint(0, 20))) for i in range(1000)]
    table = spark.createDataFrame(rows, "id int, name string, start_date date")
    path = paging.cluster(table, order, range_rows=50)
    files = spark.read.parquet(f"{path}/rows").select("_metadata.file_path").distinct().count()
    assert files >= 10
    everything = [r.id for r in table.orderBy(*order).collect()]
    for offset, limit in ((0, 10), (37, 30), (500, 100), (990, 50), (2000, 5)):
        got = paging.page(spark, path, limit, offset)
        assert [r.id for r in got.collect()] == everything[offset : offset + limit]
        assert offset >= 1000 or re.search(r"PartitionFilters: \[[^\]]*_range", got._jdf.queryExecution().executedPlan().toString())
    seen, cursor = [], None
    while found := paging.page_after(spark, path, order, cursor, 170).collect():
        seen += [r.id for r in found]
        cursor = tuple(found[-1][c] for c in order)
    assert seen == everything
    assert paging.page(spark, paging.cluster(table.where("false"), order)).count() == 0


def test_summaries_after_changes_are_those_of_all_rows(spark):
    """Random changes: values that repeat, nulls, keys that empty and return, rows that come and go in one batch."""
    rng = random.Random(19)
    schema = "k int, x long, y long"
    row = lambda: (rng.randint(1, 6), rng.choice([None, *range(8)]), rng.randint(0, 100))
    rows = [row() for _ in range(20)]
    state = increments.summary(spark.createDataFrame(rows, schema), ["k"], ["x", "y"])
    for _ in range(8):
        gone = rng.sample(rows, rng.randint(0, len(rows)))
        for r in gone:
            rows.remove(r)
        come = [row() for _ in range(rng.randint(0, 12))]
        brief = [row() for _ in range(rng.randint(0, 3))]
        rows += come
        changes_ = [(*r, 1) for r in come + brief] + [(*r, -1) for r in gone + brief]
        after = spark.createDataFrame(rows, schema)
        state = session.written(increments.merged(state, spark.createDataFrame(changes_, schema + ", weight int"), after, ["k"], ["x", "y"]), "state")
        expected = increments.summary(after, ["k"], ["x", "y"]).collect()
        key = lambda r: (r.k, r.n, r.least_x, r.most_x, r.sum_x or 0, r.sum_y, r.least_y, r.most_y)
        assert sorted(map(key, state.collect()), key=repr) == sorted(map(key, expected), key=repr)


def test_state_as_of_moments(spark):
    """Against a replay of a random history, with changes at one moment, nulls and events that are new later."""
    rng = random.Random(31)
    at = lambda n: datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=n)
    state, log, replay = {}, [], []
    for run, hour in enumerate(sorted(rng.choice(range(40)) for _ in range(120))):
        i = rng.randint(1, 8)
        new = {"name": rng.choice(["a", "b", None]), "year": rng.choice([2025, 2026, None])}
        old = state.get(i)
        if old != new:
            text = lambda v: None if v is None else str(v)
            log.append((i, run, at(hour), None if old is None else {k: text(old[k]) for k in new if old[k] != new[k]}))
            state[i] = new
        replay.append((hour, {k: dict(v) for k, v in state.items()}))
    moments = [-1, 0, 7, 20, 33, 100]
    current = spark.createDataFrame([(i, v["name"], v["year"], "now") for i, v in state.items()] + [(99, "old", 1999, "now")], "id int, name string, year int, other string")
    history = spark.createDataFrame(log, "event_id int, sync_run_id int, observed_at timestamp, previous_values map<string,string>")
    got = sorted((r.as_of, r.id, r.name or "", r.year or 0) for r in changes.as_of(current, history, [at(m) for m in moments], ["name", "year"]).collect())
    expected = []
    for m in moments:
        seen = next((s for hour, s in reversed(replay) if hour <= m), {})
        expected += [(at(m), i, v["name"] or "", v["year"] or 0) for i, v in seen.items()] + [(at(m), 99, "old", 1999)]
    assert got == sorted(expected)


def test_finals_and_registry_meet_once(spark):
    s = spark.createDataFrame([("e", "leader", "Novice", 1, 1, "finals"), ("e", "leader", "Novice", 2, 2, "finals"), (None, "leader", "Novice", 3, 3, "finals")], "event_id string, role string, division string, place int, seq int, round string")
    r = spark.createDataFrame([("e", "leader", "NOVICE", 9, "1", 1), ("e", "follower", "Novice", 4, "F", 2)], "event_id string, role string, division string, points int, result string, seq int")
    got = sorted(((x.event_id, x.role, x.place, x.points, x.source) for x in matching.merge_finals(s, r).collect()), key=repr)
    assert got == sorted([("e", "leader", 1, 9, "scoresheets+registry"), ("e", "leader", 2, None, "scoresheets"), (None, "leader", 3, None, "scoresheets"), ("e", "follower", None, 4, "registry")], key=repr)


def test_guard():
    changes.check_guard(100, 140)
    changes.check_guard(5, 19)
    changes.check_guard(0, 100, force=True)
    for found, previous in ((0, None), (5, 30)):
        with pytest.raises(changes.GuardTripped):
            changes.check_guard(found, previous)


def test_changes(spark):
    old = spark.createDataFrame([("a", "x", "confirmed", True), ("b", "y", "unknown", False), ("c", None, "confirmed", True), ("d", "z", "confirmed", True)], "id string, name string, confirmation_status string, active boolean")
    new = spark.createDataFrame([("a", "x", "unknown"), ("b", "y", "unknown"), ("c", "new", "confirmed"), (None, "n", "confirmed")], "id string, name string, confirmation_status string")
    got = {r.id: r for r in changes.classify(new, old, ["name", "confirmation_status"]).collect()}
    assert {k: r.action for k, r in got.items()} == {"a": "unchanged", "b": "reactivated", "c": "updated", "d": "unseen", None: "added"}
    assert got["c"].changed["name"].asDict() == {"from": None, "to": "new"}
    log = changes.classify(new, old, ["name", "confirmation_status"])
    assert changes.counters(log).first().asDict() == {"added": 1, "updated": 1, "reactivated": 1, "unchanged": 1, "unseen": 1}
    seen = changes.observations(log.where("id IS NOT NULL"), new.where("id IS NOT NULL"), 7, F.lit(datetime.datetime(2026, 1, 1)))
    assert sorted((r.event_id, r.previous_values) for r in seen.collect()) == [("b", {}), ("c", {"name": None})]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, v string, e int")
    new = spark.createDataFrame([(2, "c", None), (2, "late", None), (3, "d", 30)], "k int, v string, e int").withColumn("t", F.when(F.col("v") == "late", 2).otherwise(1))
    got = tables.upsert(old.withColumn("t", F.lit(0)), new, ["k"], "t", ("e",)).collect()
    assert sorted((r.k, r.v, r.e) for r in got) == [(1, "a", 10), (2, "late", 20), (3, "d", 30)]
    assert sorted((r.k, r.v) for r in tables.insert_ignore(old, new, ["k"], ["v"]).collect()) == [(1, "a"), (2, "b"), (3, "d")]


def test_snapshots_move_at_once(spark, tmp_path):
    s = tables.Snapshots(spark, f"{tmp_path}/t")
    assert s.read() is None
    s.commit(spark.range(3))
    with pytest.raises(Exception):  # noqa: B017 - whatever Spark raises
        s.commit(spark.range(1).select(F.raise_error(F.lit("no"))))
    assert s.read().count() == 3
    s.commit(s.read().where("id > 0"))
    assert s.read().count() == 2


def test_snapshots_survive_writers_that_stop(spark, tmp_path):
    """Between any two steps of a writer the old table is there; what it had written goes once it is old."""
    s, other = (tables.Snapshots(spark, f"{tmp_path}/t", buckets=4, kept=2) for _ in range(2))
    s.commit(spark.range(3))
    spark.range(9).write.parquet(f"{tmp_path}/t/v-lost")  # stopped before publishing
    open(f"{tmp_path}/t/_log/.half.new", "w").close()  # stopped while publishing
    assert other.read().count() == 3 and other.commit(spark.range(5)) == 2 and s.read().count() == 5
    with pytest.raises(tables.Conflict):
        s._publish(2, spark.range(1).schema, {})
    assert s.read().count() == 5
    for i in range(3):
        s.commit(spark.range(i))
    assert len(s.vacuum()) == 3 and s.read().count() == 2 and len(s._versions()) == 2
    assert s.vacuum(datetime.timedelta(seconds=-1)) == ["v-lost"]


def test_of_two_writers_that_read_one_version_one_fails(spark, tmp_path):
    """The second one's steps are all between the first one's reading and publishing: no rows are lost without a word."""
    one, two = (tables.Snapshots(spark, f"{tmp_path}/t", buckets=4) for _ in range(2))
    row = lambda k: spark.createDataFrame([(k, k)], "k int, v int")
    one.merge(row(1), ["k"])
    publish, ran = one._publish, []

    def late(*args):
        if not ran:
            ran.append(two.merge(row(2), ["k"]))
        return publish(*args)

    one._publish = late
    with pytest.raises(tables.Conflict):
        one.merge(row(3), ["k"])
    one.merge(row(3), ["k"])
    assert sorted(r.k for r in two.read().collect()) == [1, 2, 3]


def test_merging_rewrites_touched_buckets_only(spark, tmp_path):
    s = tables.Snapshots(spark, f"{tmp_path}/t", buckets=8)
    rows = lambda it: spark.createDataFrame([(k, f"{v}", t) for k, v, t in it], "k long, v string, t int")
    s.merge(rows((k, "old", 0) for k in range(100)), ["k"], "t")
    before = s.current()["folders"]
    s.merge(rows([(7, "new", 1), (7, "older", 0)]), ["k"], "t")
    after = s.current()["folders"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    s.merge(rows([(7, "new", 1), (7, "older", 0)]), ["k"], "t")  # run again after a crash
    assert sorted((r.k, r.v) for r in s.read().collect()) == [(k, "new" if k == 7 else "old") for k in range(100)]
    s.commit(s.read().where("k < 3"))
    s.merge(rows([(5, "x", 2)]), ["k"], "t")
    assert sorted(r.k for r in s.read().collect()) == [0, 1, 2, 5]


def test_page_snapshots(spark, tmp_path):
    p = spark.createDataFrame([(f"r{i:02}", "full", "u", "<p>") for i in range(17)], "run_id string, kind string, url string, html string")
    snapshots.write_pages(p, f"{tmp_path}/pages")
    assert snapshots.drop_old(spark, f"{tmp_path}/pages") == ["r00", "r01", "r02"]
    assert spark.read.parquet(f"{tmp_path}/pages").count() == 14
    assert snapshots.as_json(spark.createDataFrame([(1, None)], "a int, b string")).first()[0] == '{"a":1,"b":null}'


def walked(hits, begin, last):
    """The numbers a plain loop visits."""
    out, misses, n = [], 0, begin
    while misses < scans.MISS_LIMIT:
        out.append(n)
        misses = 0 if n in hits else misses + 1
        n += 1
    return [n for n in out if n <= last]


@pytest.mark.parametrize("hits", [[], [1, 2, 50], [5, 46, 90], [41], [40], [45], [39, 80, 121, 300]])
def test_walk(spark, hits):
    probes = spark.createDataFrame([(n, n in hits) for n in range(1, 400)], "n long, hit boolean")
    assert sorted(r.n for r in scans.walk(probes, 1).collect()) == walked(set(hits), 1, 399)


def test_rechecks(spark):
    now = datetime.datetime(2026, 6, 30, 12)
    ts = lambda **k: now - datetime.timedelta(**k)
    e = spark.createDataFrame([("old", d("2026-01-01"), "http://a"), ("new", d("2026-06-20"), "http://b"), ("never", d("2026-02-01"), "http://c"), ("future", d("2026-08-01"), "http://d"), ("provider", d("2026-02-01"), "https://EEPRO.com/x")], "id string, start_date date, website_url string").withColumns({"end_date": F.col("start_date"), "merged_into": F.lit(None).cast("string")})
    checks = spark.createDataFrame([("old", ts(days=6)), ("new", ts(hours=21))], "event_id string, checked_at timestamp")
    assert [r.id for r in scans.websites_due(e, checks, F.lit(now)).collect()] == ["new", "never"]
    sheets = spark.createDataFrame([(1, "parsed", 2, d("2026-06-29"), ts(minutes=30)), (2, "parsed", 2, d("2026-06-29"), ts(hours=2)), (3, "parsed", 2, d("2026-05-01"), ts(days=30)), (4, "parsed", 1, d("2026-05-01"), ts(days=30)), (5, "failed", 2, None, ts(minutes=1)), (6, "empty", 2, None, ts(minutes=1))], "k int, s string, v int, e date, f timestamp")
    fresh = sheets.where(scans.sheet_is_fresh(F.col("s"), F.col("v"), F.lit(2), F.col("e"), F.col("f"), F.lit(now)))
    assert sorted(r.k for r in fresh.collect()) == [1, 3, 6]
    known = spark.createDataFrame([(10, d("2026-06-20")), (11, d("2025-01-01")), (100, d("2026-06-25"))], "n long, start_date date")
    pending = spark.createDataFrame([(12, "no_results", ts(days=10), ts(hours=30)), (13, "no_results", ts(days=10), ts(hours=2)), (14, "no_results", ts(days=500), ts(days=9)), (15, "registered", ts(days=1), ts(days=1))], "n long, status string, first_seen_at timestamp, last_checked_at timestamp")
    assert sorted(r.n for r in scans.numbers_to_recheck(known, pending, F.lit(now)).collect()) == [10, 12]


def test_names_meet_only_compatible_ones(spark, monkeypatch):
    """Thousands of judges with one last name make no pairs unless their first names fit."""
    firsts = ["ann", "anna", "annabel", "al", "alan", "al", "mike", "michael", "mick", "chris", "tina", "topher", "christina", "bo", "bob"]
    names = sorted({f"{f}{m} {last}" for f in firsts for m in ("", " x") for last in ("low", "z")} | {"ann", "bo", "chris", "mich", "al"})
    met = []
    real = judges.even_join
    monkeypatch.setattr(judges, "even_join", lambda *a: met.append(real(*a)) or met[-1])
    got = {(r.a, r.b, r.kind) for r in judges.candidates(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    from scorelark.functions.text import first_compatible

    pairs = spark.createDataFrame([(a, b, a.split()[0], b.split()[0]) for a in names for b in names], "a string, b string, fa string, fb string")
    kind = {(r.a, r.b): r.kind for r in pairs.select("a", "b", first_compatible(F.col("fa"), F.col("fb")).alias("kind")).collect()}
    full = {n for n in names if " " in n}
    expected = {(a, b, kind[a, b]) for a in full for b in full if a < b and a.split()[-1] == b.split()[-1] and kind[a, b]}
    expected |= {(a, b, "single") for a in full for b in set(names) - full if kind[a, b]}
    assert got == expected
    many = spark.range(3000).select(F.concat(F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit("q low")).alias("name"))
    met.clear()
    assert judges.candidates(many).count() == 0 and met[0].count() == 3000  # each name with itself


def test_aliases_of_very_many_series(spark):
    """Rows meet an alias once, not each of its series; several aliases of one series count it once."""
    series = spark.range(3000).select(F.col("id"), F.concat(F.lit("name "), "id").alias("normalized_name"), (-F.col("id")).alias("created_at"))
    aliases = series.select(F.col("id").alias("series_id"), F.lit("other one").alias("normalized_alias")).unionByName(series.where("id < 7").select(F.col("id").alias("series_id"), F.lit("second alias").alias("normalized_alias")))
    rows = spark.range(2000).select(F.col("id").alias("row_id"), F.lit("Unheard").alias("canonical_name"), F.when(F.col("id") == 5, F.array(F.lit("Other One"), F.lit("Second-Alias"))).when(F.col("id") == 6, F.array(F.lit("second alias"))).otherwise(F.array(F.lit("other one"))).alias("aliases"))
    found = occurrences.find_series(rows, series, aliases)
    got = {r.row_id: (r.series_id, r.n_series) for r in found.collect()}
    assert got[5] == (2999, 3000) and got[6] == (6, 7) and got[0] == (2999, 3000) and len(got) == 2000


def test_find_series_forms_no_pairs_of_rows_and_series(spark):
    """900 million pairs would take minutes."""
    import time

    n = 30_000
    series = spark.range(n).select("id", F.concat(F.lit("name "), "id").alias("normalized_name"), F.col("id").alias("created_at"))
    aliases = series.select(F.col("id").alias("series_id"), F.lit("other one").alias("normalized_alias"))
    rows = spark.range(n).select(F.col("id").alias("row_id"), F.lit("Unheard").alias("canonical_name"), F.array(F.lit("Other One")).alias("aliases"))
    start = time.time()
    found = occurrences.find_series(rows, series, aliases)
    assert found.where("series_id = 0 AND n_series = 30000").count() == n and time.time() - start < 60


def test_scan_finds_what_postings_find(spark):
    texts = spark.createDataFrame([("k", "1", "a nation"), ("k", "2", "the end"), ("k", "3", "ration"), ("k", "4", None), ("k", "5", "")], "kind string, key string, text string")
    found = trigrams.scan(texts, {"short": "e ", "five": "ation"}).select("key", "short", "five")
    assert sorted(map(tuple, found.collect())) == [("1", False, True), ("2", True, False), ("3", False, True)]
    postings = trigrams.build(texts)
    assert {r.key for term in ("e ", "ation") for r in trigrams.find(postings, term).collect()} == {"1", "2", "3"}
    assert [r.key for r in trigrams.scan(texts, {"one": "end"}).collect()] == ["2"]


def test_names_of_two_words_meet_on_the_rarer_one(spark):
    """3,000 names with a word in common, and ten times the same name, on one day."""
    import time

    n = 20_000
    name = lambda word, copies: F.array(F.lit(word), F.concat(F.lit("no"), (F.col("id") % copies).cast("string")))
    left = spark.range(n).select("id", F.lit(1).alias("day"), name("customer", n).alias("a_words"))
    right = spark.range(n).select(F.col("id").alias("key"), F.lit(1).alias("day"), name("customer", n // 10).alias("b_words"))
    start = time.time()
    assert matching.similar_names(left, right, ["day"], 0.5).select("id", "key").distinct().count() == n and time.time() - start < 60
    words = [["x"], ["x", "y"], ["y", "x"], ["x", "y", "z"], ["u", "v", "x", "y"], []]
    a = spark.createDataFrame([(i, 1, w) for i, w in enumerate(words)], "id int, day int, a_words array<string>")
    b = a.select(F.col("id").alias("key"), "day", F.col("a_words").alias("b_words"))
    got = sorted((r.id, r.key) for r in matching.similar_names(a, b, ["day"], 0.5).collect())
    assert got == [(i, j) for i, x in enumerate(words) for j, y in enumerate(words) if x and y and 2 * len({*x} & {*y}) >= len({*x} | {*y})]


def test_pairs_in_time_are_counted_by_days(spark):
    import time

    a = spark.createDataFrame([(1, d("2026-01-01")), (2, d("2026-01-01")), (3, d("2026-01-05")), (4, None)], "id int, day date")
    b = spark.createDataFrame([(9, d("2026-01-02"), "x"), (8, d("2026-01-04"), "x"), (7, d("2026-01-09"), "y"), (6, None, "x"), (5, d("2026-01-02"), "y")], "other int, at date, source string")
    got = {r.source: (r.pairs, r["first"]) for r in matching.met_in_time(a, b, "day", "at", 3, ["source"], "other").collect()}
    pairs = matching.near_in_time(a, b, "day", "at", 3).collect()
    assert got == {s: (sum(p.source == s for p in pairs), min(p.other for p in pairs if p.source == s)) for s in {p.source for p in pairs}}
    n, start = 200_000, time.time()
    many = spark.range(n).select(F.col("id").alias("other"), F.lit(d("2026-01-01")).alias("day"), F.lit("x").alias("source"))
    assert matching.met_in_time(many, many.withColumnRenamed("day", "at"), "day", "at", 3, ["source"], "other").first().pairs == n * n and time.time() - start < 30


def test_clustering_takes_few_tasks_however_many_ranges(spark):
    table = spark.range(4000).select("id", (F.col("id") % 7).alias("name"))
    tracker, group = spark.sparkContext.statusTracker(), "clustering"
    spark.sparkContext.setJobGroup(group, group)
    path = paging.cluster(table, ["name", "id"], range_rows=10)
    got = [r.id for r in paging.page(spark, path, 20, 1995).collect()]
    tasks = sum(tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == [i for _, i in sorted((i % 7, i) for i in range(4000))][1995:2015] and tasks < 100  # 400 ranges


def test_large_tables_are_dealt_out_by_their_rows(spark, monkeypatch):
    """Tasks of marks and panels hold a number of rows, not a share of the table."""
    import os

    from scorelark import catalogue, session

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("needs the driver's tables")
    names = ["q_callback_summary", "q_round_ranks", "q_panel_pairs"]
    rows = lambda df: sorted(map(repr, df.collect()))
    before = {n: rows(catalogue.QUERIES[n](spark, data)) for n in names}
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    for n in names:
        df = catalogue.QUERIES[n](spark, data)
        plan = df._jdf.queryExecution().executedPlan().toString()
        tasks = [int(x) for x in re.findall(r"hashpartitioning\([lo]_orderkey#\w+, (\d+)\), REPARTITION_BY_NUM", plan)]
        assert len(set(tasks)) == 1 and tasks[0] >= 55 and rows(df) == before[n]


def test_matching_writes_each_number_of_a_pair_once(spark, monkeypatch):
    day = datetime.date(2026, 5, 1)
    e = spark.createDataFrame([(i, 1, day, "DEU", i, None, "x") for i in (1, 2, 3)], "id long, series_id int, start_date date, country string, created_at int, merged_into long, source string")
    rows = spark.createDataFrame([(k, k, 1, day + datetime.timedelta(1), "DEU") for k in (7, 8)], "row_id long, row_index long, series_id int, start_date date, country string")
    widths = []
    monkeypatch.setattr(occurrences, "written", lambda df, name: (widths.append((name, sorted(df.columns))), df)[1])
    got = {r.row_id: (r.id, r["diff"], r.ambiguous) for r in occurrences.match_occurrences(rows, e).collect()}
    assert got == {7: (1, 1, True), 8: (2, 1, True)}
    assert {w for w in map(str, widths)} == {str(("pairs", ["created_at", "diff", "id", "row_id", "row_index"])), str(("asked", ["diff", "id", "row_id", "row_index"]))}
