"""Scalar functions: known facts and properties."""

import datetime
import random
import re
import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorelark.functions import dates, jsons, marks, numbers, places, text


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.withColumn("x", fn(F.col("v"))).orderBy("i").collect()]


def test_normalize(spark):
    raw = ["Café & Bar", "  ÅÄÖ--x ", None, "", "Straße", "ﬁt", "日本"]
    assert column(spark, raw, text.normalize_text) == ["cafe and bar", "aao x", "", "", "stra e", "t", ""]
    assert column(spark, raw, lambda c: text.normalize_text(c, exact=True))[5] == "fit"
    assert column(spark, ["Swing 2024 (Hiatus until 2026)", "5280 Westival", "On Hiatus: X"], text.normalize_event_name) == ["swing", "5280 westival", "x"]


def test_strip_accents_agrees_with_full_decomposition_on_latin(spark):
    letters = [chr(c) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFKD", chr(c)).rstrip("".join(map(chr, range(0x300, 0x370))))) == 1]
    assert column(spark, letters, text.strip_accents) == column(spark, letters, text.strip_accents_exact)


def peel(raw):
    """Plain version: a name is peeled three times by the first ending that fits."""
    tidy = lambda x: " ".join(x.split()).strip(" \t-–—|:,")
    plain = text._py_normalize
    listed = tidy(re.sub(text.YEAR, " ", re.sub(text.HIATUS, " ", raw or "")))
    rest, inner = listed, []
    for _ in range(text.PEELS):
        fits = [m for kind, p in text.ENDINGS.items() if (m := re.match(p, rest)) and (kind == "aka" or plain(m[2]))]
        if fits:
            rest, inner = tidy(fits[0][1]), [*inner, tidy(fits[0][2])]
    canonical = rest or listed or (raw or "").strip()
    others = []
    for x in [listed, *inner]:
        if plain(x) and plain(x) not in map(plain, [canonical, *others]):
            others.append(x)
    return canonical, others


def test_split_event_name(spark):
    rng = random.Random(12)
    pool = ["Open", "aka", "a.k.a.", "(GPS)", "( )", '"SNOW"', "“Ice”", "2025", "hiatus", "-", "River Nights", "RN", "(on hiatus)", "Ünder", "&", "|", '"', "("]
    raw = ["The After Party aka TAP", "Grand Party (GPS)", 'Open WCS "SNOW" 2025', None, "", "2025"] + [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 7))) for _ in range(400)]
    got = [(r.canonical, r.aliases) for r in column(spark, raw, text.split_event_name)]
    assert got[:4] == [("The After Party", ["The After Party aka TAP", "TAP"]), ("Grand Party", ["Grand Party (GPS)", "GPS"]), ("Open WCS", ['Open WCS "SNOW"', "SNOW"]), ("", [])]
    assert got == [peel(x) for x in raw]


def test_names(spark):
    df = spark.createDataFrame([("Swingtacular: The Galactic Open", "Swingtacular"), ("Boogie by the Bay", "Bay Area Fest"), ("The Open", "Swing Fest")], "a string, b string")
    assert [r[0] for r in df.select(text.names_related(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    pairs = [("mike", "michael", "nickname"), ("chr", "christa", "prefix"), ("al", "alan", None), ("ann", "ann", "same"), ("tina", "chris", "nickname")]
    got = spark.createDataFrame(pairs, "a string, b string, e string").select("e", text.first_compatible(F.col("a"), F.col("b")).alias("k")).collect()
    assert all(r.e == r.k for r in got)
    assert len(text.NICKNAME_GROUPS) == 71 and len(text.GENERIC_WORDS) == 26 and len(places.COUNTRY_CODES) == 71


def test_titles(spark):
    titles = ["Jack & Jill Follower Novice Prelims", "All-Star Leaders Semi Finals", None, "Strictly Finals"]
    got = column(spark, titles, text.describe_title)
    assert [tuple(r) for r in got] == [("follower", "prelims", "Novice"), ("leader", "finals", "All Star"), (None, None, None), (None, "finals", None)]
    assert column(spark, ["J&J Novice", None, "Pro Am", "Other"], text.competition_type) == ["jack_and_jill", "jack_and_jill", "pro_am", "other"]
    assert column(spark, ["Novice - Finals (Leaders)", "Finals", None], lambda c: text.division_label(F.lit(None).cast("string"), c)) == ["Novice", "Competition", "Jack & Jill"]
    assert column(spark, ["1", "2", "3", "4", "11", "12", "13", "21", "112", "F", "x", None], text.result_label) == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "112th", "Finalist", "X", None]


def test_links(spark):
    urls = ["https://eepro.com/results/x2026/jj.html", "https://scoring.dance/frFR/events/195/results/", "https://scores.worlddanceregistry.com/82823D87-cacf-11f0-aaaa-0123456789ab/rounds", "https://a.b/"]
    got = column(spark, urls, text.provider_of)
    assert [tuple(r) if r else None for r in got] == [("eepro", "x2026"), ("scoring_dance", "195"), ("wdr", "82823d87-cacf-11f0-aaaa-0123456789ab"), None]
    assert column(spark, ["http://Https://a.b", " ", None], text.clean_url) == ["Https://a.b", None, None]


def d(s):
    return datetime.date.fromisoformat(s)


def test_date_ranges(spark):
    cases = {
        "Sep 23 - 27, 2026": ("2026-09-23", "2026-09-27"), "Oct 28 - Nov 2, 2026": ("2026-10-28", "2026-11-02"), "Dec 30 2026 - Jan 3 2027": ("2026-12-30", "2027-01-03"),
        "Dec 30 – Jan 3, 2027": ("2026-12-30", "2027-01-03"), "Feb 29 - Mar 5, 2028": ("2028-02-29", "2028-03-05"), "June 5, 2026": ("2026-06-05", "2026-06-05"),
        "Feb 30, 2026": None, "Foo 3, 2026": None, "Sep 27 - 23, 2026": None, "soon": None, None: None,
    }
    got = column(spark, list(cases), dates.parse_date_range)
    assert [tuple(r) if r else None for r in got] == [e and (d(e[0]), d(e[1])) for e in cases.values()]
    assert column(spark, ["September 2026", "Sep. 2026", "2026", None], dates.parse_month) == [d("2026-09-01"), d("2026-09-01"), None, None]
    assert column(spark, ["during X at 01/23/2025 in", "at 13/45/2025", "no"], dates.extract_us_date) == [d("2025-01-23"), None, None]


@given(st.dates(datetime.date(1950, 1, 1), datetime.date(2080, 1, 1)))
def test_month_patterns_know_every_month(day):
    assert day.strftime("%b").lower() in dates.MONTHS


def test_every_character_is_decomposed(spark):
    """All code points, alone and inside texts, against the full decomposition; and no Python worker."""
    import unicodedata

    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    points = [chr(p) for p in range(1, 0x110000) if not 0xD800 <= p <= 0xDFFF]
    texts = ["".join(points[i : i + 16]) for i in range(0, len(points), 16) if plain("".join(points[i : i + 16])) != "".join(points[i : i + 16])]
    texts += points[:: 97] + ["e\u0301\u0327x", "\u0327\u0301", "각각 ﬁn ½ 😀é", "", "\U0001d400\U0001f100"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4).select("t", text.strip_accents_exact(F.col("t")).alias("u"))
    wrong = [(r.t, r.u) for r in df.collect() if r.u != plain(r.t)]
    assert wrong == []
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_locations(spark):
    cases = {
        "Atlanta, GA USA": ("Atlanta", "GA", "USA", "USA"),
        "Paris, France, france, N/A": ("Paris", None, "France", "FRA"),
        "Tbilisi, Georgia": ("Tbilisi", "Georgia", None, None),
        "USA": ("USA", None, None, None),
        None: (None, None, None, None),
        " , n/a, - ": (None, None, None, None),
        "Town,  Old\u00a0 Part , Germany": ("Town", "Old Part", "Germany", "DEU"),
        "Town, USA, GA, United States": ("Town", "GA", "United States", "USA"),
        "Town, France, Ontario Canada": ("Town", "France, Ontario", "Canada", "CAN"),
        "Town, GA USA, USA": ("Town", "GA USA", "USA", "USA"),
        "Town, USA, GA USA": ("Town", "GA", "USA", "USA"),
        "Town, South Africa, East": ("Town", "East", "South Africa", "ZAF"),
        "Town, Region, East End": ("Town", "Region, East End", None, None),
        "Germany, Germany, usa": ("Germany", None, "usa", "USA"),
        "Town, New South Wales Australia": ("Town", "New South Wales", "Australia", "AUS"),
    }
    got = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", places.parse_location(F.col("raw")).alias("l")).collect()
    assert {r.raw: tuple(r.l) for r in got} == cases


def test_places():
    assert places.country_filter("united states") == "USA" and places.country_filter("xyz") == "XYZ" and places.country_filter("") is None


@pytest.mark.parametrize(("a", "b", "e"), [(245, 4, 61), (25, 10, 2), (35, 10, 4), (7, 2, 4), (5, 2, 2), (0, 3, 0), (1, 0, None)])
def test_half_even(spark, a, b, e):
    assert spark.range(1).select(numbers.half_even_div(F.lit(a).cast("long"), F.lit(b).cast("long"))).first()[0] == e


@given(st.integers(0, 10**6), st.integers(1, 10**4))
def test_half_even_is_rounding_of_the_exact_quotient(a, b):
    from fractions import Fraction

    whole, rest = divmod(a, b)
    up = 2 * rest > b or (2 * rest == b and whole % 2 == 1)
    assert whole + up == round(Fraction(a, b))


def test_marks(spark):
    assert column(spark, ["Y", "a1", "ALT3", "N", "A", None, "-"], marks.tenths) == [100, 45, 42, 0, None, None, None]
    assert column(spark, ["yes", "Alt 1", "alt", "?"], marks.mark_from_word) == ["Y", "A1", "A", "?"]
    assert column(spark, [10.0, 4.5, 4.30001, 4.2, 0.0, 5.0], marks.mark_from_points, "double") == ["Y", "A1", "A2", "A3", "N", None]
    m = spark.createDataFrame([("prelims", {"J": "Y"}), ("finals", {"J": "3", "K": "x"})], "r string, m map<string,string>").select(F.explode(marks.mark_details(F.col("r"), F.col("m"))).alias("d"))
    assert [tuple(r.d) for r in m.orderBy("d.judge", "d.placement").collect()] == [("J", None, "Y", "Yes", "yes", 10.0), ("J", 3, None, None, None, None), ("K", None, None, None, None, None)]


def test_json(spark):
    df = spark.createDataFrame([('["a"]', 1, 2), ("oops", 1, 1), (None, None, None)], "j string, a int, b int")
    got = df.select(jsons.parse_list(F.col("j")).alias("p"), jsons.append(jsons.parse_list(F.col("j")), F.lit("z"), 2).alias("q"), jsons.changed_fields({"x": F.col("a")}, {"x": F.col("b")}).alias("c")).collect()
    assert [r.p for r in got] == [["a"], [], []] and got[0].q == ["a", "z"]
    assert got[0].c["x"].asDict() == {"from": "1", "to": "2"} and not got[1].c and not got[2].c
    ids = df.select(jsons.opaque_id("evt", "a", "b")).collect()
    assert ids[0][0].startswith("evt_") and len(ids[0][0]) == 20 and len({i[0] for i in ids}) == 3


def test_special_characters_are_few_ranges():
    """Each character of a text is tried against all of them; single characters were 1,153, and syllables."""
    assert text._ranges([0x41, 0x43, 0x100, 0xAC00, 0xD7A3]) == r"\x{41}-\x{43}\x{100}-\x{100}\x{ac00}-\x{d7a3}"
    assert text._ranges([*map(ord, text._decomposed()[2]), 0xAC00, 0xD7A3]).count("-") < 100
