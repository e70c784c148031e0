"""Judges' marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import half_even_div

# Callback marks, their points in tenths and their labels.
POINT_TENTHS = {"Y": 100, "A1": 45, "ALT1": 45, "A2": 43, "ALT2": 43, "A3": 42, "ALT3": 42, "N": 0}
LABELS = {"Y": "Yes", "A1": "Alt 1", "ALT1": "Alt 1", "A2": "Alt 2", "ALT2": "Alt 2", "A3": "Alt 3", "ALT3": "Alt 3", "N": "No"}
ROUND_ORDER = {"prelims": 0, "quarters": 1, "semis": 2, "finals": 3}
WORD_MARKS = {"yes": "Y", "no": "N", "alt1": "A1", "alt2": "A2", "alt3": "A3", "alt": "A"}


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def mark_from_word(raw: Column) -> Column:
    """Provider 2's words; a generic "alt" becomes A, which is not scored."""
    return F.coalesce(_lookup(WORD_MARKS, F.replace(F.lower(raw), F.lit(" "), F.lit(""))), raw)


def mark_from_points(points: Column) -> Column:
    """Provider 3's points, after rounding to one decimal."""
    tenths = F.round(points * 10).cast("int")
    return F.when(tenths == 100, "Y").when(tenths == 45, "A1").when(tenths == 43, "A2").when(tenths == 42, "A3").when(tenths == 0, "N")


def tenths(code: Column) -> Column:
    """Points of a mark times ten; null if the mark is not scored."""
    return _lookup(POINT_TENTHS, F.upper(code))


def kind(code: Column) -> Column:
    c = F.upper(code)
    return F.when(c == "Y", "yes").when(c == "N", "no").when(c.isin(*POINT_TENTHS), "alt").otherwise("unknown")


def label(code: Column) -> Column:
    c = F.upper(code)
    return F.coalesce(_lookup(LABELS, c), c)


def round_order(name: Column) -> Column:
    return F.coalesce(_lookup(ROUND_ORDER, name), F.lit(9))


def mark_details(round_name: Column, marks: Column) -> Column:
    """Per judge a struct; placements in finals, codes with label, kind and points elsewhere."""

    def one(e: Column) -> Column:
        final, code = round_name == "finals", F.upper(e["value"])
        return F.struct(
            e["key"].alias("judge"), F.when(final, e["value"].try_cast("int")).alias("placement"), F.when(~final, code).alias("mark"),
            F.when(~final, label(code)).alias("label"), F.when(~final, kind(code)).alias("kind"), F.when(~final, tenths(code) / 10).alias("points"),
        )

    return F.transform(F.map_entries(marks), one)


def callback_aggregates(code: Column) -> list[Column]:
    """A7 over exploded marks: scored marks, points in tenths, and counts by kind."""
    points = tenths(code)
    count = lambda k: F.count_if(points.isNotNull() & (kind(code) == k))
    return [F.count(points).alias("judges_marking"), F.sum(points.cast("long")).alias("points_tenths"), count("yes").alias("yes"), count("alt").alias("alt"), count("no").alias("no")]


def callback_tenths(points_tenths: Column, judges: Column) -> Column:
    """Percentage times ten, half to even, in integers: 100 * points / (10 * judges)."""
    return half_even_div(points_tenths * 10, judges)
