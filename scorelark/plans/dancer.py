"""Competitor analytics (C10, C10a-C10e, A7-A16).

Percentages are computed in integers, half to even, and divided at the very end, so any engine gives the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.marks import callback_aggregates, callback_tenths, label, round_order, tenths
from ..functions.numbers import half_even_div
from ..functions.text import competition_type, division_label, result_label
from ..operators.matching import first_by, judge_identity, merge_finals


def exploded(entries: DataFrame) -> DataFrame:
    """One row per judge's mark of each entry, entries without marks drop."""
    return entries.where("marks IS NOT NULL").select("*", F.explode("marks").alias("judge", "mark")).drop("marks")


def callback_rounds(entries: DataFrame, key: list[str]) -> DataFrame:
    """Per round (``key``) the scored marks, points and percentage; unscored codes don't count; none scored gives nulls."""
    marks = exploded(entries.where(F.col("round") != "finals"))
    out = marks.groupBy(*key).agg(*callback_aggregates(F.col("mark")))
    n, points = F.col("judges_marking"), F.col("points_tenths")
    some = n > 0
    return out.select(*key, n, F.when(some, points / 10).alias("callback_points"), F.when(some, n * 10.0).alias("callback_max"), callback_tenths(points, n).alias("pct_tenths"), "yes", "alt", "no").withColumn("callback_pct", F.col("pct_tenths") / 10)


def divisions(entries: DataFrame, owner: list[str]) -> DataFrame:
    """Per owner, division label, kind and role: rounds in order, the furthest one, the final place."""
    rows = entries.withColumns({"competition_type": competition_type(F.col("section")), "division_label": division_label(F.col("division"), F.col("section")), "ord": round_order(F.col("round"))})
    listed = F.array_sort(F.collect_list(F.struct("ord", "seq", "round", "section", "bib", "partner_name", "rank", "place", "score", "advanced", "alternate", "competed", "sheet_url")))
    final = F.col("round") == "finals"
    out = rows.groupBy(*owner, "division_label", "competition_type", "role").agg(F.min_by("division", "seq").alias("division"), listed.alias("rounds"), F.min_by("place", F.when(final, F.col("seq"))).alias("final_place"))
    return out.withColumn("furthest_round", F.element_at("rounds", -1)["round"])


def progress(callbacks: DataFrame, order: list) -> DataFrame:
    """Callback rounds of a competitor in time."""
    return callbacks.withColumn("n", F.row_number().over(W.partitionBy("competitor").orderBy(*order)))


def finals(sheet_finals: DataFrame, registry: DataFrame) -> DataFrame:
    """Finals of sheets and registry together, labelled."""
    return merge_finals(sheet_finals, registry).withColumn("result_label", F.coalesce(result_label(F.col("place")), result_label(F.col("result"))))


def judge_breakdown(marks: DataFrame, aliases: DataFrame, owner: list[str]) -> DataFrame:
    """Per owner and judge: events, marks by kind, rates, placements given, and the names listed as.

    marks: owner, event_key, round, judge, mark.
    """
    m = judge_identity(marks, aliases).withColumns({"t": F.when(F.col("round") != "finals", tenths(F.col("mark"))), "p": F.when(F.col("round") == "finals", F.col("mark").try_cast("int"))})
    kind = lambda code: F.count_if(F.col("t").isNotNull() & code)
    up = F.upper("mark")
    out = m.groupBy(*owner, "judge_key").agg(
        F.min("judge_name").alias("judge"), F.count_distinct("event_key").alias("events_judged"), F.count("t").alias("callback_marks"),
        kind(up == "Y").alias("yes"), kind(~up.isin("Y", "N")).alias("alt"), kind(up == "N").alias("no"),
        F.sum(F.col("t").cast("long")).alias("_points"), F.count("p").alias("finals_judged"), F.sum(F.col("p").cast("long")).alias("_places"),
        F.array_sort(F.collect_set("judge")).alias("listed_as"), F.bool_or(F.coalesce(F.col("method") == "needs_review", F.lit(False))).alias("needs_review"),
    )
    return out.withColumns({
        "yes_rate": half_even_div(F.col("yes") * 1000, F.col("callback_marks")) / 10,
        "avg_points": half_even_div(F.col("_points") * 10, F.col("callback_marks")) / 100,
        "avg_finals_placement": half_even_div(F.col("_places") * 100, F.col("finals_judged")) / 100,
    }).drop("_points", "_places")


def history(marks: DataFrame) -> DataFrame:
    """Every mark with its label and points, in time."""
    return marks.select("*", label(F.col("mark")).alias("label"), (tenths(F.col("mark")) / 10).alias("points")).orderBy("competitor", "judge", "date", "event_key", "round")


def summary(rounds: DataFrame, finals_: DataFrame, owner: list[str]) -> DataFrame:
    """Per owner (add role to it for the split): events, finals, best place, callbacks and rates.

    rounds: owner, event_key, round, advanced, pct_tenths, points (registry points of the event, once per event).
    """
    scored = F.col("pct_tenths").isNotNull()
    decided = scored & F.col("advanced").isNotNull()
    left = rounds.groupBy(*owner).agg(
        F.count_distinct("event_key").alias("events_competed"), F.count_if(scored).alias("callback_rounds"), F.count_if(decided & F.col("advanced")).alias("callback_rounds_advanced"),
        F.count_if(decided).alias("_decided"), F.sum("pct_tenths").alias("_pct"),
    )
    right = finals_.groupBy(*owner).agg(F.count("*").alias("finals_made"), F.count_distinct("event_key").alias("events_with_finals"), F.min("place").alias("best_final_place"), F.nullif(F.sum("points"), F.lit(0)).alias("points"))
    out = left.join(right, owner, "full")
    made = F.coalesce("finals_made", F.lit(0))
    return out.select(
        *owner, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("events_competed", "finals_made", "events_with_finals", "callback_rounds", "callback_rounds_advanced")), "best_final_place",
        F.when(F.col("best_final_place").isNotNull(), result_label(F.col("best_final_place"))).when(made > 0, "Finalist").alias("best_final_label"),
        (half_even_div(F.col("callback_rounds_advanced") * 1000, F.col("_decided")) / 10).alias("advancement_rate"),
        (half_even_div(F.col("_pct"), F.col("callback_rounds")) / 10).alias("avg_callback_pct"), "points",
    )


def points_total(awards: DataFrame, owner: list[str]) -> DataFrame:
    """C10d, A14: points and results by division and role, and over all (division and role null)."""
    return awards.groupingSets([[*owner, "division", "role"], owner], *owner, "division", "role").agg(F.sum(F.coalesce("points", F.lit(0))).alias("points"), F.count("*").alias("results"), F.grouping("division").alias("total"))


def by_points(totals: DataFrame) -> DataFrame:
    """O7."""
    return totals.where("total = 0").orderBy(F.desc("points"), F.coalesce("division", F.lit("")), "role")


def roles(rounds: DataFrame, awards: DataFrame, owner: list[str]) -> DataFrame:
    """C10e, A15, A16, A27: primary and secondary role by number of rounds (ties: by name), roles competed in, points by role."""
    seen = rounds.where("role IS NOT NULL").select(*owner, "role", F.lit(1).alias("n"), F.lit(0).alias("points"))
    won = awards.where("role IS NOT NULL").select(*owner, "role", F.lit(0).alias("n"), F.coalesce("points", F.lit(0)).alias("points"))
    per = seen.unionByName(won).groupBy(*owner, "role").agg(F.sum("n").alias("rounds"), F.sum("points").alias("points"))
    ranked = per.withColumn("k", F.row_number().over(W.partitionBy(*owner).orderBy(F.desc("rounds"), "role")))
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    return ranked.groupBy(*owner).agg(pick(1, "role").alias("primary_role"), pick(1, "points").alias("primary_points"), pick(2, "role").alias("secondary_role"), pick(2, "points").alias("secondary_points"), F.array_sort(F.collect_set("role")).alias("competed_roles"))


def newest_first(events: DataFrame) -> DataFrame:
    """O5."""
    return events.orderBy(F.desc_nulls_last("start_date"), "event_key")


def results(entries: DataFrame, name_norm: str, known_id: int | None, registry: DataFrame, aliases: DataFrame) -> dict[str, DataFrame]:
    """All views of one competitor from entries with event info (see matching.event_info).

    registry: event_id, event_key, role, division, result, points, seq.
    """
    from ..operators.filters import name_or_id

    mine = name_or_id(entries, name_norm, known_id).withColumn("competitor", F.lit(name_norm))
    rounds = ["competitor", "event_key", "event_id", "event_name", "start_date", "division", "role", "round", "advanced", "rank", "competed", "sheet_url", "section"]
    callbacks = callback_rounds(mine, rounds)
    sheet_finals = mine.where("round = 'finals'").select("competitor", "event_id", "event_key", "start_date", "division", "role", "round", "place", F.monotonically_increasing_id().alias("seq"))
    merged = finals(sheet_finals, registry.withColumn("competitor", F.lit(name_norm)))
    both = callbacks.select("competitor", "event_key", "role", "advanced", "pct_tenths").unionByName(merged.select("competitor", "event_key", "role", F.lit(None).cast("boolean").alias("advanced"), F.lit(None).cast("long").alias("pct_tenths")))
    awards = registry.withColumn("competitor", F.lit(name_norm))
    marks = exploded(mine).select("competitor", "event_key", "round", "judge", "mark")
    return {
        "events": newest_first(mine.select("event_key", "event_name", "start_date", "city", "region", "country").distinct()),
        "divisions": divisions(mine.withColumn("seq", F.monotonically_increasing_id()), ["competitor", "event_key"]),
        "callbacks": callbacks.orderBy("start_date", round_order(F.col("round"))),
        "finals": merged.orderBy("start_date"),
        "judges": judge_breakdown(marks, aliases, ["competitor"]).orderBy(F.desc("events_judged"), "judge"),
        "summary": summary(both, merged, ["competitor"]),
        "summary_by_role": summary(both, merged, ["competitor", "role"]),
        "points": points_total(awards, ["competitor"]),
        "roles": roles(mine, awards, ["competitor"]),
    }


def first_final(entries: DataFrame, owner: list[str]) -> DataFrame:
    """The first finals row of each owner."""
    return first_by(entries.where("round = 'finals'"), owner, ["seq"])
