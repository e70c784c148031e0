"""Merging the same event of several sources (ER3, ER4, R1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import numbered, written
from .matching import PRECISION_RANK, SOURCE_RANK, rank_of, related_pairs

MAX_HOPS = 5
NEVER = (1 << 63) - 1
_FILLED = ("website_url", "city", "region", "country")


def named(events: DataFrame, names: DataFrame | None) -> DataFrame:
    """Events with one row per name they go by: their own and those in ``names`` (id, name)."""
    own = events.select("id", "name")
    every = own if names is None else own.unionByName(names.select("id", "name")).distinct()
    return events.drop("name").join(every, "id")


def edges(events: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of live events that may be one; a comes first by start date, then id."""
    every = named(events.where("merged_into IS NULL" if "merged_into" in events.columns else "true"), names)
    pairs = related_pairs(every, every).where(F.struct("a_start_date", "a_id") < F.struct("b_start_date", "b_id"))
    return pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()


def merges(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """ER3: keep, drop, in the order of ``step``: the greedy scan over all pairs in the published order (K7, K8, K13), in parallel rounds.

    The scan visits events by start date and compares each with the later ones it has an edge to, as long as both are
    there; the better ranked one stays.  Which end of an edge would go is known beforehand, so an event goes at the
    first edge that it loses to an event which is still there, and that depends on better ranked events only.  ``bounded`` finds
    these moments for all events at once.
    """
    rank = F.struct(rank_of(PRECISION_RANK, F.col("date_precision")).alias("p"), rank_of(SOURCE_RANK, F.col("source")).alias("s"), F.col("created_at").cast("string").alias("c"), "id")
    node = lambda c: events.select(F.col("id").alias(c), F.struct(F.col("start_date").cast("string").alias("d"), "id").alias(c + "_at"), rank.alias(c + "_rank"))
    both = pairs.where("a <> b").select("a", "b").join(node("a"), "a").join(node("b"), "b")
    better = F.col("a_rank") < F.col("b_rank")
    edge = both.select(F.when(better, F.col("a")).otherwise(F.col("b")).alias("keep"), F.when(better, F.col("b")).otherwise(F.col("a")).alias("drop"), F.least("a_at", "b_at").alias("first"), F.greatest("a_at", "b_at").alias("second")).distinct()
    edge = written(numbered(edge, ["first", "second"], "step", "ordered").select("keep", "drop", "step"), "edges")
    gone = bounded(edge)
    return edge.join(gone, ["drop", "step"]).select("keep", "drop", "step")


def bounded(edge: DataFrame) -> DataFrame:
    """drop, step: the moment at which each event goes, for edges (keep, drop, step) with an acyclic relation of keep to drop.

    Every event has an earliest and a latest moment at which it can go.  An edge counts for the latest one if its winner can't
    have gone before, and for the earliest one unless its winner has gone before for certain.  Both bounds close in with
    each round, which is one join and one aggregation of the edges that aren't decided, and these get fewer: the rounds are the longest
    chain of decisions that really depend on each other, few for any order of ranks that isn't made for it, however
    many edges meet in an event.
    """
    open_, state = edge, None
    while True:
        if state is None:
            state = edge.groupBy("drop").agg(F.min("step").alias("lo")).withColumn("hi", F.lit(NEVER))
        of_winner = state.select(F.col("drop").alias("keep"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
        met = open_.join(of_winner, "keep", "left").where(F.coalesce("_hi", F.lit(NEVER)) > F.col("step"))
        sure = F.coalesce("_lo", F.lit(NEVER)) > F.col("step")
        met = met.select("keep", "drop", "step", sure.alias("sure"))
        seen = met.groupBy("drop").agg(F.min("step").alias("_first"), F.min(F.when(F.col("sure"), F.col("step"))).alias("_sure"))
        hi = F.least("hi", F.coalesce("_sure", F.lit(NEVER)))
        state = written(state.join(seen, "drop", "left").select("drop", F.least(F.coalesce("_first", F.lit(NEVER)), hi).alias("lo"), hi.alias("hi")), "bounds")
        # an edge after the latest moment of its loser decides nothing
        open_ = written(met.where("NOT sure").join(state.select("drop", "hi"), "drop").where("step < hi").select("keep", "drop", "step"), "open")
        if open_.isEmpty():
            return state.where(F.col("hi") < NEVER).select("drop", F.col("hi").alias("step"))


def final_targets(merged: DataFrame) -> DataFrame:
    """Old, new: every dropped event with the event at the end of its chain, at most MAX_HOPS merges away."""
    step = merged.select(F.col("drop").alias("old"), F.col("keep").alias("new"))
    out = step
    for _ in range(MAX_HOPS - 1):
        out = out.join(step.select(F.col("old").alias("new"), F.col("new").alias("_further")), "new", "left").select("old", F.coalesce("_further", "new").alias("new"))
    return out


def merge_events(events: DataFrame, merged: DataFrame) -> DataFrame:
    """ER4 for the events: kept ones take the better dates and fill their gaps from those merged into them; dropped ones point to the end of the chain."""
    target = final_targets(merged)
    dropped = events.join(target.select(F.col("old").alias("id"), F.col("new").alias("_into")), "id")
    gifts = dropped.select(F.col("_into").alias("id"), F.struct(rank_of(PRECISION_RANK, F.col("date_precision")).alias("rank"), "created_at", F.col("id").alias("from"), "start_date", "end_date", "date_precision").alias("dates"), F.struct("created_at", "id").alias("age"), *_FILLED)
    given = gifts.groupBy("id").agg(F.min("dates").alias("_d"), *(F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("age"))).alias("_" + c) for c in _FILLED))
    kept = events.join(target.select(F.col("old").alias("id")), "id", "left_anti").join(given, "id", "left")
    better = F.coalesce(F.col("_d.rank") < rank_of(PRECISION_RANK, F.col("date_precision")), F.lit(False))
    new = {c: F.when(better, F.col(f"_d.{c}")).otherwise(F.col(c)) for c in ("start_date", "end_date", "date_precision")}
    new |= {c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.col("_" + c)) for c in _FILLED}
    if "year" in events.columns:
        new["year"] = F.year(new["start_date"])
    kept = kept.select(*(new[c].alias(c) if c in new else c for c in events.columns))
    gone = dropped.select(*((F.col("_into") if c == "merged_into" else F.lit(False) if c == "active" else F.col(c)).alias(c) for c in events.columns))
    # chains that ended in a dropped event before now end where it went
    moved = target.select(F.col("old").alias("merged_into"), F.col("new").alias("_new"))
    compressed = kept.join(moved, "merged_into", "left").withColumn("merged_into", F.coalesce("_new", "merged_into")).select(*events.columns)
    return compressed.unionByName(gone)


def repoint(child: DataFrame, merged: DataFrame, column: str = "event_id") -> DataFrame:
    """ER4: a child table's rows follow their event."""
    moved = final_targets(merged).select(F.col("old").alias(column), F.col("new").alias("_new"))
    return child.join(moved, column, "left").withColumn(column, F.coalesce("_new", column)).select(*child.columns)


def repoint_unique(child: DataFrame, merged: DataFrame, order: list[str], column: str = "event_id") -> DataFrame:
    """ER4, U8: as repoint for a table with one row per event: a row that was there before wins over one that arrives."""
    from .matching import first_by

    marked = child.withColumn("_own", F.col(column))
    moved = repoint(marked, merged, column)
    return first_by(moved.withColumn("_arrived", F.col("_own") != F.col(column)), [column], ["_arrived", *order]).select(*child.columns)


def chain(events: DataFrame) -> DataFrame:
    """Id -> the event it stands for now, following merged_into up to MAX_HOPS times."""
    return final_targets(events.where("merged_into IS NOT NULL").select(F.col("merged_into").alias("keep"), F.col("id").alias("drop")))
