"""Resolving loose event data to a catalog event (ER6, ER7, O8, W5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_short_alias, jaccard, normalize_text, tokens

# Weights and limits of the score.
RESOLVED, FUZZY, CANDIDATE, MARGIN, MOST = 0.7, 0.6, 0.3, 0.15, 5


def score(candidate: DataFrame) -> DataFrame:
    """ER6: ``score`` (three decimals) of each (request, event) row.

    Request columns: q_name (normalised), q_date, q_year, q_country, q_city.  Event columns: series_norm, name_norm,
    alias_norms (array), start_date, year, country, city.  Exact integer thousandths until the end.
    """
    q = F.col("q_name")
    exact = (q != "") & q.isin(F.col("series_norm"), F.col("name_norm"))
    alias = F.array_contains("alias_norms", q)
    words = tokens(q)
    best = F.array_max(F.transform(F.concat(F.array("series_norm"), "alias_norms"), lambda n: F.when((F.size(words) > 0) & (F.size(tokens(n)) > 0), jaccard(words, tokens(n))).otherwise(0.0)))
    name = F.when(exact, 600).when(alias, F.when(is_short_alias(q), 300).otherwise(600)).when(best >= FUZZY, 500 * best)
    days = F.abs(F.datediff("q_date", "start_date"))
    both_dates = F.col("q_date").isNotNull() & F.col("start_date").isNotNull()
    both_years = F.col("q_year").isNotNull() & F.col("year").isNotNull()
    when = F.when(both_dates, F.when(days <= 3, 300).when(days <= 14, 150).when(days > 60, -200).otherwise(0)).when(both_years, F.when(F.col("q_year") == F.col("year"), 150).otherwise(-300)).otherwise(0)
    land = F.when(F.col("q_country").isNotNull() & F.col("country").isNotNull(), F.when(F.col("q_country") == F.col("country"), 100).otherwise(-300)).otherwise(0)
    town = F.when(normalize_text(F.col("q_city")) == F.when(normalize_text(F.col("city")) != "", normalize_text(F.col("city"))), 50).otherwise(0)
    total = F.least(name + when + land + town, F.lit(1000))
    return candidate.withColumn("score", F.when(name.isNull(), 0.0).otherwise(F.bround(total, 0) / 1000))


def candidates(scored: DataFrame, request: str = "request_id") -> DataFrame:
    """At most five events per request from 0.3 on, best first."""
    order = W.partitionBy(request).orderBy(F.desc("score"), F.asc_nulls_first("start_date"), "event_id")
    return scored.where(F.col("score") >= CANDIDATE).withColumn("n", F.row_number().over(order)).where(F.col("n") <= MOST)


def decide(requests: DataFrame, ranked: DataFrame, request: str = "request_id") -> DataFrame:
    """Resolved if the best is good and clearly ahead, ambiguous if there is any, else not_found."""
    top = ranked.groupBy(request).agg(F.max(F.when(F.col("n") == 1, F.struct("score", "event_id"))).alias("top"), F.coalesce(F.max(F.when(F.col("n") == 2, F.col("score"))), F.lit(0.0)).alias("second"))
    # thousandths, so that 0.85 - 0.7 is 0.15
    ahead = F.bround((F.col("top.score") - F.col("second")) * 1000, 0) >= MARGIN * 1000
    clear = (F.col("top.score") >= RESOLVED) & ahead
    joined = requests.join(top, request, "left")
    return joined.select(*requests.columns, F.when(F.col("top").isNull(), "not_found").when(clear, "resolved").otherwise("ambiguous").alias("status"), F.col("top.score").alias("confidence"), F.when(clear, F.col("top.event_id")).alias("event_id"))


def answer(decided: DataFrame) -> DataFrame:
    """ER7: what a request for results gets: go on (catalogued or not), or a conflict with candidates."""
    return decided.withColumns({"ok": F.col("status") != "ambiguous", "status_code": F.when(F.col("status") == "ambiguous", 409), "catalog_status": F.when(F.col("status") == "resolved", "resolved").when(F.col("status") == "not_found", "uncatalogued")})


def has_any_token(tokens_: Column, name: Column) -> Column:
    """F9 for a column of tokens."""
    long_ = F.filter(tokens_, lambda t: F.length(t) > 2)
    return F.exists(F.when(F.size(long_) > 0, long_).otherwise(tokens_), lambda t: F.contains(name, t))
