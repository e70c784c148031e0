"""Summaries that are kept up to date (A7, A12, A25): changes are merged into them instead of counting everything again.

A change is a row with a weight: 1 for a row that came, -1 for one that went.  Counts and sums take changes as they are.  Smallest and
largest values take what came; only keys that lost a value as extreme as theirs are looked up in the rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Per key n, and for each value its sum, least and most, of whole numbers."""
    each = [f(F.col(v)).alias(f"{name}_{v}") for v in values for name, f in (("sum", F.sum), ("least", F.min), ("most", F.max))]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *each)


def merged(state: DataFrame, changes: DataFrame, rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The summary after ``changes`` (keys, values, weight); ``rows`` are all rows after them, of which only some keys are read.

    A key without rows left is gone.  A null value counts for n alone.
    """
    came, w = F.col("weight") > 0, F.col("weight")
    parts = [F.sum("weight").alias("_n")]
    for v in values:
        c = F.col(v)
        parts += [F.sum(w * c).alias(f"_sum_{v}"), F.min(F.when(came, c)).alias(f"_least_{v}"), F.max(F.when(came, c)).alias(f"_most_{v}"), F.min(F.when(~came, c)).alias(f"_gone_least_{v}"), F.max(F.when(~came, c)).alias(f"_gone_most_{v}")]
    delta = changes.groupBy(*keys).agg(*parts)
    both = state.join(delta, keys, "full")
    # an extreme value may be lost if one as extreme went; what the change brought itself may be what went
    unsure = F.lit(False)
    for v in values:
        unsure |= F.coalesce(F.col(f"_gone_least_{v}") <= F.least(f"least_{v}", f"_least_{v}"), F.lit(False)) | F.coalesce(F.col(f"_gone_most_{v}") >= F.greatest(f"most_{v}", f"_most_{v}"), F.lit(False))
    n = F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))
    new = both.withColumns({"_unsure": unsure & F.col("_n").isNotNull(), "_total": n}).where("_total > 0")
    again = summary(rows.join(new.where("_unsure").select(*keys), keys, "left_semi"), keys, values)
    again = again.select(*keys, *(F.col(c).alias("_again_" + c) for c in again.columns if c not in keys))
    out = new.join(again, keys, "left")
    columns = [F.col("_total").alias("n")]
    for v in values:
        total = F.when(F.col("_unsure"), F.col(f"_again_sum_{v}")).otherwise(F.when(F.col(f"sum_{v}").isNull() & F.col(f"_sum_{v}").isNull(), None).otherwise(F.coalesce(f"sum_{v}", F.lit(0)) + F.coalesce(f"_sum_{v}", F.lit(0))))
        columns += [total.alias(f"sum_{v}"), F.when(F.col("_unsure"), F.col(f"_again_least_{v}")).otherwise(F.least(f"least_{v}", f"_least_{v}")).alias(f"least_{v}"), F.when(F.col("_unsure"), F.col(f"_again_most_{v}")).otherwise(F.greatest(f"most_{v}", f"_most_{v}")).alias(f"most_{v}")]
    return out.select(*keys, *columns)
