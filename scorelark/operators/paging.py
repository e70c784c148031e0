"""Deep paging (O1, C1): a table clustered by its order, with the sizes and ends of its ranges beside it.

A page is then found in the list of ranges, and only the ranges that it lies in are read, whichever page it is.  A cursor, the order's
values in the last row of a page, leads to the next one and stays right when rows before it come or go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder
from .filters import PAGE_DEFAULT, PAGE_MAX, as_int

RANGE_ROWS = 100_000
#: Rows of one task that writes ranges, if they are smaller.
TASK_ROWS = 250_000


def cluster(rows: DataFrame, order: list[str], path: str | None = None, range_rows: int = RANGE_ROWS) -> str:
    """Write ``rows`` in ranges of about ``range_rows`` rows of ``order``, which must be total; where they lie."""
    path = path or new_folder(rows.sparkSession, "clustered")
    total = rows.count()
    # tasks hold many ranges, so what Spark samples and tells the driver for each task doesn't grow with the number of ranges
    n = max(1, -(-total // max(range_rows, TASK_ROWS)))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_ = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id().cast("long"), "_place": place})
    number = F.col("_part") * (1 << 33) + F.floor(F.col("_place") / range_rows)
    placed = sorted_.withColumns({"_range": number, "_place": F.col("_place") % range_rows}).drop("_part")
    placed.write.parquet(f"{path}/sorted")  # few files; the many ranges are never listed whole
    placed = rows.sparkSession.read.schema(placed.schema).parquet(f"{path}/sorted")
    placed.groupBy("_range").agg(F.count("*").alias("n"), F.max(F.struct(*order)).alias("last")).coalesce(1).write.parquet(f"{path}/ranges")
    placed.write.partitionBy("_range").parquet(f"{path}/rows")
    return path


def _rows(spark: SparkSession, path: str, ranges: list[int]) -> DataFrame:
    """The rows of some ranges, with _range and _place; only their folders are listed."""
    if not ranges:
        return spark.read.parquet(f"{path}/sorted").where("false")
    table = spark.read.option("basePath", f"{path}/rows").parquet(*(f"{path}/rows/_range={k}" for k in ranges))
    return table.where(F.col("_range").isin(ranges))


def _ranges(spark: SparkSession, path: str) -> list[tuple[int, int, int]]:
    """(range, rows before it, its rows) in order: one entry for every ``range_rows`` rows of the table."""
    out, before = [], 0
    for r in sorted(spark.read.parquet(f"{path}/ranges").select("_range", "n").collect()):
        out.append((r["_range"], before, r.n))
        before += r.n
    return out


def _limit(limit) -> int:
    return max(1, min(as_int(limit, "limit"), PAGE_MAX))


def page(spark: SparkSession, path: str, limit=PAGE_DEFAULT, offset=0) -> DataFrame:
    """O1 by offset: as ``filters.page``, from the ranges that hold the page."""
    limit, offset = _limit(limit), max(0, as_int(offset, "offset"))
    hit = [(k, before) for k, before, n in _ranges(spark, path) if before < offset + limit and before + n > offset]
    table = _rows(spark, path, [k for k, _ in hit])
    starts = F.create_map(*(F.lit(x) for pair in hit for x in pair)) if hit else F.create_map(F.lit(0), F.lit(0))
    at = starts[F.col("_range")] + F.col("_place")
    return table.withColumn("_at", at).where((F.col("_at") >= offset) & (F.col("_at") < offset + limit)).orderBy("_at").drop("_at", "_range", "_place")


def page_after(spark: SparkSession, path: str, order: list[str], cursor: tuple | None = None, limit=PAGE_DEFAULT) -> DataFrame:
    """O1 by cursor: the rows that follow the one with these values of ``order`` (none: the first page)."""
    limit = _limit(limit)
    ranges, after = _ranges(spark, path), F.lit(True)
    if cursor is not None:
        schema = spark.read.parquet(f"{path}/sorted").schema
        types = [schema[c].dataType for c in order]
        mark = lambda names: F.struct(*(F.lit(v).cast(t).alias(c) for v, t, c in zip(cursor, types, names, strict=True)))
        past = {r["_range"] for r in spark.read.parquet(f"{path}/ranges").where(F.col("last") <= mark(order)).select("_range").collect()}
        ranges = [r for r in ranges if r[0] not in past]
        after = F.struct(*order) > mark(order)
    wanted, held = [], 0
    for i, (k, _, n) in enumerate(ranges):
        if held >= limit:
            break
        wanted.append(k)
        held += n if i or cursor is None else 0  # of the first range only some rows follow
    return _rows(spark, path, wanted).where(after).orderBy(*order).limit(limit).drop("_range", "_place")
