"""Raw pages per run, of which the newest runs are kept (SNK1, W11), and JSON output (SNK2, SNK3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RUNS_KEPT = 14


def write_pages(pages: DataFrame, path: str) -> None:
    """SNK1: pages by run; a run written again replaces itself only."""
    pages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def retained(runs: DataFrame, kept: int = RUNS_KEPT) -> DataFrame:
    """The runs that stay; ``runs`` has one row per run, so one window over it is small."""
    return runs.select("run_id").distinct().withColumn("_n", F.dense_rank().over(W.orderBy(F.desc("run_id")))).where(F.col("_n") <= kept).drop("_n")


def drop_old(spark, path: str, kept: int = RUNS_KEPT) -> list[str]:
    """SNK1: delete the folders of older runs; returns them."""
    runs = spark.read.parquet(path).select("run_id").distinct()
    old = [r[0] for r in runs.join(retained(runs, kept), "run_id", "left_anti").orderBy("run_id").collect()]
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for run in old:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, f"run_id={run}"), True)
    return [str(r) for r in old]


def as_json(df: DataFrame) -> DataFrame:
    """SNK2, SNK3: one JSON document per row, nulls included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
