"""Corpus pipeline: documents in, packed training sequences out.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorelark.llm import decontaminate, language, lines, near, packing
from scorelark.llm.storage import written

STAGES = [
    ("language", language.accept),
    ("line_dedup", lines.stage),
    ("near_duplicates", near.stage),
    ("decontamination", decontaminate.clean),
    ("packing", packing.stage),
]
#: Language identification learns from the table and can't be put in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
