"""Cutting lineage through the shared folder that the cluster names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import session
from ..session import discard, new_folder

__all__ = ["discard", "new_folder", "written"]


def written(spark: SparkSession, df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a loss of executors costs no recomputation."""
    return session.written(df, name, **options)
