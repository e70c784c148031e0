"""Keyed tables as snapshot folders (SNK4, U6-U8, U12, U14)."""

from __future__ import annotations

import json
import time
import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import put_file


def upsert(current: DataFrame, new: DataFrame, key: list[str], newest: str | None = None, keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``new`` replace those with the same key; columns in ``keep_if_null`` keep the old value where the new is null.

    Several new rows of one key: the largest ``newest`` wins.  One union and one shuffle by key.
    """
    both = current.select("*", F.lit(0).alias("_side")).unionByName(new.select("*", F.lit(1).alias("_side")), allowMissingColumns=True)
    order = [F.desc("_side"), *([F.desc_nulls_last(newest)] if newest else []), F.desc(F.xxhash64(*current.columns))]
    w = W.partitionBy(*key).orderBy(*order)
    ranked = both.withColumns({"_n": F.row_number().over(w)} | {f"_old_{c}": F.max(F.when(F.col("_side") == 0, F.col(c))).over(W.partitionBy(*key)) for c in keep_if_null})
    first = ranked.where("_n = 1")
    return first.select(*(F.coalesce(c, f"_old_{c}").alias(c) if c in keep_if_null else c for c in current.columns))


def insert_ignore(current: DataFrame, new: DataFrame, key: list[str], order: list) -> DataFrame:
    """New rows whose key is not there yet, the first of each key."""
    first = new.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
    return current.unionByName(first.join(current.select(*key), key, "left_anti").select(*current.columns))


def replace_sheets(entries: DataFrame, new: DataFrame) -> DataFrame:
    """SNK4: all entries of the sheets in ``new`` are replaced."""
    return entries.join(new.select("sheet_url").distinct(), "sheet_url", "left_anti").select(*new.columns).unionByName(new)


class Conflict(RuntimeError):
    """Another writer has published the version that this one was about to publish."""


class Snapshots:
    """A table as versions (U14): readers see the old or the new state, never half, and never none.

    Data go to a folder of their own.  A version is a numbered file in ``_log`` that lists the folders it consists of, and
    the highest one is the table.  Nothing that a version needs is moved or deleted when the next one is
    published, so a writer may stop at any point.  A writer's number is one more than that of the version it has read, and its file
    appears whole and only if there is none of that number: of two writers that read the same version one gets a Conflict.  ``merge`` deals rows to a fixed number of buckets by key and rewrites only the buckets
    that new rows fall into; the other folders stay part of the table.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, kept: int = 5):
        self.spark, self.path, self.buckets, self.kept = spark, path.rstrip("/"), buckets, kept
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def _versions(self) -> list[str]:
        return [n for n in self._names(f"{self.path}/_log") if n.isdigit()]

    def _version(self, name: str) -> dict:
        stream = self.fs.open(self._path(f"{self.path}/_log/{name}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> dict | None:
        """The newest version: number, schema and folders by bucket."""
        names = self._versions()
        return self._version(names[-1]) if names else None

    def read(self) -> DataFrame | None:
        version = self.current()
        return self._rows(version, list(version["folders"].values())) if version else None

    def _rows(self, version: dict, folders: list[str]) -> DataFrame:
        schema = StructType.fromJson(version["schema"])
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def commit(self, df: DataFrame) -> int:
        """The table is ``df`` from now on."""
        number, folder = self._after(self.current()), f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return self._publish(number, df.schema, {"all": folder})

    def merge(self, new: DataFrame, key: list[str], newest: str | None = None, keep_if_null: tuple[str, ...] = ()) -> int:
        """Upsert ``new``; only buckets that it has rows for are read and written."""
        version = self.current()
        bucket = F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")
        touched = [str(r[0]) for r in new.select(bucket).distinct().collect()]  # at most ``buckets``
        folders = version["folders"] if version else {}
        known = [f for b, f in folders.items() if b in touched or b == "all"]
        old = self._rows(version, known) if version else new.limit(0)
        rows = upsert(old, new, key, newest, keep_if_null)
        folder = f"v-{uuid.uuid4().hex}"
        # one task per bucket; what a whole-table commit left is dealt to buckets now
        rows.withColumn("_bucket", bucket).repartition(self.buckets, "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        made = {n.partition("=")[2]: f"{folder}/{n}" for n in self._names(f"{self.path}/{folder}") if n.startswith("_bucket=")}
        return self._publish(self._after(version), old.schema, {b: f for b, f in folders.items() if b != "all"} | made)

    @staticmethod
    def _after(version: dict | None) -> int:
        return version["number"] + 1 if version else 1

    def _publish(self, number: int, schema: StructType, folders: dict[str, str]) -> int:
        if not put_file(self.spark, f"{self.path}/_log/{number:012d}", json.dumps({"number": number, "schema": json.loads(schema.json()), "folders": folders})):
            raise Conflict(f"version {number} of {self.path}")
        return number

    def vacuum(self, orphan: timedelta = timedelta(days=1)) -> list[str]:
        """Delete all but the newest ``kept`` versions, the folders that none of those needs, and folders older than ``orphan`` of writers that
        stopped before they published; returns these folders."""
        names = self._versions()
        stay, old = names[-self.kept :], names[: -self.kept]
        folders = lambda versions: {f.partition("/")[0] for v in map(self._version, versions) for f in v["folders"].values()}
        needed, known = folders(stay), folders(old)
        at = self._path(self.path)
        now = time.time() * 1000
        found = {f.getPath().getName(): f.getModificationTime() for f in self.fs.listStatus(at)} if self.fs.exists(at) else {}
        gone = sorted(n for n, changed in found.items() if n.startswith("v-") and n not in needed and (n in known or now - changed > orphan.total_seconds() * 1000))
        for folder in gone:
            self.fs.delete(self._path(f"{self.path}/{folder}"), True)
        for name in old:
            self.fs.delete(self._path(f"{self.path}/_log/{name}"), False)
        return gone
