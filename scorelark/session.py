"""Session helpers: tables of a folder, and cutting lineage through the shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Tables of a folder, read when they are asked for: ``Tables(spark, path)["orders"]``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


def package_on_workers(spark: SparkSession) -> None:
    """Python workers of this machine find the package wherever the driver's program was started."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    held = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in held.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{held}".rstrip(":")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset and Spark runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get().rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="scorelark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """Address, with its scheme, of a folder in the shared one that isn't there yet.

    All such folders of an application lie in one that is deleted when its driver program ends.
    """
    jvm = spark.sparkContext._jvm
    base = f"{shared_dir(spark)}/scorelark/{spark.sparkContext.applicationId}"
    if base not in _bases:
        _bases.add(base)
        atexit.register(_delete, spark.sparkContext, base)
    path = jvm.org.apache.hadoop.fs.Path(f"{base}/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()


_bases: set[str] = set()


def _delete(context, path: str) -> None:
    try:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the gateway may be gone at the end, then the folder stays
        return


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: a loss of executors costs no recomputation."""
    path = new_folder(df.sparkSession, name)
    schema = df.schema
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out.written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that ``written`` gave and that nothing needs any more."""
    _delete(df.sparkSession.sparkContext, df.written_at)


def computed(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` whose ``columns`` are computed once for each row: a filter on them reads them, instead of being moved below and computing them again for each time it names them."""
    return df.select(*(c for c in df.columns if c not in columns), F.inline(F.array(F.struct(*columns))))


#: Rows that a task of a large join or aggregation holds at most, about; Spark alone deals them out by their compressed size, whatever they take in memory.
TASK_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *on: str) -> DataFrame:
    """``df`` dealt out by ``on`` into tasks of about TASK_ROWS of ``rows``, the size of the largest table that meets there, so that a task's memory doesn't grow with the tables.

    Tables that give fewer such tasks than Spark shuffles into by itself on a few machines stay as they are.  Sides of a join that are dealt out for the same ``rows`` meet without another shuffle.
    """
    n = -(-rows // TASK_ROWS)
    return df.repartition(n, *on) if n > SMALL else df


#: Up to so many tasks of TASK_ROWS Spark's own choice stays.
SMALL = 24


def numbered(df: DataFrame, order: list, column: str, name: str = "numbered") -> DataFrame:
    """``df`` with ``column``, the place of each row in ``order`` (from 1), without bringing the rows into one task.

    Rows are dealt out in ranges and sorted there, and the sizes of the ranges before are added: a row of offsets for each range.  ``order``
    should be total, so that equal rows can be dealt out too.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_place": place}), name)
    before, offsets = 0, []
    for part, n in sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect()):
        offsets.append((part, before))
        before += n
    sizes = df.sparkSession.createDataFrame(offsets, "_part int, _before long")
    return placed.join(F.broadcast(sizes), "_part").select(*df.columns, (F.col("_before") + F.col("_place") + 1).alias(column))


def put_file(spark: SparkSession, path: str, text: str, replace: bool = False) -> bool:
    """Publish a small file whole: it is written and closed under another name and then gets its own, which is one step of the file system.

    Readers never see half of it.  Without ``replace`` only one of several programs succeeds; the others get False.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    at = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs = at.getFileSystem(conf)
    draft = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{uuid.uuid4().hex}.new")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    modes = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    wanted = gateway.new_array(modes, 1)
    wanted[0] = modes.OVERWRITE if replace else modes.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(draft), fs.makeQualified(at), wanted)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        return False
    finally:
        fs.delete(draft, False)
