"""The daily job and single runs (ST1, ST2, ST10, U10, U11, A28)."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import SparkSession

from ..session import put_file

STALE = {"calendar": timedelta(hours=2), "index": timedelta(hours=3), "daily": timedelta(hours=12)}
MAX_ERRORS = 200


class AlreadyRunning(RuntimeError):
    """Another run of the source holds the lock."""


class Runs:
    """Run records of the driver program: a few rows, not data."""

    def __init__(self):
        self.rows: list[dict] = []

    def begin(self, source: str, now: datetime, stale: timedelta | None = None) -> dict:
        """One run per source at a time; a run that began too long ago is taken over."""
        limit = stale or STALE.get(source, STALE["daily"])
        for row in self.rows:
            if row["source"] == source and row["status"] == "running":
                if now - row["started_at"] < limit:
                    raise AlreadyRunning(source)
                row |= {"status": "failed", "finished_at": now, "errors": [*row["errors"], "stale run taken over"]}
        row = {"id": len(self.rows) + 1, "source": source, "started_at": now, "finished_at": None, "status": "running", "errors": [], "warnings": [], "steps": {}}
        self.rows.append(row)
        return row

    def end(self, row: dict, now: datetime, status: str, **fields) -> dict:
        """U11, O13."""
        row |= {"finished_at": now, "status": status} | fields
        row["errors"] = row["errors"][:MAX_ERRORS]
        return row

    def interrupted(self, now: datetime) -> int:
        """ST10: at start-up runs that never ended have failed."""
        open_ = [r for r in self.rows if r["status"] == "running"]
        for r in open_:
            self.end(r, now, "failed", errors=[*r["errors"], "interrupted"])
        return len(open_)

    def due(self, source: str, interval: timedelta, now: datetime) -> bool:
        """ST2, A6."""
        good = [r["finished_at"] for r in self.rows if r["source"] == source and r["status"] == "success"]
        return not good or max(good) + interval <= now


_TIMES = ("started_at", "finished_at")


class StoredRuns(Runs):
    """Run records and locks in a folder that all programs share, so they outlive the program (U10, ST10).

    A lock is the last of a source's numbered files; it is free once a file beside it says so.  Whoever finds it free or stale publishes
    the next number, which only one program can, so nothing is moved and no fresh lock is taken for a stale one.
    """

    def __init__(self, spark: SparkSession, path: str):
        super().__init__()
        self.spark, self.path, self._jvm = spark, path.rstrip("/"), spark.sparkContext._jvm
        self.held: dict[str, int] = {}
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.load()

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _read(self, name: str) -> dict:
        stream = self.fs.open(self._at(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write(self, name: str, value: dict, replace: bool) -> bool:
        return put_file(self.spark, f"{self.path}/{name}", json.dumps(value, default=lambda t: t.isoformat()), replace)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(at) if not f.getPath().getName().startswith(".")) if self.fs.exists(at) else []

    def load(self) -> None:
        """The records of all programs, oldest first."""
        rows = [self._read(f"runs/{n}") for n in self._names("runs")]
        self.rows = sorted((r | {c: r[c] and datetime.fromisoformat(r[c]) for c in _TIMES} for r in rows), key=lambda r: r["id"])

    def begin(self, source: str, now: datetime, stale: timedelta | None = None) -> dict:
        folder = f"locks/{source}"
        names = self._names(folder)
        last = max((int(n) for n in names if n.isdigit()), default=0)
        if last and f"{last:012d}.free" not in names:
            held = self._read(f"{folder}/{last:012d}")
            if now - datetime.fromisoformat(held["at"]) < (stale or STALE.get(source, STALE["daily"])):
                raise AlreadyRunning(source)
        if not self._write(f"{folder}/{last + 1:012d}", {"at": now}, False):
            raise AlreadyRunning(source)  # another program was quicker
        self.held[source] = last + 1
        for name in names:
            if int(name[:12]) < last:
                self.fs.delete(self._at(f"{folder}/{name}"), False)
        self.load()
        for row in self.rows:
            if row["source"] == source and row["status"] == "running":
                self._save(super().end(row, now, "failed", errors=[*row["errors"], "stale run taken over"]))
        row = super().begin(source, now, stale)
        while not self._write(f"runs/{row['id']:012d}.json", row, False):  # another source's program took the number
            row["id"] += 1
        return row

    def _save(self, row: dict) -> dict:
        self._write(f"runs/{row['id']:012d}.json", row, True)
        return row

    def end(self, row: dict, now: datetime, status: str, **fields) -> dict:
        self._save(super().end(row, now, status, **fields))
        if number := self.held.pop(row["source"], None):
            self._write(f"locks/{row['source']}/{number:012d}.free", {"at": now}, True)
        return row


def run_steps(runs: Runs, source: str, steps: list[tuple[str, Callable[[], object]]], clock: Callable[[], datetime]) -> dict:
    """ST1, A28: the steps in order; one that fails is noted and the others still run."""
    row = runs.begin(source, clock())
    for name, step in steps:
        try:
            row["steps"][name] = {"ok": True, "result": step()}
        except Exception as e:  # a step's failure is a result of the job
            row["steps"][name] = {"ok": False, "error": str(e)}
            row["errors"].append(f"{name}: {e}")
    good = all(s["ok"] for s in row["steps"].values())
    return runs.end(row, clock(), "success" if good else "failed")
