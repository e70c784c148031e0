"""Rechecks as a stream (ST5, ST6, ST8): a page or a number says itself when it is due again.

Each thing that is polled holds a small state and one timer.  A check moves the timer on; when the timer runs out, the thing is sent
out as due, and again after every further interval in which nobody checked it.  Nothing scans the table of checks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from ..operators.scans import PENDING_DAYS, RECENT_DAYS

HOUR, DAY = 3_600_000, 86_400_000
#: As the batch rules have them: ``scans.RECHECK`` and ``scans.RECENT_RECHECK``.
RECHECK_MS, RECENT_MS = 7 * DAY, 20 * HOUR
DUE = StructType([StructField("key", StringType()), StructField("due_at", TimestampType()), StructField("checked_at", TimestampType())])
STATE = StructType([StructField("checked", LongType()), StructField("ends", LongType()), StructField("known", LongType()), StructField("timer", LongType())])


def due_at(checked: int, ends: int | None) -> int:
    """When a thing that was checked then is due again, in milliseconds: after 20 hours until three weeks after its end, else after a week.

    The first moment at which the batch rule would choose it: the daily rule holds as long as the day of asking is no later than
    three weeks after the end.
    """
    soon = checked + RECENT_MS
    until = None if ends is None else ends + (RECENT_DAYS + 1) * DAY
    return soon if until is not None and soon < until else checked + RECHECK_MS


class Rechecks(StatefulProcessor):
    """Per key: the last check, the end of its event, and a timer.  A later row about an event corrects its end, whatever order rows arrive in."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # what nobody has mentioned for so long is forgotten
        self.state = handle.getValueState("thing", STATE)

    def _move(self, checked: int, ends: int | None, known: int, old: int | None, due: int) -> None:
        if old is not None and old != due:
            self.handle.deleteTimer(old)
        if old != due:
            self.handle.registerTimer(due)
        self.state.update((checked, ends, known, due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else (None, None, None, None)
        checked, ends, known, timer = held
        for pdf in rows:
            at = pdf["checked_at"].astype("datetime64[ms]").astype("int64").to_numpy()
            for when, end in sorted(zip(at.tolist(), [None if pd.isna(e) else int(pd.Timestamp(e).value // 1_000_000) for e in pdf["end_date"]], strict=True), key=lambda r: r[0]):
                checked = when if checked is None else max(checked, when)
                if known is None or when >= known:
                    ends, known = end, when
        if checked is not None:
            # nobody is told about what was due before time had come this far, so a timer never lies in the past
            self._move(checked, ends, known, timer, max(due_at(checked, ends), timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"key": [], "due_at": [], "checked_at": []}).astype({"key": "str", "due_at": "datetime64[ns]", "checked_at": "datetime64[ns]"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        checked, ends, known, _ = self.state.get()
        due = expiredTimerInfo.getExpiryTimeInMs()
        if due - known > PENDING_DAYS * DAY:
            self.state.clear()  # ST6: given up
            return
        yield pd.DataFrame({"key": [key[0]], "due_at": [pd.Timestamp(due, unit="ms")], "checked_at": [pd.Timestamp(checked, unit="ms")]})
        # sent out again if nothing is heard: the same steps from here on, past what time has gone by
        again = due_at(due, ends)
        while again <= timerValues.getCurrentWatermarkInMs():
            again = due_at(again, ends)
        self._move(checked, ends, known, None, again)

    def close(self) -> None:
        pass


def rechecks(checks: DataFrame, late: str = "0 seconds") -> DataFrame:
    """key, due_at, checked_at from a stream of checks (key, checked_at, end_date).

    Time is event time: the newest check of anything, less ``late``, tells how far the day has come.  Needs the RocksDB state store.
    """
    marked = checks.withWatermark("checked_at", late)
    return marked.groupBy("key").transformWithStateInPandas(Rechecks(), DUE, "Append", "EventTime")
