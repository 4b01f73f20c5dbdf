"""Running checks watched by timers: a check that says nothing becomes slow, quiet, near its timeout and timed out by the passing of time alone.

The state of a check is one value; its one timer stands at the next moment at which its class can change. Both are in
the state store, so that a stream that is started again goes on with them. Needs the RocksDB state store (PROVIDER).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siftspark.session import importable

#: Setting and value that transformWithState asks for.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
STATE = "started long, last long, timeout long, goal boolean, lines long, line string, said string"
OUT = "name string, state string, status string, lines long, last_line string, elapsed_s double, quiet_s double"
#: Escape sequences of terminals, and how much of a line is kept; fixed values.
ESCAPES = re.compile(r"\x1b\[[0-9;]*[A-Za-z]")
KEPT = 180


class Watch(StatefulProcessor):
    """Rows come out when a check's class changes and when it ends."""

    def __init__(self, slow_s: float, quiet_s: float, near: float):
        self.slow, self.quiet, self.near = int(slow_s * 1000), int(quiet_s * 1000), near

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.check = handle.getValueState("check", STATE)

    def close(self) -> None:
        """Nothing to let go of."""

    def _said(self, now: int, started: int, last: int, timeout: int) -> str:
        if timeout and now - started >= timeout:
            return "timed out"
        if timeout and now - started >= self.near * timeout:
            return "near timeout"
        return "quiet" if now - last >= self.quiet else "slowing" if now - last >= self.slow else "active"

    def _settle(self, key: tuple, now: int, value: list, ended: str | None = None) -> Iterator[pd.DataFrame]:
        """Say what is new, keep the value and set the timer, or clear both where the check has ended."""
        started, last, timeout, goal, lines, line, said = value
        state = "finished" if ended else self._said(now, started, last, timeout)
        status = ended or ("PASS" if goal else "ERROR") if state in ("finished", "timed out") else None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status:
            self.check.clear()
        else:
            self.check.update((started, last, timeout, goal, lines, line, state))
            moments = [last + self.slow, last + self.quiet, *([started + int(self.near * timeout) + 1, started + timeout] if timeout else [])]
            if later := [m for m in moments if m > now]:
                self.handle.registerTimer(min(later))
        if state != said:
            yield pd.DataFrame({"name": [key[0]], "state": [state], "status": [status], "lines": [lines], "last_line": [line], "elapsed_s": [(now - started) / 1000], "quiet_s": [(now - last) / 1000]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        value = list(self.check.get()) if self.check.exists() else None
        ended = None
        came = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for event, line, timeout, goal in zip(came["event"], came["line"], came["timeout_s"], came["goal"]):
            if event == "start":
                value, ended = [now, now, 0 if pd.isna(timeout) else int(timeout * 1000), bool(goal) if not pd.isna(goal) else False, 0, "spawned process", None], None
            elif value and event == "finish":
                ended = line or "PASS"
            elif value and event == "line" and (clean := ESCAPES.sub("", line or "").strip()):
                value[1], value[4], value[5] = now, value[4] + 1, clean[-KEPT:]
        if value:
            yield from self._settle(key, now, value, ended)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.check.exists():
            yield from self._settle(key, timerValues.getCurrentProcessingTimeInMs(), list(self.check.get()))


def watched(events: DataFrame, slow_s: float = 30, quiet_s: float = 120, near: float = 0.9) -> DataFrame:
    """events, a stream: name, seq (their order), event (start, line or finish), line (of a finish: the status), timeout_s and goal (of a start; goal: using up the time is the point).

    A row whenever a check's class changes: active, slowing, quiet, near timeout (from that part of its timeout on),
    timed out, finished. One that is timed out fails, or passes if that was the point. Lines of nothing but white
    space and escape sequences are no activity; events of a check that hasn't started, or has ended, say nothing.
    """
    importable(events.sparkSession)
    events = events.selectExpr("name", "seq", "event", "line", "CAST(timeout_s AS DOUBLE) AS timeout_s", "goal")
    return events.groupBy("name").transformWithStateInPandas(statefulProcessor=Watch(slow_s, quiet_s, near), outputStructType=OUT, outputMode="append", timeMode="processingTime")
