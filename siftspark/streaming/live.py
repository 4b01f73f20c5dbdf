"""Live view of running checks, as streams of their output events: name, ts, line.

The same functions work on batches, where they answer for the time of the last event.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def heartbeats(events: DataFrame, every: str = "60 seconds", late: str | None = None) -> DataFrame:
    """Output lines of each check in windows of time; with `late`, events later than that are left out of a stream."""
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.window("ts", every).alias("w"), "name").agg(F.count("*").alias("lines"), F.max("ts").alias("last_activity")).select(F.col("w.start").alias("beat"), "name", "lines", "last_activity")


def progress(events: DataFrame) -> DataFrame:
    """State of each check: first and last activity, lines so far, the last line."""
    return events.groupBy("name").agg(F.min("ts").alias("started"), F.max("ts").alias("last_activity"), F.count("*").alias("lines"), F.max_by("line", F.struct("ts", "line")).alias("last_line"))


def liveness(now: Column, started: Column, last_activity: Column, timeout_s: Column) -> Column:
    """near timeout from 90 % of the time allowed, quiet from 120 s without output, slowing from 30 s, else active."""
    seconds = lambda a, b: F.unix_micros(a.cast("timestamp")) / 1e6 - F.unix_micros(b.cast("timestamp")) / 1e6
    quiet = seconds(now, last_activity)
    return F.when((timeout_s > 0) & (seconds(now, started) >= 0.9 * timeout_s), "near timeout").when(quiet >= 120, "quiet").when(quiet >= 30, "slowing").otherwise("active")


def outcome(timed_out: Column, budget_is_goal: Column, n_findings: Column) -> Column:
    """A check that is killed fails, unless using up its time was the point."""
    return F.when(timed_out & ~budget_is_goal, "ERROR").when(n_findings > 0, "FINDINGS").otherwise("PASS")


def interrupted(planned: DataFrame, finished: DataFrame) -> DataFrame:
    """Checks that a stop leaves without a result."""
    return planned.select("name").join(finished.select("name").distinct(), "name", "left_anti").select("name", F.lit("ERROR").alias("status"), F.lit("stopped before it finished").alias("note"))


def recent(finished: DataFrame, n: int = 8) -> DataFrame:
    """finished: name, ended. The last n that ended."""
    return finished.orderBy(F.desc("ended"), F.desc("name")).limit(n)


def queued(counts: DataFrame) -> DataFrame:
    """counts: total, done, running. With how many checks still wait."""
    return counts.withColumn("queued", F.greatest(F.lit(0).cast("long"), F.col("total") - F.col("done") - F.col("running")))


def whole_lines(chunks: DataFrame) -> DataFrame:
    """chunks: name, seq, chunk: output in pieces that end anywhere. name and line, once a line is whole; what is left at the end is a line of its own.

    In a stream the unfinished line of each name is the state; a piece that is null ends the output, and what is left
    comes out. In a batch the pieces of a name, which a run keeps up to a bound, are put together in order.
    """
    if not chunks.isStreaming:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: x.chunk), "")
        lines = chunks.groupBy("name").agg(F.split(joined, "\n").alias("lines"))
        kept = F.when(F.element_at("lines", -1) == "", F.slice("lines", 1, F.size("lines") - 1)).otherwise(F.col("lines"))
        return lines.select("name", F.explode(kept).alias("line"))
    return chunks.groupBy("name").applyInPandasWithState(_carry, "name string, line string", "rest string", "append", "NoTimeout")


def _carry(key: tuple, pieces: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    came = pd.concat(list(pieces)).sort_values("seq")["chunk"]
    lines = ((state.get[0] if state.exists else "") + "".join(came.dropna())).split("\n")
    if came.isna().any():
        if state.exists:
            state.remove()
        if not lines[-1]:
            lines.pop()
    else:
        state.update((lines.pop(),))
    yield pd.DataFrame({"name": [key[0]] * len(lines), "line": lines})
