"""Inactivity sessions, bounded histories and a sliding-log rate limit, as batch plans and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.config import DEFAULT


def timed(events: DataFrame, column: str = "ts") -> DataFrame:
    """Event time as a zoned timestamp, which watermarks need."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def sessions(events: DataFrame, *, key: str = "user_id", minutes: int = DEFAULT.session_minutes, late: str | None = None) -> DataFrame:
    """``(key, session_start, session_end, n_events)``: a session ends after more than ``minutes`` without an event.

    The same plan serves batch tables and streams; a stream needs ``late``, the time that events may
    be late, which bounds its state.  ``session_end`` is the last event plus the timeout.
    """
    source = timed(events)
    source = source.withWatermark("ts", late) if late else source
    grouped = source.groupBy(key, F.session_window("ts", f"{minutes} minutes")).agg(F.count(F.lit(1)).alias("n_events"))
    return grouped.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n_events")


def session_numbers(events: DataFrame, *, key: str = "user_id", minutes: int = DEFAULT.session_minutes) -> DataFrame:
    """Every event with the number of its session, from 1."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    gap = F.col("ts").cast("timestamp") - F.lag(F.col("ts").cast("timestamp")).over(order)
    new = F.when(gap.isNull() | (gap > F.expr(f"INTERVAL {minutes} MINUTES")), 1).otherwise(0)
    return events.withColumn("_new", new).withColumn("session_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def accepted(times: list[float], limit: int, window: float = 60.0, recent: list[float] | None = None) -> tuple[list[bool], list[float]]:
    """Which of the ascending ``times`` are accepted: fewer than ``limit`` accepted within the window before; rejected ones leave no trace."""
    log, out = list(recent or []), []
    for t in times:
        log = [x for x in log if x > t - window]
        ok = len(log) < limit
        if ok:
            log.append(t)
        out.append(ok)
    return out, log


def rate_limited(requests: DataFrame, *, key: str = "user_id", window: float = 60.0) -> DataFrame:
    """``requests(key, event_id, ts, limit)`` with ``allowed``: greedy, so each key's requests are folded in order."""
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seconds", "event_id"])
        ok, _ = accepted(pdf["seconds"].tolist(), int(pdf["limit"].iloc[0]), window)
        return pd.DataFrame({key: pdf[key], "event_id": pdf["event_id"], "allowed": ok})

    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    kind = requests.schema[key].dataType.simpleString()
    return requests.select(key, "event_id", seconds.alias("seconds"), "limit").groupBy(key).applyInPandas(fold, f"{key} {kind}, event_id long, allowed boolean")


def rate_limited_stream(requests: DataFrame, limit: int, window: float = 60.0, late: str = "1 hour") -> DataFrame:
    """The same on a stream of ``(user_id, event_id, ts)``: the state is the accepted times of the last window, and expires in event time.

    Requests that come later than ``late`` are dropped.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["seconds", "event_id"])
        ok, log = accepted(rows["seconds"].tolist(), limit, window, list(state.get[0]) if state.exists else [])
        state.update((log,))
        state.setTimeoutTimestamp(max(int((rows["seconds"].iloc[-1] + window) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "allowed": ok})

    source = timed(requests).withWatermark("ts", late).select("user_id", "event_id", "ts", (F.unix_micros("ts") / 1e6).alias("seconds"))
    return source.groupBy("user_id").applyInPandasWithState(fold, "user_id long, event_id long, allowed boolean", "log array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def history_stream(messages: DataFrame, kept: int = DEFAULT.history_kept, minutes: int = DEFAULT.session_minutes, late: str = "1 hour") -> DataFrame:
    """A stream of ``(conv_id, ts, role, text)``: after each batch, every touched conversation's last messages; silent ones expire."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values("seconds")
        seconds, lines = (list(state.get[0]), list(state.get[1])) if state.exists else ([], [])
        for s, role, text in zip(rows["seconds"], rows["role"], rows["text"], strict=True):
            if seconds and s - seconds[-1] > minutes * 60:
                seconds, lines = [], []
            seconds.append(float(s))
            lines.append(f"{role}: {text}")
        seconds, lines = seconds[-kept:], lines[-kept:]
        state.update((seconds, lines))
        state.setTimeoutTimestamp(max(int((seconds[-1] + minutes * 60) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"conv_id": [key[0]], "n_kept": [len(lines)], "history": ["\n".join(lines)]})

    source = timed(messages).withWatermark("ts", late).select("conv_id", "ts", (F.unix_micros("ts") / 1e6).alias("seconds"), "role", "text")
    return source.groupBy("conv_id").applyInPandasWithState(fold, "conv_id long, n_kept int, history string", "seconds array<double>, lines array<string>", "append", GroupStateTimeout.EventTimeTimeout)
