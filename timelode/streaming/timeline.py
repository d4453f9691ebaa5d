"""Streaming forms of the timeline operators, for segments and events that arrive late or twice."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SESSION_SCHEMA = "key string, start_ms bigint, end_ms bigint, rows bigint"
_STATE = "start_ms bigint, end_ms bigint, rows bigint, pending array<struct<s:bigint,e:bigint>>"


def once_each(stream: DataFrame, *, row_id: str, time: str, late: str) -> DataFrame:
    """Each row id once, as long as its repeats come within `late` of each other."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([row_id])


def activity(stream: DataFrame, *, time: str, kind: str, late: str, width: str) -> DataFrame:
    """Rows per kind and tumbling window; rows later than `late` are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), kind).agg(F.count("*").alias("rows")).select(
        F.col("window.start").alias("window_start"), kind, "rows"
    )


def pause_sessions(stream: DataFrame, *, key: str, time: str, late: str, pause: str) -> DataFrame:
    """Sessions of a key that end by a pause alone."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, pause).alias("session"), key).agg(F.count("*").alias("rows")).select(
        key, F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), "rows"
    )


def bounded_sessions(stream: DataFrame, *, key: str, time: str, end: str, late: str, min_ms: int, max_ms: int, pause_ms: int) -> DataFrame:
    """The greedy sessions of the batch operator on a stream (`time` and `end` are timestamps): rows wait in
    state until the watermark passes them, then join sessions in order; a session is emitted once closed,
    the last one when the watermark has passed its longest possible end."""

    def advance(key_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, rows, pending = state.get if state.exists else (None, None, 0, [])
        pending = [tuple(p) for p in pending]
        for part in parts:
            pending += list(zip(part["s"].tolist(), part["e"].tolist(), strict=True))
        mark = state.getCurrentWatermarkMs()
        ready = sorted(p for p in pending if p[0] < mark)
        pending = [p for p in pending if p[0] >= mark]
        done = []
        for s, e in ready:
            e = max(s, e)
            if start is None:
                start, last, rows = s, e, 1
            elif last - start >= min_ms and (e - start > max_ms or s - last >= pause_ms):
                done.append((key_[0], start, last, rows))
                start, last, rows = s, e, 1
            else:
                last, rows = e, rows + 1
        if start is not None and not pending and mark > max(last + pause_ms, start + max_ms):
            done.append((key_[0], start, last, rows))
            start, last, rows = None, None, 0
        if start is None and not pending:
            state.remove()
        else:
            state.update((start, last, rows, [list(p) for p in pending]))
            state.setTimeoutTimestamp(max(mark + 1, (last or pending[0][0]) + pause_ms + max_ms))
        yield pd.DataFrame(done, columns=["key", "start_ms", "end_ms", "rows"])

    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    rows = stream.withWatermark(time, late).select(F.col(key).alias("key"), F.col(time), ms(time).alias("s"), ms(end).alias("e"))
    return rows.groupBy("key").applyInPandasWithState(advance, SESSION_SCHEMA, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
