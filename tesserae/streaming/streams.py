"""Streaming forms of the operators that need no look-ahead, and the delayed form of one that does."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """With a watermark, which takes a timestamp with a zone."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling_counts(events: DataFrame, time: str = "ts", key: str = "event_type", size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, key, n, total) of each window and key, once the window is over."""
    grouped = _timed(events, time, late).groupBy(F.window(time, size), key)
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n) of runs of events at most a gap apart."""
    grouped = _timed(events, time, late).groupBy(F.session_window(time, gap), key)
    return grouped.agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(lines: DataFrame, time: str = "ts", keys: tuple[str, ...] = ("key",), late: str = "10 minutes") -> DataFrame:
    """Each key's first row within the watermark."""
    return _timed(lines, time, late).dropDuplicatesWithinWatermark(list(keys))


def delayed_cuts(events: DataFrame, key: str = "user_id", value: str = "value", time: str = "ts", k: int = 5, spike: float = 150.0, stable: float = 35.0) -> DataFrame:
    """(key, ts, mad, win): stability-gated spikes, each given out k rows later, when its centred window is
    complete. State holds the last 2k+1 steps of a key. Rows have to come in order within a key."""
    kind = events.schema[key].dataType.simpleString()

    def step(k_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, steps = state.get if state.exists else (None, "")
        kept = [(int(t), float(m)) for t, m in (s.split(":") for s in steps.split(",") if s)]  # times in microseconds
        out = []
        for b in batches:
            for t, v in b.sort_values(time)[[time, value]].itertuples(index=False):
                kept.append((int(t.asm8.astype("datetime64[us]").astype("int64")), abs(float(v) - last) if last is not None else 0.0))
                last = float(v)
                if len(kept) == 1:
                    kept = kept * (k + 1)  # the series' beginning, repeated outwards
                if len(kept) > 2 * k + 1:
                    kept.pop(0)
                if len(kept) == 2 * k + 1:
                    win = sorted(m for _, m in kept)[k]
                    at, mad = kept[k]
                    if mad > spike and win < stable:
                        out.append((k_[0], pd.Timestamp(at, unit="us"), mad, win))
        state.update((last, ",".join(f"{t!r}:{m!r}" for t, m in kept)))
        yield pd.DataFrame(out, columns=[key, time, "mad", "win"])

    return events.select(key, time, value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {time} timestamp, mad double, win double", "last double, steps string", "append", GroupStateTimeout.NoTimeout)


def held_cuts(events: DataFrame, thr: float, hold: int, key: str = "user_id", value: str = "value", time: str = "ts", order: str = "event_id") -> DataFrame:
    """(key, order): a row that stays over `thr` away from the last kept one for `hold` rows running becomes the
    next kept row; a key's first row is one. State holds the kept value and the run, whatever the length of the
    series. Rows have to come in order within a key from batch to batch."""
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, order)}

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, run = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values([time, order])
        out = []
        for v, at in rows[[value, order]].itertuples(index=False):
            run = run + 1 if kept is not None and abs(v - kept) > thr else 0
            if kept is None or run >= hold:
                kept, run = float(v), 0
                out.append((k[0], at))
        state.update((kept, run))
        yield pd.DataFrame(out, columns=[key, order])

    return events.select(key, order, time, value).groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}", "kept double, run int", "append", GroupStateTimeout.NoTimeout)
