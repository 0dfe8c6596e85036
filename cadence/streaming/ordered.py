"""Streaming forms (an extension): runs over possessions and windowed counts with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "lineup string, first bigint, last bigint, n bigint"
_OUT = "game_id long, lineup string, first_index long, last_index long, possessions long"


def _runs(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Closed runs of one game; the open run is the state, so it is bounded whatever the stream."""
    now = state.get if state.exists else None
    done = []
    if state.hasTimedOut:
        done.append((key[0], *now))
        state.remove()
    else:
        rows = pd.concat(list(frames)).sort_values("sequence_index")
        for lineup, index in zip(rows["lineup"], rows["sequence_index"]):
            if now is not None and lineup == now[0] and index == now[2] + 1:
                now = (now[0], now[1], int(index), now[3] + 1)
            else:
                if now is not None:
                    done.append((key[0], *now))
                now = (lineup, int(index), int(index), 1)
        state.update(now)
        state.setTimeoutDuration(600_000)
    yield pd.DataFrame(done, columns=["game_id", "lineup", "first_index", "last_index", "possessions"])


def streaming_runs(possessions: DataFrame) -> DataFrame:
    """Runs as they close: (game_id, lineup, sequence_index) in order within each game."""
    return possessions.select("game_id", "lineup", "sequence_index").groupBy("game_id").applyInPandasWithState(_runs, _OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by window, user and kind; rows later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "user_id", "event_type", "n")


def streaming_attribution(events: DataFrame, windows: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events joined to the window they fall into: equality on team, times within [start, finish)."""
    e = events.withWatermark("ts", late).alias("e")
    w = windows.withWatermark("start", late).alias("w")
    return e.join(w, F.expr("e.team = w.team AND e.ts >= w.start AND e.ts < w.finish")).select("e.*", F.col("w.window_id").alias("window_id"))
