"""Streaming faces: windowed counts with watermarks, and threshold runs as a stateful operator.

The same functions take batch and streaming tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, size: str, hop: str, late: str | None = None) -> DataFrame:
    """start, event_type, n, s: count and sum of values in tumbling or hopping windows; events later than `late` are let go."""
    own = events.withWatermark("ts", late) if late else events
    got = own.groupBy(F.window("ts", size, hop), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    return got.select(F.col("window.start").alias("start"), "event_type", "n", "s")


def threshold_runs(events: DataFrame, threshold: float) -> DataFrame:
    """user_id, t0, t1, n: runs of values at or over the threshold, as they end, each user's state kept between batches.

    Rows must come in order of time within a user, up to the order within one micro-batch, which is restored.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = list(state.get) if state.exists else [None, None, 0]
        rows = []
        if not state.hasTimedOut:
            batch = pd.concat(list(parts)).sort_values("ts", kind="stable")
            for ts, value in zip(batch["ts"], batch["value"], strict=True):
                t = ts.timestamp()
                if value >= threshold:
                    open_ = [t if open_[0] is None else open_[0], t, open_[2] + 1]
                elif open_[0] is not None:
                    rows.append((*key, *open_))
                    open_ = [None, None, 0]
        state.update(tuple(open_))
        yield pd.DataFrame(rows, columns=["user_id", "t0", "t1", "n"])

    return events.select("user_id", "ts", "value").groupBy("user_id").applyInPandasWithState(
        step, "user_id long, t0 double, t1 double, n long", "t0 double, t1 double, n long", "append", GroupStateTimeout.NoTimeout
    )
