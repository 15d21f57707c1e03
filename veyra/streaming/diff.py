"""Continuous monitoring: observations arrive as a stream, each page keeps the last one seen, and what changed comes out.

State per (case, key) is one observation; keys that are silent longer than `keep` (by watermark on the observation time) are
forgotten, so state is bounded by the pages seen within that time. The batch plan in operators.tracker is the specification of
which cells a change touches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "case_id string, key string, seen_at timestamp, change string, mentions int, previous int"


def changes(observations: DataFrame, late: str = "2 days", keep_ms: int = 30 * 24 * 3600 * 1000) -> DataFrame:
    """observations: case_id, key, seen_at (timestamp), mentions. Gives one row per new page and per change of its mentions.

    Rows later than `late` are dropped by the watermark (the feature of a stream with event time); rows of one batch are taken in
    time order; an older row than the state's is ignored; a null key is no page.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        out = []
        for row in pd.concat(list(frames)).sort_values("seen_at", kind="stable").itertuples():
            at, n = row.seen_at.value, None if pd.isna(row.mentions) else int(row.mentions)
            if last is not None and at < last[0]:
                continue
            before = None if last is None else (None if last[1] < 0 else last[1])
            if last is None or before != n:
                out.append((*key, row.seen_at, "new" if last is None else "changed", n, before))
            last = (at, -1 if n is None else n)
        if last is not None:
            state.update(last)
            state.setTimeoutTimestamp(max(last[0] // 1_000_000, state.getCurrentWatermarkMs()) + keep_ms)
        yield pd.DataFrame(out, columns=["case_id", "key", "seen_at", "change", "mentions", "previous"]).astype({"mentions": "Int32", "previous": "Int32"})

    keyed = observations.where(F.col("key").isNotNull()).withWatermark("seen_at", late)
    return keyed.groupBy("case_id", "key").applyInPandasWithState(step, OUTPUT, "at long, mentions int", "append", GroupStateTimeout.EventTimeTimeout)
