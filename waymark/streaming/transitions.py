"""Transitions between an entity's successive observations, as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "road_id long, from_status string, to_status string, seen long"


def detect(stream: DataFrame) -> DataFrame:
    """A row for each change of status in a stream of (road_id, seen, status). The state of
    an entity is its last status and time; late rows (not after that time) are dropped."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at = state.get if state.exists else (None, -1)
        out = []
        for r in pd.concat(list(frames)).sort_values("seen").itertuples():
            if r.seen <= at:
                continue
            if last is not None and r.status != last:
                out.append((key[0], last, r.status, r.seen))
            last, at = r.status, int(r.seen)
        state.update((last, at))
        yield pd.DataFrame(out, columns=["road_id", "from_status", "to_status", "seen"])

    return stream.groupBy("road_id").applyInPandasWithState(step, OUT, "status string, seen long", "append", GroupStateTimeout.NoTimeout)
