"""ST4: which requests may start, as a stream: none for a page that is queued or in flight."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RESULT = "host string, path string, event_id long, admitted boolean"


def admitted_starts(starts: np.ndarray, busy: bool) -> tuple[np.ndarray, bool]:
    """Which of a page's events, in order, are starts that pass; a start makes it busy, a finish frees it."""
    before = np.concatenate([[busy], starts[:-1]])
    return starts & ~before, bool(starts[-1])


def in_flight(events: DataFrame) -> DataFrame:
    """(host, path, event_id, admitted) for each start of a stream of (host, path, event_id, starts).

    One flag of state per page, kept only while the page is busy. A micro-batch's events of a page
    are put in order of their number first.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [(f.event_id.to_numpy(), f.starts.to_numpy()) for f in frames]
        numbers, starts = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.argsort(numbers, kind="stable")
        starts = starts[order].astype(bool)
        passed, busy = admitted_starts(starts, state.exists)
        if busy:
            state.update((True,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"host": key[0], "path": key[1], "event_id": numbers[order][starts], "admitted": passed[starts]})

    return events.groupBy("host", "path").applyInPandasWithState(run, RESULT, "busy boolean", "append", GroupStateTimeout.NoTimeout)
