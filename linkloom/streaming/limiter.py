"""ST3, ST7, M5, O7: the per-host rate limiter, as a stream and as a batch fold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from linkloom.functions.hosts import rate_key

#: Rows that a key passes on together.
SLICE = 10_000
RESULT = "rate_key string, event_id long, t_ms long, admitted boolean"


def keyed(requests: DataFrame) -> DataFrame:
    """(event_id, t_ms, host) with the limiter's key and delay."""
    return requests.withColumn("__k", rate_key(F.col("host"))).select("event_id", "t_ms", F.col("__k.rate_key").alias("rate_key"), F.col("__k.delay_s").cast("long").alias("delay_s"))


def admit(times: np.ndarray, delays: np.ndarray, next_ms: int) -> tuple[np.ndarray, int]:
    """Which of a host's requests, in order of time, pass: one does if the host's time has come, and moves it on.

    Refused ones are jumped over: the next to pass is found by bisection.
    """
    out = np.zeros(len(times), bool)
    at = int(np.searchsorted(times, next_ms))
    while at < len(times):
        out[at] = True
        next_ms = int(times[at]) + 1000 * int(delays[at])
        at = max(at + 1, int(np.searchsorted(times, next_ms)))
    return out, next_ms


def batch_limited(requests: DataFrame) -> DataFrame:
    """The fold over each key's requests in order of time, streamed through Arrow batches.

    Rows are sorted by key and time within partitions, and only a counter per key is held, so a
    hot key costs time but no memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, next_ms = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch["rate_key"].dictionary_encode(null_encoding="encode")
            codes, names = keys.indices.to_numpy(zero_copy_only=False), keys.dictionary.to_pylist()
            times, delays = batch["t_ms"].to_numpy(), batch["delay_s"].to_numpy()
            passed = np.zeros(len(times), bool)
            cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if names[codes[a]] != key:
                    key, next_ms = names[codes[a]], -(2**62)
                passed[a:b], next_ms = admit(times[a:b], delays[a:b], next_ms)
            yield pa.RecordBatch.from_arrays([batch["rate_key"], batch["event_id"], batch["t_ms"], pa.array(passed)], ["rate_key", "event_id", "t_ms", "admitted"])

    return keyed(requests).repartition("rate_key").sortWithinPartitions("rate_key", "t_ms", "event_id").mapInArrow(run, RESULT)


def stream_limited(requests: DataFrame) -> DataFrame:
    """The same as a stateful stream: one value of state per key.

    A micro-batch's requests of a key are put in order first; of each only its number, time and
    delay are held while that is done, and the source's trigger limits bound how many there are.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [(f.t_ms.to_numpy(), f.event_id.to_numpy(), f.delay_s.to_numpy()) for f in frames]
        times, events, delays = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((events, times))
        (next_ms,) = state.get if state.exists else (-(2**62),)
        passed, next_ms = admit(times[order], delays[order], next_ms)
        state.update((int(next_ms),))
        for at in range(0, len(order), SLICE):
            some = order[at : at + SLICE]
            yield pd.DataFrame({"rate_key": key[0], "event_id": events[some], "t_ms": times[some], "admitted": passed[at : at + SLICE]})

    return keyed(requests).groupBy("rate_key").applyInPandasWithState(run, RESULT, "next_ms long", "append", GroupStateTimeout.NoTimeout)
