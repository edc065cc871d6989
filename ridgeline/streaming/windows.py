"""Adaptive windows over a live stream.

One stateful operator holds the open window of each stream key: its counts and the hashes seen, eight bytes each.  Events are ordered
inside each micro-batch; what arrives in a later batch counts as later.  The result equals the batch operator when
batches follow the total order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ridgeline.operators.windows import KINDS, PIECE, Scan, Thresholds, piece_of

STREAM_SCHEMA = "stream string, idx bigint, ts_start bigint, ts_end bigint, m bigint, e bigint, v_src bigint, v_dst bigint, v_total bigint"


def _stored(scan: Scan) -> tuple[int, int, int, int, bytes, bytes, bytes]:
    return scan.m, scan.first, scan.last, scan.idx, *(scan.seen[k].tobytes() for k in KINDS)


def _restored(state: tuple, t: Thresholds) -> Scan:
    scan = Scan(t)
    scan.m, scan.first, scan.last, scan.idx = state[:4]
    scan.seen = {k: np.frombuffer(bytes(v), np.int64) for k, v in zip(KINDS, state[4:], strict=True)}
    return scan


def stream_windows(events: DataFrame, thresholds: Thresholds, stream: str | None = None) -> DataFrame:
    """Closed windows of a streaming frame (event_id, ts, source_entity, destination_entity), in append mode.

    ``stream`` names a column whose values are independent streams; without it there is one.
    """
    s, d = F.col("source_entity"), F.col("destination_entity")
    key = F.col(stream).cast("string") if stream else F.lit("all")
    rows = events.select(key.alias("stream"), "event_id", F.col("ts").cast("bigint").alias("ts"), F.xxhash64(s).alias("v_src"), F.xxhash64(d).alias("v_dst"), F.xxhash64(s, d).alias("e"))

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scan = _restored(state.get, thresholds) if state.exists else Scan(thresholds)
        frame = pd.concat(list(frames), ignore_index=True).sort_values(["ts", "event_id"])
        size, closed = max(1, min(thresholds.m, PIECE)), []
        for k in range(0, len(frame), size):
            own = frame.iloc[k : k + size]
            row = scan.take(piece_of(own["ts"].to_numpy(), {c: own[c].to_numpy() for c in KINDS}))
            if row is not None:
                closed.append([group[0], *row[:8]])
        state.update(_stored(scan))
        yield pd.DataFrame(closed, columns=[c.split()[0] for c in STREAM_SCHEMA.split(", ")])

    kept = "m bigint, first bigint, last bigint, idx bigint, " + ", ".join(f"{k} binary" for k in KINDS)
    return rows.groupBy("stream").applyInPandasWithState(run, STREAM_SCHEMA, kept, "append", GroupStateTimeout.NoTimeout)
