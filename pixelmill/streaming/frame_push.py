"""Frames pushed to streams one by one: what a coder decides about each, with all it has to remember held as state.

A stream's state is its order, the frames since its last key, the last frame's samples, the lookahead of mean
differences and the ring of frames kept for reference. It is one value, replaced only after a frame has been accepted:
a refused one leaves no trace, as does a task that fails (the store goes back to the version of the last micro-batch).

Defined results: refused frames are rows with an error and null in all else: "no samples" (null, empty, or a null
among them), "other size" (than the stream's first accepted frame), "late" (its number isn't above the last accepted
one's; so of frames that repeat a number inside a micro-batch, the one with the smallest samples is taken). Frames without
a number, or a stream, are "no number". Numbers may have gaps. An empty table gives no rows.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "stream long, frame long, error string, place long, key boolean, sad long, mean double, slot int, refs array<long>"
STATE = "place long, since long, last long, samples array<int>, lookahead array<long>, ring array<long>, at long"
State = namedtuple("State", "place since last samples lookahead ring at")


class FramePush(StatefulProcessor):
    """Decides frames in order; interval, threshold and min_gap as in operators.frames.key_frames, but by place in the stream."""

    def __init__(self, interval: int, threshold: int, min_gap: int, cap: int, ring: int) -> None:
        self.interval, self.threshold, self.min_gap, self.cap, self.kept = max(1, interval), threshold, min_gap, cap, ring

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stream", STATE)

    def close(self) -> None:
        """Nothing is open."""

    def pushed(self, was: State | None, frame: int, samples: np.ndarray) -> tuple[State, dict[str, Any]]:
        """The state after an accepted frame, and the frame's row."""
        before = np.array(was.samples) if was else samples
        sad = int(np.abs(samples.astype(np.int64) - before).sum()) // len(samples)
        place = was.place if was else 0
        cut = 0 < self.threshold <= sad and was is not None and was.since >= self.min_gap
        key = place % self.interval == 0 or cut
        at = 0 if key else was.at + 1
        lookahead = list(was.lookahead) if was else []
        ring = [] if key else list(was.ring)
        row = {"error": None, "place": place, "key": key, "sad": sad, "mean": sum(lookahead) / len(lookahead) if lookahead else 0.0, "slot": at % self.kept, "refs": ring}
        after = State(place + 1, 0 if key else was.since + 1, frame, samples.tolist(), [*lookahead, sad][-self.cap :], [frame, *ring][: self.kept], at)
        return after, row

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = self.state.get() if self.state.exists() else None
        now = State(*found) if found else None
        batch = [(frame, samples) for b in rows for frame, samples in zip(b["frame"], b["samples"], strict=True)]
        missing = [f for f, _ in batch if pd.isna(f)]
        some = [(int(f), None if s is None or not len(s) or pd.isna(np.asarray(s, object)).any() else np.asarray(s, np.int64)) for f, s in batch if not pd.isna(f)]
        out = [{"frame": None, "error": "no number"} for _ in missing]
        for frame, samples in sorted(some, key=lambda x: (x[0], x[1] is None, [] if x[1] is None else x[1].tolist())):
            error = "no number" if key[0] is None or pd.isna(key[0]) else "no samples" if samples is None else "late" if now and frame <= now.last else "other size" if now and len(samples) != len(now.samples) else None
            if error:
                out.append({"frame": frame, "error": error})
                continue
            now, row = self.pushed(now, frame, samples)
            out.append({"frame": frame, **row})
        if now:
            self.state.update(tuple(now))
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        table = pd.DataFrame({c: pd.Series([r.get(c) for r in out], dtype=object) for c in columns[1:]})  # as objects, so that what is missing stays None
        table.insert(0, columns[0], None if key[0] is None else key[0])
        kinds = {"stream": "Int64", "frame": "Int64", "place": "Int64", "key": "boolean", "sad": "Int64", "mean": "float64", "slot": "Int32"}
        yield table.astype(kinds)


def stored(spark: SparkSession) -> None:
    """Has the session keep state in RocksDB, which values of this kind need, and makes sure that batch jobs find its coordinator."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    spark.streams  # noqa: B018


def push(frames: DataFrame, interval: int, threshold: int, min_gap: int, cap: int = 8, ring: int = 3) -> DataFrame:
    """A row for each of (stream, frame, samples), a batch or a stream: order, key, mean difference, lookahead mean, slot and references.

    mean is over the up to `cap` accepted frames before; refs are the frames in the ring, the latest first; a key empties
    the ring and takes slot 0. Frames have to arrive in order over micro-batches; inside one they are put in order, by a
    task for each stream, which holds what a micro-batch brings of it.
    """
    stored(frames.sparkSession)
    rows = frames.select(F.col("stream").cast("long").alias("stream"), F.col("frame").cast("long").alias("frame"), F.col("samples").cast("array<int>").alias("samples"))
    return rows.groupBy("stream").transformWithStateInPandas(FramePush(interval, threshold, min_gap, cap, ring), SCHEMA, "Append", "None")
