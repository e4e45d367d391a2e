"""Key frame decisions on a stream of frame statistics: the streaming form of operators.frames.key_frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def key_frames(stats: DataFrame, interval: int, threshold: int, min_gap: int) -> DataFrame:
    """(stream, frame, key) of a streaming (stream, frame, sad).

    A stream's frames have to arrive in order over the micro-batches; inside one they are put in order. The state of a
    stream is one number: the frames since the last key.
    """
    span = max(1, interval)

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("frame")
        keys = []
        for frame, sad in zip(rows["frame"], rows["sad"], strict=True):
            is_key = frame % span == 0 or (0 < threshold <= sad and since >= min_gap)
            since = 0 if is_key else since + 1
            keys.append(is_key)
        state.update((since,))
        yield pd.DataFrame({"stream": key[0], "frame": rows["frame"], "key": keys})

    return stats.groupBy("stream").applyInPandasWithState(decide, "stream long, frame long, key boolean", "since long", "append", GroupStateTimeout.NoTimeout)
