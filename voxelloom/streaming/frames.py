"""Image work on streams of frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """What `work` makes of each batch, added to a parquet table by batch: a batch that runs again takes the place of its
    first run. Slices must come whole in one batch (files of whole slices do), as all per-slice operators need."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def temporal_mean_stream(stream: DataFrame, key: list[str], window: int = 5, *, exclude_center: bool = True) -> DataFrame:
    """(key, t, v): the temporal mean of each pixel's frame, once the frames after it that it needs have come.

    Frames of a pixel come in order of t, batch by batch. The first frame stands in for those before it. The last frames
    of a stack, which wait for more, are left to the batch operator. The state of a pixel is at most `window` values.
    """
    before, after = window // 2, window - 1 - window // 2
    schema = T.StructType([*(stream.schema[c] for c in key), T.StructField("t", T.IntegerType()), T.StructField("v", T.DoubleType())])

    def update(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, values, ready = _state(state)
        new = pd.concat(list(parts)).sort_values("t")
        times += new["t"].tolist()
        values += new["v"].astype(float).tolist()
        out = []
        # `ready` is the position of the next frame to come out.
        while ready + after < len(values):
            around = [values[max(0, ready + d)] for d in range(-before, after + 1)]
            total = sum(around)
            out.append((times[ready], (total - values[ready]) / (window - 1) if exclude_center else total / window))
            ready += 1
        drop = max(0, ready - before)
        state.update((times[drop:], values[drop:], ready - drop))
        yield pd.DataFrame({**{c: [v] * len(out) for c, v in zip(key, name)}, "t": [t for t, _ in out], "v": [v for _, v in out]})

    return stream.groupBy(*key).applyInPandasWithState(update, schema, "times array<int>, values array<double>, ready int", "append", GroupStateTimeout.NoTimeout)


def _state(state: GroupState) -> tuple[list, list, int]:
    if not state.exists:
        return [], [], 0
    times, values, ready = state.get
    return list(times), list(values), ready
