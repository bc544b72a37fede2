"""The filter of consecutive duplicates over a stream of segments, with the last text and its repetitions as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "last string, times int"


def kept_stream(segments: DataFrame, keys: list[str], order: str = "pos", text: str = "text") -> DataFrame:
    """The segments of a stream (keys strings or numbers, ``order``, ``text``) that the filter keeps.

    Rows of one recording must arrive in order across micro-batches; within one they are sorted. The state is one text and a
    number for each recording.
    """
    rows = segments.select(*keys, order, text)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, times = state.get if state.exists else ("", 0)
        b = pd.concat(list(batches)).sort_values(order, kind="stable")
        keep = []
        for t in b[text].fillna("").str.strip():
            bare = t.replace(" ", "").replace("　", "")
            if t and last and (t == last or (len(bare) > 10 and len(set(bare)) <= 2)):
                times += 1
            else:
                times, last = 0, t
            keep.append(times < 2)
        state.update((last, times))
        yield b[keep]

    return rows.groupBy(*keys).applyInPandasWithState(step, rows.schema, STATE, "append", GroupStateTimeout.NoTimeout)
