"""Causal chaining of a stream of steps: each recording's position so far is its state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout


def chain_stream(steps: DataFrame) -> DataFrame:
    """(recording_id long, frame int, dx, dy) to positions (recording_id, frame, x, y), as frames arrive in order."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        x, y = state.get if state.exists else (0.0, 0.0)
        for pdf in batches:
            pdf = pdf.sort_values("frame")
            px, py = x + pdf["dx"].fillna(0).cumsum(), y + pdf["dy"].fillna(0).cumsum()
            x, y = float(px.iloc[-1]), float(py.iloc[-1])
            yield pd.DataFrame({"recording_id": key[0], "frame": pdf["frame"], "x": px, "y": py})
        state.update((x, y))

    return steps.groupBy("recording_id").applyInPandasWithState(run, "recording_id long, frame int, x double, y double", "x double, y double", "append", GroupStateTimeout.NoTimeout)
