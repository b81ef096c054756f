"""Sliding-window admission: at most so many accepted requests a tenant in the trailing minute; refused ones don't count."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def admit(times: list[float], accepted_before: list[float], limit: int, seconds: int) -> tuple[list[bool], list[float]]:
    """Whether each of the rising times is accepted, and the accepted times that still count behind the last."""
    window, out = list(accepted_before), []
    for t in times:
        window = [x for x in window if x > t - seconds]
        out.append(len(window) < limit)
        if out[-1]:
            window.append(t)
    return out, window


def admission(requests: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """A stream of requests (tenant_id, request_id, at) with accepted. State for each tenant: the accepted times of the window, at most `limit`."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values(["at", "request_id"])
        before = list(state.get[0]) if state.exists else []
        pdf["accepted"], window = admit([t.timestamp() for t in pdf["at"]], before, limit, seconds)
        state.update((window,))
        yield pdf[["tenant_id", "request_id", "at", "accepted"]]

    return requests.select("tenant_id", "request_id", "at").groupBy("tenant_id").applyInPandasWithState(step, "tenant_id long, request_id long, at timestamp, accepted boolean", "times array<double>", "append", GroupStateTimeout.NoTimeout)
