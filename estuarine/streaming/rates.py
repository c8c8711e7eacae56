"""Rate audit over a stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from estuarine.operators.rates import MICROS, FixedWindow, SlidingLog


def rate_audit_stream(
    events: DataFrame,
    key: str,
    ts: str,
    order: str,
    limit: int,
    window_seconds: int,
    kind: str = "fixed",
    delay: str = "10 minutes",
) -> DataFrame:
    """Streaming form of the rate audit with one small state per key.

    Events of a micro-batch are taken in time order. Idle keys are forgotten once the
    watermark has passed their window.
    """
    window = window_seconds * MICROS
    rows = events.withWatermark(ts, delay).select(
        key, order, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("at")
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    fixed = kind == "fixed"
    state_schema = "anchor long, count int" if fixed else "accepted array<bigint>"

    def audit(name, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["at", order])
        if fixed:
            limiter = FixedWindow(limit, window, state.get if state.exists else (None, 0))
        else:
            limiter = SlidingLog(limit, window, state.get[0] if state.exists else None)
        verdicts = [limiter.step(int(at)) for at in pdf["at"]]
        state.update((limiter.anchor, limiter.count) if fixed else (limiter.accepted,))
        forget = (int(pdf["at"].iloc[-1]) + window) // 1000
        state.setTimeoutTimestamp(max(forget, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(
            {
                key: name[0],
                order: pdf[order].to_numpy(),
                "allowed": [ok for ok, _ in verdicts],
                "retry_after": [wait / MICROS for _, wait in verdicts],
            }
        )

    return rows.groupBy(key).applyInPandasWithState(
        audit,
        f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, allowed boolean, retry_after double",
        state_schema,
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
