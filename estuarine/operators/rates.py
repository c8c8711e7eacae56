"""Rate audit: which events of a key a limiter would have let through."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000


class FixedWindow:
    """A window opens at the first event after the last one ran out; its first `limit` events pass."""

    def __init__(self, limit: int, window: int, state: tuple = (None, 0)):
        self.limit, self.window = limit, window
        self.anchor, self.count = state

    def step(self, at: int) -> tuple[bool, int]:
        if self.anchor is None or at >= self.anchor + self.window:
            self.anchor, self.count = at, 0
        if self.count < self.limit:
            self.count += 1
            return True, 0
        return False, self.anchor + self.window - at


class SlidingLog:
    """An event passes while fewer than `limit` accepted ones lie in the window before it."""

    def __init__(self, limit: int, window: int, state: list | None = None):
        self.limit, self.window = limit, window
        self.accepted = list(state or [])

    def step(self, at: int) -> tuple[bool, int]:
        self.accepted = [t for t in self.accepted if t > at - self.window]
        if len(self.accepted) < self.limit:
            self.accepted.append(at)
            return True, 0
        return False, self.accepted[0] + self.window - at


LIMITERS = {"fixed": FixedWindow, "sliding": SlidingLog}


def independent_spans(events: DataFrame, key: str, window: int) -> DataFrame:
    """Add `span`: stretches of a key separated by more than one silent window.

    No limiter remembers anything over such a pause, so spans run in parallel. They are
    found on occupied window-long slots, whose number depends on time, not on events.
    """
    slotted = events.withColumn("__slot", F.floor(F.col("__at") / window))
    slots = slotted.select(key, "__slot").distinct()
    w = Window.partitionBy(key).orderBy("__slot")
    fresh = F.coalesce(F.col("__slot") - F.lag("__slot").over(w) > 1, F.lit(True))
    marked = slots.withColumn("__new", fresh.cast("long"))
    spans = marked.select(key, "__slot", F.sum("__new").over(w).alias("span"))
    return slotted.join(spans, [key, "__slot"]).drop("__slot")


def rate_audit(
    events: DataFrame, key: str, ts: str, order: str, limit: int, window_seconds: int, kind: str = "fixed"
) -> DataFrame:
    """(key, order, allowed, retry_after) for every event.

    Events of a span arrive sorted and stream through one task in batches; only the
    limiter's state is held, however long the span.
    """
    window = window_seconds * MICROS
    limiter = LIMITERS[kind]
    rows = events.select(key, order, F.unix_micros(F.col(ts).cast("timestamp")).alias("__at"))
    spread = independent_spans(rows, key, window).repartition(key, "span")
    ordered = spread.sortWithinPartitions(key, "span", "__at", order)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def audit(batches):
        current, state = None, None
        for pdf in batches:
            allowed, retry = [], []
            for name, span, at in zip(pdf[key], pdf["span"], pdf["__at"]):
                if (name, span) != current:
                    current, state = (name, span), limiter(limit, window)
                ok, wait = state.step(at)
                allowed.append(ok)
                retry.append(wait / MICROS)
            yield pd.DataFrame({key: pdf[key], order: pdf[order], "allowed": allowed, "retry_after": retry})

    return ordered.mapInPandas(audit, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, allowed boolean, retry_after double")
