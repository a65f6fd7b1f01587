"""Rate limits that depend on their own decisions (T8, T9, T10), in batch and in streams.

Both limiters fold a key's hits in time order.  In batch a key's hits are sorted by the exchange and read as a stream
of batches, so a hot key never has to fit into one frame: a log holds at most `limit` times, a window two numbers.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from math import floor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Step, in_batch, in_stream, rows_of


class SlidingLog:
    """Allowed hits of the last `window` seconds; blocked ones are not kept."""

    def __init__(self, limit: int, window: float, state: list[float] | None = None) -> None:
        self.limit, self.window, self.log = max(1, int(limit)), max(1, int(window)), deque(state or [])

    def hit(self, now: float) -> tuple[bool, int, int]:
        """Allowed, hits left, and the seconds to wait: a whole window after an allowed hit, else until the oldest goes."""
        while self.log and self.log[0] <= now - self.window:
            self.log.popleft()
        if len(self.log) >= self.limit:
            return False, 0, max(1, round(self.log[0] + self.window - now))
        self.log.append(now)
        return True, self.limit - len(self.log), self.window

    def state(self) -> list[float]:
        return list(self.log)


class FixedWindow:
    """A window that the first hit opens; blocked hits count too.  What is left of it is known in whole seconds,
    rounded: a hit that finds none left opens another window but goes on with the count."""

    def __init__(self, limit: int, window: float, state: list[float] | None = None) -> None:
        self.limit, self.window = max(1, int(limit)), max(1, int(window))
        self.start, self.count = state or [float("-inf"), 0]

    def hit(self, now: float) -> tuple[bool, int, int]:
        if now >= self.start + self.window:
            self.start, self.count = now, 0
        self.count += 1
        left = floor(self.start + self.window - now + 0.5)
        if left <= 0:
            self.start, left = now, self.window
        return self.count <= self.limit, max(0, self.limit - int(self.count)), left

    def state(self) -> list[float]:
        return [self.start, self.count]


def scope(workspace: Column, method: Column, path: Column) -> Column:
    """The key that is limited."""
    return F.concat_ws(":", workspace, F.upper(method), path)


def decide(hits: DataFrame, kind: type, limit: int, window: float, key: str = "key", time: str = "ts", order: str = "id") -> DataFrame:
    """hits (key, ts as seconds, id) -> the same with allowed, remaining, reset_seconds."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, limiter = object(), None
        for frame in frames:
            out = []
            for k, now in zip(frame[key], frame[time], strict=True):
                if limiter is None or k != last:
                    last, limiter = k, kind(limit, window)
                out.append(limiter.hit(now))
            yield frame.assign(allowed=[o[0] for o in out], remaining=[o[1] for o in out], reset_seconds=[o[2] for o in out])

    rows = hits.select(F.col(key).cast("string").alias(key), F.col(time).cast("double").alias(time), F.col(order).cast("long").alias(order))
    sorted_rows = rows.repartition(key).sortWithinPartitions(key, time, order)
    return sorted_rows.mapInPandas(run, f"{key} string, {time} double, {order} long, allowed boolean, remaining long, reset_seconds long")


def _limiter(kind: type, limit: int, window: float) -> Step:
    def step(state: list | None, at: int, row: dict) -> tuple[list | None, list[dict], list]:
        if row.get("forget"):  # nothing that the state holds counts any longer
            return (None if state is None or at >= state[1] + int(2 * window * 1e6) else state), [], []
        limiter = kind(limit, window, list(state[0]) if state else None)
        allowed, remaining, reset = limiter.hit(at / 1e6)
        made = {"id": row["id"], "allowed": allowed, "remaining": remaining, "reset_seconds": reset}
        return [limiter.state(), at], [made], [(at + int(2 * window * 1e6), {"forget": True})]

    return step


_DECISION = "id long, allowed boolean, remaining long, reset_seconds long"


def decide_in_order(hits: DataFrame, kind: type, limit: int, window: float) -> DataFrame:
    """hits (key, ts timestamp, id) -> (key, at micros, id, allowed, remaining, reset_seconds): decide(), by the fold that
    streams use too.  A hit without a key or a time isn't decided."""
    return in_batch(rows_of(hits, "key", "ts", "id", ["id"]), _limiter(kind, limit, window), _DECISION)


def decide_stream(hits: DataFrame, kind: type, limit: int, window: float, delay: str = "10 seconds") -> DataFrame:
    """decide_in_order() of a stream.  Hits wait until the watermark, `delay` behind the latest hit, has passed them, and
    are decided in the order of their times whatever order they came in; two windows after a key's last hit, by the
    watermark, its state goes."""
    return in_stream(rows_of(hits, "key", "ts", "id", ["id"]), _limiter(kind, limit, window), _DECISION, delay)
