"""Folds over each key's rows in time order, in batch and in streams, with the same step.

A stream's rows come late and shuffled.  They wait in a key's state until the watermark has passed them and are then
folded in order, so a replay in any order (within the watermark) decides as the batch does.  Whatever a step asks to be
woken for waits among them: in a stream an event-time timer fires it, in batch it is merged into the key's sorted rows.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: A row of a fold, in micros and in order; woken rows (rank 0) come before those of the table or stream (rank 1).
ROW = "at long, rank int, nth long, body string"

#: Rows that a task of a batch puts out at a time.
OUT = 1 << 13

#: (state, micros, row) -> (new state, rows to put out, (micros, row) to be woken with).  State and rows are plain JSON.
Step = Callable[[Any, int, dict], tuple[Any, list[dict], list[tuple[int, dict]]]]


def rows_of(df: DataFrame, key: str, time: str, order: str, columns: list[str]) -> DataFrame:
    """(key, time timestamp, order, columns) -> key, its time, and ROW."""
    body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return df.select(F.col(key).cast("string").alias("key"), F.col(time).alias("time"), F.unix_micros(time).alias("at"), F.lit(1).alias("rank"), F.col(order).cast("long").alias("nth"), body.alias("body"))


def _fold(step: Step, state: Any, heap: list[tuple], until: float) -> tuple[Any, list[dict], int]:
    """Folds what is due; woken rows are pushed and folded too if they are due."""
    out, nth = [], 0
    while heap and heap[0][0] <= until:
        at, _, _, body = heapq.heappop(heap)
        state, made, later = step(state, at, json.loads(body))
        out += [m | {"at": at} for m in made]
        for when, row in later:
            nth += 1
            heapq.heappush(heap, (max(when, at), 0, at * 8 + nth % 8, json.dumps(row)))
    return state, out, nth


class _Woken(dict):
    """A woken row as batches hold it: not as text, and put in order by its text only where two are due at once."""

    def __lt__(self, other: dict) -> bool:
        return json.dumps(self) < json.dumps(other)


def _frame(key: str, out: list[dict], schema: StructType) -> pd.DataFrame:
    return pd.DataFrame([{"key": key} | o for o in out], columns=[f.name for f in schema.fields])


def in_batch(rows: DataFrame, step: Step, out: str) -> DataFrame:
    """rows_of() of a table -> (key, at, out columns).  The exchange sorts a key's rows and a task reads them as a stream of
    batches, so a hot key never has to fit into one; only its state and its woken rows are held.  The number of
    partitions is the session's, given by name: the fold takes long for few bytes, so that partitions put together by
    their bytes would leave cores idle."""
    schema = StructType.fromDDL(f"key string, at long, {out}")
    kinds, names = to_arrow_schema(schema), [f.name for f in schema.fields[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, heap = None, None, []
        keys: list[str] = []
        times: list[int] = []
        made: list[dict] = []

        def batch() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(keys, kinds.types[0]), pa.array(times, kinds.types[1]), *(pa.array([m.get(n) for m in made], k) for n, k in zip(names, kinds.types[2:], strict=True))], schema=kinds)
            keys.clear()
            times.clear()
            made.clear()
            return found

        def fold(until: float, row: dict | None) -> None:
            """What is woken by then, the row, and what that wakes at once; _fold() of the heap with the row in it."""
            nonlocal state
            nth = 0
            while row is not None or (heap and heap[0][0] <= until):
                if heap and heap[0][0] <= until:
                    at, _, _, body = heapq.heappop(heap)
                else:
                    at, body, row = until, row, None
                state, new, later = step(state, at, body)
                for m in new:
                    keys.append(last)
                    times.append(at)
                    made.append(m)
                for when, woken in later:
                    nth += 1
                    heapq.heappush(heap, (max(when, at), 0, at * 8 + nth % 8, _Woken(woken)))

        for part in batches:
            # All earlier rows are there; those of the same time come before a row only by rank.
            bodies = json.loads(f"[{','.join(part.column('body').to_pylist())}]")
            for key, at, body in zip(part.column("key").to_pylist(), part.column("at").to_pylist(), bodies, strict=True):
                if key != last:
                    if heap:
                        fold(float("inf"), None)
                    last, state, heap = key, None, []
                fold(at, body)
                if len(made) >= OUT:
                    yield batch()
        fold(float("inf"), None)
        yield batch()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.drop("time").filter("key IS NOT NULL AND at IS NOT NULL").repartition(parts, "key").sortWithinPartitions("key", "at", "rank", "nth")
    return dealt.select("key", "at", "body").mapInArrow(run, schema)


class _InOrder(StatefulProcessor):
    """A key's waiting rows, its state, and a timer for the first of them."""

    def __init__(self, step: Step, schema: StructType) -> None:
        self.step, self.schema = step, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ROW)
        self.state = handle.getValueState("state", "body string")

    def _alarm(self, at: int) -> None:
        self.handle.registerTimer(at // 1000 + 1)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [(int(r.at), int(r.rank), int(r.nth), r.body) for frame in rows for r in frame.itertuples(index=False)]
        if new:
            self.waiting.appendList(new)
            self._alarm(min(n[0] for n in new))
        yield _frame(key[0], [], self.schema)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        heap = [tuple(r) for r in self.waiting.get()]
        heapq.heapify(heap)
        state = json.loads(self.state.get()[0]) if self.state.exists() else None
        state, out, _ = _fold(self.step, state, heap, timerValues.getCurrentWatermarkInMs() * 1000)
        self.state.update((json.dumps(state),))
        if heap:
            self.waiting.put(heap)
            self._alarm(heap[0][0])
        else:
            self.waiting.clear()
        if state is None and not heap:
            self.state.clear()
        yield _frame(key[0], out, self.schema)

    def close(self) -> None:
        pass


def in_stream(rows: DataFrame, step: Step, out: str, delay: str) -> DataFrame:
    """The same of a stream: rows that come up to `delay` behind the latest are folded in order, later ones dropped.  The
    session's state store has to be the one that has timers (spark.sql.streaming.stateStore.providerClass)."""
    schema = StructType.fromDDL(f"key string, at long, {out}")
    held = rows.filter("key IS NOT NULL AND at IS NOT NULL").withWatermark("time", delay)
    return held.groupBy("key").transformWithStateInPandas(_InOrder(step, schema), schema, "Append", "EventTime")


#: The provider of state with timers.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
