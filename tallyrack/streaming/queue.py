"""The job queue as tables and streams."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import Step, in_batch, in_stream, rows_of

MESSAGE = "job_id string, url string, prompt string, template_id string, max_pages int, max_rows int, attempt int, max_attempts int, available_at double, force boolean"


def decode(raw: DataFrame, column: str = "value") -> DataFrame:
    """T3."""
    return raw.select(F.from_json(F.col(column).cast("string"), MESSAGE).alias("m"), *(c for c in raw.columns if c != column)).select("m.*", *(c for c in raw.columns if c != column))


def encode(messages: DataFrame) -> DataFrame:
    names = [x.split()[0] for x in MESSAGE.split(", ")]
    return messages.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value"))


def ready(messages: DataFrame, now: Column, sequence: str) -> DataFrame:
    """Messages whose time has come, by time, then in the order they came."""
    return messages.filter(F.col("available_at") <= now).orderBy("available_at", sequence)


def retry_delay(initial: int, most: int, attempt: Column) -> Column:
    """No delay where the first is none."""
    first = max(0, initial)
    return F.least(F.lit(max(first, most)).cast("long"), (F.lit(first) * F.pow(F.lit(2.0), F.least(F.greatest(attempt, F.lit(0)), F.lit(40)))).cast("long"))


def after_failure(failed: DataFrame, now: Column, initial: int, most: int, max_retries: int) -> tuple[DataFrame, DataFrame]:
    """Messages to try again, and dead letters (T5)."""
    left = F.col("attempt") < F.greatest(F.lit(0), F.least(F.lit(max_retries), F.col("max_attempts")))
    again = failed.filter(left).withColumn("available_at", now + retry_delay(initial, most, F.col("attempt"))).withColumn("attempt", F.col("attempt") + 1)
    return again, failed.filter(~left).withColumn("reason", F.lit("max_retries_exceeded")).withColumn("failed_at", now)


def dead_letters(letters: DataFrame, limit: int = 100) -> DataFrame:
    """T5: the newest first."""
    return letters.orderBy(F.desc("failed_at"), "job_id").limit(limit)


def leased(messages: DataFrame, ttl: str, key: str = "job_id", time: str = "ts") -> DataFrame:
    """T4: on a stream, a job's messages within the lease of its first one are dropped."""
    return messages.withWatermark(time, ttl).dropDuplicatesWithinWatermark([key])


def lease_batch(hits: DataFrame, ttl: float, key: str, time: str, order: str) -> DataFrame:
    """T4 on a table: a hit is let through when no lease is held; a lease that is let through lasts ttl."""
    from .limits import FixedWindow, decide

    return decide(hits, FixedWindow, 1, ttl, key, time, order).filter("allowed").select(key, time, order)


def process(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Each micro-batch of messages goes through the batch operators; a batch that is repeated after a loss has
    the same number, by which `handle` can write idempotently."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def messages_from(spark: SparkSession, path: str) -> DataFrame:
    return decode(spark.readStream.text(path))


#: What a job's queue is told: `deliver` a message (T3), or that a worker is `done` with it or has `failed`; and what it
#: says.  Times are in micros.
EVENT = ("kind", "attempt", "max_attempts", "available_at", "payload", "owner")
SAID = "event string, owner string, attempt int, delay_seconds long, payload string"


@dataclass(frozen=True)
class QueueRules:
    max_retries: int = 3
    backoff_initial: int = 2
    backoff_most: int = 30
    lease_seconds: int = 300

    def delay(self, attempt: int) -> int:
        """X44."""
        first = max(0, self.backoff_initial)
        return min(max(first, self.backoff_most), first * 2 ** min(max(0, attempt), 40))


def queue_step(rules: QueueRules) -> Step:
    """T1, T4, T5, T7 as a state machine of one job: messages that wait for their time, and the lease of the one that is
    being worked on.

    A message whose time has come is dispatched under a lease; while that is held another delivery of the job is skipped.
    A lease that its worker doesn't give back in time expires.  A failure gives the lease back and the message waits
    again, longer each time, or, out of attempts, is a dead letter."""

    def step(state: dict | None, at: int, row: dict) -> tuple[dict | None, list[dict], list[tuple[int, dict]]]:
        state = state or {"waiting": [], "lease": None, "n": 0}
        out: list[dict] = []
        later: list[tuple[int, dict]] = []
        lease = state["lease"]

        def say(event: str, message: dict, owner: str | None = None, delay: int | None = None) -> None:
            out.append({"event": event, "owner": owner, "attempt": message["attempt"], "delay_seconds": delay, "payload": message["payload"]})

        def wait(message: dict, when: int) -> None:
            state["n"] += 1
            state["waiting"].append([when, state["n"], message])
            later.append((when, {"kind": "wake"}))

        def dispatch(message: dict) -> None:
            if state["lease"] is not None:
                say("duplicate_skipped", message)
                return
            state["n"] += 1
            owner = f"{at}.{state["n"]}"
            state["lease"] = {"owner": owner, "message": message}
            say("dispatched", message, owner)
            later.append((at + max(1, rules.lease_seconds) * 1_000_000, {"kind": "expire", "owner": owner}))

        if row["kind"] == "deliver":
            message = {"attempt": row["attempt"] or 0, "max_attempts": 3 if row["max_attempts"] is None else row["max_attempts"], "payload": row["payload"]}
            if (row["available_at"] or 0) > at:
                wait(message, row["available_at"])
            else:
                dispatch(message)
        elif row["kind"] == "wake":
            due = sorted(w for w in state["waiting"] if w[0] <= at)
            state["waiting"] = [w for w in state["waiting"] if w[0] > at]
            for _, _, message in due:
                dispatch(message)
        elif lease is not None and row.get("owner") in (None, lease["owner"]):
            state["lease"], message = None, lease["message"]
            if row["kind"] == "expire":
                say("lease_expired", message, lease["owner"])
            elif row["kind"] == "done":
                say("completed", message, lease["owner"])
            elif message["attempt"] < max(0, min(rules.max_retries, message["max_attempts"])):
                delay = rules.delay(message["attempt"])
                again = message | {"attempt": message["attempt"] + 1}
                say("retry_scheduled", again, lease["owner"], delay)
                wait(again, at + delay * 1_000_000)
            else:
                say("failed", message, lease["owner"])
                say("dead_lettered", message, lease["owner"])
        over = not state["waiting"] and state["lease"] is None
        return (None if over else state), out, later

    return step


def _events(events: DataFrame) -> DataFrame:
    return rows_of(events, "job_id", "ts", "nth", list(EVENT))


def run_queue(events: DataFrame, rules: QueueRules = QueueRules()) -> DataFrame:
    """events (job_id, ts timestamp, nth, EVENT) -> (job_id, at, SAID): all that happens, in batch."""
    return in_batch(_events(events), queue_step(rules), SAID).withColumnRenamed("key", "job_id")


def run_queue_stream(events: DataFrame, rules: QueueRules = QueueRules(), delay: str = "10 seconds") -> DataFrame:
    """The same of a stream; what timers bring about comes when the watermark passes it."""
    return in_stream(_events(events), queue_step(rules), SAID, delay).withColumnRenamed("key", "job_id")


def usage_events(said: DataFrame) -> DataFrame:
    """What goes into the usage log: retries, failures and dead letters."""
    names = F.create_map(*(F.lit(x) for kv in {"retry_scheduled": "run.retry_scheduled", "failed": "run.failed", "dead_lettered": "run.dead_lettered"}.items() for x in kv))
    told = said.withColumn("event_type", F.try_element_at(names, F.col("event"))).filter("event_type IS NOT NULL")
    attempt = F.when(F.col("event") == "failed", F.to_json(F.struct("job_id", F.lit("failed").alias("status"), F.col("attempt").alias("final_attempt")))).when(F.col("event") == "retry_scheduled", F.to_json(F.struct("job_id", "attempt", "delay_seconds"))).otherwise(F.to_json(F.struct("job_id", "attempt")))
    return told.select("job_id", "at", "event_type", attempt.alias("event_json"))
