"""Ordered folds: batch against plain loops, shuffled streams with losses against batch."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyrack.streaming import limits as T
from tallyrack.streaming import queue as Q
from tallyrack.streaming.ordered import ROCKS

START = datetime(2024, 1, 1, tzinfo=UTC)
FLUSH = timedelta(days=3)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def replay(spark, tmp_path, parts, schema, build):
    """The parts one after another as files of a stream that is stopped after each and started again from its checkpoint."""
    folder = tmp_path / "in"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = build(spark.readStream.schema(schema).parquet(str(folder)))
        run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert run.awaitTermination(180)
        assert run.exception() is None
    return spark.read.parquet(str(tmp_path / "out"))


def hits(n, keys, seed):
    r = random.Random(seed)
    return [(f"k{r.randrange(keys)}", START + timedelta(milliseconds=r.randrange(n * 400)), i) for i in range(n)]


HIT = "key string, ts timestamp, id long"


@pytest.mark.parametrize("kind", [T.SlidingLog, T.FixedWindow])
def test_limits_in_order_are_decides(spark, kind):
    rows = [*hits(200, 5, 1), (None, START, 900), ("k", None, 901)]
    frame = spark.createDataFrame(rows, HIT).repartition(3)
    seconds = frame.filter("key IS NOT NULL AND ts IS NOT NULL").withColumn("ts", F.unix_micros("ts") / 1e6)
    pick = lambda df: sorted(tuple(r) for r in df.select("id", "allowed", "remaining", "reset_seconds").collect())
    assert pick(T.decide_in_order(frame, kind, 3, 20)) == pick(T.decide(seconds, kind, 3, 20))
    assert T.decide_in_order(frame.filter("false"), kind, 3, 20).collect() == []


def test_shuffled_replay_of_limits(rocks, tmp_path):
    """Hits in any order within the watermark, in three runs, are decided as in batch."""
    spark = rocks
    rows = sorted(hits(120, 3, 2), key=lambda h: h[1])
    r = random.Random(3)
    shuffled = [h for i in range(0, len(rows), 30) for h in r.sample(rows[i : i + 30], len(rows[i : i + 30]))]
    last = [("flush", START + FLUSH, 999)]
    got = replay(spark, tmp_path, [shuffled[:30], shuffled[30:75], shuffled[75:], last], HIT, lambda s: T.decide_stream(s, T.SlidingLog, 3, 10, "1 minute"))
    want = T.decide_in_order(spark.createDataFrame(rows, HIT), T.SlidingLog, 3, 10)
    pick = lambda df: sorted(tuple(x) for x in df.filter("key <> 'flush'").select("key", "at", "id", "allowed", "remaining", "reset_seconds").collect())
    assert pick(got) == pick(want) and len(pick(got)) == 120


EVENT = "job_id string, ts timestamp, nth long, kind string, attempt int, max_attempts int, available_at long, payload string, owner string"


def event(job, seconds, nth, kind, attempt=0, most=3, wait=None, owner=None):
    at = START + timedelta(seconds=seconds)
    micros = None if wait is None else int((at + timedelta(seconds=wait)).timestamp() * 1_000_000)
    return job, at, nth, kind, attempt, most, micros, f"{job}!", owner


def told(df):
    zero = int(START.timestamp())
    return sorted((r.job_id, r.at / 1e6 - zero, r.event, r.attempt, r.delay_seconds) for r in df.filter("job_id <> 'flush'").collect())


EVENTS = [
    event("ok", 0, 1, "deliver"), event("ok", 3, 2, "deliver"), event("ok", 5, 3, "done"), event("ok", 6, 4, "deliver"), event("ok", 7, 5, "done", owner="nobody"),
    event("bad", 1, 6, "deliver", most=2), event("bad", 2, 7, "failed"), event("bad", 10, 8, "failed"), event("bad", 20, 9, "failed"), event("bad", 21, 10, "failed"),
    event("later", 0, 11, "deliver", wait=30), event("later", 31, 12, "done"), event("lost", 0, 13, "deliver"), event("lost", 350, 14, "done"), event("lost", 300, 15, "deliver"),
    event("none", 0, 16, "deliver", most=0), event("none", 1, 17, "failed"),
]
# worked out by hand: retries after 2 and 4 seconds, leases of 300
SAID = [
    ("bad", 1.0, "dispatched", 0, None), ("bad", 2.0, "retry_scheduled", 1, 2), ("bad", 4.0, "dispatched", 1, None), ("bad", 10.0, "retry_scheduled", 2, 4), ("bad", 14.0, "dispatched", 2, None), ("bad", 20.0, "dead_lettered", 2, None), ("bad", 20.0, "failed", 2, None),
    ("later", 30.0, "dispatched", 0, None), ("later", 31.0, "completed", 0, None), ("lost", 0.0, "dispatched", 0, None), ("lost", 300.0, "dispatched", 0, None), ("lost", 300.0, "lease_expired", 0, None), ("lost", 350.0, "completed", 0, None),
    ("none", 0.0, "dispatched", 0, None), ("none", 1.0, "dead_lettered", 0, None), ("none", 1.0, "failed", 0, None),
    ("ok", 0.0, "dispatched", 0, None), ("ok", 3.0, "duplicate_skipped", 0, None), ("ok", 5.0, "completed", 0, None), ("ok", 6.0, "dispatched", 0, None), ("ok", 306.0, "lease_expired", 0, None),
]


def test_queue(spark):
    said = Q.run_queue(spark.createDataFrame(EVENTS, EVENT).repartition(4))
    assert told(said) == SAID
    log = sorted((r.job_id, r.event_type, r.event_json) for r in Q.usage_events(said).collect())
    assert log == [("bad", "run.dead_lettered", '{"job_id":"bad","attempt":2}'), ("bad", "run.failed", '{"job_id":"bad","status":"failed","final_attempt":2}'), ("bad", "run.retry_scheduled", '{"job_id":"bad","attempt":1,"delay_seconds":2}'), ("bad", "run.retry_scheduled", '{"job_id":"bad","attempt":2,"delay_seconds":4}'), ("none", "run.dead_lettered", '{"job_id":"none","attempt":0}'), ("none", "run.failed", '{"job_id":"none","status":"failed","final_attempt":0}')]


def test_a_batch_sends_python_no_more_than_it_folds(spark):
    """Keys, times and bodies, in order already; woken rows that are due at once come as they were asked for."""
    said = Q.run_queue(spark.createDataFrame(EVENTS, EVENT).repartition(4))
    before = said._jdf.queryExecution().analyzed().toString().split("MapInArrow")[1]
    assert before.split("Project [")[1].split("]")[0].count(",") == 2
    told_at_once = lambda state, at, row: (None, [{"event": row["kind"], "payload": row.get("payload")}], [(at, {"kind": k}) for k in "ba"] if "payload" in row else [])
    from tallyrack.streaming.ordered import in_batch

    got = in_batch(Q._events(spark.createDataFrame([event("x", 0, n, "deliver") for n in (2, 1)], EVENT)), told_at_once, Q.SAID)
    assert [r.event for r in got.collect()] == ["deliver", "b", "a", "deliver", "b", "a"]


def test_queue_as_a_stream_that_is_stopped(rocks, tmp_path):
    """Shuffled within the watermark and stopped between batches, with timers pending, a stream says what the batch says."""
    early = [e for e in EVENTS if e[1] < START + timedelta(seconds=15)]
    rest = [e for e in EVENTS if e not in early]
    random.Random(5).shuffle(early)
    random.Random(6).shuffle(rest)
    flush = [event("flush", FLUSH.total_seconds(), 99, "deliver")]
    got = replay(rocks, tmp_path, [early, rest, flush], EVENT, lambda s: Q.run_queue_stream(s, delay="10 minutes"))
    assert told(got) == SAID


def test_delays():
    rules = Q.QueueRules()
    assert [rules.delay(a) for a in (-1, 0, 1, 3, 4, 99)] == [2, 2, 4, 16, 30, 30] and Q.QueueRules(backoff_initial=0).delay(5) == 0 and Q.QueueRules(backoff_initial=60).delay(3) == 60


def test_random_queues(rocks, tmp_path):
    r = random.Random(8)
    rows = [event(f"j{r.randrange(12)}", r.randrange(0, 3600), i, r.choice(["deliver", "deliver", "failed", "failed", "done"]), r.randrange(3), r.randrange(5), r.choice([None, 0, 5, 400])) for i in range(250)]
    flush = [event("flush", FLUSH.total_seconds(), 999, "deliver")]
    r.shuffle(rows)
    got = replay(rocks, tmp_path, [rows[:100], rows[100:], flush], EVENT, lambda s: Q.run_queue_stream(s, delay="2 hours"))
    assert told(got) == told(Q.run_queue(rocks.createDataFrame(rows, EVENT)))


JOB = "job_id long, nth long, status string"
LINE = "job_id long, row_index int, title string"


def test_upserts_survive_repeated_and_broken_batches(spark, tmp_path):
    from tallyrack.streaming.ledger import JobStore

    store = JobStore(spark, str(tmp_path / "s"))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    state = lambda: (sorted(map(tuple, store.jobs().collect())), sorted(map(tuple, store.rows().collect())))
    first = frame([(1, 0, "queued"), (1, 1, "success"), (2, 0, "failed")], JOB), frame([(1, 0, "a"), (1, 1, "b"), (2, 0, "z")], LINE)
    for _ in range(2):
        store.upsert(*first, 0)
        assert state() == ([(1, 1, "success"), (2, 0, "failed")], [(1, 0, "a"), (1, 1, "b"), (2, 0, "z")])
    second = frame([(2, 5, "success"), (3, 5, "success")], JOB), frame([(2, 0, "new")], LINE)
    second[0].write.parquet(str(tmp_path / "s/jobs/batch=1"))  # a batch that was cut short
    assert [r[2] for r in state()[0]] == ["success", "failed"]
    store.upsert(*second, 1)
    want = [(1, 1, "success"), (2, 5, "success"), (3, 5, "success")], [(1, 0, "a"), (1, 1, "b"), (2, 0, "new")]
    assert state() == want
    store.compact()
    assert state() == want
    store.upsert(*second, 1)  # repeated after compaction
    assert state() == want
    store.upsert(frame([(1, 9, "success")], JOB), frame([], LINE), 2)
    want = [(1, 9, "success"), *want[0][1:]], [(2, 0, "new")]
    assert state() == want
    store.compact()
    assert state() == want
    with pytest.raises(ValueError):
        store.upsert(*first, -1)


def test_upserts_of_a_stream(spark, tmp_path):
    from tallyrack.streaming.ledger import JobStore, upsert_stream

    schema = "job_id long, nth long, status string, url string, rows array<struct<title:string>>"
    store = JobStore(spark, str(tmp_path / "s"))
    for rows in ([(1, 0, "success", "u", [("a",), ("b",)]), (1, -1, "queued", "u", [("no",)])], [(1, 1, "success", "u", [("c",)]), (2, 0, "failed", "v", [])]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run = upsert_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "c"))
        assert run.awaitTermination(120)
    assert sorted((r.job_id, r.status, r.nth) for r in store.jobs().collect()) == [(1, "success", 1), (2, "failed", 0)]
    assert [tuple(r) for r in store.rows().collect()] == [(1, 0, "c")]


def test_a_batch_fold_keeps_the_sessions_partitions(spark):
    """Few bytes aren't put together into one task, and rows are put out many at a time."""
    rows = spark.createDataFrame([(f"k{i % 50}", datetime(2024, 1, 1, tzinfo=UTC) + timedelta(seconds=i * 7), i) for i in range(3000)], "key string, ts timestamp, id long")
    got = T.decide_in_order(rows, T.SlidingLog, 3, 900.0)
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    plain = T.decide(rows.withColumn("ts", F.unix_micros("ts") / 1e6), T.SlidingLog, 3, 900.0)
    names = ["key", "id", "allowed", "remaining", "reset_seconds"]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, plain.select(names).collect()))


def test_a_batch_of_queues_goes_out_many_rows_at_a_time(spark, monkeypatch):
    """However few rows are put out at a time, also in the middle of a job's, all are there with their types."""
    from tallyrack.streaming import ordered

    rows = [event(f"j{i % 3}", i * 97 % 5000, i, ["deliver", "failed", "done"][i % 5 % 3], i % 3, 3, [None, 0, 400][i % 3]) for i in range(200)]
    whole = Q.run_queue(spark.createDataFrame(rows, EVENT))
    want = told(whole)
    monkeypatch.setattr(ordered, "OUT", 7)
    assert told(Q.run_queue(spark.createDataFrame(rows, EVENT))) == want and len(want) > 200
    assert whole.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
