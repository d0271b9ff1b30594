import base64
import json
import threading
import time
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse
from urllib.request import Request, urlopen

import pytest

from tidewheel import Job, Session, Tumbling, count
from tidewheel.job import finish
from tidewheel.model import EVENT
from tidewheel.operators import Sliding
from tidewheel.operators.aggregates import total
from tidewheel.plans import windowed
from tidewheel.sources import ClockedLogSource, HttpLogSource, ScriptedSource, idempotent, scripted, write_script
from tidewheel.sources.scripted import ScriptedReader
from tidewheel.streaming import SavepointError, Savepoints, Supervisor, batches, exact_windows, keyed_process, native_windows
from tidewheel.streaming.native import configure
from tidewheel.streaming.observe import ControlServer, Throughput, state_counts, watermarks
from tidewheel.streaming.process import COUNT_STATE, running_count_function

BASE = datetime(2026, 9, 26, 12)


def at(*offsets, key="a"):
    return [(key, "1", BASE + timedelta(seconds=x)) for x in offsets]


def crash(n):
    return [(f"key-{i % 3}", "1", BASE + timedelta(seconds=i)) for i in range(n)]


def wait(condition, seconds=60):
    end = time.time() + seconds
    while not condition() and time.time() < end:
        time.sleep(0.1)
    assert condition()


def script_job(path, out, **options):
    options = {"path": path, "bound": "2s", "perBatch": "8"} | options
    job = Job("scripted").source(lambda s: s.readStream.format("scripted").options(**options).load()).map().key_by("key").parallelism(2).watermark_bound("2s")
    return job.window(Tumbling(10), count()).sink(lambda b, i: b.select("key", "value", "ts").write.mode("overwrite").parquet(f"{out}/batch={i}"))


def results(spark, out):
    return sorted((r["key"], r["value"], r["ts"]) for r in spark.read.parquet(out).select("key", "value", "ts").collect())


def bounded(spark, events):
    job = Job("b").source(lambda s: scripted(s, events)).map().key_by("key").watermark_bound("2s").window(Tumbling(10), count())
    got = []
    job.sink(lambda b, i: got.extend(b.collect())).run(spark)
    return sorted((r["key"], r["value"], r["ts"]) for r in got)


@pytest.fixture(scope="module", autouse=True)
def formats(spark):
    spark.dataSource.register(ScriptedSource)
    spark.dataSource.register(HttpLogSource)
    spark.dataSource.register(ClockedLogSource)
    configure(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_exact_stream_equals_lateness_fixture(spark, tmp_path):
    path, got, late = write_script(str(tmp_path / "s"), at(1, 12, 5, 20, 7, 30)), [], []
    job = script_job(path, str(tmp_path / "out"), perBatch="2").allowed_lateness(5).side_output(lambda b, i: late.extend(b.collect())).sink(lambda b, i: got.extend(b.collect()))
    query = job.start(spark)
    wait(lambda: len(got) >= 5)
    query.stop()
    assert sorted((r["ts"] - BASE).total_seconds() for r in got) == [10, 10, 20, 30, 40]
    assert sorted(r["value"][-1] for r in got) == ["1", "1", "1", "1", "2"]
    assert [(r["ts"] - BASE).total_seconds() for r in late] == [7]


@pytest.mark.parametrize("assigner", [Tumbling(10), Sliding(12, 5), Session(6)])
def test_exact_over_bounded_rows_equals_the_bounded_plan(spark, tmp_path, assigner):
    import random

    from tidewheel.model import epoch_us
    from tidewheel.operators import with_clock
    from tidewheel.sources.scripted import END_US

    rng = random.Random(3)
    data = [(rng.choice("abc"), "1", BASE + timedelta(seconds=2 * i - rng.choice([0, 0, 3, 9, 20])), i) for i in range(120)]
    rows = with_clock(spark.createDataFrame(data, EVENT), 4)
    ends = spark.createDataFrame([(k, None, END_US, -1, END_US) for k in "abc"], "key string, value string, us long, seq long, clock_us long")
    feed = rows.select("key", "value", epoch_us("ts").alias("us"), "seq", epoch_us("clock").alias("clock_us")).unionByName(ends)
    columns = ["kind", "key", "window_start", "window_end", "result", "seq"]
    rank = lambda frame: sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)
    mine = exact_windows(feed, assigner, count(), 6)
    assert rank(mine) == rank(windowed(rows, assigner, count(), 4, 6))


def test_restart_on_the_checkpoint_equals_one_run(spark, tmp_path):
    events = crash(30)
    path, out, data = write_script(str(tmp_path / "s"), events), str(tmp_path / "out"), str(tmp_path / "data")
    job = script_job(path, out).checkpointing(data)
    query = job.start(spark, exact=True)
    wait(lambda: len(batches(spark, f"{data}/checkpoint")) >= 2)
    query.stop()
    query = job.start(spark, exact=True)
    query.processAllAvailable()
    wait(lambda: len(results(spark, out)) >= 9)
    query.stop()
    assert results(spark, out) == bounded(spark, events)


def test_savepoint_resumes_elsewhere(spark, tmp_path):
    events = crash(30)
    path, out, data = write_script(str(tmp_path / "s"), events), str(tmp_path / "out"), str(tmp_path / "data")
    first = write_script(str(tmp_path / "first"), events[:14])
    query = script_job(first, out, end="false").checkpointing(data).start(spark, exact=True)
    points = Savepoints(spark, data)
    meta = points.trigger(query, "sp1")
    assert meta["id"] is not None and points.names() == ["sp1"]
    query = script_job(first, out, end="false").checkpointing(data).start(spark, exact=True)
    with pytest.raises(SavepointError, match="exists"):
        points.trigger(query, "sp1")
    query.stop()
    with pytest.raises(SavepointError, match="parallelism"):
        points.check(7)
    import shutil

    other = str(tmp_path / "other")
    shutil.copytree(f"{data}/savepoints", f"{other}/savepoints")
    query = script_job(path, out).checkpointing(other).resume_from("sp1").start(spark, exact=True)
    query.processAllAvailable()
    wait(lambda: len(results(spark, out)) >= 9)
    query.stop()
    assert results(spark, out) == bounded(spark, events)
    with pytest.raises(SavepointError, match="no savepoint"):
        Savepoints(spark, str(tmp_path / "none")).resume("sp9")


def test_savepoint_needs_a_running_job_and_a_folder(spark, tmp_path):
    with pytest.raises(SavepointError, match="data directory"):
        Savepoints(spark, None).trigger(None, "x")
    with pytest.raises(SavepointError, match="not running"):
        Savepoints(spark, str(tmp_path)).trigger(None, "x")


def test_native_drops_late_rows_of_their_batch(spark, tmp_path):
    feed = str(tmp_path / "feed")
    for i, x in enumerate([1, 12, 5, 40, 60]):
        spark.createDataFrame([("a", "1", BASE + timedelta(seconds=x), i)], EVENT).coalesce(1).write.mode("append").parquet(feed)
        time.sleep(0.02)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(feed)
    got = []
    query = native_windows(stream, Tumbling(10), count(), 2).writeStream.outputMode("append").foreachBatch(lambda b, i: got.extend(b.collect())).start()
    query.processAllAvailable()
    seen = watermarks(query)
    query.stop()
    assert {(r["window_end"] - BASE).total_seconds(): r["result"] for r in got} == {10: 1, 20: 1, 50: 1}
    assert seen["lateRecords"] == 1 and seen["watermark"]
    with pytest.raises(ValueError):
        native_windows(stream, Sliding(2, 5), count())


def test_process_state_survives_a_restart(spark, tmp_path):
    feed, state = str(tmp_path / "feed"), str(tmp_path / "state")
    got = []

    def once(rows):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(EVENT).parquet(feed)
        query = keyed_process(stream, running_count_function, COUNT_STATE).writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(lambda b, i: got.extend(b.collect())).trigger(availableNow=True).start()
        query.awaitTermination()

    once([("k", "x", BASE, 0), ("k", "y", BASE, 1), ("j", "x", BASE, 2)])
    once([("k", "z", BASE, 3)])
    assert [r["value"] for r in got if r["seq"] == 3] == ["z count=3"]
    assert state_counts(spark, state, {"count": False}) == {"count": 2}


def test_state_cells(spark):
    def steps(state, event):
        value, items, orders = state["v"], state["l"], state["m"]
        seen = [value.get(), items.get(), len(orders), orders.get("order-1")]
        value.set(41)
        value.set(42)
        items.add("x")
        items.add("y")
        orders.put("order-1", True)
        orders.put("order-2", True)
        seen += [value.get(), items.get(), len(orders)]
        orders.remove("order-1")
        orders.remove("missing")
        value.clear()
        items.clear()
        seen += [value.get(), items.get(), len(orders), orders.get("order-1")]
        yield event | {"value": repr(seen)}

    states = {"v": ("value", "n long"), "l": ("list", "x string"), "m": ("map", "value string", "flag boolean")}
    rows = spark.createDataFrame([("a", "", BASE, 0), ("b", "", BASE, 1)], EVENT)
    got = {r["key"]: r["value"] for r in keyed_process(rows, steps, states).collect()}
    assert got["a"] == got["b"] == repr([(None, False), [], 0, (None, False), (42, True), ["x", "y"], 2, (None, False), [], 1, (None, False)])


def test_an_error_in_a_function_fails_the_job(spark):
    def bad(state, event):
        raise RuntimeError("no such order")

    with pytest.raises(Exception, match="no such order"):
        keyed_process(spark.createDataFrame([("a", "", BASE, 0)], EVENT), bad, COUNT_STATE).collect()


def test_scripted_reader_seeks_and_replays(tmp_path):
    reader = ScriptedReader({"path": write_script(str(tmp_path / "s"), crash(20)), "perBatch": "7", "bound": "2s"})
    assert [reader.seek(x) for x in (-1, 5, 99)] == [0, 5, 20]
    rows, end = reader.read(reader.initialOffset())
    rows = list(rows)
    assert len(rows) == 7 and end["next"] == 7 and list(reader.readBetweenOffsets(reader.initialOffset(), end)) == rows


class Broker:
    """An in-memory log with one group."""

    def __init__(self, partitions=1):
        self.logs, self.committed, self.generation, self.fenced = {}, {}, 1, False
        self.partitions = list(range(partitions))
        broker = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *args):
                pass

            def reply(self, status, body):
                raw = json.dumps(body).encode()
                self.send_response(status)
                self.send_header("Content-Length", str(len(raw)))
                self.end_headers()
                self.wfile.write(raw)

            def do_GET(self):
                q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
                log = broker.logs.get((q["topic"], int(q["partition"])), [])
                some = log[int(q["offset"]) : int(q["offset"]) + int(q["max_records"])]
                self.reply(200, {"records": some, "next_offset": int(q["offset"]) + len(some)})

            def do_POST(self):
                url = urlparse(self.path)
                q = {k: v[0] for k, v in parse_qs(url.query).items()}
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                if url.path.endswith("/join"):
                    broker.generation += broker.fenced
                    broker.fenced = False
                    return self.reply(200, {"generation": broker.generation, "partitions": broker.partitions})
                if url.path.endswith("/heartbeat"):
                    return self.reply(409 if broker.fenced else 200, {"generation": broker.generation})
                if url.path == "/commit":
                    x = json.loads(body)
                    if x["generation"] != broker.generation:
                        return self.reply(409, {})
                    broker.committed[x["partition"]] = x["offset"]
                    return self.reply(200, {})
                broker.add(q["topic"], q["key"], body.decode())
                self.reply(200, {})

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_address[1]}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def add(self, topic, key, value, partition=0, seconds=0):
        log = self.logs.setdefault((topic, partition), [])
        log.append({"offset": len(log), "timestamp_ns": int((BASE + timedelta(seconds=seconds)).timestamp() * 1e9), "key": base64.b64encode(key.encode()).decode(), "value": base64.b64encode(value.encode()).decode()})


@pytest.fixture
def broker():
    b = Broker(2)
    yield b
    b.server.shutdown()


def test_log_is_read_and_committed(spark, tmp_path, broker):
    for i in range(5):
        broker.add("events", f"key-{i}", f"val-{i}", partition=0)
    for i in range(3):
        broker.add("events", f"other-{i}", "x", partition=1)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream = spark.readStream.format("httplog").options(broker=broker.url, topic="events", group="g", maxRecords="2").load()
    start = lambda: stream.writeStream.option("checkpointLocation", state).foreachBatch(idempotent(out)).start()
    query = start()
    query.processAllAvailable()
    query.stop()
    got = [(r["partition"], r["offset"], r["key"], r["value"]) for r in spark.read.parquet(out).orderBy("partition", "offset").collect()]
    assert got[:5] == [(0, i, f"key-{i}", f"val-{i}") for i in range(5)] and len(got) == 8
    broker.fenced = True
    broker.add("events", "key-5", "val-5", partition=0)
    query = start()
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(out).count() == 9
    assert broker.committed[0] >= 4 and broker.committed[1] == 2


def test_write_log(spark, broker):
    from tidewheel.sources import write_log

    write_log(spark.createDataFrame([("user-A", "count=3")], "key string, value string"), broker.url, "counts")
    log = broker.logs["counts", 0]
    assert len(log) == 1 and base64.b64decode(log[0]["value"]) == b"count=3"


def test_throughput_rates():
    values, now = [[0, 0]], [0.0]
    t = Throughput(lambda: values[0], lambda: now[0])
    assert t.sample()["sourcePerSec"] == 0
    values[0], now[0] = [30, 20], 2.0
    s = t.sample()
    assert s["sourcePerSec"] == 25 and s["sourceRecords"] == 50 == sum(x["processed"] for x in s["subtasks"]) and s["sampleIntervalMs"] == 2000


def test_control_server(spark, tmp_path):
    path, data = write_script(str(tmp_path / "s"), crash(12)), str(tmp_path / "data")
    query = script_job(path, str(tmp_path / "out"), end="false").checkpointing(data).start(spark, exact=True)
    query.processAllAvailable()
    server = ControlServer("demo", lambda: query, Savepoints(spark, data), {"cells": True}).start()
    get = lambda p: urlopen(f"http://127.0.0.1:{server.port}{p}").read().decode()
    try:
        assert get("/healthz") == "ok" and "savepoints" in get("/")
        wait(lambda: json.loads(get("/debug/throughput"))["sourceRecords"] == 12)
        assert json.loads(get("/checkpoints"))[0]["status"] == "completed"
        assert json.loads(get("/jobs/demo/state")) == {"cells": 3}
        assert "watermark" in json.loads(get("/jobs/demo/watermarks"))
        post = lambda: urlopen(Request(f"http://127.0.0.1:{server.port}/savepoints/sp", method="POST"))
        assert json.loads(post().read())["name"] == "sp"
        with pytest.raises(Exception, match="409"):
            post()
    finally:
        server.stop()


def test_supervisor_goes_on_after_a_savepoint(spark, tmp_path):
    events, out, data = crash(24), str(tmp_path / "out"), str(tmp_path / "data")
    path = write_script(str(tmp_path / "s"), events)
    job = script_job(path, out).checkpointing(data)
    points = Savepoints(spark, data)
    running = Supervisor(lambda first: job.start(spark, exact=True), points)
    server = ControlServer("demo", lambda: running.query, points, savepoint=running.savepoint).start()
    try:
        meta = json.loads(urlopen(Request(f"http://127.0.0.1:{server.port}/savepoints/one", method="POST")).read())
        assert meta["name"] == "one" and running.query.isActive and points.names() == ["one"]
        running.query.processAllAvailable()
        wait(lambda: results(spark, out) == bounded(spark, events))
    finally:
        server.stop()
        running.stop()
    running.wait()


def test_an_idle_key_fires(spark, tmp_path):
    """b's window is due when a's rows have moved the clock, without a row of b."""
    path, got = write_script(str(tmp_path / "s"), [*at(1, key="b"), *at(2, 30, 31, 32)]), []
    query = script_job(path, str(tmp_path / "out"), end="false", perBatch="1").sink(lambda b, i: got.extend(b.collect())).start(spark, exact=True)
    wait(lambda: {r["key"] for r in got} == {"a", "b"})
    query.stop()
    assert sorted((r["key"], (r["ts"] - BASE).total_seconds(), r["value"][-1]) for r in got) == [("a", 10, "1"), ("b", 10, "1")]


def test_a_function_and_a_window_in_one_stream(spark, tmp_path):
    """Dedup before the window; late rows are those of the function's events."""
    events = [("a", v, BASE + timedelta(seconds=x)) for v, x in (("p", 1), ("q", 3), ("p", 4), ("r", 25), ("s", 2), ("p", 26), ("t", 60))]

    def distinct(state, event):
        if not state["seen"].get(event["value"])[1]:
            state["seen"].put(event["value"], True)
            yield event | {"key": "renamed"}

    states = {"seen": ("map", "value string", "flag boolean")}
    path, got, late = write_script(str(tmp_path / "s"), events), [], []
    job = script_job(path, str(tmp_path / "out"), perBatch="2").process(distinct, states).allowed_lateness(1).side_output(lambda b, i: late.extend(b.collect())).sink(lambda b, i: got.extend(b.collect()))
    query = job.start(spark)
    wait(lambda: len(got) >= 3)
    query.stop()
    mine = sorted((r["key"], r["value"], r["ts"]) for r in got)
    want, missed = [], []
    plain = Job().source(lambda s: scripted(s, events)).map().key_by("key").watermark_bound("2s").process(distinct, states).window(Tumbling(10), count()).allowed_lateness(1)
    plain.side_output(lambda b, i: missed.extend(b.collect())).sink(lambda b, i: want.extend(b.collect())).run(spark)
    assert mine == sorted((r["key"], r["value"], r["ts"]) for r in want) and [r["value"] for r in late] == [r["value"] for r in missed] == ["s"]


def test_a_restore_keeps_the_kind_of_aggregate(spark, tmp_path):
    path, data = write_script(str(tmp_path / "s"), crash(12)), str(tmp_path / "data")
    job = script_job(path, str(tmp_path / "out"), end="false").checkpointing(data)
    query = job.start(spark, exact=True)
    query.processAllAvailable()
    Savepoints(spark, data).trigger(query, "sp")
    with pytest.raises(SavepointError, match="aggregate count"):
        job.window(Tumbling(10), total()).start(spark, exact=True)
    with pytest.raises(SavepointError, match="window"):
        job.window(Tumbling(20), count()).start(spark, exact=True)
    import shutil

    shutil.copytree(f"{data}/savepoints", str(tmp_path / "other" / "savepoints"))
    with pytest.raises(SavepointError, match="aggregate count"):
        job.checkpointing(str(tmp_path / "other")).resume_from("sp").window(Tumbling(10), total()).start(spark, exact=True)


def test_a_savepoint_while_records_keep_coming(spark, tmp_path):
    """A source that never runs dry: the savepoint is taken between two batches."""
    data = str(tmp_path / "data")
    job = Job("endless").source(lambda s: s.readStream.format("rate-micro-batch").option("rowsPerBatch", 20).option("advanceMillisPerBatch", 1000).load().selectExpr("cast(value % 3 as string) as key", "'1' as value", "timestamp as ts", "value as seq"))
    job = job.map().key_by("key").parallelism(2).process(running_count_function, COUNT_STATE).sink(lambda b, i: b.count()).checkpointing(data)
    query = job.start(spark)
    wait(lambda: len(batches(spark, f"{data}/checkpoint")) >= 2)
    meta = Savepoints(spark, data).trigger(query, "busy")
    saved = batches(spark, meta["path"])
    assert not query.isActive and meta["id"] == saved[-1]
    offsets = [int(p.name) for p in (tmp_path / "data" / "savepoints" / "busy" / "offsets").iterdir() if p.name.isdigit()]
    assert max(offsets) == saved[-1]


def test_what_an_exact_job_still_holds_can_be_fired(spark, tmp_path):
    """A bounded source without end rows: the state's open windows at the end."""
    events, data, got = crash(30), str(tmp_path / "data"), []
    path = write_script(str(tmp_path / "s"), events)
    job = script_job(path, str(tmp_path / "out"), end="false").checkpointing(data).sink(lambda b, i: got.extend(b.collect()))
    query = job.start(spark, exact=True)
    query.processAllAvailable()
    query.stop()
    assert len(got) < 9
    finish(job, spark)
    assert sorted((r["key"], r["value"], r["ts"]) for r in got) == bounded(spark, events)


@pytest.mark.parametrize("aggregate", [count(), total()])
def test_what_a_native_job_still_holds_can_be_fired(spark, tmp_path, aggregate):
    feed, data, got = str(tmp_path / "feed"), str(tmp_path / "data"), []
    spark.createDataFrame([("a", "2", BASE + timedelta(seconds=x), x) for x in (1, 2, 12, 40)], EVENT).coalesce(1).write.parquet(feed)
    job = Job("native").source(lambda s: s.readStream.schema(EVENT).parquet(feed)).map().key_by("key").parallelism(2).watermark_bound("2s").window(Tumbling(10), aggregate).checkpointing(data).sink(lambda b, i: got.extend(b.collect()))
    query = job.start(spark)
    query.processAllAvailable()
    query.stop()
    early = len(got)
    finish(job, spark)
    n = 2 if aggregate.name == "sum" else 1
    assert early == 2 and sorted(((r["ts"] - BASE).total_seconds(), int(r["value"].rsplit(" ", 1)[1])) for r in got) == [(10, 2 * n), (20, n), (50, n)]
    with pytest.raises(ValueError, match="sessions"):
        finish(job.window(Session(3), aggregate), spark)


def test_late_rows_of_an_exact_job_are_counted(spark, tmp_path):
    path, data = write_script(str(tmp_path / "s"), at(1, 12, 5, 20, 7, 30)), str(tmp_path / "data")
    query = script_job(path, str(tmp_path / "out"), end="false").checkpointing(data).start(spark, exact=True)
    query.processAllAvailable()
    server = ControlServer("demo", lambda: query, Savepoints(spark, data), {"cells": True}, exact=True).start()
    try:
        seen = json.loads(urlopen(f"http://127.0.0.1:{server.port}/jobs/demo/watermarks").read())
        assert seen["lateRecords"] == 2 and seen["watermark"].startswith("2026-09-26T12:00:27")
    finally:
        server.stop()
        query.stop()


def test_log_with_lateness(spark, tmp_path, broker):
    """Exact clocks over the log: a re-fire and a late record, and a restart."""
    for x in (1, 12, 5, 20, 7, 30):
        broker.add("events", "a", "1", partition=0, seconds=x)
    batches_got, batches_late, data = {}, {}, str(tmp_path / "data")
    flat = lambda found: [r for _, rows in sorted(found.items()) for r in rows]
    source = lambda s, n: s.readStream.format("httplog_clocked").options(broker=broker.url, topic="events", group="g", maxRecords=str(n), bound="2s").load()
    job = Job("log").source(source).map().key_by("key").channel_capacity(2).parallelism(2).window(Tumbling(10), count()).allowed_lateness(5).checkpointing(data)
    job = job.side_output(lambda b, i: batches_late.update({i: b.collect()})).sink(lambda b, i: batches_got.update({i: b.collect()}))
    query = job.start(spark)
    wait(lambda: len(flat(batches_got)) >= 3)
    query.stop()
    broker.fenced = True
    for x in (60, 61):
        broker.add("events", "b", "1", partition=1, seconds=x)
    query = job.start(spark)
    wait(lambda: len(flat(batches_got)) >= 5)
    wait(lambda: broker.committed.get(1) == 1)
    query.stop()
    fired = sorted((r["key"], (r["ts"] - BASE).total_seconds(), r["value"][-1]) for r in flat(batches_got))
    assert fired == [("a", 10, "1"), ("a", 10, "2"), ("a", 20, "1"), ("a", 30, "1"), ("a", 40, "1")]
    assert [(r["ts"] - BASE).total_seconds() for r in flat(batches_late)] == [7] and broker.committed[0] == 5


def test_members_beat_while_a_batch_runs(broker):
    from tidewheel.sources.httplog import HttpLogReader

    reader = HttpLogReader({"broker": broker.url, "topic": "t", "heartbeatSeconds": "0.05"})
    broker.fenced = True
    wait(lambda: reader.generation == 2 and not broker.fenced, 10)


def test_a_million_keys(spark):
    """1,000,000 keys once, 100 of them again: each has its own count."""
    from tidewheel.plans import running_count

    rows = spark.range(1_000_100).selectExpr("concat('key-', id % 1000000) as key", "'1' as value", "timestamp_ntz'2026-09-24 12:00:00' as ts", "id as seq")
    found = running_count(rows)
    assert found.where("seq >= 1000000").selectExpr("min(n)", "max(n)", "count(*)").first()[:] == (2, 2, 100)
    last = found.groupBy("key").agg({"n": "max"}).toDF("key", "n")
    assert last.groupBy("n").count().orderBy("n").collect() == [(1, 999_900), (2, 100)]
