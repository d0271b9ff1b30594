"""python -m tidewheel --job windowed-count: the demo jobs."""

from __future__ import annotations

import argparse
import json
import re
import sys
import time
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import event_time, payload, upper_value
from .job import Job
from .model import micros
from .operators.aggregates import count
from .operators.windows import Session, Sliding, Tumbling
from .plans.process import dedup, running_count
from .sources.generator import GeneratedSource, late_script
from .sources.httplog import ClockedLogSource, HttpLogSource, write_log
from .sources.sinks import console_sink
from .streaming.checkpoint import Savepoints
from .streaming.observe import ControlServer
from .streaming.process import COUNT_STATE, DEDUP_STATE, dedup_function, running_count_function
from .streaming.supervisor import Supervisor


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewheel", description="Event-time demo jobs on Spark.")
    p.add_argument("--job", default="windowed-count", help="windowed-count (also for unknown names), dedup or running-count")
    p.add_argument("--count", type=int, default=10, help="events to generate")
    p.add_argument("--interval", default="100ms", help="time between generated events")
    p.add_argument("--parallelism", type=int, default=2, help="partitions of keyed work")
    p.add_argument("--buffer", type=int, default=4, help="records of a micro-batch")
    p.add_argument("--watermark-bound", default="2s")
    p.add_argument("--window", default="5s", help="window size")
    p.add_argument("--slide", default="0s", help="0: tumbling")
    p.add_argument("--session", default="0s", help="session gap; goes before window and slide")
    p.add_argument("--lateness", default="0s", help="allowed lateness; late rows are printed")
    p.add_argument("--http", default=":9081", help="address of the control server; empty: none, and generated events without a data folder run as bounded rows")
    p.add_argument("--data-dir", default="", help="state folder (empty: no checkpoints)")
    p.add_argument("--checkpoint", default="0s", help="checkpoint interval")
    p.add_argument("--resume", default="", help="savepoint to resume from")
    p.add_argument("--broker", default="", help="log broker URL (empty: generated events)")
    p.add_argument("--topic", default="events")
    p.add_argument("--out-topic", default="counts")
    p.add_argument("--group", default="tidewheel")
    p.add_argument("--member", default="tidewheel-0")
    return p


def streams(args: argparse.Namespace) -> bool:
    """Whether the job runs as a stream: over the log, or with anything that only
    a running job has. Otherwise generated events are bounded rows."""
    return bool(args.broker or args.data_dir or args.resume or args.http)


def _log_source(args: argparse.Namespace, exact: bool):
    def read(spark, capacity):
        options = {"broker": args.broker, "topic": args.topic, "group": args.group, "member": args.member, "maxRecords": str(capacity * 25)}
        if exact:
            return spark.readStream.format("httplog_clocked").options(bound=args.watermark_bound, prefix="true", **options).load()
        return spark.readStream.format("httplog").options(**options).load().withColumn("seq", F.col("offset"))

    return read


def _generated_source(args: argparse.Namespace):
    def read(spark, capacity):
        if not streams(args):
            return late_script(spark, args.count, args.interval, repeats=args.job == "dedup")
        options = {"count": str(args.count), "interval": args.interval, "bound": args.watermark_bound, "perBatch": str(capacity), "repeats": str(args.job == "dedup")}
        return spark.readStream.format("generated").options(**options).load().withColumn("ts", F.timestamp_micros("us").cast("timestamp_ntz"))

    return read


def build(args: argparse.Namespace) -> Job:
    """The job of parsed arguments."""
    if micros(args.checkpoint) > 0 and not args.data_dir:
        raise ValueError("--checkpoint needs --data-dir")
    stream, windowed = streams(args), args.job not in ("dedup", "running-count")
    exact = stream and windowed and (not args.broker or micros(args.lateness) > 0)
    value, ts = F.col("value"), F.col("ts")
    job = Job(args.job)
    # The clocked sources have read the time in front of a value already.
    job = job.map(value=upper_value(payload(value))) if exact else job.map(ts=event_time(value, ts.cast("timestamp_ntz")), value=upper_value(payload(value)))
    job = job.key_by("key").parallelism(args.parallelism).channel_capacity(args.buffer).watermark_bound(args.watermark_bound).sink(console_sink())
    if args.broker:
        job = job.source(_log_source(args, exact)).sink(lambda b, _: write_log(b, args.broker, args.out_topic))
    else:
        job = job.source(_generated_source(args))
    if args.data_dir:
        job = job.checkpointing(args.data_dir, args.checkpoint)
    if args.resume:
        job = job.resume_from(args.resume)
    if args.job == "dedup":
        return job.process(dedup_function, DEDUP_STATE) if stream else job.process_plan(dedup)
    if args.job == "running-count":
        return job.process(running_count_function, COUNT_STATE) if stream else job.process_plan(lambda rows: running_count(rows).drop("n"))
    if micros(args.session) > 0:
        assigner = Session(args.session)
    elif micros(args.slide) > 0:
        assigner = Sliding(args.window, args.slide)
    else:
        assigner = Tumbling(args.window)
    job = job.window(assigner, count())
    if micros(args.lateness) > 0:
        job = job.allowed_lateness(args.lateness).side_output(console_sink(lambda line: print(line.replace(" key=", " LATE key=", 1))))
    return job


def _ended(query, count: int) -> bool:
    """Whether a generated stream has read all its events and its end rows."""
    last = query.lastProgress
    last = last if last is None or isinstance(last, dict) else json.loads(last.json)
    found = [re.search(r"next\W+(\d+)", str(s.get("endOffset"))) for s in (last or {}).get("sources", [])]
    return any(m and int(m[1]) > count for m in found)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tidewheel").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    job = build(args)
    if not streams(args):
        job.run(spark)
        return 0
    for source in (HttpLogSource, ClockedLogSource, GeneratedSource):
        spark.dataSource.register(source)
    exact = job._assigner is not None and (not args.broker or job._lateness > 0)
    points = Savepoints(spark, args.data_dir or None)
    running = Supervisor(lambda first: (job if first else replace(job, _resume=None)).start(spark, exact=exact), points)
    server = None
    if args.http:
        states = {"dedup": {"seen": True}, "running-count": {"count": False}}.get(args.job, {"cells": True} if exact else {})
        server = ControlServer(job.name, lambda: running.query, points, states, exact, port=int(args.http.rpartition(":")[2] or 0), savepoint=running.savepoint).start()
    try:
        if args.broker:
            running.wait()
        while not args.broker and not _ended(running.query, args.count):
            if running.query.exception() is not None:
                running.wait()
            time.sleep(0.1)
    except KeyboardInterrupt:
        pass
    finally:
        running.stop()
        if server is not None:
            server.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
