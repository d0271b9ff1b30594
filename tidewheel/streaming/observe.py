"""What a running job shows: watermarks, state, checkpoints, rates; over HTTP too."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .checkpoint import SavepointError, Savepoints, batches

HELP = "GET /healthz\nGET /jobs/<name>/watermarks\nGET /jobs/<name>/state\nGET /checkpoints\nGET /debug/throughput\nPOST /savepoints/{name}\n"


def _progress(query: StreamingQuery) -> list[dict]:
    return [p if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress]


def watermarks(query: StreamingQuery) -> dict:
    """The watermark, late rows so far, and rows held in state."""
    seen = _progress(query)
    if not seen:
        return {"watermark": None, "lateRecords": 0, "pendingRows": 0}
    late = sum(o.get("numRowsDroppedByWatermark", 0) for p in seen for o in p.get("stateOperators", []))
    return {"watermark": (seen[-1].get("eventTime") or {}).get("watermark"), "lateRecords": late, "pendingRows": sum(o.get("numRowsTotal", 0) for o in seen[-1].get("stateOperators", []))}


def late_records(spark: SparkSession, checkpoint: str) -> int:
    """Late rows that an exact job has seen, from its state."""
    return spark.read.format("statestore").option("stateVarName", "late").load(checkpoint).agg(F.coalesce(F.sum("value.n"), F.lit(0))).first()[0]


def state_counts(spark: SparkSession, checkpoint: str, names: dict[str, bool]) -> dict[str, int]:
    """Keys that hold each state variable, read from the checkpoint. `names`
    says for each variable whether it is a map."""
    out = {}
    for name, is_map in names.items():
        rows = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
        out[name] = rows.select("key").distinct().count() if is_map else rows.count()
    return out


def checkpoint_table(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(id, status) of the committed batches."""
    return spark.createDataFrame([(i, "completed") for i in batches(spark, checkpoint)], "id long, status string")


class Throughput:
    """Rates between two samples; the first sample has rates 0."""

    def __init__(self, counters: Callable[[], list[int]], clock: Callable[[], float] = time.monotonic):
        self.counters, self.clock, self.last, self.at = counters, clock, None, None

    def sample(self) -> dict:
        now, values = self.clock(), self.counters()
        span = now - self.at if self.at is not None else 0.0
        rates = [(v - (self.last[i] if i < len(self.last) else 0)) / span for i, v in enumerate(values)] if span > 0 else [0.0] * len(values)
        self.last, self.at = values, now
        return {"sourceRecords": sum(values), "sourcePerSec": sum(rates), "sampleIntervalMs": round(span * 1000), "subtasks": [{"index": i, "processed": v, "recordsPerSec": r} for i, (v, r) in enumerate(zip(values, rates, strict=True))]}


def query_counters(query: StreamingQuery) -> Callable[[], list[int]]:
    """Rows read so far, as a counter that adds up the query's progress."""
    done: dict[int, int] = {}

    def counters() -> list[int]:
        for p in _progress(query):
            done[p["batchId"]] = p.get("numInputRows", 0)
        return [sum(done.values())]

    return counters


def skipped_late(frame: DataFrame) -> DataFrame:
    """Late rows per key of an exact job's output."""
    return frame.where("kind = 'late'").groupBy("key").agg(F.count("*").alias("late"))


class ControlServer:
    """The HTTP surface of one job. savepoint: what a POST does (default: stop the
    query and copy its checkpoint; a Supervisor's also starts it again). states:
    the state variables to count, and whether each is a map. exact: an exact job,
    which keeps its late rows' number in state."""

    def __init__(self, name: str, query: Callable[[], StreamingQuery | None], savepoints: Savepoints, states: dict[str, bool] | None = None, exact: bool = False, port: int = 0, savepoint: Callable[[str], dict] | None = None):
        self.savepoint = savepoint or (lambda name: savepoints.trigger(query(), name))
        self.name, self.query, self.savepoints, self.states, self.exact = name, query, savepoints, states or {}, exact
        self.rates: Throughput | None = None
        server = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *args) -> None:
                pass

            def _send(self, status: int, body, kind: str = "application/json") -> None:
                raw = body.encode() if isinstance(body, str) else json.dumps(body).encode()
                self.send_response(status)
                self.send_header("Content-Type", kind)
                self.send_header("Content-Length", str(len(raw)))
                self.end_headers()
                self.wfile.write(raw)

            def do_GET(self) -> None:
                status, body = server.get(self.path)
                self._send(status, body, "text/plain" if isinstance(body, str) else "application/json")

            def do_POST(self) -> None:
                self._send(*server.post(self.path))

        self.http = ThreadingHTTPServer(("127.0.0.1", port), Handler)
        self.port = self.http.server_address[1]

    def start(self) -> ControlServer:
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        return self

    def stop(self) -> None:
        self.http.shutdown()
        self.http.server_close()

    def get(self, path: str) -> tuple[int, object]:
        query = self.query()
        if path == "/":
            return 200, f"{self.name}\n\n{HELP}"
        if path == "/healthz":
            return (200, "ok") if query is not None and query.isActive else (503, "stopped")
        if path == f"/jobs/{self.name}/watermarks":
            body = watermarks(query) if query is not None else {}
            if body and self.exact and batches(self.savepoints.spark, self.savepoints.checkpoint):
                body["lateRecords"] = late_records(self.savepoints.spark, self.savepoints.checkpoint)
            return 200, body
        if path == f"/jobs/{self.name}/state":
            return 200, state_counts(self.savepoints.spark, self.savepoints.checkpoint, self.states)
        if path == "/checkpoints":
            return 200, [{"id": i, "status": "completed"} for i in batches(self.savepoints.spark, self.savepoints.checkpoint)]
        if path == "/debug/throughput":
            if query is None:
                return 200, {}
            self.rates = self.rates or Throughput(query_counters(query))
            return 200, self.rates.sample()
        return 404, {"error": "not found"}

    def post(self, path: str) -> tuple[int, object]:
        if not path.startswith("/savepoints/"):
            return 404, {"error": "not found"}
        try:
            return 200, self.savepoint(path.removeprefix("/savepoints/"))
        except SavepointError as e:
            return 409, {"error": str(e)}
