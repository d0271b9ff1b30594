"""Queries over the driver's events table, each with its DuckDB twin.

Arrival is event_id order, or, where lateness matters, a fixed permutation that
delays every fifth event by 37 places."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import event_time, float_text, number, payload, upper_value, window_text
from .model import END_OF_TIME, epoch_us, events
from .operators.aggregates import count, total
from .operators.clock import with_clock
from .operators.windows import Session, Sliding, Tumbling
from .plans.bounded import late_rows, window_results, windowed
from .plans.process import dedup, list_state, running_count
from .streaming.exact import exact_windows
from .streaming.native import native_windows
from .streaming.observe import state_counts
from .streaming.process import COUNT_STATE, DEDUP_STATE, dedup_function, keyed_process, running_count_function
from .streaming.state import ROCKSDB

HOUR = 3_600


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(_events(spark, sf_dir), "user_id", "value", "ts", "event_id")


def _by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(_events(spark, sf_dir), "event_type", "value", "ts", "event_id")


def _delayed(spark: SparkSession, sf_dir: str, key: str = "event_type") -> DataFrame:
    """Rows in delayed arrival; seq is unique and follows (arrival, event_id)."""
    arrival = "(event_id + if(event_id % 5 = 4, 37, 0)) * 2 + if(event_id % 5 = 4, 0, 1)"
    return events(_events(spark, sf_dir), key, "value", "ts", arrival)


def _sums(frame: DataFrame) -> DataFrame:
    return frame.withColumn("result", F.round("result", 2))


def map_uppercase(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", upper_value(F.col("event_type")).alias("value"))


def map_event_time_prefix(spark, sf_dir):
    raw = _events(spark, sf_dir).select("event_id", F.concat((epoch_us("ts") * 1000).cast("string"), F.lit("|"), F.col("event_type"), F.lit("|"), F.col("user_id").cast("string")).alias("raw"))
    return raw.select("event_id", event_time(F.col("raw"), F.lit(None).cast("timestamp_ntz")).alias("ts"), payload(F.col("raw")).alias("value"))


def filter_passthrough(spark, sf_dir):
    return _by_user(spark, sf_dir).where(number(F.col("value")) > 50).select("key", "ts", "seq")


def key_by_partition_counts(spark, sf_dir):
    return _by_user(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n"))


def tumbling_count(spark, sf_dir):
    return window_results(_by_user(spark, sf_dir), Tumbling(7 * HOUR), count(), 600)


def tumbling_sum(spark, sf_dir):
    return _sums(window_results(_by_user(spark, sf_dir), Tumbling(7 * HOUR), total(), 600))


def sliding_count(spark, sf_dir):
    return window_results(_by_user(spark, sf_dir), Sliding(6 * HOUR, 2 * HOUR), count(), 600)


def sliding_sum(spark, sf_dir):
    return _sums(window_results(_by_user(spark, sf_dir), Sliding(6 * HOUR, 2 * HOUR), total(), 600))


def sliding_gapped(spark, sf_dir):
    return window_results(_by_user(spark, sf_dir), Sliding(2 * HOUR, 5 * HOUR), count(), 600)


def session_count(spark, sf_dir):
    return window_results(_by_user(spark, sf_dir), Session(6 * HOUR), count(), 600)


def session_sum(spark, sf_dir):
    return _sums(window_results(_by_user(spark, sf_dir), Session(6 * HOUR), total(), 600))


def session_late_fold(spark, sf_dir):
    return windowed(_delayed(spark, sf_dir, "user_id"), Session(2 * HOUR), count(), 600, HOUR).drop("value")


def watermark_progress(spark, sf_dir):
    return with_clock(_delayed(spark, sf_dir), 600, bucket_rows=2_000).select("seq", "clock")


def late_dropped_fires(spark, sf_dir):
    return window_results(_delayed(spark, sf_dir), Tumbling(HOUR), count(), 600)


def late_side_output(spark, sf_dir):
    return late_rows(_delayed(spark, sf_dir), Tumbling(HOUR), count(), 600).select("key", "seq", "ts", "window_start")


def late_count(spark, sf_dir):
    return late_rows(_delayed(spark, sf_dir), Tumbling(HOUR), count(), 600).groupBy("key").agg(F.count("*").alias("late"))


def lateness_refires(spark, sf_dir):
    return window_results(_delayed(spark, sf_dir), Tumbling(HOUR), count(), 600, HOUR)


def lateness_refires_sum(spark, sf_dir):
    return _sums(window_results(_delayed(spark, sf_dir), Tumbling(HOUR), total(), 600, HOUR))


def sliding_partial_late(spark, sf_dir):
    out = windowed(_delayed(spark, sf_dir), Sliding(3 * HOUR, HOUR), count(), 600, HOUR)
    return out.select("kind", "key", "window_start", "window_end", "result", "firing", "seq")


def dedup_first(spark, sf_dir):
    return dedup(_by_user_type(spark, sf_dir)).select("key", "value", "seq")


def _by_user_type(spark, sf_dir):
    return events(_events(spark, sf_dir), "user_id", "event_type", "ts", "event_id")


def dedup_state(spark, sf_dir):
    return keyed_process(_by_user_type(spark, sf_dir), dedup_function, DEDUP_STATE).select("key", "value", "seq")


def running_counts(spark, sf_dir):
    return running_count(_by_user_type(spark, sf_dir)).select("key", "value", "seq")


def running_count_state(spark, sf_dir):
    return keyed_process(_by_user_type(spark, sf_dir), running_count_function, COUNT_STATE).select("key", "value", "seq")


def _seen_and_bought(state, event):
    """Drops what a key has seen, and counts its purchases."""
    for e in dedup_function(state, event):
        yield from running_count_function(state, e) if e["value"] == "purchase" else (e,)


def state_key_counts(spark, sf_dir):
    """Keys that hold each state, read from the store that a stream has left."""
    checkpoint = _scratch(spark, "state")
    found = keyed_process(events(_stream(spark, sf_dir), "user_id", "event_type", "ts", "event_id"), _seen_and_bought, DEDUP_STATE | COUNT_STATE)
    _drain(spark, found, "update", checkpoint, lambda b, _: b.write.format("noop").mode("overwrite").save())
    return spark.createDataFrame(sorted(state_counts(spark, checkpoint, {"seen": True, "count": False}).items()), "state string, n_keys long")


def list_state_last_values(spark, sf_dir):
    return list_state(_by_user_type(spark, sf_dir), 5).select("key", F.array_join("values", ",").alias("last_values"))


def _last_five(state, event):
    values = [*state["last"].get(), event["value"]]
    if len(values) > 5:
        state["last"].clear()
        for v in values[-5:]:
            state["last"].add(v)
    else:
        state["last"].add(event["value"])
    yield event | {"value": ",".join(values[-5:])}


def list_state_by_key(spark, sf_dir):
    """The same by list state: what the function gave last for each key."""
    found = keyed_process(_by_user_type(spark, sf_dir), _last_five, {"last": ("list", "value string")})
    return found.groupBy("key").agg(F.max_by("value", "seq").alias("last_values"))


def process_then_window(spark, sf_dir):
    rows = with_clock(_by_user_type(spark, sf_dir), 600)
    return window_results(dedup(rows), Tumbling(24 * HOUR), count(), 600)


def _renamed(state, event):
    """Numbers its key's events and sends every other one on under another name."""
    n = (state["n"].get()[0] or 0) + 1
    state["n"].set(n)
    if n % 2:
        yield event | {"key": f"renamed-{event['key']}"}


def process_rekey_then_window(spark, sf_dir):
    """The function renames keys; windows go on by the key it was routed by."""
    found = keyed_process(with_clock(_by_type(spark, sf_dir), 600), _renamed, {"n": ("value", "n long")})
    routed = found.where(F.col("key") == F.concat(F.lit("renamed-"), "route_key")).withColumn("key", F.col("route_key")).drop("route_key")
    return window_results(routed, Tumbling(24 * HOUR), count(), 600)


def window_result_text(spark, sf_dir):
    found = window_results(_by_type(spark, sf_dir), Tumbling(7 * HOUR), count(), 600)
    return found.select("key", F.col("window_end").alias("ts"), window_text(F.col("window_start"), F.col("window_end"), F.col("result").cast("string")).alias("value"))


def sum_result_text(spark, sf_dir):
    found = _events(spark, sf_dir).select("event_id", (F.col("user_id") * 10_000_000 / 4).alias("x"))
    return found.select("event_id", float_text(F.col("x")).alias("value"))


# --- streams -----------------------------------------------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared checkpoint folder."""
    import tempfile

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    base = base or tempfile.mkdtemp(prefix="tidewheel-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def _drain(spark: SparkSession, frame: DataFrame, mode: str, checkpoint: str, sink) -> None:
    """Run a stream until its input is read; end rows have fired all windows by
    then, so no batch without data follows. State settings hold for this run."""
    names = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.shuffle.partitions": "8", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        query = frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(_events(spark, sf_dir).schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/event[s].parquet")


def stream_tumbling_native(spark, sf_dir):
    """Windows of a file stream by Spark's watermark. Complete mode gives the
    windows still open at the end as well."""
    out, state = _scratch(spark, "native"), _scratch(spark, "state")
    found = native_windows(events(_stream(spark, sf_dir), "event_type", "value", "ts", "event_id"), Tumbling(HOUR), count(), 600)
    _drain(spark, found, "complete", state, lambda b, _: b.write.mode("overwrite").parquet(out))
    return spark.read.parquet(out)


def _exact_input(spark, sf_dir, parts: int) -> tuple[str, str]:
    """(folder, schema) of files with clocks, in a folder for each stretch of
    arrival, end rows last. Rows are dealt to tasks by arrival, to 400 at most."""
    path = _scratch(spark, "arrivals")
    came = _delayed(spark, sf_dir)
    top = came.agg(F.max("seq")).first()[0] or 0
    rows = with_clock(came, 600).select("key", "value", epoch_us("ts").alias("us"), "seq", epoch_us("clock").alias("clock_us"))
    rows = rows.withColumn("part", F.expr(f"cast(seq div {top // parts + 1} as int)"))
    end = F.lit(END_OF_TIME).cast("timestamp_ntz")
    ends = came.select("key").distinct().select("key", F.lit(None).cast("string").alias("value"), epoch_us(end).alias("us"), F.lit(-1).cast("long").alias("seq"), epoch_us(end).alias("clock_us"), F.lit(parts).alias("part"))
    stretch = F.expr(f"seq div {max(2_000_000, top // 400 + 1)}")
    for frame in (rows.repartition("part", stretch), ends.coalesce(1)):
        frame.write.mode("append").partitionBy("part").parquet(path)
    return path, "key string, value string, us long, seq long, clock_us long"


def _exact_stream(spark, path: str, schema: str, parts: str) -> DataFrame:
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1_000).parquet(f"{path}/part={parts}")
    return exact_windows(stream, Tumbling(HOUR), count(), HOUR)


def _append(out: str):
    return lambda b, i: b.select("key", "window_start", "window_end", "result", "firing", "kind").write.mode("overwrite").parquet(f"{out}/batch={i}")


def stream_exact_lateness(spark, sf_dir):
    """Per-record clocks, re-fires and late rows by keyed state."""
    path, schema = _exact_input(spark, sf_dir, 2)
    out, state = _scratch(spark, "exact"), _scratch(spark, "state")
    _drain(spark, _exact_stream(spark, path, schema, "*"), "update", state, _append(out))
    return spark.read.parquet(out).where("kind = 'fire'").select("key", "window_start", "window_end", "result", "firing")


def stream_restart_equivalence(spark, sf_dir):
    """The same in three runs on one checkpoint: each run finds the state the
    one before it left, and batch folders keep what was written once."""
    path, schema = _exact_input(spark, sf_dir, 2)
    out, state, feed = _scratch(spark, "restart"), _scratch(spark, "state"), _scratch(spark, "feed")
    for part in (0, 1, 2):
        spark.read.schema(schema).parquet(f"{path}/part={part}").write.mode("append").parquet(feed)
        stream = spark.readStream.schema(schema).parquet(feed)
        _drain(spark, exact_windows(stream, Tumbling(HOUR), count(), HOUR), "update", state, _append(out))
    return spark.read.parquet(out).where("kind = 'fire'").select("key", "window_start", "window_end", "result", "firing")


QUERIES = {
    f.__name__: f
    for f in (
        map_uppercase, map_event_time_prefix, filter_passthrough, key_by_partition_counts, tumbling_count, tumbling_sum, sliding_count, sliding_sum, sliding_gapped, session_count, session_sum, session_late_fold, watermark_progress,
        late_dropped_fires, late_side_output, late_count, lateness_refires, lateness_refires_sum, sliding_partial_late, dedup_first, dedup_state, running_counts, running_count_state, state_key_counts, list_state_last_values, list_state_by_key,
        process_then_window, process_rekey_then_window, window_result_text, sum_result_text, stream_tumbling_native, stream_exact_lateness, stream_restart_equivalence,
    )
}


# --- the same in DuckDB --------------------------------------------------------

_H = HOUR * 1_000_000


def _at(us: str) -> str:
    return f"make_timestamp({us})"


def _panes(size: int, slide: int, key: str, rows: str = "events") -> str:
    """One row per event and window, in microseconds."""
    n = (size - 1) // slide + 1
    return f"""(SELECT *, (epoch_us(ts) // {slide} - k) * {slide} AS s, (epoch_us(ts) // {slide} - k) * {slide} + {size} AS e, CAST({key} AS VARCHAR) AS key
      FROM {rows} CROSS JOIN range({n}) r(k) WHERE (epoch_us(ts) // {slide} - k) * {slide} + {size} > epoch_us(ts))"""


def _simple(size: int, slide: int, key: str, result: str) -> str:
    return f"SELECT key, {_at('s')} AS window_start, {_at('e')} AS window_end, {result} AS result, CAST(0 AS BIGINT) AS firing FROM {_panes(size, slide, key)} GROUP BY key, s, e"


def _session(result: str) -> str:
    gap = 6 * _H
    return f"""SELECT key, {_at('min(us)')} AS window_start, {_at(f'max(us) + {gap}')} AS window_end, {result} AS result, CAST(0 AS BIGINT) AS firing FROM (
      SELECT *, sum(opens) OVER (PARTITION BY key ORDER BY us, event_id) AS island FROM (
        SELECT CAST(user_id AS VARCHAR) AS key, value, event_id, epoch_us(ts) AS us,
          CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= {gap} THEN 0 ELSE 1 END AS opens FROM events))
      GROUP BY key, island"""


_ARRIVED = """arrived AS (
  SELECT *, max(epoch_us(ts)) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 600000000 AS clock
  FROM (SELECT *, (event_id + CASE WHEN event_id % 5 = 4 THEN 37 ELSE 0 END) * 2 + CASE WHEN event_id % 5 = 4 THEN 0 ELSE 1 END AS seq FROM events))"""


def _classed(size: int, slide: int, lateness: int) -> str:
    return f"""WITH {_ARRIVED}, classed AS (
      SELECT *, CASE WHEN clock IS NULL OR e > clock THEN 'ontime' WHEN clock < e + {lateness} THEN 'refire' ELSE 'late' END AS class FROM {_panes(size, slide, 'event_type', 'arrived')})"""


def _fired(result: str, running: str) -> str:
    return f"""SELECT key, {_at('s')} AS window_start, {_at('e')} AS window_end, {result} AS result, CAST(0 AS BIGINT) AS firing FROM classed WHERE class = 'ontime' GROUP BY key, s, e
      UNION ALL SELECT key, {_at('s')}, {_at('e')}, result, CAST(firing AS BIGINT) FROM (
        SELECT key, s, e, class, {running} AS result, sum(CASE WHEN class = 'refire' THEN 1 ELSE 0 END) OVER w AS firing
        FROM classed WHERE class <> 'late' WINDOW w AS (PARTITION BY key, s, e ORDER BY seq ROWS UNBOUNDED PRECEDING)) WHERE class = 'refire'"""


_COUNTS, _SUMS = _fired("count(*)", "count(*) OVER w"), _fired("round(sum(value), 2)", "round(sum(value) OVER w, 2)")
_DEDUP = "SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events"
_LATE = _classed(_H, _H, 0)
_REFIRES = f"{_classed(_H, _H, _H)} {_COUNTS}"

ORACLE = {
    "map_uppercase": "SELECT event_id, upper(event_type) AS value FROM events",
    "map_event_time_prefix": "SELECT event_id, ts, event_type || '|' || user_id AS value FROM events",
    "filter_passthrough": "SELECT CAST(user_id AS VARCHAR) AS key, ts, event_id AS seq FROM events WHERE value > 50",
    "key_by_partition_counts": "SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n FROM events GROUP BY user_id",
    "tumbling_count": _simple(7 * _H, 7 * _H, "user_id", "count(*)"),
    "tumbling_sum": _simple(7 * _H, 7 * _H, "user_id", "round(sum(value), 2)"),
    "sliding_count": _simple(6 * _H, 2 * _H, "user_id", "count(*)"),
    "sliding_sum": _simple(6 * _H, 2 * _H, "user_id", "round(sum(value), 2)"),
    "sliding_gapped": _simple(2 * _H, 5 * _H, "user_id", "count(*)"),
    "session_count": _session("count(*)"),
    "session_sum": _session("round(sum(value), 2)"),
    "watermark_progress": f"WITH {_ARRIVED} SELECT seq, {_at('clock')} AS clock FROM arrived",
    "late_dropped_fires": f"{_LATE} SELECT key, {_at('s')} AS window_start, {_at('e')} AS window_end, count(*) AS result, CAST(0 AS BIGINT) AS firing FROM classed WHERE class = 'ontime' GROUP BY key, s, e",
    "late_side_output": f"{_LATE} SELECT key, seq, ts, {_at('s')} AS window_start FROM classed WHERE class = 'late'",
    "late_count": f"{_LATE} SELECT key, count(*) AS late FROM classed WHERE class = 'late' GROUP BY key",
    "lateness_refires": _REFIRES,
    "lateness_refires_sum": f"{_classed(_H, _H, _H)} {_SUMS}",
    "sliding_partial_late": f"""{_classed(3 * _H, _H, _H)} SELECT 'fire' AS kind, key, window_start, window_end, result, firing, CAST(NULL AS BIGINT) AS seq FROM ({_COUNTS})
      UNION ALL SELECT 'late', key, {_at('s')}, {_at('e')}, NULL, NULL, seq FROM classed WHERE class = 'late'""",
    "dedup_first": f"SELECT CAST(user_id AS VARCHAR) AS key, event_type AS value, event_id AS seq FROM ({_DEDUP}) WHERE r = 1",
    "dedup_state": f"SELECT CAST(user_id AS VARCHAR) AS key, event_type AS value, event_id AS seq FROM ({_DEDUP}) WHERE r = 1",
    "running_counts": "SELECT CAST(user_id AS VARCHAR) AS key, event_type || ' count=' || row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS value, event_id AS seq FROM events",
    "state_key_counts": "SELECT 'seen' AS state, count(DISTINCT user_id) AS n_keys FROM events UNION ALL SELECT 'count', count(DISTINCT user_id) FROM events WHERE event_type = 'purchase'",
    "list_state_last_values": "SELECT CAST(user_id AS VARCHAR) AS key, string_agg(event_type, ',' ORDER BY event_id) AS last_values FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 5 GROUP BY user_id",
    "process_then_window": f"SELECT CAST(user_id AS VARCHAR) AS key, {_at(f'epoch_us(ts) // {24 * _H} * {24 * _H}')} AS window_start, {_at(f'epoch_us(ts) // {24 * _H} * {24 * _H} + {24 * _H}')} AS window_end, count(*) AS result, CAST(0 AS BIGINT) AS firing FROM ({_DEDUP}) WHERE r = 1 GROUP BY 1, 2, 3",
    "process_rekey_then_window": f"""SELECT key, {_at('s')} AS window_start, {_at('e')} AS window_end, count(*) AS result, CAST(0 AS BIGINT) AS firing FROM
      {_panes(24 * _H, 24 * _H, 'event_type', '(SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events)')} WHERE n % 2 = 1 GROUP BY key, s, e""",
    "window_result_text": f"SELECT key, window_end AS ts, 'window[' || strftime(window_start, '%H:%M:%S') || '~' || strftime(window_end, '%H:%M:%S') || ') ' || result AS value FROM ({_simple(7 * _H, 7 * _H, 'event_type', 'count(*)')})",
    "sum_result_text": "SELECT event_id, CASE WHEN user_id * 10000000 % 4 = 0 THEN CAST(user_id * 10000000 // 4 AS VARCHAR) ELSE CAST(user_id * 10000000 / 4 AS VARCHAR) END AS value FROM events",
    "stream_tumbling_native": f"SELECT key, window_start, window_end, result FROM ({_simple(_H, _H, 'event_type', 'count(*)')})",
    "stream_exact_lateness": _REFIRES,
    "stream_restart_equivalence": _REFIRES,
}
ORACLE["running_count_state"] = ORACLE["running_counts"]
ORACLE["list_state_by_key"] = ORACLE["list_state_last_values"]

# Sessions folded row by row: each step holds a key's open sessions as a list,
# fires and drops what the clock has passed, then merges the row in.
_FOLD_GAP, _FOLD_LATE = 2 * _H, _H
ORACLE["session_late_fold"] = f"""WITH RECURSIVE {_ARRIVED}, placed AS (
  SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS us, seq, clock, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS r FROM arrived
), steps AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT) AS r, CAST([] AS STRUCT(s BIGINT, e BIGINT, n BIGINT, fired BOOLEAN, k BIGINT)[]) AS cells,
    CAST([] AS STRUCT(kind VARCHAR, s BIGINT, e BIGINT, result BIGINT, firing BIGINT, us BIGINT, seq BIGINT)[]) AS outs FROM placed
  UNION ALL
  SELECT key, r, CASE WHEN too_late THEN adv ELSE list_append(apart, struct_pack(s := ms, e := me, n := n0 + 1, fired := again OR (same AND fired0), k := CASE WHEN again THEN greatest(k0, 1) + 1 ELSE k0 END)) END,
    list_concat(due, CASE WHEN too_late THEN [struct_pack(kind := 'late', s := ms, e := me, result := CAST(NULL AS BIGINT), firing := CAST(NULL AS BIGINT), us := us, seq := seq)]
      WHEN again THEN [struct_pack(kind := 'fire', s := ms, e := me, result := n0 + 1, firing := greatest(k0, 1), us := CAST(NULL AS BIGINT), seq := CAST(NULL AS BIGINT))] ELSE [] END)
  FROM (SELECT *, coalesce(me <= clock AND clock >= me + {_FOLD_LATE}, false) AS too_late, coalesce(me <= clock AND clock < me + {_FOLD_LATE}, false) AS again FROM (
    SELECT *, least(us, coalesce(list_min(list_transform(touch, lambda c: c.s)), us)) AS ms, greatest(us + {_FOLD_GAP}, coalesce(list_max(list_transform(touch, lambda c: c.e)), us)) AS me,
      CAST(coalesce(list_sum(list_transform(touch, lambda c: c.n)), 0) AS BIGINT) AS n0,
      len(touch) = 1 AND coalesce(touch[1].s <= us AND touch[1].e >= us + {_FOLD_GAP}, false) AS same,
      CASE WHEN len(touch) = 1 AND touch[1].s <= us AND touch[1].e >= us + {_FOLD_GAP} THEN touch[1].k ELSE 0 END AS k0, coalesce(touch[1].fired, false) AS fired0 FROM (
      SELECT *, list_filter(adv, lambda c: c.s <= us + {_FOLD_GAP} AND us <= c.e) AS touch, list_filter(adv, lambda c: NOT (c.s <= us + {_FOLD_GAP} AND us <= c.e)) AS apart FROM (
        SELECT p.key, p.r, p.us, p.seq, p.clock,
          list_transform(list_filter(t.cells, lambda c: coalesce(c.e <= p.clock, false) AND NOT c.fired), lambda c: struct_pack(kind := 'fire', s := c.s, e := c.e, result := c.n, firing := c.k, us := CAST(NULL AS BIGINT), seq := CAST(NULL AS BIGINT))) AS due,
          list_filter(list_transform(t.cells, lambda c: struct_pack(s := c.s, e := c.e, n := c.n, fired := c.fired OR coalesce(c.e <= p.clock, false), k := c.k + CASE WHEN coalesce(c.e <= p.clock, false) AND NOT c.fired THEN 1 ELSE 0 END)),
            lambda c: NOT coalesce(c.e + {_FOLD_LATE} <= p.clock, false)) AS adv
        FROM steps t JOIN placed p ON p.key = t.key AND p.r = t.r + 1))))
), ended AS (SELECT key, max(r) AS r FROM placed GROUP BY key), said AS (
  SELECT key, unnest(outs) AS o FROM steps
  UNION ALL SELECT key, unnest(list_transform(list_filter(cells, lambda c: NOT c.fired), lambda c: struct_pack(kind := 'fire', s := c.s, e := c.e, result := c.n, firing := c.k, us := CAST(NULL AS BIGINT), seq := CAST(NULL AS BIGINT)))) AS o
  FROM steps JOIN ended USING (key, r)
)
SELECT o.kind AS kind, key, {_at('o.s')} AS window_start, {_at('o.e')} AS window_end, o.result AS result, o.firing AS firing, {_at('o.us')} AS ts, o.seq AS seq FROM said"""
