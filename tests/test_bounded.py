import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from reference_model import run

from tidewheel.functions.text import event_time, float_text, number, payload
from tidewheel.model import EVENT, micros
from tidewheel.operators import InputClocks, OutOfOrderClock, Session, Sliding, Tumbling, count, total, with_clock
from tidewheel.operators.aggregates import custom, parse_number
from tidewheel.plans import dedup, list_state, running_count, windowed

BASE = datetime(2026, 9, 24, 12)


def rows(spark, offsets, key="a", value="1"):
    return spark.createDataFrame([(x[0] if isinstance(x, tuple) else key, value, BASE + timedelta(seconds=x[1] if isinstance(x, tuple) else x), i) for i, x in enumerate(offsets)], EVENT)


def seconds(ts):
    return (ts - BASE).total_seconds()


def emitted(frame):
    got = frame.collect()
    fires = sorted((r["key"], seconds(r["window_start"]), seconds(r["window_end"]), r["result"]) for r in got if r["kind"] == "fire")
    return fires, sorted(seconds(r["ts"]) for r in got if r["kind"] == "late")


def ends(fires):
    return sorted((e, n) for _, _, e, n in fires)


def test_tumbling_drops_late(spark):
    fires, late = emitted(windowed(rows(spark, [1, 3, 12, 13, 5, 20]), Tumbling(10), count(), 2))
    assert ends(fires) == [(10, 2), (20, 2), (30, 1)] and late == [5]


def test_sliding_assigns_both_windows(spark):
    assert Sliding(10, 5).panes(7_000_000) == [(0, 10_000_000), (5_000_000, 15_000_000)]
    fires, _ = emitted(windowed(rows(spark, [7]), Sliding(10, 5), count(), 1))
    assert [n for *_, n in fires] == [1, 1]


def test_keys_do_not_mix(spark):
    fires, _ = emitted(windowed(rows(spark, [("a", 1), ("b", 2), ("a", 3)]), Tumbling(10), count(), 1))
    assert sorted((k, n) for k, *_, n in fires) == [("a", 2), ("b", 1)]


def test_fire_timing(spark):
    fires, _ = emitted(windowed(rows(spark, [9, 11, 12]), Tumbling(10), count(), 2))
    assert ends(fires) == [(10, 1), (20, 2)]


def test_lateness_refires_and_side_output(spark):
    fires, late = emitted(windowed(rows(spark, [1, 12, 5, 20, 7, 30]), Tumbling(10), count(), 2, 5))
    assert ends(fires) == [(10, 1), (10, 2), (20, 1), (30, 1), (40, 1)] and late == [7]


def test_side_output_without_lateness(spark):
    fires, late = emitted(windowed(rows(spark, [1, 12, 5]), Tumbling(10), count(), 2))
    assert (10, 1) in ends(fires) and late == [5]


@pytest.mark.parametrize("offsets, bound, gap, lateness, expected", [
    ([0, 3, 20], 2, 5, 0, [(8, 2), (25, 1)]),
    ([0, 4, 10, 7, 30], 2, 5, 0, [(15, 4), (35, 1)]),
    ([0, 4, 8, 12, 13, 14, 6, 60], 1, 5, 0, [(19, 7), (65, 1)]),
    ([0, 20, 4, 60], 2, 5, 30, [(5, 1), (9, 2), (25, 1), (65, 1)]),
])
def test_sessions(spark, offsets, bound, gap, lateness, expected):
    fires, _ = emitted(windowed(rows(spark, offsets), Session(gap), count(), bound, lateness))
    assert ends(fires) == expected


@pytest.mark.parametrize("assigner, kind", [(Tumbling(10), ("tumbling", 10)), (Sliding(12, 5), ("sliding", 12, 5)), (Sliding(3, 7), ("sliding", 3, 7)), (Session(6), ("session", 6))])
@pytest.mark.parametrize("lateness", [0, 8])
def test_random_input_equals_the_model(spark, assigner, kind, lateness):
    rng = random.Random(f"{kind}{lateness}")
    at, data = 100, []
    for _ in range(300):
        at += rng.choice([0, 1, 1, 2, 3])
        data.append((rng.choice("abc"), str(rng.randint(1, 9)), at - rng.choice([0, 0, 0, 2, 5, 11, 25])))
    frame = spark.createDataFrame([(k, v, BASE - timedelta(seconds=BASE.second) + timedelta(seconds=t), i) for i, (k, v, t) in enumerate(data)], EVENT)
    shift = int(BASE.timestamp()) if False else int((BASE - datetime(1970, 1, 1)).total_seconds())
    fires, late = run([(k, int(v), t + shift) for k, v, t in data], kind, 4, lateness, add=lambda s, v: s + v)
    got = windowed(frame, assigner, total(), 4, lateness).collect()
    origin = datetime(1970, 1, 1)
    mine = sorted((r["key"], round((r["window_start"] - origin).total_seconds()), round((r["window_end"] - origin).total_seconds()), round(r["result"])) for r in got if r["kind"] == "fire")
    assert mine == fires
    assert sorted((r["seq"], r["key"]) for r in got if r["kind"] == "late") == late


def test_clock_over_buckets_equals_one_task(spark):
    rng = random.Random(5)
    frame = rows(spark, [rng.randint(0, 500) for _ in range(400)])
    one = {r["seq"]: r["clock"] for r in with_clock(frame, 3).collect()}
    many = {r["seq"]: r["clock"] for r in with_clock(frame, 3, bucket_rows=17).collect()}
    assert one == many and one[0] is None


def test_clocks():
    clock = OutOfOrderClock(2)
    for t in (1, 4, 3, 8):
        clock.observe(t * 1_000_000)
    assert clock.now == 6_000_000
    both = InputClocks()
    assert [both.update(i, t) for i, t in ((0, 10), (1, 6), (1, 12), (0, 13))] == [10, 10, 10, 12]


def test_nonpositive_windows_take_nothing(spark):
    for assigner in (Tumbling(0), Sliding(0, 1), Sliding(1, 0), Session(0)):
        assert windowed(rows(spark, [1, 2]), assigner, count(), 1).count() == 0


def test_empty_input(spark):
    assert windowed(rows(spark, []), Tumbling(10), count(), 1).count() == 0
    assert windowed(rows(spark, []), Session(10), count(), 1).count() == 0


def test_numbers_in_values(spark):
    cases = {"1": 1.0, " 1": None, "1d": None, "1e999": None, "1e3": 1000.0, "inf": float("inf"), "-Inf": float("-inf"), "": None, "x": None, ".5": 0.5, "5.": 5.0, "+2": 2.0, "1_000": None, "0x1p4": 16.0, "-0X1.8p1": -3.0, "0x.8p0": 0.5, "0x1": None, "0xp1": None, "0x1p99999": None, "0x0p0": 0.0, "0x1p-1074": 5e-324, "0xfffffffffffffp-52": 1 - 2.0**-52}
    got = {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in cases], "v string").select("v", number(F.col("v"))).collect()}
    assert got == cases
    assert all(parse_number(k) == (v or 0.0) for k, v in cases.items())


def test_number_text(spark):
    cases = [(3.0, "3"), (1e7, "10000000"), (0.5, "0.5"), (1.25e10, "12500000000"), (1e-7, "0.0000001"), (-2.5e-5, "-0.000025"), (1.5e20, "150000000000000000000"), (0.0, "0"), (float("inf"), "+Inf")]
    got = [r[0] for r in spark.createDataFrame([(x,) for x, _ in cases], "x double").select(float_text(F.col("x"))).collect()]
    assert got == [t for _, t in cases]


def test_time_prefix(spark):
    ts = F.lit(BASE).cast("timestamp_ntz")
    cases = ["1700000000123456789|pay|load", "|x", "abc|x", "12", "99999999999999999999|x", "-1000|y"]
    got = [(r[0], r[1]) for r in spark.createDataFrame([(c,) for c in cases], "v string").select(payload(F.col("v")), event_time(F.col("v"), ts)).collect()]
    assert [p for p, _ in got] == ["pay|load", "|x", "abc|x", "12", "99999999999999999999|x", "y"]
    assert got[0][1] == datetime(2023, 11, 14, 22, 13, 20, 123456) and got[1][1] == BASE and got[5][1] == datetime(1969, 12, 31, 23, 59, 59, 999999)


def test_process_plans(spark):
    data = [(f"user-{u}", f"order-{o}") for _ in range(2) for u in range(10) for o in range(50)]
    frame = spark.createDataFrame([(k, v, BASE, i) for i, (k, v) in enumerate(data)], EVENT)
    assert dedup(frame).count() == 500 and dedup(frame).agg(F.max("seq")).first()[0] == 499
    last = running_count(frame).where("key = 'user-3'").orderBy(F.desc("seq")).first()
    assert last["value"] == "order-49 count=100" and last["n"] == 100
    assert {tuple(r["values"]) for r in list_state(frame, 2).collect()} == {("order-48", "order-49")}


def test_durations():
    assert [micros(x) for x in ("250ms", "1h30m", "10 minutes", 2, timedelta(seconds=1), "0s")] == [250_000, 5_400_000_000, 600_000_000, 2_000_000, 1_000_000, 0]
    with pytest.raises(ValueError):
        micros("soon")


def test_sessions_refuse_what_cannot_be_folded(spark):
    longest = custom("longest", lambda: F.max(F.length("value")), "long")
    with pytest.raises(ValueError, match="folded"):
        windowed(rows(spark, [1, 12, 5]), Session(3), longest, 2)


@pytest.mark.parametrize("bucket_rows", [1_000_000, 3])
def test_clock_of_rows_without_a_place(spark, bucket_rows):
    """Rows with a null seq come before all others, in one bucket or in many."""
    at = lambda s: BASE + timedelta(seconds=s)
    data = [("a", "1", at(9), None)] + [("a", "1", at(i), i) for i in range(9)]
    got = with_clock(spark.createDataFrame(data, EVENT), 0, bucket_rows=bucket_rows).collect()
    assert len(got) == 10 and {r["seq"]: r["clock"] for r in got} == {None: None} | {i: at(9) for i in range(9)}
    nowhere = with_clock(spark.createDataFrame([("a", "1", at(3), None)] * 5, EVENT), 0, bucket_rows=bucket_rows).collect()
    assert len(nowhere) == 5


def test_one_day_by_the_second(spark):
    """A window of 86,400 slides is a sequence, not as many expressions."""
    panes = Sliding("1d", "1s").explode(rows(spark, [5]))
    assert panes.count() == 86_400 and len(panes._jdf.queryExecution().optimizedPlan().toString()) < 5_000


def test_last_values_of_a_hot_key(spark):
    frame = spark.range(5_000).select(F.lit("k").alias("key"), F.col("id").cast("string").alias("value"), F.lit(BASE).cast("timestamp_ntz").alias("ts"), F.col("id").alias("seq"))
    assert list_state(frame, 3).first()["values"] == ["4997", "4998", "4999"]


def test_sessions_run_over_stretches(spark, monkeypatch):
    """One key, whose sessions cross the stretches its rows are ordered in."""
    from tidewheel.plans import bounded

    monkeypatch.setattr(bounded, "STRETCH_GAPS", 2)
    rng = random.Random(5)
    places = sorted(rng.sample(range(4000), 900))
    some = rows(spark, places)
    nameless = windowed(some.withColumn("key", F.lit(None).cast("string")), Session(6), count(), 0)
    got = windowed(some, Session(6), count(), 0).collect()
    assert nameless.where("kind = 'fire'").count() == sum(r["kind"] == "fire" for r in got)
    plain = custom("plain", lambda: F.count(F.lit(1)), "long", lambda s, _: (s or 0) + 1, lambda a, b: (a or 0) + (b or 0))
    assert sorted(windowed(some, Session(6), plain, 0).collect(), key=repr) == sorted(got, key=repr)
    want, first, last, n = [], places[0], places[0], 0
    for x in [*places, 10**6]:
        if x - last > 6:
            want.append((first, last + 6, n))
            first, n = x, 0
        last, n = x, n + 1
    assert sorted((seconds(r["window_start"]), seconds(r["window_end"]), r["result"]) for r in got if r["kind"] == "fire") == want


def test_running_counts_go_on_over_slices(spark, monkeypatch):
    from tidewheel.plans import process

    monkeypatch.setattr(process, "SLICE", 7)
    data = [("k" if i % 3 else None, "v", BASE, i if i else None) for i in range(50)]
    got = {r["seq"]: r["n"] for r in running_count(spark.createDataFrame(data, EVENT)).collect()}
    seen = {}
    for k, _, _, i in data:
        seen[k] = seen.get(k, 0) + 1
        assert got[i] == seen[k]
