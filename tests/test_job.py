from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewheel import Job, Tumbling, count, total
from tidewheel.cli import build, main, parser
from tidewheel.functions.text import upper_value
from tidewheel.streaming import SavepointError
from tidewheel.sources import console_sink, generator, late_script, scripted

BASE = datetime(2026, 9, 24, 12)


def at(*offsets):
    return [("a", str(i + 1), BASE + timedelta(seconds=x)) for i, x in enumerate(offsets)]


def collector():
    got = []
    return got, lambda batch, _: got.extend(batch.collect())


def test_fluent_windowed_job(spark):
    got, sink = collector()
    Job("demo").source(lambda s: scripted(s, at(1, 3))).map(value=upper_value(F.col("value"))).key_by("key").window(Tumbling(10), count()).sink(sink).run(spark)
    assert [r["value"] for r in got] == ["window[12:00:00~12:00:10) 2"] and got[0]["ts"] == BASE + timedelta(seconds=10)


def test_sum_text(spark):
    got, sink = collector()
    Job().source(lambda s: scripted(s, at(1, 3, 4))).map().key_by("key").window(Tumbling(10), total()).sink(sink).run(spark)
    assert got[0]["value"].endswith(" 6")


def test_pipeline_prints_upper_case(spark):
    lines = []
    Job().source(lambda s: generator(s, 3)).map(value=F.upper("value")).key_by("key").sink(console_sink(lines.append)).run(spark)
    assert sorted(x.split("value=")[1] for x in lines) == ["EVENT-0", "EVENT-1", "EVENT-2"] and "key=key-0" in " ".join(lines)


def test_filter_moves_the_clock_and_side_output(spark):
    got, sink = collector()
    late, side = collector()
    job = Job().source(lambda s: scripted(s, at(1, 30, 2))).map().key_by("key").window(Tumbling(10), count()).watermark_bound(2).sink(sink).side_output(side)
    job.filter("value <> '2'").run(spark)
    assert [r["value"] for r in late] == ["3"] and len(got) == 1


@pytest.mark.parametrize("drop, text", [("_source", "source"), ("_map", "map"), ("_key", "key_by"), ("_sink", "sink")])
def test_missing_parts(drop, text):
    from dataclasses import replace

    whole = Job().source(lambda s: None).map().key_by("key").sink(lambda b, i: None)
    with pytest.raises(ValueError, match=text):
        replace(whole, **{drop: None}).validate()


def test_window_needs_both_parts():
    with pytest.raises(ValueError, match="both"):
        Job().source(lambda s: None).map().key_by("key").sink(lambda b, i: None).window(Tumbling(1), None).validate()


def test_streams_refuse_what_they_cannot_do(spark):
    whole = Job().source(lambda s: None).map().key_by("key").sink(lambda b, i: None)
    with pytest.raises(ValueError, match="bounded"):
        whole.process_plan(lambda rows: rows).start(spark)


def test_a_keyed_function_before_a_window(spark):
    """The function renames the key; the window goes on by the key of the row."""

    def rename(state, event):
        yield event | {"key": "other"}

    got, sink = collector()
    Job().source(lambda s: scripted(s, at(1, 3))).map().key_by("key").process(rename, {}).window(Tumbling(10), count()).sink(sink).run(spark)
    assert [(r["key"], r["value"][-1]) for r in got] == [("a", "2")]


def test_senseless_settings_are_ignored():
    job = Job().parallelism(0).channel_capacity(-1).watermark_bound(-1).allowed_lateness(0)
    assert (job._parallelism, job._capacity, job._bound, job._lateness) == (1, 16, 5_000_000, 0)


def test_generators(spark):
    assert generator(spark, 0).count() == 0 and generator(spark, -3).count() == 0
    rows = late_script(spark, 14, "1s", start_us=0, repeats=True).orderBy("seq").collect()
    assert rows[4]["ts"] == datetime(1970, 1, 1, 0, 0, 3) and rows[6]["value"] == rows[5]["value"] and rows[13]["key"] == "key-0"


def test_cli(spark, capsys):
    args = parser().parse_args(["--job", "anything", "--session", "3s", "--lateness", "1s"])
    assert build(args)._lateness == 1_000_000 and type(build(args)._assigner).__name__ == "Session"
    assert type(build(parser().parse_args(["--slide", "1s"]))._assigner).__name__ == "Sliding"
    assert main(["--job", "dedup", "--count", "14", "--http", ""]) == 0
    out = capsys.readouterr().out
    assert len([x for x in out.splitlines() if "value=EVENT-" in x]) == 12
    assert main(["--job", "running-count", "--count", "5", "--http", ""]) == 0
    assert "EVENT-4 count=2" in capsys.readouterr().out
    assert main(["--count", "20", "--interval", "1s", "--http", ""]) == 0
    assert "window[" in capsys.readouterr().out


def test_cli_streams(spark, capsys, tmp_path):
    """With a data folder, generated events come as a stream, with state kept."""
    data = str(tmp_path / "data")
    assert main(["--count", "12", "--interval", "1ms", "--window", "1s", "--data-dir", data, "--checkpoint", "50ms", "--http", ""]) == 0
    lines = [x for x in capsys.readouterr().out.splitlines() if "window[" in x]
    assert sum(int(x.rsplit(" ", 1)[1]) for x in lines) == 12 and (tmp_path / "data" / "checkpoint" / "commits").exists()
    assert main(["--job", "dedup", "--count", "14", "--interval", "1ms", "--data-dir", str(tmp_path / "other"), "--http", ":0"]) == 0
    assert len([x for x in capsys.readouterr().out.splitlines() if "value=EVENT-" in x]) == 12


def test_cli_flags_that_need_one_another(spark):
    with pytest.raises(ValueError, match="--data-dir"):
        build(parser().parse_args(["--checkpoint", "1s"]))
    with pytest.raises(SavepointError, match="data directory"):
        main(["--resume", "sp", "--http", ""])
    late = build(parser().parse_args(["--broker", "http://localhost:1", "--lateness", "1s"]))
    assert late._lateness == 1_000_000 and late._side is not None and "ts" not in late._map


def test_sources_of_two_arguments_get_the_capacity(spark):
    asked = []
    job = Job().source(lambda s, n: asked.append(n) or scripted(s, at(1))).map().key_by("key").channel_capacity(7).sink(lambda b, i: b.collect())
    job.run(spark)
    assert asked == [7]


@pytest.mark.parametrize("settings", [{"lateness": "5s"}, {"side": console_sink()}])
def test_exact_stream_refuses_a_mapped_time(spark, settings):
    job = Job().source(lambda s: late_script(s, 5, "1s")).map(ts="ts + interval 1 day").key_by("key").window(Tumbling(10), count()).sink(console_sink())
    job = job.allowed_lateness(settings["lateness"]) if "lateness" in settings else job.side_output(settings["side"])
    with pytest.raises(ValueError, match="cannot set ts"):
        job.start(spark)
