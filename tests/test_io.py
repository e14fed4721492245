"""Sources, sinks, streams and the command line."""

import datetime as dt
import json
import threading
import urllib.error
import urllib.request
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from logtide import cli
from logtide.errors import ConfigError
from logtide.operators import features
from logtide.plans import pipeline
from logtide.settings import Settings
from logtide.sources import logs, sinks
from logtide.streaming import streams


def test_text_and_batches(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\n\n  \ntwo \xff\n")
    got = [r.line for r in logs.read_text(spark, str(tmp_path / "a.log")).collect()]
    assert got == ["one", "  ", "two �"]
    batches = spark.createDataFrame([("web", ["x", " ", ""]), (None, ["y"])], "source string, lines array<string>")
    assert sorted((r.line, r.source) for r in logs.from_batches(batches).collect()) == [("x", "web"), ("y", "api")]
    assert logs.accepted(batches).first().ingested == 4
    assert [r.line for r in logs.from_lines(spark, ["a", "b"]).collect()] == ["a", "b"]
    sinks.write_lines(logs.from_lines(spark, ["a", "b"]).coalesce(1), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_messages(spark):
    raw = spark.createDataFrame([('{"line": "l", "source": "s", "ts": 1.5}',), ("{}",), ("junk",)], "value string")
    got = logs.decode_messages(raw).collect()
    assert (got[0].line, got[0].source, got[0].bad) == ("l", "s", False) and got[0].ts == dt.datetime(1970, 1, 1, 0, 0, 1, 500000)
    assert (got[1].line, got[1].source, got[1].bad) == ("", "unknown", False) and got[1].ts.year > 2020
    assert got[2].bad


def test_store(spark, tmp_path):
    store = sinks.Store(spark, str(tmp_path / "s"))
    assert store.read("templates") is None
    rows = lambda *x: spark.createDataFrame(list(x), "template_id string, count int, last_seen int")
    store.upsert("templates", rows(("a", 1, 1), ("b", 1, 1), ("a", 2, 2)))
    store.upsert("templates", rows(("b", 5, 0)))
    assert sorted((r.template_id, r["count"]) for r in store.read("templates").collect()) == [("a", 2), ("b", 5)]


def stream_of(spark, tmp_path, frame):
    frame.repartition(3).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_streamed_windows_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(300)
    lines = logs.logs_of_events(events)
    stream = streams.classified(stream_of(spark, tmp_path, lines))
    parts = []
    counted = streams.window_counts(stream, "component", Settings(window_seconds=3600), late="60 days")
    streams.drain_to(counted, lambda b, i: parts.append({(r.component, r.start): r["count"] for r in b.collect()}), str(tmp_path / "c1"))
    got = {}
    for p in parts:
        got |= p
    batch = features.window_counts(streams.classified(lines), "component", 3600).collect()
    assert {(k[0], int(k[1].replace(tzinfo=dt.timezone.utc).timestamp()) // 3600): v for k, v in got.items()} == {(r.component, r.widx): r["count"] for r in batch}


def test_streamed_state(spark, tmp_path):
    lines = logs.generate(spark, 400).coalesce(1)
    stream = streams.with_templates(streams.classified(stream_of(spark, tmp_path, lines)))
    streams.drain(stream, str(tmp_path / "out"), str(tmp_path / "c")).stop()
    out = spark.read.parquet(str(tmp_path / "out"))
    batch = pipeline.judged(lines)
    assert out.count() == 400 and out.where("is_new").count() == out.select("group_id").distinct().count() == batch.select("template_id").distinct().count()
    assert sorted(r["count"] for r in out.groupBy("group_id").count().collect()) == sorted(r["count"] for r in batch.groupBy("template_id").count().collect())


def test_streamed_rates_and_cooldown_equal_batch(spark, tmp_path):
    lines = spark.range(300).select(F.col("id").cast("string").alias("id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 7 + (F.col("id") % 5) * 40).alias("ts"), F.lit("t").alias("template_id"))
    one = lines.coalesce(1)
    one.write.parquet(str(tmp_path / "one"))
    read = lambda: spark.readStream.schema(one.schema).parquet(str(tmp_path / "one"))
    streams.drain(streams.rates(read(), "template_id", Settings(window_seconds=60)), str(tmp_path / "r"), str(tmp_path / "cr"))
    want = {r.id: r.rate_z for r in features.rate_z(lines, "template_id", Settings(window_seconds=60)).collect()}
    got = {r.id: r.rate_z for r in spark.read.parquet(str(tmp_path / "r")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    from logtide.operators.alerts import cooled

    streams.drain(streams.cooled(read()), str(tmp_path / "a"), str(tmp_path / "ca"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "a")).collect()) == sorted(r.id for r in cooled(lines).collect())


def test_bad_records_are_set_apart(spark, tmp_path):
    raw = spark.createDataFrame([('{"line": "l", "source": "s"}',), ("junk",)], "value string")
    good, bad = streams.good_and_bad(logs.decode_messages(stream_of(spark, tmp_path, raw)))
    q = streams.drain(good, str(tmp_path / "g"), str(tmp_path / "cg"))
    streams.drain(bad, str(tmp_path / "b"), str(tmp_path / "cb"))
    assert spark.read.parquet(str(tmp_path / "g")).count() == 1 and spark.read.parquet(str(tmp_path / "b")).count() == 1
    assert streams.consumer_lag(q) == 0


def test_command_line(spark, capsys, monkeypatch, tmp_path):
    monkeypatch.setattr(cli, "session", lambda: spark)
    (tmp_path / "x.log").write_text("2023-08-01T12:00:00 ERROR payment failed\n\nall good\n")
    assert cli.main(["ingest", str(tmp_path / "x.log")]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["total_logs"] == 2


def test_http(spark):
    result = pipeline.run(logs.generate(spark, 300))
    s = cli.server(result, Settings(), "127.0.0.1", 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    get = lambda path: urllib.request.urlopen(f"http://127.0.0.1:{s.server_port}{path}", timeout=120).read().decode()
    assert json.loads(get("/healthz"))["status"] == "ok"
    assert json.loads(get("/health"))["total_logs"] == 300
    assert "logtide_logs_total 300" in get("/metrics") and isinstance(json.loads(get("/templates")), list)
    post = urllib.request.Request(f"http://127.0.0.1:{s.server_port}/ingest", json.dumps({"lines": ["FATAL: the disk is gone", " ", "fine"], "source": "t"}).encode(), method="POST")
    assert json.loads(urllib.request.urlopen(post, timeout=300).read()) == {"ingested": 3, "anomalies": 1}
    assert json.loads(get("/health"))["total_logs"] == 302
    bad = urllib.request.Request(f"http://127.0.0.1:{s.server_port}/ingest", b"{}", method="POST")
    with pytest.raises(urllib.error.HTTPError) as e:
        urllib.request.urlopen(bad, timeout=60)
    assert e.value.code == 422
    s.shutdown()


def test_lag_and_idle_state():
    behind = lambda n: SimpleNamespace(lastProgress={"sources": [{"metrics": {"avgOffsetsBehindLatest": str(n)}}]})
    assert streams.consumer_lag(behind(500)) == 500 and streams.consumer_lag(behind(0)) == 0
    removed = []
    gone, live = (SimpleNamespace(hasTimedOut=t, remove=lambda: removed.append(1)) for t in (True, False))
    assert streams._idle(gone, Settings()) and not streams._idle(live, Settings()) and removed == [1]


def test_store_by_setting(spark, tmp_path):
    for kind in ("parquet", "orc", "json"):
        store = sinks.open_store(spark, Settings(storage_format=kind, storage_path=f"{tmp_path}/{kind}"))
        store.upsert("templates", spark.createDataFrame([("t", 1)], "template_id string, last_seen int"))
        assert store.read("templates").count() == 1
    with pytest.raises(ConfigError):
        sinks.open_store(spark, Settings(storage_format="clay"))


def test_ids_tell_equal_lines_apart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("same\nsame\n")
    (tmp_path / "in" / "b.log").write_text("same\n")
    streams.drain(logs.stream_text(spark, str(tmp_path / "in")), str(tmp_path / "o"), str(tmp_path / "c"))
    for rows in (logs.read_text(spark, str(tmp_path / "in")), spark.read.parquet(str(tmp_path / "o"))):
        ids = [r.id for r in rows.collect()]
        assert len(set(ids)) == 3 and all(len(i) == 36 for i in ids)
