"""Rates by event time on a stream equal the batch's, over shuffled arrival, restarts and replays."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from logtide.operators import features
from logtide.settings import Settings
from logtide.streaming import streams
from logtide.streaming.timed import RateStream

SCHEMA = "id string, ts timestamp, template_id string"
SETTINGS = Settings(window_seconds=60)


def shuffled(n=400, delay=500):
    """Lines in order of arrival: each comes up to ``delay`` seconds after its time."""
    r = np.random.default_rng(5)
    start = dt.datetime(2024, 1, 1)
    rows = [(f"{i:04d}", start + dt.timedelta(seconds=int(s)), f"t{int(k)}") for i, (s, k) in enumerate(zip(np.sort(r.integers(0, 6000, n)), r.integers(0, 5, n) ** 2 // 5, strict=True))]
    order = np.argsort([(x[1] - start).total_seconds() + d for x, d in zip(rows, r.integers(0, delay, n), strict=True)])
    return [rows[i] for i in order]


def rates_of(frame):
    return {r.id: round(r.rate_z, 9) for r in frame.collect()}


def test_rates_equal_batch_over_restart_and_replay(spark, tmp_path):
    rows, at = shuffled(), [0, 90, 170, 290, 400]
    assert rows != sorted(rows)
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    read = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    for part in ((0, 1), (2, 3)):  # a query that ends and another that goes on from its checkpoint
        for i in part:
            spark.createDataFrame(rows[at[i] : at[i + 1]], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        streams.drain_to(read(), RateStream(spark, state, settings=SETTINGS), str(tmp_path / "c"), "append")
    stream = RateStream(spark, state, settings=SETTINGS)
    before = rates_of(stream.rates())
    assert 0 < len(before) < 400 and stream.late().count() == 0  # the last windows are open
    stream(spark.createDataFrame(rows[at[3] :], SCHEMA), 3)  # the last batch runs again
    assert rates_of(stream.rates()) == before
    stream.finish()
    batch = spark.createDataFrame(rows, SCHEMA)
    want = rates_of(features.rate_z(batch, "template_id", SETTINGS))
    assert rates_of(stream.rates()) == want and len(want) == 400 and len(set(want.values())) > 20
    counts = features.window_counts(batch, "template_id", 60)
    place = lambda df, n: sorted((r.template_id, r.widx, r[n]) for r in df.collect())
    assert place(stream.windows(), "x") == place(counts, "count")
    assert len(list((tmp_path / "state" / "open").glob("batch=*"))) <= 3  # old states are gone


def test_late_lines_go_aside_and_change_nothing(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    row = lambda i, s, key="a": (i, None if s is None else start + dt.timedelta(seconds=s), key)
    stream = RateStream(spark, str(tmp_path / "s"), settings=SETTINGS, late_seconds=120)
    frame = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    stream(frame(), 0)
    stream(frame(row("1", 0), row("2", 30), row("3", 70), row("4", 239)), 1)  # watermark 119: the first window closes
    assert set(rates_of(stream.rates())) == {"1", "2"}
    stream(frame(row("5", 59), row("6", 60), row("7", None), row("8", 200, None)), 2)
    assert sorted(r.id for r in stream.late().collect()) == ["5", "7", "8"]
    stream(frame(), 3)
    assert set(rates_of(stream.rates())) == {"1", "2"}
    stream.finish()
    stream(frame(row("9", 241)), 4)  # the stream goes on: what ``finish`` closed is open again
    stream.finish()
    kept = frame(row("1", 0), row("2", 30), row("3", 70), row("4", 239), row("6", 60), row("9", 241))
    assert rates_of(stream.rates()) == rates_of(features.rate_z(kept, "template_id", SETTINGS))
    assert stream.late().count() == 3 and stream.windows().agg(F.sum("x")).first()[0] == 6
