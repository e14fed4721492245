"""The store of deltas, the text source with offsets, lag, and the outbox."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from logtide.errors import StorageError
from logtide.plans import readmodels
from logtide.sources import logs, text
from logtide.sources.store import KEPT, Store, last_of
from logtide.streaming import lag, streams
from logtide.streaming.outbox import Outbox

ROW = "template_id string, count int, last_seen int"


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_upserts_equal_a_dictionary(spark, tmp_path, fmt):
    r = random.Random(4)
    store, want = Store(spark, str(tmp_path), fmt, buckets=4, most=2), {}
    assert store.read("templates") is None
    for number in range(7):
        rows = [(f"t{r.randrange(12)}", r.randrange(1000), i) for i in range(5)]
        store.upsert("templates", spark.createDataFrame(rows, ROW))
        want |= {k: c for k, c, _ in rows}
        assert {x.template_id: x["count"] for x in store.read("templates").collect()} == want
        assert store.read("templates").count() == len(want)
    held = [n for n in os.listdir(tmp_path / "templates" / "log") if not n.startswith((".", "_"))]
    assert len(held) <= KEPT + 2  # compaction removes what is old
    live = store._head("templates")["parts"]
    assert max(sum(b == x for _, b in live) for x in range(4)) <= 3
    store.compact("templates")
    store.vacuum("templates")
    assert {x.template_id: x["count"] for x in store.read("templates").collect()} == want


def test_a_batch_touches_only_its_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=16)
    store.upsert("templates", spark.createDataFrame([(f"t{i}", i, i) for i in range(200)], ROW))
    before = store._head("templates")["parts"]
    files = {p: os.stat(p).st_mtime_ns for p in map(str, tmp_path.rglob("*.parquet"))}
    store.upsert("templates", spark.createDataFrame([("t7", 1, 1), ("t7", 2, None)], ROW))
    after = store._head("templates")["parts"]
    assert len(before) == 16 and len(after) == 17 and after[:16] == before
    assert all(os.stat(p).st_mtime_ns == t for p, t in files.items())
    assert store.read("templates").where("template_id = 't7'").first()["count"] == 1  # null is first in order
    store.upsert("templates", spark.createDataFrame([], ROW))
    store.upsert("templates", spark.createDataFrame([(None, 3, 3)], ROW))
    assert store.read("templates").count() == 201


def test_batches_again_failed_versions_and_two_writers(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=2)
    one = lambda n: spark.createDataFrame([("a", n, 1)], ROW)
    save = store.save_batch("templates", "w")
    save(one(1), 0), save(one(2), 1), save(one(9), 1)
    assert store.read("templates").first()["count"] == 2
    os.makedirs(tmp_path / "templates" / "log" / "00000003")  # a writer that was lost
    save(one(3), 2)
    assert store.read("templates").first()["count"] == 3
    head = store._head("templates")
    store._commit("templates", head, head["parts"])
    with pytest.raises(StorageError):
        store._commit("templates", head, head["parts"])


def test_rows_without_order_have_one_winner(spark):
    rows = [("k", i, None) for i in range(20)]
    got = {last_of(spark.createDataFrame(random.Random(s).sample(rows, 20), ROW).repartition(3), "template_id", "last_seen").first()["count"] for s in range(3)}
    assert len(got) == 1


def _files(folder):
    r = random.Random(8)
    os.makedirs(folder / "deep")
    data = {
        folder / "a.log": b"one\n\n  \ntwo \xff\r\nlast without end",
        folder / "deep" / "b.log": b"".join(b"x" * r.randrange(40) + b"\n" for _ in range(300)),
        folder / "c.log": b"",
        folder / "_hidden": b"no\n",
        folder / "d.txt": "é漢 same\n".encode() * 9 + b"z" * 3000 + b"\nend\n",
    }
    for p, b in data.items():
        p.write_bytes(b)
    return {p: b for p, b in data.items() if not p.name.startswith("_")}


def _plain(data):
    out = []
    for p, b in data.items():
        at = 0
        for x in b.split(b"\n"):
            line = x.removesuffix(b"\r")
            if line:
                out.append((str(p), at, line.decode("utf-8", "replace")))
            at += len(x) + 1
    return sorted(out)


@pytest.mark.parametrize("size,block", [(1 << 20, 1 << 20), (1, 3), (7, 2), (64, 5), (513, 64)])
def test_lines_by_any_split(tmp_path, size, block):
    data = _files(tmp_path / "in")
    path = str(tmp_path / "in")
    parts = text.cut([(n, 0, s) for n, s in text.sizes_of(path).items()], size)
    assert all(sum(e - s for _, s, e in p.ranges) <= size for p in parts)
    got = [tuple(r.values()) for p in parts for n, s, e in p.ranges for b in text.lines_of(path, n, s, e, block) for r in b.to_pylist()]
    assert sorted(got) == _plain(data)


def test_text_ids_are_the_same_each_time(spark, tmp_path):
    data = _files(tmp_path / "in")
    want = sorted(x[2] for x in _plain(data))
    read = lambda size, path=tmp_path / "in": sorted((r.id, r.line) for r in logs.read_text(spark, str(path), split_bytes=size).collect())
    first = read(1 << 20)
    assert sorted(x for _, x in first) == want and len({i for i, _ in first}) == len(first)
    assert read(100) == first
    assert len(read(1 << 20, tmp_path / "in" / "*.log")) == 4
    streams.drain(logs.stream_text(spark, str(tmp_path / "in")), str(tmp_path / "o"), str(tmp_path / "c"))
    streamed = {(r.id, r.line) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert streamed == set(first) - {x for x in first if x[1] == "last without end"}  # not ended yet
    with pytest.raises(Exception, match="nowhere"):
        logs.read_text(spark, str(tmp_path / "nowhere")).count()


def test_lag_of_a_text_stream(spark, tmp_path):
    folder, listener = tmp_path / "in", lag.Progress()
    folder.mkdir()
    (folder / "a.log").write_text("".join(f"line {i}\n" for i in range(500)))
    assert lag.unread(spark, str(folder)) == 500
    spark.streams.addListener(listener)
    try:
        query = streams.drain(logs.stream_text(spark, str(folder)), str(tmp_path / "o"), str(tmp_path / "c"))
        offset = query.lastProgress["sources"][0]["endOffset"]
        assert lag.unread(spark, str(folder), offset) == 0
        with open(folder / "a.log", "a") as f:
            f.write("more\n" * 20)
        (folder / "b.log").write_text("new\n")
        behind = lag.unread(spark, str(folder), offset)
        assert behind == 21
        lines = logs.generate(spark, 10).select("*", F.lit("t").alias("template_id"), F.lit(False).alias("is_anomaly"), F.lit(2).alias("severity"))
        assert readmodels.health(lines, lag=behind).first().consumer_lag == 21
        streams.drain(logs.stream_text(spark, str(folder)), str(tmp_path / "o"), str(tmp_path / "c"))
        assert spark.read.parquet(str(tmp_path / "o")).count() == 521
    finally:
        spark.streams.removeListener(listener)
    assert sum(listener.rows.values()) == 521
    assert lag.unread(spark, str(folder), next(iter(listener.offsets.values()))[0]) == 0


def test_drain_waits_for_slow_listeners(spark, tmp_path):
    class Slow(lag.Progress):
        def onQueryProgress(self, event):  # noqa: N802
            time.sleep(1.5)
            super().onQueryProgress(event)

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("line\n" * 30)
    for i, run in enumerate((lambda s, c: streams.drain(s, str(tmp_path / "o"), c), lambda s, c: streams.drain_to(s, lambda batch, _: batch.count(), c))):
        listener = Slow()
        spark.streams.addListener(listener)
        try:
            run(logs.stream_text(spark, str(tmp_path / "in")), str(tmp_path / f"c{i}"))
        finally:
            spark.streams.removeListener(listener)
        assert sum(listener.rows.values()) == 30


def test_outbox_sends_once(spark, tmp_path):
    said = str(tmp_path / "said")

    def senders():
        def to(channel):
            def send(alert):
                with open(said, "a") as f:
                    f.write(f"{channel} {alert.id}\n")
                return f"{channel}://{alert.id}"

            return send

        return {"pagerduty": to("pagerduty"), "slack": to("slack")}

    rows = [(f"a{i}", "t", ["slack", "pagerduty"] if i == 1 else ["slack", "fax"], f"2024-01-0{i + 1} 10:00:00") for i in range(4)]
    batch = spark.createDataFrame([*rows, rows[0]], "id string, template_id string, channels array<string>, ts string")
    box = Outbox(spark, str(tmp_path / "box"), senders)
    box.send(batch.limit(0))
    assert box.receipts().count() == 0
    box.send(batch.where("id <> 'a3'"), 0)
    box.send(batch.where("id <> 'a3'"), 0)
    box.send(batch, 1)
    lines = open(said).read().split("\n")[:-1]
    assert lines == ["slack a0", "pagerduty a1", "slack a1", "slack a2", "slack a3"]
    assert sorted((r.id, r.channel, r.receipt) for r in box.receipts().collect()) == sorted((x.split()[1], x.split()[0], "://".join(x.split())) for x in lines)
