"""Clusters and flags on a stream equal the batch's, over restarts and replays."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from logtide.operators import clustering
from logtide.settings import Settings
from logtide.streaming import streams
from logtide.streaming.incidents import IncidentStream

SCHEMA = "id string, ts timestamp, template_id string, template string, severity int, component string, is_new boolean, reasons array<string>"


def judged(n=240):
    r = np.random.default_rng(9)
    words = ["disk", "full", "on", "node", "timeout", "db", "refused", "peer", "login", "failed"]
    texts = [" ".join(r.choice(words, r.integers(2, 6))) for _ in range(25)] + ["???", ""]
    start, out, seen = dt.datetime(2024, 1, 1), [], set()
    for i in range(n):
        t = int(r.integers(0, len(texts)))
        severity = int(r.integers(1, 6))
        out.append((f"{i:05d}", start + dt.timedelta(seconds=40 * i), f"tpl_{t}", texts[t], severity, "api", t not in seen, ["rare_error"] if i % 7 == 0 else []))
        seen.add(t)
    return out


def batch_twin(spark, rows, settings):
    lines = spark.createDataFrame(rows, SCHEMA)
    is_gated = clustering.gate(F.col("severity"), F.col("is_new"), F.col("reasons"))
    gated = lines.where(is_gated)
    assigned = clustering.assign(gated, settings)
    by_template = assigned.join(clustering.promotions(gated, assigned, settings), "cluster_id", "left")
    full = clustering.flagged(lines.join(by_template, "template_id", "left"), is_gated, settings)
    lines = {r.id: (r.cluster_id, r.new_incident) for r in full.collect()}
    found = {r.id: (r.members, r.max_severity, r.first_seen, r.last_seen, r.promoted, r.new_incident) for r in clustering.clusters(gated, assigned, settings).collect()}
    return lines, found


def state_of(stream):
    lines = {r.id: (r.cluster_id, r.new_incident) for r in stream.lines().collect()}
    return lines, {r.cluster_id: (r.members, r.max_severity, r.since, r.last_seen, r.promoted, r.new_incident) for r in stream.clusters().collect()}


@pytest.mark.parametrize("block", [2, 2048])
def test_stream_equals_batch_and_survives_a_restart(spark, tmp_path, block):
    rows, settings = judged(), Settings(new_incident_seconds=3000)
    at = [0, 31, 60, 150, 240]
    source = str(tmp_path / "in")
    read = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    for part in ((0, 1), (2, 3)):  # a query that ends and another that goes on from its checkpoint
        for i in part:
            spark.createDataFrame(rows[at[i] : at[i + 1]], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        streams.drain_to(read(), IncidentStream(spark, str(tmp_path / "state"), settings, block), str(tmp_path / "c"), "append")
    stream = IncidentStream(spark, str(tmp_path / "state"), settings, block)
    want = batch_twin(spark, rows, settings)
    assert state_of(stream) == want
    assert len(want[1]) < 27 and any(new for _, new in want[0].values()) and not all(c[5] for c in want[1].values())
    stream(spark.createDataFrame(rows[at[3] :], SCHEMA), 3)  # the last batch runs again
    assert state_of(stream) == want


def test_idle_clusters_take_no_templates(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    row = lambda i, s, t: (str(i), start + dt.timedelta(seconds=s), t, "disk full on node", 4, "api", False, [])
    for idle, clusters in ((None, 1), (100, 2)):
        stream = IncidentStream(spark, str(tmp_path / f"s{idle}"), idle_seconds=idle)
        stream(spark.createDataFrame([row(1, 0, "a"), row(2, 50, "b")], SCHEMA), 0)
        stream(spark.createDataFrame([row(3, 1000, "c"), row(4, 1001, "a")], SCHEMA), 1)
        stream(spark.createDataFrame([], SCHEMA), 2)
        assert stream.clusters().count() == clusters and stream.lines().count() == 4
