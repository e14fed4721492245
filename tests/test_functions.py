"""Masking, extraction, classification, vectors, anomaly rules and alert texts on known inputs."""

import math

import pytest
from pyspark.sql import functions as F

from logtide.functions import classify, masking, vectors
from logtide.operators import alerts, anomaly, templates
from logtide.settings import Settings
from logtide.sources.logs import partition_of


def one(spark, value, make):
    kind = "string" if isinstance(value, str) else "array<double>"
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("2023-08-01T12:04:11Z connection to 10.0.4.7:8080 failed after 3 retries (err=0x1F)", "<TIMESTAMP> connection to <IP>:<PORT> failed after <NUM> retries (err=<HEX>)"),
        ('10.1.2.3 - - [2023-08-01T12:00:00] "GET /api/v1/users/7 HTTP/1.1" 200 512', '<IP> - - [<TIMESTAMP>] "GET <PATH> HTTP/<NUM>" <NUM> <NUM>'),
        ("took 45ms and 3.5GB by a.b@c.org", "took <DURATION> and <SIZE> by <EMAIL>"),
        ("total-vm:12kB user_9", "total-vm:12kB user_9"),
        ("id 0123456789ab mac aa:bb:cc:dd:ee:ff", "id <HEX> mac <MAC>"),
        ("session 00000000-0000-4000-8000-000000000001 at https://x.y/z?q=1 'q'", "session <UUID> at <URL> 'q'"),
        ("  a \t b  ", "a b"),
        ("", ""),
    ],
)
def test_mask(spark, line, want):
    assert one(spark, line, masking.mask) == want


def test_extract(spark):
    got = one(spark, "user from 10.0.0.5 at 2023-08-01T00:00:00 took 45ms", masking.extract_variables)
    assert got == {"TIMESTAMP": ["2023-08-01T00:00:00"], "IP": ["10.0.0.5"], "DURATION": ["45ms"]}
    assert one(spark, "nothing here", masking.extract_variables) == {}


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("2023 ERROR deadlock detected on relation orders", (4, "postgres")),
        ("kernel: Out of memory: Killed process", (5, "kernel")),
        ("INFO request handled", (2, "nginx")),
        ("EMERG x", (5, "other")),
        ("WARNING: slow", (3, "other")),
        ("connection refused by peer", (4, "network")),
        ("retrying", (3, "other")),
        ("", (2, "other")),
    ],
)
def test_classify(spark, line, want):
    got = one(spark, line, lambda c: F.struct(classify.severity(c).alias("s"), classify.component(c).alias("c")))
    assert (got.s, got.c) == want


def test_severity_names(spark):
    assert one(spark, " Fatal ", classify.severity_of_name) == 5 and one(spark, "bogus", classify.severity_of_name) == 2
    assert isinstance(classify.classifier("onnx", ""), classify.LexicalClassifier)
    assert isinstance(classify.classifier("onnx", "m.onnx"), classify.OnnxClassifier)


@pytest.mark.parametrize(
    ("severity", "new", "rare", "z", "want"),
    [
        (5, False, False, 0.0, ["critical_severity"]),
        (4, True, True, 0.0, ["new_template", "rare_error"]),
        (4, False, True, 0.0, ["rare_error"]),
        (2, False, False, 5.0, ["rate_spike"]),
        (2, False, False, 0.0, []),
    ],
)
def test_reasons(spark, severity, new, rare, z, want):
    row = spark.createDataFrame([(severity, new, rare, z)], "s int, n boolean, r boolean, z double")
    assert row.select(anomaly.reasons(F.col("s"), F.col("n"), F.col("r"), F.col("z")).alias("y")).first().y == want


@pytest.mark.parametrize(
    ("severity", "reasons", "new", "want"),
    [
        (5, [], False, ["pagerduty", "slack"]),
        (2, ["critical_severity"], False, ["pagerduty", "slack"]),
        (4, [], False, ["slack"]),
        (2, ["rate_spike"], False, ["slack"]),
        (2, [], True, ["slack"]),
        (3, [], False, []),
    ],
)
def test_channels(spark, severity, reasons, new, want):
    row = spark.createDataFrame([(severity, reasons, new)], "s int, r array<string>, n boolean")
    assert row.select(alerts.channels(F.col("s"), F.col("r"), F.col("n")).alias("y")).first().y == want


def test_alert_texts(spark):
    row = spark.createDataFrame([("api", 4, "t" * 90, "tpl_1", [], True)], "c string, s int, t string, i string, r array<string>, n boolean")
    got = row.select(alerts.title(F.col("c"), F.col("s"), F.col("t")).alias("a"), alerts.detail(F.col("i"), F.col("s"), F.col("r"), F.col("n")).alias("b")).first()
    assert got.a == "[api] ERROR — " + "t" * 80
    assert got.b == "template=tpl_1 severity=ERROR reasons=threshold NEW-INCIDENT"


def test_vectors(spark):
    texts = spark.createDataFrame([(1, "connection to host failed"), (2, "connection to peer failed"), (3, "background save done"), (4, "")], "k int, t string")
    got = {r.k: r.embedding for r in vectors.hash_embed(texts, "k", "t").collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(got[a], got[b], strict=True))
    assert all(abs(dot(k, k) - 1) < 1e-9 for k in (1, 2, 3)) and got[4] == [0.0] * 64
    assert dot(1, 2) > dot(1, 3)
    assert one(spark, "Saw <IP> x9!", vectors.words) == ["saw", "<ip>", "x9", "!"]
    assert one(spark, [3.0, 4.0], vectors.l2_normalise) == [0.6, 0.8]
    near = vectors.nearest(spark.createDataFrame([(1, [1.0, 0.0])], "i int, v array<double>"), "v", spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0])], "n string, c array<double>"), "n", "c").first()
    assert near.nearest == "a" and near.similarity == 1.0


def test_similarity_and_tokens(spark):
    rows = spark.createDataFrame([("a b <*>", "a c d")], "l string, r string")
    got = rows.select(templates.similarity(templates.tokens(F.col("l")), templates.tokens(F.col("r"))).alias("y")).first().y
    assert math.isclose(got, 2 / 3)
    assert one(spark, "", templates.tokens) == ["<empty>"]
    assert one(spark, "a b9 c d e", lambda c: templates.bucket_prefix(templates.tokens(c))) == ["a", "<*>", "c", "d"]


def test_partition_is_stable(spark):
    assert one(spark, "hostA", partition_of) == one(spark, "hostA", partition_of) in range(8)


def test_settings():
    assert Settings.from_env({"LOGTIDE_WINDOW_SECONDS": "5", "LOGTIDE_RATE_SPIKE_Z": "2.5"}) == Settings(window_seconds=5, rate_spike_z=2.5)
    from logtide.errors import ConfigError

    for bad in ({"LOGTIDE_WINDOW_SECONDS": "0"}, {"LOGTIDE_PARTITIONS": "many"}):
        with pytest.raises(ConfigError):
            Settings.from_env(bad)
