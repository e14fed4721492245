"""Read models over mined templates and incidents, on a fixture whose figures are counted by hand."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logtide.operators import clustering
from logtide.plans import pipeline, readmodels
from logtide.queries import QUERIES
from logtide.sources import logs


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Four FATAL lines a minute apart (an incident from the third on), five views, three sign-ups of different users."""
    at = str(tmp_path_factory.mktemp("sf"))
    when = lambda i: datetime(2024, 1, 1, 12) + timedelta(minutes=i)
    rows = [(97 * (i + 1), when(i), 1, "view", 1.0) for i in range(4)]
    rows += [(1 + i, when(i), 2, "view", 1.0) for i in range(5)]
    rows += [(21 + i, when(i), 10 + i, "signup", 1.0) for i in range(3)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{at}/events.parquet")
    return at


def test_health_counts_incidents(spark, sf):
    (r,) = QUERIES["pipeline_health"](spark, sf).collect()
    assert (r.total_logs, r.anomalies, r.unique_templates, r.new_incident_types, r.error_rate) == (12, 4, 3, 1, 0.3333)
    lines = {x.line for x in QUERIES["pipeline_prometheus"](spark, sf).collect()}
    assert {"logtide_new_incident_types 1", "logtide_unique_templates 3", 'logtide_logs_by_severity{severity="5"} 4'} <= lines


def test_stats_count_incidents_and_templates(spark, sf):
    (r,) = QUERIES["pipeline_ingest_stats"](spark, sf).collect()
    assert (r.total, r.anomalies, r.new_incidents, r.alerts) == (12, 4, 2, 1)
    (r,) = QUERIES["pipeline_store_stats"](spark, sf).collect()
    assert (r.templates, r.anomalies, r.alerts) == (3, 4, 1)


@pytest.mark.parametrize("name", ["pipeline_rollup", "pipeline_top_templates", "pipeline_top_anomalous_templates"])
def test_lists_are_of_mined_templates(spark, sf, name):
    rows = QUERIES[name](spark, sf).collect()
    assert sorted((r["count"], r.max_severity, r.anomaly_count) for r in rows) == [(3, 2, 0), (4, 5, 4), (5, 2, 0)]
    assert any(r.template == "<TIMESTAMP> INFO session authenticated for <*>" for r in rows)


def test_reasons(spark, sf):
    got = {r.id: r.reasons for r in QUERIES["pipeline_anomaly_reasons"](spark, sf).collect()}
    assert set(got) == {97, 194, 291, 388} and got[388] == "critical_severity"


def test_chain_without_raw_text(spark):
    """Raw and masked lines, which no registered query reads, can be left behind once templates are known; nothing else changes."""
    lines = logs.generate(spark, 400)
    full, slim = pipeline.run(lines), pipeline.run(lines, with_text=False)
    assert set(full.lines.columns) - set(slim.lines.columns) == {"line", "masked"}
    for a, b in ((full.lines.drop("line", "masked"), slim.lines), (full.clusters, slim.clusters), (full.alerts, slim.alerts)):
        assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))
    with_values = pipeline.judged(lines, with_variables=True, with_text=False)
    assert "variables" in with_values.columns and not {"line", "masked"} & set(with_values.columns)


def test_full_stats_count_lines_once(spark, tmp_path):
    """Of the five counts one reads the lines; a second reading is that of the latest lines' times."""
    result = pipeline.run(logs.generate(spark, 400))
    for name, rows in (("lines", result.lines.withColumn("probe", F.lit(1))), ("alerts", result.alerts), ("clusters", result.clusters)):
        rows.write.parquet(str(tmp_path / name))
    lines, sent, found = (spark.read.parquet(str(tmp_path / x)) for x in ("lines", "alerts", "clusters"))
    out = readmodels.full_stats(lines, sent, clustering.new_incidents(found))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in x and "probe" in x for x in plan.splitlines()) == 1
    row, health, counts = out.first(), readmodels.health(lines, clustering.new_incidents(found)).first(), readmodels.ingest_stats(lines, sent).first()
    assert all(row[c] == health[c] for c in health.asDict()) and (row.new_incidents, row.alerts) == (counts.new_incidents, counts.alerts)
    assert {x["name"]: x["count"] for x in row.severities} == dict(readmodels.severity_histogram(lines).collect())
    assert [(x["name"], x["count"]) for x in row.components] == [tuple(x) for x in readmodels.top_components(lines).collect()]
    none = readmodels.full_stats(lines.limit(0), sent.limit(0), clustering.new_incidents(found.limit(0))).first()
    assert (none.total_logs, none.anomalies, none.unique_templates, none.error_rate, none.new_incidents, none.severities) == (0, 0, 0, 0.0, 0, [])
