"""Read models over judged lines, clusters and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.features import logs_per_second
from ..scratch import materialise
from ..settings import Settings


def rollup(lines: DataFrame, key: str = "template_id", text: str = "template") -> DataFrame:
    """Per template: text, counts, worst severity, last component and the span of event time."""
    place = F.struct("ts", "id")
    return lines.groupBy(key).agg(
        F.max_by(text, place).alias("template"),
        F.count("*").alias("count"),
        F.max("severity").alias("max_severity"),
        F.max_by("component", place).alias("component"),
        F.count_if("is_anomaly").alias("anomaly_count"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )


def top_templates(rolled: DataFrame, limit: int = 20, order: str = "count", key: str = "template_id") -> DataFrame:
    """Most frequent, or with ``order="anomaly"`` most anomalous, ties by first appearance."""
    by = "anomaly_count" if order == "anomaly" else "count"
    return rolled.orderBy(F.desc(by), "first_seen", key).limit(limit)


def recent(rows: DataFrame, limit: int = 50, cap: int = 5_000) -> DataFrame:
    """Newest first; never more than ``cap`` are shown."""
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(min(limit, cap))


def recent_anomalies(lines: DataFrame, limit: int = 50, settings: Settings = Settings()) -> DataFrame:
    return recent(lines.where("is_anomaly").select("id", "template_id", "severity", "component", "reasons", "ts"), limit, settings.anomaly_cap)


def recent_alerts(alerts: DataFrame, limit: int = 50, settings: Settings = Settings()) -> DataFrame:
    return recent(alerts, limit, settings.alert_cap)


def severity_histogram(lines: DataFrame) -> DataFrame:
    return lines.groupBy("severity").agg(F.count("*").alias("count"))


def top_components(lines: DataFrame, limit: int = 8) -> DataFrame:
    return lines.groupBy("component").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "component").limit(limit)


def totals(lines: DataFrame, key: str = "template_id") -> DataFrame:
    """One row: logs, anomalies, distinct templates and the share of errors."""
    return lines.agg(
        F.count("*").alias("total_logs"),
        F.count_if("is_anomaly").alias("anomalies"),
        F.count_distinct(key).alias("unique_templates"),
        F.coalesce(F.avg((F.col("severity") >= 4).cast("double")), F.lit(0.0)).alias("error_rate"),
    )


def health(lines: DataFrame, incidents: DataFrame | None = None, lag: int = 0, settings: Settings = Settings(), key: str = "template_id") -> DataFrame:
    """One row of the dashboard's headline; rounded for display."""
    return _shown(totals(lines, key), lines, incidents, lag, settings)


def _shown(counts: DataFrame, lines: DataFrame, incidents: DataFrame | None, lag: int, settings: Settings, *more: str) -> DataFrame:
    """The health record made of ``totals``, and more of its columns."""
    out = counts.join(F.broadcast(logs_per_second(lines, settings.throughput_window)))
    types = incidents.agg(F.count("*").alias("new_incident_types")) if incidents is not None else None
    out = out.join(F.broadcast(types)) if types is not None else out.withColumn("new_incident_types", F.lit(0).cast("long"))
    return out.select(
        F.round("logs_per_second", 1).alias("logs_per_second"),
        F.round("error_rate", 4).alias("error_rate"),
        "total_logs",
        "anomalies",
        "unique_templates",
        "new_incident_types",
        F.lit(lag).cast("long").alias("consumer_lag"),
        *more,
    )


def ingest_stats(lines: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row of counters: lines, anomalies, lines in new incidents, alerts."""
    counts = lines.agg(F.count("*").alias("total"), F.count_if("is_anomaly").alias("anomalies"), F.count_if("new_incident").alias("new_incidents"))
    return counts.join(F.broadcast(alerts.agg(F.count("*").alias("alerts"))))


def store_stats(rolled: DataFrame, anomalies: DataFrame, alerts: DataFrame) -> DataFrame:
    counts = [t.agg(F.count("*").alias(n)) for t, n in ((rolled, "templates"), (anomalies, "anomalies"), (alerts, "alerts"))]
    return counts[0].join(F.broadcast(counts[1])).join(F.broadcast(counts[2]))


def full_stats(lines: DataFrame, alerts: DataFrame, incidents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row: the health record, lines in new incidents, alerts, and the severity and top-component
    counts as arrays of (name, count).

    Lines are counted once, by severity, component and template; that table is written and summed up further."""
    by = lines.groupBy("severity", "component", "template_id").agg(F.count("*").alias("n"), F.count_if("is_anomaly").alias("anomalies"), F.count_if("new_incident").alias("new_incidents"))
    by = materialise(by, "counted")
    summed = lambda key: by.groupBy(key).agg(F.sum("n").alias("count"))
    listed = lambda rows, key, order: rows.agg(F.sort_array(F.collect_list(F.struct(order.alias("_o"), F.col(key).alias("name"), "count"))).alias("l"))
    severities = listed(summed("severity"), "severity", F.col("severity")).select(F.transform("l", lambda x: F.struct(x["name"].alias("name"), x["count"].alias("count"))).alias("severities"))
    top = summed("component").orderBy(F.desc("count"), "component").limit(8)
    components = listed(top, "component", -F.col("count")).select(F.transform("l", lambda x: F.struct(x["name"].alias("name"), x["count"].alias("count"))).alias("components"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    counts = by.agg(
        total("n").alias("total_logs"),
        total("anomalies").alias("anomalies"),
        F.count_distinct("template_id").alias("unique_templates"),
        F.coalesce(F.sum(F.when(F.col("severity") >= 4, F.col("n")).otherwise(0)) / F.sum("n"), F.lit(0.0)).alias("error_rate"),
        total("new_incidents").alias("new_incidents"),
    )
    shown = _shown(counts, lines, incidents, 0, settings, "new_incidents")
    return shown.join(F.broadcast(alerts.agg(F.count("*").alias("alerts")))).join(F.broadcast(severities)).join(F.broadcast(components))
