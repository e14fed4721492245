"""Sinks: the store's tables, text, Kafka, and the metrics exposition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import Settings
from .store import TABLES, Store, open_store

__all__ = ["TABLES", "Store", "kafka_writer", "open_store", "prometheus", "to_messages", "write_lines"]

def write_lines(lines: DataFrame, path: str) -> None:
    """One line a record, as text files."""
    lines.select("line").write.text(path)


def to_messages(lines: DataFrame) -> DataFrame:
    """Bus records ``key, value``: keyed by source, JSON with the event time in seconds."""
    body = F.struct("line", "source", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return lines.select(F.col("source").alias("key"), F.to_json(body).alias("value"))


def kafka_writer(messages: DataFrame, settings: Settings = Settings(), topic: str | None = None):
    """A writer of bus records (stream or batch) to Kafka; needs the connector on the class path."""
    writer = messages.writeStream if messages.isStreaming else messages.write
    return writer.format("kafka").option("kafka.bootstrap.servers", settings.kafka_brokers).option("topic", topic or settings.topic)


def prometheus(health: DataFrame, severities: DataFrame, prefix: str = "logtide") -> DataFrame:
    """``at, line`` of the metrics exposition, in order, from one-row health and the histogram."""
    gauges = (
        ("logs_total", "counter", "total_logs"),
        ("logs_per_second", "gauge", "logs_per_second"),
        ("error_rate", "gauge", "error_rate"),
        ("anomalies_total", "counter", "anomalies"),
        ("unique_templates", "gauge", "unique_templates"),
        ("new_incident_types", "gauge", "new_incident_types"),
        ("consumer_lag", "gauge", "consumer_lag"),
    )
    rows = []
    for i, (name, kind, column) in enumerate(gauges):
        rows.append(F.struct(F.lit(2 * i).alias("at"), F.lit(f"# TYPE {prefix}_{name} {kind}").alias("line")))
        rows.append(F.struct(F.lit(2 * i + 1).alias("at"), F.concat(F.lit(f"{prefix}_{name} "), F.col(column).cast("string")).alias("line")))
    head = health.select(F.inline(F.array(*rows)))
    line = F.concat(F.lit(f'{prefix}_logs_by_severity{{severity="'), F.col("severity"), F.lit('"} '), F.col("count"))
    return head.union(severities.select((F.lit(100) + F.col("severity")).alias("at"), line.alias("line")))
