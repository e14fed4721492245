"""Alerts sent from tasks, with receipts: a batch that is run again sends nothing twice.

Receipts ``id, channel, receipt, day`` are written below ``sent/day=<day of the alert>``; a batch is joined
against the receipts of its own days and only what has none is sent.  Each task sends its alerts in
order, pager first, and returns their receipts; nothing passes through the driver.

Receipts are there once a batch's job has ended.  Where a task is lost in the middle of its sends, these are made again:
senders get the alert's id, which receivers should take as the key under which they drop repeats.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialise

#: Channels in the order in which an alert is sent to them.
ORDER = ("pagerduty", "slack")
RECEIPT = "id string, channel string, receipt string, day date"


class Outbox:
    """``senders()`` runs once in each task and returns a function a channel: alert (a Row) to receipt (text)."""

    def __init__(self, spark: SparkSession, path: str, senders: Callable[[], dict[str, Callable[[Row], str]]]):
        self.spark, self.path, self.senders = spark, f"{path.rstrip('/')}/sent", senders

    def receipts(self) -> DataFrame:
        """``id, channel, receipt, day`` of all that was sent."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(RECEIPT).parquet(self.path) if there else self.spark.createDataFrame([], RECEIPT)

    def send(self, alerts: DataFrame, _batch: int = 0) -> None:
        """Send a (micro-)batch of alerts ``id, template_id, channels, ts, ...``; also a ``foreachBatch`` function.

        A repeated row is sent once; channels without a sender are left out; an empty batch sends nothing.
        """
        senders, fields = self.senders, ["day", *alerts.columns]

        def run(batches):
            to = senders()
            for b in batches:
                sent = []
                for r in b.to_pylist():
                    alert, channel, day = Row(**{c: r[c] for c in fields[1:]}), r["_channel"], r["day"]
                    if channel in to:
                        sent.append((alert.id, channel, str(to[channel](alert)), day))
                if sent:
                    yield pa.record_batch([pa.array(c) for c in zip(*sent, strict=True)], ["id", "channel", "receipt", "day"])

        day = F.coalesce(F.to_date(F.col("ts").cast("timestamp")), F.lit("1970-01-01").cast("date"))
        batch = materialise(alerts.withColumn("day", day), "outbox")  # the plan that made it runs once
        first, last = batch.agg(F.min("day"), F.max("day")).first()
        if first is None:
            return
        known = self.receipts().where(F.col("day").between(first, last)).select(F.col("id").alias("_id"), F.col("channel").alias("_to"))
        due = batch.dropDuplicates(["id"]).withColumn("_channel", F.explode(F.array_distinct("channels")))
        due = due.join(known, (F.col("id") == F.col("_id")) & (F.col("_channel") == F.col("_to")), "left_anti")
        place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("_channel"))
        ordered = due.withColumn("_place", place).repartition("template_id").sortWithinPartitions("ts", "id", "_place")
        ordered.mapInArrow(run, RECEIPT).write.mode("append").partitionBy("day").parquet(self.path)
