"""Incident clusters on a stream: each micro-batch of judged lines joins, or opens, clusters kept in tables.

The state lies under one folder, a sub-folder a batch: ``templates`` (each template with its vector and cluster,
once), ``clusters`` (running attributes of those a batch touched) and ``lines`` (its flagged lines).  A batch reads
what earlier batches wrote and overwrites what it wrote itself, so a batch that a restarted query runs again
leaves what one run would have left.  Lines in order of time give the clusters and flags of the batch pipeline;
lines that come late meet the leaders that are there already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import clustering
from ..scratch import materialise
from ..settings import Settings

TEMPLATES = "template_id string, at long, id string, embedding array<double>, cluster_id string, leads boolean, round int"
_PLACE = "struct<ts: timestamp, id: string>"
CLUSTERS = f"cluster_id string, members long, since timestamp, last_seen timestamp, max_severity int, sample_template string, promoted_from {_PLACE}"


class IncidentStream:
    """A ``foreachBatch`` function over judged lines (``id, ts, template_id, template, severity, component, is_new, reasons``).

    With ``idle_seconds`` clusters that had no line for so long, by event time, take no new templates.
    """

    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings(), block: int = 2048, idle_seconds: int | None = None):
        self.spark, self.path, self.settings, self.block, self.idle_seconds = spark, path.rstrip("/"), settings, block, idle_seconds
        for table, schema in (("templates", TEMPLATES), ("clusters", CLUSTERS)):
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.path}/{table}/batch=-1")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        lines = materialise(batch.withColumns({"id": F.col("id").cast("string"), "ts": F.col("ts").cast("timestamp")}), "batch")
        is_gated = clustering.gate(F.col("severity"), F.col("is_new"), F.col("reasons"))
        gated = lines.where(is_gated)
        self._write("templates", self._joined(gated, batch_id), batch_id)
        names = self._read("templates", TEMPLATES, batch_id + 1).select("template_id", "cluster_id")
        self._write("clusters", self._running(gated.join(names, "template_id"), batch_id), batch_id)
        since = self._latest(batch_id + 1).select("cluster_id", "promoted_from", "since")
        full = lines.join(names.join(since, "cluster_id", "left"), "template_id", "left")
        self._write("lines", clustering.flagged(full, is_gated, self.settings), batch_id)

    def clusters(self) -> DataFrame:
        """All clusters as they stand: attributes, ``promoted`` and ``new_incident``."""
        span = (F.unix_micros("last_seen") - F.unix_micros("since")) / 1e6
        marks = {"promoted": F.col("members") >= self.settings.min_cluster_size, "new_incident": span <= self.settings.new_incident_seconds}
        return self._latest(1 << 62).withColumns(marks)

    def lines(self) -> DataFrame:
        """The flagged lines of all batches."""
        return self.spark.read.parquet(f"{self.path}/lines").drop("batch")

    def _read(self, table: str, schema: str, before: int) -> DataFrame:
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{table}").where(F.col("batch") < before)

    def _write(self, table: str, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={batch_id}")

    def _latest(self, before: int) -> DataFrame:
        names = [c for c in StructType.fromDDL(CLUSTERS).names if c != "cluster_id"]
        state = self._read("clusters", CLUSTERS, before)
        return state.groupBy("cluster_id").agg(F.max_by(F.struct(*names), "batch").alias("s")).select("cluster_id", "s.*")

    def _leaders(self, batch_id: int, fresh: DataFrame) -> list[DataFrame]:
        """Earlier leaders in order of batch and round, in tables of at most ``block`` rows."""
        known = self._read("templates", TEMPLATES, batch_id).where("leads")
        if self.idle_seconds is not None:
            since = (fresh.agg(F.min("at")).first()[0] or 0) - self.idle_seconds * 1_000_000
            live = self._latest(batch_id).where(F.unix_micros("last_seen") >= since)
            known = known.join(live.select("cluster_id"), "cluster_id", "left_semi")
        sizes = known.groupBy("batch", "round").count().orderBy("batch", "round").collect()  # a row a batch and round
        blocks: list[list[tuple]] = []
        held = self.block
        for r in sizes:
            if held + r["count"] > self.block:
                blocks.append([])
                held = 0
            blocks[-1].append((r.batch, r["round"]))
            held += r["count"]
        place = F.struct("batch", "round")
        span = lambda x: F.struct(F.lit(x[0]).cast("long").alias("batch"), F.lit(x[1]).alias("round"))
        return [known.where((place >= span(b[0])) & (place <= span(b[-1]))) for b in blocks]

    def _joined(self, gated: DataFrame, batch_id: int) -> DataFrame:
        """Templates that no earlier batch had, with the cluster that each joins or opens."""
        threshold = self.settings.cluster_similarity
        known = self._read("templates", TEMPLATES, batch_id).select("template_id")
        fresh = materialise(clustering.embedded_templates(gated.join(known, "template_id", "left_anti"), self.settings), "fresh")
        old = self._leaders(batch_id, fresh)
        near = materialise(clustering.nearest_leader(fresh, old, any_order=True), "near")
        own = clustering.leaders(near.where(F.col("best") < threshold).drop("best", "leader"), threshold, self.block)
        near = clustering.nearest_leader(near.withColumn("best", F.when(F.col("best") < threshold, -2.0).otherwise(F.col("best"))), own)
        rounds = [t.select("template_id", F.lit(i).alias("round")) for i, t in enumerate(own)]
        number = rounds[0] if rounds else self.spark.createDataFrame([], "template_id string, round int")
        for r in rounds[1:]:
            number = number.union(r)
        found = near.join(number, "template_id", "left").withColumn("leads", F.col("leader") == F.col("template_id"))
        return found.select("template_id", "at", "id", "embedding", clustering.cluster_id(F.col("leader")).alias("cluster_id"), "leads", F.coalesce("round", F.lit(0)).alias("round"))

    def _running(self, lines: DataFrame, batch_id: int) -> DataFrame:
        """Attributes of the clusters that gated lines touch, with all that came before.

        Of each cluster Spark keeps ``min_cluster_size`` lines a task to find the one that promotes it.
        """
        place, least = F.struct("ts", "id"), self.settings.min_cluster_size
        now = lines.groupBy("cluster_id").agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.max("severity").alias("worst"), F.min_by("template", place).alias("sample"))
        early = Window.partitionBy("cluster_id").orderBy("ts", "id")
        nth = lines.select("cluster_id", "ts", "id").withColumn("nth", F.row_number().over(early)).where(F.col("nth") <= least)
        old = self._latest(batch_id)
        counted = nth.join(old.select("cluster_id", F.col("members").alias("had")), "cluster_id", "left")
        promoting = counted.groupBy("cluster_id").agg(F.max(F.when(F.col("nth") + F.coalesce("had", F.lit(0)) == least, place)).alias("promoting"))
        both = now.join(promoting, "cluster_id").join(old, "cluster_id", "left")
        return both.select(
            "cluster_id",
            (F.col("n") + F.coalesce("members", F.lit(0))).alias("members"),
            F.least("since", "lo").alias("since"),
            F.greatest("last_seen", "hi").alias("last_seen"),
            F.greatest("max_severity", "worst").alias("max_severity"),
            F.coalesce("sample_template", "sample").alias("sample_template"),
            F.coalesce("promoted_from", "promoting").alias("promoted_from"),
        )
