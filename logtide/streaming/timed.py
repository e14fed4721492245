"""Event-time windows and rates on a stream: windows close at the watermark, lines that come later go aside.

The state lies under one folder, a sub-folder a batch: ``clock`` (the greatest event time seen and the first window
that is still open), ``open`` (lines of open windows) and ``base`` (each key's last closed window with its
baseline).  The results do too: ``rates`` (each line of a closed window with its z-score), ``windows`` (closed windows)
and ``late``.  A batch reads the state of the one before it and overwrites its own, so a batch that a restarted
query runs again leaves what one run would have left; states that no batch can need any more are deleted.
However lines are shuffled within the watermark, they get the rates of the batch pipeline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features
from ..scratch import materialise
from ..settings import Settings


class RateStream:
    """A ``foreachBatch`` function over lines (``key``, ``id``, ``ts``).

    The watermark is the greatest event time seen less ``late_seconds``; a window closes with the batch
    that takes the watermark to its end.  A line of a closed window is late: no rate changes any more.
    Lines without a key or a time belong to no window and go aside with the late ones; an empty batch
    closes nothing.  Held are the lines of open windows and a row a key.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "template_id", settings: Settings = Settings(), late_seconds: int = 600):
        self.spark, self.path, self.key, self.settings, self.late_seconds = spark, path.rstrip("/"), key, settings, late_seconds
        self.lines_schema = f"{key} string, id string, ts timestamp, widx long"
        self.schemas = {
            "clock": "seen long, closed long",
            "open": self.lines_schema,
            "base": f"{key} string, n long, x long, mean double, var double, prev_mean double, prev_var double",
            "late": self.lines_schema,
            "windows": f"{key} string, {features.BASELINE}",
            "rates": f"{self.lines_schema}, rate_z double",
        }
        for table, schema in self.schemas.items():
            rows = [(None, -(1 << 62))] if table == "clock" else []
            spark.createDataFrame(rows, schema).write.mode("ignore").parquet(f"{self.path}/{table}/batch=-1")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        last, seen, closed = self._clock(batch_id)
        width = self.settings.window_seconds
        slim = batch.select(F.col(self.key).cast("string").alias(self.key), F.col("id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
        lines = materialise(slim.withColumn("widx", features.window_index(F.col("ts"), width)), "timed")
        newest = lines.agg(F.max(F.unix_micros("ts"))).first()[0]
        seen = max((t for t in (seen, newest) if t is not None), default=None)
        until = closed if seen is None else max(closed, (seen - 1_000_000 * self.late_seconds) // (1_000_000 * width))
        self._advance(lines, batch_id, last, seen, closed, until)

    def finish(self) -> None:
        """Close all windows that are open, as the batch after the last; should the stream go on, its next
        batch takes that one's place, and they are open again."""
        last, seen, closed = self._clock(1 << 62)
        until = self._state("open", last).agg(F.max("widx")).first()[0]
        if until is not None:
            self._advance(self.spark.createDataFrame([], self.lines_schema), last + 1, last, seen, closed, until + 1)

    def rates(self) -> DataFrame:
        """``key, id, ts, widx, rate_z`` of the lines of closed windows."""
        return self._all("rates")

    def windows(self) -> DataFrame:
        """Closed windows, as ``features.baselines`` gives them."""
        return self._all("windows")

    def late(self) -> DataFrame:
        """Lines that came after their window had closed, or belong to none."""
        return self._all("late")

    def _all(self, table: str) -> DataFrame:
        return self.spark.read.schema(f"{self.schemas[table]}, batch long").parquet(f"{self.path}/{table}").drop("batch")

    def _state(self, table: str, batch_id: int) -> DataFrame:
        return self.spark.read.schema(self.schemas[table]).parquet(f"{self.path}/{table}/batch={batch_id}")

    def _clock(self, before: int) -> tuple[int, int | None, int]:
        """The last batch before ``before``, the greatest event time by then and the first open window."""
        rows = self.spark.read.schema("seen long, closed long, batch long").parquet(f"{self.path}/clock")
        r = rows.where(F.col("batch") < before).orderBy(F.desc("batch")).first()
        return r.batch, r.seen, r.closed

    def _write(self, table: str, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={batch_id}")

    def _advance(self, lines: DataFrame, batch_id: int, last: int, seen: int | None, closed: int, until: int) -> None:
        key, at = self.key, F.col("widx")
        in_time = F.coalesce((at >= closed) & F.col(key).isNotNull(), F.lit(False))
        self._write("late", lines.where(~in_time), batch_id)
        held = materialise(self._state("open", last).union(lines.where(in_time)), "held")
        self._write("open", held.where(at >= until), batch_id)
        done, old = held.where(at < until), self._state("base", last)
        self._write("windows", features.baselines(done.groupBy(key, "widx").count(), key, self.settings, old), batch_id)
        windows = self._state("windows", batch_id)
        self._write("rates", features.scored(done, windows, key).select(key, "id", "ts", "widx", "rate_z"), batch_id)
        now = windows.groupBy(key).agg(F.max_by(F.struct(*features.CARRIED), "widx").alias("s")).select(key, "s.*")
        self._write("base", now.union(old.join(now, key, "left_anti")), batch_id)
        self._write("clock", self.spark.createDataFrame([(seen, until)], self.schemas["clock"]).coalesce(1), batch_id)
        self._forget(last)

    def _forget(self, last: int) -> None:
        """Delete the states before batch ``last``: only the newest batch can be run again."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        for table in ("clock", "open", "base"):
            root = fs_path(f"{self.path}/{table}")
            fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for f in fs.listStatus(root):
                name = f.getPath().getName()
                if name.startswith("batch=") and int(name[6:]) < last:
                    fs.delete(f.getPath(), True)
