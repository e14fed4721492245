"""The store: keyed tables whose upserts cost what they change.

``data/written=<version>/key_bucket=<b>/`` holds the rows of one upsert, dealt by a hash of the key;
``log/<version>`` holds one JSON line that names the live (written, bucket) folders.  An upsert adds a
delta to the buckets of its keys and reads none.  Reading merges: of a key the row written last.  A bucket
of over ``most`` deltas is merged into one, alone, and what no recent version names is deleted.

A version counts when its log line is there, so a lost executor or a failed job leaves the table as it
was; the second of two writers who take one number fails with ``StorageError`` and may try again.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, StorageError
from ..settings import Settings

#: The store's tables and their keys.
TABLES = {"templates": "template_id", "anomalies": "id", "alerts": "id"}
#: Versions whose folders stay, for readers that opened one before it was replaced.
KEPT = 3


def last_of(rows: DataFrame, key: str, *by: str) -> DataFrame:
    """One row a key: the last by the columns ``by`` (null: first), equal ones by a hash of the row."""
    order = F.struct(*by, F.xxhash64(F.to_json(F.struct(*sorted(rows.columns)))).alias("_tie"))
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*rows.columns), order).alias("_row")).select("_row.*")


class Store:
    """Tables under one folder, each of ``buckets`` buckets (fixed by a table's first upsert)."""

    def __init__(self, spark: SparkSession, path: str, fmt: str = "parquet", buckets: int = 64, most: int = 8):
        self.spark, self.path, self.fmt, self.buckets, self.most = spark, path.rstrip("/"), fmt, buckets, most

    def _at(self, *parts: str):
        """A path below the store and its file system."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        where, fs = self._at(*parts)
        found = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(n for n in found if not n.startswith((".", "_")))

    def _version(self, table: str, name: str) -> dict | None:
        line = self.spark.read.text(f"{self.path}/{table}/log/{name}").first()
        return json.loads(line.value) if line else None

    def _head(self, table: str) -> dict:
        """The newest complete version; ``next`` is the number that follows all that were begun."""
        names = self._names(table, "log")
        taken = int(names[-1]) if names else 0
        for name in reversed(names):
            if head := self._version(table, name):
                return {**head, "next": taken + 1}
        return {"buckets": self.buckets, "parts": [], "batches": {}, "next": taken + 1}

    def _commit(self, table: str, head: dict, parts: list) -> None:
        line = json.dumps({"buckets": head["buckets"], "parts": parts, "batches": head["batches"]})
        try:
            self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{self.path}/{table}/log/{head['next']:08d}")
        except AnalysisException as e:
            raise StorageError(f"{table}: another writer took version {head['next']}") from e

    def _write(self, table: str, rows: DataFrame, head: dict) -> list:
        """Write a delta; returns its (written, bucket) folders.  Large buckets are split into several files."""
        written = f"d{head['next']:08d}-{uuid.uuid4().hex[:8]}"
        bucket = F.pmod(F.xxhash64(F.col(TABLES[table]).cast("string")), F.lit(head["buckets"])).cast("int")
        dealt = rows.withColumn("key_bucket", bucket).hint("rebalance", "key_bucket")
        dealt.write.partitionBy("key_bucket").format(self.fmt).save(f"{self.path}/{table}/data/written={written}")
        return [[written, int(n.split("=")[1])] for n in self._names(table, "data", f"written={written}")]

    def _merged(self, table: str, parts: list) -> DataFrame:
        base = f"{self.path}/{table}/data"
        reader = self.spark.read.format(self.fmt).option("basePath", base).option("mergeSchema", "true")
        rows = reader.load([f"{base}/written={w}/key_bucket={b}" for w, b in parts])
        return last_of(rows, TABLES[table], "written").drop("written", "key_bucket")

    def read(self, table: str) -> DataFrame | None:
        """A table as of now, one row a key; None if nothing was ever written."""
        parts = self._head(table)["parts"]
        return self._merged(table, parts) if parts else None

    def upsert(self, table: str, rows: DataFrame, order: str = "last_seen", batch: tuple[str, int] | None = None) -> None:
        """Insert or replace by the table's key; among rows of one key the last by ``order`` wins.

        ``batch`` names a writer and the number of its batch: one that is there already is not written again.
        """
        head = self._head(table)
        if batch and head["batches"].get(batch[0], -1) >= batch[1]:
            return
        if batch:
            head["batches"][batch[0]] = batch[1]
        rows = last_of(rows, TABLES[table], *([order] if order in rows.columns else []))
        parts = head["parts"] + self._write(table, rows, head)
        self._commit(table, head, parts)
        crowded = [b for b, n in Counter(b for _, b in parts).items() if n > self.most]
        if crowded:
            self.compact(table, crowded)

    def compact(self, table: str, buckets: list[int] | None = None) -> None:
        """Merge the deltas of some buckets (all: None) into one each; other buckets are not read."""
        head = self._head(table)
        mine = [p for p in head["parts"] if buckets is None or p[1] in buckets]
        if mine:
            done = self._write(table, self._merged(table, mine), head)
            self._commit(table, head, [p for p in head["parts"] if p not in mine] + done)
            self.vacuum(table)

    def vacuum(self, table: str) -> None:
        """Delete old versions and the folders that none of the last ``KEPT`` names.  Folders newer than
        the last version may be another writer's, under way, and stay."""
        names = self._names(table, "log")
        live, newest = set(), ""
        for name in names[-KEPT:]:
            if version := self._version(table, name):
                live |= {tuple(p) for p in version["parts"]}
                newest = name
        for name in names[:-KEPT]:
            where, fs = self._at(table, "log", name)
            fs.delete(where, True)
        for folder in self._names(table, "data"):
            written = folder.split("=")[1]
            if written[1:9] > newest:
                continue
            inside = [n for n in self._names(table, "data", folder) if n.startswith("key_bucket=")]
            dead = [n for n in inside if (written, int(n.split("=")[1])) not in live]
            for parts in [(folder,)] if len(dead) == len(inside) else [(folder, n) for n in dead]:
                where, fs = self._at(table, "data", *parts)
                fs.delete(where, True)

    def save_batch(self, table: str, writer: str | None = None):
        """A ``foreachBatch`` function that upserts micro-batches; with the name of a ``writer`` (one a
        checkpoint) a batch that is run again is not written again."""
        return lambda rows, number: self.upsert(table, rows, batch=(writer, number) if writer else None)


def open_store(spark: SparkSession, settings: Settings = Settings()) -> Store:
    """The store that the settings name: Parquet, ORC or JSON tables under ``storage_path``."""
    if settings.storage_format not in ("parquet", "orc", "json"):
        raise ConfigError(f"no store of format {settings.storage_format!r}")
    return Store(spark, settings.storage_path, settings.storage_format)
