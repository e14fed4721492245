"""Templates kept from batch to batch: only strings never seen before are folded, into the groups of their leaves.

Under one folder, a sub-folder a batch: ``strings`` (each distinct masked string once, with its leaf and its group's
number there), ``children`` (parse-tree children by level) and ``groups`` (the whole groups of the leaves that the batch
changed).  Groups are dealt into buckets of leaves, and a batch reads the buckets that its new strings fall into.
A batch reads what earlier ones wrote and overwrites its own, so it can be run again.  Batches in order of time give
the templates of one run over all lines.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialise
from ..settings import Settings
from .templates import CHILDREN, _descended, distinct_masked, fold, template_id

STRINGS = "masked string, n_tokens int, prefix array<string>, at int"
GROUPS = "n_tokens int, prefix array<string>, groups array<array<string>>, seeds array<string>"
_LEAF = ["n_tokens", "prefix"]


class TemplateStore:
    """Masked lines (``masked, ts, id``) in batches; ``templates`` of all strings so far."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings(), buckets: int = 64):
        self.spark, self.path, self.settings, self.buckets = spark, path.rstrip("/"), settings, buckets
        for table, schema in (("strings", STRINGS), ("children", CHILDREN)):
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.path}/{table}/batch=-1")
        spark.createDataFrame([], GROUPS).write.mode("ignore").parquet(f"{self.path}/groups/batch=-1/bucket=-1")

    def add(self, lines: DataFrame, batch_id: int) -> None:
        """Fold the strings of a batch that no earlier batch had; also a ``foreachBatch`` function."""
        known = self._read("strings", STRINGS, batch_id).select("masked")
        fresh = materialise(distinct_masked(lines).join(known, "masked", "left_anti"), "fresh")
        keyed, children = _descended(fresh, self.settings, self._read("children", CHILDREN, batch_id).drop("batch"))
        keyed = materialise(keyed.select("masked", "toks", *_LEAF, "first.ts", F.col("first.id").cast("string").alias("id"), self._bucket()), "keyed")
        self._write("children", children, batch_id)
        folded = materialise(self._folded(keyed, batch_id), "folded")
        self._write("strings", folded.select(*_LEAF, F.explode("assigned").alias("a")).select("a.masked", *_LEAF, "a.at"), batch_id)
        changed = folded.select(*_LEAF, "groups", "seeds", self._bucket()).repartition("bucket")
        changed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/groups/batch={batch_id}")

    def templates(self) -> DataFrame:
        """``masked, template, template_id, seed`` of every distinct string so far, as ``templates.mine`` gives them."""
        newest = self._newest(1 << 62)
        at = F.col("at")
        found = self._read("strings", STRINGS, 1 << 62).join(newest, _LEAF)
        found = found.select("masked", F.array_join(F.get("groups", at), " ").alias("template"), F.get("seeds", at).alias("seed"))
        return found.select("masked", "template", "seed", template_id(F.col("template")).alias("template_id"))

    def _bucket(self):
        return F.pmod(F.xxhash64(*_LEAF), F.lit(self.buckets)).cast("int").alias("bucket")

    def _read(self, table: str, schema: str, before: int) -> DataFrame:
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{table}").where(F.col("batch") < before)

    def _write(self, table: str, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={batch_id}")

    def _newest(self, before: int, buckets: list[int] | None = None) -> DataFrame:
        """Each leaf's groups as the last batch that changed it left them, of some buckets (partitions) alone."""
        rows = self.spark.read.schema(f"{GROUPS}, batch long, bucket int").parquet(f"{self.path}/groups").where((F.col("batch") < before) & (F.col("bucket") >= 0))
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        return rows.groupBy(*_LEAF).agg(F.max_by(F.struct("groups", "seeds"), "batch").alias("s")).select(*_LEAF, "s.*")

    def _folded(self, keyed: DataFrame, batch_id: int) -> DataFrame:
        threshold = self.settings.template_similarity

        words, placed = pa.list_(pa.string()), pa.struct([("masked", pa.string()), ("at", pa.int32())])
        schema = pa.schema([("n_tokens", pa.int32()), ("prefix", words), ("groups", pa.list_(words)), ("seeds", words), ("assigned", pa.list_(placed))])

        def run(new: pa.Table, old: pa.Table) -> pa.Table:
            rows = sorted(new.select(["ts", "id", "masked", "toks", "n_tokens", "prefix"]).to_pylist(), key=lambda r: (r["ts"], r["id"]))
            if not rows:
                return schema.empty_table()
            (had,) = old.select(["groups", "seeds"]).to_pylist() or [{"groups": [], "seeds": []}]
            assigned, groups = fold([r["toks"] for r in rows], threshold, had["groups"])
            seeds = had["seeds"]
            for at, r in zip(assigned, rows, strict=True):
                if at == len(seeds):
                    seeds.append(r["masked"])
            each = [{"masked": r["masked"], "at": a} for r, a in zip(rows, assigned, strict=True)]
            return pa.Table.from_pylist([{"n_tokens": rows[0]["n_tokens"], "prefix": rows[0]["prefix"], "groups": groups, "seeds": seeds, "assigned": each}], schema)

        buckets = [r.bucket for r in keyed.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        leaf = F.concat_ws(" ", F.col("n_tokens").cast("string"), F.to_json("prefix")).alias("leaf")
        old = self._newest(batch_id, buckets).select("*", leaf)
        return keyed.select("*", leaf).groupBy("leaf").cogroup(old.groupBy("leaf")).applyInArrow(run, f"{GROUPS}, assigned array<struct<masked: string, at: int>>")
