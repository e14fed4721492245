"""Open-set incident types: leader clustering of distinct, gated templates.

The embedding depends on the template alone, so templates (not lines) are clustered, weighted by
their gated lines and in order of first gated line.  A cluster's leader is its first template: a template
within the threshold of no earlier leader leads, any other joins the most similar earlier leader.

Leaders are found in rounds.  A round takes the first undecided templates, a block of bounded size, picks
the leaders among them, and every task drops the templates that these cover; so templates meet leaders
alone, never each other in pairs, and what a round holds in one place does not grow with the templates.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import hash_embed, l2_normalise
from ..scratch import materialise
from ..settings import Settings


def gate(severity: Column, is_new: Column, reasons: Column) -> Column:
    """Which lines are embedded and clustered at all."""
    return (F.size(reasons) > 0) | is_new | (severity >= 4)


def first_leaders(vectors: np.ndarray, similarity: float) -> list[int]:
    """Of unit vectors in order, those within the threshold of no earlier leader."""
    close = vectors @ vectors.T >= similarity
    covered, found = np.zeros(len(vectors), bool), []
    for i in range(len(vectors)):
        if not covered[i]:
            found.append(i)
            covered |= close[i]
    return found


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _parts(batch: pa.RecordBatch, rows: int = 512):
    """A batch in parts, whose cosines to a block of leaders are few MB."""
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def leaders(embedded: DataFrame, similarity: float, block: int = 2048) -> list[DataFrame]:
    """Written tables ``template_id, at, id, embedding`` of leaders, each of at most ``block`` rows, one a round and
    in order of (at, id).

    The driver holds one block.  A round decides at least one template and all that its leaders cover.
    """
    rest, out, order = embedded, [], ("at", "id", "template_id")
    while True:
        head = rest.orderBy(*order).limit(block).collect()
        if not head:
            return out
        found = [head[i] for i in first_leaders(np.array([r.embedding for r in head]), similarity)]
        out.append(materialise(embedded.sparkSession.createDataFrame(found, embedded.schema), "leaders"))
        if len(head) < block:
            return out
        centres, last = np.array([r.embedding for r in found]), head[-1]

        def uncovered(batches, centres=centres):
            for b in batches:
                for part in _parts(b):
                    near = (_matrix(part.column("embedding")) @ centres.T >= similarity).any(axis=1)
                    yield part.filter(pa.array(~near))

        later = F.struct(*order) > F.struct(*(F.lit(last[c]).cast(embedded.schema[c].dataType) for c in order))
        rest = materialise(rest.where(later).mapInArrow(uncovered, embedded.schema), "undecided")


def nearest_leader(rows: DataFrame, tables: list[DataFrame], any_order: bool = False) -> DataFrame:
    """Rows with ``best, leader``: the most similar leader that is no later than the row, the first of equals.

    Rows that have these two columns from other tables keep them unless a better leader comes.  With ``any_order`` leaders
    count wherever they stand, as those of an earlier batch do.  Each table of leaders is a broadcast of at most a block.
    """
    if "best" not in rows.columns:
        rows = rows.withColumns({"best": F.lit(-2.0), "leader": F.lit(None).cast("string")})
    out, schema = rows, rows.schema
    for first in range(0, len(tables), _TOGETHER):
        held = []
        for table in tables[first : first + _TOGETHER]:
            some = table.select("template_id", "at", "id", "embedding").orderBy("at", "id", "template_id").collect()
            if some:
                held.append((np.array([r.embedding for r in some]), [(r.at, r.id, r.template_id) for r in some]))

        def better(batches, held=held):
            for b in batches:
                for part in _parts(b):
                    for centres, places in held:
                        part = _better(part, centres, places, any_order)
                    yield part

        if held:
            out = out.mapInArrow(better, schema)
        if len(tables) - first > _TOGETHER:
            out = materialise(out, "nearest")
    return out


#: Tables of leaders that rows meet in one pass, of a Python worker a task.
_TOGETHER = 8


def _better(b: pa.RecordBatch, centres: np.ndarray, places: list[tuple], any_order: bool) -> pa.RecordBatch:
    """Rows with ``best, leader`` changed where one of some leaders, in order of their places, is more similar."""
    cosine = _matrix(b.column("embedding")) @ centres.T
    if not any_order:
        own = list(zip(*(b.column(c).to_pylist() for c in ("at", "id", "template_id")), strict=True))
        known = np.array([bisect_right(places, p) for p in own], np.int64)  # leaders up to the row itself
        cosine[np.arange(len(places)) >= known[:, None]] = -2.0
        for i, p in enumerate(own):
            if known[i] and places[known[i] - 1] == p:
                cosine[i, known[i] - 1] = 2.0  # a leader leads itself, even without words
    which, had = cosine.argmax(axis=1), b.column("best").to_numpy()
    top = cosine[np.arange(len(which)), which]
    new = top > had
    leader = [places[w][2] if n else x for w, n, x in zip(which.tolist(), new.tolist(), b.column("leader").to_pylist(), strict=True)]
    changed = {"best": pa.array(np.where(new, top, had)), "leader": pa.array(leader, pa.string())}
    return pa.record_batch([changed.get(c, b.column(c)) for c in b.schema.names], b.schema.names)


def cluster_id(leader: Column) -> Column:
    return F.concat(F.lit("cl_"), F.substring(F.md5(leader), 1, 12))


def embedded_templates(gated: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``template_id, at, id, embedding`` of the templates of gated lines, with the place of each one's first line."""
    templates = gated.groupBy("template_id").agg(F.min(F.struct("ts", "id", "template")).alias("first")).select("template_id", "first", F.col("first.template").alias("template"))
    vectors = hash_embed(templates, "template_id", "template", settings.embed_dim)
    at = F.unix_micros(F.col("first.ts").cast("timestamp")).alias("at")
    return templates.join(vectors, "template_id").select("template_id", at, F.col("first.id").alias("id"), "embedding")


def assign(gated: DataFrame, settings: Settings = Settings(), block: int = 2048) -> DataFrame:
    """``template_id, cluster_id, embedding`` for each template of gated lines (``template_id, template, ts, id``)."""
    embedded = materialise(embedded_templates(gated, settings), "embedded")
    return grouped(embedded, settings.cluster_similarity, block)


def grouped(embedded: DataFrame, similarity: float, block: int = 2048) -> DataFrame:
    """``template_id, cluster_id, embedding`` of a written table ``template_id, at, id, embedding`` (unit vectors), ordered by (at, id)."""
    found = nearest_leader(embedded, leaders(embedded, similarity, block))
    return found.select("template_id", cluster_id(F.col("leader")).alias("cluster_id"), "embedding")


def clusters(gated: DataFrame, assigned: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row a cluster with its attributes; ``promoted`` from ``min_cluster_size`` gated lines on."""
    lines = gated.join(assigned, "template_id")
    totals = lines.groupBy("cluster_id").agg(
        F.count("*").alias("members"),
        F.max("severity").alias("max_severity"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.min_by("template", F.struct("ts", "id")).alias("sample_template"),
    )
    modes = lines.groupBy("cluster_id", "component").agg(F.count("*").alias("n"), F.min(F.struct("ts", "id")).alias("first"))
    by_mode = Window.partitionBy("cluster_id").orderBy(F.desc("n"), "first")
    mode = modes.withColumn("_r", F.row_number().over(by_mode)).where("_r = 1").select("cluster_id", F.col("component").alias("dominant_component"))
    weights = lines.groupBy("cluster_id", "template_id").agg(F.count("*").alias("w"), F.first("embedding").alias("embedding"))
    parts = weights.select("cluster_id", "w", F.posexplode("embedding").alias("at", "x")).groupBy("cluster_id", "at").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("x"))
    centre = parts.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("at", "x")))["x"].alias("_mean"))
    seconds = (F.unix_micros(F.col("last_seen").cast("timestamp")) - F.unix_micros(F.col("first_seen").cast("timestamp"))) / 1e6
    out = totals.join(mode, "cluster_id").join(centre, "cluster_id")
    return out.select(
        F.col("cluster_id").alias("id"),
        F.concat(F.initcap("dominant_component"), F.lit(" incident")).alias("label"),
        l2_normalise(F.col("_mean")).alias("centroid"),
        "members",
        "dominant_component",
        "max_severity",
        "first_seen",
        "last_seen",
        (seconds <= settings.new_incident_seconds).alias("new_incident"),
        "sample_template",
        (F.col("members") >= settings.min_cluster_size).alias("promoted"),
    )


def new_incidents(found: DataFrame) -> DataFrame:
    """Promoted clusters whose lines all lie within the new-incident window."""
    return found.where("promoted and new_incident")


def promotions(gated: DataFrame, assigned: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``cluster_id, promoted_from`` (a struct of ts and id, null if never) ``, since``: the line that
    promotes a cluster and its first time.  Spark keeps ``min_cluster_size`` rows a cluster per task
    before it shuffles."""
    lines = gated.join(assigned.select("template_id", "cluster_id"), "template_id")
    early = Window.partitionBy("cluster_id").orderBy("ts", "id")
    first = lines.select("cluster_id", "ts", "id").withColumn("_n", F.row_number().over(early)).where(F.col("_n") <= settings.min_cluster_size)
    return first.groupBy("cluster_id").agg(
        F.max(F.when(F.col("_n") == settings.min_cluster_size, F.struct("ts", "id"))).alias("promoted_from"), F.min("ts").alias("since")
    )


def flagged(lines: DataFrame, is_gated: Column, settings: Settings = Settings()) -> DataFrame:
    """Lines with their template's cluster: ``cluster_id`` of gated lines alone, and ``new_incident``
    from the promoting line on, within the window."""
    since = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp"))) / 1e6
    flag = is_gated & (F.struct("ts", "id") >= F.col("promoted_from")) & (since <= settings.new_incident_seconds)
    return lines.withColumns({"new_incident": F.coalesce(flag, F.lit(False)), "cluster_id": F.when(is_gated, F.col("cluster_id"))}).drop("promoted_from", "since")
