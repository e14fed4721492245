"""Alert routing: channels, texts and the cooldown."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.classify import severity_name
from ..settings import Settings


def worthy(severity: Column, reasons: Column, new_incident: Column, settings: Settings = Settings()) -> Column:
    return (severity >= settings.alert_min_severity) | (F.size(reasons) > 0) | new_incident


def channels(severity: Column, reasons: Column, new_incident: Column) -> Column:
    """Pager and chat for the critical, chat for other errors and news, none else."""
    has = lambda r: F.array_contains(reasons, F.lit(r))
    chat, none = F.array(F.lit("slack")), F.array().cast("array<string>")
    return (
        F.when((severity >= 5) | has("critical_severity"), F.array(F.lit("pagerduty"), F.lit("slack")))
        .when(has("rate_spike") | has("rare_error") | (severity >= 4), chat)
        .when(new_incident | has("new_template"), chat)
        .otherwise(none)
    )


def title(component: Column, severity: Column, template: Column) -> Column:
    return F.concat(F.lit("["), component, F.lit("] "), severity_name(severity), F.lit(" — "), F.substring(template, 1, 80))


def detail(template_id: Column, severity: Column, reasons: Column, new_incident: Column) -> Column:
    listed = F.when(F.size(reasons) > 0, F.array_join(reasons, ",")).otherwise("threshold")
    return F.concat(F.lit("template="), template_id, F.lit(" severity="), severity_name(severity), F.lit(" reasons="), listed, F.when(new_incident, " NEW-INCIDENT").otherwise(""))


def cooled(candidates: DataFrame, settings: Settings = Settings(), key: str = "template_id") -> DataFrame:
    """The candidates that are sent: in order of (ts, id), each at least the cooldown after the key's
    last *sent* one.

    A candidate that follows the one before it by the cooldown or more is sent whatever came earlier,
    so a key's candidates fall into runs that are folded apart.  Time is cut into slots of the cooldown:
    such a gap can only lie between slots, so runs are found on each slot's first and last time, not on
    the candidates.  Only (key, ts, id) go to the fold; the rest is joined back on the few sent."""
    gap, gap_micros = settings.cooldown_seconds, int(settings.cooldown_seconds * 1_000_000)
    kinds = {c: candidates.schema[c].dataType.simpleString() for c in (key, "id")}

    def run(batches):
        now, until = None, 0
        for b in batches:
            at, kept, start = b.column("at").to_numpy(), [], 0
            keys, runs = b.column(key), b.column("run")
            opens = pc.or_(pc.not_equal(keys[1:], keys[:-1]), pc.not_equal(runs[1:], runs[:-1])).fill_null(True).to_numpy(zero_copy_only=False) if len(at) else []
            for end in [*(np.flatnonzero(opens) + 1).tolist(), len(at)] if len(at) else []:
                if (mine := (keys[start].as_py(), runs[start].as_py())) != now:
                    now, until = mine, at[start]
                while (start := start + int(np.searchsorted(at[start:end], until))) < end:
                    kept.append(start)
                    until = at[start] + gap_micros
                    start += 1
            yield b.select([key, "id"]).take(pa.array(kept, pa.int64()))

    if gap <= 0:
        return candidates
    slot = F.floor(F.col("at") / F.lit(gap * 1e6)).cast("long")
    slim = candidates.select(key, "id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).withColumn("slot", slot)
    spans = slim.groupBy(key, "slot").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    before = Window.partitionBy(key).orderBy("slot")
    opens = F.coalesce((F.col("lo") - F.lag("hi").over(before) >= gap * 1e6).cast("int"), F.lit(1))
    runs = spans.withColumn("opens", opens).withColumn("run", F.sum("opens").over(before)).select(key, "slot", "run")
    # one pass over runs in order, many a task: what is held is the time up to which candidates are silent
    ordered = slim.join(runs, [key, "slot"]).select(key, "run", "at", "id").repartition(key, "run").sortWithinPartitions(key, "run", "at", "id")
    sent = ordered.mapInArrow(run, f"{key} {kinds[key]}, id {kinds['id']}")
    return candidates.join(sent, [key, "id"], "left_semi")


def alerts(lines: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Alerts ``id, template_id, severity, title, detail, channels, ts`` of judged lines
    (``template_id, template, severity, component, reasons, new_incident, ts, id``)."""
    routed = lines.where(worthy(F.col("severity"), F.col("reasons"), F.col("new_incident"), settings))
    routed = routed.withColumn("channels", channels(F.col("severity"), F.col("reasons"), F.col("new_incident"))).where(F.size("channels") > 0)
    return cooled(routed, settings).select(
        F.concat(F.lit("alert_"), F.substring(F.md5(F.concat_ws(":", "template_id", "id")), 1, 12)).alias("id"),
        "template_id",
        "severity",
        title(F.col("component"), F.col("severity"), F.col("template")).alias("title"),
        detail(F.col("template_id"), F.col("severity"), F.col("reasons"), F.col("new_incident")).alias("detail"),
        "channels",
        "ts",
    )


class Recorder:
    """A dispatcher for tests: keeps what it is given and names it ``<scheme>://<alert id>``."""

    def __init__(self, scheme: str):
        self.scheme, self.sent = scheme, []

    def __call__(self, alert: Row) -> str:
        self.sent.append(alert)
        return f"{self.scheme}://{alert.id}"


def dispatch(batch: DataFrame, pager: Callable[[Row], str], chat: Callable[[Row], str]) -> int:
    """Send a (micro-)batch of alerts, pager first; streams a bounded batch through the driver."""
    n = 0
    for alert in batch.orderBy("ts", "id").toLocalIterator():
        if "pagerduty" in alert.channels:
            pager(alert)
        if "slack" in alert.channels:
            chat(alert)
        n += 1
    return n
