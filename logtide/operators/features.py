"""Arrival rates per template: tumbling windows, an EWMA baseline, and each line's z-score.

The z-score a line sees depends on windows before its own and on its place within it, so it has a
closed form over per-window baselines: no per-line state is carried.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import Settings


def window_index(ts: Column, seconds: int) -> Column:
    """Whole windows since the epoch, of a timestamp with or without zone (UTC session)."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000 * max(1, seconds))).cast("long")


def window_counts(lines: DataFrame, key: str, seconds: int) -> DataFrame:
    """``key, widx, count``."""
    return lines.groupBy(key, window_index(F.col("ts"), seconds).alias("widx")).count()


def ewma_step(state: tuple[float, float] | None, x: int, alpha: float) -> tuple[float, float]:
    """Mean and variance after one more window; the first sets (count, 1)."""
    if state is None:
        return float(x), 1.0
    d = x - state[0]
    return (1 - alpha) * state[0] + alpha * x, (1 - alpha) * (state[1] + alpha * d * d)


BASELINE = "widx long, n long, x long, mean double, var double, prev_mean double, prev_var double, first_z double"


#: What the next window of a key needs of its last one.
CARRIED = ("n", "x", "mean", "var", "prev_mean", "prev_var")


def baselines(counts: DataFrame, key: str, settings: Settings = Settings(), carried: DataFrame | None = None) -> DataFrame:
    """Per non-empty window: its number ``n`` and count ``x``, the state after it (``mean, var``) and
    before it (``prev_*``, null in the first), and the z-score that its first line sees.

    ``carried`` (``key`` and the columns ``CARRIED``, a row a key) holds each key's last window before these."""
    alpha = settings.ewma_alpha
    schema = f"{key} {counts.schema[key].dataType.simpleString()}, {BASELINE}"
    names = [key, *(f.split()[0] for f in BASELINE.split(", "))]
    kinds = [pa.int64()] * 3 + [pa.float64()] * 5
    had = F.lit(None).cast("struct<n: long, x: long, mean: double, var: double, prev_mean: double, prev_var: double>")
    counts = counts.withColumn("_had", had) if carried is None else counts.join(carried.select(key, F.struct(*CARRIED).alias("_had")), key, "left")

    def run(batches):
        now, n, x, state, before = object(), 0, 0, None, None
        for b in batches:
            rows = []
            for k, widx, count, had in zip(*(b.column(c).to_pylist() for c in (key, "widx", "count", "_had")), strict=True):
                if k != now:
                    now, n, state, before = k, 0, None, None
                    if had:
                        n, x, state = had["n"], had["x"], (had["mean"], had["var"])
                        before = None if had["prev_mean"] is None else (had["prev_mean"], had["prev_var"])
                # the first line of a window still sees the window before it as the current one
                first_z = (x - before[0]) / max(before[1], 1e-9) ** 0.5 if before else 0.0
                n, x, before, state = n + 1, count, state, ewma_step(state, count, alpha)
                rows.append((widx, n, x, *state, *(before or (None, None)), first_z))
            if rows:
                yield pa.record_batch([b.column(key), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    # one pass over each key's windows in order, many keys a task: what is held is one state
    ordered = counts.select(key, "widx", "count", "_had").repartition(key).sortWithinPartitions(key, "widx")
    return ordered.mapInArrow(run, schema)


def rate_z(lines: DataFrame, key: str, settings: Settings = Settings()) -> DataFrame:
    """Adds ``rate_z``, what the line's template shows just before the line is recorded.

    The running number within (key, window) is the only per-line order, so a hot template is
    dealt over its windows.
    """
    stamped = lines.withColumn("widx", window_index(F.col("ts"), settings.window_seconds))
    return scored(stamped, baselines(stamped.groupBy(key, "widx").count(), key, settings), key)


def scored(stamped: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Adds ``rate_z`` to lines with their ``widx``, from ``baselines`` of their windows."""
    base = windows.select(key, "widx", "n", "prev_mean", "prev_var", "first_z")
    j = F.row_number().over(Window.partitionBy(key, "widx").orderBy("ts", "id"))
    z = (
        F.when(F.col("_j") == 1, F.col("first_z"))
        .when(F.col("n") == 1, 0.0)
        .otherwise((F.col("_j") - 1 - F.col("prev_mean")) / F.sqrt(F.greatest("prev_var", F.lit(1e-9))))
    )
    return stamped.withColumn("_j", j).join(base, [key, "widx"]).withColumn("rate_z", z).drop("_j", "n", "prev_mean", "prev_var", "first_z")


def logs_per_second(lines: DataFrame, latest: int = 20_000) -> DataFrame:
    """One row ``logs_per_second``: the latest lines' number over their time span, 0 without a span."""
    tail = lines.select("ts", "id").orderBy(F.desc("ts"), F.desc("id")).limit(latest)
    span = (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 1e6
    return tail.agg(F.count("*").alias("n"), span.alias("span")).select(
        F.when((F.col("n") >= 2) & (F.col("span") > 0), F.col("n") / F.col("span")).otherwise(0.0).alias("logs_per_second")
    )
