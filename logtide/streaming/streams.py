"""Structured Streaming versions of the pipeline's stages.

Stateless stages are the batch functions.  State lives per key: parse-tree leaf for templates,
template for rates and cooldown, and goes when a key has been idle for ``state_idle_seconds`` (0: never).  Inside a micro-batch a key's rows are taken in event-time order;
the leaf key is uncapped, as the fan-out cap needs to know all keys.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import masking
from ..functions.classify import component, severity
from ..operators.templates import bucket_prefix, fold, tokens
from ..settings import Settings


def _timeout(settings: Settings) -> str:
    """Idle keys expire only where it is asked for: Spark then runs batches without data for ever, which a
    stream that is to end must not do."""
    return GroupStateTimeout.ProcessingTimeTimeout if settings.state_idle_seconds else GroupStateTimeout.NoTimeout


def _idle(state: GroupState, settings: Settings) -> bool:
    """Whether a key's time is up; then its state goes."""
    if state.hasTimedOut:
        state.remove()
        return True
    return False


def classified(lines: DataFrame) -> DataFrame:
    """Masked and classified lines with a zoned event time."""
    line = F.col("line")
    return lines.withColumns({"ts": F.col("ts").cast("timestamp"), "masked": masking.mask(line), "severity": severity(line), "component": component(line)})


def window_counts(lines: DataFrame, key: str, settings: Settings = Settings(), late: str = "10 minutes") -> DataFrame:
    """Tumbling counts ``key, start, count``; rows later than the watermark are dropped."""
    w = F.window("ts", f"{settings.window_seconds} seconds")
    return lines.withWatermark("ts", late).groupBy(key, w).count().select(key, F.col("window.start").alias("start"), "count")


def with_templates(lines: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds ``group_id`` (of the seed, stable), ``template`` (as of this line), ``is_new`` and ``matched_count``."""
    toks = tokens(F.col("masked"))
    keyed = lines.withColumn("leaf", F.concat_ws(" ", F.size(toks).cast("string"), bucket_prefix(toks, settings.prefix_depth)))
    threshold = settings.template_similarity
    columns = ["id", "ts", "line", "source", "masked", "severity", "component"]
    schema = "id string, ts timestamp, line string, source string, masked string, severity int, component string, group_id string, template string, is_new boolean, matched_count long"

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if _idle(state, settings):
            return
        groups, seeds, counts = (list(x) for x in state.get) if state.exists else ([], [], [])
        groups = [list(g) for g in groups]
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "id"])
        out = []
        for masked in pdf["masked"]:
            before = len(groups)
            (at,), groups = fold([masked.split(" ") if masked else ["<empty>"]], threshold, groups)
            if len(groups) > before:
                seeds.append(masked)
                counts.append(0)
            counts[at] += 1
            out.append((seeds[at], " ".join(groups[at]), len(groups) > before, counts[at]))
        state.update((groups, seeds, counts))
        if settings.state_idle_seconds:
            state.setTimeoutDuration(1000 * settings.state_idle_seconds)
        yield pdf[columns].assign(group_id=[o[0] for o in out], template=[o[1] for o in out], is_new=[o[2] for o in out], matched_count=[o[3] for o in out])

    mined = keyed.withColumn("id", F.col("id").cast("string")).groupBy("leaf").applyInPandasWithState(
        run, schema, "groups array<array<string>>, seeds array<string>, counts array<long>", "append", _timeout(settings)
    )
    return mined.withColumn("group_id", F.concat(F.lit("grp_"), F.substring(F.md5("group_id"), 1, 12)))


def rates(lines: DataFrame, key: str, settings: Settings = Settings()) -> DataFrame:
    """``key, id, ts, rate_z``: the z-score before each line is recorded.

    Lines of a window before the current one count towards the current one but never re-roll it.
    """
    alpha, width = settings.ewma_alpha, settings.window_seconds

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if _idle(state, settings):
            return
        window, count, mean, var, rolled = state.get if state.exists else (-1, 0, 0.0, 1.0, False)
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "id"])
        out = []
        for ts in pdf["ts"]:
            out.append((count - mean) / max(var, 1e-9) ** 0.5 if rolled else 0.0)
            now = int(ts.timestamp() // width)
            if window < 0:
                window = now
            elif now > window:
                if rolled:
                    d = count - mean
                    mean, var = (1 - alpha) * mean + alpha * count, (1 - alpha) * (var + alpha * d * d)
                else:
                    mean, var, rolled = float(count), 1.0, True
                window, count = now, 0
            count += 1
        state.update((window, count, mean, var, rolled))
        if settings.state_idle_seconds:
            state.setTimeoutDuration(1000 * settings.state_idle_seconds)
        yield pd.DataFrame({key: k[0], "id": pdf["id"], "ts": pdf["ts"], "rate_z": out})

    slim = lines.select(key, F.col("id").cast("string").alias("id"), "ts")
    return slim.groupBy(key).applyInPandasWithState(
        run, f"{key} string, id string, ts timestamp, rate_z double", "window long, count long, mean double, var double, rolled boolean", "append", _timeout(settings)
    )


def cooled(candidates: DataFrame, settings: Settings = Settings(), key: str = "template_id") -> DataFrame:
    """``key, id, ts`` of candidates at least the cooldown after the key's last sent one."""
    gap = settings.cooldown_seconds

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if _idle(state, settings):
            return
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "id"])
        keep = []
        for ts in pdf["ts"]:
            at = ts.timestamp()
            keep.append(last is None or at - last >= gap)
            last = at if keep[-1] else last
        state.update((last,))
        if settings.state_idle_seconds:
            state.setTimeoutDuration(1000 * settings.state_idle_seconds)
        yield pdf[keep][[key, "id", "ts"]]

    slim = candidates.select(key, F.col("id").cast("string").alias("id"), "ts")
    return slim.groupBy(key).applyInPandasWithState(run, f"{key} string, id string, ts timestamp", "last double", "append", _timeout(settings))


def good_and_bad(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decoded messages apart from those that could not be read; counters come with the progress."""
    counted = messages.observe("worker", F.count("*").alias("consumed"), F.count_if("bad").alias("errors"))
    return counted.where("not bad").drop("bad"), messages.where("bad")


def consumer_lag(query: StreamingQuery) -> int:
    """Rows that the source holds beyond what the query has read, where the source reports it."""
    progress = query.lastProgress
    sources = progress["sources"] if progress else []
    return sum(int((s.get("metrics") or {}).get("avgOffsetsBehindLatest") or 0) for s in sources)


class _Ended(StreamingQueryListener):
    """Tells when a stream's end has been reported; all listeners have its progress then."""

    def __init__(self) -> None:
        self.runs: set[str] = set()
        self.news = threading.Condition()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self.news:
            self.runs.add(str(event.runId))
            self.news.notify_all()


def _run(stream: DataFrame, writer: DataStreamWriter, path: str | None = None, patience: float = 60) -> StreamingQuery:
    """Start a stream and wait for its end and (``patience`` seconds at most) for its listeners, who hear of it later."""
    streams, ended = stream.sparkSession.streams, _Ended()
    streams.addListener(ended)
    try:
        query = writer.trigger(availableNow=True).start(path)
        query.awaitTermination()
        with ended.news:
            ended.news.wait_for(lambda: str(query.runId) in ended.runs, patience)
    finally:
        streams.removeListener(ended)
    return query


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over all that is there and append it to a Parquet folder."""
    return _run(stream, stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint), path)


def drain_to(stream: DataFrame, write, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """The same through ``write(batch, batch_id)``, e.g. ``Store.save_batch`` or an alert dispatcher."""
    return _run(stream, stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint))
