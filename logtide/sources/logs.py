"""Log sources: tables, text, HTTP-style batches, bus messages, Kafka, and a synthetic generator."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..settings import Settings
from .text import NAME, TextSource

#: The message body derived from an ``events`` row; the same text in Spark and DuckDB.
BODY = """CASE
  WHEN event_id % 97 = 0 THEN concat('FATAL: could not write to file base/', event_id, ': No space left on device')
  WHEN event_id % 61 = 0 THEN concat('WARNING: checkpoint occurring too frequently (', event_id % 60, ' seconds apart)')
  WHEN event_type = 'error' THEN concat('ERROR connection to 10.0.', user_id % 256, '.', event_id % 254 + 1, ':', 1024 + event_id % 60000, ' timed out after ', cast(round(value*100) as bigint), 'ms')
  WHEN event_type = 'click' THEN concat('INFO request handled in ', cast(round(value*100) as bigint), 'ms status=200')
  WHEN event_type = 'view' THEN concat('connection from 10.1.', user_id % 256, '.', event_id % 254 + 1, ':', 1024 + event_id % 60000, ' established on eth0')
  WHEN event_type = 'signup' THEN concat('INFO session authenticated for user_', user_id)
  ELSE concat('LOG: duration: ', cast(round(value*100) as bigint), 'ms statement: SELECT * FROM orders WHERE id=', event_id) END"""
LOGS_SQL = f"SELECT event_id AS id, ts, concat('svc-', user_id % 8) AS source, concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'), ' ', {BODY}) AS line FROM events"


#: Lines a task is given at most: masking and classifying cost some 0.1 to 0.5 ms a line.
TASK_LINES = 200_000


def dealt(table: DataFrame, lines: int = TASK_LINES) -> DataFrame:
    """A Parquet table dealt over the cores, and into tasks of about ``lines`` rows, where its files give fewer splits,
    as what follows costs far more than this exchange; a table of enough splits stays as it is.  Rows are
    counted from the files' footers."""
    if table.isStreaming:
        return table
    tasks = max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // lines))
    return table if table.rdd.getNumPartitions() >= tasks else table.repartition(tasks)


def logs_of_events(events: DataFrame) -> DataFrame:
    """``id, ts, source, line`` made of an ``events`` table (the tests' stand-in for a log table)."""
    events = dealt(events.select("event_id", "ts", "user_id", "event_type", "value"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return events.select(
        F.col("event_id").alias("id"), "ts", F.concat(F.lit("svc-"), F.col("user_id") % 8).alias("source"), F.concat(stamp, F.lit(" "), F.expr(BODY)).alias("line")
    )


def stamped(lines: DataFrame, source: Column | str = "unknown", ts: Column | None = None) -> DataFrame:
    """Raw records of a ``line`` column: a 128-bit id, arrival time now unless given.

    Lines read from files (``file, offset``) have ids of content and place, the same at each reading.  Others are
    numbered as they come, so what joins records writes them first (``pipeline.judged``)."""
    source = F.lit(source) if isinstance(source, str) else source
    place = ["file", "offset"] if {"file", "offset"} <= set(lines.columns) else [F.uuid() if lines.isStreaming else F.monotonically_increasing_id()]
    ident = F.concat(F.lit("log_"), F.md5(F.concat_ws(":", *place, "line")))
    return lines.select(ident.alias("id"), "line", source.alias("source"), (F.current_timestamp() if ts is None else ts).alias("ts"))


def from_lines(spark: SparkSession, lines: Iterable[str], source: str = "unknown") -> DataFrame:
    """One or many lines from memory."""
    return stamped(spark.createDataFrame([(x,) for x in lines], "line string"), source)


def read_text(spark: SparkSession, path: str, source: str = "file", split_bytes: int = 128 << 20) -> DataFrame:
    """Text files (a file, a folder, wildcards), one line a record; empty lines are skipped, invalid UTF-8 is
    replaced; ids are of file, byte offset and content, the same at each reading and split size."""
    spark.dataSource.register(TextSource)
    return stamped(spark.read.format(NAME).option("splitBytes", split_bytes).load(path), source)


def stream_text(spark: SparkSession, path: str, source: str = "file", split_bytes: int = 128 << 20) -> DataFrame:
    """The same as a stream that follows files as they appear and grow; a line is read once it has ended."""
    spark.dataSource.register(TextSource)
    return stamped(spark.readStream.format(NAME).option("splitBytes", split_bytes).load(path), source)


def from_batches(batches: DataFrame) -> DataFrame:
    """HTTP-style batches (``source, lines[]``): blank lines are skipped, the source defaults to api."""
    lines = batches.select(F.coalesce("source", F.lit("api")).alias("_source"), F.explode("lines").alias("line")).where(F.trim("line") != "")
    return stamped(lines, F.col("_source"))


def accepted(batches: DataFrame) -> DataFrame:
    """One row ``ingested``: the lines that batches carry, blank ones too."""
    return batches.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0)).cast("long").alias("ingested"))


def decode_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """Bus messages (JSON ``line, source, ts``) with the defaults of missing parts; ``bad`` marks
    values that are no JSON object, which carry an empty line instead of stopping the job."""
    parsed = F.from_json(F.col(value).cast("string"), schema.MESSAGE)
    text = F.col(value).cast("string")
    return messages.withColumn("_m", parsed).select(
        F.coalesce("_m.line", F.lit("")).alias("line"),
        F.coalesce("_m.source", F.lit("unknown")).alias("source"),
        F.coalesce(F.timestamp_micros(F.round(F.nullif(F.col("_m.ts"), F.lit(0.0)) * 1e6).cast("long")), F.current_timestamp()).alias("ts"),
        (F.get_json_object(text, "$").isNull() | ~F.ltrim(text).startswith("{")).alias("bad"),
    )


def kafka(spark: SparkSession, settings: Settings = Settings(), most: int | None = None) -> DataFrame:
    """A Kafka stream of messages (needs the connector on the class path)."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", settings.kafka_brokers).option("subscribe", settings.topic)
    return decode_messages(reader.option("maxOffsetsPerTrigger", most or settings.batch_size).load())


def partition_of(key: Column, partitions: int = 8) -> Column:
    """The bus partition of a key: the first four bytes of its MD5, big-endian, modulo."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % partitions).cast("int")


#: Message patterns of the generator by category, with their sources.
NORMAL = (
    ("nginx", '{ip} - - [{ts}] "GET /api/v1/users/{n} HTTP/1.1" 200 {sz}'),
    ("nginx", '{ip} - - [{ts}] "POST /api/v1/orders HTTP/1.1" 201 {sz}'),
    ("nginx", '{ip} - - [{ts}] "GET /api/v1/items/{n} HTTP/1.1" 404 {sz}'),
    ("postgres", "{ts} LOG: duration: {ms}ms statement: SELECT * FROM orders WHERE id={n}"),
    ("postgres", "{ts} WARNING: checkpoint occurring too frequently ({n} seconds apart)"),
    ("kafka", "{ts} INFO [Consumer group-{n}] partition {n} offset committed at {n}"),
    ("redis", "{ts} * Background saving terminated with success, {n} keys"),
    ("kubelet", "{ts} kubelet: pod default/app-{n} readiness probe succeeded"),
    ("auth", "{ts} INFO session {uuid} authenticated for user_{n}"),
    ("api", "{ts} INFO request {uuid} handled in {ms}ms status=200"),
    ("network", "{ts} connection from {ip}:{port} established on eth0"),
)
ERRORS = (
    ("postgres", "{ts} ERROR: deadlock detected on relation orders pid {n}"),
    ("network", "{ts} ERROR connection to {ip}:{port} timed out after {ms}ms"),
    ("nginx", '{ip} - - [{ts}] "GET /api/v1/checkout HTTP/1.1" 503 {sz} upstream timed out'),
    ("auth", "{ts} ERROR unauthorized access attempt from {ip} token={uuid}"),
    ("kafka", "{ts} ERROR [Broker {n}] partition {n} under-replicated ISR shrank"),
    ("kubelet", "{ts} kubelet: pod default/app-{n} liveness probe failed with err={hex}"),
)
CRITICAL = (
    ("kernel", "{ts} kernel: Out of memory: Killed process {n} (java) total-vm:{n}kB"),
    ("kernel", "{ts} kernel: BUG: unable to handle kernel NULL pointer at {hex}"),
    ("postgres", "{ts} FATAL: could not write to file base/{n}: No space left on device"),
)
INCIDENT = (("payments", "{ts} ERROR payment-gateway settlement failed txn={uuid} code=GW-{n} retry exhausted"),)
START = 1690891200


def generate(
    spark: SparkSession, n: int, seed: int = 7, error_ratio: float = 0.12, critical_ratio: float = 0.01, inject_incident_at: float = 0.7, incident_burst: int = 40
) -> DataFrame:
    """``n`` synthetic lines ``id, line, source, ts``, the same for a seed however they are dealt.

    Every draw is a hash of (id, seed, purpose).  A burst of one new error pattern stands at
    ``inject_incident_at`` of the way; all ``{n}`` of a line are equal; lines are 0.25 s apart.
    """
    def draw(tag: str, below: int) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws(":", "id", F.lit(seed), F.lit(tag))), 1, 12), 16, 10).cast("long") % below

    first = int(n * inject_incident_at)
    share = draw("category", 1_000_000)
    critical, error = int(critical_ratio * 1_000_000), int((critical_ratio + error_ratio) * 1_000_000)
    pools = [F.array(*(F.struct(F.lit(s).alias("source"), F.lit(t).alias("text")) for s, t in pool)) for pool in (INCIDENT, CRITICAL, ERRORS, NORMAL)]
    sizes = [len(p) for p in (INCIDENT, CRITICAL, ERRORS, NORMAL)]
    picks = [F.get(p, (draw("pattern", size)).cast("int")) for p, size in zip(pools, sizes, strict=True)]
    chosen = F.when((F.col("id") >= first) & (F.col("id") < first + incident_burst), picks[0]).when(share < critical, picks[1]).when(share < error, picks[2]).otherwise(picks[3])
    hexed = lambda tag, digits: F.substring(F.md5(F.concat_ws(":", "id", F.lit(seed), F.lit(tag))), 1, digits)
    two = lambda tag: F.lpad(draw(tag, 60).cast("string"), 2, "0")
    fill = {
        "{ip}": F.concat(F.lit("10."), draw("ip2", 256), F.lit("."), draw("ip3", 256), F.lit("."), draw("ip4", 254) + 1),
        "{ts}": F.concat(F.lit("2023-08-01T12:"), two("minute"), F.lit(":"), two("second")),
        "{n}": (draw("n", 99_999) + 1).cast("string"),
        "{ms}": (draw("ms", 5_000) + 1).cast("string"),
        "{sz}": (draw("size", 99_900) + 100).cast("string"),
        "{port}": (draw("port", 64_512) + 1024).cast("string"),
        "{uuid}": F.concat(hexed("uuid1", 8), F.lit("-0000-4000-8000-"), hexed("uuid2", 12)),
        "{hex}": F.concat(F.lit("0x"), F.upper(hexed("hex", 6))),
    }
    out = spark.range(n).withColumn("_p", chosen)
    line = F.col("_p.text")
    for slot, value in fill.items():
        line = F.replace(line, F.lit(slot), value)
    ts = F.timestamp_micros(F.lit(START * 1_000_000) + F.col("id") * 250_000)
    return out.select(F.col("id").cast("string").alias("id"), line.alias("line"), F.col("_p.source").alias("source"), ts.alias("ts"))


def sample_corpus(spark: SparkSession, n: int = 400, seed: int = 1) -> DataFrame:
    return generate(spark, n, seed).select("line")
