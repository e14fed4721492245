"""Registered queries over the test tables and their SQL counterparts.

Logs are derived from ``events`` (``sources.logs``) or generated.  ``pipeline_*``, ``generated_*``,
``incident_clusters`` and ``new_incidents`` run the whole chain over mined templates with clusters and
alerts; their SQL (``oracle``) folds recursively.  Queries named without such a part take the masked
line for the template and know no incidents.

Every query reads its whole table.  DuckDB's regular expressions know ASCII boundaries alone; the
SQL over documents in any script works around that (``masking.mask_sql``, ``classify.severity_sql``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .functions import classify, masking, vectors
from .operators import alerts, anomaly, clustering, features, templates, tokenizer
from .plans import pipeline, readmodels
from .scratch import materialise
from .settings import Settings
from .sources import logs as source
from .sources import sinks

HOURLY = Settings(window_seconds=3600)
MONTHLY = Settings(window_seconds=3600, new_incident_seconds=31 * 86400)

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Queries over the generator's lines read no given table: tests compare them, the entry leaves them out.
GENERATED_QUERIES: dict = {}
GENERATED_SQL: dict[str, str] = {}


def query(sql: str | None = None, given: bool = True):
    """Register a query under its function's name, with its SQL if it has any."""
    queries, texts = (QUERIES, ORACLE_SQL) if given else (GENERATED_QUERIES, GENERATED_SQL)

    def add(f):
        queries[f.__name__] = f
        if sql:
            texts[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, whatever its script; null text counts as empty."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.logs_of_events(_table(spark, sf_dir, "events"))


def _classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    return _logs(spark, sf_dir).select("*", masking.mask(line).alias("masked"), classify.severity(line).alias("severity"), classify.component(line).alias("component"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged lines with the masked line as template and without incidents, as the SQL has them.

    Masked and judged lines are each written once, as what follows reads them more than once; raw lines are not carried on."""
    lines = _classed(spark, sf_dir).drop("line").withColumnRenamed("masked", "template").withColumn("template_id", templates.template_id(F.col("template")))
    lines = materialise(lines, "classed")
    rated = features.rate_z(lines, "template_id", HOURLY)
    return materialise(pipeline.explained(rated, HOURLY, lines).withColumn("new_incident", F.lit(False)), "judged")


# ---- SQL building blocks ---------------------------------------------------------------

_SQL_LOGS = f"logs AS ({source.LOGS_SQL})"
_SQL_CLASSED = (
    f"{_SQL_LOGS}, classed AS (SELECT *, {masking.mask_sql('line')} AS masked, {classify.severity_sql('line')} AS severity, "
    f"{classify.component_sql('line')} AS component, epoch_us(ts) // 3600000000 AS widx FROM logs)"
)


def _sql_ewma(table: str, key: str) -> str:
    """CTEs ``counts`` and ``ewma`` of hourly counts by key."""
    return f"""
counts AS (SELECT {key} AS k, widx, count(*) AS x, row_number() OVER (PARTITION BY {key} ORDER BY widx) AS n FROM {table} GROUP BY {key}, widx),
ewma AS (
  SELECT k, n, x, CAST(x AS DOUBLE) AS m, CAST(1 AS DOUBLE) AS v FROM counts WHERE n = 1
  UNION ALL
  SELECT c.k, c.n, c.x, 0.7::DOUBLE * e.m + 0.3::DOUBLE * c.x, 0.7::DOUBLE * (e.v + 0.3::DOUBLE * (c.x - e.m) * (c.x - e.m))
  FROM ewma e JOIN counts c ON c.k = e.k AND c.n = e.n + 1)"""


_SQL_Z = """
numbered AS (SELECT t.*, c.n, row_number() OVER (PARTITION BY t.{key}, t.widx ORDER BY t.ts, t.id) AS j FROM {table} t JOIN counts c ON c.k = t.{key} AND c.widx = t.widx),
rated AS (SELECT l.*,
  CASE WHEN j = 1 AND l.n <= 2 THEN 0 WHEN j = 1 THEN (p1.x - p2.m) / sqrt(greatest(p2.v, 1e-9))
       WHEN l.n = 1 THEN 0 ELSE (j - 1 - p1.m) / sqrt(greatest(p1.v, 1e-9)) END AS z
  FROM numbered l LEFT JOIN ewma p1 ON p1.k = l.{key} AND p1.n = l.n - 1 LEFT JOIN ewma p2 ON p2.k = l.{key} AND p2.n = l.n - 2)"""
_SQL_JUDGED = (
    f"WITH RECURSIVE {_SQL_CLASSED}, {_sql_ewma('classed', 'masked')}, {_SQL_Z.format(key='masked', table='classed')}, "
    """placed AS (SELECT *, row_number() OVER (PARTITION BY masked ORDER BY ts, id) AS place, 'tpl_' || substr(md5(masked), 1, 12) AS template_id FROM rated),
judged AS (SELECT *, concat_ws(',', CASE WHEN severity >= 5 THEN 'critical_severity' END, CASE WHEN place = 1 AND severity >= 3 THEN 'new_template' END,
  CASE WHEN place <= 3 AND severity >= 4 THEN 'rare_error' END, CASE WHEN z >= 3 THEN 'rate_spike' END) AS reasons FROM placed)
"""
)
_SQL_CHANNELS = """CASE WHEN severity >= 5 OR contains(reasons, 'critical_severity') THEN 'pagerduty,slack'
  WHEN contains(reasons, 'rate_spike') OR contains(reasons, 'rare_error') OR severity >= 4 THEN 'slack'
  WHEN contains(reasons, 'new_template') THEN 'slack' ELSE '' END"""
_SQL_SEVERITY_NAME = "CASE severity WHEN 0 THEN 'TRACE' WHEN 1 THEN 'DEBUG' WHEN 2 THEN 'INFO' WHEN 3 THEN 'WARNING' WHEN 4 THEN 'ERROR' ELSE 'CRITICAL' END"
_SQL_COOLED = f"""
, routed AS (SELECT *, {_SQL_CHANNELS} AS channels FROM judged WHERE severity >= 4 OR reasons <> ''),
candidates AS (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY ts, id) AS c FROM routed WHERE channels <> ''),
sent AS (
  SELECT template_id, c, ts FROM candidates WHERE c = 1
  UNION ALL
  SELECT template_id, c, ts FROM (
    SELECT k.template_id, k.c, k.ts, row_number() OVER (PARTITION BY k.template_id ORDER BY k.c) AS first
    FROM sent s JOIN candidates k ON k.template_id = s.template_id AND k.c > s.c AND k.ts >= s.ts + INTERVAL 300 SECOND) WHERE first = 1)"""


# ---- masking and extraction ------------------------------------------------------------


@query(f"WITH {_SQL_CLASSED} SELECT masked, severity, count(*) AS count FROM classed GROUP BY ALL")
def masked_by_severity(spark, sf_dir):
    return _classed(spark, sf_dir).groupBy("masked", "severity").count()


@query(f"WITH {_SQL_CLASSED} SELECT id, masked FROM classed")
def mask_logs(spark, sf_dir):
    return _logs(spark, sf_dir).select("id", masking.mask(F.col("line")).alias("masked"))


@query(f"SELECT doc_id, md5({masking.mask_sql('text', unicode=True)}) AS masked_md5 FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def mask_documents(spark, sf_dir):
    return _whole_documents(spark, sf_dir).select("doc_id", F.md5(masking.mask(F.col("text"))).alias("masked_md5"))


@query(f"SELECT page_id, {masking.mask_sql('url')} AS masked FROM pages")
def mask_page_urls(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", masking.mask(F.col("url")).alias("masked"))


#: Every placeholder that stands for values.
_PLACEHOLDERS = list(dict.fromkeys(name for name, _ in masking.RULES))


def _sql_extracted(rest: str) -> str:
    found: dict[str, str] = {}
    for name, pattern in masking.RULES:
        quoted = pattern.replace("'", "''")
        values = f"array_to_string(regexp_extract_all({rest}, '{quoted}'), ',')"
        found[name] = f"concat_ws(',', nullif({found[name]}, ''), nullif({values}, ''))" if name in found else values
        rest = f"regexp_replace({rest}, '{quoted}', ' ', 'g')"
    return ", ".join(f"{v} AS {k.lower()}" for k, v in found.items())


@query(f"WITH {_SQL_LOGS} SELECT id, {_sql_extracted('line')} FROM logs")
def extract_variables_of_logs(spark, sf_dir):
    return _extracted(_logs(spark, sf_dir), "id", "line")


def _extracted(rows, key: str, text: str):
    shown = lambda v: F.struct(*(F.coalesce(F.array_join(v[k], ","), F.lit("")).alias(k.lower()) for k in _PLACEHOLDERS))
    return rows.select(key, F.inline(F.array(masking.bound(masking.extract_variables(F.col(text)), shown))))


@query(f"SELECT page_id, {_sql_extracted('url')} FROM pages")
def extract_variables_of_page_urls(spark, sf_dir):
    return _extracted(_table(spark, sf_dir, "pages"), "page_id", "url")


# ---- templates -------------------------------------------------------------------------

_SQL_PREFIX = "array_to_string([CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END FOR x IN list_slice(toks, 1, 4)], ' ')"
_SQL_BUCKETS = (
    f"WITH {_SQL_CLASSED}, strings AS (SELECT masked, count(*) AS n_lines, CASE WHEN masked = '' THEN ['<empty>'] ELSE string_split(masked, ' ') END AS toks FROM classed GROUP BY masked), "
    f"buckets AS (SELECT masked, n_lines, toks, len(toks) AS n_tokens, {_SQL_PREFIX} AS prefix FROM strings)"
)


def _buckets(spark, sf_dir):
    strings = materialise(templates.distinct_masked(_classed(spark, sf_dir)), "strings")  # read at each level of the tree
    return templates.capped_buckets(strings).withColumn("prefix", F.array_join("prefix", " "))


@query(f"{_SQL_BUCKETS} SELECT masked, CAST(n_tokens AS INTEGER) AS n_tokens, prefix FROM buckets")
def drain_bucket_key(spark, sf_dir):
    return _buckets(spark, sf_dir).select("masked", "n_tokens", "prefix")


@query(f"{_SQL_BUCKETS} SELECT CAST(n_tokens AS INTEGER) AS n_tokens, prefix, count(*) AS strings, CAST(sum(n_lines) AS BIGINT) AS lines FROM buckets GROUP BY ALL")
def bucket_sizes(spark, sf_dir):
    return _buckets(spark, sf_dir).groupBy("n_tokens", "prefix").agg(F.count("*").alias("strings"), F.sum("n_lines").alias("lines"))


@query(
    f"""{_SQL_BUCKETS}, pairs AS (SELECT a.masked, b.masked AS other, a.toks AS s, b.toks AS t, unnest(range(1, len(a.toks) + 1)) AS i
  FROM buckets a JOIN buckets b ON a.n_tokens = b.n_tokens AND a.prefix = b.prefix AND a.masked <> b.masked),
scored AS (SELECT masked, other, round(avg(CASE WHEN s[i] = t[i] OR s[i] = '<*>' OR t[i] = '<*>' THEN 1.0::DOUBLE ELSE 0 END), 6) AS similarity FROM pairs GROUP BY ALL)
SELECT masked, other, similarity FROM scored QUALIFY row_number() OVER (PARTITION BY masked ORDER BY similarity DESC, other) = 1"""
)
def template_similarity_pairs(spark, sf_dir):
    """Each string with the most similar other one of its bucket (ties: the least)."""
    return templates.most_similar(materialise(_buckets(spark, sf_dir).select("masked", "toks", "n_tokens", "prefix"), "buckets"))


@query(f"WITH {_SQL_CLASSED} SELECT DISTINCT masked, 'tpl_' || substr(md5(masked), 1, 12) AS template_id FROM classed")
def template_ids(spark, sf_dir):
    return _classed(spark, sf_dir).select("masked").distinct().withColumn("template_id", templates.template_id(F.col("masked")))


@query(
    f"WITH {_SQL_CLASSED}, placed AS (SELECT id, row_number() OVER (PARTITION BY masked ORDER BY ts, id) AS matched_count FROM classed) SELECT id, matched_count, matched_count = 1 AS is_new FROM placed"
)
def matched_counts(spark, sf_dir):
    lines = _classed(spark, sf_dir).withColumn("template_id", F.col("masked"))
    return templates.matched_counts(lines).select("id", "matched_count", "is_new")


_SQL_CHAIN = oracle.chain(_SQL_CLASSED, HOURLY)


@query(f"{_SQL_CHAIN} SELECT template_id, template, count(*) AS count FROM lines GROUP BY ALL")
def drain_templates(spark, sf_dir):
    strings = materialise(templates.distinct_masked(pipeline.masked(_logs(spark, sf_dir))), "strings")
    found = templates.with_templates(strings, templates.mine_strings(strings))
    return found.groupBy("template_id", "template").agg(F.sum("n_lines").alias("count"))


@query(f"{_SQL_CHAIN} SELECT count(*) AS count FROM lines WHERE template_id = (SELECT template_id FROM lines GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
def template_count(spark, sf_dir):
    strings = materialise(templates.distinct_masked(pipeline.masked(_logs(spark, sf_dir))), "strings")
    found = materialise(templates.with_templates(strings, templates.mine_strings(strings)).select("template_id", "n_lines"), "ids")
    top = found.groupBy("template_id").agg(F.sum("n_lines").alias("count")).orderBy(F.desc("count"), "template_id").first()
    return templates.template_count(found, top.template_id if top else "", "n_lines")


NARROW = Settings(prefix_depth=6, max_children=20)


@query(f"WITH RECURSIVE {_SQL_CLASSED}, {oracle.tree(NARROW)} SELECT masked, CAST(n_tokens AS INTEGER) AS n_tokens, array_to_string(prefix, ' ') AS prefix FROM tree")
def drain_fanout_cap(spark, sf_dir):
    """The parse-tree leaf where a level holds more tokens than it admits."""
    strings = materialise(templates.distinct_masked(_classed(spark, sf_dir)), "strings")
    return templates.capped_buckets(strings, NARROW).select("masked", "n_tokens", F.array_join("prefix", " ").alias("prefix"))


@query(f"WITH RECURSIVE {_SQL_CLASSED}, {oracle.tree(NARROW)}, {oracle.mined(NARROW)} SELECT masked, template, template_id FROM mined")
def drain_with_cap(spark, sf_dir):
    strings = materialise(templates.distinct_masked(_classed(spark, sf_dir)), "strings")
    return templates.mine_strings(strings, NARROW).select("masked", "template", "template_id")


# ---- classification --------------------------------------------------------------------


@query(f"WITH {_SQL_CLASSED} SELECT id, severity FROM classed")
def severity_of_logs(spark, sf_dir):
    return _logs(spark, sf_dir).select("id", classify.severity(F.col("line")).alias("severity"))


@query(f"WITH {_SQL_CLASSED} SELECT id, component FROM classed")
def component_of_logs(spark, sf_dir):
    return _logs(spark, sf_dir).select("id", classify.component(F.col("line")).alias("component"))


@query(f"SELECT doc_id, {classify.severity_sql('text', unicode=True)} AS severity, {classify.component_sql('text')} AS component FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def classify_documents(spark, sf_dir):
    docs = _whole_documents(spark, sf_dir)
    return docs.select("doc_id", classify.severity(F.col("text")).alias("severity"), classify.component(F.col("text")).alias("component"))


@query(f"WITH {_SQL_CLASSED} SELECT severity, count(*) AS count FROM classed GROUP BY severity")
def severity_hist(spark, sf_dir):
    return readmodels.severity_histogram(_classed(spark, sf_dir))


@query(f"WITH {_SQL_CLASSED} SELECT component, count(*) AS count FROM classed GROUP BY component ORDER BY count DESC, component LIMIT 8")
def component_top8(spark, sf_dir):
    return readmodels.top_components(_classed(spark, sf_dir))


# ---- rates -----------------------------------------------------------------------------


@query(f"WITH {_SQL_CLASSED} SELECT masked, widx, count(*) AS count FROM classed GROUP BY ALL")
def window_counts(spark, sf_dir):
    return features.window_counts(_classed(spark, sf_dir), "masked", 3600)


_SQL_TYPED = "typed AS (SELECT event_id AS id, ts, event_type, epoch_us(ts) // 3600000000 AS widx FROM events)"


def _typed(spark, sf_dir):
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", "event_type")


@query(f"WITH RECURSIVE {_SQL_TYPED}, {_sql_ewma('typed', 'event_type')} SELECT k AS event_type, n, x, round(m, 6) AS mean, round(v, 6) AS var FROM ewma")
def ewma_baseline(spark, sf_dir):
    counts = features.window_counts(_typed(spark, sf_dir), "event_type", 3600)
    return features.baselines(counts, "event_type", HOURLY).select("event_type", "n", "x", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


@query(f"WITH RECURSIVE {_SQL_TYPED}, {_sql_ewma('typed', 'event_type')}, {_SQL_Z.format(key='event_type', table='typed')} SELECT id, round(z, 5) AS z FROM rated")
def rate_z(spark, sf_dir):
    return features.rate_z(_typed(spark, sf_dir), "event_type", HOURLY).select("id", F.round("rate_z", 5).alias("z"))


@query(
    "WITH tail AS (SELECT ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20000) SELECT round(count(*) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1e6, 9) AS logs_per_second FROM tail"
)
def logs_per_second(spark, sf_dir):
    lines = _table(spark, sf_dir, "events").select("ts", F.col("event_id").alias("id"))
    return features.logs_per_second(lines).select(F.round("logs_per_second", 9).alias("logs_per_second"))


@query(f"WITH {_SQL_CLASSED} SELECT round(avg(CASE WHEN severity >= 4 THEN 1.0::DOUBLE ELSE 0 END), 6) AS error_rate, count(*) AS total_logs FROM classed")
def error_rate(spark, sf_dir):
    return _classed(spark, sf_dir).agg(F.round(F.avg((F.col("severity") >= 4).cast("double")), 6).alias("error_rate"), F.count("*").alias("total_logs"))


# ---- anomalies, alerts, read models ----------------------------------------------------


@query(f"{_SQL_JUDGED} SELECT id, reasons FROM judged WHERE reasons <> ''")
def anomaly_reasons(spark, sf_dir):
    return _judged(spark, sf_dir).where("is_anomaly").select("id", F.array_join("reasons", ",").alias("reasons"))


@query(f"{_SQL_JUDGED} SELECT id, template_id, severity, component, reasons, epoch_us(ts) AS ts_us FROM judged WHERE reasons <> '' ORDER BY ts DESC, id DESC LIMIT 50")
def recent_anomalies(spark, sf_dir):
    found = readmodels.recent_anomalies(_judged(spark, sf_dir))
    return found.select("id", "template_id", "severity", "component", F.array_join("reasons", ",").alias("reasons"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))


_SQL_ROLLUP = f"""{_SQL_JUDGED}, rolled AS (SELECT template_id, any_value(masked) AS template, count(*) AS count, max(severity) AS max_severity, arg_max(component, struct_pack(ts := ts, id := id)) AS component,
  count(*) FILTER (WHERE reasons <> '') AS anomaly_count, min(ts) AS first_seen, max(ts) AS last_seen FROM judged GROUP BY template_id)"""
_ROLLED = "template_id, template, count, max_severity, component, anomaly_count, epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us"


def _rolled(df):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return df.select("template_id", "template", "count", "max_severity", "component", "anomaly_count", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"))


@query(f"{_SQL_ROLLUP} SELECT {_ROLLED} FROM rolled")
def template_rollup(spark, sf_dir):
    return _rolled(readmodels.rollup(_judged(spark, sf_dir)))


@query(f"{_SQL_ROLLUP} SELECT {_ROLLED} FROM rolled ORDER BY count DESC, first_seen, template_id LIMIT 20")
def top_templates(spark, sf_dir):
    return _rolled(readmodels.top_templates(readmodels.rollup(_judged(spark, sf_dir))))


@query(f"{_SQL_ROLLUP} SELECT {_ROLLED} FROM rolled ORDER BY anomaly_count DESC, first_seen, template_id LIMIT 5")
def top_anomalous_templates(spark, sf_dir):
    return _rolled(readmodels.top_templates(readmodels.rollup(_judged(spark, sf_dir)), 5, order="anomaly"))


@query(f"{_SQL_JUDGED} SELECT id, {_SQL_CHANNELS} AS channels FROM judged WHERE severity >= 4 OR reasons <> ''")
def alert_channels(spark, sf_dir):
    lines = _judged(spark, sf_dir).where(alerts.worthy(F.col("severity"), F.col("reasons"), F.col("new_incident")))
    return lines.select("id", F.array_join(alerts.channels(F.col("severity"), F.col("reasons"), F.col("new_incident")), ",").alias("channels"))


@query(f"{_SQL_JUDGED}{_SQL_COOLED} SELECT k.id, k.template_id FROM candidates k JOIN sent s USING (template_id, c)")
def alert_cooldown(spark, sf_dir):
    lines = _judged(spark, sf_dir).where(alerts.worthy(F.col("severity"), F.col("reasons"), F.col("new_incident")))
    routed = lines.where(F.size(alerts.channels(F.col("severity"), F.col("reasons"), F.col("new_incident"))) > 0)
    return alerts.cooled(routed).select("id", "template_id")


@query(
    f"""{_SQL_JUDGED}{_SQL_COOLED} SELECT 'alert_' || substr(md5(k.template_id || ':' || k.id), 1, 12) AS id, k.template_id, severity, channels,
  '[' || component || '] ' || {_SQL_SEVERITY_NAME} || ' — ' || substr(masked, 1, 80) AS title,
  'template=' || k.template_id || ' severity=' || {_SQL_SEVERITY_NAME} || ' reasons=' || CASE WHEN reasons = '' THEN 'threshold' ELSE reasons END AS detail
FROM candidates k JOIN sent s USING (template_id, c)"""
)
def alert_text(spark, sf_dir):
    return alerts.alerts(_judged(spark, sf_dir)).select("id", "template_id", "severity", F.array_join("channels", ",").alias("channels"), "title", "detail")


_SQL_HEALTH = f"""{_SQL_JUDGED}, tail AS (SELECT ts FROM judged ORDER BY ts DESC, id DESC LIMIT 20000),
health AS (SELECT (SELECT round(count(*) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1e6, 1) FROM tail) AS logs_per_second,
  round(avg(CASE WHEN severity >= 4 THEN 1.0::DOUBLE ELSE 0 END), 4) AS error_rate, count(*) AS total_logs,
  count(*) FILTER (WHERE reasons <> '') AS anomalies, count(DISTINCT template_id) AS unique_templates, CAST(0 AS BIGINT) AS new_incident_types, CAST(0 AS BIGINT) AS consumer_lag FROM judged)"""


@query(f"{_SQL_HEALTH} SELECT * FROM health")
def health_summary(spark, sf_dir):
    return readmodels.health(_judged(spark, sf_dir))


@query(
    f"""{_SQL_HEALTH}, parts AS (
  SELECT unnest(['logs_total counter', 'anomalies_total counter', 'unique_templates gauge', 'new_incident_types gauge', 'consumer_lag gauge']) AS name,
         unnest([total_logs, anomalies, unique_templates, new_incident_types, consumer_lag]) AS value FROM health)
SELECT '# TYPE logtide_' || name AS line FROM parts
UNION ALL SELECT 'logtide_' || split_part(name, ' ', 1) || ' ' || value FROM parts
UNION ALL SELECT 'logtide_logs_by_severity{{severity="' || severity || '"}} ' || count(*) FROM judged GROUP BY severity"""
)
def prometheus_lines(spark, sf_dir):
    lines = _judged(spark, sf_dir)
    shown = sinks.prometheus(readmodels.health(lines), readmodels.severity_histogram(lines))
    return shown.where("line NOT LIKE '%logs_per_second%' AND line NOT LIKE '%error_rate%'").select("line")


@query(
    f"""{_SQL_JUDGED}{_SQL_COOLED} SELECT count(*) AS total, count(*) FILTER (WHERE reasons <> '') AS anomalies, CAST(0 AS BIGINT) AS new_incidents, (SELECT count(*) FROM sent) AS alerts FROM judged"""
)
def ingest_stats(spark, sf_dir):
    lines = _judged(spark, sf_dir)
    return readmodels.ingest_stats(lines, alerts.alerts(lines))


@query(
    f"""{_SQL_JUDGED}{_SQL_COOLED} SELECT count(DISTINCT template_id) AS templates, count(*) FILTER (WHERE reasons <> '') AS anomalies, (SELECT count(*) FROM sent) AS alerts FROM judged"""
)
def store_stats(spark, sf_dir):
    lines = _judged(spark, sf_dir)
    return readmodels.store_stats(readmodels.rollup(lines), lines.where("is_anomaly"), alerts.alerts(lines))


# ---- sources and partitioning ----------------------------------------------------------

_SQL_PARTITION = "CAST(('0x' || substr(md5(source), 1, 8))::UBIGINT % 8 AS INTEGER)"


@query(f"WITH {_SQL_LOGS} SELECT DISTINCT source, {_SQL_PARTITION} AS partition FROM logs")
def partition_for_source(spark, sf_dir):
    return _logs(spark, sf_dir).select("source").distinct().withColumn("partition", source.partition_of(F.col("source")))


@query(f"WITH {_SQL_LOGS} SELECT {_SQL_PARTITION} AS partition, count(*) AS lines FROM logs GROUP BY 1")
def partition_load(spark, sf_dir):
    return _logs(spark, sf_dir).groupBy(source.partition_of(F.col("source")).alias("partition")).agg(F.count("*").alias("lines"))


@query(f"WITH {_SQL_LOGS} SELECT line, source, epoch_us(ts) AS ts_us, false AS bad FROM logs")
def message_round_trip(spark, sf_dir):
    decoded = source.decode_messages(sinks.to_messages(_logs(spark, sf_dir)))
    return decoded.select("line", "source", F.unix_micros("ts").alias("ts_us"), "bad")


@query("SELECT role AS source, count(*) AS lines FROM conversations WHERE trim(text) <> '' GROUP BY role")
def http_batch_lines(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").withColumnRenamed("role", "source")
    batches = turns.groupBy("source", "conv_id", F.floor(F.col("turn") / 100)).agg(F.collect_list("text").alias("lines"))  # at most 100 lines
    return source.from_batches(batches).groupBy("source").agg(F.count("*").alias("lines"))


def _sql_generator(n: int, seed: int = 7) -> str:
    md = lambda tag: f"md5(concat_ws(':', id, {seed}, '{tag}'))"
    draw = lambda tag, below: f"(('0x' || substr({md(tag)}, 1, 12))::UBIGINT % {below})"

    def pick(pool, part):
        items = ", ".join("'" + p[part].replace("'", "''") + "'" for p in pool)
        return f"([{items}])[CAST({draw('pattern', len(pool))} AS INTEGER) + 1]"

    def chosen(part):
        first = int(n * 0.7)
        return (
            f"CASE WHEN id >= {first} AND id < {first + 40} THEN {pick(source.INCIDENT, part)} WHEN {draw('category', 1000000)} < 10000 THEN {pick(source.CRITICAL, part)} "
            f"WHEN {draw('category', 1000000)} < 130000 THEN {pick(source.ERRORS, part)} ELSE {pick(source.NORMAL, part)} END"
        )

    two = lambda tag: f"lpad(CAST({draw(tag, 60)} AS VARCHAR), 2, '0')"
    fill = {
        "{ip}": f"'10.' || {draw('ip2', 256)} || '.' || {draw('ip3', 256)} || '.' || ({draw('ip4', 254)} + 1)",
        "{ts}": f"'2023-08-01T12:' || {two('minute')} || ':' || {two('second')}",
        "{n}": f"CAST({draw('n', 99999)} + 1 AS VARCHAR)",
        "{ms}": f"CAST({draw('ms', 5000)} + 1 AS VARCHAR)",
        "{sz}": f"CAST({draw('size', 99900)} + 100 AS VARCHAR)",
        "{port}": f"CAST({draw('port', 64512)} + 1024 AS VARCHAR)",
        "{uuid}": f"substr({md('uuid1')}, 1, 8) || '-0000-4000-8000-' || substr({md('uuid2')}, 1, 12)",
        "{hex}": f"'0x' || upper(substr({md('hex')}, 1, 6))",
    }
    line = chosen(1)
    for slot, value in fill.items():
        line = f"replace({line}, '{slot}', {value})"
    return f"SELECT CAST(id AS VARCHAR) AS id, {line} AS line, {chosen(0)} AS source FROM range({n}) t(id)"


@query(_sql_generator(3000), given=False)
def generated_lines(spark, sf_dir):
    return source.generate(spark, 3000).select("id", "line", "source")


# ---- words, embeddings, clusters -------------------------------------------------------

_SQL_WORDS = r"unnest(regexp_extract_all(lower({0}), '<[a-z]+>|[a-z0-9]+|[^\s\x0B\x{{85}}\p{{Z}}a-z0-9]'))"
_SQL_SLOT = "CAST(('0x' || substr(md5(token), 1, 16))::UBIGINT % 64 AS INTEGER)"


@query(f"WITH w AS (SELECT {_SQL_WORDS.format('text')} AS word FROM benchmark) SELECT word, count(*) AS count FROM w GROUP BY word")
def word_frequency(spark, sf_dir):
    return tokenizer.word_frequency(_table(spark, sf_dir, "benchmark"), "text")


@query(f"WITH w AS (SELECT {_SQL_WORDS.format('text')} AS word FROM documents) SELECT word, count(*) AS count FROM w GROUP BY word")
def word_frequency_documents(spark, sf_dir):
    return tokenizer.word_frequency(_table(spark, sf_dir, "documents"), "text")


@query(f"WITH {_SQL_CLASSED}, w AS (SELECT DISTINCT {_SQL_WORDS.format('masked')} AS token FROM classed) SELECT token, {_SQL_SLOT} AS slot, ('0x' || substr(md5(token), 1, 1))::INTEGER & 2 <> 0 AS positive FROM w")
def token_hash_slot(spark, sf_dir):
    tokens = _classed(spark, sf_dir).select("masked").distinct().select(F.explode(vectors.words(F.col("masked"))).alias("token")).distinct()
    return tokens.select("token", vectors.token_slot(F.col("token")).alias("slot"), (vectors.token_sign(F.col("token")) > 0).alias("positive"))


@query(
    f"""WITH {_SQL_CLASSED}, strings AS (SELECT DISTINCT masked FROM classed), w AS (SELECT masked, {_SQL_WORDS.format('masked')} AS token FROM strings),
c AS (SELECT masked, token, count(*) AS n FROM w GROUP BY ALL)
SELECT masked, {_SQL_SLOT} AS slot, round(sum((1 + ln(n)) * CASE WHEN ('0x' || substr(md5(token), 1, 1))::INTEGER & 2 <> 0 THEN 1 ELSE -1 END), 6) AS value FROM c GROUP BY 1, 2"""
)
def hash_embedding_sparse(spark, sf_dir):
    strings = _classed(spark, sf_dir).select("masked").distinct()
    return vectors.slot_weights(strings, "masked", "masked").select("masked", "slot", F.round("value", 6).alias("value"))


@query("SELECT vec_id, round(sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS norm FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id")
def l2_norms(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.l2_norm(F.col("embedding")), 6).alias("norm"))


_SQL_PARTS = "parts AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)"


@query(
    f"""WITH {_SQL_PARTS}, one AS (SELECT i, x FROM parts WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
SELECT vec_id, round(sum(CAST(p.x AS DOUBLE) * CAST(o.x AS DOUBLE)), 5) AS cosine FROM parts p JOIN one o USING (i) GROUP BY vec_id ORDER BY sum(CAST(p.x AS DOUBLE) * CAST(o.x AS DOUBLE)) DESC, vec_id LIMIT 20"""
)
def cosine_topk(spark, sf_dir):
    table = _table(spark, sf_dir, "embeddings")
    one = table.agg(F.min_by("embedding", "vec_id").alias("q"))
    near = table.join(F.broadcast(one)).select("vec_id", vectors.dot(F.col("embedding"), F.col("q")).alias("c"))
    return near.orderBy(F.desc("c"), "vec_id").limit(20).select("vec_id", F.round("c", 5).alias("cosine"))


_SQL_CENTRES = f"WITH {_SQL_PARTS}, means AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM parts GROUP BY ALL), centres AS (SELECT label, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS c FROM means)"


def _centres(spark, sf_dir):
    return vectors.centroids(_table(spark, sf_dir, "embeddings"), "label", "embedding")


@query(f"{_SQL_CENTRES} SELECT label, CAST(i - 1 AS INTEGER) AS at, round(c, 6) AS value FROM centres")
def label_centroids(spark, sf_dir):
    return _centres(spark, sf_dir).select("label", F.posexplode("centroid").alias("at", "value")).withColumn("value", F.round("value", 6))


@query(
    f"""{_SQL_CENTRES}, sims AS (SELECT p.vec_id, c.label, sum(CAST(p.x AS DOUBLE) * c.c) AS s FROM parts p JOIN centres c USING (i) GROUP BY ALL)
SELECT vec_id, arg_max(label, s) AS nearest, round(max(s), 5) AS similarity FROM sims GROUP BY vec_id"""
)
def nearest_centroid(spark, sf_dir):
    table = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = vectors.nearest(table, "embedding", _centres(spark, sf_dir), "label", "centroid")
    return found.select("vec_id", "nearest", F.round("similarity", 5).alias("similarity"))


MERGES = 50


def _sql_vocabulary(texts: str, min_freq: int, merges: int = MERGES, vocab_size: int = 1500) -> str:
    """CTEs ``words`` (word, n) of ``texts`` (t) and ``vocab`` (token, id): characters and placeholders, then merge after merge."""
    return rf"""words AS MATERIALIZED (SELECT word, count(*) AS n, word LIKE '<%>' AND length(word) > 1 AS atomic FROM (SELECT unnest(regexp_extract_all(lower(t), '{vectors.WORD}')) AS word FROM {texts}) GROUP BY word),
kept AS MATERIALIZED (SELECT * FROM words WHERE atomic OR n >= {min_freq}),
chars AS (SELECT c AS token, min(struct_pack(n := -n, word := word, pos := pos)) AS first, any_value(atomic) AS atomic FROM (
  SELECT n, word, atomic, unnest(CASE WHEN atomic THEN [word] ELSE string_split(word, '') END) AS c, unnest(range(CASE WHEN atomic THEN 1 ELSE length(word) END)) AS pos FROM kept) GROUP BY c),
seeds AS (SELECT token, first, 0 AS part FROM chars UNION ALL SELECT '##' || token, first, 1 FROM chars WHERE NOT atomic),
start AS MATERIALIZED (SELECT token, 1 + row_number() OVER (ORDER BY first, part) AS id FROM seeds),
steps AS (
  SELECT 0 AS k, '<' || array_to_string(string_split(word, ''), '><') || '>' AS p, n, '' AS l, '' AS r FROM kept WHERE NOT atomic AND length(word) > 1
  UNION ALL
  SELECT k + 1, replace(p, '<' || b.l || '><' || b.r || '>', '<' || b.l || b.r || '>'), n, b.l, b.r
  FROM steps, (SELECT l, r FROM (SELECT n, unnest(ts[:-2]) AS l, unnest(ts[2:]) AS r FROM (SELECT n, string_split(p[2:-2], '><') AS ts FROM steps)) GROUP BY l, r HAVING sum(n) >= {min_freq} ORDER BY sum(n) DESC, l, r LIMIT 1) b
  WHERE k < {merges} AND (SELECT count(*) FROM start) + 2 + 2 * k < {vocab_size}),
merged AS (SELECT DISTINCT k, l || r AS token FROM steps WHERE k > 0),
more AS (SELECT token, min(k) AS k, 0 AS part FROM merged GROUP BY token UNION ALL SELECT '##' || token, min(k), 1 FROM merged GROUP BY token),
vocab AS MATERIALIZED (SELECT '[PAD]' AS token, 0 AS id UNION ALL SELECT '[UNK]', 1 UNION ALL SELECT token, id FROM start
  UNION ALL SELECT token, (SELECT count(*) FROM start) + 1 + row_number() OVER (ORDER BY k, part) FROM more ANTI JOIN start USING (token))"""


@query(f"WITH RECURSIVE {_SQL_CLASSED}, texts AS (SELECT masked AS t FROM classed), {_sql_vocabulary('texts', 2)} SELECT token, CAST(id AS INTEGER) AS id FROM vocab")
def bpe_vocab(spark, sf_dir):
    strings = _classed(spark, sf_dir).select("masked")
    return tokenizer.train(strings, "masked", 1500, max_merges=MERGES).frame(spark)


@query(
    f"""WITH RECURSIVE {_SQL_CLASSED}, texts AS (SELECT DISTINCT masked AS t FROM classed), {_sql_vocabulary('texts', 1)},
spans AS (SELECT word, a, unnest(range(a + 1, length(word) + 1)) AS e FROM (SELECT word, unnest(range(0, length(word))) AS a FROM words WHERE word NOT IN (SELECT token FROM vocab))),
longest AS MATERIALIZED (SELECT word, a, max(e) AS e FROM (SELECT word, a, e, CASE WHEN a > 0 THEN '##' ELSE '' END || word[a + 1:e] AS token FROM spans) SEMI JOIN vocab USING (token) GROUP BY word, a),
coded AS (
  SELECT word, 0 AS a, CASE WHEN word IN (SELECT token FROM vocab) THEN [word] ELSE [] END AS toks, word IN (SELECT token FROM vocab) AS done FROM words
  UNION ALL
  SELECT c.word, coalesce(l.e, c.a + 1), list_append(c.toks, CASE WHEN l.e IS NULL THEN '[UNK]' ELSE CASE WHEN c.a > 0 THEN '##' ELSE '' END || c.word[c.a + 1:l.e] END), coalesce(l.e, c.a + 1) = length(c.word)
  FROM coded c LEFT JOIN longest l ON l.word = c.word AND l.a = c.a WHERE NOT c.done),
book AS (SELECT word, toks FROM coded WHERE done),
placed AS (SELECT t, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT t, regexp_extract_all(lower(t), '{vectors.WORD}') AS ws FROM texts))
SELECT t AS masked, array_to_string(flatten(list(toks ORDER BY i)), ' ') AS tokens, CAST(sum(len(toks)) AS INTEGER) AS n_ids FROM placed JOIN book USING (word) GROUP BY t"""
)
def wordpiece_encode(spark, sf_dir):
    strings = materialise(_classed(spark, sf_dir).select("masked").distinct(), "strings")
    book = tokenizer.train(strings, "masked", 1500, min_freq=1, max_merges=MERGES)
    return book.encode(strings, "masked", "masked").select("masked", F.array_join("tokens", " ").alias("tokens"), F.size("ids").alias("n_ids"))


# ---- the whole chain -------------------------------------------------------------------

GENERATED = 5000
_SQL_GENERATED = (
    f"logs AS (SELECT g.*, make_timestamp({source.START * 1_000_000} + CAST(id AS BIGINT) * 250000) AS ts FROM ({_sql_generator(GENERATED)}) g), classed AS (SELECT *, {masking.mask_sql('line')} AS masked, "
    f"{classify.severity_sql('line')} AS severity, {classify.component_sql('line')} AS component, epoch_us(ts) // 60000000 AS widx FROM logs)"
)
_SQL_GENERATED_CHAIN = oracle.chain(_SQL_GENERATED, Settings())


def _run(spark, sf_dir):
    return pipeline.run(_logs(spark, sf_dir), HOURLY, with_text=False)


def _run_generated(spark):
    return pipeline.run(source.generate(spark, GENERATED))


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


_CLUSTER = "id, label, members, dominant_component, max_severity, first_us, last_us, new_incident, sample_template, promoted"


def _cluster_rows(found):
    return found.withColumns({"first_us": _micros("first_seen"), "last_us": _micros("last_seen")}).select(*_CLUSTER.split(", "))


@query(f"{_SQL_CHAIN} SELECT {_CLUSTER} FROM clusters")
def incident_clusters(spark, sf_dir):
    return _cluster_rows(_run(spark, sf_dir).clusters)


@query(
    f"""{_SQL_CHAIN}, spread AS (SELECT cluster_id, members, v, unnest(range(1, len(v) + 1)) AS i FROM embedded JOIN assigned USING (template_id)),
sums AS (SELECT cluster_id, i, sum(members * v[i]) AS x FROM spread GROUP BY ALL), norms AS (SELECT cluster_id, sqrt(sum(x * x)) AS norm FROM sums GROUP BY ALL)
SELECT cluster_id AS id, i - 1 AS at, round(x / norm, 6) AS value FROM sums JOIN norms USING (cluster_id)"""
)
def cluster_centroids(spark, sf_dir):
    at = F.posexplode("centroid").alias("at", "value")
    return _run(spark, sf_dir).clusters.select("id", at).select("id", F.col("at").cast("long").alias("at"), F.round("value", 6).alias("value"))


@query(
    f"""WITH RECURSIVE templates AS (SELECT conv_id || ':' || turn AS template_id, any_value(coalesce(text, '')) AS template, struct_pack(ts := conv_id, id := turn) AS first FROM conversations GROUP BY conv_id, turn),
{oracle.embedded()}, {oracle.leaders("embedded", 0.6)}
SELECT l.template_id, 'cl_' || substr(md5(leader), 1, 12) AS cluster_id FROM led l"""
)
def conversation_clusters(spark, sf_dir):
    """Every turn of every conversation in clusters of similar wording, led by the first turn of each."""
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    turns = turns.select(F.concat_ws(":", "conv_id", "turn").alias("template_id"), F.col("conv_id").alias("at"), F.col("turn").alias("id"), "text")
    embedded = turns.join(vectors.hash_embed(turns, "template_id", "text"), "template_id").drop("text")
    return clustering.grouped(materialise(embedded, "turns"), 0.6).select("template_id", "cluster_id")


@query(f"{_SQL_GENERATED_CHAIN} SELECT {_CLUSTER} FROM clusters WHERE promoted", given=False)
def generated_incidents(spark, sf_dir):
    """The generator's lines end to end: the injected pattern is among the promoted clusters."""
    return _cluster_rows(_run_generated(spark).clusters.where("promoted"))


@query(f"{oracle.chain(_SQL_CLASSED, MONTHLY)} SELECT {_CLUSTER} FROM clusters WHERE promoted AND new_incident")
def new_incidents(spark, sf_dir):
    """Promoted clusters all of whose lines lie within 31 days."""
    return _cluster_rows(clustering.new_incidents(pipeline.run(_logs(spark, sf_dir), MONTHLY, with_text=False).clusters))


@query(f"{_SQL_GENERATED_CHAIN} SELECT {_CLUSTER} FROM clusters WHERE promoted AND new_incident", given=False)
def generated_new_incidents(spark, sf_dir):
    return _cluster_rows(clustering.new_incidents(_run_generated(spark).clusters))


_LINE = "id, source, epoch_us(ts) AS ts_us, template, template_id, severity, component, cluster_id, reasons <> '' AS is_anomaly, reasons AS anomaly_reasons, new_incident"


def _line_rows(lines):
    shown = pipeline.projected(lines, "new_incident").withColumns({"ts_us": _micros("ts"), "anomaly_reasons": F.array_join("anomaly_reasons", ",")})
    return shown.drop("ts")


@query(f"{_SQL_CHAIN} SELECT {_LINE} FROM flagged")
def pipeline_lines(spark, sf_dir):
    return _line_rows(_run(spark, sf_dir).lines)


@query(f"{_SQL_GENERATED_CHAIN} SELECT {_LINE} FROM flagged", given=False)
def generated_pipeline_lines(spark, sf_dir):
    return _line_rows(_run_generated(spark).lines)


@query(f"{_SQL_CHAIN} SELECT id, z FROM (SELECT id, round(z, 5) AS z FROM flagged)")
def pipeline_rate_z(spark, sf_dir):
    return _run(spark, sf_dir).lines.select("id", F.round("rate_z", 5).alias("z"))


def _alert_rows(alerts_):
    return alerts_.select("id", "template_id", "severity", F.array_join("channels", ",").alias("channels"), "title", "detail")


@query(_SQL_CHAIN + oracle.ALERTS)
def pipeline_alerts(spark, sf_dir):
    return _alert_rows(_run(spark, sf_dir).alerts)


@query(_SQL_GENERATED_CHAIN + oracle.ALERTS, given=False)
def generated_alerts(spark, sf_dir):
    return _alert_rows(_run_generated(spark).alerts)


@query(f"{_SQL_CHAIN} SELECT id, template_id, severity, channels, title, detail FROM (SELECT k.ts AS sent_at, a.* FROM ({oracle.ALERTS}) a JOIN candidates k ON a.id = 'alert_' || substr(md5(k.template_id || ':' || k.id), 1, 12)) ORDER BY sent_at DESC, id DESC LIMIT 50")
def recent_alerts(spark, sf_dir):
    return _alert_rows(readmodels.recent_alerts(_run(spark, sf_dir).alerts))


@query(f"{_SQL_CHAIN} SELECT id, reasons FROM flagged WHERE reasons <> ''")
def pipeline_anomaly_reasons(spark, sf_dir):
    lines = _run(spark, sf_dir).lines
    return lines.where("is_anomaly").select("id", F.array_join("reasons", ",").alias("reasons"))


_SQL_MINED_ROLLUP = f"""{_SQL_CHAIN}, rolled AS (SELECT template_id, any_value(template) AS template, count(*) AS count, max(severity) AS max_severity, arg_max(component, struct_pack(ts := ts, id := id)) AS component,
  count(*) FILTER (WHERE reasons <> '') AS anomaly_count, min(ts) AS first_seen, max(ts) AS last_seen FROM flagged GROUP BY template_id)"""


@query(f"{_SQL_MINED_ROLLUP} SELECT {_ROLLED} FROM rolled")
def pipeline_rollup(spark, sf_dir):
    return _rolled(readmodels.rollup(_run(spark, sf_dir).lines))


@query(f"{_SQL_MINED_ROLLUP} SELECT {_ROLLED} FROM rolled ORDER BY count DESC, first_seen, template_id LIMIT 20")
def pipeline_top_templates(spark, sf_dir):
    return _rolled(readmodels.top_templates(readmodels.rollup(_run(spark, sf_dir).lines)))


@query(f"{_SQL_MINED_ROLLUP} SELECT {_ROLLED} FROM rolled ORDER BY anomaly_count DESC, first_seen, template_id LIMIT 5")
def pipeline_top_anomalous_templates(spark, sf_dir):
    return _rolled(readmodels.top_templates(readmodels.rollup(_run(spark, sf_dir).lines), 5, order="anomaly"))


def _health(result):
    return readmodels.health(result.lines, clustering.new_incidents(result.clusters))


_SQL_MINED_HEALTH = """, tail AS (SELECT ts FROM flagged ORDER BY ts DESC, id DESC LIMIT 20000),
health AS (SELECT (SELECT round(count(*) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1e6, 1) FROM tail) AS logs_per_second,
  round(avg(CASE WHEN severity >= 4 THEN 1.0::DOUBLE ELSE 0 END), 4) AS error_rate, count(*) AS total_logs, count(*) FILTER (WHERE reasons <> '') AS anomalies,
  count(DISTINCT template_id) AS unique_templates, (SELECT count(*) FROM clusters WHERE promoted AND new_incident) AS new_incident_types, CAST(0 AS BIGINT) AS consumer_lag FROM flagged)"""
_SQL_MINED_PROMETHEUS = """, parts AS (
  SELECT unnest(['logs_total counter', 'logs_per_second gauge', 'error_rate gauge', 'anomalies_total counter', 'unique_templates gauge', 'new_incident_types gauge', 'consumer_lag gauge']) AS name,
         unnest([CAST(total_logs AS VARCHAR), CAST(logs_per_second AS VARCHAR), CAST(error_rate AS VARCHAR), CAST(anomalies AS VARCHAR), CAST(unique_templates AS VARCHAR), CAST(new_incident_types AS VARCHAR), CAST(consumer_lag AS VARCHAR)]) AS value FROM health)
SELECT '# TYPE logtide_' || name AS line FROM parts
UNION ALL SELECT 'logtide_' || split_part(name, ' ', 1) || ' ' || value FROM parts
UNION ALL SELECT 'logtide_logs_by_severity{severity="' || severity || '"} ' || count(*) FROM flagged GROUP BY severity"""
_SQL_MINED_STATS = " SELECT count(*) AS total, count(*) FILTER (WHERE reasons <> '') AS anomalies, count(*) FILTER (WHERE new_incident) AS new_incidents, (SELECT count(*) FROM sent) AS alerts FROM flagged"


@query(f"{_SQL_CHAIN}{_SQL_MINED_HEALTH} SELECT * FROM health")
def pipeline_health(spark, sf_dir):
    return _health(_run(spark, sf_dir))


@query(f"{_SQL_GENERATED_CHAIN}{_SQL_MINED_HEALTH} SELECT * FROM health", given=False)
def generated_health(spark, sf_dir):
    return _health(_run_generated(spark))


def _prometheus(result):
    return sinks.prometheus(_health(result), readmodels.severity_histogram(result.lines)).select("line")


@query(f"{_SQL_CHAIN}{_SQL_MINED_HEALTH}{_SQL_MINED_PROMETHEUS}")
def pipeline_prometheus(spark, sf_dir):
    return _prometheus(_run(spark, sf_dir))


@query(f"{_SQL_GENERATED_CHAIN}{_SQL_MINED_HEALTH}{_SQL_MINED_PROMETHEUS}", given=False)
def generated_prometheus(spark, sf_dir):
    return _prometheus(_run_generated(spark))


@query(_SQL_CHAIN + _SQL_MINED_STATS)
def pipeline_ingest_stats(spark, sf_dir):
    result = _run(spark, sf_dir)
    return readmodels.ingest_stats(result.lines, result.alerts)


@query(_SQL_GENERATED_CHAIN + _SQL_MINED_STATS, given=False)
def generated_ingest_stats(spark, sf_dir):
    result = _run_generated(spark)
    return readmodels.ingest_stats(result.lines, result.alerts)


@query(f"{_SQL_CHAIN} SELECT count(DISTINCT template_id) AS templates, count(*) FILTER (WHERE reasons <> '') AS anomalies, (SELECT count(*) FROM sent) AS alerts FROM flagged")
def pipeline_store_stats(spark, sf_dir):
    result = _run(spark, sf_dir)
    return readmodels.store_stats(readmodels.rollup(result.lines), result.lines.where("is_anomaly"), result.alerts)


@query(
    f"""{_SQL_CHAIN}{_SQL_MINED_HEALTH}, stats AS ({_SQL_MINED_STATS}), hist AS (SELECT string_agg(severity || '=' || n, ',' ORDER BY severity) AS severities FROM (SELECT severity, count(*) AS n FROM flagged GROUP BY 1)),
top AS (SELECT string_agg(component || '=' || n, ',' ORDER BY n DESC, component) AS components FROM (SELECT component, count(*) AS n FROM flagged GROUP BY 1 ORDER BY n DESC, component LIMIT 8))
SELECT h.*, s.new_incidents, s.alerts, severities, components FROM health h, stats s, hist, top"""
)
def full_stats(spark, sf_dir):
    result = _run(spark, sf_dir)
    row = readmodels.full_stats(result.lines, result.alerts, clustering.new_incidents(result.clusters))
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["name"].cast("string"), F.lit("="), x["count"])), ",")
    return row.withColumns({"severities": shown("severities"), "components": shown("components")})
