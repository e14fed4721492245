"""SQL twins of the mined chain: parse tree, template fold, rates, rules, clusters and alerts.

Sequential folds are recursive common table expressions over distinct strings or templates, so
these texts check the Spark operators on small tables; they are no way to run them on large ones.
"""

from __future__ import annotations

from .functions.vectors import WORD
from .settings import Settings

SEVERITY_NAME = "CASE severity WHEN 0 THEN 'TRACE' WHEN 1 THEN 'DEBUG' WHEN 2 THEN 'INFO' WHEN 3 THEN 'WARNING' WHEN 4 THEN 'ERROR' ELSE 'CRITICAL' END"


def tree(settings: Settings = Settings(), table: str = "classed") -> str:
    """CTE ``tree``: distinct masked strings with their tokens and capped prefix (the parse-tree leaf)."""
    out = f"""strings AS (SELECT masked, min(struct_pack(ts := ts, id := id)) AS first, count(*) AS n_lines, CASE WHEN masked = '' THEN ['<empty>'] ELSE string_split(masked, ' ') END AS toks FROM {table} GROUP BY masked),
level0 AS (SELECT *, len(toks) AS n_tokens, [CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END FOR x IN list_slice(toks, 1, {settings.prefix_depth})] AS raw, CAST([] AS VARCHAR[]) AS prefix FROM strings)"""
    for k in range(1, settings.prefix_depth + 1):
        out += f""",
came{k} AS (SELECT *, min(first) OVER (PARTITION BY n_tokens, prefix, raw[{k}]) AS came FROM level{k - 1}),
rank{k} AS (SELECT *, dense_rank() OVER (PARTITION BY n_tokens, prefix ORDER BY came) AS place FROM came{k}),
level{k} AS (SELECT masked, first, n_lines, toks, n_tokens, raw, CASE WHEN raw[{k}] IS NULL THEN prefix WHEN place > {settings.max_children} THEN list_append(prefix, '<*>') ELSE list_append(prefix, raw[{k}]) END AS prefix FROM rank{k})"""
    return out + f""",
tree AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY n_tokens, prefix ORDER BY first) AS k FROM level{settings.prefix_depth})"""


def mined(settings: Settings = Settings()) -> str:
    """CTE ``mined``: every distinct masked string with its final template and id."""
    return f"""fold AS (
  SELECT n_tokens, prefix, k, [toks] AS groups, CAST(1 AS BIGINT) AS at FROM tree WHERE k = 1
  UNION ALL
  SELECT n_tokens, prefix, k, CASE WHEN top >= {settings.template_similarity}::DOUBLE
      THEN list_transform(groups, lambda g, i: CASE WHEN i = best THEN list_transform(g, lambda x, j: CASE WHEN x = toks[j] THEN x ELSE '<*>' END) ELSE g END)
      ELSE list_append(groups, toks) END, CASE WHEN top >= {settings.template_similarity}::DOUBLE THEN best ELSE len(groups) + 1 END
  FROM (SELECT *, list_max(scores) AS top, list_position(scores, list_max(scores)) AS best FROM (
    SELECT t.n_tokens, t.prefix, t.k, t.toks, f.groups,
      list_transform(f.groups, lambda g: list_sum(list_transform(g, lambda x, j: CASE WHEN x = t.toks[j] OR x = '<*>' OR t.toks[j] = '<*>' THEN 1 ELSE 0 END))::DOUBLE / t.n_tokens) AS scores
    FROM fold f JOIN tree t ON t.n_tokens = f.n_tokens AND t.prefix = f.prefix AND t.k = f.k + 1))),
final AS (SELECT n_tokens, prefix, arg_max(groups, k) AS groups FROM fold GROUP BY ALL),
mined AS MATERIALIZED (SELECT t.masked, array_to_string(g.groups[f.at], ' ') AS template, 'tpl_' || substr(md5(array_to_string(g.groups[f.at], ' ')), 1, 12) AS template_id
  FROM tree t JOIN fold f ON f.n_tokens = t.n_tokens AND f.prefix = t.prefix AND f.k = t.k JOIN final g ON g.n_tokens = t.n_tokens AND g.prefix = t.prefix)"""


def embedded(settings: Settings = Settings()) -> str:
    """CTEs up to ``embedded`` over ``templates`` (template_id, template, first): unit vectors ``v``, numbered ``k`` in order."""
    slot = f"CAST(('0x' || substr(md5(token), 1, 16))::UBIGINT % {settings.embed_dim} AS INTEGER)"
    return rf"""words AS (SELECT template_id, unnest(regexp_extract_all(lower(template), '{WORD}')) AS token FROM templates),
counted AS (SELECT template_id, token, count(*) AS n FROM words GROUP BY ALL),
slots AS (SELECT template_id, {slot} AS slot, sum((1 + ln(n)) * CASE WHEN ('0x' || substr(md5(token), 1, 1))::INTEGER & 2 <> 0 THEN 1 ELSE -1 END) AS value FROM counted GROUP BY ALL),
dense AS (SELECT t.template_id, d.slot, coalesce(s.value, 0)::DOUBLE AS value FROM templates t CROSS JOIN (SELECT unnest(range({settings.embed_dim})) AS slot) d LEFT JOIN slots s ON s.template_id = t.template_id AND s.slot = d.slot),
raw AS (SELECT template_id, list(value ORDER BY slot) AS v, sqrt(sum(value * value)) AS norm FROM dense GROUP BY template_id),
embedded AS MATERIALIZED (SELECT t.*, list_transform(r.v, lambda x: CASE WHEN r.norm > 0 THEN x / r.norm ELSE x END) AS v, row_number() OVER (ORDER BY first) AS k FROM templates t JOIN raw r USING (template_id))"""


def leaders(table: str, similarity: float) -> str:
    """CTEs ``edges``, ``leads`` and ``led`` (template_id, leader) of ``table`` (template_id, v, k from 1 in order)."""
    return f"""edges AS MATERIALIZED (SELECT a.k AS a, b.k AS b, list_inner_product(a.v, b.v) AS cosine FROM {table} a JOIN {table} b ON a.k < b.k AND list_inner_product(a.v, b.v) >= {similarity}::DOUBLE),
near AS MATERIALIZED (SELECT k, coalesce(list(a) FILTER (WHERE a IS NOT NULL), []) AS earlier FROM {table} LEFT JOIN edges ON b = k GROUP BY k),
leads AS (
  SELECT k, [k] AS ks FROM near WHERE k = 1
  UNION ALL
  SELECT n.k, CASE WHEN list_has_any(l.ks, n.earlier) THEN l.ks ELSE list_append(l.ks, n.k) END FROM leads l JOIN near n ON n.k = l.k + 1),
heads AS MATERIALIZED (SELECT unnest(arg_max(ks, k)) AS k FROM leads),
led AS (SELECT e.template_id, coalesce(h.template_id, e.template_id) AS leader FROM {table} e
  LEFT JOIN (SELECT b, a FROM edges SEMI JOIN heads ON heads.k = edges.a ANTI JOIN heads ON heads.k = edges.b QUALIFY row_number() OVER (PARTITION BY b ORDER BY cosine DESC, a) = 1) j ON j.b = e.k
  LEFT JOIN {table} h ON h.k = j.a)"""


def clusters(settings: Settings = Settings()) -> str:
    """CTEs over ``judged``: ``gated`` lines, ``assigned`` templates, ``clusters`` and, with flags, ``flagged`` lines."""
    return rf"""gated AS MATERIALIZED (SELECT * FROM judged WHERE reasons <> '' OR place = 1 OR severity >= 4),
templates AS (SELECT template_id, any_value(template) AS template, count(*) AS members, min(struct_pack(ts := ts, id := id)) AS first FROM gated GROUP BY template_id),
{embedded(settings)},
{leaders("embedded", settings.cluster_similarity)},
assigned AS MATERIALIZED (SELECT template_id, 'cl_' || substr(md5(leader), 1, 12) AS cluster_id FROM led),
clustered AS (SELECT g.*, a.cluster_id, row_number() OVER (PARTITION BY a.cluster_id ORDER BY g.ts, g.id) AS nth, min(g.ts) OVER (PARTITION BY a.cluster_id) AS since FROM gated g JOIN assigned a USING (template_id)),
modes AS (SELECT cluster_id, component, count(*) AS n, min(struct_pack(ts := ts, id := id)) AS first FROM clustered GROUP BY ALL),
mode AS (SELECT cluster_id, component FROM modes QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, first) = 1),
clusters AS (SELECT c.cluster_id AS id, upper(substr(any_value(m.component), 1, 1)) || substr(any_value(m.component), 2) || ' incident' AS label, count(*) AS members, any_value(m.component) AS dominant_component,
  max(severity) AS max_severity, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 <= {settings.new_incident_seconds} AS new_incident,
  arg_min(template, struct_pack(ts := ts, id := c.id)) AS sample_template, count(*) >= {settings.min_cluster_size} AS promoted
  FROM clustered c JOIN mode m USING (cluster_id) GROUP BY c.cluster_id),
promoting AS (SELECT cluster_id, min(struct_pack(ts := ts, id := id)) AS from_place FROM clustered WHERE nth = {settings.min_cluster_size} GROUP BY cluster_id),
flags AS (SELECT c.id, c.cluster_id, coalesce(struct_pack(ts := c.ts, id := c.id) >= p.from_place, false) AND (epoch_us(c.ts) - epoch_us(c.since)) / 1e6 <= {settings.new_incident_seconds} AS new_incident FROM clustered c LEFT JOIN promoting p USING (cluster_id)),
flagged AS MATERIALIZED (SELECT j.*, f.cluster_id, coalesce(f.new_incident, false) AS new_incident FROM judged j LEFT JOIN flags f USING (id))"""


def rates(table: str, key: str, settings: Settings = Settings(), lines: str = "") -> str:
    """CTEs ``counts``, ``ewma``, ``numbered`` and ``rated`` (lines with their z) of ``table`` by ``key``."""
    a = f"{settings.ewma_alpha}::DOUBLE"
    return f"""
counts AS MATERIALIZED (SELECT {key} AS k, widx, count(*) AS x, row_number() OVER (PARTITION BY {key} ORDER BY widx) AS n FROM {table} GROUP BY {key}, widx),
ewma AS (
  SELECT k, n, x, CAST(x AS DOUBLE) AS m, CAST(1 AS DOUBLE) AS v FROM counts WHERE n = 1
  UNION ALL
  SELECT c.k, c.n, c.x, (1 - {a}) * e.m + {a} * c.x, (1 - {a}) * (e.v + {a} * (c.x - e.m) * (c.x - e.m)) FROM ewma e JOIN counts c ON c.k = e.k AND c.n = e.n + 1),
numbered AS (SELECT t.*, c.n, row_number() OVER (PARTITION BY t.{key}, t.widx ORDER BY t.ts, t.id) AS j FROM {table} t JOIN counts c ON c.k = t.{key} AND c.widx = t.widx),
rated AS (SELECT l.*,
  CASE WHEN j = 1 AND l.n <= 2 THEN 0 WHEN j = 1 THEN (p1.x - p2.m) / sqrt(greatest(p2.v, 1e-9))
       WHEN l.n = 1 THEN 0 ELSE (j - 1 - p1.m) / sqrt(greatest(p1.v, 1e-9)) END AS z
  FROM numbered l LEFT JOIN ewma p1 ON p1.k = l.{key} AND p1.n = l.n - 1 LEFT JOIN ewma p2 ON p2.k = l.{key} AND p2.n = l.n - 2)"""


def judged(settings: Settings = Settings()) -> str:
    """CTE ``judged`` over ``rated`` lines with a ``template_id``."""
    return f"""placed AS (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY ts, id) AS place FROM rated),
judged AS MATERIALIZED (SELECT *, concat_ws(',', CASE WHEN severity >= 5 THEN 'critical_severity' END, CASE WHEN place = 1 AND severity >= 3 THEN 'new_template' END,
  CASE WHEN place <= {settings.rare_template_threshold} AND severity >= 4 THEN 'rare_error' END, CASE WHEN z >= {settings.rate_spike_z} THEN 'rate_spike' END) AS reasons FROM placed)"""


CHANNELS = """CASE WHEN severity >= 5 OR contains(reasons, 'critical_severity') THEN 'pagerduty,slack'
  WHEN contains(reasons, 'rate_spike') OR contains(reasons, 'rare_error') OR severity >= 4 THEN 'slack'
  WHEN new_incident OR contains(reasons, 'new_template') THEN 'slack' ELSE '' END"""


def sent(settings: Settings = Settings()) -> str:
    """CTEs over ``flagged``: ``routed``, ``candidates`` and ``sent`` ones (template_id, c)."""
    return f"""routed AS (SELECT *, {CHANNELS} AS channels FROM flagged WHERE severity >= {settings.alert_min_severity} OR reasons <> '' OR new_incident),
candidates AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY ts, id) AS c FROM routed WHERE channels <> ''),
sent AS (
  SELECT template_id, c, ts FROM candidates WHERE c = 1
  UNION ALL
  SELECT template_id, c, ts FROM (
    SELECT k.template_id, k.c, k.ts, row_number() OVER (PARTITION BY k.template_id ORDER BY k.c) AS first
    FROM sent s JOIN candidates k ON k.template_id = s.template_id AND k.c > s.c AND k.ts >= s.ts + INTERVAL {settings.cooldown_seconds} SECOND) WHERE first = 1)"""


ALERTS = f"""SELECT 'alert_' || substr(md5(k.template_id || ':' || k.id), 1, 12) AS id, k.template_id, severity, channels,
  '[' || component || '] ' || {SEVERITY_NAME} || ' — ' || substr(template, 1, 80) AS title,
  'template=' || k.template_id || ' severity=' || {SEVERITY_NAME} || ' reasons=' || CASE WHEN reasons = '' THEN 'threshold' ELSE reasons END || CASE WHEN new_incident THEN ' NEW-INCIDENT' ELSE '' END AS detail
FROM candidates k JOIN sent s USING (template_id, c)"""


def chain(classed: str, settings: Settings) -> str:
    """The whole chain from a CTE ``classed`` (id, ts, source, line, masked, severity, component, widx)."""
    return (
        f"WITH RECURSIVE {classed}, {tree(settings)}, {mined(settings)}, "
        f"lines AS MATERIALIZED (SELECT c.*, m.template, m.template_id FROM classed c JOIN mined m USING (masked)), "
        f"{rates('lines', 'template_id', settings)}, {judged(settings)}, {clusters(settings)}, {sent(settings)} "
    )
