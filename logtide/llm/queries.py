"""The registered ``opN_*`` queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, cotraining, licenses, lines, omh, packing, passages, pieces, rules, simhash, suffixes, token_files, whitening
from .common import WHITE, scratch_path


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.with_next(_documents(spark, sf_dir))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.nbest_digest(_documents(spark, sf_dir), _path("piece_bpe_32k.model"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), _path("word_bpe_49k.json"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffixes.remove_repeats(_documents(spark, sf_dir))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("data", 256).alias("kept_sha256"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = cotraining.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return cotraining.score(docs, model)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = passages.remove_passages(_documents(spark, sf_dir).select("doc_id", "text"))
    words = F.regexp_replace(F.trim(F.col("text"), F.lit(WHITE)), "[\\x20\\x09-\\x0D]+", " ")
    kept = F.when(F.col("n_removed") > 0, F.col("text")).otherwise(F.coalesce(words, F.lit("")))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write(_documents(spark, sf_dir), path, _path("byte_bpe_50k.json"))
    return token_files.read(spark, path)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir)).drop("matches")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_order_minhash, op2_sentencepiece, op3_packing, op4_line_dedup, op5_simhash, op6_suffix_dedup, op7_quality_classifier, op8_substring_dedup, op9_quality_rules, op10_token_files, op11_license_scan, op12_whitening, op13_collocations)}

_KEY = "translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _license_sql() -> str:
    """Templates as expressions over the words, each followed by a space; quarters of them for the score."""
    parsed = [(label, licenses.parse(markup)) for label, markup in licenses.TEMPLATES]
    holds = lambda nodes, quarter=4: f"regexp_matches(t, ' {licenses.to_regex(nodes, quarter)}')"
    labels = ", ".join(f"CASE WHEN {holds(nodes)} THEN '{label}' END" for label, nodes in parsed)
    score = " ".join(f"WHEN {' OR '.join(holds(nodes, q) for _, nodes in parsed)} THEN {q / 4}" for q in (4, 3, 2, 1))
    phrases = "(VALUES " + ", ".join(f"('{p}', '{label}')" for p, label in licenses.PHRASES.items()) + ") AS phrases(phrase, label)"
    return f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
places AS (SELECT doc_id, label, unnest(list_filter(range(0, len(w)), lambda i: array_to_string(w[i + 1:i + len(string_split(phrase, ' '))], ' ') = phrase)) AS i
  FROM docs, {phrases} WHERE list_contains(w, 'license')),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS base FROM places GROUP BY doc_id),
flat AS (SELECT doc_id, len(w) AS n_words, ' ' || array_to_string(w, ' ') || ' ' AS t FROM docs),
judged AS (SELECT doc_id, n_words, list_filter([{labels}], lambda x: x IS NOT NULL) AS own, CASE {score} ELSE 0.0 END AS score FROM flat)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(base, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), own))), ','), '') AS labels, CAST(score AS DOUBLE) AS score
FROM judged LEFT JOIN base USING (doc_id)
"""


ORACLE_SQL = {
    "op11_license_scan": _license_sql(),
    "op4_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, {_KEY} AS k FROM lines),
firsts AS (SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
judged AS (SELECT doc_id, pos, line, coalesce(doc_id > first_doc, false) AS gone FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
    "op6_suffix_dedup": """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
bases AS (SELECT doc_id, h, length(h) // 2 - 199 AS starts, unnest(range(0, length(h) // 2 - 199, 128)) AS b FROM docs WHERE length(h) >= 400),
pieces AS MATERIALIZED (SELECT doc_id, b, least(128, starts - b) AS m, substr(h, 2 * b + 1, 654) AS part FROM bases),
heads AS (SELECT doc_id, b, part, unnest(range(1, m + 1)) AS i FROM pieces),
short AS MATERIALIZED (SELECT doc_id, b, i, hash(substr(part, 2 * i - 1, 64)) AS k FROM heads),
twin AS (SELECT k FROM short GROUP BY k HAVING count(*) > 1),
long AS MATERIALIZED (SELECT s.doc_id, s.b + s.i AS p, md5(substr(d.part, 2 * s.i - 1, 400)) AS k FROM short s SEMI JOIN twin USING (k) JOIN pieces d ON d.doc_id = s.doc_id AND d.b = s.b),
twice AS (SELECT k FROM long GROUP BY k HAVING count(*) > 1),
hits AS (SELECT doc_id, p FROM long SEMI JOIN twice USING (k)),
opens AS (SELECT doc_id, p, coalesce(p > lag(p) OVER w + 200, true) AS fresh FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
runs AS (SELECT doc_id, p, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM opens),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 200 AS b FROM runs GROUP BY ALL),
gaps AS (SELECT doc_id, run, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS since FROM spans),
cut AS (SELECT g.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(d.h, 2 * since - 1, 2 * (a - since)), '' ORDER BY a) AS front, max(b) AS last
  FROM gaps g JOIN docs d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 1) - 1))) AS kept_sha256
FROM docs d LEFT JOIN cut ON cut.doc_id = d.doc_id
""",
    "op8_substring_dedup": r"""
WITH docs AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p, len(ws) AS n FROM docs),
keyed AS (SELECT doc_id, p, word, CASE WHEN p + 49 <= n THEN md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) END AS k FROM words),
firsts AS (SELECT k, min(doc_id) AS f FROM keyed WHERE k IS NOT NULL GROUP BY k HAVING min(doc_id) < max(doc_id)),
judged AS (SELECT doc_id, p, word, max(CASE WHEN doc_id > f THEN p END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM keyed LEFT JOIN firsts ON keyed.k = firsts.k)
SELECT d.doc_id, len(any_value(d.ws)) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM docs d LEFT JOIN judged j ON j.doc_id = d.doc_id GROUP BY d.doc_id
""",
    "op13_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
ws AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w)) AS n FROM ws GROUP BY lang),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM ws, (VALUES (1), (2), (3), (4), (5)) AS lengths(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM places GROUP BY ALL HAVING count(*) >= 100),
parts AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
cuts AS (SELECT *, unnest(range(1, k)) AS j FROM parts),
scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.j, x.a AS l, y.a AS r, n, (CAST(1000 AS HUGEINT) * c.a * n) // (CAST(x.a AS HUGEINT) * y.a) AS score
  FROM cuts c JOIN sizes USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.j], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.j + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_at AS (SELECT lang, k, w, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM parts)),
gone AS (SELECT DISTINCT f.lang, f.phrase FROM inner_at JOIN f ON f.lang = inner_at.lang AND f.phrase = array_to_string(w[i:i + m - 1], ' ') WHERE 100 * inner_at.a >= 100 * f.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest ANTI JOIN gone USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
""",
}
