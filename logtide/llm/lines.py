"""Line de-duplication with DataFrame functions alone.

Lines are exploded and normalised to keys, keys are hashed (128 bits) and each hash's distinct
documents are counted: that there are two or more its smallest and largest doc_id say at once, for
higher thresholds each task first combines (hash, document).  The smallest doc_id keeps the line.  Hot
lines get their verdict by broadcast (``lookup_weighted``), and a document's dropped positions rebuild
its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, free_names, lookup_weighted, lower_ascii, materialise, own_columns, quoted

_LAST = (1 << 63) - 1


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """All columns of ``docs`` with ``text`` rebuilt, plus ``n_lines`` (before) and ``n_dropped``.

    A line's key is the line without ASCII white space at both ends, A-Z lower-cased.  A key of at
    least ``min_chars`` code points that ``min_docs`` documents hold loses its lines everywhere but in
    the smallest doc_id holding it.  Null or empty text is one empty line.  Rows that share a doc_id
    count as one document; a null doc_id counts as the largest.  Very long texts are taken whole; an
    empty table stays empty.  Columns of ``docs`` named like the two new ones, in any case, give way to
    them; all others stay.
    """
    own = own_columns(docs, "n_lines", "n_dropped")
    doc, row, lines, gone = free_names(docs, "_doc", "_row", "_lines", "_gone")
    base = docs.select(*(F.coalesce("text", F.lit("")).alias(c) if c.lower() == "text" else quoted(c) for c in own))
    base = base.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), row: F.xxhash64("text")})
    key = lower_ascii(F.trim(F.col("line"), F.lit(WHITE)))
    held = (
        base.select(F.col(doc).alias("doc"), F.col(row).alias("row"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        .select("doc", "row", "pos", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    if min_docs <= 2:
        counts = held.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("weight")).where("first < last")
    else:
        each = held.groupBy("h1", "h2", "doc").agg(F.count("*").alias("n"))
        counts = each.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.count("*").alias("docs"), F.sum("n").alias("weight")).where(F.col("docs") >= min_docs)
    shared = materialise(counts.select("h1", "h2", "first", "weight"), "lines")
    dropped = (
        lookup_weighted(held, shared, ["h1", "h2"])
        .where("doc > first")
        .groupBy(F.col("doc").alias(doc), F.col("row").alias(row))
        .agg(F.collect_set("pos").alias(gone))
    )
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    kept = F.transform(left, lambda i: F.get(lines, i))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return (
        base.join(dropped, [doc, row], "left")
        .withColumn(lines, _lines(F.col("text")))
        .select(*(text.alias(c) if c.lower() == "text" else quoted(c) for c in own), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"))
    )
