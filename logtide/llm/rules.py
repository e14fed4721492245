"""Quality rules: a base of surface rules and a hashed n-gram log-likelihood ratio.

Texts become bags of hashed byte n-grams.  Two multinomials over the buckets, one of trusted target
documents and one of the raw corpus, give each gram the weight log(p_target / p_raw); a document's
score is the mean weight of its grams, so length plays no part, and a document is kept if the score
reaches the threshold: one given, or 0 (likelier as target than as raw) lowered where needed to keep
``keep_trusted`` of the trusted documents, whose mix of languages may differ.  The raw counts cover every document, the
target counts and the threshold every trusted one.  What reaches the driver is one row a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialise, mix, word_hashes

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 9, 10, 11, 12, 13]] = True
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def grams(data: bytes, buckets: int) -> np.ndarray:
    """Buckets of a text's byte trigrams."""
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, np.uint32)
    code = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(12)) % np.uint32(buckets)


def surface(data: bytes, window: int = 5) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a UTF-8 text."""
    a = np.frombuffer(data, np.uint8)
    word_chars = int(np.count_nonzero(~_WHITE[a] & ((a & 0xC0) != 0x80)))
    lines = [line for line in data.split(b"\n") if line.strip()]
    h = word_hashes(data)
    n, repeated = len(h), 0
    if n > window:
        w = np.zeros(n - window + 1, np.uint64)
        for i in range(window):
            w = mix(w * np.uint64(31) + h[i : n - window + 1 + i])
        order = np.argsort(w, kind="stable")
        same = w[order][1:] == w[order][:-1]
        if same.any():
            twice = np.zeros(len(w), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            edge = np.zeros(n + 1, np.int64)
            edge[: len(w)] += twice
            edge[window:] -= twice
            repeated = int(np.count_nonzero(np.cumsum(edge[:-1])))
    return n, word_chars, int(np.count_nonzero(_SYMBOL[a])), len(lines) - len(set(lines)), repeated


def bucket_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """``bucket, n`` of the grams of all texts, summed in each task before the shuffle."""

    def run(batches):
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for data in b.column("data"):
                g = grams(data.as_py(), buckets)
                if len(g) < buckets // 16:
                    np.add.at(n, g, 1)
                else:
                    n += np.bincount(g, minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(n[at])], ["bucket", "n"])

    return docs.select("data").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gram_counts(docs: DataFrame, trusted: set[int], buckets: int) -> DataFrame:
    """``bucket, raw, target``: counts over the whole table, and over the rows with a doc_id of a short list."""
    target = bucket_counts(docs.where(F.col("doc_id").isin(*trusted)), buckets).withColumnRenamed("n", "target")
    both = bucket_counts(docs, buckets).withColumnRenamed("n", "raw").join(target, "bucket", "left")
    return both.select("bucket", "raw", F.coalesce("target", F.lit(0)).alias("target"))


def weights(counts: DataFrame, buckets: int, smoothing: float = 1.0) -> np.ndarray:
    """log(p_target / p_raw) per bucket, add-one smoothed; zeros where there is no target text."""
    raw, target = np.full(buckets, smoothing), np.full(buckets, smoothing)
    for r in counts.collect():
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    if target.sum() == smoothing * buckets:
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def trusted_rows(rows: DataFrame, trusted: DataFrame, bits: int = 1 << 25) -> DataFrame:
    """The ``rows`` whose doc_id is one of ``trusted`` (distinct), read whole, without a shuffle of the other rows' texts.

    A broadcast bitmap of hashed ids, at most ``bits`` / 64 rows however long the list, lets pass all trusted rows and few
    others; only what passes is shuffled to the exact join.  The join never turns into a broadcast of the list, so
    what is written grows with the table.
    """
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at(c), F.lit(64)).cast("int"))
    word = lambda c: F.floor(at(c) / 64).cast("int").alias("_word")
    words = trusted.groupBy(word("doc_id")).agg(F.bit_or(bit("doc_id")).alias("_bits"))
    near = rows.withColumn("_word", word("doc_id")).join(F.broadcast(words), "_word").where(F.col("_bits").bitwiseAND(bit("doc_id")) != 0)
    return near.select(*rows.columns).join(trusted.hint("merge"), "doc_id")  # a semi join would be pushed below the bitmap


def _scores(weight: np.ndarray, buckets: int):
    def run(batches):
        for b in batches:
            base, score = [], []
            for data in b.column("data"):
                data = data.as_py()
                base.append(surface(data))
                g = grams(data, buckets)
                score.append(float(weight[g].mean(dtype=np.float64)) if len(g) else 0.0)
            cols = [pa.array(np.array(c, np.int64)) for c in zip(*base, strict=True)] or [pa.array([], pa.int64())] * 5
            names = [f.split()[0] for f in BASE.split(", ")]
            yield pa.record_batch([b.column("doc_id"), *cols, pa.array(score, pa.float64())], ["doc_id", *names, "llr"])

    return run


def nth_smallest(table: DataFrame, column: str, at: int, few: int = 10_000, bins: int = 1024) -> float:
    """The number at place ``at`` (from 0) of a written table's finite doubles in order, exactly: counts of ever narrower
    bins, at most ``bins`` rows each time, until at most ``few`` numbers are left."""
    value = F.col(column)
    low, high, n = table.agg(F.min(value), F.max(value), F.count(value)).first()
    while low < high:
        inside = table.where(value.between(low, high))
        if n <= few:
            return sorted(r[0] for r in inside.select(value).collect())[at]
        if not (width := (high - low) / bins):
            break
        place = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        for r in sorted(inside.groupBy(place.alias("bin")).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n")).collect()):
            if at < r.n:
                low, high, n = r.low, r.high, r.n
                break
            at -= r.n
    return low


def judge(docs: DataFrame, labels: DataFrame, threshold: float | None = None, keep_trusted: float = 0.995, buckets: int = 1 << 16) -> DataFrame:
    """``doc_id``, the base figures, ``base_failed``, ``llr`` and ``kept`` for every row of ``docs``.

    ``labels`` names trusted documents (quality 1, toxic 0; null labels are not trusted).  Base
    failures: fewer than 10 words, or over 20 % of words in 5-word windows found twice.  Null or
    empty text fails the base and scores 0, as does text under three bytes; with no trusted text
    every score is 0 and the base alone decides.  Repeated rows each get their verdict.
    """
    trusted = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    rows = documents(docs).select("doc_id", F.col("text").cast("binary").alias("data"))
    raw = bucket_counts(rows, buckets).withColumnRenamed("n", "raw").withColumn("target", F.lit(0).cast("long"))
    # few tasks, as each gives a row a bucket; texts stream through them
    target = trusted_rows(rows, trusted).coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism)
    counts = raw.union(bucket_counts(target, buckets).select("bucket", F.lit(0).cast("long"), "n"))
    weight = weights(counts, buckets).astype(np.float32)

    scored = rows.mapInArrow(_scores(weight, buckets), f"doc_id long, {BASE}, llr double")
    if threshold is None:
        scored = materialise(scored, "scored")  # figures alone, so the trusted rows' scores are joined without their texts
        known = materialise(scored.select("doc_id", "llr").join(trusted.hint("merge"), "doc_id", "left_semi").select("llr"), "trusted-scores")
        n = known.count()
        threshold = min(0.0, nth_smallest(known, "llr", int((1 - keep_trusted) * n))) if n else 0.0

    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
