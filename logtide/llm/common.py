"""Helpers shared by the training-data operators: ordered shards, skew-proof joins, hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialise, scratch_path

__all__ = ["materialise", "scratch_path"]

#: ASCII white space of the contracts, `[\x20\x09-\x0D]`; ``bytes.split()`` cuts at the same six.
WHITE = " \t\n\x0b\x0c\r"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_names(docs: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``docs`` does not have in any case, like those wanted."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def own_columns(docs: DataFrame, *new: str) -> list[str]:
    """The columns of ``docs`` but for those named, in any case, like new ones."""
    return [c for c in docs.columns if c.lower() not in {n.lower() for n in new}]


def quoted(name: str) -> Column:
    """A column by its whole name, dots and back-ticks too."""
    return F.col("`" + name.replace("`", "``") + "`")


def documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone (null text: empty), whatever else the table carries."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: At most so many keys can each own a HOT-th of the rows that a table's weights count.
HOT = 1024


def lookup_weighted(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of ``left`` to ``right``, whose ``weight`` says how many left rows each key has.

    Keys (longs) that own more than a ``HOT``-th of all weight are at most ``HOT`` rows: these alone
    are broadcast, and their left rows go through the shuffle under spread-out stand-in keys.  Lesser
    keys that outgrow a task are left to Spark's adaptive skew join, which splits their left rows.
    ``right`` is a durable table (read three times), unique by ``keys``; ``left`` is read once.
    """
    total = right.agg(F.sum("weight")).first()[0] or 0
    bar = max(1000, total // HOT)
    hot = right.where(right["weight"] > bar)
    if total <= bar or hot.isEmpty():
        return left.join(right, keys)
    values = [c for c in right.columns if c not in keys]
    hot = hot.select(*keys, F.struct(*values).alias("_hot"))
    light = right.where(right["weight"] <= bar).select(*(F.col(k).alias(f"_{k}") for k in keys), F.struct(*values).alias("_light"))
    spread = F.xxhash64(*left.columns)
    both = left.join(F.broadcast(hot), keys, "left").withColumns(
        {f"_{k}": F.when(F.col("_hot").isNull(), F.col(k)).otherwise(spread) for k in keys}
    )
    both = both.join(light, [f"_{k}" for k in keys], "left").withColumn("_hot", F.coalesce("_hot", "_light"))
    return both.where("_hot is not null").select(*left.columns, *(F.col(f"_hot.{v}").alias(v) for v in values))


def shard_bounds(ids: DataFrame, shards: int) -> list[int]:
    """At most ``shards - 1`` ascending doc_ids that cut the table into even, ordered shards.

    One pass over the id column; quantile sketches merge map-side, and what reaches the
    driver is bounded by ``shards``.  Same rows give the same bounds whatever their layout
    up to the sketch's error, and any bounds give the same results downstream.
    """
    if shards < 2:
        return []
    at = [i / shards for i in range(1, shards)]
    row = ids.select(F.percentile_approx("doc_id", at, 10 * max(100, shards)).alias("q")).first()
    return sorted(set(row.q or []))


def shard_of(bounds: list[int]):
    """A column function from doc_id to its shard: how many bounds lie at or below (null: 0)."""
    edges = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def shard(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), dtype=np.int32)
        out[known] = np.searchsorted(edges, ids[known].astype("int64").to_numpy(), side="right")
        return pd.Series(out)

    return shard


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


# ---- substring hashes ------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, 0 to n at least."""
    if len(_powers["up"]) <= n:
        m = max(2 * n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            p = np.full(m + 1, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (xor-shift-multiply rounds, a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of value * base**i: any substring's hash is then two look-ups."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def spans_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [start, end), the same wherever they lie."""
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def windows_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all substrings of ``width``."""
    if len(prefix) <= width:
        return np.zeros(0, np.uint64)
    _, down = powers(len(prefix))
    return (prefix[width:] - prefix[:-width]) * down[: len(prefix) - width]


def byte_values(data: bytes) -> np.ndarray:
    return _TABLE[np.frombuffer(data, np.uint8)]


def batch_words(texts: pa.Array, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts of a batch: runs of bytes whose ``kind`` is 0, within one text.

    Returns the texts' bytes one after another, their bounds (one more than texts), and each word's start, end
    and text.
    """
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    bounds = ends - ends[0]
    opens = np.zeros(len(data) + 1, bool)
    opens[bounds] = True
    inside = kind[data] == 0
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | opens[1:-1]
    end[:-1] &= ~inside[1:] | opens[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return data, bounds, start, end, np.searchsorted(bounds, start, side="right") - 1


_SPACE = np.zeros(256, bool)
_SPACE[list(WHITE.encode())] = True


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (byte offsets) of the words `[^\\x20\\x09-\\x0D]+`."""
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_SPACE[np.frombuffer(data, np.uint8)]
    d = np.diff(inside)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash for each word of a text."""
    start, end = word_spans(data)
    if not len(start):
        return np.zeros(0, np.uint64)
    h = spans_hash(prefix_hash(byte_values(data)), start, end)
    return mix(h + (end - start).astype(np.uint64))
