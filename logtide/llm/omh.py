"""Order MinHash fingerprints: near for texts at a small edit distance.

After Marcais et al., "Locality-sensitive hashing for the edit distance" (2019).  A text's k-mers are
numbered by occurrence, so repeats count.  For each of ``sketches`` hash functions the ``picks``
(k-mer, occurrence) pairs of smallest hash are selected, put back in text order, and their k-mers
hashed as a tuple: two texts agree on a component only if they share the k-mers *and* their order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, mix, prefix_hash, shard_bounds, shard_of, shuffle_partitions, windows_hash

_PLACE = np.uint64((1 << 24) - 1)


def _occurrence_numbers(kmers: np.ndarray) -> np.ndarray:
    """How many equal k-mers (by the upper 40 bits of their hashes) stand before each."""
    n = len(kmers)
    if n <= int(_PLACE):  # hash and place in one word: one plain sort, no indirection
        packed = np.sort((kmers & ~_PLACE) | np.arange(n, dtype=np.uint64))
        group, place = packed >> np.uint64(24), (packed & _PLACE).astype(np.int64)
    else:
        group = kmers >> np.uint64(24)
        place = np.argsort(group, kind="stable")
        group = group[place]
    at = np.arange(n)
    start = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), at, 0))
    out = np.empty(n, np.int64)
    out[place] = at - start
    return out


class OrderMinHash:
    """Signatures of ``sketches`` 16-bit components over k-mers of ``k`` code points."""

    def __init__(self, k: int = 8, picks: int = 2, sketches: int = 64, seed: int = 7):
        random = np.random.default_rng(seed)
        self.k, self.picks, self.sketches = k, picks, sketches
        self.flip = random.integers(0, 1 << 32, sketches, dtype=np.uint32)
        self.times = random.integers(0, 1 << 31, sketches, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def signature(self, text: str) -> np.ndarray:
        """Texts shorter than ``k`` are one k-mer; the empty text has none, and only it agrees with itself."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.zeros(self.sketches, np.uint16)
        kmers = mix(windows_hash(prefix_hash(mix(points.astype(np.uint64) + np.uint64(1))), min(self.k, len(points))))
        numbered = (mix(kmers + _occurrence_numbers(kmers).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
        row = np.arange(self.sketches)
        least = place = None
        for at in range(0, len(kmers), 4096):
            h = (numbered[None, at : at + 4096] ^ self.flip[:, None]) * self.times[:, None]
            found, where = [], []
            for _ in range(min(self.picks, h.shape[1])):
                i = h.argmin(axis=1)
                found.append(h[row, i].astype(np.uint64))
                where.append(i + at)
                h[row, i] = np.uint32(0xFFFFFFFF)
            found, where = np.stack(found, 1), np.stack(where, 1)
            if least is not None:
                found, where = np.concatenate([least, found], 1), np.concatenate([place, where], 1)
                order = np.argsort(found, axis=1, kind="stable")[:, : self.picks]
                found, where = np.take_along_axis(found, order, 1), np.take_along_axis(where, order, 1)
            least, place = found, where
        tuples = kmers[np.sort(place, axis=1)]
        out = np.full(self.sketches, self.k, np.uint64)
        for j in range(tuples.shape[1]):
            out = mix(out * np.uint64(31) + tuples[:, j])
        return (out >> np.uint64(48)).astype(np.uint16) | np.uint16(1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal components, an estimate that falls with edit distance."""
    return float(np.mean(a == b))


def in_id_order(docs: DataFrame) -> DataFrame:
    """``doc_id, text, lead`` in ordered shards, each opened by the row before its first.

    Each row of a shard (``lead`` false) then follows the row that precedes it in ascending
    (doc_id, text); before the first row of all stands the last.  One shuffle carries every
    text once; which rows open another shard is settled on the id column alone.
    """
    docs = documents(docs)
    n = shuffle_partitions(docs.sparkSession)
    bounds = shard_bounds(docs, n)
    shard = shard_of(bounds)
    tops = docs.groupBy(shard("doc_id").alias("shard")).agg(F.max("doc_id").alias("top")).orderBy("shard").limit(n + 1).collect()
    opens: dict = {}
    for here, after in zip(tops, [*tops[1:], *tops[:1]], strict=True):
        opens[here.top] = after.shard
    own = docs.withColumn("shard", shard("doc_id")).withColumn("lead", F.lit(False))
    if None in opens:
        lead = own.where("doc_id is null").withColumns({"shard": F.lit(opens.pop(None)), "lead": F.lit(True)})
        own = own.union(lead)
    if opens:
        pairs = docs.sparkSession.createDataFrame([(int(d), int(s)) for d, s in opens.items()], "doc_id long, shard int")
        lead = docs.join(F.broadcast(pairs), "doc_id").select("doc_id", "text", "shard", F.lit(True).alias("lead"))
        own = own.union(lead)
    return own.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", F.desc("lead"), "doc_id", "text").drop("shard")


def with_next(docs: DataFrame, sketch: OrderMinHash | None = None) -> DataFrame:
    """Fingerprints of each document, of its edited text, and their likenesses.

    The next document is the one before it in ascending (doc_id, text) order; after the last comes
    the first.  The edited text has its last ``n_chars // 3`` code points replaced by as many of the
    next document's first (or all it has).  Null text counts as empty and a null doc_id as the
    smallest; a lone document follows itself; repeated rows follow one another; an empty table
    gives no rows.
    """
    sketch = sketch or OrderMinHash()

    def run(batches):
        before, its = "", None
        for b in batches:
            rows = []
            for doc_id, text, lead in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "lead")), strict=True):
                if lead:
                    before, its = text, None
                    continue
                its = sketch.signature(before) if its is None else its
                cut = len(text) // 3
                edited = text[: len(text) - cut] + before[:cut] if cut else text
                own = sketch.signature(text)
                changed = sketch.signature(edited) if cut else own
                digest = hashlib.sha256(edited.encode()).hexdigest()
                rows.append((doc_id, len(text), digest, own.astype(">u2").tobytes().hex(), changed.astype(">u2").tobytes().hex(), likeness(own, changed), likeness(own, its)))
                before, its = text, own
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_id_order(docs).mapInArrow(run, schema)
