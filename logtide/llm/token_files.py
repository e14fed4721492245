"""Token-id files: one shared zstandard dictionary, each document compressed on its own.

Layout under one folder:

- ``dictionary``: one row ``dict_hash string, width int, content binary``;
- ``blocks``: rows of at most about ``block_bytes``, in ascending doc_id order within and across
  ``shard``: ``shard, block, first_doc_id, last_doc_id, tokens_before`` (within the shard),
  ``dict_hash, doc_ids[], offsets[], n_tokens[], data``.  ``data`` is the concatenation of the
  documents' zstandard frames and ``offsets`` their index, so one short document is read by
  filtering on first/last doc_id (pushed to Parquet), slicing and decompressing one frame.

Texts are encoded and compressed before the only shuffle, which carries the frames to ordered
shards.  A task holds one block at a time.  The dictionary is fitted on a bounded sample
(``sample_docs`` documents of smallest hash, of each a run of ``sample_ids`` ids whose place in the
whole document a hash chooses); every document is written.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import documents, shard_bounds, shuffle_partitions

BLOCKS = (
    "shard int, block int, first_doc_id long, last_doc_id long, tokens_before long, dict_hash string, "
    "doc_ids array<long>, offsets array<long>, n_tokens array<int>, data binary"
)


def train_dictionary(serialised: list[bytes], size: int = 64 << 10) -> bytes:
    """A zstandard dictionary for serialised id arrays; where they are too few to train on, their bytes
    themselves serve as a raw-content dictionary."""
    samples = [s for s in serialised if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or b"\0" * 8


def write(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 2,
    level: int = 3,
    sample_docs: int = 500,
    sample_ids: int = 4096,
    block_bytes: int = 1 << 20,
) -> None:
    """Encode every document and write the files under ``path``.

    Null text counts as empty (the end id alone); null doc_ids come first; equal rows are each
    written, ordered by their bytes; an empty table writes a dictionary and no blocks.
    """
    spark, docs = docs.sparkSession, documents(docs)
    width = 2 if max(tokens.encoder(tokenizer_path).size, end_id + 1) <= 1 << 16 else 4
    end = np.array([end_id], "<u4").tobytes()

    def sampled(batches):
        code = tokens.encoder(tokenizer_path)
        for batch in batches:
            for part in tokens.slices(batch):
                runs = []
                for ids in code.encode(part.column("text")):
                    ids = np.frombuffer(ids, "<u4")
                    at = zlib.crc32(ids.tobytes()) % max(1, len(ids) - sample_ids + 1)
                    runs.append(ids[at : at + sample_ids].astype(f"<u{width}").tobytes())
                yield pa.record_batch([part.column("doc_id"), pa.array(runs, pa.binary())], ["doc_id", "ids"])

    chosen = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    sample = docs.join(F.broadcast(chosen), "doc_id", "left_semi").mapInArrow(sampled, "doc_id long, ids binary")
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "ids").limit(sample_docs).collect()
    content = train_dictionary([bytes(r.ids) for r in sample])
    digest = hashlib.sha256(content).hexdigest()
    spark.createDataFrame([(digest, width, bytearray(content))], "dict_hash string, width int, content binary").coalesce(1).write.parquet(f"{path}/dictionary")

    bounds = shard_bounds(docs, shuffle_partitions(spark))
    edges = np.array(bounds, np.int64)

    def compress(batches):  # tells the shard too: a Python function of its own would be a second worker a task, with its own stems
        code, packer = tokens.encoder(tokenizer_path), zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(content))
        for batch in batches:
            for part in tokens.slices(batch, most=2_000_000):
                ids = [x + end for x in code.encode(part.column("text"))]
                frames = [packer.compress(np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes()) for x in ids]
                doc_id = part.column("doc_id")
                shard = np.where(doc_id.is_valid().to_numpy(zero_copy_only=False), np.searchsorted(edges, doc_id.fill_null(0).to_numpy(), side="right"), 0)
                yield pa.record_batch([doc_id, pa.array([len(x) // 4 for x in ids], pa.int32()), pa.array(frames, pa.binary()), pa.array(shard.astype(np.int32))], ["doc_id", "n_tokens", "frame", "shard"])

    def blocks(batches):
        shard = None
        held: list[tuple] = []
        size = block = before = 0

        def block_row():
            offsets = np.cumsum([0, *(len(x[2]) for x in held)])[:-1].tolist()
            known = [x[0] for x in held if x[0] is not None]
            row = (shard, block, min(known, default=None), max(known, default=None), before, digest, [x[0] for x in held], offsets, [x[1] for x in held], b"".join(x[2] for x in held))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            names = [f.split()[0] for f in BLOCKS.split(", ")]
            return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for s, doc_id, n, frame in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "n_tokens", "frame")), strict=True):
                if held and (s != shard or size + len(frame) > block_bytes):
                    yield block_row()
                    before, block = (before + sum(x[1] for x in held), block + 1) if s == shard else (0, 0)
                    held, size = [], 0
                shard = s
                held.append((doc_id, n, frame))
                size += len(frame)
        if held:
            yield block_row()

    frames = docs.mapInArrow(compress, "doc_id long, n_tokens int, frame binary, shard int")
    dealt = frames.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", "doc_id", "frame")
    dealt.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, with_ids: bool = False, doc_ids: list[int] | None = None) -> DataFrame:
    """One row a document: ``doc_id, start, n_tokens, ids_crc32`` and, if asked, its ``ids``.

    ``start`` counts the ids of all documents before it: blocks carry the count within their
    shard, and the shards' totals (as many rows as there were shards) are summed here.
    With ``doc_ids`` (a list that fits a plan) only the blocks that hold them are unpacked.  Null
    doc_ids come back as such, empty documents as their end id, an empty table as no rows.
    """
    stored = spark.read.parquet(f"{path}/dictionary").first()
    content, digest, width = bytes(stored.content), stored.dict_hash, stored.width
    if hashlib.sha256(content).hexdigest() != digest:
        raise ValueError("the dictionary does not match its hash")
    table = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = table.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()
    starts, total = {}, 0
    for r in sorted(totals, key=lambda r: r.shard):
        starts[r.shard] = total
        total += r.n
    wanted = None if doc_ids is None else set(doc_ids)
    if wanted is not None:  # the ends reach the Parquet scan, the list of ids settles each block
        few = F.lit(sorted(wanted)).cast("array<long>")
        table = table.where((F.col("first_doc_id") <= max(wanted, default=0)) & (F.col("last_doc_id") >= min(wanted, default=0)) & F.arrays_overlap("doc_ids", few))

    def unpack(batches):
        opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
        for batch in batches:
            for r in batch.to_pylist():
                if r["dict_hash"] != digest:
                    raise ValueError("a block was written with another dictionary")
                start, rows = starts[r["shard"]] + r["tokens_before"], []
                ends = [*r["offsets"][1:], len(r["data"])]
                for d, n, a, b in zip(r["doc_ids"], r["n_tokens"], r["offsets"], ends, strict=True):
                    if wanted is None or d in wanted:
                        ids = np.frombuffer(opener.decompress(r["data"][a:b], max_output_size=n * width), f"<u{width}").astype("<u4")
                        rows.append((d, start, len(ids), zlib.crc32(ids.tobytes())) + ((ids.astype("i4"),) if with_ids else ()))
                    start += n
                if rows:
                    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(kinds)])

    return table.mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
