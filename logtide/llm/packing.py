"""Cost-balanced packing of token sequences.

A document's cost is estimated as ``linear * n + quadratic * n**2`` (projections and attention).
Documents are taken in descending length; each goes whole to the sequence of lowest cost that
still has room for it, and where none has, it is cut at the room of the lowest-cost open sequence.
The sequences' capacities add up to exactly the tokens at hand: full sequences, and the rest as
powers of two, which need no padding.

Spark partitions the work: each task streams its input split through groups of at most
``group_tokens`` tokens (longer documents are cut at the edge of a group), so memory is bounded,
nothing is shuffled, and a lost task is simply redone from its split.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import tokens
from .common import documents

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def capacities(total: int, capacity: int) -> list[int]:
    """Sequence lengths that hold ``total`` tokens exactly: full ones, then powers of two."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 4096) -> list[tuple]:
    """Pieces ``(item, start, length, sequence, offset)`` that fill ``capacities(sum(lengths))``.

    Every token lies in exactly one piece and every sequence is gapless from 0.  Ties go to the
    earlier item and the lower sequence, so equal input gives equal output.
    """
    room = np.array(capacities(sum(lengths), capacity), dtype=np.int64)
    cost, used = np.zeros(len(room)), np.zeros(len(room), dtype=np.int64)
    pieces: list[tuple] = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[item]
        while left:
            fits = np.where(room >= left, cost, np.inf)
            best = int(np.argmin(fits))
            if not np.isfinite(fits[best]):  # cut: fill the cheapest open sequence
                best = int(np.argmin(np.where(room > 0, cost, np.inf)))
            n = int(min(left, room[best]))
            pieces.append((item, start, n, best, int(used[best])))
            cost[best] += linear * n + quadratic * n * n
            room[best] -= n
            used[best] += n
            start, left = start + n, left - n
    return pieces


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, group_tokens: int = 1 << 21, with_ids: bool = False
) -> DataFrame:
    """Tokenise ``docs`` and pack them; one row a piece, with its ids if ``with_ids``.

    ``sequence_id`` is unique over the whole table: the task's number in the high bits, the
    sequence's in the low 33.  Null text counts as empty and gives the end id alone; equal rows
    are packed once each; an empty table gives no rows; other columns are ignored.
    """
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches):
        code = tokens.encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 33
        group, held = [], 0

        def packed():
            nonlocal sequence
            out = assign([len(x[2]) // 4 for x in group], capacity)
            rows = []
            for item, start, n, place, offset in out:
                doc_id, before, ids, whole = group[item]
                part = ids[4 * start : 4 * (start + n)]
                row = (doc_id, before + start, n, zlib.crc32(part), whole, sequence + place, offset)
                rows.append(row + ((np.frombuffer(part, "<u4").astype("i4"),) if with_ids else ()))
            sequence += max(p[3] for p in out) + 1
            names = [f.split()[0] for f in schema.split(", ")]
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for part in tokens.slices(batch):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), code.encode(part.column("text")), strict=True):
                    ids += end
                    whole, before = len(ids) // 4, 0
                    while before < whole:
                        n = min(whole - before, group_tokens - held)
                        group.append((doc_id, before, ids[4 * before : 4 * (before + n)], whole))
                        before, held = before + n, held + n
                        if held == group_tokens:
                            yield packed()
                            group, held = [], 0
        if group:
            yield packed()

    return documents(docs).mapInArrow(run, schema)
