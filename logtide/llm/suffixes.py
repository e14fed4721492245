"""Byte-level substring de-duplication by suffix order and longest previous factors.

One suffix array of a corpus would be one task, so windows that can be equal are first brought
together under content-chosen anchors (``repeats``).  The contents of an anchor are then put in
suffix order, compared to ``length`` bytes.  The previous and the next smaller places in that order
give each window's longest previous factor, the longest match that starts earlier; the same with
places reversed gives its longest next factor.  A window whose factor reaches ``length`` repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, materialise, mix, prefix_hash, windows_hash
from .repeats import ANYWHERE, LATER, OCCURRENCE, by_window, matched, occurrence_rows


class SuffixOrder:
    """Suffix order of texts put one after another, up to ``depth`` bytes.

    ``ends`` gives for each place where its text ends, ``group`` a number whose texts alone may match.
    ``levels`` holds, for widths 4, 8, 16 ... and ``depth``, each place's rank among all by its first
    ``width`` bytes: equal ranks are equal bytes.  Each level sorts only the places that the last left tied.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, group: np.ndarray, depth: int):
        self.data, self.ends, self.group, self.depth = data, ends, group, depth
        n, width = len(data), min(4, depth)
        padded = np.concatenate([data, np.zeros(width, np.uint8)])
        key = group.astype(np.uint64)
        for k in range(width):
            key = (key << np.uint64(8)) | padded[k : k + n]
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])[:n]
        rank = np.full(n + 1, -1, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        tied = np.sort(order[~(new & np.concatenate([new[1:], [True]])[:n])])
        self.levels = [(width, rank.astype(np.int32))]
        while width < depth:
            step = min(width, depth - width)
            pair = (rank[tied] << 32) | (rank[np.minimum(tied + step, n)] + 1)
            order = np.argsort(pair, kind="stable")
            pair, at = pair[order], np.arange(len(tied))
            new = np.concatenate([[True], pair[1:] != pair[:-1]])[: len(tied)]
            old = np.concatenate([[True], (pair[1:] >> 32) != (pair[:-1] >> 32)])[: len(tied)]
            moved = np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(old, at, 0))
            rank[tied[order]] += moved
            tied = np.sort(tied[order][~(new & np.concatenate([new[1:], [True]])[: len(tied)])])
            width += step
            self.levels.append((width, rank.astype(np.int32)))
        self.rank, self.tied = rank, tied

    def match(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at ``i`` and ``j`` share, at most ``depth``; -1 for no place is none."""
        n = len(self.data)
        out = np.zeros(len(i), np.int64)
        room = np.where(j >= 0, np.minimum(self.ends[i] - i, self.ends[j] - j), 0)
        room = np.where(self.group[i] == self.group[j], room, 0)
        for width, rank in reversed(self.levels):
            more = rank[np.minimum(i + out, n)] == rank[np.minimum(j + out, n)]
            out += np.where(more & (out < room), width, 0)
        for _ in range(3):
            a, b = np.minimum(i + out, n - 1), np.minimum(j + out, n - 1)
            out += (self.data[a] == self.data[b]) & (out < room)
        return np.minimum(np.minimum(out, room), self.depth)

    def factors(self, places: np.ndarray, next: bool = False) -> np.ndarray:
        """Longest previous (or next) factor at each of ``places`` among them, at most ``depth``."""
        order = np.lexsort((-places if next else places, self.rank[places]))
        at = places[order]
        before, after = smaller_neighbours(-at if next else at)
        best = np.zeros(len(at), np.int64)
        for other in (before, after):
            best = np.maximum(best, self.match(at, np.where(other >= 0, at[other], -1)))
        out = np.empty(len(at), np.int64)
        out[order] = best
        return out


def smaller_neighbours(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the previous and of the next smaller value of each (-1: none), by minima of doubling stretches."""
    n = len(a)
    out = []
    for values in (a, a[::-1]):
        minima = [values]
        while 1 << len(minima) <= n:
            last, width = minima[-1], 1 << (len(minima) - 1)
            longer = last.copy()
            longer[width:] = np.minimum(last[width:], last[:-width])
            minima.append(longer)  # over the stretch of 2 ** level that ends here, or all from the start
        at = np.arange(n) - 1
        for level in range(len(minima) - 1, -1, -1):
            low = (at >= 0) & (minima[level][np.maximum(at, 0)] > values)
            at = np.where(low, np.maximum(at - (1 << level), -1), at)
        out.append(at)
    before, after = out[0], out[1][::-1]
    return before, np.where(after >= 0, n - 1 - after, -1)


def longest_previous_factor(data: bytes) -> np.ndarray:
    """LPF of one string: at i the length of the longest match of data[i:] that starts before i."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    order = SuffixOrder(np.frombuffer(data, np.uint8), np.full(n, n), np.zeros(n, np.int64), n)
    return order.factors(np.arange(n))


def _by_suffix_order(length: int, rule: str):
    """Compares contents of whole anchors: which windows have a factor of ``length``."""

    def compare(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        contents = [r[4] for r in rows]
        size = np.array([len(c) for c in contents])
        ends = np.cumsum(size)
        anchors = np.array([r[0] for r in rows])
        group = np.cumsum(np.concatenate([[0], anchors[1:] != anchors[:-1]]))
        order = SuffixOrder(np.frombuffer(b"".join(contents), np.uint8), np.repeat(ends, size), np.repeat(group, size), length)
        windows = np.maximum(size - length + 1, 0)
        first = np.repeat(ends - size, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        tied = np.zeros(len(order.data), bool)
        tied[order.tied] = True  # no other window shares its bytes: its factors are shorter than ``length``
        found = tied[first]
        places = first[found]
        reach = order.factors(places)
        if rule == ANYWHERE:
            reach = np.maximum(reach, order.factors(places, next=True))
        found[found] = reach >= length
        return windows, found

    return compare


def repeated_ranges(docs: DataFrame, length: int, gram: int = 32, dense: int = 4000, keep_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows ``doc, th, data`` dealt by row, and runs of repeated windows ``doc, th, lo, n``."""
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"),
        F.coalesce("text", F.lit("")).cast("binary").alias("data"),
    )

    def pack(data: bytes, ranges: list) -> list[bytes]:
        return [data[lo : lo + n - 1 + length] for lo, n, _ in ranges]

    def window_keys(content: bytes) -> np.ndarray:
        return mix(windows_hash(prefix_hash(byte_values(content)), length))

    rule = LATER if keep_first else ANYWHERE
    found = rows.mapInArrow(occurrence_rows(lambda data: by_window(byte_values(data), length, gram), "data"), OCCURRENCE)
    return rows, matched(rows, found, pack, _by_suffix_order(length, rule), window_keys, rule, dense)


def cut_spans(data: bytes, spans: list, length: int) -> tuple[bytes, int, int]:
    """Remaining bytes, removed bytes and removed runs after cutting windows ``(lo, n)``."""
    if not spans:
        return data, 0, 0
    edge = np.zeros(len(data) + 1, np.int64)
    lo = np.array([s["lo"] for s in spans])
    n = np.array([s["n"] for s in spans])
    np.add.at(edge, lo, 1)
    np.add.at(edge, lo + n - 1 + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 32, dense: int = 4000, keep_first: bool = False) -> DataFrame:
    """``doc_id, data, n_bytes, n_removed, n_spans``: texts as UTF-8 without bytes that repeat.

    A byte goes if a ``length``-byte string covers it that also starts anywhere else, in another
    row or the same one; with ``keep_first`` only if it also starts earlier, in order of doc_id, a hash
    of the text and place, so the first copy stays.  Strings are judged on the input.  ``data`` is what is left (a cut may fall
    inside a character).  Null text counts as empty; shorter texts stay whole; repeated rows are
    copies of each other (with ``keep_first`` they are one row, and stay or go together); null doc_ids are
    kept; an empty table stays empty; other columns of ``docs`` are not returned, whatever their names.
    """
    rows, runs = repeated_ranges(docs, length, gram, dense, keep_first)
    spans = materialise(runs.groupBy("doc", "th").agg(F.collect_list(F.struct("lo", "n")).alias("spans")), "spans")

    def cut(batches):
        for b in batches:
            out = [cut_spans(d.as_py(), s or [], length) for d, s in zip(b.column("data"), b.column("spans").to_pylist(), strict=True)]
            ids = [None if d == -(1 << 63) else d for d in b.column("doc").to_pylist()]
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] + len(o[0]) for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())],
                ["doc_id", "data", "n_bytes", "n_removed", "n_spans"],
            )

    return rows.join(spans.hint("merge"), ["doc", "th"], "left").mapInArrow(cut, "doc_id long, data binary, n_bytes long, n_removed long, n_spans long")
