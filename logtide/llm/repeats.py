"""Exact repeated windows over a corpus: what both substring de-duplicators share.

A window is ``length`` consecutive units (bytes or words) of one row.  Windows are filed under
anchors so that equal windows always meet.  An *occurrence* is an anchor at a place with the range of
windows filed there and a hash of the range's whole content.  ``matched`` then works on occurrences:

1. Anchors held once are dropped after a map-side combined count.
2. Copies collapse: occurrences of an anchor with equal content are one, and where all of an
   anchor's are equal nothing is left to compare.
3. Of the others one occurrence per content is fetched, and a task compares the contents of an
   anchor by the operator's own method (suffix order, or extension of block hits).
4. Anchors with over ``dense`` contents send their windows' hashes through an ordinary aggregation.

Only hashes, ranges and the fetched contents are shuffled besides the text's single exchange; hot
keys are looked up by a broadcast of at most ``HOT`` rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup_weighted, materialise, mix, prefix_hash, spans_hash, windows_hash

#: ``off`` is where the anchor lies in the content, for operators that need it.
OCCURRENCE = "doc long, th long, lo int, n int, off int, anchor long, rng long"
#: Which repeated windows go: all; all but the first by (doc, th, lo); those that a smaller doc has.
ANYWHERE, LATER, SMALLER_DOC = "anywhere", "later", "smaller doc"
_POS = np.uint64((1 << 24) - 1)


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values (block-wise running minima)."""
    blocks = -(-len(a) // width)
    padded = np.full(blocks * width, np.iinfo(a.dtype).max, a.dtype)
    padded[: len(a)] = a
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(a) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


Occurrences = tuple[np.ndarray, ...]
Compare = Callable[[list[tuple]], tuple[np.ndarray, np.ndarray] | None]


def _in_stretches(values: np.ndarray, length: int, step: int, one: Callable[[np.ndarray], Occurrences]) -> Occurrences:
    """Occurrences over stretches of at most ``step`` window starts, so places fit in 24 bits."""
    out = []
    for at in range(0, max(0, len(values) - length + 1), step):
        lo, *rest = one(values[at : at + step + length - 1])
        out.append((lo + at, *rest))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _chosen(grams: np.ndarray, width: int) -> np.ndarray:
    """For each stretch of ``width`` grams, the place of its smallest (leftmost of equals)."""
    packed = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
    return (sliding_min(packed, width) & _POS).astype(np.int64)


def range_hash(prefix: np.ndarray, lo: np.ndarray, n: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Of the content of the windows [lo, lo + n), with where the gram lies in it."""
    return mix(spans_hash(prefix, lo, lo + n - 1 + length) ^ mix(((place - lo) * (1 << 20) + n).astype(np.uint64)))


def by_window(values: np.ndarray, length: int, gram: int) -> Occurrences:
    """``lo, n, off, anchor, rng`` of a row: each window's anchor is the gram of smallest hash in it, so runs
    of windows share one and each window has exactly one."""

    def one(part: np.ndarray) -> Occurrences:
        prefix = prefix_hash(part)
        grams = mix(windows_hash(prefix, gram))
        chosen = _chosen(grams, length - gram + 1)
        lo = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        n = np.diff(np.concatenate([lo, [len(chosen)]]))
        place = chosen[lo]
        return lo, n, place - lo, grams[place], range_hash(prefix, lo, n, place, length)

    return _in_stretches(values, length, 1 << 23, one)


def occurrence_rows(filed: Callable[[dict], Occurrences], *columns: str):
    """A ``mapInArrow`` function: ``filed`` gives ``lo, n, off, anchor, rng`` of a row's ``columns``."""

    def run(batches):
        for b in batches:
            cols: list[list] = [[], [], [], [], [], [], []]
            for doc, th, *row in zip(b.column("doc").to_pylist(), b.column("th").to_pylist(), *(b.column(c) for c in columns), strict=True):
                lo, n, off, anchor, rng = filed(*(x.as_py() for x in row))
                if len(lo):
                    out = (np.full(len(lo), doc, np.int64), np.full(len(lo), th, np.int64), lo.astype(np.int32), n.astype(np.int32), off.astype(np.int32), anchor.view(np.int64), rng.view(np.int64))
                    for c, x in zip(cols, out, strict=True):
                        c.append(x)
            if cols[0]:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in cols], [f.split()[0] for f in OCCURRENCE.split(", ")])

    return run


def _fetch_rows(pack: Callable[[bytes, list], list[bytes]]):
    """Contents asked of each row: ``anchor, doc, th, lo, content``."""

    def run(batches):
        for b in batches:
            for doc, th, data, asked in zip(b.column("doc").to_pylist(), b.column("th").to_pylist(), b.column("data"), b.column("asked").to_pylist(), strict=True):
                got = pack(data.as_py(), [(a["lo"], a["n"], a["off"]) for a in asked])
                m = len(asked)
                yield pa.record_batch(
                    [pa.array([a["anchor"] for a in asked], pa.int64()), pa.array([doc] * m, pa.int64()), pa.array([th] * m, pa.int64()), pa.array([a["lo"] for a in asked], pa.int32()), pa.array(got, pa.binary())],
                    ["anchor", "doc", "th", "lo", "content"],
                )

    return run


def _compared(compare: Compare, held_bytes: int):
    """Contents in order of anchor, doc, th and lo in; runs of matched windows ``doc, th, lo, n`` out.

    ``compare`` takes whole anchors and gives each content's number of windows and, for all windows
    one after another, whether they match."""

    def judged(rows: list[tuple]):
        if len(rows) < 2:
            return None
        sizes, found = compare(rows)
        row = np.repeat(np.arange(len(rows)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.flatnonzero(found)
        if not len(at):
            return None
        new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(row[at]) != 0)])
        first = at[new]
        n = np.diff(np.concatenate([np.flatnonzero(new), [len(at)]]))
        who = row[first]
        docs, ths, los = (np.array([r[i] for r in rows]) for i in (1, 2, 3))
        return pa.record_batch([pa.array(docs[who].astype(np.int64)), pa.array(ths[who].astype(np.int64)), pa.array((los[who] + place[first]).astype(np.int32)), pa.array(n.astype(np.int32))], ["doc", "th", "lo", "n"])

    def run(batches):
        held: list[tuple] = []
        size, last = 0, None
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("anchor", "doc", "th", "lo", "content")), strict=True):
                if size > held_bytes and r[0] != last:
                    if (out := judged(held)) is not None:
                        yield out
                    held, size = [], 0
                held.append(r)
                size += len(r[4])
                last = r[0]
        if held and (out := judged(held)) is not None:
            yield out

    return run


def _window_rows(window_keys: Callable[[bytes], np.ndarray]):
    """For anchors with very many contents: one row a window, ``key, doc, th, lo``."""

    def run(batches):
        for b in batches:
            keys = [window_keys(c.as_py()) for c in b.column("content")]
            sizes = np.array([len(k) for k in keys])
            if sizes.sum():
                inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                lo = np.repeat(b.column("lo").to_numpy(), sizes) + inner
                yield pa.record_batch(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(b.column("doc").to_numpy(), sizes)), pa.array(np.repeat(b.column("th").to_numpy(), sizes)), pa.array(lo.astype(np.int32))],
                    ["key", "doc", "th", "lo"],
                )

    return run


def matched(
    rows: DataFrame,
    found: DataFrame,
    pack: Callable[[bytes, list], list[bytes]],
    compare: Compare,
    window_keys: Callable[[bytes], np.ndarray],
    rule: str,
    dense: int,
    held_bytes: int = 2 << 20,
) -> DataFrame:
    """Runs of windows ``doc, th, lo, n`` that go by ``rule``, from the occurrences ``found``.

    ``rows`` has ``doc long, th long, data binary``; equal (doc, th) must mean equal rows, so ``th`` is a
    64-bit hash of the text: rows without a doc_id, or with one in common, are told apart by it alone.  ``pack``
    takes a row and (lo, n, off) and gives contents, of which ``compare`` judges the windows and
    ``window_keys`` gives their 64-bit hashes.
    """
    place = F.struct("doc", "th", "lo")
    by_doc = rule == SMALLER_DOC
    held = found.groupBy("anchor").agg(
        F.count("*").alias("weight"), F.min("rng").alias("r0"), F.max("rng").alias("r1"), F.min("doc").alias("first"), F.max("doc").alias("last"), *([F.min(place).alias("one")] if rule == LATER else [])
    )
    held = held.where(F.col("first") < F.col("last") if by_doc else F.col("weight") > 1).select("anchor", "weight", (F.col("r0") == F.col("r1")).alias("alike"), "first", *(["one"] if rule == LATER else []))
    shared = materialise(lookup_weighted(found, materialise(held, "anchors"), ["anchor"]), "occurrences")

    mixed = shared.where("not alike").select("doc", "th", "lo", "n", "off", "anchor", "rng")
    contents = materialise(mixed.groupBy("anchor", "rng").agg(F.count("*").alias("weight"), F.min("doc").alias("first"), F.min(place).alias("one")), "contents")
    judged = lookup_weighted(mixed, contents, ["anchor", "rng"])
    runs = ("doc", "th", "lo", "n")
    gone = {ANYWHERE: F.lit(True), LATER: place != F.col("one") if rule == LATER else None, SMALLER_DOC: F.col("doc") > F.col("first")}[rule]
    settled = shared.where("alike").where(gone).select(*runs).union(judged.where("weight > 1" if rule == ANYWHERE else place != F.col("one") if rule == LATER else "doc > first").select(*runs))
    asked = judged.where("doc = first" if by_doc else place == F.col("one")).groupBy("doc", "th").agg(F.collect_list(F.struct("lo", "n", "off", "anchor")).alias("asked"))
    fetched = materialise(rows.join(asked.hint("merge"), ["doc", "th"]).mapInArrow(_fetch_rows(pack), "anchor long, doc long, th long, lo int, content binary"), "fetched")
    many = contents.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > dense).select("anchor")
    many = materialise(many, "many-contents")
    if many.isEmpty():
        few, windows = fetched, None
    else:
        few = fetched.join(many, "anchor", "left_anti")
        windows = fetched.join(many, "anchor", "left_semi").mapInArrow(_window_rows(window_keys), "key long, doc long, th long, lo int")
    order = few.repartition("anchor").sortWithinPartitions("anchor", "doc", "th", "lo")
    out = settled.union(order.mapInArrow(_compared(compare, held_bytes), "doc long, th long, lo int, n int"))
    if windows is not None:
        same = windows.groupBy("key").agg(F.count("*").alias("weight"), F.min("doc").alias("first"), *([F.min(place).alias("one")] if rule == LATER else [])).where("weight > 1")
        hits = lookup_weighted(windows, materialise(same, "windows"), ["key"]).where(gone)
        out = out.union(hits.select("doc", "th", "lo", F.lit(1).alias("n")))
    return out
