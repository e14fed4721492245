"""Phrase collocations: frequent phrases of two to five words and how well their cuts explain them.

Phrases grow level by level.  A phrase of k + 1 words is looked at only where both its parts of k words
are frequent, so no frequent phrase is missed (Apriori).  It is named by an exact key: the slot of its
first k words and the slot of its last word.  Tasks tell how often they met each key, no more than the bar;
keys that reach the bar in sum are the candidates.  Each level's candidates get a minimal perfect hash
(``slots``), which checks the stored key.  In one scan a level, tasks look their keys up, count slots in an
array (bincount) and write the keys of the next level; the arrays of all tasks are summed in a tree.  All
further reading goes by slot: the parts of each cut, the longer phrases that swallow a shorter one.

Nothing grows with the corpus on the driver or in a task: hashes are broadcast in blocks of at most
``block_slots`` keys, one scan a block.  Words are known by a 64-bit hash with their language.  Streams are written
in rows of about ``_RUN`` keys: pages and Arrow batches hold a number of rows whatever their size, and buffers for
them lie outside the heap.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import batch_words, byte_values, materialise, mix, prefix_hash, shuffle_partitions, spans_hash
from .slots import GAP, Block, build, part_of

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = byte_values(_LOWER.tobytes())
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b"\t ")] = 1
_CLASS[list(b".,;:!?\n\x0b\x0c\r")] = 2
_HALF = np.uint64(32)
_FAN_IN = 16
_SLICE = 1 << 13
_RUN = 256
_MANY = 1 << 16
_STREAM = "kind int, task int, at long, width int, data binary, slots binary"
_PART = "part int, n long, sizes array<int>, bits binary, keys binary, langs array<string>, words array<string>"


# ---- words of a slice of texts -----------------------------------------------------------


def words_of(texts: pa.Array, langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``bytes`` of the texts, then for each word its start, end, text and a hash with the language; last, pieces.

    A-Z count as lower case; pieces end at the separators and with the text.
    """
    data, bounds, start, end, text = batch_words(texts, _CLASS)
    opens = np.zeros(len(data) + 1, bool)
    opens[bounds] = True
    piece = np.cumsum((_CLASS[data] == 2) | opens[:-1], dtype=np.int32)[start] if len(data) else np.zeros(0, np.int32)
    own = {x: mix(spans_hash(p := prefix_hash(byte_values(b := x.encode())), np.array([0]), np.array([len(p) - 1])) + np.uint64(len(b) + 1))[0] for x in set(langs)}
    lang = np.array([own[x] for x in langs], np.uint64)
    hashed = spans_hash(prefix_hash(_VALUE[data]), start, end) + (end - start).astype(np.uint64)
    return data, start, end, text, mix(mix(hashed) ^ lang[text]), piece


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    if not len(key):
        return key, count
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(count[order], first)


def _word_counts(batches: Iterator[pa.RecordBatch], most: int = 150_000) -> Iterator[pa.RecordBatch]:
    met: dict[int, list] = {}

    def out():
        rows = list(met.values())
        return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    for batch in batches:
        for part in tokens.slices(batch, most=400_000):
            langs = part.column("lang").to_pylist()
            data, start, end, text, key, _ = words_of(part.column("text"), langs)
            distinct, first, count = np.unique(key, return_index=True, return_counts=True)
            for k, i, n in zip(distinct.tolist(), first.tolist(), count.tolist(), strict=True):
                if k in met:
                    met[k][2] += n
                else:
                    met[k] = [langs[text[i]], _LOWER[data[start[i] : end[i]]].tobytes().decode(), n]
            if len(met) > most:
                yield out()
                met.clear()
    yield out()


# ---- minimal perfect hashes, a part a task -------------------------------------------------


def _part_row(part: int, keys: np.ndarray, named: dict | None = None) -> pa.Table:
    sizes, bits, stored = build(keys)
    names = [named[k] for k in stored.tolist()] if named else []
    row = {"part": [part], "n": [len(keys)], "sizes": [sizes], "bits": [bits], "keys": [stored.tobytes()], "langs": [[x[0] for x in names]], "words": [[x[1] for x in names]]}
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string())]
    return pa.table([pa.array(v, k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))


def _word_parts(words: DataFrame, parts: int) -> DataFrame:
    """The hash of ``lang, word`` rows."""

    def keyed(batches):
        for b in batches:
            langs = b.column("lang").to_pylist()
            one = [words_of(pa.array([w]), [x])[4] for x, w in zip(langs, b.column("word").to_pylist(), strict=True)]
            key = np.concatenate(one) if one else np.zeros(0, np.uint64)
            yield pa.record_batch([b.column("lang"), b.column("word"), pa.array(key.view(np.int64)), pa.array(part_of(key, parts))], ["lang", "word", "key", "part"])

    def built(table):
        key = table.column("key").to_numpy().view(np.uint64)
        named = dict(zip(key.tolist(), zip(table.column("lang").to_pylist(), table.column("word").to_pylist(), strict=True), strict=True))
        if len(named) < len(key):
            raise ValueError("two frequent words have one 64-bit hash")
        return _part_row(table.column("part")[0].as_py(), key, named)

    return words.mapInArrow(keyed, "lang string, word string, key long, part int").groupBy("part").applyInArrow(built, _PART)


def _phrase_parts(stream: DataFrame, bar: int, parts: int, most: int = 1 << 19) -> DataFrame:
    """The hash of the stream's keys that occur at least ``bar`` times; tasks tell no more than ``bar`` of each."""
    width = np.min_scalar_type(bar)

    def told(key, count):
        part = part_of(key, parts)
        order = np.argsort(part, kind="stable")
        key, count, part = key[order], np.minimum(count, bar).astype(width)[order], part[order]
        edge = np.searchsorted(part, np.arange(parts + 1))
        full = np.flatnonzero(edge[1:] > edge[:-1])
        cut = lambda x: pa.array([x[edge[i] : edge[i + 1]].tobytes() for i in full], pa.binary())
        return pa.record_batch([pa.array(full.astype(np.int32)), cut(key), cut(count)], ["part", "keys", "counts"])

    def local(batches):
        keys, counts, size = [], [], 0
        for b in batches:
            for key in _joined(b.column("data")):
                key, count = np.unique(key[key != GAP], return_counts=True)
                keys.append(key)
                counts.append(count)
                size += len(key)
                if size > most:
                    key, count = _merged(keys, counts)
                    if len(key) > most // 2:
                        yield told(key, count)
                        key, count = key[:0], count[:0]
                    keys, counts, size = [key], [count], len(key)
            pa.default_memory_pool().release_unused()
        if size:
            yield told(*_merged(keys, counts))

    def built(table):
        keys = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("keys")]
        key, count = _merged(keys, [np.frombuffer(x.as_py(), width).astype(np.int64) for x in table.column("counts")])
        return _part_row(table.column("part")[0].as_py(), key[count >= bar])

    return stream.mapInArrow(local, "part int, keys binary, counts binary").groupBy("part").applyInArrow(built, _PART)


class _Level:
    """A level's hash as a written table, with the slots before each part and blocks of at most ``block_slots`` keys."""

    def __init__(self, table: DataFrame, parts: int, block_slots: int):
        self.table, self.parts = materialise(table.where("n > 0"), "slots"), parts
        sizes = self.table.select("part", "n").orderBy("part").collect()  # at most ``parts`` numbers
        self.base, self.blocks, self.n = {}, [], 0
        held = block_slots
        for r in sizes:
            if held + r.n > block_slots:
                self.blocks.append([r.part, r.part])
                held = 0
            self.base[r.part], self.blocks[-1][1] = self.n, r.part
            self.n += r.n
            held += r.n
        if self.n >= 1 << 32:
            raise ValueError("over 4 billion frequent phrases of one length")

    def block(self, first: int, last: int):
        rows = self.table.where(F.col("part").between(first, last)).select("part", "sizes", "bits", "keys").orderBy("part").collect()
        rows = [(r.part, list(r.sizes), bytes(r.bits), bytes(r.keys)) for r in rows]
        return self.table.sparkSession.sparkContext.broadcast((rows, self.parts, self.base[first]))

    def phrases(self) -> DataFrame:
        """``slot, head, word`` (slots of the first words and of the last one) of each key."""
        base = self.base

        def run(batches):
            for b in batches:
                for part, data in zip(b.column("part").to_pylist(), b.column("keys"), strict=True):
                    key = np.frombuffer(data.as_py(), np.uint64)
                    slot = base[part] + np.arange(len(key))
                    yield pa.record_batch([pa.array(slot), pa.array((key >> _HALF).astype(np.int64)), pa.array((key & np.uint64(2**32 - 1)).astype(np.int64))], ["slot", "head", "word"])

        return self.table.select("part", "keys").mapInArrow(run, "slot long, head long, word long")

    def words(self) -> DataFrame:
        """``slot, lang, word`` of the first level."""
        spark = self.table.sparkSession
        base = spark.createDataFrame(list(self.base.items()), "part int, base long")
        each = self.table.join(base, "part").select("base", "langs", F.posexplode("words").alias("i", "word"))
        return each.select((F.col("base") + F.col("i")).alias("slot"), F.get("langs", F.col("i")).alias("lang"), "word")


# ---- scans: look keys up, count slots, make the next level's keys ---------------------------------


def next_keys(keys: np.ndarray, slots: np.ndarray, first: bool) -> np.ndarray:
    """Keys of the phrases one word longer, where both parts have a slot; runs end with a gap."""
    if len(keys) < 2:
        return np.zeros(0, np.uint64)
    both = np.append((slots[:-1] >= 0) & (slots[1:] >= 0), False)
    word = slots if first else keys & np.uint64(2**32 - 1)
    out = np.full(len(keys), GAP)
    at = np.flatnonzero(both)
    out[at] = (slots[at].astype(np.uint64) << _HALF) | word[at + 1].astype(np.uint64)
    keep = both.copy()
    keep[1:] |= both[:-1]
    return out[keep]


def _text_keys(batches) -> Iterator[tuple[np.ndarray, None]]:
    """Hashes of a slice's words, with a gap after each piece."""
    for batch in batches:
        for part in tokens.slices(batch, most=400_000):
            *_, key, piece = words_of(part.column("text"), part.column("lang").to_pylist())
            if len(key):
                at = np.arange(len(key)) + np.cumsum(np.concatenate([[0], piece[1:] != piece[:-1]]))
                out = np.full(at[-1] + 2, GAP)
                out[at] = key
                yield out, None


def _joined(rows: pa.Array, kind: type = np.uint64) -> Iterator[np.ndarray]:
    """The numbers of a column's rows, one row after another, about ``_MANY`` at a time."""
    if not len(rows):
        return
    rows = rows.cast(pa.large_binary())
    ends = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
    data = np.frombuffer(rows.buffers()[2] or b"", np.uint8)
    cuts = [*ends[np.diff((ends - ends[0]) // (8 * _MANY), prepend=-1) > 0].tolist(), int(ends[-1])]
    for start, end in zip(cuts, cuts[1:], strict=False):
        if start < end:
            yield data[start:end].view(kind)


def _stream_keys(batches) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    for b in batches:
        slots = b.column("slots")
        yield from zip(_joined(b.column("data")), repeat(None) if slots.null_count else _joined(slots, np.int64), strict=False)
        pa.default_memory_pool().release_unused()


def _runs(task: int, keys: np.ndarray, slots: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of kind 0, each of about ``_RUN`` keys: they end with a gap, as ``keys`` do, so no run is cut."""
    gap = np.flatnonzero(keys == GAP) + 1
    ends = np.append(0, gap[np.diff(gap // _RUN, append=-1) != 0])
    n = len(ends) - 1
    column = lambda x: pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((8 * ends).astype(np.int32)), pa.py_buffer(x)])
    cols = [pa.array(np.full(n, v, k)) for v, k in ((0, np.int32), (task, np.int32), (0, np.int64), (8, np.int32))]
    return pa.record_batch([*cols, column(keys), pa.nulls(n, pa.binary()) if slots is None else column(slots)], [c.split()[0] for c in _STREAM.split(", ")])


def _rows(kind: int, task: int, rows: list[tuple]) -> pa.RecordBatch:
    at, width, data, slots = zip(*rows, strict=True)
    n = len(rows)
    cols = [pa.array([kind] * n, pa.int32()), pa.array([task] * n, pa.int32()), pa.array(at, pa.int64()), pa.array(width, pa.int32()), pa.array(data, pa.binary()), pa.array(slots, pa.binary())]
    return pa.record_batch(cols, [c.split()[0] for c in _STREAM.split(", ")])


def _narrow(counts: np.ndarray) -> tuple[int, bytes]:
    kind = np.min_scalar_type(int(counts.max()))
    return kind.itemsize, counts.astype(kind).tobytes()


def _scan(rows: DataFrame, block, source, first: bool, last: bool) -> DataFrame:
    """Rows of kind 0, the keys of the next level (or, before the last block, these keys with the slots found
    so far), and of kind 1, this task's counts of the block's slots."""

    def run(batches):
        from pyspark import TaskContext

        task, here = TaskContext.get().partitionId(), Block(*block.value)
        counts = np.zeros(len(here), np.int64)
        for keys, slots in source(batches):
            found = here.slots(keys)
            counts += np.bincount(found[found >= 0] - here.base, minlength=len(counts))
            slots = found if slots is None else np.where(found >= 0, found, slots)
            if not last:
                yield _runs(task, keys, slots)
            elif len(out := next_keys(keys, slots, first)):
                yield _runs(task, out)
        for at in range(0, len(counts), _SLICE):
            if (some := counts[at : at + _SLICE]).any():
                yield _rows(1, task, [(here.base + at, *_narrow(some), None)])

    return rows.mapInArrow(run, _STREAM)


def _tree_sum(counts: DataFrame) -> DataFrame:
    """Arrays of counts (``task, at, width, data``) summed by place, ``_FAN_IN`` tasks at a time."""

    def summed(table):
        width, data = table.column("width").to_pylist(), table.column("data")
        total = np.sum([np.frombuffer(x.as_py(), f"u{w}").astype(np.int64) for w, x in zip(width, data, strict=True)], axis=0)
        w, x = _narrow(total)
        return pa.table([table.column("task")[:1], table.column("at")[:1], pa.array([w], pa.int32()), pa.array([x], pa.binary())], names=["task", "at", "width", "data"])

    tasks = (counts.agg(F.max("task")).first()[0] or 0) + 1
    counts = counts.select("task", "at", "width", "data")
    while tasks > 1:
        counts = counts.withColumn("task", F.expr(f"task div {_FAN_IN}").cast("int")).groupBy("task", "at").applyInArrow(summed, "task int, at long, width int, data binary")
        tasks = -(-tasks // _FAN_IN)
    return counts


def _by_slot(counts: DataFrame) -> DataFrame:
    """``slot, a`` from summed arrays."""

    def run(batches):
        for b in batches:
            for at, w, data in zip(b.column("at").to_pylist(), b.column("width").to_pylist(), b.column("data"), strict=True):
                a = np.frombuffer(data.as_py(), f"u{w}").astype(np.int64)
                yield pa.record_batch([pa.array(at + np.arange(len(a))), pa.array(a)], ["slot", "a"])

    return counts.select("at", "width", "data").mapInArrow(run, "slot long, a long")


def _counted(rows: DataFrame, level: _Level, source, first: bool) -> tuple[DataFrame, DataFrame]:
    """The next level's stream and ``slot, a`` of this level."""
    sums = []
    for i, (low, high) in enumerate(level.blocks):
        block = level.block(low, high)
        done = materialise(_scan(rows, block, source if i == 0 else _stream_keys, first, i == len(level.blocks) - 1), "keys")
        block.unpersist()
        sums.append(_tree_sum(done.where("kind = 1")))
        rows = done.where("kind = 0").select("data", "slots")
    return rows, _by_slot(reduce(DataFrame.unionAll, sums))


def mine(docs: DataFrame, longest: int = 5, bar: int = 100, share: int = 100, most: int | None = 2000, block_slots: int = 1 << 22) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of 2 to ``longest`` words.

    A phrase occurs ``a`` times (at least ``bar``) within pieces, ``n`` is the number of all words of its language;
    of its cuts into two parts that occur ``l`` and ``r`` times the one of lowest floor(1000 * a * n / (l * r)) counts, of equal
    ones the first.  A phrase goes if a longer one around it has at least ``share`` percent of its occurrences.
    ``most`` (a report's length; None: all) keeps the best of each language by score, count and bytes.

    Null text counts as empty, a null lang as ``und``; doc_ids and other columns play no part, so repeated
    rows count each; long texts are taken whole; an empty table, or one without a frequent phrase, gives no rows.
    """
    spark, parallelism = docs.sparkSession, docs.sparkSession.sparkContext.defaultParallelism
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    texts = texts.coalesce(8 * parallelism)  # each task writes an array of counts: as many as there are cores for, a few times over
    met = materialise(texts.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    size = met.groupBy("lang").agg(F.sum("n").alias("n"))
    total = met.agg(F.sum("n")).first()[0] or 0
    parts = max(2 * shuffle_partitions(spark), total >> 21)
    level = _Level(_word_parts(met.where(F.col("n") >= bar).select("lang", "word"), parts), parts, block_slots)
    names = materialise(level.words(), "words")
    stream, counts = _counted(texts, level, _text_keys, True) if level.n else (None, None)

    tables = []  # of the phrases of 1, 2, ... words
    if level.n:
        one = names.join(counts, "slot").join(size, "lang")
        tables.append(materialise(one.select("slot", "lang", "n", "a", F.array("slot").alias("words"), F.lit(None).cast("long").alias("head"), F.lit(None).cast("long").alias("tail"), F.lit(None).cast("long").alias("word"), F.array("a").alias("firsts"), F.array("a").alias("lasts")), "phrases"))
    while stream is not None and len(tables) < longest:
        level = _Level(_phrase_parts(stream, bar, parts), parts, block_slots)
        if not level.n:
            break
        stream, counts = _counted(stream, level, _stream_keys, False)
        tables.append(materialise(_longer(level.phrases().join(counts, "slot"), tables[-1], len(tables)), "phrases"))
    if len(tables) < 2:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    return _reported(tables, names, share, most)


def _longer(found: DataFrame, below: DataFrame, k: int) -> DataFrame:
    """Phrases one word longer than ``below`` (of ``k`` words): what their first and last words occur, read by slot."""
    head = below.select(F.col("slot").alias("head"), "lang", "n", F.col("words").alias("w"), F.col("tail").alias("t"), F.col("firsts").alias("f"))
    each = found.join(head, "head")
    if k == 1:
        each = each.withColumn("tail", F.col("word"))
    else:
        tails = below.select(F.col("slot").alias("tail"), F.col("head").alias("t"), "word")
        each = each.join(tails, ["t", "word"])
    last = below.select(F.col("slot").alias("tail"), F.col("lasts").alias("b"))
    each = each.join(last, "tail")
    return each.select("slot", "lang", "n", "a", F.concat("w", F.array("word")).alias("words"), "head", "tail", "word", F.concat("f", F.array("a")).alias("firsts"), F.concat("b", F.array("a")).alias("lasts"))


def _lowest_cut(k: int) -> Column:
    """Score, first part's length, ``l`` and ``r`` of the cut that counts; exact in 38 digits."""
    up = F.expr("cast(1000 as decimal(4, 0)) * cast(a as decimal(17, 0)) * cast(n as decimal(17, 0))")
    cuts = []
    for i in range(1, k):
        left, right = F.get("firsts", F.lit(i - 1)), F.get("lasts", F.lit(k - i - 1))
        down = left.cast("decimal(17, 0)") * right.cast("decimal(17, 0)")
        cuts.append(F.struct(F.call_function("div", up, down).cast("long").alias("score"), F.lit(i).alias("k"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def _reported(tables: list[DataFrame], names: DataFrame, share: int, most: int | None) -> DataFrame:
    found = []
    for k, table in enumerate(tables[1:], start=2):
        if k < len(tables):
            longer = tables[k]
            inside = lambda c, counts: longer.where(100 * F.col("a") >= share * F.get(counts, F.lit(k - 1))).select(F.col(c).alias("slot"))  # noqa: B023, E731
            table = table.join(inside("head", "firsts").union(inside("tail", "lasts")).distinct(), "slot", "left_anti")
        found.append(table.select("lang", "n", "a", "words", _lowest_cut(k).alias("cut")))
    scored = reduce(DataFrame.unionAll, found).select("lang", "n", "a", "words", "cut.score", "cut.l", "cut.r")
    if most is not None:  # words are looked up for what can be reported, all of a tie at the end included
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
        scored = scored.withColumn("place", F.rank().over(order)).where(F.col("place") <= most).drop("place")
    each = scored.select("lang", "n", "a", "score", "l", "r", "words", F.posexplode("words").alias("i", "slot")).join(names.select("slot", "word"), "slot")
    phrase = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ")
    spelled = each.groupBy("lang", "words", "n", "a", "score", "l", "r").agg(phrase.alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelled.withColumn("rank", F.row_number().over(order).cast("long"))
    if most is not None:
        ranked = ranked.where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
