"""Word-level substring de-duplication by fixed-block anchors: passages that an earlier document has.

Non-overlapping blocks of half a window index each document, and every rolling window of a block's
width probes that index by the hash of its words.  A window of ``length`` words holds a whole block of
any document it lies in, so a copy of it always probes that block.  Hits are then extended word by
word to both sides to maximal exact repeats, and a word is removed if a repeat of ``length`` words over
it also starts in a document with a smaller doc_id.

Block keys and probes meet by key range: each task packs those of a batch of documents into one binary
row a range (five bytes of hash a probe; places compressed), a range's task keeps its block keys and
streams the probes, and only hits come out, packed as well and gathered by batch.  A hot passage gives a range one probe a document, so no
range is hot.  Five bytes may meet by chance; the extension compares whole words' hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, materialise, mix, own_columns, prefix_hash, quoted, shuffle_partitions, windows_hash, word_hashes
from .repeats import OCCURRENCE, SMALLER_DOC, matched, occurrence_rows, range_hash

_LAST = (1 << 63) - 1
_LOW = np.uint64((1 << 40) - 1)


def kept_words(data: bytes, spans: list, length: int) -> tuple[bytes, int, int]:
    """The words left, joined by one space, with the numbers of words before and removed."""
    words = data.split()
    gone = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        gone[s["lo"]] += 1
        gone[s["lo"] + s["n"] - 1 + length] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k), len(words), int((~keep).sum())


def block_keys(words: np.ndarray, block: int) -> np.ndarray:
    """The hash of every rolling window of ``block`` words; those at multiples of ``block`` are the index."""
    return mix(windows_hash(prefix_hash(words), block))


def _pack(keys: np.ndarray, who: np.ndarray, at: np.ndarray) -> tuple[bytes, bytes]:
    """Low five bytes of keys, and compressed: in which row (by number, ascending) and where each lies."""
    low = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    same = np.concatenate([[0], (np.diff(who) == 0).astype(np.int64)])
    step = np.where(same == 1, np.diff(at, prepend=0), at)
    return low, zstandard.ZstdCompressor(level=1).compress(np.diff(who, prepend=0).astype("<u2").tobytes() + step.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(low: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    wide = np.zeros((len(low) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(low, np.uint8).reshape(-1, 5)
    raw = zstandard.ZstdDecompressor().decompress(places)
    n = len(wide)
    who = np.cumsum(np.frombuffer(raw[: 2 * n], "<u2").astype(np.int64))
    step = np.ascontiguousarray(np.frombuffer(raw[2 * n :], np.uint8).reshape(4, n).T).view("<u4").ravel().astype(np.int64)
    total = np.cumsum(step)
    first = np.concatenate([[True], np.diff(who) != 0])[:n]
    before = (total - step)[first]
    return wide.view("<u8").ravel(), who, total - np.repeat(before, np.diff(np.concatenate([np.flatnonzero(first), [n]])))


def _range_rows(block: int, length: int, ranges: int, words_held: int = 1 << 20):
    """Packed block keys (``kind`` 0) and probes (1) of batches of documents, one row a range of keys."""

    def packed(held: list[tuple]):
        docs, ths = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64)
        sizes = np.array([len(h[2]) for h in held])
        keys = np.concatenate([h[2] for h in held])
        who = np.repeat(np.arange(len(held)), sizes)
        at = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        part = ((keys >> np.uint64(40)) % np.uint64(ranges)).astype(np.uint16 if ranges < 1 << 16 else np.int64)
        out: list[list] = [[], [], [], [], [], [], []]
        src = int.from_bytes(hashlib.md5(docs.tobytes() + ths.tobytes()).digest()[:8], "little", signed=True)
        for kind, mine in ((0, np.flatnonzero(at % block == 0)), (1, np.arange(len(keys)))):
            mine = mine[np.argsort(part[mine], kind="stable")]
            cut = np.flatnonzero(np.diff(part[mine].astype(np.int64))) + 1
            for sel in np.split(mine, cut) if len(mine) else []:
                rows, number = np.unique(who[sel], return_inverse=True)
                low, places = _pack(keys[sel], number, at[sel])
                row = (int(part[sel[0]]), kind, src, docs[rows].tobytes(), ths[rows].tobytes(), low, places)
                for c, x in zip(out, row, strict=True):
                    c.append(x)
        kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
        return pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["range", "kind", "src", "docs", "ths", "low", "places"])

    def run(batches):
        held: list[tuple] = []
        total = 0
        for b in batches:
            for doc, th, data in zip(b.column("doc").to_pylist(), b.column("th").to_pylist(), b.column("data"), strict=True):
                words = word_hashes(data.as_py())
                if len(words) < length:
                    continue
                held.append((doc, th, block_keys(words, block)))
                total += len(words)
                if total >= words_held or len(held) == 1 << 15:
                    yield packed(held)
                    held, total = [], 0
        if held:
            yield packed(held)
        pa.default_memory_pool().release_unused()

    return run


def _hits(batches):
    """Of ranges in order, block keys before probes: probes of a key that a smaller doc indexes, and the
    indexed places of keys that a larger doc probes; packed as they came, by the batch ``src``."""
    now, index, table = None, [], None

    def read(r):
        key, who, at = _unpack(r["low"], r["places"])
        return key, np.frombuffer(r["docs"], np.int64)[who], np.frombuffer(r["ths"], np.int64)[who], at

    def row(src, doc, th, at):
        return pa.record_batch([pa.array([src], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (doc, th, at.astype(np.int32)))], ["src", "docs", "ths", "places"])

    def settle():
        """Keys of the range in order, with the least doc that indexes each and the greatest that probes it."""
        keys, which = np.unique(np.concatenate([x[1] for x in index]), return_inverse=True)
        least = np.full(len(keys), _LAST)
        np.minimum.at(least, which, np.concatenate([x[2] for x in index]))
        return {"keys": keys, "least": least, "most": np.full(len(keys), -(1 << 63)), "which": np.split(which, np.cumsum([len(x[1]) for x in index])[:-1])}

    def indexed():
        for (src, _, doc, th, at), which in zip(index, table["which"], strict=True):
            on = doc < table["most"][which]
            if on.any():
                yield row(src, doc[on], th[on], at[on])

    for b in batches:
        for r in b.to_pylist():
            if r["range"] != now:
                if table is not None:
                    yield from indexed()
                now, index, table = r["range"], [], None
            if r["kind"] == 0:
                index.append((r["src"], *read(r)))
                continue
            if not index:
                continue
            table = settle() if table is None else table
            key, doc, th, at = read(r)
            which = np.minimum(np.searchsorted(table["keys"], key), len(table["keys"]) - 1)
            on = table["keys"][which] == key
            which, doc, th, at = which[on], doc[on], th[on], at[on]
            np.maximum.at(table["most"], which, doc)
            on = table["least"][which] < doc
            if on.any():
                yield row(r["src"], doc[on], th[on], at[on])
    if table is not None:
        yield from indexed()


def _by_document(batches):
    """Packed hits in order of ``src`` in; one row a document with its places out."""

    def unpacked(held):
        doc, th, at = (np.concatenate([np.frombuffer(h[i], t) for h in held]) for i, t in ((0, np.int64), (1, np.int64), (2, np.int32)))
        order = np.lexsort((at, th, doc))
        doc, th, at = doc[order], th[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])]))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([first, [len(at)]]).astype(np.int32)), pa.array(at))
        return pa.record_batch([pa.array(doc[first]), pa.array(th[first]), lists], ["doc", "th", "places"])

    now, held = None, []
    for b in batches:
        for src, *row in zip(*(b.column(c).to_pylist() for c in ("src", "docs", "ths", "places")), strict=True):
            if held and src != now:
                yield unpacked(held)
                held = []
            now = src
            held.append(row)
    if held:
        yield unpacked(held)


def _around(places: np.ndarray, words: int, block: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and number of the windows of ``length`` that hold the block at each place."""
    lo = np.maximum(0, places + block - length)
    return lo, np.minimum(places, words - length) - lo + 1


def _extended(block: int, length: int):
    """Compares contents of whole anchors: hits of a probe on an indexed block of a smaller doc are
    extended to both sides; windows inside a repeat of ``length`` words match."""

    def compare(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        wide = length - block
        offset = np.array([int.from_bytes(r[4][:4], "little") for r in rows])
        size = np.array([(len(r[4]) - 4) // 8 for r in rows])
        words = np.frombuffer(b"".join(r[4][4:] for r in rows), np.uint64)
        ends = np.cumsum(size)
        #: One row a content, the block in the middle; beyond a content's ends stands what no other row has.
        grid = np.arange(len(rows), dtype=np.uint64)[:, None] + np.zeros((1, block + 2 * wide), np.uint64)
        row = np.repeat(np.arange(len(rows)), size)
        grid[row, wide - offset[row] + np.arange(len(words)) - np.repeat(ends - size, size)] = words | np.uint64(1 << 63)
        docs, anchors = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
        windows = size - length + 1
        first = np.cumsum(windows) - windows
        edge = np.zeros(int(windows.sum()) + 1, np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1], [True]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            for i in range(a, b - 1):  # the rows of an anchor are in order of doc
                later = np.arange(max(i + 1, int(np.searchsorted(docs[a:b], docs[i], side="right")) + a), b)
                if not len(later):
                    continue
                equal = grid[later] == grid[i]
                left = np.minimum.accumulate(equal[:, wide - 1 :: -1] if wide else equal[:, :0], axis=1).sum(axis=1)
                right = np.minimum.accumulate(equal[:, wide + block :], axis=1).sum(axis=1)
                on = equal[:, wide : wide + block].all(axis=1) & (left + block + right >= length)
                who, left, right = later[on], left[on], right[on]
                np.add.at(edge, first[who] + offset[who] - left, 1)
                np.add.at(edge, first[who] + offset[who] + right + block - length + 1, -1)
        return windows, np.cumsum(edge[:-1]) > 0

    return compare


def repeated_passages(rows: DataFrame, length: int, dense: int) -> DataFrame:
    """Runs of windows ``doc, th, lo, n`` that a smaller doc has; ``rows`` has ``doc long, th long, data binary``."""
    block = (length + 1) // 2
    ranges = shuffle_partitions(rows.sparkSession)
    packed = rows.mapInArrow(_range_rows(block, length, ranges), "range int, kind int, src long, docs binary, ths binary, low binary, places binary")
    dealt = packed.repartitionById(ranges, "range").sortWithinPartitions("range", "kind")
    hits = dealt.mapInArrow(_hits, "src long, docs binary, ths binary, places binary")
    found = hits.repartition("src").sortWithinPartitions("src").mapInArrow(_by_document, "doc long, th long, places array<int>")
    asked = materialise(found.groupBy("doc", "th").agg(F.flatten(F.collect_list("places")).alias("places")), "hits")

    def filed(data: bytes, places: list):
        words, at = word_hashes(data), np.unique(places)
        lo, n = _around(at, len(words), block, length)
        prefix = prefix_hash(words)
        return lo, n, at - lo, block_keys(words, block)[at], range_hash(prefix, lo, n, at, length)

    def pack(data: bytes, ranges: list) -> list[bytes]:
        words = word_hashes(data)
        return [off.to_bytes(4, "little") + words[lo : lo + n - 1 + length].tobytes() for lo, n, off in ranges]

    def window_keys(content: bytes) -> np.ndarray:
        return mix(windows_hash(prefix_hash(np.frombuffer(content[4:], np.uint64)), length))

    rows = materialise(rows.join(asked.hint("merge"), ["doc", "th"]), "documents-with-hits")
    found = rows.mapInArrow(occurrence_rows(filed, "data", "places"), OCCURRENCE)
    return matched(rows, found, pack, _extended(block, length), window_keys, SMALLER_DOC, dense)


def remove_passages(docs: DataFrame, length: int = 50, dense: int = 256) -> DataFrame:
    """All columns of ``docs``, ``text`` rebuilt from the kept words, plus ``n_words, n_removed``.

    Words are `[^\\x20\\x09-\\x0D]+`; windows are judged on the input and never cross documents.
    Documents that lose nothing keep their text as it is, white space and all.  Null text has no
    words and stays null.  Rows that share a doc_id are one document to each other; a null doc_id
    counts as the largest.  Very long texts are taken whole.  An empty table stays empty.  Columns of
    ``docs`` named like the two new ones, in any case, give way to them; all others stay.
    """
    own = own_columns(docs, "n_words", "n_removed")
    docs = docs.select(*map(quoted, own))
    doc, th, data, spans, new = free_names(docs, "_doc", "_th", "_data", "_spans", "_new")
    rows = docs.withColumns(
        {
            doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)),
            th: F.xxhash64(F.coalesce("text", F.lit(""))),
            data: F.coalesce("text", F.lit("")).cast("binary"),
        }
    )
    runs = repeated_passages(rows.select(F.col(doc).alias("doc"), F.col(th).alias("th"), F.col(data).alias("data")), length, dense)
    found = materialise(runs.groupBy(F.col("doc").alias(doc), F.col("th").alias(th)).agg(F.collect_list(F.struct("lo", "n")).alias(spans)), "passages")

    @F.pandas_udf("struct<text: string, n_words: long, n_removed: long>")
    def rebuilt(data: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = [kept_words(d, [] if s is None else s, length) for d, s in zip(data, spans, strict=True)]
        return pd.DataFrame({"text": [o[0].decode() for o in out], "n_words": [o[1] for o in out], "n_removed": [o[2] for o in out]})

    joined = rows.join(found.hint("merge"), [doc, th], "left").withColumn(new, rebuilt(data, spans))
    changed = F.when(F.col(f"{new}.n_removed") > 0, F.col(f"{new}.text")).otherwise(F.col("text"))
    return joined.select(*(changed.alias(c) if c.lower() == "text" else quoted(c) for c in own), F.col(f"{new}.n_words"), F.col(f"{new}.n_removed"))
