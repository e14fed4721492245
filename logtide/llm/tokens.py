"""Exact, cached encoding with the ``tokenizers`` library inside Spark tasks.

Both kinds of public vocabulary cut text before any merge: at white space, and between letters
and what follows them.  A text's ids are therefore the ids of its words in order.  Arrow splits a
slice of texts and numbers its distinct words, so Python handles each distinct word once; a word is
a stem of letters and a tail of punctuation, and the library encodes only stems that this worker has
not met, many at a time.  A worker keeps two generations of stems, each bounded in bytes, as arrays: a 64-bit
hash, a place and a size for each.  Texts whose white space is not plain are given to the library whole.
"""

from __future__ import annotations

import os
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import byte_values, mix, prefix_hash, spans_hash

#: What one generation of a worker's stems may hold.
_MOST_BYTES = 24 << 20
#: White space other than the six ASCII characters (and what Python or the library may take for it).
_OTHER_SPACE = r"\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_ODD = f"[{_OTHER_SPACE}]"
_UNEVEN = rf"^$|^[ \n]|[ \n]$|  | \n|\n |\n\n|[\t\r\x0b\x0c\x00{_OTHER_SPACE}]"
_encoders: dict[str, "Encoder"] = {}


class Stems:
    """Ids of stems by the stems' hashes, in sorted arrays."""

    def __init__(self):
        self.hash, self.ids = np.zeros(0, np.uint64), np.zeros(0, "<u4")
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)

    @property
    def held(self) -> int:
        return sum(x.nbytes for x in (self.hash, self.ids, self.start, self.size))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 where there is none."""
        if not len(self.hash):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where(self.hash[at] == hashes, at, -1)

    def put(self, hashes: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """New stems, whose ids stand one after another."""
        start = len(self.ids) + np.cumsum(size) - size
        order = np.argsort(hashes)
        merged = np.concatenate([self.hash, hashes[order]])
        place = np.argsort(merged, kind="stable")  # two sorted runs
        self.hash = merged[place]
        self.start = np.concatenate([self.start, start[order]])[place]
        self.size = np.concatenate([self.size, size[order].astype(np.int32)])[place]
        self.ids = np.concatenate([self.ids, ids])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows one after another, and how many each has."""
        size = self.size[rows].astype(np.int64)
        return runs(self.ids, self.start[rows], size)[0], size


class Encoder:
    """Texts to little-endian 32-bit ids, as ``encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.library.get_vocab()
        self.size = len(vocabulary)
        #: Byte-level vocabularies keep spaces; the others drop white space, case and mark word ends.
        self.spaced = not any(piece.endswith("</w>") for piece in vocabulary)
        self.edge = np.zeros(self.size, bool)
        for piece, i in vocabulary.items():
            self.edge[i] = piece.startswith("Ġ") if self.spaced else piece.endswith("</w>")
        self.stems, self.old = Stems(), Stems()
        self.tails: dict[str, bytes] = {}
        self.most_bytes = _MOST_BYTES

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text; a caller bounds the slice (``slices``)."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        odd = pc.match_substring_regex(texts, _UNEVEN if self.spaced else _ODD).to_numpy(zero_copy_only=False)
        if odd.any():
            plain = iter(self.plain(texts.filter(pa.array(~odd))))
            whole = iter(texts.filter(pa.array(odd)).to_pylist())
            return [self.whole(next(whole)) if o else next(plain) for o in odd.tolist()]
        return self.plain(texts)

    def plain(self, texts: pa.Array) -> list[bytes]:
        """Texts of plain white space: words by number, ids gathered for all words at once."""
        if not len(texts):
            return []
        if self.spaced:  # a leading \0 (start of text) or \n stands for what precedes a word instead of a space
            marked = pc.binary_join_element_wise("\0", pc.replace_substring(texts, "\n", " \n"), "")
            words = pc.split_pattern(marked, " ")
        else:
            words = pc.ascii_split_whitespace(texts)
        numbered = words.values.dictionary_encode()
        ids, ends = self.words(numbered.dictionary)
        ids, ends = gather(ids, ends, numbered.indices.to_numpy())
        raw, bounds = ids.tobytes(), (4 * ends[words.offsets.to_numpy()]).tolist()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, with where each word's begin and end.

        A word is a lead and letters (its stem) and closing punctuation, or else a stem as it is."""
        stem = pc.utf8_rtrim(words, string.punctuation)
        letters = pc.utf8_is_alpha(pc.utf8_ltrim(stem, "\0\n") if self.spaced else stem)
        stem = pc.if_else(letters, stem if self.spaced else pc.ascii_lower(stem), words)
        cut = pc.subtract(pc.binary_length(words), pc.binary_length(stem)).to_numpy()
        tail = np.zeros(len(words), np.int64)
        where = np.flatnonzero(cut)
        ends = [w[-n:] for w, n in zip(strings(words.take(pa.array(where))), cut[where].tolist(), strict=True)]
        stems = stem.dictionary_encode()
        ids, size = self.learnt(stems.dictionary)
        if len(self.tails) > 10_000:
            self.tails = {}
        for t in set(ends).difference(self.tails):
            self.tails[t] = self.whole(t)
        number = {t: i for i, t in enumerate(dict.fromkeys(ends), 1)}
        tail[where] = [number[t] for t in ends]
        known = [b"", *map(self.tails.__getitem__, number)]
        both = np.empty(2 * len(words), np.int64)
        both[::2], both[1::2] = stems.indices.to_numpy(), tail + len(size)
        size = np.concatenate([size, np.fromiter(map(len, known), np.int64, len(known)) // 4])
        ids, at = gather(np.concatenate([ids, np.frombuffer(b"".join(known), "<u4")]), np.concatenate([[0], np.cumsum(size)]), both)
        return ids, at[::2]

    def learnt(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct stems one after another, and how many each has.  A full table becomes the old one, from
        which stems that come again return; the rest of it goes when the next table is full."""
        if self.stems.held > self.most_bytes:
            self.stems, self.old = Stems(), self.stems
        hashes = text_hashes(names)
        new = np.flatnonzero(self.stems.find(hashes) < 0)
        if len(new):
            row = self.old.find(hashes[new])
            again = row >= 0
            if again.any():
                self.stems.put(hashes[new[again]], *self.old.take(row[again]))
            if not again.all():
                new = new[~again]
                got = self.encoded(strings(names.take(pa.array(new))))
                self.stems.put(hashes[new], np.frombuffer(b"".join(got), "<u4"), np.fromiter(map(len, got), np.int64, len(got)) // 4)
        return self.stems.take(self.stems.find(hashes))

    def encoded(self, stems: list[str]) -> list[bytes]:
        """Ids of stems: those of one kind are encoded many at a time and cut where a word begins or ends."""
        ahead, bare, other, got = [], [], [], {}
        for s in stems:
            body = s[1:] if self.spaced and s[:1] in ("\0", "\n") else s
            (other if not body.isalpha() else ahead if len(body) == len(s) else bare).append(s)
        for i in range(0, len(ahead), 2000):
            part = ahead[i : i + 2000]
            text = "".join(" " + s for s in part) if self.spaced else " ".join(part)
            ids = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
            at = 4 * (np.flatnonzero(self.edge[ids]) + (not self.spaced))
            self.keep(got, part, ids.tobytes(), [*at.tolist(), 4 * len(ids)] if self.spaced else [0, *at.tolist()])
        if bare:
            line = np.frombuffer(self.whole("\n"), "<u4")
        for i in range(0, len(bare), 2000):
            part = bare[i : i + 2000]
            ids = np.array(self.library.encode("".join("\n" + s[1:] for s in part), add_special_tokens=False).ids, "<u4")
            at = 4 * np.flatnonzero(ids == line[0])
            self.keep(got, part, ids.tobytes(), [*at.tolist(), 4 * len(ids)])
            for s in part:
                if s[0] == "\0":
                    got[s] = got[s][4:]
        for s in other:
            got[s] = self.whole((s[1:] if s[:1] == "\0" else s if s[:1] == "\n" else " " + s) if self.spaced else s)
        return [got[s] for s in stems]

    def keep(self, got: dict[str, bytes], part: list[str], raw: bytes, bounds: list[int]) -> None:
        """Cut the ids of joined stems apart; where the cuts do not fit, encode one by one."""
        if len(bounds) == len(part) + 1:
            got.update((s, raw[a:b]) for s, a, b in zip(part, bounds, bounds[1:], strict=False))
        else:
            got.update((s, self.whole("\n" + s[1:] if s[:1] in ("\0", "\n") else " " + s if self.spaced else s)) for s in part)


def strings(texts: pa.Array) -> list[str]:
    """The strings of an array without nulls, cut from one decoded buffer."""
    at = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy())]).tolist()
    whole = "" if not len(texts) else pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "")[0].as_py()
    return [whole[a:b] for a, b in zip(at, at[1:], strict=False)]


def text_hashes(texts: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string of an array without nulls."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2] or b"")[ends[0] : ends[-1]]
    at = ends - ends[0]
    return mix(spans_hash(prefix_hash(byte_values(data)), at[:-1], at[1:]) + np.diff(at).astype(np.uint64))


def runs(ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``ids`` one after another, with where each begins and the last ends."""
    out = np.concatenate([[0], np.cumsum(n)])
    return ids[np.repeat(start - out[:-1], n) + np.arange(out[-1])], out


def gather(ids: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of ``ids`` that begin and end at ``ends``, those numbered ``at`` one after another."""
    return runs(ids, ends[:-1][at], np.diff(ends)[at])


def encoder(path: str, most_bytes: int = _MOST_BYTES) -> Encoder:
    """This worker's encoder for a vocabulary file, whose generations of stems hold ``most_bytes`` at most."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].most_bytes = most_bytes
    return _encoders[path]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 4_000_000):
    """Parts of a batch with about ``most`` bytes of text each, so long texts stay small in memory."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    start, n = 0, batch.num_rows
    while start < n:
        done = ends[start - 1] if start else 0
        end = max(start + 1, min(n, int(np.searchsorted(ends, done + most, side="right"))))
        yield batch.slice(start, end - start)
        start = end
    pa.default_memory_pool().release_unused()  # what Arrow holds on to would add up over a worker's life
