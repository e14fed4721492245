"""SentencePiece encoding and decoding with n-best segmentation.

A text's piece lattice is scored forward by Viterbi; those scores are then exact heuristics for an
A* search backward from the end, which meets complete segmentations in order of score.  Where no
piece holds the two characters on either side of a place, no path can pass over it: the lattice
falls into units there, whose choices are independent.  The units of many texts are searched at once
on arrays; a text's n best combine its units', of which only the n - 1 with the cheapest second
choices can differ from the best.  Characters without a piece become their UTF-8 byte pieces.  The
vocabulary is read, never trained.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import documents

MARK = "▁"
#: Units of more characters are searched one by one.
_LONG = 48
#: Characters of the most common scripts, whose pairs are looked up in a square table.
_COMMON = 1024
_lattices: dict[str, "Lattice"] = {}


class Lattice:
    """Piece lattices over one vocabulary: ``pieces`` are (text, score) by id, ``byte_ids`` 256 ids or none."""

    def __init__(self, pieces: list[tuple[str, float] | None], byte_ids: list[int] | None, unknown: int = 0):
        self.ids = {p[0]: i for i, p in enumerate(pieces) if p}
        self.scores = np.array([p[1] if p else 0.0 for p in pieces])
        self.byte_ids, self.unknown = byte_ids, unknown
        self.longest = max(map(len, self.ids), default=1)
        self.unknown_score = min((p[1] for p in pieces if p), default=0.0) - 10.0
        spelt = [p[0].replace(MARK, " ").encode() if p else b"" for p in pieces]
        for value, i in enumerate(byte_ids or []):
            spelt[i] = bytes([value])
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.spelt_ends = np.concatenate([[0], np.cumsum([len(x) for x in spelt])])
        #: Characters by number, in order of code point; 0 for those of no piece.
        chars = sorted(set("".join(self.ids)))
        self.numbers = np.zeros(0x110000, np.int32)
        self.numbers[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        self._tree()
        self._pairs()

    def _tree(self) -> None:
        """The tree of pieces as sorted keys (node, character) with the child and its piece (or -1)."""
        nodes, piece, keys = {"": 0}, [-1], {}
        for text in sorted(self.ids):
            at = 0
            for k, c in enumerate(text, 1):
                child = nodes.setdefault(text[:k], len(nodes))
                if child == len(piece):
                    piece.append(-1)
                    keys[at * self.width + int(self.numbers[ord(c)])] = child
                at = child
            piece[at] = self.ids[text]
        self.keys = np.array(sorted(keys) or [-1], np.int64)
        self.child = np.array([keys[k] for k in sorted(keys)] or [0], np.int64)
        self.piece = np.array(piece, np.int64)

    def _pairs(self) -> None:
        inner = {(a, b) for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        number = [(int(self.numbers[ord(a)]), int(self.numbers[ord(b)])) for a, b in inner]
        self.joined = np.array(sorted(a * self.width + b for a, b in number), np.int64)
        self.common = np.zeros((_COMMON, _COMMON), bool)
        for a, b in number:
            if a < _COMMON and b < _COMMON:
                self.common[a, b] = True

    @classmethod
    def from_model(cls, path: str) -> Lattice:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        odd = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        pieces = [None if odd[i] else (sp.id_to_piece(i), sp.get_score(i)) for i in range(n)]
        byte_ids = [sp.piece_to_id(f"<0x{v:02X}>") for v in range(256)]
        return cls(pieces, byte_ids if all(sp.is_byte(i) for i in byte_ids) else None, sp.unk_id())

    def spell(self, char: str) -> tuple[int, ...]:
        """What stands for a character that is no piece."""
        return tuple(self.byte_ids[v] for v in char.encode()) if self.byte_ids else (self.unknown,)

    def edges(self, text: str) -> list[list[tuple[int, float, tuple]]]:
        """Edges by their end: ``(start, score, ids)``."""
        into: list[list] = [[] for _ in range(len(text) + 1)]
        number = self.numbers[np.frombuffer(text.encode("utf-32-le"), np.uint32)][None, :]
        place, size, piece = self._matches(number)
        for start, k, i in zip(place.tolist(), size.tolist(), piece.tolist(), strict=True):
            into[start + k].append((start, float(self.scores[i]), (i,)))
        for start in np.setdiff1d(np.arange(len(text)), place[size == 1]).tolist():
            into[start + 1].append((start, self.unknown_score, self.spell(text[start])))
        return into

    def _matches(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in rows of equally many characters: flat place of the start, length, id."""
        flat, long = numbers.ravel(), numbers.shape[1]
        at = np.arange(len(flat))
        node = np.zeros(len(flat), np.int64)
        room = long - at % max(1, long)
        out = [[np.zeros(0, np.int64)] * 3]
        for k in range(1, min(self.longest, long) + 1):
            key = node * self.width + flat[at + k - 1]
            where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[where] == key
            at, node = at[on], self.child[where[on]]
            piece = self.piece[node]
            ends = piece >= 0
            out.append([at[ends], np.full(int(ends.sum()), k), piece[ends]])
            further = room[at] > k
            at, node = at[further], node[further]
            if not len(at):
                break
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def nbest(self, text: str, n: int) -> list[tuple[float, tuple]]:
        """The ``n`` best segmentations ``(score, ids)``, best first; scores equal to nine decimals in order of ids.

        A* from the end: among entries of one score those further right go first, so a place is left
        only when all its tails of that score are known, and then in order of ids.  Of a place only
        ``n`` tails can be part of the ``n`` best, so ties are bounded.
        """
        into = self.edges(text)
        best = [0.0] + [-np.inf] * len(text)
        for end in range(1, len(text) + 1):
            best[end] = max(best[start] + score for start, score, _ in into[end])
        #: Tails by place: (score, ids of its first edge, place after it, which tail there)
        tails: dict[int, list[tuple]] = {}
        heap: list = [(round(-best[-1], 9), -len(text), (), 0, 0.0, len(text))]
        while heap and len(tails.get(0, ())) < n:
            _, at, ids, rest, done, after = heapq.heappop(heap)
            at = -at
            mine = tails.setdefault(at, [])
            if len(mine) == n:
                continue
            mine.append((done, ids, after, rest))
            for start, score, edge in into[at]:
                f = done + score + best[start]
                heapq.heappush(heap, (round(-f, 9), -start, edge, len(mine) - 1, done + score, at))
        out = []
        for done, ids, after, rest in tails.get(0, []):
            path, at = list(ids), after
            while at < len(text):
                _, ids, after, rest = tails[at][rest]
                path += ids
                at = after
            out.append((done, tuple(path)))
        return out

    def best_of_many(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For units of equally many characters (rows of numbers): best score, how far below it the
        second best lies, ids (rows, -1 after the end), and which rows this search leaves open.

        One A* search a row, all rows in step.  The heuristic is exact, so the entry to take next is
        a child of the last one, and of all others the frontier needs only its best bound: when the
        start is reached, that is the second best score.  Rows with ties or unknown characters stay open.
        """
        m, long = numbers.shape
        wide = min(self.longest, long)
        score = np.full((m, long + 1, wide), -np.inf)
        piece = np.full((m, long + 1, wide), -1, np.int32)
        place, size, i = self._matches(numbers)
        at = (place // long, place % long + size, size - 1)
        score[at], piece[at] = self.scores[i], i
        undone = (piece[:, 1:, 0] < 0).any(axis=1)
        score[:, 1:, 0] = np.where(piece[:, 1:, 0] < 0, self.unknown_score, score[:, 1:, 0])
        best = np.full((m, long + 1), -np.inf)
        best[:, 0] = 0
        for end in range(1, long + 1):
            k = min(wide, end)
            best[:, end] = (best[:, end - k : end][:, ::-1] + score[:, end, :k]).max(axis=1)
        total = best[:, long].copy()
        near = 1e-9 * (1 - total)
        rest = np.full(m, -np.inf)
        path = np.full((m, long), -1, np.int32)
        done, place, rows, back = np.zeros(m), np.full(m, long), np.arange(m), np.arange(1, wide + 1)
        for step in range(long - 1, -1, -1):
            start = place[rows, None] - back
            f = done[rows, None] + score[rows, place[rows]] + np.where(start >= 0, best[rows[:, None], np.maximum(start, 0)], -np.inf)
            pick = f.argmax(axis=1)
            mine = np.arange(len(rows))
            f[mine, pick] = -np.inf
            rest[rows] = np.maximum(rest[rows], f.max(axis=1))
            done[rows] += score[rows, place[rows], pick]
            path[rows, step] = piece[rows, place[rows], pick]
            place[rows] -= pick + 1
            rows = rows[place[rows] > 0]
            if not len(rows):
                break
        gap = total - rest
        return total, gap, path, undone | (gap <= near)

    def search(self, units: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best score, gap to the second best, ids and their ends for each of distinct units."""
        texts = tokens.strings(units)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(size) - size
        score, gap = np.zeros(len(texts)), np.zeros(len(texts))
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # which units, how many ids, ids
        alone = [np.flatnonzero(size > _LONG)]
        for long in np.unique(size[size <= _LONG]).tolist():
            same = np.flatnonzero(size == long)
            most = max(1, (1 << 20) // ((long + 1) * min(self.longest, long)))
            for a in range(0, len(same), most):
                rows = same[a : a + most]
                total, between, path, undone = self.best_of_many(self.numbers[points[first[rows, None] + np.arange(long)]])
                score[rows], gap[rows] = total, between
                alone.append(rows[undone])
                rows, path = rows[~undone], path[~undone]
                parts.append((rows, (path >= 0).sum(axis=1), path[path >= 0]))
        for u in np.concatenate(alone).tolist():
            two = self.nbest(texts[u], 2)
            score[u], gap[u] = two[0][0], two[0][0] - two[1][0] if len(two) > 1 else np.inf
            parts.append((np.array([u]), np.array([len(two[0][1])]), np.array(two[0][1])))
        if not parts:
            return score, gap, np.zeros(0, np.int64), np.zeros(1, np.int64)
        which, count, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids, ends = tokens.gather(ids, np.concatenate([[0], np.cumsum(count)]), np.argsort(which))
        return score, gap, ids, ends

    def units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The units of marked texts one after another, and how many lie before each text and after the last."""
        marked = pc.replace_substring(texts, " ", MARK)
        marked = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(MARK, marked, ""))
        text = "".join(marked.to_pylist())
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        chars = np.concatenate([[0], np.cumsum(pc.utf8_length(marked).to_numpy())])
        if not len(points):
            return pa.array([], pa.string()), np.zeros(len(chars), np.int64)
        number = self.numbers[points]
        a, b = number[:-1], number[1:]
        both = (a < _COMMON) & (b < _COMMON)
        opens = np.ones(len(points), bool)
        opens[1:] = ~self.common[np.where(both, a, 0), np.where(both, b, 0)]
        rare = np.flatnonzero(~both)
        if len(rare) and len(self.joined):
            key = a[rare].astype(np.int64) * self.width + b[rare]
            opens[rare + 1] = self.joined[np.minimum(np.searchsorted(self.joined, key), len(self.joined) - 1)] != key
        opens[chars[:-1][chars[:-1] < len(points)]] = True
        wide = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF).astype(np.int64)
        raw = np.concatenate([[0], np.cumsum(wide)])
        at = np.flatnonzero(opens)
        offsets = np.concatenate([raw[at], raw[-1:]]).astype(np.int32)
        out = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(text.encode()))
        return out, np.searchsorted(at, chars)

    def encode(self, texts: list[str] | pa.Array, n: int) -> list[list[tuple[float, np.ndarray]]]:
        """Each text's ``n`` best as ``(score, ids)``.

        Equal scores of a unit go in order of ids; equal scores of a text so that earlier units keep
        their better choices (the vector of choices in order).
        """
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        units, ends = self.units(texts)
        distinct = units.dictionary_encode()
        score, gap, ids, bounds = self.search(distinct.dictionary, n)
        which = distinct.indices.to_numpy()
        ids, bounds = tokens.gather(ids, bounds, which)
        score, gap = score[which], gap[which]
        choices: dict[str, list] = {}
        out = []
        for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            total, gaps, found = float(score[lo:hi].sum()), gap[lo:hi].copy(), ids[bounds[lo] : bounds[hi]]
            vary = []
            while len(vary) < min(n - 1, hi - lo):  # smallest gaps, of equals the last unit
                i = len(gaps) - 1 - int(gaps[::-1].argmin())
                if gaps[i] == np.inf:
                    break
                vary.append(i)
                gaps[i] = np.inf
            plans: list[tuple] = [(0.0, ())]
            for i in sorted(vary):  # n best sums of independent choices, unit by unit
                unit = units[lo + i].as_py()
                if unit not in choices:
                    choices[unit] = self.nbest(unit, n)
                c = choices[unit]
                plans = sorted((round(loss + c[0][0] - s, 9), (*done, j)) for loss, done in plans for j, (s, _) in enumerate(c))[:n]
            best = []
            for loss, picks in plans:
                parts, at = [], bounds[lo]
                for i, j in zip(sorted(vary), picks, strict=True):
                    if j:
                        parts += [ids[at : bounds[lo + i]], np.array(choices[units[lo + i].as_py()][j][1], ids.dtype)]
                        at = bounds[lo + i + 1]
                best.append((total - loss, np.concatenate([*parts, ids[at : bounds[hi]]]) if parts else found))
            out.append(best)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids (the mark added before the first word is taken off)."""
        data = tokens.gather(self.spelt, self.spelt_ends, ids)[0].tobytes()
        return data[1:].decode(errors="replace") if data[:1] == b" " else data.decode(errors="replace")


def lattice(path: str) -> Lattice:
    """This worker's lattice for a model file."""
    if path not in _lattices:
        _lattices[path] = Lattice.from_model(path)
    return _lattices[path]


def encode_nbest(docs: DataFrame, model_path: str, n: int = 3) -> DataFrame:
    """A row a document and rank: ``doc_id, rank`` (from 1), ``score, ids, decoded`` (is it the text again).

    Null text counts as empty: one segmentation of no pieces.  A text with fewer than ``n``
    segmentations gives those it has.  Ties have a fixed order (``Lattice.encode``).  A text that
    holds the mark itself decodes to one with spaces and says so.  Long texts are taken whole;
    repeated rows repeat; other columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        code = lattice(model_path)
        for b in batches:
            for part in tokens.slices(b, most=2_000_000):
                texts, rows = part.column("text"), []
                for d, t, best in zip(part.column("doc_id").to_pylist(), texts.to_pylist(), code.encode(texts, n), strict=True):
                    rows += [(d, r, s, ids.astype("<u4").tobytes(), code.decode(ids) == t) for r, (s, ids) in enumerate(best, 1)]
                kinds = [pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.bool_()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "rank", "score", "ids", "decoded"])

    return documents(docs).mapInArrow(run, "doc_id long, rank int, score double, ids binary, decoded boolean")


def nbest_digest(docs: DataFrame, model_path: str, n: int = 3) -> DataFrame:
    """``doc_id, rank, score, n_pieces, ids_crc32, decoded`` of every segmentation."""
    found = encode_nbest(docs, model_path, n)
    return found.select("doc_id", "rank", F.round("score", 6).alias("score"), (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "decoded")
