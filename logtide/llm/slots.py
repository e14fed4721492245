"""Minimal perfect hashes over large key sets: parts built by tasks, read in blocks of bounded size.

A part numbers its n keys 0 to n - 1 without gaps.  Each of its levels is a bit array of about twice the
keys that are left; a key that is alone on its bit is placed there, the others go on to the next level.
A key's slot is the number of set bits before its own.  Slots of keys outside the set mean nothing, so each
slot's key is stored and compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import mix

#: Marks a gap in a stream of keys; never a key itself.
GAP = np.uint64(2**64 - 1)
_ROOM = 2.0
_LOW = np.uint64(32)


def _seed(level: int) -> np.uint64:
    return mix(np.array([level + 1], np.uint64))[0]


def _place(keys: np.ndarray, level: int, size) -> np.ndarray:
    return (((mix(keys ^ _seed(level)) >> _LOW) * np.asarray(size, np.uint64)) >> _LOW).astype(np.int64)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key: ranges of its mixed hash, so parts are of even size whatever the keys."""
    return (((mix(keys) >> _LOW) * np.uint64(parts)) >> _LOW).astype(np.int32)


def build(keys: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
    """``sizes`` of the levels, their ``bits`` and the keys by slot, for distinct uint64 keys."""
    sizes, bits, rest = [], [], keys
    while len(rest):
        size = -(-max(64, int(_ROOM * len(rest))) // 64) * 64
        at = _place(rest, len(sizes), size)
        count = np.bincount(at, minlength=size)
        sizes.append(size)
        bits.append(np.packbits(count == 1, bitorder="little").tobytes())
        rest = rest[count[at] > 1]
    data = b"".join(bits)
    stored = np.zeros(len(keys), np.uint64)
    block = Block([(0, sizes, data, stored.tobytes())], 1)
    stored[block.unchecked(keys)] = keys
    return sizes, data, stored


class Block:
    """Consecutive parts ``(part, sizes, bits, keys)`` of ``parts`` in all, slots counted from ``base``."""

    def __init__(self, rows: list[tuple], parts: int, base: int = 0):
        self.parts, self.base, self.first = parts, base, rows[0][0] if rows else 0
        self.keys = np.frombuffer(b"".join(bytes(r[3]) for r in rows), np.uint64)
        levels = max((len(r[1]) for r in rows), default=0)
        span = rows[-1][0] - self.first + 1 if rows else 0
        self.size, self.off = np.zeros((span, levels), np.int64), np.zeros((span, levels), np.int64)
        at = 0
        for part, sizes, _, _ in rows:
            for level, size in enumerate(sizes):
                self.size[part - self.first, level], self.off[part - self.first, level] = size, at
                at += size
        self.words = np.frombuffer(b"".join(bytes(r[2]) for r in rows) or b"\0" * 8, np.uint64)
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def __len__(self) -> int:
        return len(self.keys)

    def _hits(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        part = part_of(keys, self.parts) - self.first
        live = np.flatnonzero((part >= 0) & (part < len(self.size)) & (keys != GAP))
        part, keys = part[live], keys[live]
        for level in range(self.size.shape[1]):
            if not len(live):
                return
            size = self.size[part, level]
            pos = self.off[part, level] + _place(keys, level, size)
            word, bit = self.words[pos >> 6], (pos & 63).astype(np.uint64)
            hit = ((word >> bit) & np.uint64(1)).astype(bool) & (size > 0)
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            yield live[hit], self.rank[pos[hit] >> 6] + np.bitwise_count(below)
            live, part, keys = live[~hit], part[~hit], keys[~hit]

    def unchecked(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys known to be in the set."""
        out = np.zeros(len(keys), np.int64)
        for at, slot in self._hits(keys):
            out[at] = slot
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot, -1 for keys that the block does not hold."""
        out = np.full(len(keys), -1, np.int64)
        for at, slot in self._hits(keys):
            right = self.keys[slot] == keys[at]
            out[at[right]] = slot[right] + self.base
        return out
