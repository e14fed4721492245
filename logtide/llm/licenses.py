"""License scans: phrases, and templates with optional and replaceable regions as token automata.

Template markup: ``<<optional>>...<<end>>`` may be absent (regions nest), ``<<var LOW-HIGH>>`` stands for so many
words of any kind, ``<<one of>>a b|c<<end>>`` for one of the wordings.  All else is mandatory wording, compared word
by word in lower case.  A template compiles to a nondeterministic automaton over words, whose sets of states are
made deterministic as texts reach them.  A text holds the license where the automaton reaches its end, so every
mandatory word was there, in order, with nothing between but what the markup allows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import batch_words, byte_values, documents, mix, prefix_hash, spans_hash

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = byte_values(_LOWER.tobytes())
#: 0 for the bytes of words, `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` once A-Z are lower case.
_KIND = np.ones(256, np.uint8)
_KIND[0x30:0x3A] = _KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:] = 0

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_BSD_OPEN = """redistribution and use in source and binary forms with or without modification are permitted provided that the
following conditions are met <<optional>><<one of>>1|a<<end>><<end>> redistributions of source code must retain the above copyright notice
this list of conditions and the following disclaimer <<optional>><<one of>>2|b<<end>><<end>> redistributions in binary form must reproduce
the above copyright notice this list of conditions and the following disclaimer in the documentation and or other
materials provided with the distribution"""
_BSD_CLOSE = """this software is provided by <<var 1-12>> as is and any express or implied warranties including but not
limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"""

#: Label, markup; public notices and texts, from their first mandatory word.
TEMPLATES = [
    ("mit-notice", "<<one of>>released|licensed|distributed|available<<end>> under the <<optional>>terms of the<<end>> mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", """licensed under the apache license version 2 0 the license you may not use this <<one of>>file|work|software<<end>> except in
compliance with the license you may obtain a copy of the license at <<var 1-12>> unless required by applicable law or agreed to in writing
software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"""),
    ("gpl-notice", "<<one of>>licensed|released|distributed<<end>> under <<optional>>the terms of<<end>> the gnu <<optional>><<one of>>lesser|affero<<end>><<end>> general public license"),
    ("gpl-2.0", "licensed under the gnu general public license <<optional>>gpl<<end>> version 2"),
    ("gpl-3.0", "licensed under the gnu general public license <<optional>>gpl<<end>> version 3"),
    ("gpl-any-later", """free software you can redistribute it and or modify it under the terms of the gnu <<optional>><<one of>>lesser|affero<<end>><<end>>
general public license as published by the free software foundation either version <<var 1-2>> of the license or <<optional>>at your option<<end>> any later version"""),
    ("cc-by-nc", "licensed under <<optional>>a<<end>> <<one of>>cc by nc|creative commons attribution non commercial|creative commons attribution noncommercial<<end>> <<optional>>license<<end>> <<one of>>1|2|3|4<<end>> <<one of>>0|5<<end>>"),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of <<one of>>this software|<<var 1-5>><<end>> and associated documentation
files <<optional>>the software<<end>> to deal in <<one of>>the software|<<var 1-5>><<end>> without restriction including without limitation the rights to use copy modify merge
publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject
to the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<<end>> shall be included in all
copies or substantial portions of the software"""),
    ("isc", """permission to use copy modify and <<optional>>or<<end>> distribute this software for any purpose with or without fee is hereby granted provided
that the above copyright notice and this permission notice appear in all copies"""),
    ("bsd-2-clause", f"{_BSD_OPEN} {_BSD_CLOSE}"),
    ("bsd-3-clause", f"""{_BSD_OPEN} <<optional>><<one of>>3|c<<end>><<end>> neither the name of <<var 1-12>> nor the names of its contributors may be used to endorse
or promote products derived from this software without specific prior written permission {_BSD_CLOSE}"""),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications
and to alter it and redistribute it freely"""),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

_MARK = re.compile(r"<<(optional|one of|end|var (\d+)-(\d+))>>|(\|)|([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)")


def parse(markup: str) -> list[tuple]:
    """Nodes ``("word", w)``, ``("var", low, high)``, ``("optional", nodes)``, ``("one of", [nodes, ...])``."""
    stack: list[tuple[str, list[list[tuple]]]] = [("", [[]])]
    for m in _MARK.finditer(markup.lower()):
        mark, low, high, bar, word = m.groups()
        here = stack[-1][1][-1]
        if word:
            here.append(("word", word))
        elif bar:
            stack[-1][1].append([])
        elif low:
            if not 0 < int(high) <= 1000 or int(low) > int(high):
                raise ValueError(f"no such number of words: {m[0]}")
            here.append(("var", int(low), int(high)))
        elif mark != "end":
            stack.append((mark, [[]]))
        else:
            kind, parts = stack.pop()
            if not stack or (kind == "optional" and len(parts) > 1) or not all(parts):
                raise ValueError(f"a region is empty or does not close: {markup}")
            stack[-1][1][-1].append((kind, parts[0] if kind == "optional" else parts))
    if len(stack) > 1 or len(stack[0][1]) > 1:
        raise ValueError(f"a region does not close: {markup}")
    return stack[0][1][0]


def units(nodes: list[tuple]) -> int:
    """Mandatory units: words and choices outside optional regions."""
    return sum(n[0] in ("word", "one of") for n in nodes)


class Automaton:
    """Nondeterministic automaton of a template; states carry how many mandatory units lie before them."""

    def __init__(self, label: str, nodes: list[tuple], number: dict[str, int]):
        self.label, self.total = label, units(nodes)
        if self.total < 5 or nodes[-1][0] not in ("word", "one of"):
            raise ValueError(f"a template has five mandatory units at least and ends with one: {label}")
        self.by_word: list[dict[int, list[int]]] = []
        self.by_any: list[list[int]] = []
        self.free: list[list[int]] = []
        self.passed: list[int] = []
        start = self._state(0)
        self.end = self._sequence(start, nodes, 0, number, True)
        self._sets: dict[frozenset, int] = {}
        self._members: list[tuple[frozenset, int, bool]] = []
        self._next: dict[tuple[int, int], int] = {}
        self.start = self._number(self._closed({start}))

    def _state(self, passed: int) -> int:
        for table, new in ((self.by_word, {}), (self.by_any, []), (self.free, []), (self.passed, passed)):
            table.append(new)
        return len(self.passed) - 1

    def _sequence(self, at: int, nodes: list[tuple], passed: int, number: dict[str, int], counted: bool) -> int:
        for node in nodes:
            kind = node[0]
            passed += counted and kind in ("word", "one of")
            out = self._state(passed)
            if kind == "word":
                self.by_word[at].setdefault(number[node[1]], []).append(out)
            elif kind == "var":
                for i in range(node[2]):
                    if i >= node[1]:
                        self.free[at].append(out)
                    more = self._state(passed)
                    self.by_any[at].append(more)
                    at = more
                self.free[at].append(out)
            else:
                before = self.passed[at]
                for part in [node[1]] if kind == "optional" else node[1]:
                    self.free[self._sequence(at, part, before, number, False)].append(out)
                if kind == "optional":
                    self.free[at].append(out)
            at = out
        return at

    def _closed(self, states: set[int]) -> frozenset:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return frozenset(states)

    def _number(self, states: frozenset) -> int:
        if states not in self._sets:
            self._sets[states] = len(self._members)
            self._members.append((states, max((self.passed[s] for s in states), default=0), self.end in states))
        return self._sets[states]

    def step(self, state: int, word: int) -> int:
        """The set of states after a word (0: one that no template has); an empty set is the end of the way."""
        after = self._next.get((state, word))
        if after is None:
            out: set[int] = set()
            for s in self._members[state][0]:
                out.update(self.by_word[s].get(word, ()))
                out.update(self.by_any[s])
            after = self._next[state, word] = self._number(self._closed(out))
        return after

    def read(self, ids: list[int], at: int, end: int) -> tuple[int, int | None]:
        """From place ``at``: mandatory units passed at the furthest, and where the longest match ends if there is one."""
        state, most, match = self.start, 0, None
        for i in range(at, end):
            state = self.step(state, ids[i])
            states, passed, accepts = self._members[state]
            if not states:
                break
            most = max(most, passed)
            if accepts:
                match = i + 1
        return most, match


@dataclass(frozen=True)
class Scanner:
    """Phrases and automata with the words they know."""

    phrases: list[tuple[list[int], str]]
    automata: list[Automaton]
    known: np.ndarray
    ids: np.ndarray
    opens: dict[int, list[Automaton]]
    second: np.ndarray

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each word's number (0: unknown) and where each text's words begin."""
        data, bounds, start, end, _ = batch_words(texts, _KIND)
        h = mix(spans_hash(prefix_hash(_VALUE[data]), start, end) + (end - start).astype(np.uint64))
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, self.ids[at], 0), np.searchsorted(start, bounds)

    def scan(self, words: list[int] | np.ndarray) -> tuple[list[tuple[int, str]], list[tuple[str, int, int]], float]:
        """Of one text: phrase places with labels, longest matches ``label, start, end``, and the score."""
        w = np.asarray(words)
        found = [(i, label) for phrase, label in self.phrases for i in _places(w, phrase)]
        matches, score, past = [], 0.0, {}
        begins = np.flatnonzero(self.second[w[:-1], w[1:]]) if len(w) > 1 else []
        ids = w.tolist() if len(begins) else []
        for i in map(int, begins):
            for automaton in self.opens[ids[i]]:
                if i >= past.get(id(automaton), 0):
                    passed, end = automaton.read(ids, i, len(ids))
                    score = max(score, 4 * passed // automaton.total / 4)
                    if end is not None:
                        matches.append((automaton.label, i, end))
                        past[id(automaton)] = end
        return sorted(found), matches, score


def _places(w: np.ndarray, phrase: list[int]) -> list[int]:
    n = len(w) - len(phrase) + 1
    if n < 1:
        return []
    hit = w[:n] == phrase[0]
    for k, p in enumerate(phrase[1:], start=1):
        hit &= w[k : n + k] == p
    return np.flatnonzero(hit).tolist()


def compiled(templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> Scanner:
    """A scanner of (label, markup) templates and of phrases with labels."""
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    parsed = [(label, parse(markup)) for label, markup in templates]

    def words(nodes):
        for n in nodes:
            if n[0] == "word":
                yield n[1]
            elif n[0] != "var":
                for part in [n[1]] if n[0] == "optional" else n[1]:
                    yield from words(part)

    vocabulary = sorted({w for _, nodes in parsed for w in words(nodes)} | {w for p in phrases for w in p.split()})
    number = {w: i + 1 for i, w in enumerate(vocabulary)}
    hashes = np.array([mix(spans_hash(prefix_hash(byte_values(b := w.encode())), np.array([0]), np.array([len(b)])) + np.uint64(len(b)))[0] for w in vocabulary] or [0], np.uint64)
    order = np.argsort(hashes)
    automata = [Automaton(label, nodes, number) for label, nodes in parsed]
    opens: dict[int, list[Automaton]] = {}
    second = np.zeros((len(vocabulary) + 1,) * 2, bool)
    for a in automata:  # no way that ends after one word can count: it has less than a quarter of the units
        for w in range(len(vocabulary) + 1):
            if a._members[one := a.step(a.start, w)][0]:
                opens.setdefault(w, []).append(a)
                for x in range(len(vocabulary) + 1):
                    second[w, x] |= bool(a._members[a.step(one, x)][0])
    ids = order + 1 if vocabulary else np.zeros(1, np.int64)
    return Scanner([([number[w] for w in p.split()], label) for p, label in phrases.items()], automata, hashes[order], ids, opens, second)


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches`` for every row.

    Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased.  ``n_base`` counts all places of
    phrases, ``first_word`` and ``last_word`` are the smallest and largest of these (null without any); ``matches`` are the
    templates' longest matches ``label, start, end`` in words, those of one template apart from each other.  Labels
    are distinct, sorted and joined by commas.  ``score`` is the largest share, in quarters, of a template's mandatory wording
    that the text holds in order from the template's beginning; 1 says that a template matches.

    Null text counts as empty: no words, empty labels, score 0.  Very long texts are scanned whole, repeated rows and
    null doc_ids get a row each, an empty table gives none; other columns play no part.
    """
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    compiled(templates, phrases)  # faults of the markup show here
    place = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label: string, start: long, end: long>>"
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(place)]
    names = [c.split()[0] for c in schema.split(", ")[:9]]

    def run(batches):
        scanner = compiled(templates, phrases)
        for batch in batches:
            for part in tokens.slices(batch):
                words, edge = scanner.numbers(part.column("text"))
                rows = []
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    found, matches, score = scanner.scan(words[a:b])
                    base = {label for _, label in found}
                    at = [i for i, _ in found]
                    every = base | {m[0] for m in matches}
                    shown = [{"label": x, "start": i, "end": j} for x, i, j in matches]
                    rows.append((doc_id, b - a, len(found), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(every)), score, shown))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return documents(docs).mapInArrow(run, schema)


def to_regex(nodes: list[tuple], quarter: int = 4) -> str:
    """A template, or its first so many quarters of mandatory units, as an expression for words that end with a space."""
    total, out, passed = units(nodes), "", 0
    for n in nodes:
        out += _node_regex(n)
        passed += n[0] in ("word", "one of")
        if 4 * passed >= quarter * total:
            break
    return out


def _node_regex(node: tuple) -> str:
    if node[0] == "word":
        return f"{node[1]} "
    if node[0] == "var":
        return f"(?:[^ ]+ ){{{node[1]},{node[2]}}}"
    if node[0] == "optional":
        return f"(?:{''.join(map(_node_regex, node[1]))})?"
    return f"(?:{'|'.join(''.join(map(_node_regex, part)) for part in node[1])})"
