"""Subword vocabulary (BPE) and its greedy encoder.

Words, their counts and their pieces stay in Spark tables.  A round counts adjacent pairs of pieces, shows the
driver the most frequent ones and merges in all words at once those that no other merge could have changed, so
the vocabulary is that of one merge after another.  The driver holds the vocabulary and one short list of pairs.
Encoding runs on distinct words and is joined back.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.masking import mask
from ..functions.vectors import words
from ..scratch import materialise
from ..sources.logs import sample_corpus

PAD, UNKNOWN = "[PAD]", "[UNK]"


def word_frequency(texts: DataFrame, text: str) -> DataFrame:
    return texts.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("count"))


@dataclass(frozen=True)
class Vocabulary:
    """Tokens and their ids; continuations carry ``##``."""

    ids: dict[str, int]

    @property
    def size(self) -> int:
        return len(self.ids)

    def encode_word(self, word: str) -> list[str]:
        """The whole word if known, else the longest known pieces from the left; unknown characters alone."""
        if word in self.ids:
            return [word]
        out, at = [], 0
        while at < len(word):
            lead = "##" if at else ""
            end = next((e for e in range(len(word), at, -1) if lead + word[at:e] in self.ids), 0)
            out.append(lead + word[at:end] if end else UNKNOWN)
            at = end or at + 1
        return out

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(sorted(self.ids.items(), key=lambda x: x[1]), "token string, id int")

    def encode(self, texts: DataFrame, key: str, text: str) -> DataFrame:
        """``key, tokens, ids`` of each text."""
        book = self.ids
        unknown = book.get(UNKNOWN, 1)
        at = texts.select(key, F.posexplode(words(F.col(text))).alias("at", "word"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            mine = Vocabulary(book)
            for b in batches:
                tokens = [mine.encode_word(w) for w in b["word"]]
                yield pd.DataFrame({"word": b["word"], "tokens": tokens, "ids": [[book.get(t, unknown) for t in ts] for ts in tokens]})

        coded = at.select("word").distinct().mapInPandas(run, "word string, tokens array<string>, ids array<int>")
        whole = at.join(coded, "word").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "tokens", "ids"))).alias("w"))
        return texts.select(key).join(whole, key, "left").select(
            key, F.coalesce(F.flatten("w.tokens"), F.array().cast("array<string>")).alias("tokens"), F.coalesce(F.flatten("w.ids"), F.array().cast("array<int>")).alias("ids")
        )


def merge_loop(counts: dict[str, int], vocab_size: int, min_freq: int, max_merges: int) -> dict[str, int]:
    """Placeholders whole, then characters, then the most frequent adjacent pairs (ties: the least pair).

    Pair counts and the words that hold a pair are kept up to date, so a merge touches only those; the next
    pair comes from a heap, whose outdated entries are passed over.
    """
    ids = {PAD: 0, UNKNOWN: 1}
    parts: list[list[str]] = []
    weight: list[int] = []
    for word, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        atomic = word.startswith("<") and word.endswith(">")
        if atomic:
            ids.setdefault(word, len(ids))
        elif n >= min_freq:
            parts.append(list(word))
            weight.append(n)
            for c in word:
                ids.setdefault(c, len(ids))
                ids.setdefault("##" + c, len(ids))
    pairs: Counter = Counter()
    where: dict[tuple[str, str], set[int]] = {}
    for i, p in enumerate(parts):
        for pair in zip(p, p[1:], strict=False):
            pairs[pair] += weight[i]
            where.setdefault(pair, set()).add(i)
    heap = [(-n, pair) for pair, n in pairs.items()]
    heapq.heapify(heap)
    for _ in range(max_merges):
        while heap and pairs.get(heap[0][1], 0) != -heap[0][0]:
            heapq.heappop(heap)
        if len(ids) >= vocab_size or not heap or -heap[0][0] < min_freq:
            break
        left, right = heapq.heappop(heap)[1]
        changed: set[tuple[str, str]] = set()
        ids.setdefault(left + right, len(ids))
        ids.setdefault("##" + left + right, len(ids))
        for i in where.pop((left, right)):
            old, new = parts[i], []
            for t in old:
                if new and new[-1] == left and t == right:
                    new[-1] = left + right
                else:
                    new.append(t)
            for pair in zip(old, old[1:], strict=False):
                pairs[pair] -= weight[i]
                changed.add(pair)
            for pair in zip(new, new[1:], strict=False):
                pairs[pair] += weight[i]
                changed.add(pair)
                where.setdefault(pair, set()).add(i)
            parts[i] = new
        pairs.pop((left, right), None)
        for pair in changed:
            if pairs.get(pair, 0) > 0:
                heapq.heappush(heap, (-pairs[pair], pair))
            else:
                pairs.pop(pair, None)
    return ids


def independent(top: list[tuple[str, str, int]], whole: bool) -> list[tuple[str, str, int]]:
    """Of pairs with counts, most frequent first, those that are merged next one after another whatever the merges do.

    A merge takes from, and makes, only pairs that touch its pieces, and a pair it makes is no more frequent than
    the one it took from.  So pairs are safe up to the first that touches an earlier one, as long as they
    are more frequent than it (or than the last pair of a list that is not ``whole``).
    """
    taken: set[str] = set()
    out: list[tuple[str, str, int]] = []
    bound = 0 if whole or not top else top[-1][2]
    for left, right, n in top:
        pieces = {left, right, left + right}
        if taken & pieces or (out and out[0][0] == out[0][1]):
            bound = max(bound, n)
            break
        out.append((left, right, n))
        taken |= pieces
        if left == right:  # a run of one piece makes pairs out of its own
            bound = max(bound, n)
            break
    return out[:1] + [x for x in out[1:] if x[2] > bound]


def merge_rounds(counts: DataFrame, vocab_size: int, min_freq: int, max_merges: int, listed: int = 256) -> dict[str, int]:
    """``merge_loop`` over a table ``word, count``, a round of independent merges at a time.

    A word of two letters or more holds ASCII letters and digits alone (``vectors.WORD``), so its pieces are kept
    as ``<piece><piece>``.
    """
    atomic = F.col("word").rlike("^<.*>$")
    found = materialise(counts.where(atomic | (F.col("count") >= min_freq)), "word-counts")
    place = F.struct((-F.col("count")).alias("n"), "word", "at")
    chars = found.where(~atomic).select("word", "count", F.posexplode(F.split("word", "")).alias("at", "token")).where("token <> ''")
    whole = found.where(atomic).select("word", "count", F.lit(0).alias("at"), F.col("word").alias("token"))
    first = chars.union(whole).groupBy("token").agg(F.min(place).alias("first")).orderBy("first")
    ids = {PAD: 0, UNKNOWN: 1}
    for r in first.toLocalIterator():  # characters and placeholders: part of the vocabulary
        ids.setdefault(r.token, len(ids))
        if not (r.token.startswith("<") and r.token.endswith(">")):
            ids.setdefault("##" + r.token, len(ids))
    pieces = F.concat(F.lit("<"), F.array_join(F.split("word", "(?<=.)(?=.)"), "><"), F.lit(">"))
    table = found.where(~atomic & (F.length("word") > 1)).select(pieces.alias("p"), F.col("count").alias("n"))
    done = rounds = 0
    while done < max_merges and len(ids) < vocab_size:
        if rounds % 8 == 0:
            table = materialise(table.groupBy("p").agg(F.sum("n").alias("n")), "pieces")
        rounds += 1
        ts = F.split(F.expr("substring(p, 2, length(p) - 2)"), "><")
        pairs = table.select("n", ts.alias("ts")).select("n", F.explode(F.arrays_zip(F.slice("ts", 1, F.size("ts") - 1).alias("l"), F.slice("ts", 2, F.size("ts") - 1).alias("r"))).alias("pair"))
        best = pairs.groupBy("pair.l", "pair.r").agg(F.sum("n").alias("n")).where(F.col("n") >= min_freq).orderBy(F.desc("n"), "l", "r").limit(listed).collect()
        merged = F.col("p")
        if not best:
            break
        for left, right, _ in independent([(r.l, r.r, r.n) for r in best], len(best) < listed):
            if done == max_merges or len(ids) >= vocab_size:
                break
            ids.setdefault(left + right, len(ids))
            ids.setdefault("##" + left + right, len(ids))
            merged = F.replace(merged, F.lit(f"<{left}><{right}>"), F.lit(f"<{left}{right}>"))
            done += 1
        table = table.select(merged.alias("p"), "n")
    return ids


def train(texts: DataFrame, text: str, vocab_size: int = 2000, min_freq: int = 2, max_merges: int = 4000) -> Vocabulary:
    """Fit on every word that occurs ``min_freq`` times; rarer ones go, placeholders stay."""
    return Vocabulary(merge_rounds(word_frequency(texts, text), vocab_size, min_freq, max_merges))


def bootstrap(spark: SparkSession, lines: int = 300, vocab_size: int = 1500) -> Vocabulary:
    """A first vocabulary, from masked lines of the sample corpus, so that placeholders are in it.

    The sample is bounded by ``lines``, so its words are merged on the driver."""
    masked = sample_corpus(spark, lines).select(mask(F.col("line")).alias("masked"))
    found = word_frequency(masked, "masked").where((F.col("count") >= 2) | F.col("word").rlike("^<.*>$"))
    return Vocabulary(merge_loop({r.word: r["count"] for r in found.collect()}, vocab_size, 2, 4000))


def retrain(lines: DataFrame, line: str = "line", vocab_size: int = 2000) -> Vocabulary:
    """A vocabulary of masked real traffic, to use in place of the first one."""
    return train(lines.select(mask(F.col(line)).alias("masked")), "masked", vocab_size)
