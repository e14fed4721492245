"""Line, passage and suffix-order de-duplication against plain brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logtide.llm import cotraining, lines, passages, repeats, simhash, suffixes
from logtide.llm.common import word_hashes

LAST = (1 << 63) - 1
WHITE = " \t\n\x0b\x0c\r"


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def brute_lines(rows):
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[low(line.strip(WHITE))].add(LAST if i is None else i)
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not (len(k := low(x.strip(WHITE))) >= 10 and (LAST if i is None else i) > min(held[k]))]
        out.append((i, len(all_lines), len(all_lines) - len(kept), sha("\n".join(kept).encode())))
    return Counter(out)


def test_lines(docs, none, rows):
    done = lines.dedup_lines(docs)
    assert set(docs.columns) <= set(done.columns)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, sha(r.text.encode())) for r in done.collect()) == brute_lines(rows)
    assert lines.dedup_lines(none).count() == 0


def covered(n, starts, length):
    edge = np.zeros(n + 1, int)
    for s in starts:
        edge[s] += 1
        edge[s + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def brute_bytes(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[s : s + length] for b in texts for s in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, texts, strict=True):
        gone = covered(len(b), [s for s in range(len(b) - length + 1) if seen[b[s : s + length]] > 1], length)
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return Counter(out)


@pytest.mark.parametrize("dense", [4000, 1])
def test_bytes(docs, none, rows, dense):
    done = suffixes.remove_repeats(docs, length=60, gram=12, dense=dense)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.data))) for r in done.collect())
    assert got == brute_bytes(rows, 60)
    assert suffixes.remove_repeats(none, length=60, gram=12).count() == 0


@pytest.mark.parametrize("dense", [4000, 1])
def test_bytes_keep_the_first_copy(spark, rows, dense):
    unique = {}
    for i, t in rows:
        if i is not None and i not in unique:
            unique[i] = t
    docs = spark.createDataFrame(list(unique.items()), "doc_id long, text string")
    done = suffixes.remove_repeats(docs, length=60, gram=12, dense=dense, keep_first=True)
    seen, want = set(), Counter()
    for i in sorted(unique):
        b = (unique[i] or "").encode()
        starts = []
        for s in range(len(b) - 60 + 1):
            w = b[s : s + 60]
            if w in seen:
                starts.append(s)
            seen.add(w)
        gone = covered(len(b), starts, 60)
        want[(i, int(gone.sum()), sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))] += 1
    assert Counter((r.doc_id, r.n_removed, sha(bytes(r.data))) for r in done.collect()) == want


def brute_words(rows, length):
    texts = [(LAST if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in texts:
        for s in range(len(w) - length + 1):
            k = tuple(w[s : s + length])
            first[k] = min(first.get(k, LAST), i)
    out = []
    for (i, _), (d, w) in zip(rows, texts, strict=True):
        gone = covered(len(w), [s for s in range(len(w) - length + 1) if first[tuple(w[s : s + length])] < d], length)
        out.append((i, len(w), int(gone.sum()), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return Counter(out)


@pytest.mark.parametrize(("length", "dense"), [(50, 256), (13, 256), (12, 256), (12, 1), (2, 256)])
def test_words(docs, none, rows, length, dense):
    done = passages.remove_passages(docs, length=length, dense=dense)
    assert set(docs.columns) <= set(done.columns)
    got = Counter((r.doc_id, r.n_words, r.n_removed, sha(b" ".join((r.text or "").encode().split()))) for r in done.collect())
    assert got == brute_words(rows, length)
    assert passages.remove_passages(none).count() == 0


def test_longest_previous_factor():
    for data in (b"", b"a", b"aaaa", b"abracadabra", b"mississippi", bytes(np.random.default_rng(1).integers(97, 99, 120, dtype=np.uint8))):
        want = [max((m for j in range(i) for m in range(len(data) - i + 1) if data[i : i + m] == data[j : j + m]), default=0) for i in range(len(data))]
        assert suffixes.longest_previous_factor(data).tolist() == want


def test_windows_are_filed_once_each():
    values = word_hashes(b" ".join(b"w%d" % (i % 37) for i in range(300)))
    lo, n, off, anchor, rng = repeats.by_window(values, 20, 5)
    assert n.sum() == 300 - 20 + 1 and (lo[1:] == lo[:-1] + n[:-1]).all() and (off >= 0).all()
    assert len(set(zip(anchor.tolist(), rng.tolist(), strict=True))) < len(lo)




def kept_values(done, names):
    return all(r[c] == f"{c}={r.doc_id}" for r in done.collect() for c in names)


def test_clashing_names(clashing, rows):
    names = clashing.columns[5:]
    done = lines.dedup_lines(clashing)
    mine = [c for c in names if c.lower() not in ("n_lines", "n_dropped")]
    assert len({c.lower() for c in done.columns}) == len(done.columns) and kept_values(done.select("doc_id", *(f"`{c}`" for c in mine)), mine)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, sha(r.text.encode())) for r in done.collect()) == brute_lines(rows)
    done = passages.remove_passages(clashing)
    mine = [c for c in names if c.lower() not in ("n_words", "n_removed")]
    assert len({c.lower() for c in done.columns}) == len(done.columns) and kept_values(done.select("doc_id", *(f"`{c}`" for c in mine)), mine)
    assert Counter((r.doc_id, r.n_words, r.n_removed, sha(b" ".join((r.text or "").encode().split()))) for r in done.collect()) == brute_words(rows, 50)
    for kept in (simhash.keep_first(clashing), cotraining.keep_good(clashing, None)):
        assert kept.columns == clashing.columns and kept_values(kept.select("doc_id", *(f"`{c}`" for c in names)), names)
    assert suffixes.remove_repeats(clashing).count() == len(rows)


@pytest.mark.parametrize("least", [2, 3])
def test_line_threshold(docs, rows, least):
    done = lines.dedup_lines(docs, min_docs=least)
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[low(line.strip(WHITE))].add(LAST if i is None else i)
    gone = Counter()
    for i, t in rows:
        keys = [low(x.strip(WHITE)) for x in (t or "").split("\n")]
        gone[(i, sum(len(k) >= 10 and len(held[k]) >= least and (LAST if i is None else i) > min(held[k]) for k in keys))] += 1
    assert Counter((r.doc_id, r.n_dropped) for r in done.collect()) == gone


def same_short_hash(spark):
    """Two texts whose 32-bit ``hash`` is equal, found by counting."""
    numbers = spark.range(200_000).selectExpr("concat('a number spelled out as ', id, ' of many more') as t").selectExpr("t", "hash(t) as h")
    pair = numbers.groupBy("h").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a < b").orderBy("h").first()
    return pair.a, pair.b


@pytest.mark.parametrize("doc_id", [None, 7])
def test_rows_without_an_id_of_their_own_keep_apart(spark, doc_id):
    """One of two texts with equal 32-bit hashes repeats elsewhere; the other must not lose its words."""
    a, b = same_short_hash(spark)
    table = spark.createDataFrame([(doc_id, a), (doc_id, b), (1, a)], "doc_id long, text string")
    length = len(a) - 2
    removed = {(r.n_bytes, r.n_removed > 0, bytes(r.data) == b.encode()) for r in suffixes.remove_repeats(table, length=length, gram=4).collect()}
    assert (len(b), False, True) in removed and (len(a), True, False) in removed
    kept = [r.text for r in passages.remove_passages(table, length=9).collect()]
    assert b in kept and kept.count(a) == 1
