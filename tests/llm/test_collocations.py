"""Phrases against plain counting of every n-gram; minimal perfect hashes against a dictionary."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from logtide.llm import collocations, slots


def brute(rows, bar, longest=5, share=100, most=None):
    n, f, out = Counter(), defaultdict(Counter), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, at in f.items():
        found = {p: a for p, a in at.items() if len(p) > 1 and a >= bar}
        gone = {p[i : i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= share * at[p[i : i + k]]}
        rows_ = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (at[p[:k]] * at[p[k:]]), k) for k in range(1, len(p)))
                rows_.append((-score, -a, " ".join(p).encode(), at[p[:k]], at[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(rows_)[:most], 1):
            out.append((lang, i, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def table(spark, rows):
    full = [(t, x, i, "k", 7) for i, (t, x) in enumerate(rows)]
    return spark.createDataFrame(full, "text string, lang string, doc_id long, word string, SLOT int").repartition(3)


def odd_rows():
    r = random.Random(3)
    v = ["a", "b", "A", "été", "c,", "d.", "e f", "g", "ÉTÉ", "x\xa0y", "(z)"]
    rows = [(" ".join(r.choice(v) for _ in range(r.randint(0, 60))), r.choice(["en", "fr", None, "und", ""])) for _ in range(80)]
    return [*rows, (None, "en"), ("", None), ("a b c a b c a b c " * 300, "en"), ("\n\t", "en"), ("a a a a a a a a a\x0ba a", "de"), rows[0], rows[0], ("end", "en"), ("start", "en")]


def test_phrases(spark):
    rows = odd_rows()
    docs = table(spark, rows)
    want = brute(rows, 6)
    assert len(want) > 50 and any(x[0] == "und" for x in want)
    assert sorted(map(tuple, collocations.mine(docs, bar=6).collect())) == want
    assert sorted(map(tuple, collocations.mine(docs, bar=6, block_slots=4, most=7, share=60).collect())) == brute(rows, 6, share=60, most=7)


def test_phrases_of_nothing(spark):
    assert collocations.mine(table(spark, []).limit(0), bar=2).count() == 0
    assert collocations.mine(table(spark, [("one two", "en"), (None, None)]), bar=2).count() == 0
    assert collocations.mine(table(spark, [("one. one. one", "en")]), bar=2).count() == 0


def test_texts_do_not_touch():
    import pyarrow as pa

    *_, key, piece = collocations.words_of(pa.array(["a b", "c", "", "B a"])[1:], ["x", "x", "x"])
    assert len(key) == 3 and len(set(piece.tolist())) == 2


def test_flushes_and_saturated_counts(spark):
    r = np.random.default_rng(1)
    keys = [r.integers(0, 300, 900).astype(np.uint64) for _ in range(20)]
    stream = spark.createDataFrame([(bytearray(k.tobytes()),) for k in keys], "data binary").repartition(2)
    whole = Counter(np.concatenate(keys).tolist())
    for most in (100, 10_000):
        rows = collocations._phrase_parts(stream, 60, 5, most).collect()
        got = np.concatenate([np.frombuffer(x["keys"], np.uint64) for x in rows]).tolist()
        assert sorted(got) == sorted(k for k, n in whole.items() if n >= 60)


def test_minimal_perfect_hash():
    r = np.random.default_rng(2)
    keys = np.unique(np.concatenate([r.integers(0, 2**63, 5000).astype(np.uint64), np.arange(300, dtype=np.uint64)]))
    part = slots.part_of(keys, 7)
    rows = []
    for p in np.unique(part).tolist():
        sizes, bits, stored = slots.build(keys[part == p])
        rows.append((p, sizes, bits, stored.tobytes()))
    block = slots.Block(rows, 7)
    assert sorted(block.slots(keys).tolist()) == list(range(len(keys)))  # minimal and perfect
    assert (block.keys[block.slots(keys)] == keys).all()
    others = np.setdiff1d(r.integers(0, 2**63, 5000).astype(np.uint64), keys)
    assert (block.slots(np.append(others, slots.GAP)) == -1).all()
    late = slots.Block(rows[3:5], 7, base=100)
    got = late.slots(keys)
    assert ((got >= 0) == np.isin(part, [rows[3][0], rows[4][0]])).all() and got.max() == 100 + len(late) - 1
    assert (slots.Block([], 7).slots(keys) == -1).all()


def test_tree_sum(spark):
    r = np.random.default_rng(3)
    arrays = [r.integers(0, 10 ** (1 + i % 6), 50) for i in range(40)]
    rows = [(t, at, *(lambda w, d: (w, bytearray(d)))(*collocations._narrow(a))) for t, a in enumerate(arrays) for at in (0, 50)]
    total = collocations._tree_sum(spark.createDataFrame(rows, "task int, at long, width int, data binary").repartition(4))
    got = dict(map(tuple, collocations._by_slot(total).collect()))
    assert got == {at + i: int(n) for at in (0, 50) for i, n in enumerate(np.sum(arrays, axis=0))}


def test_streams_are_written_in_short_rows(spark, monkeypatch):
    r = random.Random(4)
    texts = [" ".join(r.choice("abc") + r.choice(["", "", "", "."]) for _ in range(6000)) for _ in range(30)]
    rows = [(t, "en") for t in texts]
    made, count = [], collocations.materialise
    monkeypatch.setattr(collocations, "materialise", lambda df, tag: made.append((tag, out := count(df, tag))) or out)
    docs = table(spark, rows)
    assert sorted(map(tuple, collocations.mine(docs, bar=100, block_slots=5).collect())) == brute(rows, 100)
    written = [t.where("kind = 0") for tag, t in made if tag == "keys"]
    sizes = [t.selectExpr("max(length(data))", "max(length(slots))", "sum(length(data))").first() for t in written]
    assert len(sizes) > 5 and max(x[2] or 0 for x in sizes) > 1_000_000
    assert max(x[0] or 0 for x in sizes) < 8 * (256 + 100) and max(x[1] or 0 for x in sizes) < 8 * (256 + 100)


def test_rows_join_to_slices_and_cut_at_gaps():
    import pyarrow as pa

    r = np.random.default_rng(5)
    keys = r.integers(0, 50, 300_000).astype(np.uint64)
    keys[r.random(len(keys)) < 0.1] = slots.GAP
    keys[5000:9000], keys[9000], keys[-1] = 1, slots.GAP, slots.GAP  # a run longer than a row
    batch = collocations._runs(3, keys, np.arange(len(keys)))
    rows = [np.frombuffer(x, np.uint64) for x in batch.column("data").to_pylist()]
    assert all(x[-1] == slots.GAP for x in rows) and len(rows) > 1000 and (np.concatenate(rows) == keys).all()
    got = list(collocations._stream_keys([batch.slice(0, 700), batch.slice(700), batch.slice(0, 0)]))
    assert (np.concatenate([k for k, _ in got]) == keys).all() and (np.concatenate([s for _, s in got]) == np.arange(len(keys))).all()
    assert len(got) < 10 and max(len(k) for k, _ in got) < 80_000
    assert all(s is None for _, s in collocations._stream_keys([collocations._runs(3, keys)]))
