"""Encoding, packing, token files and n-best segmentation: exact round trips and brute force."""

import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest

from logtide.llm import packing, pieces, token_files, tokens

P = pytest.importorskip("public_tokenizers")
ODD = ["", " ", "\n", "a\xa0b\n \xa0c  d", "  x  \n\n y's it's\t\tz \n", "\x1cfoo \x1d bar", "<|endoftext|> hi <|startoftext|>", " a b", "a b ", "a\n\nb c", "　x y", "x y", "A'S B'Re 12 3a4", "İstanbul ΣΑΣ. É, é."]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(rows, name):
    texts = [t or "" for _, t in rows] + ODD
    code = tokens.Encoder(P.path(name))
    want = [e.ids for e in code.library.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in code.encode(texts)] == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_with_small_generations_of_stems(rows, name):
    texts = [t or "" for _, t in rows] + ODD
    code = tokens.Encoder(P.path(name))
    code.most_bytes = 600
    want = [e.ids for e in code.library.encode_batch(texts, add_special_tokens=False)]
    for step in (1, 7, 50):
        got = [x for i in range(0, len(texts), step) for x in code.encode(texts[i : i + step])]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert len(code.old.hash) and code.stems.held < 1 << 20


def expected(rows, name):
    code = tokens.Encoder(P.path(name))
    return [(d, np.array([*code.library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for d, t in rows]


def test_packing(docs, none, rows):
    got = packing.pack(docs, P.path("word_bpe_49k.json"), capacity=256, group_tokens=2000, with_ids=True).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.array(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.start, r.length, ids.tobytes()))
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
        padding += 0 if at & (at - 1) == 0 else 256 - at
    assert padding == 0
    whole = expected(rows, "word_bpe_49k.json")
    assert sum(r.length for r in got) == sum(len(x) for _, x in whole)
    for d, x in whole:
        if sum(e[0] == d for e in whole) == 1:
            assert b"".join(p[2] for p in sorted(by_doc[d])) == x.tobytes()
    assert packing.pack(none, P.path("word_bpe_49k.json")).count() == 0


def test_assignment_balances_cost():
    r = np.random.default_rng(3)
    lengths = r.integers(1, 3000, 400).tolist()
    pieces_ = packing.assign(lengths, 4096)
    cost = defaultdict(float)
    for _, _, n, s, _ in pieces_:
        cost[s] += n + n * n / 4096
    full = [c for s, c in cost.items() if s < sum(lengths) // 4096]
    assert max(full) < 2 * min(full)
    assert packing.capacities(5000, 4096) == [4096, 512, 256, 128, 8]


def plain_assign(lengths, capacity):
    """The same rule with lists: descending documents to the cheapest sequence with room, else a cut."""
    total = sum(lengths)
    rooms = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if total % capacity >> b & 1]
    cost, used, out = [0.0] * len(rooms), [0] * len(rooms), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start = 0
        while start < lengths[item]:
            left = lengths[item] - start
            fitting = [s for s in range(len(rooms)) if rooms[s] - used[s] >= left] or [s for s in range(len(rooms)) if rooms[s] > used[s]]
            s = min(fitting, key=lambda s: (cost[s], s))
            n = min(left, rooms[s] - used[s])
            out.append((item, start, n, s, used[s]))
            cost[s] += n + n * n / 4096
            used[s] += n
            start += n
    return out


def test_assignment_equals_plain_lists():
    r = np.random.default_rng(6)
    for capacity in (64, 4096):
        for _ in range(6):
            lengths = r.integers(0, 3 * capacity, r.integers(1, 60)).tolist()
            assert packing.assign(lengths, capacity) == plain_assign(lengths, capacity)
    assert packing.assign([], 64) == []


def test_token_files(spark, docs, none, rows, tmp_path):
    path = f"file://{tmp_path}/t"
    token_files.write(docs, path, P.path("byte_bpe_50k.json"), block_bytes=2000)
    got = sorted(((r.start, r.doc_id, tuple(r.ids), r.ids_crc32, r.n_tokens) for r in token_files.read(spark, path, with_ids=True).collect()), key=lambda x: x[0])
    ids = expected(rows, "byte_bpe_50k.json")
    assert sorted((g[1] is not None, g[1], g[2]) for g in got if g[1] is not None) == sorted((True, d, tuple(x.tolist())) for d, x in ids if d is not None)
    at, last = 0, -1
    for start, d, x, crc, n in got:
        assert start == at and n == len(x) and crc == zlib.crc32(np.array(x, "<u4").tobytes())
        assert (-1 if d is None else d) >= last
        at, last = at + n, -1 if d is None else d
    some = token_files.read(spark, path, doc_ids=[4, 7]).collect()
    assert sorted((r.doc_id, r.start) for r in some) == sorted((g[1], g[0]) for g in got if g[1] in (4, 7))
    token_files.write(none, path + "0", P.path("byte_bpe_50k.json"))
    assert token_files.read(spark, path + "0").count() == 0


def brute_nbest(lattice, text, n):
    """All segmentations of a marked, short text: the n best, equal scores in order of ids."""
    out = []
    for cuts in itertools.product([0, 1], repeat=max(0, len(text) - 1)):
        edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(text)]
        total, ids = 0.0, ()
        for a, b in itertools.pairwise(edges):
            part = text[a:b]
            if part in lattice.ids:
                total += lattice.scores[lattice.ids[part]]
                ids += (lattice.ids[part],)
            elif len(part) == 1:
                total += lattice.unknown_score
                ids += lattice.spell(part)
            else:
                break
        else:
            out.append((round(float(total), 9), ids))
    return sorted(out, key=lambda x: (-x[0], x[1]))[:n]


SMALL = [("a", -1.0), ("b", -1.5), ("ab", -1.9), ("aba", -2.4), ("▁", -2.0), ("▁a", -2.2), ("▁ab", -2.6), ("ba", -2.1)]
ADDITIVE = [("a" * k, -1.0 * k) for k in (3, 1, 2)] + [("▁", -1.0)]


@pytest.fixture(scope="module")
def public():
    return pieces.Lattice.from_model(P.path("piece_bpe_32k.model"))


def marked(text):
    return pieces.MARK + text.replace(" ", pieces.MARK) if text else ""


def test_nbest_is_exact(public):
    models = (public, pieces.Lattice(SMALL, None), pieces.Lattice(ADDITIVE, None))
    for model in models:
        for text in ("", "a", "ab ab", "abab ba", "the cat", "aab b", "  a", "é漢 a", "aaaaaaaaa", "aa aaa", "b#a"):
            want = brute_nbest(model, marked(text), 5)
            assert [(round(s, 9), ids) for s, ids in model.nbest(marked(text), 5)] == (want if text else [(0.0, ())]), text
            (got,) = model.encode([text], 5)
            assert np.allclose([s for s, _ in got], [w[0] for w in want] or [0.0]), text
            assert tuple(got[0][1].tolist()) == (want[0][1] if want else ())
            assert len({tuple(ids.tolist()) for _, ids in got}) == len(got)
            if model is public:
                assert all(model.decode(ids) == text for _, ids in got)
        together = model.encode(["ab ab", "", "the cat", "é漢 a"], 4)
        for text, best in zip(["ab ab", "", "the cat", "é漢 a"], together, strict=True):
            assert [(s, i.tolist()) for s, i in best] == [(s, i.tolist()) for s, i in model.encode([text], 4)[0]]


def test_ties_are_bounded_and_in_order_of_ids():
    model = pieces.Lattice(ADDITIVE, None)
    for long in (41, 60, 2000):  # every segmentation has the same score
        got = model.nbest("a" * long, 3)
        assert [s for s, _ in got] == [-float(long)] * 3
        assert got[0][1] == (0,) * (long // 3) + {0: (), 1: (1,), 2: (1, 1)}[long % 3]
        assert [i for _, i in got] == sorted(i for _, i in got)
        (texts,) = model.encode(["a" * long], 3)
        assert len({tuple(i.tolist()) for _, i in texts}) == 3
    many = model.encode(["a" * 45 + " " + "a" * 44] * 3, 4)
    assert all(len(b) == 4 and len({s for s, _ in b}) == 1 for b in many)


def test_equal_texts_keep_earlier_choices():
    model = pieces.Lattice([("a", -1.0), ("aa", -2.0), ("▁", -1.0)], None)
    (got,) = model.encode(["aa aa aa"], 3)  # each unit has two segmentations of one score
    assert [i.tolist() for _, i in got] == [[2, 0, 0, 2, 0, 0, 2, 0, 0], [2, 0, 0, 2, 0, 0, 2, 1], [2, 0, 0, 2, 1, 2, 0, 0]]


def test_decoding_agrees_with_the_library(spark, docs, none, rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    found = pieces.encode_nbest(docs, P.path("piece_bpe_32k.model"), 3).collect()
    assert all(r.decoded for r in found)
    assert {r.doc_id for r in found} == {d for d, _ in rows}
    texts = dict(rows)
    for r in [r for r in found if r.doc_id in (1, 4, 16)][:6]:
        assert library.decode(np.frombuffer(bytes(r.ids), "<u4").tolist()) == texts[r.doc_id]
    assert pieces.encode_nbest(none, P.path("piece_bpe_32k.model")).count() == 0
    held = spark.createDataFrame([(1, "x▁y"), (2, "x y")], "doc_id long, text string")
    assert {(r.doc_id, r.decoded) for r in pieces.encode_nbest(held, P.path("piece_bpe_32k.model")).collect()} == {(1, False), (2, True)}
