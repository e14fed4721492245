"""SimHash groups and Order MinHash against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from logtide.llm import omh, simhash
from logtide.llm.common import materialise


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, prints):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, prints[i], least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_groups(docs, none, rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.groups(docs).collect()), key=str)
    assert got == brute_groups(rows, prints)
    assert simhash.groups(none).count() == 0


def shingle_set(text, words=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def near_copies():
    """Texts of 120 words with one to ten words changed, in groups, among others of the same words."""
    r = random.Random(9)
    words = ["w%d" % i for i in range(400)]
    out = []
    for _ in range(12):
        base = [r.choice(words) for _ in range(120)]
        out.append(" ".join(base))
        for n in (1, 2, 3, 8):
            copy = list(base)
            for at in r.sample(range(120), n):
                copy[at] = r.choice(words)
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("whole", [256, 2])
def test_kept_documents_are_not_alike_and_removed_ones_are(spark, docs, none, rows, monkeypatch, whole):
    original = simhash._removed
    monkeypatch.setattr(simhash, "_removed", lambda *a: original(*a, whole=whole))
    extra = [(1000 + i, t) for i, t in enumerate(near_copies())]
    everything = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    kept = simhash.keep_first(everything)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    named = [x for x in got if x[0] is not None]
    assert len(named) == len(set(named)) and sum(d is None for d, _ in got) == sum(d is None for d, _ in rows)
    sets = {x: shingle_set(x[1]) for x in {*rows, *extra} if x[0] is not None}
    stay = {x: sets[x] for x in named}
    gone = [x for x in sets if x not in stay]
    assert all(any(likeness(sets[x], s) >= 0.8 for s in stay.values()) for x in gone)  # clean documents stay
    close = [(a, b) for a in stay for b in stay if a < b and likeness(stay[a], stay[b]) >= 0.8]
    near = [(a, b) for a in sets for b in sets if a[0] < b[0] and likeness(sets[a], sets[b]) >= 0.8]
    assert len(close) <= 0.1 * len(near) and len(gone) > 20
    assert simhash.keep_first(none).count() == 0


@pytest.mark.parametrize("dense", [1024, 3])
def test_links_in_dense_and_sparse_buckets(spark, dense):
    r = random.Random(3)
    prints = {r.getrandbits(64) for _ in range(200)}
    for _ in range(5):
        base = r.getrandbits(64)
        for _ in range(60):
            p = base
            for _ in range(r.randint(0, 5)):
                p ^= 1 << r.randrange(64)
            prints.add(p)
    prints = sorted(prints)
    rows = list(enumerate(prints))
    fps = materialise(spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long"), "test")
    found = [(r.u & (1 << 64) - 1, r.v & (1 << 64) - 1) for r in simhash.links(fps, dense).collect()]
    place = {p: i for i, p in rows}
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for u, v in found:
        parent[find(place[u])] = find(place[v])
    want = brute_groups(rows, prints)
    least = {}
    for i, _ in rows:
        least[find(i)] = min(least.get(find(i), i), i)
    assert sorted(((i, p, least[find(i)]) for i, p in rows), key=str) == want


def test_wide_links_do_not_depend_on_parts(spark):
    """All pairs within 8 bits are joined; a bucket dealt into parts gives the components of one compared whole."""
    r = random.Random(11)
    base = [r.getrandbits(64) for _ in range(12)]
    prints = {b ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 8))) for b in base for _ in range(9)}
    prints |= {base[0] ^ i for i in range(64)}  # one hot bucket
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    fps = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = []
    for dense in (8192, 5):
        links = {(x.u & (1 << 64) - 1, x.v & (1 << 64) - 1) for x in simhash.wide_links(fps, dense).collect()}
        parent = {p: p for p in prints}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for u, v in links:
            parent[find(u)] = find(v)
        got.append({frozenset(q for q in prints if find(q) == root) for root in {find(p) for p in prints}})
        assert all(find(u) == find(v) for u in prints for v in prints if (u ^ v).bit_count() <= 8)
    assert got[0] == got[1]


def test_large_components_are_judged_in_order(spark, monkeypatch):
    """One component of chains, dealt into shares: the same documents stay as when one task judges it in order."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    text, texts = [word() for _ in range(100)], []
    for i in range(45):
        text = list(text)
        text[(7 * i) % 100] = word()
        texts.append(" ".join(text))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    original, got = simhash._removed, []
    for whole, share in ((256, 4096), (9, 10)):
        monkeypatch.setattr(simhash, "_removed", lambda *a, w=whole, s=share: original(*a, whole=w, share=s))
        got.append(sorted(x.doc_id for x in simhash.keep_first(docs).collect()))
    assert got[0] == got[1] and 1 < len(got[0]) < 25


def test_order_minhash_rows(docs, none, rows):
    order = sorted(rows, key=lambda x: ((-1 if x[0] is None else x[0]), x[1] or ""))
    sketch = omh.OrderMinHash()
    want = []
    for i, (d, t) in enumerate(order):
        t, before = t or "", order[i - 1][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + before[:cut]
        own, other, nxt = sketch.signature(t), sketch.signature(edited), sketch.signature(before)
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), own.astype(">u2").tobytes().hex(), omh.likeness(own, other), omh.likeness(own, nxt)))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) for r in omh.with_next(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert omh.with_next(none).count() == 0


def test_order_minhash_is_sensitive_to_order_and_edits():
    sketch = omh.OrderMinHash()
    r = random.Random(2)
    text = "".join(r.choice("abcdefghij ") for _ in range(9000))
    near = text[:8000] + "".join(r.choice("abcdefghij ") for _ in range(1000))
    swapped = text[4500:] + text[:4500]
    a = sketch.signature(text)
    assert omh.likeness(a, sketch.signature(text)) == 1.0
    assert omh.likeness(a, sketch.signature(near)) > 0.5 > 0.1 > omh.likeness(a, sketch.signature(near[::-1]))
    assert omh.likeness(a, sketch.signature(swapped)) < 0.8
    assert sketch.signature("").tolist() == [0] * 64 and sketch.signature("a").all()


def test_occurrence_numbers():
    k = np.array([5, 7, 5, 5, 7], np.uint64) << np.uint64(40)
    assert omh._occurrence_numbers(k).tolist() == [0, 0, 1, 2, 1]


def test_signature_equals_a_plain_order_minhash():
    """Each component hashes, in text order, the k-mers of smallest numbered hash: counted with dictionaries."""
    sketch = omh.OrderMinHash(k=4, picks=3, sketches=8)
    m64 = (1 << 64) - 1
    mixed = lambda x: int(omh.mix(np.array([x & m64], np.uint64))[0])
    for text in ("abcabcabcabd", "the cat sat on the mat, the cat sat", "aaaaaaaaaaaa", "xyz", "é漢😀ab" * 3):
        k = min(4, len(text))
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        hashes = omh.mix(omh.windows_hash(omh.prefix_hash(omh.mix(points.astype(np.uint64) + np.uint64(1))), k)).tolist()
        seen, numbered = {}, []
        for i in range(len(text) - k + 1):
            kmer = text[i : i + k]
            numbered.append(mixed(hashes[i] + seen.get(kmer, 0)) >> 32)
            seen[kmer] = seen.get(kmer, 0) + 1
        want = []
        for flip, times in zip(sketch.flip.tolist(), sketch.times.tolist(), strict=True):
            order = sorted(range(len(numbered)), key=lambda i: ((((numbered[i] ^ flip) * times) & 0xFFFFFFFF), i))[:3]
            out = 4
            for i in sorted(order):
                out = mixed(out * 31 + hashes[i])
            want.append((out >> 48) | 1)
        assert sketch.signature(text).tolist() == want, text


def test_recall_of_near_copies_on_a_whole_table(spark):
    """Of all pairs of different texts at a likeness of 0.8 or more, at most a twentieth stays together."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sets, held = {}, {}
    for r in rows:
        sets[r.doc_id] = shingle_set(r.text or "", 5)
        for s in sets[r.doc_id]:
            held.setdefault(s, []).append(r.doc_id)
    shared = {}
    for ids in held.values():
        for i, a in enumerate(sorted(set(ids))):
            for b in sorted(set(ids))[i + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    text = {r.doc_id: r.text for r in rows}
    alike = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) and text[a] != text[b]]
    kept = {r.doc_id for r in simhash.keep_first(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("doc_id").collect()}
    together = sum(a in kept and b in kept for a, b in alike)
    assert len(alike) > 10 and together <= 0.05 * len(alike)
    for r in rows:  # whoever goes has someone alike of smaller id
        if r.doc_id not in kept:
            assert any((a, b) in shared and shared[a, b] >= 0.8 * (len(sets[a]) + len(sets[b]) - shared[a, b]) for a in sets if a < r.doc_id for b in [r.doc_id])
