"""License automata against regular expressions, phrases against plain search."""

import random
import re

import pytest

from logtide.llm import licenses


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(text, templates, phrases):
    w = plain_words(text)
    flat = " " + "".join(f"{x} " for x in w)
    at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    parsed = [(label, licenses.parse(m)) for label, m in templates]
    own = {label for label, nodes in parsed if re.search(" " + licenses.to_regex(nodes), flat)}
    score = max((q / 4 for q in (1, 2, 3, 4) for _, nodes in parsed if re.search(" " + licenses.to_regex(nodes, q), flat)), default=0.0)
    base = {label for _, label in at}
    first, last = (min(at)[0], max(at)[0]) if at else (None, None)
    return len(w), len(at), first, last, ",".join(sorted(base)), ",".join(sorted(base | own)), score


def rendered(nodes, r, fault=False):
    out = []
    for n in nodes:
        if n[0] == "word":
            out.append(n[1])
        elif n[0] == "var":
            out += [r.choice(["any", "license", "the", "été"]) for _ in range(r.randint(n[1], n[2]))]
        elif n[0] == "optional":
            out += rendered(n[1], r) if r.random() < 0.5 else []
        else:
            out += rendered(r.choice(n[1]), r)
    if fault and out:
        i = r.randrange(len(out))
        out[i : i + 1] = r.choice([[], ["other"], [out[i], "more"]])
    return out


SMALL = [
    ("loops", "a b <<optional>>a b <<optional>>c<<end>> a<<end>> <<var 0-3>> <<one of>>a|a b|c c<<end>> b a"),
    ("plain", "b a b a c"),
    ("wide", "<<optional>>x<<end>> a <<var 2-4>> <<one of>><<var 1-2>> c|b<<end>> a b c"),
]


def texts():
    r = random.Random(8)
    say = lambda n: [r.choice(["the", "license", "mit", "general", "public", "apache", "this", "permission", "is", "licensed", "under", "x1"]) for _ in range(n)]
    out = [None, "", " .,; ", "MIT LICENSE", "mit-license, Mit\nlicense MITlicense", "Apache License general public license", "Émit license", "mit\xa0license"]
    for label, markup in licenses.TEMPLATES * 4:
        for fault in (False, True):
            core = rendered(licenses.parse(markup), r, fault)
            cut = core[: r.randint(1, len(core))] if r.random() < 0.3 else core
            sep = r.choice([" ", "\n", ", ", ' "'])
            out.append(sep.join([*say(r.randint(0, 9)), *(x.upper() if r.random() < 0.2 else x for x in cut), *say(r.randint(0, 9))]))
    out.append(" ".join(say(30_000)) + " Released under the MIT License")
    return [*out, out[10], out[10]]


def test_scan(spark):
    rows = [(i if i % 9 else None, t, "k", 3) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string, N_WORDS int").repartition(3)
    got = licenses.scan(docs).drop("matches").collect()
    want = [(i, *brute(t, licenses.TEMPLATES, licenses.PHRASES)) for i, t, *_ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {x[0] for x in licenses.TEMPLATES} <= {y for x in want for y in x[6].split(",")}
    assert licenses.scan(docs.limit(0)).count() == 0


def test_matches_say_where(spark):
    docs = spark.createDataFrame([(1, "So: licensed under the Apache License, Version 2.0! Released under the terms of the MIT license. mit license")], "doc_id long, text string")
    row = licenses.scan(docs).first()
    assert [tuple(m) for m in row.matches] == [("apache-2.0", 1, 9), ("mit-notice", 9, 17)]
    assert (row.labels, row.n_base, row.first_word, row.last_word) == ("apache,apache-2.0,mit,mit-notice", 3, 4, 17)


def test_automata_on_small_alphabets():
    r = random.Random(1)
    scanner = licenses.compiled(SMALL, {"a b": "x"})
    number = {w: i for i, w in enumerate(["?", "a", "b", "c", "x"])}
    for _ in range(4000):
        w = [r.choice("abcx?") if r.random() < 0.9 else "a" for _ in range(r.randint(0, 25))]
        if r.random() < 0.5:
            w += rendered(licenses.parse(r.choice(SMALL)[1]), r)
        found, matches, score = scanner.scan([number.get(x, 0) for x in w])
        want = brute(" ".join("q" if x == "?" else x for x in w), SMALL, {"a b": "x"})
        assert len(found) == want[1] and score == want[6]
        assert ",".join(sorted({m[0] for m in matches} | {x for _, x in found})) == want[5]


@pytest.mark.parametrize("bad", ["a b c <<optional>>d e", "a b<<end>> c d e f", "a b c d <<var 3-2>> e", "a b c d", "a b c d e <<var 1-2>>", "a b | c d e", "a <<optional>><<end>> b c d e"])
def test_faulty_markup(bad):
    with pytest.raises(ValueError):
        licenses.compiled([("bad", bad)])
