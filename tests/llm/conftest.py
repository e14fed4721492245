import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, data int, n_words int, spans string, _extra string"


def _texts():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(150)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared = [say(70), say(60)]
    lines = ["  A Common line of text ", "another line, shared", "short"]
    out = []
    for i in range(36):
        parts = [say(r.randint(1, 60))]
        if i % 3 == 0:
            parts.insert(r.randint(0, 1), shared[i % 2])
        if i % 4 == 0:
            parts.append(r.choice(lines))
        if i % 5 == 0:
            parts.append("é ü 漢字 😀 " + say(5))
        out.append(r.choice([" ", "\n", " \n"]).join(parts))
    base = say(300).split()
    for _ in range(6):  # near copies
        copy = list(base)
        copy[r.randrange(300)] = "changed"
        out.append(" ".join(copy))
    out += [out[3], out[3], "x" * 5000, say(4000), "", " \t\n", "\n\n", None, shared[0] + "\n" + shared[0], "a", "### $$$ %%% " * 40]
    return out


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): shared passages, near and exact copies, nulls, blanks, long texts, repeated rows."""
    out = [(3 * i + 1, t) for i, t in enumerate(_texts())]
    return [*out, out[0], out[3], (out[5][0], "other text under a used id " * 9), (None, out[6][1]), (None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with extra columns whose names clash with the operators' own."""
    full = [(i, t, "en", "s", len(t or ""), "d", 7, 1, "x", "e") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


#: Names that operators use inside, or return, in other cases too.
CLASHES = ["_doc", "_row", "_lines", "_gone", "_spans", "_first", "_place", "_new", "_th", "_data", "_hot", "_light", "N_LINES", "n_Dropped", "N_words", "n_removed", "fp", "root", "places", "a.b"]


@pytest.fixture(scope="session")
def clashing(spark, rows):
    """The rows with a column for each of ``CLASHES``."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(i, t, None, "s", None, *(f"{c}={i}" for c in CLASHES)) for i, t in rows], schema).repartition(3)



@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
