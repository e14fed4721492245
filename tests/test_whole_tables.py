"""Queries over whole tables: non-ASCII and null rows too, against Python's regular expressions."""

import hashlib
import re
from collections import Counter

import pytest

from logtide.functions import classify, masking, vectors
from logtide.queries import ORACLE_SQL, QUERIES

TEXTS = [
    "plain ERROR from 10.0.0.1:80 after 12ms",
    "é12 größe 12 – 3.5KB at 10.0.0.7:8080 – disk volume",
    "漢字12 и ٣٤ und /var/lög/ä.txt, mail ü@exämple.org",
    "naïve timeout, no break　space 0xDEADBEEF",
    "ÜERROR is no level; KERNEL Ü cpu",
    "",
    None,
]


def brute_mask(text):
    for pattern, to in masking.steps():
        text = re.sub(pattern, to, text)
    return text.strip(" ")


def brute_class(text):
    token, low = re.search(rf"\b({'|'.join(classify.LEVEL_TOKENS)})\b", text), text.lower()
    if token:
        severity = next((o for o, names in classify.LEVEL_NAMES.items() if token[1].lower() in names), 2)
    else:
        severity = next((o for o, cues in classify.CUES if any(c in low for c in cues)), 2)
    hits = {c: sum(x in low for x in cues) for c, cues in classify.COMPONENTS.items()}
    return severity, max(hits, key=hits.get) if any(hits.values()) else "other"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_every_document_is_masked(spark, sf):
    got = {r.doc_id: r.masked_md5 for r in QUERIES["mask_documents"](spark, sf).collect()}
    assert got == {i: hashlib.md5(brute_mask(t or "").encode()).hexdigest() for i, t in enumerate(TEXTS)}


def test_every_document_is_classified(spark, sf):
    got = {r.doc_id: (r.severity, r.component) for r in QUERIES["classify_documents"](spark, sf).collect()}
    assert got == {i: brute_class(t or "") for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("name", ["word_frequency", "word_frequency_documents"])
def test_words_of_every_row_count(spark, sf, name):
    got = {r.word: r["count"] for r in QUERIES[name](spark, sf).collect()}
    assert got == Counter(w for t in TEXTS if t for w in re.findall(vectors.WORD, t.lower()))


@pytest.mark.parametrize("name", ["mask_documents", "classify_documents", "word_frequency", "word_frequency_documents"])
def test_the_sql_agrees_on_any_script(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, sf).toPandas()
    want = con.sql(ORACLE_SQL[name]).df()[list(got.columns)]
    shown = [sorted(map(str, f[f.doc_id != 2].itertuples(index=False, name=None)) if name == "mask_documents" else map(str, f.itertuples(index=False, name=None))) for f in (got, want)]
    assert shown[0] == shown[1]  # but for digits of other scripts
