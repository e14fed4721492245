"""Co-training learns from every unlabelled document, not from a pool of bounded size."""

import numpy as np
from pyspark.sql import functions as F

from logtide.llm import cotraining


def test_pool_is_the_whole_table(spark):
    ids = [r.id for r in spark.range(1000, 5700).orderBy(F.xxhash64("id"), "id").collect()]
    late = set(ids[-300:])  # after the 4,000 of smallest hash
    good, bad = "a calm and clear sentence about the sea " * 4, "$$ WIN ### CASH !!! %% " * 8
    text = lambda i: (good if i % 2 else bad) + f" {i % 7}"
    rows = [(i, text(i), "en", "books" if i % 2 else "spam") for i in range(600)]
    rows += [(i, good + f" {i % 7}", "en", "late") if i in late else (i, text(i), "en", "books" if i % 2 else "spam") for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, quality int")
    model = cotraining.fit(docs, labels)
    slot = cotraining.meta_slots("en", "late", None)[1]
    assert model.meta[slot] > 0.01  # no labelled document has this source


def test_parts_of_the_pool_sum_up():
    r = np.random.default_rng(1)
    views = (r.normal(size=(50, 3)).astype(np.float32), r.normal(size=(50, 2)).astype(np.float32))
    students = [r.normal(size=4), r.normal(size=3)]
    teachers = [(w * 3, (1.0, 0.1)) for w in students]
    whole = cotraining.pool_sums(views, teachers, students, 0.9)
    parts = [cotraining.pool_sums(tuple(v[i : i + 20] for v in views), teachers, students, 0.9) for i in (0, 20, 40)]
    assert np.allclose(cotraining.merged(parts), whole) and whole[0] > 0
