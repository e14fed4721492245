"""Quality rules against plain counting, the classifier by held-out accuracy, and the pipeline's contract."""

import re
from collections import Counter

import numpy as np

import pytest

import corpus_pipeline
from logtide.llm import cotraining, rules
from test_near_dup import likeness, shingle_set
from test_text_dedup import WHITE, covered, low


def brute_surface(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    gone = [False] * len(words)
    for i in range(len(words) - 4):
        if at[tuple(words[i : i + 5])] > 1:
            gone[i : i + 5] = [True] * 5
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(gone)


def test_surface(rows):
    for _, t in rows:
        for text in (t or "", (t or "") + "\n" + (t or "")):
            assert rules.surface(text.encode()) == brute_surface(text)


def test_judge(spark, docs, none, rows):
    labels = spark.createDataFrame([(d, 1, 0) for d, t in rows[:30] if d is not None] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    got = rules.judge(docs, labels).collect()
    assert len(got) == len(rows)
    weight = rules.weights(rules.gram_counts(docs.selectExpr("doc_id", "cast(coalesce(text, '') as binary) data"), {d for d, _ in rows[:30] if d is not None}, 1 << 16), 1 << 16)
    text = {}
    for d, t in rows:
        text.setdefault(d, []).append(t or "")
    for r in got:
        surfaces = [brute_surface(t) for t in text[r.doc_id]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in surfaces
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        if len(surfaces) == 1:
            g = rules.grams(text[r.doc_id][0].encode(), 1 << 16)
            assert abs(r.llr - (weight[g].mean() if len(g) else 0)) < 1e-4
        assert not (r.base_failed and r.kept)
    assert rules.judge(none, labels).count() == 0
    assert all(r.llr == 0 and r.kept != r.base_failed for r in rules.judge(docs, labels.limit(0)).collect())


def test_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fit_on = labels.where("doc_id % 3 <> 0")
    model = cotraining.fit(docs, fit_on)
    held = labels.where("doc_id % 3 = 0").join(cotraining.score(docs, model), "doc_id").collect()
    right = np.mean([(r.quality == 1) == r.kept for r in held])
    assert len(held) > 80 and right > 0.95
    kept = cotraining.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == cotraining.score(docs, model).where("kept").count()


def test_classifier_without_labels(docs, none, rows):
    labels = docs.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")
    assert cotraining.fit(docs, labels) is None
    assert cotraining.score(docs, None).where("kept").count() == len(rows)
    assert cotraining.keep_good(docs, None).count() == len(rows)
    assert cotraining.score(none, None).count() == 0


def test_views_exchange_labels():
    r = np.random.default_rng(4)
    y = r.integers(0, 2, 400)
    text = np.column_stack([y * 2 - 1 + r.normal(0, 0.3, 400), r.normal(size=400)]).astype(np.float32)
    meta = np.column_stack([y, 1 - y]).astype(np.float32)
    label = np.where(np.arange(400) < 80, y, -1)
    model = cotraining.co_train(text, meta, label)
    z = [model.log_odds(text[i], [0 if y[i] else 1])[2] for i in range(80, 400)]
    assert np.mean((np.array(z) > 0) == (y[80:] == 1)) > 0.98


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    """Each stage over all that its predecessor kept, on whole tables at the smallest scale."""
    sf = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "simhash_near_dedup", "substring_dedup", "packing"]
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    docs, outs = documents, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        outs.append(docs)
    texts = [{r.doc_id: r.text for r in d.collect()} for d in outs[:4]]
    assert all(d.columns == documents.columns and d.where("n_chars <> char_length(text)").isEmpty() for d in outs[:4])

    model = cotraining.fit(documents, spark.read.parquet(f"{sf}/labels.parquet"))
    whole = {r.doc_id: r.text for r in documents.collect()}
    kept = {r.doc_id for r in cotraining.score(documents, model).where("kept").collect()}
    assert texts[0] == {d: whole[d] for d in kept} and 0 < len(kept) < len(whole)

    held = {}
    for d, t in texts[0].items():
        for line in t.split("\n"):
            k = low(line.strip(WHITE))
            held[k] = min(d, held.get(k, d))
    lines = {d: "\n".join(x for x in t.split("\n") if len(k := low(x.strip(WHITE))) < 10 or held[k] == d) for d, t in texts[0].items()}
    assert texts[1] == lines

    sets = {d: shingle_set(t) for d, t in lines.items()}
    assert texts[2] == {d: lines[d] for d in texts[2]}
    gone = set(lines) - set(texts[2])
    assert all(any(e < d and likeness(sets[e], sets[d]) >= 0.8 for e in texts[2]) for d in gone) and gone
    close = sum(likeness(sets[e], sets[d]) >= 0.8 for e in texts[2] for d in texts[2] if e < d)
    near = sum(likeness(sets[e], sets[d]) >= 0.8 for e in sets for d in sets if e < d)
    assert close <= 0.1 * near

    first, words = {}, {d: t.split() for d, t in texts[2].items()}
    for d, w in words.items():
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(d, first.get(k, d))
    for d, w in words.items():
        gone = covered(len(w), [i for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d], 50)
        assert texts[3][d] == (" ".join(x for x, g in zip(w, gone, strict=True) if not g) if gone.any() else texts[2][d])

    packed = outs[4].collect()
    assert {r.doc_id for r in packed} == set(texts[3])
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)
    assert corpus_pipeline.run(spark, sf).count() == len(packed)


def plain_counts(texts, buckets):
    out = np.zeros(buckets, np.int64)
    for t in texts:
        b = t.encode()
        for i in range(len(b) - 2):
            code = b[i] << 16 | b[i + 1] << 8 | b[i + 2]
            out[((code * 2654435761) % (1 << 32) >> 12) % buckets] += 1
    return out


def test_verdicts_equal_plain_counting(spark, rows):
    buckets = 1 << 10
    table = {d: t for d, t in rows[:36]}
    docs = spark.createDataFrame(list(table.items()), "doc_id long, text string")
    trusted = sorted(table)[::2]
    labels = spark.createDataFrame([(d, 1, 0) for d in trusted] + [(sorted(table)[1], 1, 1)], "doc_id long, quality int, toxic int")
    raw, target = plain_counts(table.values(), buckets) + 1.0, plain_counts([table[d] for d in trusted], buckets) + 1.0
    weight = np.log(target / target.sum()) - np.log(raw / raw.sum())

    def score(t):
        counts = plain_counts([t], buckets)
        return float((counts * weight).sum() / counts.sum()) if counts.sum() else 0.0

    threshold = min(0.0, sorted(score(table[d]) for d in trusted)[int(0.1 * len(trusted))])
    for r in rules.judge(docs, labels, keep_trusted=0.9, buckets=buckets).collect():
        want = score(table[r.doc_id])
        assert abs(r.llr - want) < 1e-5
        if abs(want - threshold) > 1e-5:
            assert r.kept == (not r.base_failed and want >= threshold)


def test_rounds_equal_a_plain_loop():
    """Co-training row by row in plain Python against the sums of ``exchange``."""
    r = np.random.default_rng(8)
    y = r.integers(0, 2, 90)
    views = [np.column_stack([y * 2 - 1 + r.normal(0, 0.8, 90), r.normal(size=90)]), np.column_stack([y + r.normal(0, 0.4, 90), r.normal(size=90), r.normal(size=90)])]
    views = [v.astype(np.float32) for v in views]
    known = 50
    model = cotraining.exchange(views[0][:known], views[1][:known], y[:known], lambda *a: cotraining.pool_sums(tuple(v[known:] for v in views), *a), rounds=2, sure=0.8, steps=3)
    held, train = list(range(0, known, 4)), [i for i in range(known) if i % 4]
    weight = [cotraining.fit_logistic(v[train], y[train]).astype(float) for v in views]
    dot = lambda me, i, w: float(sum(a * b for a, b in zip(views[me][i], w)) + w[-1])
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for _ in range(2):
        slopes = [cotraining.platt(np.array([dot(me, i, weight[me]) for i in held]), y[held]) for me in (0, 1)]
        said = []  # what each view says of the unlabelled: 1, 0 or nothing
        for me in (0, 1):
            p = [sigmoid(slopes[me][0] * dot(me, i, weight[me]) + slopes[me][1]) for i in range(known, 90)]
            said.append([1 if x >= 0.8 else 0 if x <= 0.2 else None for x in p])
        now, ahead = [w.copy() for w in weight], [w.copy() for w in weight]
        for t in range(3):
            for me in (0, 1):
                step = 1e-4 * ahead[me]
                for c in (0, 1):
                    own = [i for i in train if y[i] == c]
                    pseudo = [i for i in range(known, 90) if said[1 - me][i - known] == c]
                    grad = lambda rows: sum((sigmoid(dot(me, i, ahead[me])) - c) * np.append(views[me][i], 1.0) for i in rows) / len(rows)  # noqa: B023, E731
                    step = step + 0.5 * ((grad(own) + grad(pseudo)) / 2 if pseudo else grad(own))
                norm = max((views[me][train] ** 2).sum(axis=1).max(), (views[me][known:] ** 2).sum(axis=1).max()) + 1
                new = ahead[me] - 4.0 / (norm + 1e-4) * step
                ahead[me], now[me] = new + t / (t + 3) * (new - now[me]), new
        weight = now
    assert np.allclose(model.text, weight[0], atol=1e-3) and np.allclose(model.meta, weight[1], atol=1e-3)


@pytest.fixture(scope="module")
def odd_tables(clashing, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    names = [c for c in clashing.columns if c != "a.b"]
    clashing.select(*names).write.parquet(f"{at}/documents.parquet")
    labels = [(d, i % 2, 0) for i, (d, t) in enumerate(rows[:36])] + [(None, 1, 0), (2, None, None)]
    clashing.sparkSession.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_pipeline_on_odd_tables(spark, odd_tables, tmp_path):
    """Nulls, blanks, repeated rows and clashing columns go through every stage; so does an empty table."""
    docs = spark.read.parquet(f"{odd_tables}/documents.parquet")
    columns, none = docs.columns, docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, odd_tables)
        assert stage(spark, none, odd_tables).count() == 0
        if name == "packing":
            assert {r.doc_id for r in done.collect()} == {r.doc_id for r in docs.collect()}
            break
        assert done.columns == columns
        assert all(r[c] == f"{c}={r.doc_id}" for r in done.collect() for c in columns[5:])
        done.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert docs.count() > 5  # the labels are arbitrary, so the classifier rejects many


def test_metadata_by_name_in_any_case(spark):
    good, bad = "a calm and clear sentence about the sea " * 4, "$$ WIN ### CASH !!! %% " * 8
    rows = [(i, (good if i % 2 else bad) + f" {i % 7}", "en", "books" if i % 2 else "spam", 100 + i) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    lower = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    other = lower.toDF("Doc_Id", "TEXT", "LANG", "Source", "N_chars")
    models = [cotraining.fit(d, labels) for d in (lower, other)]
    assert np.allclose(models[0].meta, models[1].meta, atol=1e-6) and np.abs(models[0].meta).max() > 0.1
    kept = [sorted(r[0] for r in cotraining.keep_good(d, models[0]).collect()) for d in (lower, other)]
    assert kept[0] == kept[1] and cotraining.score(other, models[0]).count() == 400


def shuffled_mb(spark):
    """MB that this session has written to shuffles so far."""
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite() / 1e6


def test_only_trusted_texts_are_shuffled(spark, tmp_path):
    """What judging writes follows the trusted texts: texts of other rows are not shuffled, and a list of any length joins alike."""
    r = np.random.default_rng(2)
    spark.createDataFrame([(i, r.bytes(6000).hex()) for i in range(800)], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    labels = spark.createDataFrame([(i, int(i % 10 == 0), 0) for i in range(800)], "doc_id long, quality int, toxic int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_mb(spark)
        got = rules.judge(docs, labels).collect()
        wrote = shuffled_mb(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 800
    assert wrote < 3.5  # MB of some 9.6; of the trusted texts 1
    rows = docs.selectExpr("doc_id", "cast(text as binary) as data")
    for bits in (64, 1 << 12, 1 << 25):  # few bits let more rows pass; the join after them stays exact
        found = rules.trusted_rows(rows, labels.where("quality = 1").select("doc_id"), bits)
        assert sorted(x.doc_id for x in found.collect()) == list(range(0, 800, 10))
