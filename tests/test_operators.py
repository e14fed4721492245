"""Mining, rates, cooldown, clustering and the vocabulary: known cases and invariants."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from logtide.functions import vectors
from logtide.operators import alerts, clustering, features, templates, tokenizer
from logtide.plans import pipeline, readmodels
from logtide.settings import Settings
from logtide.sources import logs


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def lines_of(spark, masked):
    return spark.createDataFrame([(str(i).zfill(4), at(i), m) for i, m in enumerate(masked)], "id string, ts timestamp, masked string")


def test_merging_and_new_groups(spark):
    found = {r.masked: r.template for r in templates.mine(lines_of(spark, ["connection to <IP> failed after <NUM> retries"] * 2)).collect()}
    assert list(found.values()) == ["connection to <IP> failed after <NUM> retries"]
    two = templates.mine(lines_of(spark, ["user login succeeded for account <NUM>", "kernel panic unable to handle <HEX>", ""]))
    assert {r.template for r in two.collect()} == {"user login succeeded for account <NUM>", "kernel panic unable to handle <HEX>", "<empty>"}
    merged = templates.mine(lines_of(spark, ["a b c d user_1", "a b c d user_2", "a b c d user_1"])).collect()
    assert {r.template for r in merged} == {"a b c d <*>"} and {r.seed for r in merged} == {"a b c d user_1"}


def test_fold_ties_and_threshold():
    assigned, groups = templates.fold([["a", "b", "c"], ["a", "d", "c"], ["x", "y", "z"]], 0.4)
    assert assigned == [0, 0, 1] and groups == [["a", "<*>", "c"], ["x", "y", "z"]]
    assert templates.fold([["a", "b", "c"], ["a", "y", "z"]], 0.4)[0] == [0, 1]


def test_fan_out_cap(spark):
    strings = templates.distinct_masked(lines_of(spark, [f"{chr(97 + i)} same" for i in range(6)] + ["b same"]))
    got = templates.capped_buckets(strings, Settings(max_children=3))
    assert {r.masked[0]: r.prefix[0] for r in got.collect()} == {"a": "a", "b": "b", "c": "c", "d": "<*>", "e": "<*>", "f": "<*>"}


def test_generated_templates_and_incident(spark):
    raw = logs.generate(spark, 3000)
    assert raw.count() == 3000 and raw.collect() == logs.generate(spark, 3000).repartition(5).orderBy(F.col("id").cast("int")).collect()
    result = pipeline.run(raw)
    lines = result.lines
    assert lines.select("template_id").distinct().count() == 19
    bad = lines.where(templates.similarity(templates.tokens(F.col("template")), templates.tokens(F.col("masked"))) < 1.0)
    assert bad.count() == 0 and lines.count() == 3000
    total = readmodels.totals(lines).first()
    assert total.anomalies > 0 and 0 < total.error_rate < 1
    promoted = result.clusters.where("promoted").collect()
    assert any("settlement" in r.sample_template for r in promoted)
    gated = lines.where(clustering.gate(F.col("severity"), F.col("is_new"), F.col("reasons")))
    assert sum(r.members for r in result.clusters.collect()) == gated.count()
    sent = result.alerts.collect()
    assert any("pagerduty" in r.channels for r in sent)
    for t in {r.template_id for r in sent}:
        times = sorted(r.ts for r in sent if r.template_id == t)
        assert all((b - a).total_seconds() >= 300 for a, b in zip(times, times[1:], strict=False))


def test_rate_z(spark):
    rows = [(i, at(1 + 10 * w), "t") for w in range(5) for i in (2 * w, 2 * w + 1)] + [(10 + i, at(100 + i / 10), "t") for i in range(20)]
    got = features.rate_z(spark.createDataFrame(rows, "id int, ts timestamp, k string"), "k", Settings(window_seconds=10)).orderBy("id").collect()
    assert [r.rate_z for r in got[:4]] == [0.0, 0.0, 0.0, (1 - 2) / 1.0]
    assert abs(got[-1].rate_z - (19 - 2) / 0.49) < 1e-9  # seen before the last line is recorded
    state = None
    for _ in range(5):
        state = features.ewma_step(state, 2, 0.3)
    assert abs(state[1] - 0.2401) < 1e-12 and abs((20 - state[0]) / state[1] ** 0.5 - 18 / 0.49) < 1e-9


def test_rate_z_equals_a_sequential_run(spark):
    r = np.random.default_rng(1)
    ts = np.sort(r.integers(0, 900, 400))
    rows = [(i, at(int(t)), "ab"[int(k)]) for i, (t, k) in enumerate(zip(ts, r.integers(0, 2, 400), strict=True))]
    got = {x.id: x.rate_z for x in features.rate_z(spark.createDataFrame(rows, "id int, ts timestamp, k string"), "k", Settings(window_seconds=60)).collect()}
    for key in "ab":
        window, count, mean, var, rolled = None, 0, 0.0, 1.0, False
        for i, t, k in rows:
            if k != key:
                continue
            assert abs(got[i] - ((count - mean) / max(var, 1e-9) ** 0.5 if rolled else 0.0)) < 1e-9
            w = int((t - dt.datetime(1970, 1, 1)).total_seconds() // 60)
            if window is not None and w != window:
                d = count - mean
                mean, var = ((0.7 * mean + 0.3 * count, 0.7 * (var + 0.3 * d * d)) if rolled else (float(count), 1.0))
                rolled, count = True, 0
            window, count = w, count + 1


def test_cooldown(spark):
    rows = [(i, at(t), "a") for i, t in enumerate((0, 299, 300, 301, 599, 600, 1000))] + [(9, at(5), "b")]
    got = alerts.cooled(spark.createDataFrame(rows, "id int, ts timestamp, template_id string"))
    assert sorted(r.id for r in got.collect()) == [0, 2, 5, 6, 9]


def test_cooldown_and_rates_carry_over_batches(spark):
    r = np.random.default_rng(6)
    rows = sorted((int(r.integers(0, 40_000)), f"k{int(r.integers(0, 9))}", i) for i in range(3000))
    lines = spark.createDataFrame([(i, at(t), k) for t, k, i in rows], "id int, ts timestamp, template_id string")
    last, want = {}, set()
    for t, k, i in rows:
        if k not in last or t - last[k] >= 300:
            last[k] = t
            want.add(i)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    z = [sorted(map(str, features.rate_z(lines, "template_id").select("id", "rate_z").collect()))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert {x.id for x in alerts.cooled(lines).collect()} == want
        z.append(sorted(map(str, features.rate_z(lines, "template_id").select("id", "rate_z").collect())))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert z[0] == z[1]


def test_dispatch(spark):
    pager, chat = alerts.Recorder("pd"), alerts.Recorder("slack")
    rows = spark.createDataFrame([("1", ["pagerduty", "slack"], at(0)), ("2", ["slack"], at(1))], "id string, channels array<string>, ts timestamp")
    assert alerts.dispatch(rows, pager, chat) == 2 and len(pager.sent) == 1 and len(chat.sent) == 2


def plain_leaders(rows, similarity):
    """Leader of each (template_id, at, id, vector), one after another."""
    led, found = {}, []
    for name, _, _, v in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        cosines = [float(np.dot(v, c)) for _, c in found]
        best = int(np.argmax(cosines)) if cosines else -1
        if best < 0 or cosines[best] < similarity:
            found.append((name, v))
            best = len(found) - 1
        led[name] = found[best][0]
    return led


def embedded_points(kind, n):
    r = np.random.default_rng(5)
    v = {"spread": r.normal(size=(n, 3)), "tight": r.normal(size=(n, 3)) * 0.2 + r.choice([-1, 1], (n, 1)), "chain": np.array([[np.cos(i / 3), np.sin(i / 3), 0] for i in range(n)])}[kind]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[n // 2] = 0  # a text without words
    return [(f"t{i}", int(r.integers(0, n // 2)), int(r.integers(0, 5)), v[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("kind", ["spread", "tight", "chain"])
@pytest.mark.parametrize("block", [1, 7, 500])
def test_leaders_in_rounds_equal_one_by_one(spark, kind, block):
    from logtide.scratch import materialise

    rows = embedded_points(kind, 40 if block == 1 else 200)
    table = materialise(spark.createDataFrame(rows, "template_id string, at long, id int, embedding array<double>").repartition(3), "points")
    got = clustering.nearest_leader(table, clustering.leaders(table, 0.9, block)).collect()
    assert {r.template_id: r.leader for r in got} == plain_leaders(rows, 0.9)
    empty = table.limit(0)
    assert clustering.grouped(empty, 0.9, block).count() == 0


def test_promotion(spark):
    rows = [(str(i), at(i), "tpl_a", "same words here", 4, "api") for i in range(3)]
    gated = spark.createDataFrame(rows, "id string, ts timestamp, template_id string, template string, severity int, component string")
    assigned = clustering.assign(gated)
    (c,) = clustering.clusters(gated, assigned).collect()
    assert c.members == 3 and c.promoted and c.new_incident and c.label == "Api incident"
    by_template = assigned.join(clustering.promotions(gated, assigned), "cluster_id")
    lines = gated.union(gated.limit(1).withColumn("severity", F.lit(1)).withColumn("id", F.lit("9"))).join(by_template, "template_id")
    flagged = clustering.flagged(lines, F.col("severity") >= 4).orderBy("id").collect()
    assert [r.new_incident for r in flagged] == [False, False, True, False] and flagged[3].cluster_id is None


def test_nearest_is_the_same_in_blocks(spark):
    r = np.random.default_rng(2)
    points = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(40)], "i int, v array<double>")
    targets = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(25)] + [(30, [0.0] * 4), (31, [0.0] * 4)], "t int, c array<double>")
    found = [{r.i: (r.nearest, r.similarity) for r in vectors.nearest(points, "v", targets, "t", "c", block).collect()} for block in (4096, 5, 1)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 40


def test_merges_take_the_most_frequent_pair(spark):
    """The heap against a scan of all pairs at each merge."""
    r = np.random.default_rng(3)
    counts = {"".join(r.choice(list("abcd"), r.integers(1, 9))): int(r.integers(1, 30)) for _ in range(80)} | {"<ip>": 5}
    ids, words = {"[PAD]": 0, "[UNK]": 1}, []
    for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        if w.startswith("<"):
            ids.setdefault(w, len(ids))
        elif n >= 2:
            words.append((list(w), n))
            for c in w:
                ids.setdefault(c, len(ids)), ids.setdefault("##" + c, len(ids))
    for _ in range(60):
        pairs = {}
        for p, n in words:
            for x in zip(p, p[1:], strict=False):
                pairs[x] = pairs.get(x, 0) + n
        if not pairs or max(pairs.values()) < 2 or len(ids) >= 90:
            break
        a, b = min(x for x, n in pairs.items() if n == max(pairs.values()))
        ids.setdefault(a + b, len(ids)), ids.setdefault("##" + a + b, len(ids))
        for k, (p, n) in enumerate(words):
            out = []
            for t in p:
                if out and out[-1] == a and t == b:
                    out[-1] = a + b
                else:
                    out.append(t)
            words[k] = (out, n)
    assert tokenizer.merge_loop(counts, 90, 2, 60) == ids


@pytest.mark.parametrize("alphabet, listed", [("ab", 64), ("abcdefgh", 3), ("abcdefgh", 64)])
def test_merge_rounds_equal_one_merge_after_another(spark, alphabet, listed):
    r = np.random.default_rng(len(alphabet))
    counts = {"".join(r.choice(list(alphabet), r.integers(1, 8))): int(r.integers(1, 30)) for _ in range(60)} | {"<ip>": 1, "<": 4, "é": 9, "aaaaaaa": 25}
    table = spark.createDataFrame(list(counts.items()), "word string, count long").repartition(3)
    for size, least, most in ((400, 2, 25), (40, 1, 99)):
        assert tokenizer.merge_rounds(table, size, least, most, listed) == tokenizer.merge_loop(counts, size, least, most)
    assert tokenizer.merge_rounds(table.limit(0), 10, 1, 5) == {"[PAD]": 0, "[UNK]": 1}


def test_independent_merges():
    assert tokenizer.independent([("a", "b", 9), ("c", "d", 7), ("e", "f", 5), ("b", "c", 5), ("g", "h", 4)], True) == [("a", "b", 9), ("c", "d", 7)]
    assert tokenizer.independent([("a", "a", 9), ("c", "d", 7)], True) == [("a", "a", 9)]
    assert tokenizer.independent([("a", "b", 9), ("c", "d", 7), ("e", "f", 7)], False) == [("a", "b", 9)]
    assert tokenizer.independent([("a", "b", 9), ("ab", "d", 7)], True) == [("a", "b", 9)] and tokenizer.independent([], True) == []


def test_bootstrap_and_retrain(spark):
    first = tokenizer.bootstrap(spark, 60, 400)
    assert {"<ip>", "<num>"} <= set(first.ids)
    again = tokenizer.retrain(spark.createDataFrame([("payment 12 failed",)] * 3, "line string"))
    assert "payment" in again.ids and "<num>" in again.ids and "kernel" not in again.ids


def test_cooldown_over_many_slots(spark):
    r = np.random.default_rng(5)
    times = sorted({int(t) for t in np.cumsum(r.choice([1, 20, 299, 300, 700], 200))})
    rows = spark.createDataFrame([(f"{i:03}", at(t), "k" if i % 3 else "j") for i, t in enumerate(times)], "id string, ts timestamp, template_id string")
    want, last = [], {}
    for i, t in enumerate(times):
        key = "k" if i % 3 else "j"
        if key not in last or t - last[key] >= 300:
            want.append(f"{i:03}")
            last[key] = t
    assert sorted(r.id for r in alerts.cooled(rows).collect()) == want


def test_vocabulary(spark):
    lines = logs.sample_corpus(spark, 120).select("line")
    book = tokenizer.train(lines, "line", 800, max_merges=30)
    assert 50 < book.size <= 801 and book.ids["[PAD]"] == 0 and book.ids["[UNK]"] == 1
    assert tokenizer.train(lines.repartition(5), "line", 800, max_merges=30).ids == book.ids
    got = book.encode(spark.createDataFrame([(1, "ERROR connection"), (2, "")], "k int, line string"), "k", "line").orderBy("k").collect()
    assert "".join(t.removeprefix("##") for t in got[0].tokens) == "errorconnection" and got[1].tokens == []
    assert tokenizer.Vocabulary({"[UNK]": 1, "a": 2, "##b": 3}).encode_word("abz") == ["a", "##b", "[UNK]"]
