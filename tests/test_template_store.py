"""Templates mined batch by batch equal those of one run; unchanged buckets are not read."""

import datetime as dt

import numpy as np

from logtide.operators import templates
from logtide.operators.template_store import TemplateStore
from logtide.settings import Settings


def masked_lines(n=300):
    r = np.random.default_rng(11)
    heads = ["alpha", "beta", "gamma", "delta", "eps1", "zeta"]
    tails = ["disk", "full", "<NUM>", "node", "peer", "x9", "down", "up"]
    start = dt.datetime(2024, 1, 1)
    text = lambda: " ".join([str(r.choice(heads)), *map(str, r.choice(tails, r.integers(0, 6)))])
    return [(text() if i % 50 else "", start + dt.timedelta(seconds=i), f"{i:05d}") for i in range(n)]


def test_batches_equal_one_run(spark, tmp_path):
    rows, schema = masked_lines(), "masked string, ts timestamp, id string"
    for children in (100, 3):
        settings = Settings(max_children=children)
        want = {tuple(r) for r in templates.mine(spark.createDataFrame(rows, schema), settings).select("masked", "template", "seed", "template_id").collect()}
        store = TemplateStore(spark, str(tmp_path / f"s{children}"), settings, buckets=8)
        for i, (a, b) in enumerate(((0, 40), (40, 41), (41, 300))):
            store.add(spark.createDataFrame(rows[a:b], schema), i)
        assert {tuple(r) for r in store.templates().collect()} == want
        store.add(spark.createDataFrame(rows[41:], schema), 2)  # a batch that runs again
        store.add(spark.createDataFrame(rows, schema), 3)  # nothing new
        again = TemplateStore(spark, store.path, settings, buckets=8)
        assert {tuple(r) for r in again.templates().collect()} == want
        assert again._read("strings", "masked string", 9).where("batch = 3").count() == 0


def test_only_touched_buckets_are_read(spark, tmp_path):
    rows, schema = masked_lines(), "masked string, ts timestamp, id string"
    store = TemplateStore(spark, str(tmp_path / "s"), buckets=8)
    store.add(spark.createDataFrame(rows, schema), 0)
    plan = store._newest(1, [2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
