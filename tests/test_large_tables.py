"""What was bounded, sampled or compared in pairs before: the whole job by ways that grow with the input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logtide.functions import masking
from logtide.llm import rules, simhash
from logtide.operators import clustering, templates
from logtide.sources import logs


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [1, 1000])
def test_most_similar_equals_all_pairs(spark, tmp_path, few):
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(12)]
    texts = {" ".join(["a b c d", *r.choice(words, n)]) for n in (1, 3, 4) for _ in range(60)} | {"", "<empty>", "a b c d <*>", "a b c d <*> w1 w2", "lone"}
    rows = [(t, t.split(" ") if t else ["<empty>"]) for t in sorted(texts)]
    table = spark.createDataFrame([(m, t, len(t), " ".join(t[:4])) for m, t in rows], "masked string, toks array<string>, n_tokens int, prefix string")
    table.write.parquet(f"{tmp_path}/b")
    like = lambda s, t: round(sum(x == y or "<*>" in (x, y) for x, y in zip(s, t, strict=True)) / len(s), 6)
    want = {}
    for m, s in rows:
        near = [(-like(s, t), o) for o, t in rows if o != m and len(s) == len(t) and s[:4] == t[:4]]
        if near:
            want[m] = (min(near)[1], -min(near)[0])
    got = templates.most_similar(spark.read.parquet(f"{tmp_path}/b"), few=few, share=7).collect()
    assert {x.masked: (x.other, x.similarity) for x in got} == want and len(got) == len(want)


def test_a_large_bucket_is_not_compared_in_pairs(spark, tmp_path):
    rows = spark.range(40_000).select(F.concat(F.lit("a b c user_"), "id").alias("masked"))
    rows = rows.withColumn("toks", F.split("masked", " ")).select("*", F.lit(4).alias("n_tokens"), F.lit("a b c <*>").alias("prefix"))
    rows.write.parquet(f"{tmp_path}/b")
    got = templates.most_similar(spark.read.parquet(f"{tmp_path}/b")).groupBy("other", "similarity").count().collect()  # 1.6e9 pairs before
    assert {(x.other, x.similarity, x["count"]) for x in got} == {("a b c user_0", 0.75, 39_999), ("a b c user_1", 0.75, 1)}


def test_every_trusted_row_counts(spark):
    n = 24_000  # over the 20,000 rows that once were taken
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    # raw and target are the same texts, so every weight and every score is 0
    assert rules.judge(docs, labels).agg(F.max(F.abs("llr"))).first()[0] < 1e-9


def test_nth_smallest(spark, tmp_path):
    x = np.concatenate([np.random.default_rng(1).normal(size=3000), np.zeros(500), [1e9, -1e9]])
    spark.createDataFrame([(float(v),) for v in x], "v double").write.parquet(f"{tmp_path}/v")
    table, order = spark.read.parquet(f"{tmp_path}/v"), np.sort(x)
    for at in (0, 17, 1500, 1700, 3501):
        assert rules.nth_smallest(table, "v", at, few=50, bins=16) == order[at]


def test_wide_links_join_nothing_where_no_bucket_is_heavy(spark, tmp_path):
    spark.range(500).select(F.xxhash64("id").alias("fp")).write.parquet(f"{tmp_path}/fp")
    fps = spark.read.parquet(f"{tmp_path}/fp")
    assert "Join" not in plan(simhash.wide_links(fps))
    assert "Join" in plan(simhash.wide_links(fps, 1))


def test_leaders_of_many_tables_meet_rows_in_one_pass(spark, tmp_path):
    r = np.random.default_rng(2)
    v = r.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    schema = "template_id string, at long, id long, embedding array<double>"
    spark.createDataFrame([(f"t{i}", i, i, x.tolist()) for i, x in enumerate(v)], schema).write.parquet(f"{tmp_path}/e")
    table = spark.read.parquet(f"{tmp_path}/e")
    found = clustering.leaders(table, 0.95, 10)
    assert len(found) > 4
    assert plan(clustering.nearest_leader(table, found[:4])).count("MapInArrow") == 1


def test_many_lines_are_many_tasks(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    assert logs.dealt(table, 100).rdd.getNumPartitions() == 10
    assert logs.dealt(table).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_extraction_names_no_text_twice(spark):
    """The text left by each rule was written out anew in every later rule's column."""
    one = spark.createDataFrame([("2024-01-01T00:00:00 a@b.cd 10.0.0.1:80 took 5ms in /a/b/c 0x1F 7 at 00:00:01",)], "line string")
    frame = one.select(masking.extract_variables(F.col("line")).alias("v"))
    assert frame.first().v == {"TIMESTAMP": ["2024-01-01T00:00:00", "00:00:01"], "EMAIL": ["a@b.cd"], "IP": ["10.0.0.1"], "DURATION": ["5ms"], "PATH": ["/a/b/c"], "HEX": ["0x1F"], "NUM": ["80", "7"]}
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= len(masking.RULES)
