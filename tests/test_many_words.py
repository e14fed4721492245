"""The vocabulary is fitted on every word, however many there are."""

from pyspark.sql import functions as F

from logtide.operators import tokenizer


def test_rare_words_and_placeholders_count(spark):
    many = spark.range(50_100).select(F.concat(F.lit("w"), "id", F.lit(" w"), "id").alias("line"))
    texts = many.union(spark.createDataFrame([("漢 <rare>",)], "line string"))
    book = tokenizer.train(texts, "line", 60, min_freq=1, max_merges=3)
    assert {"漢", "##漢", "<rare>"} <= set(book.ids)
    assert book.encode_word("漢") == ["漢"]
    assert "<rare>" in tokenizer.train(texts, "line", 60, max_merges=3).ids
