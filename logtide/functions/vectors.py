"""Words, hashed embeddings and vector arithmetic, as column expressions and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A placeholder, a run of letters and digits, or any other single visible character.
WORD = r"<[a-z]+>|[a-z0-9]+|[^\sa-z0-9]"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("(?U)" + WORD), F.lit(0))


def token_hash(token: Column) -> Column:
    """The first eight bytes of MD5 as an unsigned number."""
    return F.conv(F.substring(F.md5(token), 1, 16), 16, 10).cast("decimal(20,0)")


def token_slot(token: Column, dim: int = 64) -> Column:
    return F.pmod(token_hash(token), F.lit(dim)).cast("int")


def token_sign(token: Column) -> Column:
    """1 if bit 61 of the hash is set, else -1."""
    nibble = F.conv(F.substring(F.md5(token), 1, 1), 16, 10).cast("int")
    return F.when(nibble.bitwiseAND(2) != 0, 1.0).otherwise(-1.0)


def dot(a: Column, b: Column) -> Column:
    """Cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalise(a: Column) -> Column:
    """The unit vector; a zero vector stays."""
    n = l2_norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def slot_weights(texts: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """``key, slot, value``: signed, log-damped token counts summed by hash slot (not normalised)."""
    tokens = texts.select(key, F.explode(words(F.col(text))).alias("token")).groupBy(key, "token").count()
    value = token_sign(F.col("token")) * (1 + F.ln("count"))
    return tokens.groupBy(key, token_slot(F.col("token"), dim).alias("slot")).agg(F.sum(value).alias("value"))


def hash_embed(texts: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """``key, embedding``: a unit vector of ``dim`` doubles a row; texts without words get zeros."""
    sparse = slot_weights(texts, key, text, dim).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("slots"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at(F.coalesce("slots", F.create_map().cast("map<int,double>")), i), F.lit(0.0)))
    return texts.select(key).distinct().join(sparse, key, "left").select(key, l2_normalise(dense).alias("embedding"))


def centroids(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """``group, centroid``: mean of each component, then normalised; summed map-side."""
    parts = vectors.select(group, F.posexplode(vector).alias("at", "x")).groupBy(group, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = parts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("xs"))
    return whole.select(group, l2_normalise(F.col("xs.x")).alias("centroid"))


def nearest(vectors: DataFrame, vector: str, targets: DataFrame, target: str, centre: str, block: int = 4096) -> DataFrame:
    """Each row of ``vectors`` with its nearest of ``targets`` and the cosine; ties go to the smallest target.

    Targets are dealt into blocks of about ``block``; each block is one broadcast row, so what is broadcast
    at once is bounded, and a row carries its best so far from block to block.
    """
    blocks = max(1, -(-targets.count() // block))
    kind = targets.schema[target].dataType
    start = F.struct(F.lit(None).cast(kind).alias("t"), F.lit(-2.0).alias("sim"))
    out = vectors.withColumn("_best", start)
    for i in range(blocks):
        mine = targets if blocks == 1 else targets.where(F.pmod(F.xxhash64(target), F.lit(blocks)) == i)
        table = mine.agg(F.sort_array(F.collect_list(F.struct(F.col(target).alias("t"), F.col(centre).alias("c")))).alias("_targets"))
        sim = lambda x: dot(F.col(vector), x["c"])
        better = lambda a, x: (sim(x) > a["sim"]) | ((sim(x) == a["sim"]) & (x["t"] < a["t"]))
        best = F.aggregate("_targets", F.col("_best"), lambda a, x: F.when(better(a, x), F.struct(x["t"].alias("t"), sim(x).alias("sim"))).otherwise(a))  # noqa: B023
        out = out.join(F.broadcast(table)).withColumn("_best", best).drop("_targets")
    return out.select(*vectors.columns, F.col("_best.t").alias("nearest"), F.col("_best.sim").alias("similarity"))
