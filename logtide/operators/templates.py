"""Template mining after Drain: group masked lines by shape, then merge similar ones.

Only distinct masked strings are mined, in order of first appearance: folding a string that was
folded before changes no template, so the result equals that of folding every line.  The parse
tree is a grouping key (token count and capped leading tokens), which makes the folds independent.
"""

from __future__ import annotations

from functools import reduce
from hashlib import md5
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise
from ..settings import Settings
from .features import window_index

WILD = "<*>"
EMPTY = "<empty>"


def tokens(masked: Column) -> Column:
    return F.when(masked == "", F.array(F.lit(EMPTY))).otherwise(F.split(masked, " "))


def bucket_prefix(toks: Column, depth: int = 4) -> Column:
    """The first ``depth`` tokens, any with a digit as a wildcard."""
    return F.transform(F.slice(toks, 1, depth), lambda t: F.when(t.rlike("[0-9]"), WILD).otherwise(t))


def similarity(a: Column, b: Column) -> Column:
    """Share of places that are equal or wild on either side; 1 for no tokens."""
    same = F.zip_with(a, b, lambda x, y: F.when((x == y) | (x == WILD) | (y == WILD), 1.0).otherwise(0.0))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.aggregate(same, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def template_id(template: Column) -> Column:
    return F.concat(F.lit("tpl_"), F.substring(F.md5(template), 1, 12))


def distinct_masked(lines: DataFrame) -> DataFrame:
    """``masked, n_lines, first`` (a struct of ts and id) of lines with ``masked, ts, id``."""
    return lines.groupBy("masked").agg(F.count("*").alias("n_lines"), F.min(F.struct("ts", "id")).alias("first"))


CHILDREN = "level int, n_tokens int, prefix array<string>, child string"


def capped_buckets(strings: DataFrame, settings: Settings = Settings(), known: DataFrame | None = None) -> DataFrame:
    """Adds ``toks, n_tokens, prefix``: each tree level admits ``max_children`` tokens under a parent.

    Tokens that first appear after a parent is full fall to the wildcard; known ones still match.
    ``known`` (``CHILDREN``) are children that earlier strings gave.
    """
    return _descended(strings, settings, known)[0]


def _descended(strings: DataFrame, settings: Settings, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``capped_buckets`` and the children that the strings add.

    A level ranks one row a (parent, child), of which Spark keeps ``max_children`` a parent in each task before
    it shuffles, and joins the admitted ones to the strings.
    """
    out = strings.withColumn("toks", tokens(F.col("masked"))).withColumn("n_tokens", F.size("toks"))
    out = out.withColumn("_raw", bucket_prefix(F.col("toks"), settings.prefix_depth)).withColumn("prefix", F.array().cast("array<string>"))
    added = []
    for level in range(settings.prefix_depth):
        key = ["n_tokens", "prefix", "child"]
        here = out.withColumn("child", F.get("_raw", F.lit(level)))
        came = here.where("child is not null").groupBy(*key).agg(F.min("first").alias("came"))
        order = Window.partitionBy("n_tokens", "prefix").orderBy("came", "child")
        if known is None:
            fresh = came.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= settings.max_children).select(*key)
            admitted = fresh
        else:
            had = known.where(F.col("level") == level).select(*key)
            full = had.groupBy("n_tokens", "prefix").agg(F.count("*").alias("had"))
            fresh = came.join(had, key, "left_anti").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= settings.max_children)
            fresh = fresh.join(full, ["n_tokens", "prefix"], "left").where(F.col("nth") + F.coalesce("had", F.lit(0)) <= settings.max_children).select(*key)
            admitted = had.union(fresh)
        added.append(fresh.select(F.lit(level).alias("level"), *key))
        into = F.when(F.col("_ok").isNull(), WILD).otherwise(F.col("child"))
        out = here.join(admitted.withColumn("_ok", F.lit(True)), key, "left")
        out = out.withColumn("prefix", F.when(F.col("child").isNull(), F.col("prefix")).otherwise(F.concat("prefix", F.array(into)))).drop("child", "_ok")
    return out.drop("_raw"), reduce(DataFrame.unionAll, added)


def fold(strings: list[list[str]], threshold: float, groups: list[list[str]] | None = None) -> tuple[list[int], list[list[str]]]:
    """Fold token lists of one length, in order, into groups: the most similar (first of equals) at or over
    the threshold takes a string and turns its differing places wild; else the string opens a group.

    Words are numbered, so a string meets all groups in one comparison of arrays.
    """
    groups = [] if groups is None else groups
    if not strings:
        return [], groups
    numbers: dict[str, int] = {WILD: 0}
    number = lambda toks: [numbers.setdefault(t, len(numbers)) for t in toks]
    table = np.zeros((max(16, 2 * len(groups)), len(strings[0])), np.int64)
    for g, have in enumerate(groups):
        table[g] = number(have)
    n, assigned = len(groups), []
    for toks in strings:
        row = np.array(number(toks), np.int64)
        have = table[:n]
        same = (have == row) | (have == 0) | (row == 0)
        scores = same.mean(axis=1) if len(row) else np.ones(n)
        best = int(scores.argmax()) if n else -1
        if best >= 0 and scores[best] >= threshold:
            table[best] = np.where(have[best] == row, row, 0)
        else:
            if n == len(table):
                table = np.concatenate([table, np.zeros_like(table)])
            best, n = n, n + 1
            table[best] = row
        assigned.append(best)
    words = list(numbers)
    return assigned, [[words[i] for i in r] for r in table[:n].tolist()]


def mine(lines: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``masked, template, template_id, seed`` for every distinct masked string of ``lines``.

    Final templates: one id for all lines of a group, whatever the group looked like at the time.
    ``seed`` is the group's first string, the stable key that streams use.  Distinct strings are written once,
    as each level of the parse tree reads them.
    """
    return mine_strings(materialise(distinct_masked(lines), "strings"), settings)


def mine_strings(strings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``mine`` over the distinct strings of ``distinct_masked``."""
    threshold = settings.template_similarity

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "id"])
        assigned, groups = fold([list(t) for t in pdf["toks"]], threshold)
        texts = [" ".join(g) for g in groups]
        seeds: dict[int, str] = {}
        for a, m in zip(assigned, pdf["masked"], strict=True):
            seeds.setdefault(a, m)
        return pd.DataFrame({"masked": pdf["masked"], "template": [texts[a] for a in assigned], "seed": [seeds[a] for a in assigned]})

    keyed = capped_buckets(strings, settings).select("masked", "toks", "n_tokens", F.array_join("prefix", " ").alias("prefix"), "first.ts", "first.id")
    found = keyed.groupBy("n_tokens", "prefix").applyInPandas(run, "masked string, template string, seed string")
    return found.withColumn("template_id", template_id(F.col("template")))


def with_templates(lines: DataFrame, mined: DataFrame) -> DataFrame:
    """Lines joined to their templates; the mined side is small and Spark decides how to join."""
    return lines.join(mined.select("masked", "template", "template_id"), "masked")


def first_rows(lines: DataFrame, keep: int) -> DataFrame:
    """``template_id, first, upto``: a template's first (ts, id) and its ``keep``-th (or last).

    Spark keeps ``keep`` rows a template before it shuffles.
    """
    w = Window.partitionBy("template_id").orderBy("ts", "id")
    early = lines.select("template_id", "ts", "id").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep)
    return early.groupBy("template_id").agg(F.min(F.struct("ts", "id")).alias("first"), F.max(F.struct("ts", "id")).alias("upto"))


def matched_counts(lines: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """Adds ``matched_count``, the line's running number in its template, and ``is_new``.

    Lines are numbered within slices of time, and the lines of earlier slices come from a running sum
    over each template's slices, so a hot template is dealt over its slices.
    """
    sliced = lines.withColumn("_slice", window_index(F.col("ts"), slice_seconds))
    counts = sliced.groupBy("template_id", "_slice").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("template_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("template_id", "_slice").orderBy("ts", "id"))
    out = sliced.withColumn("_place", place).join(counts, ["template_id", "_slice"]).withColumn("matched_count", (F.col("_before") + F.col("_place")).cast("long"))
    return out.withColumn("is_new", F.col("matched_count") == 1).drop("_slice", "_place", "_before")


def template_count(lines: DataFrame, wanted: str, weight: str | None = None) -> DataFrame:
    """One row: how many lines have the template id (0 if unknown); ``weight`` names a column that says for how many lines a row stands."""
    n = F.count("*") if weight is None else F.coalesce(F.sum(weight), F.lit(0))
    return lines.where(F.col("template_id") == wanted).agg(n.alias("count"))


def _blanked(drops: tuple[int, ...]):
    """Rows ``masked, d, key``: a hash (128 bits) of a string's bucket and tokens for each choice of ``d`` places left out."""

    def run(batches):
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                out = []
                for masked, toks, prefix in zip(*(part.column(c).to_pylist() for c in ("masked", "toks", "prefix")), strict=True):
                    for d in drops:
                        for at in combinations(range(len(toks)), d):
                            rest = " ".join(t for i, t in enumerate(toks) if i not in at)
                            out.append((masked, d, md5(f"{len(toks)}\n{prefix}\n{at}\n{rest}".encode()).digest()))
                cols = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.binary()), strict=True)], ["masked", "d", "key"])

    return run


def _differing(strings: DataFrame, drops: tuple[int, ...]) -> DataFrame:
    """``masked, d, other``: of other strings that differ in the fewest places, ``drops`` at most, the least one."""
    keyed = materialise(strings.select("masked", "toks", "prefix").mapInArrow(_blanked(drops), "masked string, d int, key binary"), "blanked")
    # a key's two least strings, of which Spark keeps two a task before it shuffles, serve all that share it
    two = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("masked"))).where(F.col("nth") <= 2)
    two = two.groupBy("key").agg(F.min("masked").alias("lo"), F.max("masked").alias("hi")).where("lo <> hi")
    met = keyed.join(two, "key").select("masked", "d", F.when(F.col("masked") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("other"))
    return met.groupBy("masked").agg(F.min(F.struct("d", "other")).alias("b")).select("masked", "b.d", "b.other")


def most_similar(buckets: DataFrame, few: int = 1024, choices: int = 256, share: int = 256) -> DataFrame:
    """``masked, other, similarity``: each string with the most similar other one of its bucket (of equals the least).

    ``buckets`` is a written table ``masked, toks, n_tokens, prefix`` (text) of distinct strings.  Strings that differ in few
    places share a key once these places are left out, so they are found without comparing pairs: in up to one place first,
    then, for strings of large buckets without such a neighbour, in two and in three, where there are at most ``choices``
    of places.  What is left (strings of at most ``few``, or unlike all others) is compared with its bucket, dealt in shares
    of ``share`` strings.  Strings that hold a wildcard match in more ways and are compared with their bucket.
    """
    bucket, wild = ["n_tokens", "prefix"], F.array_contains("toks", WILD)
    plain = buckets.where(~wild)
    known = materialise(_differing(plain, (0, 1)), "neighbours")
    for d in (2, 3):
        left = plain.join(known.select("masked"), "masked", "left_anti")
        places = reduce(lambda x, i: x * (F.col("n_tokens") - i), range(d), F.lit(1))
        large = left.select(*bucket).distinct().join(plain, bucket).groupBy(*bucket).agg(F.count("*").alias("n"))
        large = materialise(large.where((F.col("n") > few) & (places <= choices * (2 if d == 2 else 6))).select(*bucket), "large-buckets")
        if large.isEmpty():
            continue
        more = _differing(plain.join(large, bucket, "left_semi"), (d,)).join(known.select("masked"), "masked", "left_anti")
        known = materialise(known.union(more), "neighbours")
    left = materialise(buckets.where(~wild).join(known.select("masked"), "masked", "left_anti").union(buckets.where(wild)).select(*buckets.columns), "unlike")
    parts = left.groupBy(*bucket).agg(F.ceil(F.count("*") / share).cast("int").alias("parts"))
    mine = left.join(parts, bucket).withColumn("salt", F.pmod(F.xxhash64("masked"), F.col("parts")).cast("int")).drop("parts")
    all_ = buckets.join(parts, bucket).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*bucket, "salt", F.col("masked").alias("other"), F.col("toks").alias("t"))
    pairs = mine.join(all_, [*bucket, "salt"]).where(F.col("masked") != F.col("other"))
    scored = pairs.select("masked", "other", F.array_contains("toks", WILD).alias("wild"), F.round(similarity(F.col("toks"), F.col("t")), 6).alias("similarity"))
    back = scored.where("wild").select(F.col("other").alias("masked"), F.col("masked").alias("other"), "similarity")  # likeness goes both ways
    near = known.join(buckets.select("masked", "n_tokens"), "masked").select("masked", "other", F.round((F.col("n_tokens") - F.col("d")) / F.col("n_tokens"), 6).alias("similarity"))
    found = scored.select("masked", "other", "similarity").union(back).union(near)
    best = found.groupBy("masked").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "other")).alias("b"))
    return best.select("masked", "b.other", (-F.col("b.s")).alias("similarity"))
