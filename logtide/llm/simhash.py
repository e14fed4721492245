"""SimHash fingerprints, near-duplicate groups and their removal by multi-index hashing.

64-bit fingerprints are cut into two 32-bit segments.  Two fingerprints within 3 bits differ by
at most one bit in one of them, so each fingerprint is stored in two exact segment tables and
probes them with the Hamming ball of radius 1 around each segment (of a pair, the side with the
set bit probes).  Every meeting is verified on the complete distance.

Copies collapse to one row a fingerprint first.  A bucket of at most ``dense`` fingerprints is
verified in one small matrix and only a spanning forest of its links goes on.  A larger bucket
is not compared pair by pair: its members meet at explicit ball variants of the other segment
(radius 1 and 2), whose groups the ball's size bounds.  Both ways are exact.

``keep_first`` works on five-word shingles and a similarity of 0.8, which is wider than 3 bits: after a
pass at 3 bits has removed what large groups of copies hold, a second one covers 8 bits (and most of 9
and 10) by three segments and balls of radius 2: both sides come to the variants one bit away.  Links only say which
texts to compare; a document goes if its shingles are similar to those of one that stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, free_names, lookup_weighted, materialise, mix, prefix_hash, quoted, windows_hash, word_hashes
from .graph import connected_components

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)
#: Linked: at most so many differing bits, which two segments with balls of radius 1 cover.
BITS = 3
#: A wider link: three segments (first bit, bits) with balls of radius 2.  They meet all pairs within 8
#: bits and most of those with 9 or 10, which are taken too, as their texts are compared in any case.
WIDE_BITS, WIDE = 10, ((0, 21), (21, 21), (42, 22))


def fingerprint(data: bytes, words: int = 3) -> int:
    """SimHash of a UTF-8 text over its word shingles, each with its repeats."""
    parts = data.translate(_LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    spans = zip(starts[:n].tolist(), ends[len(parts) - n :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in spans], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = h[i : i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_POWERS[2 * counts > n].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) for every row; null or blank text gives 0."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([b.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])
        pa.default_memory_pool().release_unused()

    return documents(docs).withColumn("text", F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def _probes(batches):
    """Bucket rows ``key, fp, stored``: the segment tables and the probes into them."""
    one, low = np.uint64(1), np.uint64(0xFFFFFFFF)
    for b in batches:
        fp = b.column("fp").to_numpy().view(np.uint64)
        keys, who, stored = [], [], []
        for side in (np.uint64(0), np.uint64(1)):
            seg = (fp >> (side << np.uint64(5))) & low
            tag = side << np.uint64(32)
            keys.append(seg | tag), who.append(fp), stored.append(np.ones(len(fp), bool))
            for i in range(32):
                bit = one << np.uint64(i)
                has = (seg & bit) != 0
                keys.append((seg[has] ^ bit) | tag), who.append(fp[has]), stored.append(np.zeros(int(has.sum()), bool))
        if len(fp):
            yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(who).view(np.int64)), pa.array(np.concatenate(stored))], ["key", "fp", "stored"])


def _wide_probes(batches):
    """Bucket rows ``key, fp`` of the wide link: every segment with its variants one bit away."""
    one = np.uint64(1)
    for b in batches:
        fp = b.column("fp").to_numpy().view(np.uint64)
        keys = []
        for number, (first, bits) in enumerate(WIDE):
            seg = ((fp >> np.uint64(first)) & np.uint64((1 << bits) - 1)) | np.uint64(number << 32)
            keys += [seg, *(seg ^ (one << np.uint64(i)) for i in range(bits))]
        if len(fp):
            yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(fp, len(keys)).view(np.int64))], ["key", "fp"])


def _forest(a: np.ndarray, t: int, bits: int) -> np.ndarray:
    """Smallest label over links within ``bits`` between the first ``t`` fingerprints and all; a stretch of rows at a time."""
    label = np.arange(len(a))
    step = max(1, (1 << 20) // len(a))
    while True:
        new = label.copy()
        for i in range(0, t, step):
            near = np.bitwise_count(a[i : min(t, i + step), None] ^ a[None, :]) <= bits
            rows = np.minimum(new[i : i + len(near)], np.where(near, new[None, :], len(a)).min(axis=1))
            new[i : i + len(near)] = rows
            new = np.minimum(new, np.where(near, rows[:, None], len(a)).min(axis=0))
        if (new == label).all():
            return label
        label = new


def _verify(bits: int):
    """Per bucket, verified links as a forest ``u, v``; arrays of stored and probing fingerprints in."""

    def run(batches):
        for b in batches:
            us, vs = [], []
            for table, probes in zip(b.column("table").to_pylist(), b.column("probes").to_pylist(), strict=True):
                if len(table) + len(probes) == 2:
                    u, v = (x & (1 << 64) - 1 for x in [*table, *probes])
                    if (u ^ v).bit_count() <= bits:
                        us.append(u), vs.append(v)
                    continue
                a = np.array(table + probes, np.int64).view(np.uint64)
                label = _forest(a, len(table), bits)
                away = np.flatnonzero(label != np.arange(len(a)))
                us += a[label[away]].tolist()
                vs += a[away].tolist()
            yield pa.record_batch([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (us, vs)], ["u", "v"])

    return run


def _variants(batches):
    """For buckets too large to compare: rows ``key, variant, fp, centre``.

    Stored fingerprints are centres of their radius-1 variants and come to those of radius 2;
    probes (one bit away in this segment) come to those of radius 1.
    """
    one = np.uint64(1)
    flips = [np.uint64(0)] + [one << np.uint64(i) for i in range(32)]
    twice = [flips[i + 1] | flips[j + 1] for i in range(32) for j in range(i)]
    for b in batches:
        key, fp, stored = b.column("key").to_numpy(), b.column("fp").to_numpy().view(np.uint64), b.column("stored").to_numpy(zero_copy_only=False)
        other = np.where(key >> 32 == 0, np.uint64(32), np.uint64(0))
        for rows, masks, centre in ((stored, flips, True), (stored, twice, False), (~stored, flips, False)):
            k, f, o = key[rows], fp[rows], other[rows]
            for i in range(0, len(masks), 64):
                m = np.array(masks[i : i + 64], np.uint64)
                v = ((f >> o) & np.uint64(0xFFFFFFFF))[:, None] ^ m[None, :]
                n = len(m)
                yield pa.record_batch([pa.array(np.repeat(k, n)), pa.array(v.ravel().view(np.int64)), pa.array(np.repeat(f, n).view(np.int64)), pa.array(np.full(len(k) * n, centre))], ["key", "variant", "fp", "centre"])


def links(fps: DataFrame, dense: int = 1024) -> DataFrame:
    """Links ``u, v`` whose components are those of "at most 3 differing bits".

    ``fps`` holds distinct fingerprints in a durable table (it is read twice).
    """
    probes = fps.select("fp").mapInArrow(_probes, "key long, fp long, stored boolean")
    met = probes.groupBy("key").agg(F.count("*").alias("weight"), F.max("stored").alias("any")).where("weight > 1 and any").select("key", "weight")
    rows = materialise(lookup_weighted(probes, materialise(met, "bucket-sizes"), ["key"]), "buckets")
    small = (
        rows.where(F.col("weight") <= dense)
        .groupBy("key")
        .agg(
            F.collect_list(F.when(F.col("stored"), F.col("fp"))).alias("table"),
            F.collect_list(F.when(~F.col("stored"), F.col("fp"))).alias("probes"),
        )
        .mapInArrow(_verify(BITS), "u long, v long")
    )
    large = (
        rows.where(F.col("weight") > dense)
        .select("key", "fp", "stored")
        .mapInArrow(_variants, "key long, variant long, fp long, centre boolean")
        .groupBy("key", "variant")
        .agg(F.min(F.when(F.col("centre"), F.col("fp"))).alias("u"), F.collect_set("fp").alias("near"))
        .where("u is not null and size(near) > 1")
        .select("u", F.explode("near").alias("v"))
    )
    return small.union(large).where("u <> v").distinct()


def wide_links(fps: DataFrame, dense: int = 8192) -> DataFrame:
    """Links ``u, v`` that join fingerprints within 8 bits, and most within ``WIDE_BITS``.

    ``fps`` holds distinct fingerprints in a durable table (it is read twice).  Tables hold 21 bits, so
    buckets grow with the corpus: one of over ``dense`` fingerprints is dealt into parts, and each pair of
    parts is compared by a task of its own, so no task holds more than two parts whatever the skew.
    """
    rows = fps.select("fp").mapInArrow(_wide_probes, "key long, fp long")
    heavy = materialise(rows.groupBy("key").agg(F.count("*").alias("weight")).where(F.col("weight") > dense), "wide-heavy")
    whole = F.collect_list("fp")
    if heavy.isEmpty():
        buckets = rows.groupBy("key").agg(whole.alias("table")).where(F.size("table") > 1).withColumn("probes", F.array().cast("array<bigint>"))
    else:  # of a heavy key's rows each meets every part; others are one part, whose bucket is compared as it is
        parts = F.coalesce(F.ceil(F.col("weight") / dense).cast("int"), F.lit(1))
        met = rows.join(heavy, "key", "left")
        dealt = met.select("key", "fp", F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
        buckets = dealt.groupBy("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).agg(
            F.collect_list(F.when(F.col("part") <= F.col("other"), F.col("fp"))).alias("table"),
            F.collect_list(F.when(F.col("part") > F.col("other"), F.col("fp"))).alias("probes"),
        ).where((F.size("table") > 0) & (F.size("table") + F.size("probes") > 1))
    return buckets.select("table", "probes").mapInArrow(_verify(WIDE_BITS), "u long, v long").where("u <> v").distinct()


def groups(docs: DataFrame, words: int = 3, dense: int = 1024) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest doc_id reachable over links, itself included.

    Every row is returned, repeated rows each.  Null or blank text has fingerprint 0 and is linked
    like any other.  Null doc_ids are kept but never the smallest, unless a group has no other.
    """
    stored = materialise(fingerprints(docs, words), "simhash")
    heads = materialise(stored.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "simhash-distinct")
    root = connected_components(links(heads, dense))
    rooted = heads.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialise(rooted, "simhash-rooted")
    named = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("weight")), "simhash-named")
    ids = lookup_weighted(rooted.select("fp", "root", "copies"), named, ["root"]).select("fp", "component_id", F.col("copies").alias("weight"))
    return lookup_weighted(stored, materialise(ids, "simhash-ids"), ["fp"]).select("doc_id", "fp", "component_id")


def shingles(data: bytes, words: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of a text's lower-cased word shingles (fewer words: of all of them), sorted."""
    h = word_hashes(data.translate(_LOWER))
    return np.unique(mix(windows_hash(prefix_hash(h), min(words, len(h))))) if len(h) else h


def _classes(docs: DataFrame, words: int) -> DataFrame:
    """``fp, key, least, th``: texts of equal words are one class, named by its least (doc_id, text hash)."""

    def run(batches):
        for b in batches:
            fps, keys = [], []
            for t in b.column("data"):
                t = t.as_py()
                fps.append(fingerprint(t, words))
                keys.append(xxhash.xxh64_intdigest(b" ".join(t.translate(_LOWER).split())))
            yield pa.record_batch([b.column("doc_id"), b.column("th"), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, keys))], ["doc_id", "th", "fp", "key"])

    rows = docs.select("doc_id", "th", "data").mapInArrow(run, "doc_id long, th long, fp long, key long")
    named = rows.groupBy("fp", "key").agg(F.min(F.struct("doc_id", "th")).alias("one"))
    return named.select("fp", "key", F.col("one.doc_id").alias("least"), F.col("one.th").alias("th"))


_SETS = "root long, least long, th long, set binary"


def _alike(mine: np.ndarray, others: list[np.ndarray], similarity: float) -> bool:
    """Whether a set of shingles is similar to one of others."""
    for other in others:
        if min(len(mine), len(other)) < similarity * max(len(mine), len(other)):
            continue
        both = len(np.intersect1d(mine, other, assume_unique=True))
        if both >= similarity * (len(mine) + len(other) - both):
            return True
    return False


def _judge(similarity: float):
    """Rows of whole components in order in; adds whether each is ``alike`` to an earlier one that stays."""

    def run(batches):
        now, stay = None, []
        for b in batches:
            alike = []
            for root, x in zip(b.column("root").to_pylist(), b.column("set"), strict=True):
                if root != now:
                    now, stay = root, []
                mine = np.frombuffer(x.as_py(), np.uint64)
                alike.append(_alike(mine, stay, similarity))
                if not alike[-1]:
                    stay.append(mine)
            yield b.append_column("alike", pa.array(alike, pa.bool_()))

    return run


def _against(similarity: float):
    """Rows by (root, salt), leaders first, in; the others out with ``alike``: similar to a leader or not."""

    def run(batches):
        now, leaders = None, []
        for b in batches:
            alike, place = [], []
            for i, (root, salt, leads, x) in enumerate(zip(*(b.column(c).to_pylist() for c in ("root", "salt", "leads")), b.column("set"), strict=True)):
                if (root, salt) != now:
                    now, leaders = (root, salt), []
                mine = np.frombuffer(x.as_py(), np.uint64)
                if leads:
                    leaders.append(mine)
                else:
                    place.append(i), alike.append(_alike(mine, leaders, similarity))
            rows = b.select(["root", "least", "th", "set"]).take(pa.array(place, pa.int64()))
            yield rows.append_column("alike", pa.array(alike, pa.bool_()))

    return run


def _removed(docs: DataFrame, classes: DataFrame, edges: DataFrame, words: int, similarity: float, whole: int = 256, share: int = 4096) -> DataFrame:
    """``least, th`` of classes to remove: of linked classes, in order of doc_id, each that is similar to
    one that stays.  A component of at most ``whole`` classes goes through one task.  Of larger ones each
    round decides the first ``whole`` classes and compares the others, dealt in shares of ``share``, with
    those that stay, until what is left is small: no task holds more than ``whole`` sets, none is broadcast."""
    rooted = materialise(classes.join(connected_components(edges).withColumnRenamed("node", "fp"), "fp"), "near-rooted")
    rooted = materialise(rooted.union(_same_print(classes, rooted)).select("root", "least", "th"), "near-classes")

    def sets(batches):
        for b in batches:
            found = [shingles(t.as_py(), words).tobytes() for t in b.column("data")]
            yield pa.record_batch([*(b.column(c) for c in ("root", "least", "th")), pa.array(found, pa.binary())], ["root", "least", "th", "set"])

    def judged(rows):
        order = rows.select("root", "least", "th", "set").repartition("root").sortWithinPartitions("root", "least", "th")
        return order.mapInArrow(_judge(similarity), f"{_SETS}, alike boolean")

    texts = docs.select(F.col("doc_id").alias("least"), "th", "data").join(rooted, ["least", "th"]).dropDuplicates(["least", "th"])
    left = materialise(texts.mapInArrow(sets, _SETS), "near-sets")
    name, salts = ["root", "least", "th"], F.ceil(F.col("weight") / share).cast("int")
    small, gone = [], []
    while True:
        sizes = materialise(left.groupBy("root").agg(F.count("*").alias("weight")), "near-sizes")
        large = sizes.where(F.col("weight") > whole)
        if large.isEmpty():
            small.append(left.select(*name, "set"))
            break
        place = F.row_number().over(Window.partitionBy("root").orderBy("least", "th"))  # tasks keep their first ``whole``
        first = left.select(*name).join(large.select("root"), "root", "left_semi").withColumn("place", place).where(F.col("place") <= whole)
        rows = lookup_weighted(left, sizes, ["root"]).join(first, name, "left")
        rows = materialise(rows.select(*name, "set", "weight", F.col("place").isNotNull().alias("first")), "near-sized")
        small.append(rows.where(F.col("weight") <= whole).select(*name, "set"))
        block = materialise(judged(rows.where("first")), "near-block")
        lead = block.where("not alike").join(large, "root").select(*name, "set", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(True).alias("leads"))
        rest = rows.where((F.col("weight") > whole) & ~F.col("first"))
        rest = rest.select(*name, "set", F.pmod(F.xxhash64("least", "th"), salts).cast("int").alias("salt"), F.lit(False).alias("leads"))
        met = lead.union(rest).repartition("root", "salt").sortWithinPartitions("root", "salt", F.desc("leads"))
        round_ = materialise(met.mapInArrow(_against(similarity), f"{_SETS}, alike boolean"), "near-round")
        gone += [block, round_]
        left = round_.where("not alike").drop("alike")
    rows = small[0]
    for s in small[1:]:
        rows = rows.union(s)
    out = judged(rows)
    for g in gone:
        out = out.union(g)
    return materialise(out.where("alike").select("least", "th"), "near-removed")


def _same_print(classes: DataFrame, rooted: DataFrame) -> DataFrame:
    """Classes of one fingerprint that no link names: they are a component of their own."""
    several = classes.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    return classes.join(several, "fp", "left_semi").join(rooted.select("fp").distinct(), "fp", "left_anti").withColumn("root", F.col("fp")).select(*rooted.columns)


def keep_first(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near duplicates: one document of each group stays.

    Texts of equal words (A-Z lower-cased) are copies; the least doc_id stays, of its repeated rows one.
    Others that are linked by their fingerprints (first within 3 bits, then within 8 to 10) go if the
    Jaccard similarity of their ``words``-word shingles to a document with a smaller doc_id that stays
    is ``similarity`` or more.  So every document that goes has a similar one that stays.  Null and blank
    texts are copies of each other; rows that share a doc_id but not the text are documents of their
    own; rows without a doc_id cannot be named and all stay; an empty table stays empty; columns are
    unchanged whatever their names.
    """
    rows = documents(docs).where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("data"))
    classes = materialise(_classes(rows, words), "near-prints")
    for find in (links, wide_links):
        edges = find(classes.select("fp").distinct())
        removed = _removed(rows, classes, edges, words, similarity)
        classes = materialise(classes.join(removed, ["least", "th"], "left_anti").select("fp", "key", "least", "th"), "near-kept")
    first, hashed, place = free_names(docs, "_first", "_th", "_place")
    stay = classes.select(F.col("least").alias(first), F.col("th").alias(hashed))
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    named = docs.join(stay, (F.col("doc_id").cast("long") == F.col(first)) & (text == F.col(hashed)), "left_semi")
    order = Window.partitionBy("doc_id", text).orderBy("text")
    one = named.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(*map(quoted, docs.columns))
    return one.union(docs.where("doc_id is null"))
