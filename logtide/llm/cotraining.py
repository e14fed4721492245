"""Quality classifier by co-training (Blum and Mitchell, 1998).

Two views of a document, its text and its metadata (language, source, size), get a logistic
classifier each.  In each round each view labels every unlabelled document that it is sure of for
the other, which moves on by gradients over the labelled and all those documents.  Held-out documents
calibrate both views (Platt), and all documents are scored by the sum of the calibrated log-odds less
the prior's, counted once.

Labelled documents are a bounded sample (``most_labelled`` of smallest hash), whose features come to
the driver.  The unlabelled ones are never sampled: their features are written once to the shared
folder, each step passes over them with two weight vectors and only sums of gradients come back.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .rules import grams
from .tokens import slices

GRAMS = 512
META = 256
#: Floats of a document: hashed trigrams and four shape figures; hashed metadata.
DIMS = GRAMS + 4 + META


def text_view(data: bytes) -> np.ndarray:
    """Square-rooted shares of hashed byte trigrams (a unit vector) and shape figures."""
    g = grams(data, 1 << 14)
    out = np.zeros(GRAMS + 4, np.float32)
    if len(g):
        out[:GRAMS] = np.sqrt(np.bincount(g % GRAMS, minlength=GRAMS) / len(g))
        a = np.frombuffer(data, np.uint8)
        n = len(a)
        stretch = np.arange(len(g), dtype=np.uint32) // np.uint32(2000)  # distinct within each, so length plays little part
        out[GRAMS] = len(np.unique(g + (stretch << np.uint32(14)))) / len(g)
        out[GRAMS + 1] = np.count_nonzero((a >= 65) & (a <= 90)) / n
        out[GRAMS + 2] = np.count_nonzero((a >= 33) & (a <= 47)) / n
        out[GRAMS + 3] = math.log2(n) / 20
    return out


def meta_slots(lang: str | None, source: str | None, n_chars: int | None) -> list[int]:
    """The three metadata features that a document has, as slots."""
    size = -1 if n_chars is None else max(0, int(n_chars)).bit_length()
    return [zlib.crc32(f"{kind}={value}".encode()) % META for kind, value in (("lang", lang), ("source", source), ("size", size))]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Weights and intercept of a ridge logistic model; classes weigh alike; Nesterov's gradient steps."""
    x = np.column_stack([x, np.ones(len(x), np.float32)]).astype(np.float32)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
    rate = 4.0 / float((x * x).sum(axis=1).max() + ridge)
    w = v = np.zeros(x.shape[1], np.float32)
    for t in range(steps):
        z = np.clip(x @ v, -30, 30)
        step = x.T @ (share * (1 / (1 + np.exp(-z)) - y)) + ridge * v
        new = v - rate * step
        v = new + (t / (t + 3)) * (new - w)
        w = new
    return w


def platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope (not negative) and intercept that turn scores into log-odds, by Newton's steps.

    Targets are softened as Platt does, so perfect separation stays finite.
    """
    up, down = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 0.0, math.log((up + 1) / (down + 1))
    scale = float(np.std(z)) or 1.0
    x = z / scale
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        q = p * (1 - p) + 1e-9
        g = np.array([((p - t) * x).sum() + 1e-3 * a, (p - t).sum()])
        h = np.array([[(q * x * x).sum() + 1e-3, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        a, b = a - float(np.clip(move[0], -5, 5)), b - float(np.clip(move[1], -5, 5))
    if a < 0:
        return 0.0, math.log((up + 1) / (down + 1))
    return a / scale, b


class CoTrained:
    """Two fitted, calibrated views."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, slopes: tuple, prior: float):
        self.text, self.meta, self.slopes, self.prior = text, meta, slopes, prior

    def log_odds(self, text: np.ndarray, slots: list[int]) -> tuple[float, float, float]:
        (a, b), (c, d) = self.slopes
        one = a * float(text @ self.text[:-1] + self.text[-1]) + b
        two = c * float(self.meta[slots].sum() + self.meta[-1]) + d
        return one, two, one + two - self.prior


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pool_sums(views: tuple, teachers: list, students: list, sure: float) -> np.ndarray:
    """Of unlabelled rows: for each view and class the number of rows that the other view is sure of and
    the sum of their gradients; then each view's largest squared norm.

    ``teachers`` are the weights and slopes that label, ``students`` the weights that learn.
    """
    out = []
    for me, other in ((0, 1), (1, 0)):
        w, (a, b) = teachers[other]
        p = _sigmoid(a * (views[other] @ w[:-1] + w[-1]) + b)
        for y, rows in ((0, p <= 1 - sure), (1, p >= sure)):
            x = views[me][rows]
            miss = _sigmoid(x @ students[me][:-1] + students[me][-1]) - y
            out += [[len(x)], miss @ x, [miss.sum()]]
    out.append([float((v * v).sum(axis=1).max(initial=0)) + 1 for v in views])
    return np.concatenate(out).astype(np.float64)


def merged(sums: list[np.ndarray]) -> np.ndarray:
    """The sums of several parts of the pool as of one."""
    every = np.array(sums)
    return np.concatenate([every[:, :-2].sum(axis=0), every[:, -2:].max(axis=0)])


def exchange(text: np.ndarray, meta: np.ndarray, label: np.ndarray, pool, rounds: int = 4, sure: float = 0.95, steps: int = 12) -> CoTrained | None:
    """Fit on rows with label 1 or 0; ``pool(teachers, students, sure)`` gives the ``pool_sums`` of all unlabelled rows.

    None unless both classes have ten rows.  Of a class, the labelled rows together and the pseudo-labelled
    rows together weigh alike, however many they are.
    """
    if (label == 1).sum() < 10 or (label == 0).sum() < 10:
        return None
    known = np.arange(len(label))
    held, train = known[::4], np.setdiff1d(known, known[::4])
    if len(set(label[held])) < 2 or len(set(label[train])) < 2:
        held = train = known
    views = (text, meta)
    weight = [fit_logistic(v[train], label[train]) for v in views]
    ones = [np.column_stack([v[train], np.ones(len(train), np.float32)]) for v in views]
    own = [float((x * x).sum(axis=1).max()) for x in ones]
    y, ridge = label[train], 1e-4

    def slopes():
        return [platt(v[held] @ w[:-1] + w[-1], label[held]) for v, w in zip(views, weight, strict=True)]

    for _ in range(rounds):
        teachers = list(zip(weight, slopes(), strict=True))
        ahead = list(weight)
        for t in range(steps):
            got = pool(teachers, ahead, sure)
            norms, at, sure_of = got[-2:], 0, 0
            for me, x in enumerate(ones):
                d, step = x.shape[1], ridge * ahead[me]
                miss = _sigmoid(x @ ahead[me]) - y
                for c in (0, 1):
                    n, sums = got[at], got[at + 1 : at + 1 + d]
                    mean = miss[y == c] @ x[y == c] / (y == c).sum()
                    step = step + 0.5 * ((mean + sums / n) / 2 if n else mean)
                    at, sure_of = at + 1 + d, sure_of + n
                new = (ahead[me] - 4.0 / (max(own[me], norms[me]) + ridge) * step).astype(np.float32)
                ahead[me], weight[me] = new + np.float32(t / (t + 3)) * (new - weight[me]), new
            if not sure_of:
                break
        if not sure_of:
            break
    up, down = (label == 1).sum(), (label == 0).sum()
    return CoTrained(weight[0], weight[1], tuple(slopes()), math.log(up / down))


def co_train(text: np.ndarray, meta: np.ndarray, label: np.ndarray, rounds: int = 4, sure: float = 0.95) -> CoTrained | None:
    """``exchange`` over rows in memory with label 1, 0 or -1 (unlabelled)."""
    known, free = label >= 0, label < 0
    return exchange(text[known], meta[known], label[known], lambda *a: pool_sums((text[free], meta[free]), *a), rounds, sure)


def _rows(docs: DataFrame) -> DataFrame:
    """The columns that the views read, by name in any case (the first of that name), null where ``docs`` has none."""
    names = [c.lower() for c in docs.columns]
    docs = docs.toDF(*(f"c{i}" for i in range(len(names))))
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    col = {n: (F.col(f"c{names.index(n)}") if n in names else F.lit(None)).cast(t) for n, t in kinds.items()}
    data = F.coalesce(col["text"], F.lit("")).cast("binary")
    return docs.select(col["doc_id"].alias("doc_id"), data.alias("data"), *(col[n].alias(n) for n in ("lang", "source", "n_chars")))


def _features(batches):
    for batch in batches:
        for b in slices(batch, "data"):
            out, slots = [], []
            for data, lang, source, size in zip(b.column("data"), *(b.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True):
                out.append(text_view(data.as_py()).tobytes())
                slots.append(np.array(meta_slots(lang, source, size), np.int16).tobytes())
            yield pa.record_batch([b.column("doc_id"), pa.array(out, pa.binary()), pa.array(slots, pa.binary())], ["doc_id", "x", "slots"])


def _flat(column: pa.Array, kind: type) -> np.ndarray:
    """All values of a binary column one after another, without a copy."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind)


def _matrices(x: pa.Array, slots: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Both views of rows of ``_features``."""
    meta = np.zeros((len(x), META), np.float32)
    meta[np.arange(len(x))[:, None], _flat(slots, np.int16).reshape(len(x), 3)] = 1
    return _flat(x, np.float32).reshape(len(x), GRAMS + 4), meta


def _pool_of(stored: DataFrame):
    """The ``pool`` of ``exchange`` over stored features; one row of sums a task comes to the driver."""

    def pool(teachers, students, sure):
        def run(batches):
            parts = []
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    b = batch.slice(at, 1024)
                    parts.append(pool_sums(_matrices(b.column("x"), b.column("slots")), teachers, students, sure))
            pa.default_memory_pool().release_unused()
            if parts:
                yield pa.record_batch([pa.array([merged(parts).tobytes()], pa.binary())], ["sums"])

        got = [np.frombuffer(bytes(r.sums)) for r in stored.mapInArrow(run, "sums binary").collect()]
        none = pool_sums((np.zeros((0, GRAMS + 4), np.float32), np.zeros((0, META), np.float32)), teachers, students, sure)
        return merged([none, *got])

    return pool


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 4000) -> CoTrained | None:
    """Co-train on a bounded sample of labelled rows and all other rows of ``docs``; ``labels`` has
    doc_id and quality (1 good, 0 not).  Labelled rows outside the sample count as unlabelled.

    Null or empty text has no text features, null metadata is a value of its own, texts are taken whole.
    Of a labelled doc_id that repeats one row is taken, and of its labels the lesser.  None where either
    class has under ten documents, as with empty tables; other columns do not matter."""
    rows = _rows(docs)
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y"))
    asked = dict(map(tuple, known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled).collect()))
    if not asked:
        return None
    ids = F.broadcast(docs.sparkSession.createDataFrame([(d,) for d in asked], "doc_id long"))
    kinds = "doc_id long, x binary, slots binary"
    sample = rows.join(ids, "doc_id", "left_semi").mapInArrow(_features, kinds)
    got = sorted(sample.dropDuplicates(["doc_id"]).collect(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    y = np.array([asked[r.doc_id] for r in got])
    if (y == 1).sum() < 10 or (y == 0).sum() < 10:
        return None
    text, meta = _matrices(pa.array([bytes(r.x) for r in got], pa.binary()), pa.array([bytes(r.slots) for r in got], pa.binary()))
    rest = rows.join(ids, "doc_id", "left_anti").mapInArrow(_features, kinds).select("x", "slots")
    return exchange(text, meta, y, _pool_of(materialise(rest, "unlabelled")))


def score(docs: DataFrame, model: CoTrained | None, threshold: float = 0.5) -> DataFrame:
    """``doc_id, text_p, meta_p, quality_p, kept`` for every row.

    Null text counts as empty and null metadata as a value of its own.  Without a model (too few
    labels of either class) nothing is rejected and the probabilities are null.  Repeated rows each
    get their verdict; an empty table stays empty.
    """

    def run(batches):
        for batch in batches:
            for b in slices(batch, "data"):
                out = []
                for data, lang, source, size in zip(b.column("data"), *(b.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True):
                    if model is None:
                        out.append((None, None, None, True))
                    else:
                        p = _sigmoid(np.array(model.log_odds(text_view(data.as_py()), meta_slots(lang, source, size)))).tolist()
                        out.append((*p, p[2] >= threshold))
                kinds = [pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
                cols = list(zip(*out, strict=True)) or [()] * 4
                yield pa.record_batch([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "text_p", "meta_p", "quality_p", "kept"])

    return _rows(docs).mapInArrow(run, "doc_id long, text_p double, meta_p double, quality_p double, kept boolean")


def keep_good(docs: DataFrame, model: CoTrained | None, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns unchanged.

    Null text counts as empty, missing or null metadata as a value of its own; without a model every row
    stays; repeated rows each get the same verdict; an empty table stays empty; texts are taken whole."""
    if model is None:
        return docs
    names = [c.lower() for c in docs.columns]
    text, *others = (names.index(c) if c in names else None for c in ("text", "lang", "source", "n_chars"))

    def run(batches):
        for batch in batches:
            data = batch.column(text).fill_null("")
            at = 0
            for b in slices(pa.record_batch([data], ["data"]), "data"):
                part, at = batch.slice(at, b.num_rows), at + b.num_rows
                rows = zip(b.column("data"), *([None] * b.num_rows if i is None else part.column(i).to_pylist() for i in others), strict=True)
                z = [model.log_odds(text_view(t.as_py().encode()), meta_slots(*m))[2] for t, *m in rows]
                yield part.filter(pa.array(_sigmoid(np.array(z)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
