"""Quality classifier by positive-unlabelled learning.

A linear model over hashed byte trigrams and a few shape features is fitted by the non-negative unbiased risk

    prior * R(positives as 1) + max(0, R(unlabelled as 0) - prior * R(positives as 0))

from trusted positives (label 1 outside the held-out fold) and unlabelled web text of the same fold; labels 0 are never read. The
class prior is the smallest ratio of tail masses, unlabelled to positive, under a first positive-against-unlabelled model on halves
it has not seen. Both samples are bounded: ``POSITIVES`` and ``UNLABELLED`` rows, of least hash; features are computed
where the texts lie, so only their vectors reach the driver. Every whole text is scored.

Defined results: null and empty texts have all features 0 and get the score of the intercept; repeated rows get equal scores; without
any trusted positive every score is 0.5; labels that name no document, or a document twice, do no harm; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import SPACE_SEPARATED, arrow_batches, durable, mix, pieces, utf8, words

POSITIVES = 2500
UNLABELLED = 5000
HASHED = 1024
SHAPES = 9
FOLDS = 5
THRESHOLD = 0.3
STEPS = 400
RIDGE = 1e-4
KEEP = 0.998  # share of the trusted positives that the threshold lets through

_LINES = np.ones(256, dtype=bool)
_LINES[[10, 13]] = False
_CLASS = np.zeros(256, np.int64)  # upper, lower, digit, other visible ASCII, white space, not ASCII
_CLASS[33:127], _CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 3, 0, 1, 2, 5
_CLASS[[9, 10, 11, 12, 13, 32]] = 4


def held_out(key: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _distinct_share(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Distinct parts over parts of each text."""
    _, _, h, first = words(data, off, inside)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    _, at = np.unique(mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(doc[at], minlength=len(n)) / np.maximum(n, 1)


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row for each text: square roots of trigram shares, and shape features between 0 and about 1."""
    n, size = len(off) - 1, np.diff(off)
    out = np.zeros((n, HASHED + SHAPES), np.float32)
    if not n or not len(data):
        return out
    doc = np.repeat(np.arange(n), size)
    if len(data) > 2:
        same = doc[2:] == doc[:-2]
        b = data.astype(np.uint32)
        tri = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35))
        slot = ((tri ^ (tri >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(12)) % np.uint32(HASHED)
        counts = np.bincount(doc[:-2][same] * HASHED + slot[same], minlength=n * HASHED).reshape(n, HASHED)
        out[:, :HASHED] = 4 * np.sqrt(counts / np.maximum(size - 2, 1)[:, None])
    shares = np.bincount(doc * 6 + _CLASS[data], minlength=n * 6).reshape(n, 6) / np.maximum(size, 1)[:, None]
    out[:, HASHED: HASHED + 6] = shares
    out[:, HASHED + 6] = np.log1p(size) / 12
    out[:, HASHED + 7] = _distinct_share(data, off, SPACE_SEPARATED)
    out[:, HASHED + 8] = _distinct_share(data, off, _LINES)
    out[size == 0] = 0
    return out


def _vectors(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple] = set()  # repeated rows of this task; the sample bounds it
        for whole in batches:
            for batch in pieces(whole, text):
                positive, row = batch.column(batch.schema.get_field_index("positive")), batch.column(batch.schema.get_field_index("row"))
                new = [i for i, x in enumerate(zip(positive.to_pylist(), row.to_pylist())) if not (x in sent or sent.add(x))]
                new = pa.array(new, pa.int64())
                x = features(*utf8(batch.column(batch.schema.get_field_index(text)).take(new))[:2])
                yield pa.RecordBatch.from_pydict({"positive": positive.take(new), "row": row.take(new), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    return run


def _fit(x: np.ndarray, gradient, steps: int = STEPS, rate: float = 0.02) -> np.ndarray:
    """Adam on a linear model; ``gradient`` gives dRisk/dmargin of every row."""
    w = np.zeros(x.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = gradient(x @ w) @ x + RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio of tail masses above a threshold, with room for chance."""
    z = np.sort(np.concatenate([positive, unlabelled]))
    p, u = np.sort(positive), np.sort(unlabelled)
    tail_p = 1 - np.searchsorted(p, z, "left") / len(p)
    tail_u = 1 - np.searchsorted(u, z, "left") / len(u)
    room = np.sqrt(np.log(4 / 0.1) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    ok = tail_p > 0
    best = np.argmin((tail_u[ok] + room) / tail_p[ok])
    return float(np.clip(tail_u[ok][best] / tail_p[ok][best], 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights (the last is the intercept) and the estimated prior."""
    one = lambda a: np.hstack([a, np.ones((len(a), 1), np.float32)])
    p, u = one(positive), one(unlabelled)
    n_p, n_u = len(p), len(u)
    # First positives against unlabelled, on one half; the prior from the other half.
    a, b = p[::2], u[::2]
    x = np.vstack([a, b])
    y = np.r_[np.ones(len(a)), np.zeros(len(b))].astype(np.float32)
    share = np.where(y == 1, 0.5 / len(a), 0.5 / max(1, len(b))).astype(np.float32)
    first = _fit(x, lambda z: (share * (_sigmoid(z) - y)).astype(np.float32), STEPS // 2)
    prior = estimate_prior(p[1::2] @ first, u[1::2] @ first) if n_p > 1 and n_u > 1 else 0.5
    x = np.vstack([p, u])

    def gradient(z: np.ndarray) -> np.ndarray:
        zp, zu = z[:n_p], z[n_p:]
        g = np.empty_like(z)
        if _softplus(zu).mean() - prior * _softplus(zp).mean() >= 0:
            g[:n_p] = -prior / n_p  # of prior * (loss as 1 - loss as 0), whose slope is constant
            g[n_p:] = _sigmoid(zu) / n_u
        else:  # the negative part must not go below zero: step back along it
            g[:n_p] = prior * _sigmoid(zp) / n_p
            g[n_p:] = -_sigmoid(zu) / n_u
        return g

    w = _fit(x, gradient)
    # The risk fixes the order of texts; where to cut is told by the positives, so the intercept puts the threshold there.
    w[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - np.quantile(p @ w, 1 - KEEP)
    return w, prior


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> np.ndarray | None:
    """Weights of the model, or None if no trusted positive lies outside the held-out fold.

    A sample is the rows whose hash lies under a bound set by the number of rows, cut at the exact size: no sort or limit over texts.
    """
    def under(hashed: Column, wanted: int, there: int) -> Column:
        return F.pmod(hashed, F.lit(1 << 40)) < int((1 << 40) * min(1.0, (1.2 * wanted + 200) / max(1, there)))

    trusted = labels.filter(~held_out(F.col(key)) & (F.col(label) == 1)).select(F.col(key).alias("key")).distinct()
    known = durable(trusted.filter(under(F.xxhash64("key", F.lit(7)), positives, trusted.count())))
    if not known.count():
        return None
    pool = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(~held_out(F.col("key")))
    row = F.xxhash64("key", "text", F.lit(11))
    near = pool.join(F.broadcast(known), "key", "left_semi").select(F.lit(True).alias("positive"), row.alias("row"), "text")
    any_ = pool.filter(under(row, unlabelled, pool.count())).select(F.lit(False).alias("positive"), row.alias("row"), "text")
    rows = near.unionByName(any_).mapInArrow(_vectors("text"), "positive boolean, row long, x binary").dropDuplicates(["positive", "row"]).toPandas()
    rows = rows.sort_values("row")
    near, any_ = rows[rows.positive][:positives], rows[~rows.positive][:unlabelled]
    if not len(near) or not len(any_):
        return None
    matrix = lambda x: np.frombuffer(b"".join(x), np.float32).reshape(-1, HASHED + SHAPES)
    return fit(matrix(near.x), matrix(any_.x))[0]


def _score_with(weights: np.ndarray | None, text: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text):
                data, off, _ = utf8(batch.column(batch.schema.get_field_index(text)))
                if weights is None:
                    score = np.full(len(off) - 1, 0.5)
                else:
                    score = _sigmoid((features(data, off) @ weights[:-1] + weights[-1]).astype(np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(score) if f.name == "score" else batch.column(batch.schema.get_field_index(f.name)).cast(f.type) for f in schema], schema=schema)

    return run


def score(documents: DataFrame, weights: np.ndarray | None, text: str = "text") -> DataFrame:
    """``documents`` with a column ``score`` (a column of that name is replaced)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    plain = documents.drop("score")
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())])
    return plain.mapInArrow(_score_with(weights, text, to_arrow_schema(schema)), schema)


def classify(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD,
             positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """``documents`` with held_out, score (0 to 1, higher is better) and predicted (1 from the threshold on)."""
    arrow_batches(documents.sparkSession)
    weights = train(documents, labels, key, text, label, positives, unlabelled)
    return (score(documents, weights, text).withColumn("held_out", held_out(F.col(key)))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
