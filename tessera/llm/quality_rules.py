"""Quality rules: logistic regression on hashed word and character n-grams.

A text's features are the shares of its words, pairs of words and runs of
three bytes that fall into each of 2^17 buckets a kind. The score is linear in
these, so a document costs one table lookup an n-gram; batches are scored on
their bytes with numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textbytes as tb
from tessera.llm.shared import least_hashed

U64 = np.uint64
BITS = 17
#: Labelled rows of each class that the model is fitted on, at most; a fourth of them calibrates it.
SAMPLE = 1500
#: Bytes of text that are scored at a time; each takes about a hundred bytes of memory.
PIECE_BYTES = 500_000
#: Below the first a text is rejected, from the second on accepted; between them it is borderline and stays.
REJECT, ACCEPT = 0.2, 0.8


def _buckets(data: np.ndarray, offsets: np.ndarray):
    """For each kind of n-gram (buckets, text of each), in order of text."""
    if len(data) >= 3:
        wide = data.astype(np.uint32)
        key = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
        bucket = (key * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        within = np.ones(len(bucket), bool)
        edge = offsets[1:-1]
        for back in (1, 2):
            at = edge - back
            within[at[(at >= 0) & (at < len(within))]] = False
        place = np.flatnonzero(within)
        runs = bucket[place], np.searchsorted(offsets, place, "right") - 1
    else:
        runs = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    lower = tb.LOWER[data]
    begin, end, text = tb.words(lower, offsets)
    h = tb.span_hashes(lower, begin, end)
    one = (h >> U64(64 - BITS)).astype(np.uint32)
    pair = tb.mix(h[:-1] * tb.GRAM_CODE[0] + h[1:] * tb.GRAM_CODE[1]) if len(h) > 1 else h[:0]
    same = text[:-1] == text[1:] if len(h) > 1 else np.zeros(0, bool)
    two = (pair[same] >> U64(64 - BITS)).astype(np.uint32)
    return [runs, (one, text), (two, text[:-1][same] if len(h) > 1 else text[:0])]


class Model:
    """Weights of the three kinds, bias, and the line that calibrates the score."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        total = np.full(n, self.bias)
        for weights, (bucket, text) in zip(self.weights, _buckets(data, offsets), strict=True):
            bounds = np.searchsorted(text, np.arange(n + 1))
            running = np.r_[0.0, np.cumsum(weights[bucket], dtype=np.float64)]
            count = np.diff(bounds)
            total += np.diff(running[bounds]) / np.maximum(count, 1)
        return total

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.scores(data, offsets) + self.shift, -30, 30)))


def _pieces(texts: list[str], most: int = PIECE_BYTES):
    """(first text, bytes, offsets) of runs of texts, a little at a time, for the driver's sake."""
    at = 0
    for part in tb.chunks(pa.record_batch({"text": pa.array(texts, pa.large_string())}), "text", most):
        yield at, *tb.text_bytes(part.column("text"))
        at += part.num_rows


def fit(texts: list[str], good: np.ndarray, share_good: float, rounds: int = 120, rate: float = 1.0, decay: float = 1e-4) -> Model:
    """Full-batch Adam on three fourths of the rows, then Platt calibration on the others, weighted to the share of good rows."""
    order = np.random.default_rng(0).permutation(len(texts))
    held, rest = order[: len(order) // 4], order[len(order) // 4 :]
    size = 1 << BITS
    y = good[rest].astype(np.float64)
    columns, rows, values = [], [], []
    for first, data, offsets in _pieces([texts[i] for i in rest]):
        for kind, (bucket, text) in enumerate(_buckets(data, offsets)):
            counts = np.bincount(text, minlength=len(offsets) - 1)
            key, times = np.unique(text.astype(np.int64) * size + bucket, return_counts=True)
            rows.append((key // size + first).astype(np.int32))
            columns.append((kind * size + key % size).astype(np.int32))
            values.append((times / counts[key // size]).astype(np.float32))
    columns, rows, values = np.concatenate(columns), np.concatenate(rows), np.concatenate(values)
    w, b = np.zeros(3 * size), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(rows, values * w[columns], len(rest)) + b
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(columns, values * error[rows], 3 * size) / len(rest) + decay * w / len(rest)
        gb = error.mean()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = rate * (1 - t / (rounds + 1))
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        b -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    model = Model(w.reshape(3, size).astype(np.float32), b)
    s, target = np.concatenate([model.scores(d, o) for _, d, o in _pieces([texts[i] for i in held])]), good[held].astype(np.float64)
    if 0 < target.sum() < len(target):
        scale = max(1.0, float(np.abs(s).max()))
        x = s / scale
        weight = np.where(target == 1, share_good / target.mean(), (1 - share_good) / (1 - target.mean()))
        smooth = np.where(target == 1, (target.sum() + 1) / (target.sum() + 2), 1 / (len(target) - target.sum() + 2))
        a, c = scale, 0.0
        for _ in range(50):  # Newton's method for two parameters
            p = 1 / (1 + np.exp(-np.clip(a * x + c, -30, 30)))
            r, q = weight * (p - smooth), weight * p * (1 - p)
            hess = np.array([[(q * x * x).sum() + 1e-3, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-3]])
            step = np.linalg.solve(hess, [(r * x).sum(), r.sum()])
            a, c = a - np.clip(step[0], -5, 5), c - np.clip(step[1], -5, 5)
        model.slope, model.shift = max(a / scale, 1e-3), c
    return model


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of the labelled rows, or None where a class has none.

    At most `sample` labelled documents of each class are read, those of the
    least hash of their doc_id. Labels that differ for one doc_id count as the
    lower; of its texts, that of the least hash is read. Rows with a null doc_id, quality or text aren't used.
    """
    given = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    shares = {r.quality: r["count"] for r in given.groupBy("quality").count().collect()}
    if not shares.get(0) or not shares.get(1):
        return None
    chosen = least_hashed(given.where("quality in (0, 1)"), "quality", sample)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    good = np.array([r.quality for r in rows])
    if len(set(good.tolist())) < 2 or len(rows) < 8:
        return None
    return fit([r.text for r in rows], good, shares[1] / (shares[0] + shares[1]))


def _scored(model):
    def run(it):
        for batch in it:
            for part in tb.chunks(batch, "text", PIECE_BYTES):
                data, offsets = tb.text_bytes(part.column("text"))
                p = model.value.probabilities(data, offsets)
                words = np.diff(offsets) > 0
                at = part.schema.get_field_index("text")
                yield part.remove_column(at).append_column("p_good", pa.array(p, pa.float64(), mask=~words))

    return run


def scored(docs: DataFrame, labels: DataFrame, reject: float = REJECT, accept: float = ACCEPT, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, p_good, verdict) of every row of docs.

    p_good is the calibrated probability of good quality over the whole text.
    verdict: 'reject' where p_good < reject, 'accept' where it is at least
    accept, else 'borderline'. A null or empty text has no features: p_good is
    null and the verdict 'reject'. Without labels of both classes p_good is
    null and the verdict 'unscored' for all. Repeated rows are each scored; a
    null doc_id stays null. Very long texts are scored whole, an empty table
    gives no rows. Other columns are ignored.
    """
    model = trained(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        return rows.select("doc_id", F.lit(None).cast("double").alias("p_good"), F.lit("unscored").alias("verdict"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = rows.mapInArrow(tb.trimmed(_scored(shared)), "doc_id long, p_good double")
    verdict = F.when(F.col("p_good").isNull() | (F.col("p_good") < reject), "reject").when(F.col("p_good") >= accept, "accept").otherwise("borderline")
    return found.withColumn("verdict", verdict)


def _filtered(model, reject: float):
    def run(it):
        for batch in it:
            for part in tb.chunks(batch, "text", PIECE_BYTES):
                data, offsets = tb.text_bytes(part.column("text"))
                keep = (model.value.probabilities(data, offsets) >= reject) & (np.diff(offsets) > 0)
                yield part.filter(pa.array(keep))

    return run


def not_rejected(docs: DataFrame, labels: DataFrame, reject: float = REJECT, sample: int = SAMPLE) -> DataFrame:
    """docs without rejected rows, all columns kept: null and empty texts go as well. Without labels of both classes all rows stay, these too. Text is scored and passed on in one scan, without a join."""
    model = trained(docs, labels, sample)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(tb.trimmed(_filtered(shared, reject)), docs.schema)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
