"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features; each step fits a shallow tree to one
feature's bins (later: to one pair of features) and adds it to that feature's
lookup table. A text is scored by adding one table entry for each feature and
pair.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textbytes as tb
from tessera.llm.shared import least_hashed

#: Labelled rows of each class to fit on, at most.
SAMPLE = 3000
BINS, PAIR_BINS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE, LEAVES = 32, 8, 120, 6, 60, 0.15, 4
#: From this probability on a text is kept.
KEEP = 0.3

FEATURES = ["log_bytes", "log_words", "word_bytes", "upper", "digits", "marks", "symbols", "spaces", "wide", "line_bytes", "blank_lines", "line_ends", "common", "distinct", "longest_word"]
_COMMON = "the of and to in is that for it was as with on are this be by from de la le les et des en un une du que qui dans pour par sur est el los las y una por con para del se der die das und ist von zu mit den im nicht ein eine auf".split()
_MARKS = np.zeros(256, bool)
_MARKS[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "*$%&#!|=<>~^@{}[]\\/"]] = True
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?:;\"'"]] = True


def _hash_of(words: list[str]) -> np.ndarray:
    data, offsets = tb.text_bytes(pa.array(words))
    begin, end, _ = tb.words(data, offsets)
    return np.sort(tb.span_hashes(data, begin, end))


_COMMON_HASHES = _hash_of(sorted(set(_COMMON)))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text, from its bytes; zeros for a text without any."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)

    def count(flags: np.ndarray) -> np.ndarray:
        running = np.zeros(len(flags) + 1, np.int32)
        np.cumsum(flags, out=running[1:])
        return (running[offsets[1:]] - running[offsets[:-1]]).astype(np.float64)

    lower = tb.LOWER[data]
    begin, end, text = tb.words(lower, offsets)
    h = tb.span_hashes(lower, begin, end)
    words = np.bincount(text, minlength=n).astype(np.float64)
    some, many = np.maximum(size, 1), np.maximum(words, 1)
    letters = np.bincount(text, end - begin, n)
    longest = np.zeros(n)
    np.maximum.at(longest, text, end - begin)
    at = np.minimum(np.searchsorted(_COMMON_HASHES, h), len(_COMMON_HASHES) - 1)
    common = np.bincount(text, _COMMON_HASHES[at] == h, n)
    order = np.lexsort((h, text))
    hs, ts = h[order], text[order]
    new = np.r_[True, (hs[1:] != hs[:-1]) | (ts[1:] != ts[:-1])] if len(hs) else np.zeros(0, bool)
    distinct = np.bincount(ts[new], minlength=n)
    newline = data == 10
    lines = count(newline) + 1
    after = np.zeros(len(data), bool)
    blank = np.zeros(len(data), bool)
    if len(data):
        after[:-1] = newline[1:] & _ENDS[data[:-1]]
        blank[1:] = newline[1:] & newline[:-1]
    return np.stack([np.log1p(size), np.log1p(words), letters / many, count(lower != data) / some, count((data >= 48) & (data < 58)) / some, count(_MARKS[data]) / some, count(_SYMBOLS[data]) / some, count((data == 32) | newline) / some, count(data >= 128) / some, size / lines, count(blank) / lines, count(after) / lines, common / many, distinct / many, longest], 1)


def _table(grad: np.ndarray, hess: np.ndarray, leaves: int) -> np.ndarray:
    """Lookup table of a greedy tree over ordered bins with at most that many leaves (Newton steps, lightly shrunk)."""
    g, h = np.r_[0, np.cumsum(grad)], np.r_[0, np.cumsum(hess)]

    def best(lo: int, hi: int):
        if hi - lo < 2:
            return 0.0, lo
        cut = np.arange(lo + 1, hi)
        gl, hl = g[cut] - g[lo], h[cut] - h[lo]
        gr, hr = g[hi] - g[cut], h[hi] - h[cut]
        gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - (g[hi] - g[lo]) ** 2 / (h[hi] - h[lo] + 1)
        k = int(gain.argmax())
        return float(gain[k]), int(cut[k])

    spans = [(0, len(grad))]
    while len(spans) < leaves:
        gain, cut, k = max((*best(*s), k) for k, s in enumerate(spans))
        if gain <= 1e-9:
            break
        lo, hi = spans[k]
        spans[k : k + 1] = [(lo, cut), (cut, hi)]
    table = np.zeros(len(grad))
    for lo, hi in spans:
        table[lo:hi] = -(g[hi] - g[lo]) / (h[hi] - h[lo] + 1)
    return table


def _pair_table(grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, float]:
    """Table of a tree of depth two: one cut of the first feature, then one of the second on either side; and its gain."""
    best, found = -1.0, np.zeros_like(grad)
    total = grad.sum() ** 2 / (hess.sum() + 1)
    for turned in (False, True):
        g, h = (grad.T, hess.T) if turned else (grad, hess)
        for cut in range(1, len(g)):
            table, gain = np.zeros_like(g), -total
            for side in (slice(0, cut), slice(cut, len(g))):
                gs, hs = g[side].sum(0), h[side].sum(0)
                row = _table(gs, hs, 2)
                gain += float((-row * gs - 0.5 * row**2 * (hs + 1e-9)).sum() * 2)
                table[side] = row
            if gain > best:
                best, found = gain, table.T if turned else table
    return found, best


class Gam:
    """Edges of the bins, lookup tables by feature and by pair, and the intercept."""

    def __init__(self, edges, tables, pairs, pair_tables, intercept):
        self.edges, self.tables, self.pairs, self.pair_tables, self.intercept = edges, tables, pairs, pair_tables, intercept

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[b[:, j]]
        coarse = b * PAIR_BINS // BINS
        for (p, q), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[:, p], coarse[:, q]]
        return total

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scores(x), -30, 30)))


def fit(x: np.ndarray, good: np.ndarray, share_good: float) -> Gam:
    """Rows are weighted so that the classes have their shares of the labelled corpus."""
    y = good.astype(np.float64)
    weight = np.where(y == 1, share_good / y.mean(), (1 - share_good) / (1 - y.mean()))
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(x.shape[1])]
    model = Gam(edges, [np.zeros(BINS) for _ in edges], [], [], float(np.log(share_good / (1 - share_good))))
    bins = model.bins(x)
    coarse = bins * PAIR_BINS // BINS
    score = np.full(len(x), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        return weight * (p - y), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _table(np.bincount(bins[:, j], g, BINS), np.bincount(bins[:, j], h, BINS), LEAVES)
            table += step
            score += step[bins[:, j]]

    def squares(p: int, q: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[:, p] * PAIR_BINS + coarse[:, q], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)

    g, h = slopes()
    gains = {(p, q): _pair_table(squares(p, q, g), squares(p, q, h))[1] for p, q in itertools.combinations(range(x.shape[1]), 2)}
    model.pairs = sorted(gains, key=lambda k: (-gains[k], k))[:PAIRS]
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (p, q), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            step = RATE * _pair_table(squares(p, q, g), squares(p, q, h))[0]
            table += step
            score += step[coarse[:, p], coarse[:, q]]
    return model


def _feature_rows(it):
    for batch in it:
        for part in tb.chunks(batch, "text"):
            x = features(*tb.text_bytes(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "quality", "x"])


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Gam | None:
    """A model of the labelled rows, or None where a class has none. Tasks send features, not texts.

    At most `sample` documents of each class are used, those of the least hash
    of doc_id; labels that differ for one doc_id count as the lower.
    """
    given = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    shares = {r.quality: r["count"] for r in given.groupBy("quality").count().collect()}
    if not shares.get(0) or not shares.get(1):
        return None
    chosen = least_hashed(given.where("quality in (0, 1)"), "quality", sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text <> ''").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    found = sorted((r.doc_id, r.quality, tuple(r.x)) for r in rows.mapInArrow(_feature_rows, "doc_id long, quality int, x array<double>").collect())
    good = np.array([q for _, q, _ in found])
    if len(set(good.tolist())) < 2:
        return None
    return fit(np.array([x for _, _, x in found]), good, shares[1] / (shares[0] + shares[1]))


def _scored(model):
    def run(it):
        for batch in it:
            for part in tb.chunks(batch, "text"):
                data, offsets = tb.text_bytes(part.column("text"))
                p = model.value.probabilities(features(data, offsets))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p, pa.float64(), mask=np.diff(offsets) == 0)], ["doc_id", "p_good"])

    return run


def classified(docs: DataFrame, labels: DataFrame, keep: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, p_good, keep) of every row.

    keep is p_good >= the threshold. A null or empty text has no features:
    p_good is null and keep false. Without labels of both classes p_good is
    null and keep true for all. Repeated rows are each scored, a null doc_id
    stays null, other columns are ignored; an empty table gives no rows.
    """
    model = trained(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        return rows.select("doc_id", F.lit(None).cast("double").alias("p_good"), F.lit(True).alias("keep"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = rows.mapInArrow(_scored(shared), "doc_id long, p_good double")
    return found.withColumn("keep", F.coalesce(F.col("p_good") >= keep, F.lit(False)))


def op6_quality_gam(spark, sf_dir: str) -> DataFrame:
    return classified(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
