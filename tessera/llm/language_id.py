"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are read in segments of 128 bytes, all of them; the network labels every
byte from what stands before and after it in its segment, and a document's
probabilities are the means over its bytes. Training is backpropagation
through time in numpy; many segments run side by side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textbytes as tb
from tessera.llm.shared import least_hashed

SEGMENT, HIDDEN, SIDE = 128, 8, 1024
#: Documents of each language that the network is trained on, at most.
SAMPLE, EPOCHS, BATCH, RATE = 150, 5, 128, 0.02

f32 = np.float32


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, length, text) of the segments of all texts; bytes after the length of the last one of a text are zero."""
    size = np.diff(offsets)
    count = -(-size // SEGMENT)
    text = np.repeat(np.arange(len(size)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][text] + k * SEGMENT
    length = np.minimum(size[text] - k * SEGMENT, SEGMENT)
    at = start[:, None] + np.arange(SEGMENT)
    inside = np.arange(SEGMENT) < length[:, None]
    out = np.zeros((len(text), SEGMENT), np.uint8)
    out[inside] = data[at[inside]]
    return out, length, text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return f32(0.5) * np.tanh(f32(0.5) * x) + f32(0.5)


class Network:
    """Weights: for each direction a row of inputs for every byte and the recurrence, then the output layer over both."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 1):
        r = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = r.normal(0, 0.3, (256, 3 * hidden)).astype(f32)
            self.w[f"u{d}"] = r.normal(0, 0.3, (hidden, 3 * hidden)).astype(f32)
            self.w[f"v{d}"] = r.normal(0, 0.3, (hidden, len(languages))).astype(f32)
        self.w["c"] = np.zeros(len(languages), f32)

    def _step(self, x: np.ndarray, u: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        k = self.hidden
        a = h @ u
        gates = _sigmoid(x[:, : 2 * k] + a[:, : 2 * k])
        z, r = gates[:, :k], gates[:, k:]
        n = np.tanh(x[:, 2 * k :] + r * a[:, 2 * k :])
        return n + z * (h - n), z, r, n, a[:, 2 * k :]

    def logits(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Scores of every language at every place: (place, segment, language)."""
        places = int(length.max(initial=0))
        out = np.zeros((places, len(x), len(self.languages)), f32)
        out += self.w["c"]
        turned = np.ascontiguousarray(x[:, :places].T)
        short = length < places
        for d, order in (("f", range(places)), ("b", range(places - 1, -1, -1))):
            xs, u, v = self.w[f"x{d}"], self.w[f"u{d}"], self.w[f"v{d}"]
            h = np.zeros((len(x), self.hidden), f32)
            for t in order:
                h = self._step(xs[turned[t]], u, h)[0]
                if d == "b":
                    h[short & (length <= t)] = 0
                out[t] += h @ v
        return out

    def gradients(self, x: np.ndarray, length: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all bytes, and its gradients by backpropagation through time."""
        places, n, k = int(length.max()), len(x), self.hidden
        inside = np.arange(places)[:, None] < length
        turned = np.ascontiguousarray(x[:, :places].T)
        states = {}
        for d, order in (("f", list(range(places))), ("b", list(range(places - 1, -1, -1)))):
            h, kept = np.zeros((n, k), f32), []
            for t in order:
                new, z, r, c, a = self._step(self.w[f"x{d}"][turned[t]], self.w[f"u{d}"], h)
                new = new * inside[t][:, None] + h * ~inside[t][:, None]
                kept.append((t, h, new, z, r, c, a))
                h = new
            states[d] = kept
        logits = np.zeros((places, n, len(self.languages)), f32) + self.w["c"]
        for d, kept in states.items():
            for t, _, new, *_ in kept:
                logits[t] += new @ self.w[f"v{d}"]
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        total = f32(inside.sum())
        loss = float(-(np.log(np.maximum(p[:, np.arange(n), target], 1e-12)) * inside).sum() / total)
        delta = p
        delta[:, np.arange(n), target] -= 1
        delta *= inside[:, :, None] / total
        g = {name: np.zeros_like(w) for name, w in self.w.items()}
        g["c"] = delta.sum((0, 1))
        for d, kept in states.items():
            u, v = self.w[f"u{d}"], self.w[f"v{d}"]
            carry = np.zeros((n, k), f32)
            by_byte = np.zeros((places, n, 3 * k), f32)
            for t, h, new, z, r, c, a in reversed(kept):
                on = inside[t][:, None]
                g[f"v{d}"] += new.T @ delta[t]
                dh = delta[t] @ v.T + carry
                live = dh * on
                dc = live * (1 - z) * (1 - c * c)
                dz = live * (h - c) * z * (1 - z)
                dr = dc * a * r * (1 - r)
                da = np.concatenate([dz, dr, dc * r], 1)
                by_byte[t] = np.concatenate([dz, dr, dc], 1)
                g[f"u{d}"] += h.T @ da
                carry = live * z + da @ u.T + dh * ~on
            flat, rows = turned.reshape(-1), by_byte.reshape(-1, 3 * k)
            for j in range(3 * k):
                g[f"x{d}"][:, j] = np.bincount(flat, rows[:, j], 256)
        return loss, g

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities, labelled bytes) by text and language; zeros for a text without bytes."""
        n, k = len(offsets) - 1, len(self.languages)
        share, labelled = np.zeros((n, k)), np.zeros((n, k), np.int64)
        x, length, text = segments(data, offsets)
        for at in range(0, len(x), SIDE):
            own, size, who = x[at : at + SIDE], length[at : at + SIDE], text[at : at + SIDE]
            p = self.logits(own, size)
            inside = np.arange(len(p))[:, None] < size
            top = p.argmax(2)
            p -= p.max(2, keepdims=True)
            np.exp(p, out=p)
            p /= p.sum(2, keepdims=True)
            p *= inside[:, :, None]
            first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            share[who[first]] += np.add.reduceat(p.sum(0, dtype=np.float64), first)
            for j in range(k):
                labelled[who[first], j] += np.add.reduceat(((top == j) & inside).sum(0), first)
        return share / np.maximum(np.diff(offsets), 1)[:, None], labelled


def fit(texts: list[str], languages: list[str], epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, hidden: int = HIDDEN, seed: int = 1) -> Network:
    """Adam on the mean loss of all bytes of batches of segments."""
    names = sorted(set(languages))
    net = Network(names, hidden, seed)
    data, offsets = tb.text_bytes(pa.array(texts, pa.large_string()))
    x, length, text = segments(data, offsets)
    target = np.array([names.index(v) for v in languages])[text]
    r, t = np.random.default_rng(seed), 0
    m, v = ({k: np.zeros_like(w) for k, w in net.w.items()} for _ in range(2))
    steps = epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = r.permutation(len(x))
        for at in range(0, len(x), batch):
            some = order[at : at + batch]
            _, g = net.gradients(x[some], length[some], target[some])
            norm = np.sqrt(sum(float((w * w).sum()) for w in g.values()))
            t += 1
            for k, w in net.w.items():
                d = g[k] * f32(min(1.0, 1.0 / (norm + 1e-9)))
                m[k] = f32(0.9) * m[k] + f32(0.1) * d
                v[k] = f32(0.99) * v[k] + f32(0.01) * d * d
                w -= (f32(rate * (1 - (t - 1) / steps) / (1 - 0.9**t)) * m[k] / (np.sqrt(v[k] / f32(1 - 0.99**t)) + f32(1e-6))).astype(f32)
    return net


def trained(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """A network of the languages named in docs.lang, or None without any.

    For each language the whole texts of at most `sample` documents, those of
    the least hash of doc_id, are read. Rows with a null lang, null or empty
    text aren't used.
    """
    rows = docs.select("doc_id", "text", "lang").where("lang is not null and text <> ''")
    ids = least_hashed(rows, "lang", sample)
    found = rows.join(F.broadcast(ids), ["doc_id", "lang"]).collect()
    found.sort(key=lambda r: (r.lang, r.doc_id, r.text))
    return fit([r.text for r in found], [r.lang for r in found]) if found else None


def _labelled(net):
    def run(it):
        names = net.value.languages
        for batch in it:
            for part in tb.chunks(batch, "text"):
                data, offsets = tb.text_bytes(part.column("text"))
                share, count = net.value.pooled(data, offsets)
                none = np.diff(offsets) == 0
                n = int((~none).sum())
                ends = np.r_[0, np.cumsum(~none)] * len(names)
                at = pa.array(np.append(np.where(none, None, ends[:-1]), ends[-1]).tolist(), pa.int32())
                keys = pa.array(names * n)
                best = share.argmax(1)
                lang = [None if e else names[b] for e, b in zip(none, best, strict=True)]
                maps = [pa.MapArray.from_arrays(at, keys, v) for v in (pa.array(share[~none].reshape(-1)), pa.array(count[~none].reshape(-1)))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(share.max(1), pa.float64(), mask=none), *maps], ["doc_id", "lang", "p_lang", "p", "labelled_bytes"])

    return run


def identified(docs: DataFrame, net: Network | None = None, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, lang, p_lang, p, labelled_bytes) of every row.

    p maps each language to the document's probability, labelled_bytes to the
    number of bytes labelled so; lang is the likeliest, the first by name at a
    tie. Null and empty texts have nulls throughout. Without any lang to train
    on all rows have nulls. Repeated rows are each labelled, a null doc_id
    stays null, other columns are ignored.
    """
    net = net or trained(docs, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, lang string, p_lang double, p map<string,double>, labelled_bytes map<string,long>"
    if net is None:
        return rows.select("doc_id", *[F.lit(None).cast(t).alias(n) for n, t in (("lang", "string"), ("p_lang", "double"), ("p", "map<string,double>"), ("labelled_bytes", "map<string,long>"))])
    return rows.mapInArrow(_labelled(docs.sparkSession.sparkContext.broadcast(net)), schema)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    return identified(spark.read.parquet(f"{sf_dir}/documents.parquet"))
