"""The models and the whole pipeline against slow versions in plain Python, and their accuracy on held-out rows of the test tables."""

import math
import re
from collections import Counter

import corpus_pipeline as cp
import numpy as np
import pyarrow as pa
from tessera.llm import decontaminate as dc
from tessera.llm import language_id as li
from tessera.llm import passages as ps
from tessera.llm import quality_gam as qg
from tessera.llm import quality_rules as qr
from tessera.llm import textbytes as tb
from tessera.llm.shared import table

from test_documents import plain_dedup, plain_ffd, plain_passages
from test_ngram_join import all_classes

SF, MASK = "/root/testdata/sf0.001", 2**64 - 1


def plain_mix(h):
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & MASK
    return h ^ (h >> 31)


def plain_word(raw):
    total, power = len(raw), 1
    for b in raw:
        power = power * int(tb.STEP) & MASK
        total = (total + int(tb.BYTE_CODE[b]) * power) & MASK
    return plain_mix(total)


def plain_quality(model, text):
    """Probability by dictionaries of counted n-grams."""
    raw = text.encode()
    shift = 64 - qr.BITS
    runs = Counter((((raw[i] << 16) | (raw[i + 1] << 8) | raw[i + 2]) * 2654435761 & 0xFFFFFFFF) >> (32 - qr.BITS) for i in range(len(raw) - 2))
    words = [plain_word(w) for w in re.findall(rb"[0-9a-z_\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), raw))]
    pairs = Counter(plain_mix((a * int(tb.GRAM_CODE[0]) + b * int(tb.GRAM_CODE[1])) & MASK) >> shift for a, b in zip(words, words[1:], strict=False))
    score = model.bias
    for weights, found in zip(model.weights, (runs, Counter(w >> shift for w in words), pairs), strict=True):
        score += sum(float(weights[k]) * n for k, n in found.items()) / max(1, sum(found.values()))
    return 1 / (1 + math.exp(-max(-30, min(30, model.slope * score + model.shift))))


def test_quality_is_the_plain_one_and_holds_out(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    model = qr.trained(docs, labels.where("doc_id % 2 = 0"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = [(r.doc_id, r.quality) for r in labels.collect() if r.doc_id % 2]
    got = {r.doc_id: r for r in qr.scored(docs, labels.where("doc_id % 2 = 0")).collect()}
    assert np.mean([(got[i].p_good >= 0.5) == bool(q) for i, q in held]) > 0.9
    for i in sorted(texts, key=lambda i: (len(texts[i] or ""), i))[::25]:
        if texts[i]:
            want = plain_quality(model, texts[i])
            assert abs(got[i].p_good - want) < 1e-4, i
            assert got[i].verdict == ("reject" if want < qr.REJECT else "accept" if want >= qr.ACCEPT else "borderline") or min(abs(want - qr.REJECT), abs(want - qr.ACCEPT)) < 1e-4
    gam = {r.doc_id: r.keep for r in qg.classified(docs, labels.where("doc_id % 2 = 0")).collect()}
    assert np.mean([gam[i] == bool(q) for i, q in held]) > 0.85


def plain_pooled(net, text):
    """Mean probabilities over the bytes of a text, a cell at a time."""
    sig = lambda x: 1 / (1 + math.exp(-x))
    raw, k = text.encode(), net.hidden
    total = np.zeros(len(net.languages))
    for at in range(0, len(raw), li.SEGMENT):
        part = raw[at : at + li.SEGMENT]
        logits = [[float(x) for x in net.w["c"]] for _ in part]
        for d, order in (("f", range(len(part))), ("b", range(len(part) - 1, -1, -1))):
            x, u, v = (net.w[f"{n}{d}"].astype(float) for n in "xuv")
            h = [0.0] * k
            for t in order:
                inner = [sum(h[i] * u[i][j] for i in range(k)) for j in range(3 * k)]
                z = [sig(x[part[t]][j] + inner[j]) for j in range(k)]
                r = [sig(x[part[t]][k + j] + inner[k + j]) for j in range(k)]
                n = [math.tanh(x[part[t]][2 * k + j] + r[j] * inner[2 * k + j]) for j in range(k)]
                h = [n[j] + z[j] * (h[j] - n[j]) for j in range(k)]
                for q in range(len(logits[t])):
                    logits[t][q] += sum(h[j] * v[j][q] for j in range(k))
        for row in logits:
            e = [math.exp(x - max(row)) for x in row]
            total += np.array(e) / sum(e)
    return total / len(raw)


def test_languages_are_the_plain_ones_and_hold_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    net = li.trained(docs.where("doc_id % 2 = 0"), 60)
    rows = [r for r in docs.where("doc_id % 2 = 1").collect() if r.text and r.lang]
    got = {r.doc_id: r.lang for r in li.identified(docs.where("doc_id % 2 = 1"), net).collect()}
    assert np.mean([got[r.doc_id] == r.lang for r in rows]) > 0.95
    for text in (*(r.text[:200] for r in rows[:3]), "é", "a" * 129):
        share, _ = net.pooled(*tb.text_bytes(pa.array([text])))
        assert np.allclose(share[0], plain_pooled(net, text), atol=1e-4)


def plain_pipeline(docs, model, items):
    """Bins of (doc_id, word at which a piece begins, its words), by the rules of the stages one after another, on lists."""
    docs = [(i, t) for i, t in docs if t and plain_quality(model, t) >= qr.REJECT]
    cut = plain_dedup(docs)
    docs = [(i, cut[i, t]) for i, t in docs if cut[i, t] == t or re.search(r"[^ \n]", cut[i, t])]
    gone = {i for i, c, _ in all_classes(docs, 4, 2 / 5) if i != c}
    docs = [(i, t) for i, t in docs if i not in gone]
    left = plain_passages(docs)
    word = re.compile(ps.A_WORD.replace(r"\x{80}-\x{10FFFF}", "\u0080-\U0010ffff") + "+")
    sizes = {}
    for i, t in docs:
        kept = left[i, t]
        if kept != word.findall(t) and not kept:
            continue
        plain = dc.normal(" ".join(kept) if kept != word.findall(t) else t)
        if not any(dc.best_distance(x, plain) <= len(x) // 16 for x in items):
            sizes[i] = len(kept)
    pieces = sorted(((min(2048, n - s), i, s) for i, n in sizes.items() for s in range(0, n, 2048)), key=lambda p: (-p[0], p[1], p[2]))
    bins = {}
    for k, (n, i, s) in zip(plain_ffd([n for n, *_ in pieces], 2048), pieces, strict=True):
        bins.setdefault(k, []).append((i, s, n))
    return sorted(bins.values())


def test_pipeline_is_the_plain_one(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    model = qr.trained(table(spark, SF, "documents"), table(spark, SF, "labels"))
    items = [x for r in table(spark, SF, "benchmark").collect() if r.text and (x := dc.normal(r.text))]
    got = sorted(list(zip(b.doc_ids, b.starts, b.sizes, strict=True)) for b in cp.run(spark, SF).collect())
    assert got == plain_pipeline(docs, model, items)


def test_pipeline_odd_rows(spark):
    """Null and repeated ids, long texts and missing labels go through all stages."""
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(None, "a null id and a text of its own"), (None, None), (1, None), (2, ""), (3, long), (4, "twice the same words in one text"), (4, "twice the same words in one text"), (5, "éü"), (None, "some copy of words that are here"), (6, "some copy of words that are here")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, part int")
    empty = {"labels": table(spark, SF, "labels").limit(0), "benchmark": table(spark, SF, "benchmark")}
    before = cp.table
    cp.table = lambda s, d, name: empty[name]
    try:
        for _, stage in cp.STAGES[:-1]:
            docs = stage(spark, docs, SF).cache()
    finally:
        cp.table = before
    got = sorted((str(r.doc_id), len(r.text or "")) for r in docs.collect())
    assert got == sorted([("None", 31), ("None", 0), ("1", 0), ("2", 0), ("3", len(long)), ("4", 32), ("5", 2), ("6", 32)])
    packed = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(Counter(str(i) for b in packed for i in b.doc_ids).items()) == [("3", 30), ("4", 1), ("5", 1), ("6", 1), ("None", 1)]
