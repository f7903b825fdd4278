"""Benchmark decontamination by pigeonhole edit matching.

A test item that may differ in k places is split into k + 1 pieces: wherever
it occurs, at least one piece occurs unchanged. An Aho-Corasick automaton
finds the pieces of all items in one pass over a text, and Myers' bit-parallel
algorithm measures the item against the text around each hit.
"""

from __future__ import annotations

import math
from collections import defaultdict
from fractions import Fraction

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textbytes as tb

RATE = Fraction(1, 16)
#: Bytes of test items that one automaton holds. A larger benchmark takes several passes over the documents.
PASS_BYTES = 8_000_000

_PLAIN = np.where(tb.WORD, tb.LOWER, 32).astype(np.uint8)
_automata: dict[tuple, tuple] = {}


def normal(text: str) -> str:
    """Words in lower case with single spaces between and around them, one character for each byte; '' without words."""
    raw = _PLAIN[np.frombuffer(pc.utf8_lower(text).as_py().encode(), np.uint8)].tobytes().decode("latin-1").split(" ")
    kept = [w for w in raw if w]
    return f" {' '.join(kept)} " if kept else ""


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of errors + 1 pieces of nearly one length."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_distance(item: str, text: str) -> int:
    """The least edit distance between item and any substring of text (Myers 1999, on Python's long integers)."""
    m = len(item)
    if not m:
        return 0
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        where[c] |= 1 << i
    plus, minus, score, best = full, 0, m, m
    for c in text:
        eq = where.get(c, 0)
        x = eq | minus
        d = ((((eq & plus) + plus) ^ plus) | eq) & full
        d |= minus
        up = minus | (full & ~(d | plus))
        down = plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(x | up))
        minus = up & x
        best = min(best, score)
    return best


def _automaton(items: tuple[tuple[int, str], ...], rate: Fraction):
    key = (hash(items), len(items), rate)
    if key not in _automata:
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        budget = [math.floor(rate * len(t)) for _, t in items]
        for k, (_, t) in enumerate(items):
            for offset, piece in pieces(t, budget[k]):
                found[piece].append((k, offset))
        made = ahocorasick.Automaton()
        for piece, uses in found.items():
            made.add_word(piece, (len(piece), uses))
        made.make_automaton()
        _automata.clear()
        _automata[key] = made, budget
    return _automata[key]


def matches(data: np.ndarray, offsets: np.ndarray, items: tuple[tuple[int, str], ...], rate: Fraction) -> list[tuple[int, int, int]]:
    """(text, index of item, distance) of every item that a text holds within its budget. A text begins with two spaces and ends with one."""
    automaton, budget = _automaton(items, rate)
    if not len(automaton) or not len(data):
        return []
    data = _PLAIN[data]
    data[offsets[:-1]] = 10
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    data = data[keep]
    begins = np.flatnonzero(data == 10)
    ends = np.r_[begins[1:], len(data)]
    plain = data.tobytes().decode("latin-1")
    hits: dict[tuple[int, int], list[int]] = defaultdict(list)
    found = [(end - length + 1, uses) for end, (length, uses) in automaton.iter(plain)]
    texts = np.searchsorted(begins, np.array([at for at, _ in found], np.int64), "right") - 1
    for (at, uses), text in zip(found, texts.tolist(), strict=True):
        for k, offset in uses:
            hits[text, k].append(at - offset)
    out = []
    for (text, k), starts in hits.items():
        item, errors = items[k][1], budget[k]
        lo, hi = int(begins[text]) + 1, int(ends[text])
        best = errors + 1
        starts.sort()
        i = 0
        while i < len(starts) and best:
            j = i
            while j + 1 < len(starts) and starts[j + 1] - starts[j] <= 2 * errors + 1:
                j += 1
            a, b = max(lo, starts[i] - errors), min(hi, starts[j] + len(item) + errors)
            region = plain[a:b]
            best = 0 if item in region else min(best, best_distance(item, region))
            i = j + 1
        if best <= errors:
            out.append((text, k, best))
    return out


def _lower(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts in lower case, with the spaces that matches() wants around each."""
    return tb.text_bytes(pc.binary_join_element_wise(pa.scalar("  ", column.type), pc.utf8_lower(column.fill_null("")), pa.scalar(" ", column.type), pa.scalar("", column.type)))


def _searched(items, rate: Fraction):
    def run(it):
        for batch in it:
            for part in tb.chunks(batch, "text"):
                rows = matches(*_lower(part.column("text")), items.value, rate)
                ids = part.column("doc_id").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[t] for t, _, _ in rows], pa.int64()), pa.array([items.value[k][0] for _, k, _ in rows], pa.int64()), pa.array([d for _, _, d in rows], pa.int32()), pa.array([len(items.value[k][1]) for _, k, _ in rows], pa.int32())],
                    ["doc_id", "item_id", "distance", "item_bytes"],
                )

    return run


def _without(items, rate: Fraction):
    def run(it):
        for batch in it:
            for part in tb.chunks(batch, "text"):
                keep = np.ones(part.num_rows, bool)
                keep[[t for t, _, _ in matches(*_lower(part.column("text")), items.value, rate)]] = False
                yield part.filter(pa.array(keep))

    return run


def _passes(benchmark: DataFrame, pass_bytes: int):
    """The test items in normal form, broadcast in lots of about pass_bytes."""
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = asked.agg(F.coalesce(F.sum(F.octet_length("text") + 2), F.lit(0))).first()[0]
    passes = max(1, -(-int(total) // pass_bytes))
    for p in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(tuple(sorted((r.item_id, t) for r in rows if (t := normal(r.text)))))


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: Fraction | float = RATE, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, item_bytes): the test items that documents hold, with the least edit distance of each.

    Both sides are compared as lowercase words with single spaces between
    them; an item of L bytes, its outer spaces counted, may have floor(rate * L)
    edits and lies between word ends. All occurrences within the budget are
    found, in whole texts. The automaton is sent to all tasks, so its size is
    checked: items of more than pass_bytes in all are split by a hash over
    several passes. Nulls and texts without words match nothing, nor does a
    row with a null doc_id or item_id. Rows of one doc_id and item_id are one,
    with the least distance; equal items are each reported. Very long texts are
    searched whole; an empty table on either side gives no rows.
    """
    rate = Fraction(rate).limit_denominator(1000)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    found = None
    for items in _passes(benchmark, pass_bytes):
        one = texts.mapInArrow(tb.trimmed(_searched(items, rate)), "doc_id long, item_id long, distance int, item_bytes int")
        found = one if found is None else found.union(one)
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.max("item_bytes").alias("item_bytes"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: Fraction | float = RATE, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """docs without the rows whose text holds a test item; rows with a null text stay, a null doc_id doesn't matter.

    Texts, of any length, are searched and passed on in one scan, without a
    join. All columns are kept; an empty table stays empty.
    """
    rate = Fraction(rate).limit_denominator(1000)
    for items in _passes(benchmark, pass_bytes):
        docs = docs.mapInArrow(tb.trimmed(_without(items, rate)), docs.schema)
    return docs


def op4_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
