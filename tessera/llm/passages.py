"""Removal of repeated passages, wherever they begin and end in a line, by windows of fifty words.

Each window of 50 words holds 31 runs of 20 words; the run of least hash is its
fingerprint, so that equal windows have equal fingerprints, and neighbouring
windows mostly share one (winnowing: about one in sixteen words begins a
fingerprint). Only windows whose fingerprint occurs again are written out and
compared as a whole, by two 64-bit hashes. No repeated window is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textbytes as tb
from tessera.llm.shared import fresh, row_key, written

WIDTH, RUN = 50, 20
RUNS = WIDTH - RUN + 1
#: Numbers in a table, of 8 bytes each, up to which it is sent to all tasks by way of the driver, where a row takes as much as ROW_ITEMS; a larger one is joined by a shuffle.
BROADCAST_ITEMS, ROW_ITEMS = 2_000_000, 19
A_WORD = r"[0-9A-Za-z_\x{80}-\x{10FFFF}]"


def _hashes(h: np.ndarray, n: int, code: np.ndarray) -> np.ndarray:
    """Hash of each run of n words, over the ends of texts as well."""
    values = np.zeros(max(0, len(h) - n + 1), tb.U64)
    for i in range(n):
        values += h[i : i + len(values)] * code[i]
    return tb.mix(values)


def _sliding(a: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """best of each n neighbours."""
    w = 1
    while 2 * w <= n:
        a, w = best(a[:-w], a[w:]), 2 * w
    return best(a[: len(a) - (n - w)], a[n - w :]) if w < n else a


def _runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, their texts, hashes of the runs, whether a window that is within a text begins at a word); all empty if there is no window."""
    data, offsets = tb.text_bytes(column)
    begin, end, text = tb.words(data, offsets)
    if len(begin) < WIDTH:
        return np.zeros(0, tb.U64), text[:0], np.zeros(0, tb.U64), np.zeros(0, bool)
    h = tb.span_hashes(data, begin, end)
    return h, text, _hashes(h, RUN, tb.GRAM_CODE), text[: len(text) - WIDTH + 1] == text[WIDTH - 1 :]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tb.chunks(batch, "text"):
            _, text, runs, within = _runs(part.column("text"))
            if not within.any():
                continue
            least = np.where(within, _sliding(runs, RUNS, np.minimum), tb.U64(0))
            edge = np.zeros(RUNS - 1, tb.U64)
            at = np.flatnonzero(_sliding(np.r_[edge, least, edge], RUNS, np.maximum) == runs)
            found = pd.DataFrame({"h": runs[at].view(np.int64), "row": part.column("row").to_numpy()[text[at]]}).value_counts()
            yield pa.RecordBatch.from_arrays([pa.array(found.index.get_level_values(k)) for k in ("h", "row")] + [pa.array(found.to_numpy(), pa.int64())], ["h", "row", "times"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tb.chunks(batch, "text"):
            h, text, runs, within = _runs(part.column("text"))
            if not within.any():
                continue
            again = np.isin(runs, np.unique(part.column("again").flatten().to_numpy()).view(tb.U64))
            at = np.flatnonzero(_sliding(again, RUNS, np.logical_or) & within)
            of = text[at]
            first = np.searchsorted(text, of, "left")
            hashes = [pa.array(_hashes(h, WIDTH, code)[at].view(np.int64)) for code in (tb.GRAM_CODE, tb.GRAM_CODE[::-1])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(of)), part.column("row").take(pa.array(of)), pa.array((at - first).astype(np.int32)), *hashes], ["doc_id", "row", "k", "h1", "h2"])


def cut(text: str, places) -> tuple[str, int]:
    """text without the windows that begin at the words numbered in places, and the number of words gone; a newline after a passage stays."""
    raw = text.encode()
    begin, end, _ = tb.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    step = np.zeros(len(begin) + 1, np.int64)
    np.add.at(step, np.asarray(places), 1)
    np.add.at(step, np.asarray(places) + WIDTH, -1)
    gone = np.r_[False, np.cumsum(step[:-1]) > 0, False]
    left, at = [], 0
    for a, b in zip(np.flatnonzero(gone[1:] & ~gone[:-1]), np.flatnonzero(gone[:-1] & ~gone[1:]), strict=True):
        left.append(raw[at : begin[a]])
        at = int(begin[b]) if b < len(begin) else len(raw)
        if b < len(begin) and b"\n" in raw[end[b - 1] : at]:
            left.append(b"\n")
    return b"".join([*left, raw[at:]]).decode(), int(gone.sum())


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("gone", T.LongType())]))
def _cut(text: pd.Series, places: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if t is None else cut(t, p) for t, p in zip(text, places, strict=True)], columns=["text", "gone"]).astype({"gone": "Int64"})


def _small(df: DataFrame, items: str) -> DataFrame:
    df = written(df, "passages")
    return F.broadcast(df) if (df.agg(F.sum(ROW_ITEMS + F.size(items))).first()[0] or 0) <= BROADCAST_ITEMS else df


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, row, places): the words of each row, by number, at which later occurrences of windows begin."""
    rows = docs.where("text is not null").select("doc_id", row_key("doc_id", "text").alias("row"), "text")
    prints = rows.select("row", "text").mapInArrow(tb.trimmed(_fingerprints), "h long, row long, times long")
    again = prints.groupBy("h").agg(F.sum("times").alias("times"), F.collect_set("row").alias("rows")).where("times > 1")
    again = again.select("h", F.explode("rows").alias("row")).groupBy("row").agg(F.collect_set("h").alias("again"))
    windows = rows.join(_small(again, "again"), "row").select("doc_id", "row", "text", "again")
    windows = written(windows.mapInArrow(tb.trimmed(_windows), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, k int, h1 long, h2 long"), "passage-windows")
    at = F.struct("doc_id", "row", "k")
    first = windows.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min(at).alias("first")).where("times > 1").select("h1", "h2", "first")
    later = windows.join(first, ["h1", "h2"]).where(~at.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "row").agg(F.collect_set("k").alias("places"))


def without_repeated_passages(docs: DataFrame, removed: str = "removed_words") -> DataFrame:
    """docs without what later occurrences of windows of 50 words cover, and beside their columns the number of words gone (bigint), of a name that docs doesn't have.

    Words are runs of letters, digits and underscores, compared as they are
    written; what is between them isn't compared, so a passage may begin and
    end anywhere and break its lines anywhere. Of the occurrences of a window,
    that of the least (doc_id, then row content, then position) stays, with a
    null doc_id before all others; from every other all 50 words go. Windows
    cover their words together. Rows that agree in doc_id and text are one
    document. A text of fewer than 50 words stays; so does a null text, with a
    null count. n_chars, where there is such a column, is that of the new text.
    """
    row, of, places, new = (fresh(docs.columns, x) for x in ("row", "row_of", "places", "new"))
    found = _small(repeated_windows(docs), "places").select(F.col("row").alias(of), F.struct("doc_id", "places").alias(places))
    joined = docs.withColumn(row, row_key("doc_id", "text")).join(found, (F.col(row) == F.col(of)) & F.col("doc_id").eqNullSafe(F.col(f"{places}.doc_id")), "left").withColumn(places, F.col(f"{places}.places"))
    touched = F.col(places).isNotNull()
    joined = joined.withColumn(new, _cut(F.when(touched, F.col("text")), F.col(places)))
    more = {removed: F.when(F.col("text").isNotNull(), F.coalesce(F.col(f"{new}.gone"), F.lit(0).cast("long"))), "text": F.when(touched, F.col(f"{new}.text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        more["n_chars"] = F.when(touched, F.length(F.col(f"{new}.text")).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return joined.withColumns(more).select(*docs.columns, removed)


def op7_passage_dedup(spark, sf_dir: str) -> DataFrame:
    return without_repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
