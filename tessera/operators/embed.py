"""Chunks and their vectors: what is pending, cut, embedded and stored."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import chunked, give_back, tag_list

LEAST = 50


def eligible(rows: DataFrame) -> DataFrame:
    """Rows worth embedding: not bulk, at least fifty characters."""
    return rows.where((F.coalesce("is_bulk", F.lit(0)) == 0) & (F.length("body_text") >= LEAST))


def pending(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Eligible rows (source_table, id) of which there are no chunks."""
    return eligible(rows).join(chunks.select("source_table", F.col("source_id").alias("id")).distinct(), ["source_table", "id"], "left_anti")


def limited(tables: list[DataFrame], limit: int) -> DataFrame:
    """The first rows of the tables, in order of table, then id: one limit for all."""
    out = None
    for i, t in enumerate(tables):
        one = t.withColumn("_t", F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.orderBy("_t", "id").limit(limit).drop("_t")


def web_page_texts(pages: DataFrame, bookmarks: DataFrame, chunks: DataFrame, least: int = LEAST) -> DataFrame:
    """(source_table, id, subject, body_text, domain, last_seen): the text of web pages to embed, with what their bookmarks add.

    pages(id, title, excerpt, domain, last_seen); bookmarks(web_page_id, id,
    note, highlights, tags as JSON, excluded). Notes, highlights and tags of a
    page's bookmarks, in order of id, follow title and excerpt. Pages with
    chunks, and those with too little text, are left out.
    """
    told = bookmarks.where("not coalesce(excluded, false) and (note is not null or highlights is not null or coalesce(tags, '[]') <> '[]')")
    joined = lambda c, mark: F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("id", c.alias("v"))))), lambda x: x["v"]), mark), F.lit(""))
    added = told.groupBy(F.col("web_page_id").alias("id")).agg(joined(F.col("note"), "\n").alias("notes"), joined(F.col("highlights"), "\n").alias("highlights"), joined(tag_list(F.col("tags")), ", ").alias("tag_list"))
    rows = pages.join(added, "id", "left")
    none = lambda c: F.coalesce(c, F.lit(""))
    body = F.concat(none("title"), F.lit("\n"), none("excerpt"), *[none(F.concat(F.lit("\n"), F.col(c))) for c in ("notes", "highlights", "tag_list")])
    rows = rows.where(F.length(F.concat(none("title"), none("excerpt"), none("notes"))) >= least)
    rows = rows.join(chunks.where("source_table = 'web_pages'").select(F.col("source_id").alias("id")).distinct(), "id", "left_anti")
    return rows.select(F.lit("web_pages").alias("source_table"), "id", F.col("title").alias("subject"), body.alias("body_text"), "domain", "last_seen")


def cut(rows: DataFrame) -> DataFrame:
    """(source_table, source_id, chunk_index, title, content, content_hash) of rows; ids follow from the first three."""
    out = rows.select("source_table", F.col("id").alias("source_id"), F.col("subject").alias("title"), F.posexplode(chunked(F.col("body_text"))).alias("chunk_index", "content"))
    return out.select(F.xxhash64("source_table", "source_id", "chunk_index").alias("id"), "source_table", "source_id", "chunk_index", "title", "content", F.sha2("content", 256).alias("content_hash"))


Provider = Callable[[list[str]], np.ndarray]


def hashing_provider(size: int = 64) -> Provider:
    """A deterministic stand-in for a model: signed counts of hashed words, at unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), size), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % size] += 1 if h & 0x80000000 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return embed


def query_vector(spark, provider: Provider, query: str) -> DataFrame:
    """(embedding): the one row that search.knn asks with; queries have a prefix of their own."""
    return spark.createDataFrame([([float(x) for x in provider([f"search_query: {query}"])[0]],)], "embedding array<float>")


def embedded(chunks: DataFrame, provider: Provider, batch: int = 32, retries: int = 5, backoff: float = 0.0) -> DataFrame:
    """(id, embedding, error) of chunks, in batches. A batch that keeps failing is tried text by text; a text that fails then has no embedding and what was raised. Between attempts it waits backoff seconds, twice as long each time. Python holds a batch of texts and vectors at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tried(texts: list[str], times: int) -> tuple[np.ndarray | None, str | None]:
            said = None
            for k in range(times):
                try:
                    return np.asarray(provider(texts)), None
                except Exception as e:  # noqa: BLE001 - whatever the provider raises is a failed attempt
                    said = repr(e)[:500]
                    time.sleep(backoff * 2**k)
            return None, said

        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                some = rows.slice(at, batch)
                texts = [f"search_document: {t}" for t in some.column("content").to_pylist()]
                got, _ = tried(texts, retries)
                each = [(v, None) for v in got] if got is not None else [(r[0], None) if (r := (x := tried([t], 1))[0]) is not None else (None, x[1]) for t in texts]
                vectors = pa.array([None if v is None else np.asarray(v, np.float32) for v, _ in each], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([some.column("id"), vectors, pa.array([e for _, e in each], pa.string())], ["id", "embedding", "error"])
        give_back()

    return chunks.select(F.col("id").cast("long").alias("id"), "content").mapInArrow(run, "id long, embedding array<float>, error string")


def status(rows: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(source_table, eligible, done, chunks, embedded) by table; done counts rows of that table that have chunks."""
    want = eligible(rows).groupBy("source_table").agg(F.count("*").alias("eligible"))
    vectors = vectors.where("embedding is not null") if "embedding" in vectors.columns else vectors
    have = chunks.join(vectors.select("id", F.lit(1).alias("_v")), "id", "left").groupBy("source_table").agg(F.countDistinct("source_id").alias("done"), F.count("*").alias("chunks"), F.count("_v").alias("embedded"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return want.join(have, "source_table", "full").select("source_table", *[zero(c) for c in ("eligible", "done", "chunks", "embedded")])
