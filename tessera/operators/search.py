"""Retrieval: text search by BM25, vectors by exact or bucketed distance, fusion, weights and hydration.

Ranking works on ids and numbers; texts are read again only for the rows that
are shown. Chunks have (id, source_table, source_id, title, content,
date_sent, is_bulk, kind); scores are (id, score).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.types import Text
from tessera.functions.text import query_parts, snippet, tokens
from tessera.functions.values import in_range, l2
from tessera.operators.shared import kept

RRF_K, K1, B = 60, 1.2, 0.75


def ranked(scores: DataFrame, *order: Column) -> DataFrame:
    """rank from 1 by the order, over rows already cut to a few."""
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rrf_fuse(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """(id, score): the sum of 1 / (k + rank) over the lists (id, rank), best first, ties by id."""
    rows = lists[0].select("id", "rank")
    for more in lists[1:]:
        rows = rows.union(more.select("id", "rank"))
    return rows.groupBy("id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score")).orderBy(F.desc("score"), "id")


def postings(chunks: DataFrame) -> DataFrame:
    """(term, id, tf, dl): the inverted index; dl is the number of terms of the chunk."""
    rows = chunks.select("id", tokens(F.col("content")).alias("t")).where(F.size("t") > 0)
    return rows.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def _bm25(tf: Column, dl: Column, df: Column, n: Column, mean: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def _matched(chunks: DataFrame, query: str) -> tuple[DataFrame, list[str]]:
    """Chunks that hold any part of the query, with dl and the number of occurrences of each part as n0, n1, ..."""
    phrases, terms = query_parts(query)
    parts = [" ".join(p.lower().split()) for p in phrases] + [t.lower() for t in terms]
    rows = chunks.select("id", "date_sent", tokens(F.col("content")).alias("t"))
    flat = F.concat(F.lit(" "), F.array_join("t", " "), F.lit(" "))

    def times(part: str) -> Column:
        if " " in part:
            return F.size(F.split(F.replace(flat, F.lit(f" {part} "), F.lit(f" \u0001{part} ")), "\u0001")) - 1
        return F.size(F.filter("t", lambda x: x == F.lit(part)))

    counts = {f"n{i}": times(p) for i, p in enumerate(parts)}
    return rows.select("id", "date_sent", F.size("t").alias("dl"), *[c.cast("long").alias(n) for n, c in counts.items()]), list(counts)


def _statistics(rows: DataFrame, parts: list[str], hits: list[Column]) -> DataFrame:
    """One row: n and mean of the chunks with terms, df of each part, and how many rows meet each of hits."""
    return rows.agg(F.count_if(F.col("dl") > 0).alias("n"), F.avg(F.when(F.col("dl") > 0, F.col("dl"))).alias("mean"), *[F.count_if(F.col(p) > 0).alias(f"df_{p}") for p in parts], *[F.count_if(h).alias(f"hits_{i}") for i, h in enumerate(hits)])


def _hit(parts: list[str], op: str, since: Text, until: Text) -> Column:
    test = [F.col(p) > 0 for p in parts]
    hit = test[0]
    for t in test[1:]:
        hit = (hit & t) if op == "AND" else (hit | t)
    return hit & in_range(F.col("date_sent"), since, until) if since or until else hit


def _best(rows: DataFrame, parts: list[str], stats: DataFrame, hit: Column, k: int) -> DataFrame:
    found = rows.where(hit).crossJoin(F.broadcast(stats))
    score = sum((_bm25(F.col(p), F.col("dl"), F.col(f"df_{p}"), F.col("n"), F.col("mean")) for p in parts), F.lit(0.0))
    return found.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def bm25_search(chunks: DataFrame, query: str, k: int, op: str = "AND", since: Text = None, until: Text = None) -> DataFrame:
    """(id, score): the k best of the chunks that hold all (or, with OR, any) parts of the query.

    One scan counts the parts in every chunk; one aggregate of it gives the
    frequencies. No index and no shuffle of texts; for many queries of one
    corpus use postings(). A query without parts gives no rows.
    """
    rows, parts = _matched(chunks, query)
    if not parts:
        return rows.select("id", F.lit(0.0).alias("score")).limit(0)
    return _best(rows, parts, _statistics(rows, parts, []), _hit(parts, op, since, until), k)


def lengths(chunks: DataFrame) -> DataFrame:
    """(id, dl): terms of each chunk that has any."""
    return chunks.select("id", F.size(tokens(F.col("content"))).alias("dl")).where("dl > 0")


def bm25_postings(index: DataFrame, lengths: DataFrame, terms: list[str], k: int) -> DataFrame:
    """(id, score): the k best chunks for any of the terms, from an index and the table of lengths."""
    whole = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))
    mine = index.where(F.col("term").isin(*[t.lower() for t in terms]))
    df = mine.groupBy("term").agg(F.count("*").alias("df"))
    scored = mine.join(F.broadcast(df), "term").crossJoin(F.broadcast(whole))  # one row a term of the query, and one row
    return scored.groupBy("id").agg(F.round(F.sum(_bm25(F.col("tf"), F.col("dl"), F.col("df"), F.col("n"), F.col("mean"))), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def text_search(chunks: DataFrame, query: str, k: int, since: Text = None, until: Text = None) -> tuple[DataFrame, str]:
    """(id, score, rank), and a label: all parts first; any part if those are fewer than max(5, k // 4).

    Texts are read once: the counts of the parts are written down, and the
    statistics, both numbers of hits and the ranking come from these.
    """
    rows, parts = _matched(chunks, query)
    if not parts:
        return ranked(bm25_search(chunks, query, k), F.desc("score"), F.col("id")), "AND (0 hits)"
    rows = kept(rows, "search")
    both = {op: _hit(parts, op, since, until) for op in ("AND", "OR")}
    stats = kept(_statistics(rows, parts, list(both.values())), "search")
    hits = dict(zip(both, stats.select("hits_0", "hits_1").first(), strict=True))
    op = "AND" if min(hits["AND"], k) >= max(5, k // 4) else "OR"
    return ranked(_best(rows, parts, stats, both[op], k), F.desc("score"), F.col("id")), f"{op} ({min(hits[op], k)} hits)"


def knn(vectors: DataFrame, query: DataFrame, k: int, within: DataFrame | None = None) -> DataFrame:
    """(id, distance, rank): the k nearest of vectors(id, embedding) to the one row of query(embedding), by exact distance.

    within: ids to choose from, applied before the cut, so that k remain.
    """
    rows = vectors if within is None else vectors.join(within.select("id").distinct(), "id", "left_semi")
    seed = query.select(F.col("embedding").alias("_q")).limit(1)
    near = rows.crossJoin(F.broadcast(seed)).select("id", F.round(l2(F.col("embedding"), F.col("_q")), 6).alias("distance"))
    return ranked(near.orderBy("distance", "id").limit(k), F.col("distance"), F.col("id"))


def nearest_neighbors(vectors: DataFrame, seed_id: int, k: int = 10) -> DataFrame:
    """The k nearest others of a stored vector."""
    seed = vectors.where(F.col("id") == seed_id).select("embedding")
    return knn(vectors.where(F.col("id") != seed_id), seed, k)


def knn_bucketed(vectors: DataFrame, query: list[float], k: int, width: float = 2.0, tables: int = 6) -> DataFrame:
    """(id, distance, rank) by random-projection buckets, re-ranked by exact distance. Approximate."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rows = vectors.select("id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=width, numHashTables=tables, seed=1).fit(rows)
    near = model.approxNearestNeighbors(rows, Vectors.dense(query), k, distCol="distance").select("id", F.round("distance", 6).alias("distance"))
    return ranked(near, F.col("distance"), F.col("id"))


def year_counts(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.length("date_sent") >= 4).groupBy(F.substring("date_sent", 1, 4).alias("year")).agg(F.count("*").alias("n"))


def year_weights(counts: DataFrame) -> DataFrame:
    """(year, n, weight): mean / n, at most 1 and at least a half."""
    mean = counts.agg(F.avg("n").alias("mean"))
    return counts.crossJoin(F.broadcast(mean)).select("year", "n", F.least(F.lit(1.0), F.col("mean") / F.least(F.col("n").cast("double"), 2 * F.col("mean"))).alias("weight"))


def hydrate(scored: DataFrame, chunks: DataFrame, snippet_chars: int = 240) -> DataFrame:
    """scored with what is shown of each chunk; ids that there are no chunks of go."""
    shown = chunks.select("id", "source_table", "source_id", "title", snippet(F.col("content"), snippet_chars).alias("snippet"), F.substring("date_sent", 1, 10).alias("date"), "is_bulk", "kind")
    return shown.join(F.broadcast(scored), "id")


def hydrated(scored: DataFrame, chunks: DataFrame, parents: DataFrame, snippet_chars: int = 240) -> DataFrame:
    """scored(id, score) with what is shown of each chunk and of its parent, by comm.parents(); a chunk without a parent row is shown with nulls, an id without a chunk goes.

    The few ids shown pick their chunks first, and these their parents, so
    neither large table is shuffled.
    """
    cols = ["id", "source_table", "source_id", "title", "content"]
    mine = chunks.select(*cols).join(F.broadcast(scored), "id")
    wanted = parents.join(F.broadcast(mine.select("source_table", "source_id").distinct()), ["source_table", "source_id"], "left_semi")
    rows = mine.join(F.broadcast(wanted), ["source_table", "source_id"], "left")
    return rows.select("id", "source_table", "source_id", "score", F.coalesce("subject", "title").alias("subject"), "sender_address", "sender_name", F.substring("date_sent", 1, 10).alias("date"), "direction", "thread_id", "is_bulk", "kind", snippet(F.col("content"), snippet_chars).alias("snippet"))


def search(chunks: DataFrame, query: str, vectors: DataFrame | None = None, query_vector: DataFrame | None = None, scores: DataFrame | None = None, mode: str = "hybrid", k: int = 10, snippet_chars: int = 240, since: Text = None, until: Text = None, year_normalize: bool = False, include_meta: bool = False, include_bulk: bool = False, per_source_k: int = 50) -> DataFrame:
    """Hybrid retrieval: both legs, fused, cut to 2k, weighted, shown, filtered, cut to k.

    The filters for bulk and kind come after the first cut, so fewer than k
    rows can be left. Without a query vector 'hybrid' is text search alone and
    'semantic' an error.
    """
    wide = max(5 * k, per_source_k)
    legs = []
    if mode in ("hybrid", "semantic"):
        if vectors is not None and query_vector is not None:
            dated = chunks.where(in_range(F.col("date_sent"), since, until)) if since or until else None
            legs.append(knn(vectors, query_vector, wide, dated))
        elif mode == "semantic":
            raise ValueError("semantic search needs vectors and a query vector")
    if mode in ("hybrid", "fts"):
        legs.append(text_search(chunks, query, wide, since, until)[0])
    best = rrf_fuse(*legs).limit(2 * k)
    if year_normalize:
        years = chunks.select("id", F.substring("date_sent", 1, 4).alias("year")).join(F.broadcast(best), "id")
        best = years.join(F.broadcast(year_weights(year_counts(chunks))), "year", "left").select("id", (F.col("score") * F.coalesce("weight", F.lit(1.0))).alias("score"))
    if scores is not None:
        best = best.join(scores.select("id", F.col("score").alias("decay_score")), "id", "left").select("id", (F.col("score") * F.coalesce("decay_score", F.lit(1.0))).alias("score"), F.coalesce("decay_score", F.lit(1.0)).alias("decay_score"))
    else:
        best = best.withColumn("decay_score", F.lit(1.0))
    rows = hydrate(best, chunks, snippet_chars)
    if not include_bulk:
        rows = rows.where("coalesce(is_bulk, 0) = 0")
    if not include_meta:
        rows = rows.where("kind is null or kind = 'message'")
    return rows.withColumns({"score": F.bround("score", 5), "decay_score": F.bround("decay_score", 4)}).orderBy(F.desc("score"), "id").limit(k)
