"""Idempotent loading: first one wins, or later values fill in, by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def new_rows(incoming: DataFrame, stored: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Incoming rows of keys that aren't stored, each key once."""
    return first_wins(incoming, keys, order).join(stored.select(*keys), keys, "left_anti")


def last_known(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: of every column the last value that isn't null, in order.

    max_by over (order, value) aggregates before the shuffle, which a window couldn't.
    """
    others = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in others])


def web_pages(sightings: DataFrame) -> DataFrame:
    """Pages of sightings(normalized_url, url, title, excerpt, seen, seq): last text that isn't empty, first and last time seen."""
    filled = lambda c: F.max_by(F.nullif(c, F.lit("")), F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.col("seq"))).alias(c)
    return sightings.groupBy("normalized_url").agg(F.min_by("url", "seq").alias("url"), filled("title"), filled("excerpt"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))


def bookmarks(sightings: DataFrame) -> DataFrame:
    """One row for each page and instrument: appearances, repeats included, and the time span."""
    return sightings.groupBy("normalized_url", "instrument").agg(F.count("*").alias("appearance_count"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))


def connections(appearances: DataFrame) -> DataFrame:
    """Connections of appearances(key, name, friends_since, export): the newest export's name, earliest date, list of exports."""
    return appearances.groupBy("key").agg(F.max_by("name", "export").alias("name"), F.min("friends_since").alias("friends_since"), F.max("export").alias("last_export"), F.array_sort(F.collect_set("export")).alias("exports"))


def with_inactive(connections: DataFrame, current: str) -> DataFrame:
    """status: 'active' if the current export has the connection, else 'inferred_inactive'."""
    return connections.withColumn("status", F.when(F.col("last_export") == current, "active").otherwise("inferred_inactive"))


def row_loss(previous: DataFrame, now: DataFrame, most: float = 0.01) -> DataFrame:
    """Tables of (name, n) that lost more than a share of their rows."""
    rows = previous.withColumnRenamed("n", "before").join(now.withColumnRenamed("n", "after"), "name", "left").withColumn("after", F.coalesce("after", F.lit(0)))
    return rows.where((F.col("before") > 0) & ((F.col("before") - F.col("after")) / F.col("before") > most))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): the rows of each table, to be kept beside a snapshot and compared by row_loss() with those of a later one."""
    out = None
    for name, t in sorted(tables.items()):
        one = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


def watermarks(rows: DataFrame, key: str, by: str) -> DataFrame:
    """(key, watermark): how far each source has been read."""
    return rows.groupBy(key).agg(F.max(by).alias("watermark"))


def after_watermark(rows: DataFrame, marks: DataFrame, key: str, by: str) -> DataFrame:
    """Rows beyond the watermark of their source, and all rows of sources without one."""
    joined = rows.join(marks.select(key, "watermark"), key, "left")
    return joined.where(F.col("watermark").isNull() | (F.col(by) > F.col("watermark"))).select(*rows.columns)


def source_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """(id, source_path, content_hash, source_kind) of files(source_path, content_hash, source_kind): known ones keep their id; a file that changed has a new one."""
    rows = files.select("source_path", "content_hash", "source_kind").dropDuplicates(["source_path", "content_hash"])
    fresh = rows.join(known, ["source_path", "content_hash"], "left_anti").withColumn("id", F.xxhash64("source_path", "content_hash"))
    return known.select("id", "source_path", "content_hash", "source_kind").unionByName(fresh)
