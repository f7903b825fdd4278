"""How densely years and domains of life are covered by records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _find(mapping: Mapping[str, str], key: Column) -> Column:
    if not mapping:
        return F.lit(None).cast("string")
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), F.coalesce(key, F.lit("")))


def classified(source_kind: Column, schema_type: Column, sender_domain: Column, rules: Mapping[str, Mapping[str, str]]) -> Column:
    """Domain by source kind, else by schema type (for an email the sender's domain goes before it), else by the sender's domain, else 'unclassified'."""
    by_kind, by_type = _find(rules.get("source_kind", {}), source_kind), _find(rules.get("schema_type", {}), schema_type)
    by_sender = _find(rules.get("sender_domain", {}), F.lower(F.trim(sender_domain)))
    return F.coalesce(by_kind, F.when((schema_type == "EmailMessage") & by_type.isNotNull(), F.coalesce(by_sender, by_type)), by_type, by_sender, F.lit("unclassified"))


def matrix(records: DataFrame, domains: list[str]) -> DataFrame:
    """(year, domain, n, scale_group, sparsity) for every year that occurs and every domain; years outside 1980 to 2030 don't count.

    sparsity is 1 - n / the most of the domain, to four places; 1 where the domain has nothing.
    """
    spark = records.sparkSession
    n = records.where(F.col("year").between(1980, 2030)).groupBy("year", "domain").agg(F.count("*").alias("n"))
    every = n.select("year").distinct().crossJoin(F.broadcast(spark.createDataFrame([(d,) for d in domains], "domain string")))
    cells = every.join(n, ["year", "domain"], "left").select("year", "domain", F.coalesce("n", F.lit(0)).alias("n"))
    most = F.max("n").over(Window.partitionBy("domain"))
    return cells.withColumns({"scale_group": F.when(F.col("domain") == "health", "health").otherwise("main"), "sparsity": F.when(most == 0, 1.0).otherwise(F.round(1 - F.col("n") / most, 4))})


def summary(cells: DataFrame) -> DataFrame:
    other = F.col("domain") != "health"
    rows = cells.agg(F.sum("n").alias("total_rows"), F.countDistinct("year").alias("years"), F.coalesce(F.sum(F.when(other & (F.col("domain") == "unclassified"), F.col("n"))), F.lit(0)).alias("_u"), F.coalesce(F.sum(F.when(other, F.col("n"))), F.lit(0)).alias("_all"))
    return rows.select("total_rows", "years", F.when(F.col("_all") == 0, 0.0).otherwise(F.round(F.col("_u") * 100 / F.col("_all"), 1)).alias("unclassified_pct"))


def thinnest(cells: DataFrame, k: int = 10) -> DataFrame:
    """The k smallest cells that hold anything, without health and unclassified."""
    return cells.where((F.col("n") > 0) & ~F.col("domain").isin("health", "unclassified")).orderBy("n", "year", "domain").limit(k).select("year", "domain", "n")


def cube(records: DataFrame) -> DataFrame:
    """Counts by year and domain, each alone, and together."""
    return records.cube("year", "domain").agg(F.count("*").alias("n"))


def grown(previous: int, now: int, share: float = 0.10, rows: int = 1_000_000) -> bool:
    """Whether the map is to be made again."""
    return now - previous >= rows or (previous == 0 and now > 0) or (previous > 0 and (now - previous) / previous >= share)
