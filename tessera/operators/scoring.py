"""Retrieval weights that decay with age, by tier, and are raised by engagement."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import age_days, decay, rate


@dataclass(frozen=True)
class Policy:
    """tiers: name -> (half life in days, base value, floor fraction); a half life that isn't positive never decays."""

    tiers: dict[str, tuple[float, float, float]] = field(default_factory=lambda: {"evergreen": (-1, 1.0, 1.0), "near_evergreen": (3652, 1.0, 0.05), "warm": (1826, 1.0, 0.05), "standard": (730, 1.0, 0.05), "fast": (182, 1.0, 0.05)})
    by_source_kind: dict[str, str] = field(default_factory=dict)
    by_schema_type: dict[str, str] = field(default_factory=dict)
    boost: float = 0.1


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    if not mapping:
        return F.lit(None).cast("string")
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def tier(policy: Policy, source_kind: Column, schema_type: Column, override: Column) -> Column:
    """The override, else the tier of the schema type, else of the source kind, else 'standard'; unknown names don't count."""
    known = lambda c: F.when(c.isin(*policy.tiers), c)
    return F.coalesce(known(override), known(_lookup(policy.by_schema_type, F.coalesce(schema_type, F.lit("")))), known(_lookup(policy.by_source_kind, F.coalesce(source_kind, F.lit("")))), F.lit("standard"))


def _tier_value(policy: Policy, i: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for name, t in policy.tiers.items() for x in (name, float(t[i]))]), F.col("tier"))


def with_tiers(chunks: DataFrame, policy: Policy) -> DataFrame:
    """chunks with tier, rate, base and floor."""
    column = lambda name: F.col(name) if name in chunks.columns else F.lit(None).cast("string")
    rows = chunks.withColumn("tier", tier(policy, column("source_kind"), column("schema_type"), column("tier_override")))
    rows = rows.withColumns({"rate": rate(_tier_value(policy, 0)), "base": _tier_value(policy, 1)})
    return rows.withColumn("floor", F.col("base") * _tier_value(policy, 2))


def scores(chunks: DataFrame, engagements: DataFrame | None, policy: Policy, as_of: str) -> DataFrame:
    """(id, tier, age_days, score): max(floor, base * decay(age) + sum of base * boost * decay(age of engagement)).

    An engagement decays at its chunk's rate. With e^(-r * age) the sum is
    factored by (chunk, rate), so engagements are aggregated before the join
    whenever they are many: one shuffle on the chunk's id.
    """
    rows = with_tiers(chunks, policy).withColumn("age_days", age_days(F.col("date_sent"), as_of))
    own = F.col("base") * decay(F.col("age_days"), F.col("rate"))
    if engagements is None:
        boost = F.lit(0.0)
    else:
        rates = sorted({(float(t[0])) for t in policy.tiers.values()})
        age = age_days(F.col("engaged_at"), as_of)
        sums = engagements.groupBy(F.col("chunk_id").alias("id")).agg(*[F.sum(decay(age, rate(F.lit(h)))).alias(f"_b{i}") for i, h in enumerate(rates)])
        rows = rows.join(sums, "id", "left")
        pick = F.lit(0.0)
        for i, h in enumerate(rates):
            pick = F.when(F.col("tier").isin(*[n for n, t in policy.tiers.items() if float(t[0]) == h]), F.coalesce(f"_b{i}", F.lit(0.0))).otherwise(pick)
        boost = F.col("base") * policy.boost * pick
    return rows.select("id", "tier", F.round("age_days", 4).alias("age_days"), F.round(F.greatest(F.col("floor"), own + boost), 6).alias("score"))


def unscored(chunks: DataFrame, scored: DataFrame) -> DataFrame:
    """Chunks without a score yet."""
    return chunks.join(scored.select("id"), "id", "left_anti")


def populated(chunks: DataFrame, scored: DataFrame, policy: Policy, as_of: str) -> DataFrame:
    """scored and the initial scores of all other chunks."""
    return scored.unionByName(scores(unscored(chunks, scored), None, policy, as_of))


def recomputed(chunks: DataFrame, engagements: DataFrame, policy: Policy, as_of: str, only: str | None = None) -> DataFrame:
    """All scores anew, or those of one tier."""
    rows = scores(chunks, engagements, policy, as_of)
    return rows.where(F.col("tier") == only) if only else rows


def tier_summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"), F.min("score").alias("least"), F.max("score").alias("most"))


def content_dates(chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """chunks(id, source_table, source_id, ...) with date_sent of the parent row, '' where it has none or isn't there."""
    rows = chunks.drop("date_sent").join(parents.select("source_table", "source_id", "date_sent"), ["source_table", "source_id"], "left")
    return rows.withColumn("date_sent", F.coalesce("date_sent", F.lit("")))


def source_kinds(chunks: DataFrame, origins: DataFrame, files: DataFrame) -> DataFrame:
    """chunks with the source_kind of the file that the parent came from: origins(source_table, source_id, source_file_id), files(id, source_kind)."""
    kinds = origins.join(files.select(F.col("id").alias("source_file_id"), "source_kind"), "source_file_id").drop("source_file_id")
    return chunks.drop("source_kind").join(kinds, ["source_table", "source_id"], "left")


def recorded(engagements: DataFrame, chunk_ids: list[int], event_type: str, at: str, source: str | None = None) -> DataFrame:
    """engagements(chunk_id, engaged_at, event_type, source) and one more of that type for each of the chunks. Nothing is merged: looking twice counts twice."""
    more = engagements.sparkSession.createDataFrame([(i, at, event_type, source) for i in chunk_ids], "chunk_id long, engaged_at string, event_type string, source string")
    for name in ("event_type", "source"):
        if name not in engagements.columns:
            engagements = engagements.withColumn(name, F.lit(None).cast("string"))
    return engagements.unionByName(more)
