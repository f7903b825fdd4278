"""Readiness in disciplines, and what to practise next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.values import age_days, decay, iso_timestamp, rate


def predicted(baseline: Column, days: Column, rate: Column, floor: float) -> Column:
    """What is left of a baseline without practice."""
    return F.greatest(baseline * floor, baseline * decay(days, rate))


def readiness(disciplines: DataFrame, practice: DataFrame, as_of: str, half_life: float = 180, floor: float = 0.05, boost: float = 0.05, alarm: float = 0.5) -> DataFrame:
    """(label, readiness, atrophied) of disciplines(label, baseline, asserted_at) and practice(label, at).

    The decayed baseline and a decayed boost for each practice event, at least
    the floor of the baseline and at most 1; null without either.
    """
    r = rate(F.lit(half_life))
    lifts = practice.groupBy("label").agg(F.sum(F.lit(boost) * decay(age_days(F.col("at"), as_of), r)).alias("_lift"))
    rows = disciplines.join(lifts, "label", "left").withColumn("_days", age_days(F.col("asserted_at"), as_of))
    base = F.coalesce(F.col("baseline") * decay(F.col("_days"), r), F.lit(0.0))
    raw = F.least(F.lit(1.0), F.greatest(F.coalesce(F.col("baseline") * floor, F.lit(0.0)), base + F.coalesce("_lift", F.lit(0.0))))
    value = F.when(F.col("baseline").isNotNull() | F.col("_lift").isNotNull(), F.round(raw, 4))
    return rows.select("label", value.alias("readiness"), (predicted(F.col("baseline"), F.col("_days"), r, floor) < F.col("baseline") * alarm).alias("atrophied"))


def practice_events(commits: DataFrame, mapping: DataFrame, own: str = "owner-authored") -> DataFrame:
    """(label, at): own commits of mapping(repo, label)'s repositories."""
    return commits.where(F.col("authorship") == own).join(mapping, "repo").select("label", F.col("captured_at").alias("at"))


def frontier(nodes: DataFrame, prerequisites: DataFrame, as_of: str, threshold: float = 0.3, stale_days: int = 60) -> DataFrame:
    """(label, reason) of nodes(label, readiness, last_verified), prerequisites(subject, object): subject comes before object.

    unaddressed: no readiness; under-informed: never or long ago verified, or at
    no readable time; below-threshold. The first two only if the node has no
    prerequisite, or at least one is at the threshold.
    """
    at = iso_timestamp(F.col("last_verified"))
    old = at < F.lit(as_of).cast("timestamp") - F.expr(f"interval {stale_days} days")
    reason = F.when(F.col("readiness").isNull(), "unaddressed").when(at.isNull() | old, "under-informed").when(F.col("readiness") < threshold, "below-threshold")
    ready = nodes.where(F.col("readiness") >= threshold).select(F.col("label").alias("subject"), F.lit(True).alias("_ready"))
    gate = prerequisites.join(ready, "subject", "left").groupBy(F.col("object").alias("label")).agg(F.max(F.coalesce("_ready", F.lit(False))).alias("_open"))
    rows = nodes.withColumn("reason", reason).where("reason is not null").join(gate, "label", "left")
    return rows.where((F.col("reason") == "below-threshold") | F.coalesce("_open", F.lit(True))).select("label", "reason")


def ranked_actions(entries: DataFrame, actions: DataFrame) -> DataFrame:
    """Actions (label, action, est_value, cost, novelty, p_action) of the entries with score and place, best first."""
    score = (F.col("est_value") - F.col("cost") + F.col("novelty")) * F.col("p_action")
    rows = entries.join(actions, "label").withColumn("score", F.round(score, 6))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "action")))


def snapshot(qualifiers: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each subject of qualifiers(label, key, value), a column for each key."""
    return qualifiers.groupBy("label").pivot("key", keys).agg(F.max("value"))


def readiness_qualifiers(ready: DataFrame, as_of: str) -> DataFrame:
    """(label, key, value): readiness as text of four places, and when it was computed."""
    rows = ready.where("readiness is not null")
    return rows.select("label", F.lit("readiness").alias("key"), F.format_string("%.4f", "readiness").alias("value")).union(rows.select("label", F.lit("computed_at").alias("key"), F.lit(as_of).alias("value")))
