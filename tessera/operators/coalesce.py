"""Merging of emissions that are about the same person or place.

Each rule becomes a key such that the pairs it fires for agree in it, so that
no rule compares all pairs. What a key groups is joined to the least id of the
group; distances are checked between neighbouring grid cells.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import e164, strip
from tessera.functions.values import canonical_json, haversine_m
from tessera.operators.components import components

AUTO = 0.90
#: Ids of one point that are held in a row; two such rows give up to the square of it as pairs.
BLOCK = 1000
_HELD = ("lat", "lon", "several", "block", "ids")


@dataclass(frozen=True)
class Rule:
    """shape: exact_field, two_field, regex (its first group, or all), alias_list, named_location or geo_radius_meters."""

    name: str
    shape: str
    fields: tuple[str, ...]
    confidence: float
    normalize: str | None = None
    pattern: str = ""
    aliases: tuple[str, ...] = ()
    radius_m: float = 0.0
    review: bool = False


PEOPLE = (
    Rule("exact_email_local_domain", "exact_field", ("email",), 0.95, "lowercase"),
    Rule("phone_e164", "exact_field", ("phone",), 0.95, "e164"),
    Rule("discord_handle", "exact_field", ("discord_handle",), 0.85, "lowercase"),
    Rule("same_full_name_same_email_domain", "two_field", ("full_name", "email_domain"), 0.75, "lowercase"),
    Rule("same_full_name", "exact_field", ("full_name",), 0.50, "lowercase", review=True),
)
PLACES = (
    Rule("geo_within_100m", "geo_radius_meters", ("lat", "lon"), 0.85, radius_m=100.0),
    Rule("geo_within_500m", "geo_radius_meters", ("lat", "lon"), 0.65, radius_m=500.0, review=True),
    Rule("named_location_exact", "named_location", ("name",), 0.80, "lowercase"),
)


def normalized(c: Column, how: str | None) -> Column:
    if how == "lowercase":
        return F.lower(strip(c.cast("string")))
    if how == "strip":
        return strip(c.cast("string"))
    return e164(strip(c.cast("string"))) if how == "e164" else c.cast("string")


def _key(rule: Rule) -> Column:
    parts = [F.nullif(normalized(F.col(f), rule.normalize), F.lit("")) for f in rule.fields]
    if rule.shape == "regex":
        group = 1 if "(" in rule.pattern.replace("(?:", "").replace(r"\(", "") else 0
        return F.nullif(F.regexp_extract(F.col(rule.fields[0]).cast("string"), rule.pattern, group), F.lit(""))
    if rule.shape == "alias_list":
        names = F.array(*[normalized(F.lit(a), rule.normalize) for a in rule.aliases])
        return F.when(F.array_contains(names, parts[0]), F.lit("*"))
    key = F.concat_ws("\u0001", *parts)
    for p in parts:
        key = F.when(p.isNotNull(), key)
    return key


def _equal_pairs(rows: DataFrame, rule: Rule) -> DataFrame:
    keyed = rows.select("id", _key(rule).alias("k")).where("k is not null")
    least = keyed.groupBy("k").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(least, "k").where("id <> a").select("a", F.col("id").alias("b"))


def _near_pairs(rows: DataFrame, rule: Rule) -> DataFrame:
    """All pairs within the radius, each once: cells as wide as the radius, each point with the cells around it.

    A degree of longitude shrinks with latitude, so points are put into bands
    of latitude cells, and columns are as wide as the widest need of the band
    and its neighbours. Columns go round: the first and the last are neighbours.

    Distances are those of points, whatever number of ids is at one. The ids of
    a point are held in blocks of about BLOCK, and pairs of blocks are spread
    over all tasks before they are written out as pairs of ids. Only ids that
    are at several points can give a pair twice.
    """
    deg = math.degrees(rule.radius_m / 6_371_000.0) * 1.0001
    lat, lon = (F.col(f).cast("double") for f in rule.fields)
    at = rows.select("id", lat.alias("lat"), lon.alias("lon")).where("id is not null and lat is not null and lon is not null and abs(lat) <= 90")
    at = at.groupBy("id").agg(F.collect_set(F.struct("lat", "lon")).alias("at")).select("id", F.explode("at").alias("at"), (F.size("at") > 1).alias("several")).select("id", "at.lat", "at.lon", "several")
    count = at.groupBy("lat", "lon").agg(F.count("*").alias("n"))
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / F.lit(BLOCK))).alias("block")
    at = at.join(count, ["lat", "lon"]).groupBy("lat", "lon", "several", block).agg(F.collect_list("id").alias("ids"))
    at = at.withColumn("y", F.floor(F.col("lat") / deg).cast("long"))
    mine = at.withColumn("band", F.explode(F.array(F.col("y") - 1, F.col("y"), F.col("y") + 1)))
    width = F.lit(deg) / F.greatest(F.lit(1e-3), F.cos(F.radians(F.least(F.lit(89.9), F.abs((F.col("band") + F.when(F.col("band") >= 0, 2).otherwise(-1)) * F.lit(deg))))))
    around = F.greatest(F.lit(1), F.floor(F.lit(360.0) / width).cast("long"))  # whole columns in a circle; the last is wider than the others
    wrap = lambda x: F.pmod(x, around)
    mine = mine.withColumn("around", around).withColumn("x", F.least(F.floor(F.pmod(F.col("lon") + 180.0, F.lit(360.0)) / width).cast("long"), around - 1))
    left = mine.where("band = y").select(*[F.col(c).alias(f"{c}1") for c in _HELD], "band", F.explode(F.array_distinct(F.array(wrap(F.col("x") - 1), F.col("x"), wrap(F.col("x") + 1)))).alias("x"))
    right = mine.select(*[F.col(c).alias(f"{c}2") for c in _HELD], "band", "x")
    place = lambda k: F.struct(*[F.col(f"{c}{k}") for c in _HELD[:4]])
    near = left.join(right, ["band", "x"]).where((place(1) <= place(2)) & (haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")) <= rule.radius_m))
    near = near.select(*[F.col(f"{c}{k}") for k in (1, 2) for c in _HELD], (place(1) == place(2)).alias("same"), (F.col("several1") | F.col("several2")).alias("again"))
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 4 * spark.sparkContext.defaultParallelism)
    near = near.repartition(tasks, *[F.col(f"{c}{k}") for k in (1, 2) for c in _HELD[:4]])
    pairs = near.select("same", "again", "ids2", F.explode("ids1").alias("i")).select("same", "again", "i", F.explode("ids2").alias("j")).where("case when same then i < j else i <> j end")
    pairs = pairs.select("again", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    return pairs.where("not again").select("a", "b").unionAll(pairs.where("again").select("a", "b").distinct())


def candidate_pairs(rows: DataFrame, rules: tuple[Rule, ...], threshold: float = 0.0) -> DataFrame:
    """(a, b, rule, confidence): pairs that link what the rules hold equal, each with its surest rule.

    Of what agrees in a key every member is paired with the least id; distance
    rules give all their pairs. At equal confidence the rule first by name
    counts. Rules on columns that rows lack don't fire.
    """
    fit = [r for r in rules if r.confidence >= threshold and all(f in rows.columns for f in r.fields)]
    out = None
    for r in fit:
        pairs = _near_pairs(rows, r) if r.shape == "geo_radius_meters" else _equal_pairs(rows, r)
        pairs = pairs.select("a", "b", F.lit(r.name).alias("rule"), F.lit(r.confidence).alias("confidence"), F.lit(r.review).alias("review"))
        out = pairs if out is None else out.union(pairs)
    if out is None:
        raise ValueError("no rule applies to these columns")
    if len(fit) == 1 and fit[0].shape == "geo_radius_meters":  # each pair is there once
        return out.select("a", "b", "rule", "confidence", "review")
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "rule", "confidence", "review"))
    return out.groupBy("a", "b").agg(best.alias("s")).select("a", "b", "s.rule", "s.confidence", "s.review")


def proposals(rows: DataFrame, rules: tuple[Rule, ...], threshold: float = 0.0) -> DataFrame:
    """(id, survivor, rule, confidence, decision) of every row that merges into another.

    survivor is the least id of the component; rule and confidence are the
    surest of the pairs in it. decision is 'auto' from 0.90 on unless the rule
    asks for a review, else 'review'.
    """
    pairs = candidate_pairs(rows, rules, threshold)
    groups = components(pairs.select("a", "b"))
    best = pairs.join(groups, F.col("a") == F.col("node")).groupBy("component").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "rule", "confidence", "review")).alias("s"))
    out = groups.where("node <> component").join(best, "component")
    decision = F.when((F.col("s.confidence") >= AUTO) & ~F.col("s.review"), "auto").otherwise("review")
    return out.select(F.col("node").alias("id"), F.col("component").alias("survivor"), F.col("s.rule").alias("rule"), F.col("s.confidence").alias("confidence"), decision.alias("decision"))


def applied(rows: DataFrame, key: str, merges: DataFrame) -> DataFrame:
    """rows with the ids in key replaced by their survivors."""
    moved = merges.select(F.col("id").alias(key), F.col("survivor").alias("_to"))
    return rows.join(moved, key, "left").withColumn(key, F.coalesce("_to", key)).drop("_to").select(*rows.columns)


def unmerged(merges: DataFrame, survivor: int) -> DataFrame:
    """The map of ids without the merges into one survivor: views made from it show the originals again."""
    return merges.where(F.col("survivor") != survivor)


def merge_stats(merges: DataFrame) -> DataFrame:
    """(rule, bucket, n) by hundredths of confidence in tenths."""
    bucket = F.when(F.col("confidence") >= 0.95, ">=0.95").when(F.col("confidence") >= 0.90, "0.90-0.95").when(F.col("confidence") >= 0.80, "0.80-0.90").when(F.col("confidence") >= 0.50, "0.50-0.80").otherwise("<0.50")
    return merges.groupBy("rule", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def review_queue(pending: DataFrame, queued: DataFrame) -> DataFrame:
    """Proposals for review whose signature (survivor, rule, member) isn't queued yet."""
    sign = lambda df: df.withColumn("signature", F.sha2(F.concat_ws("|", "survivor", "rule", "id"), 256))
    return sign(pending.where("decision = 'review'")).join(queued.select("signature"), "signature", "left_anti")


def shown_for_review(queue: DataFrame, rule: str | None = None, limit: int | None = None, auto_accept: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, shown): what is at least as sure as auto_accept needs no review; of the rest those of a rule, the surest first, up to a limit."""
    sure = F.col("confidence") >= auto_accept if auto_accept is not None else F.lit(False)
    shown = queue.where(~sure)
    if rule is not None:
        shown = shown.where(F.col("rule") == rule)
    shown = shown.orderBy(F.desc("confidence"), "survivor", "id")
    return queue.where(sure), shown if limit is None else shown.limit(limit)


def audit_log(rows: DataFrame, key: str, merges: DataFrame, facet_type: str) -> DataFrame:
    """(facet_type, facet_node_id, rule, confidence, merged_id, payload): one entry for each id merged away, with its whole row as JSON, from which unmerged rows can be made again."""
    payload = canonical_json(F.struct(*[F.col(c) for c in rows.columns])).alias("payload")
    held = rows.select(F.col(key).alias("id"), payload)
    return merges.join(held, "id").select(F.lit(facet_type).alias("facet_type"), F.col("survivor").alias("facet_node_id"), "rule", "confidence", F.col("id").alias("merged_id"), "payload")


def restored(log: DataFrame, rows: DataFrame, survivor: int) -> DataFrame:
    """The rows (of the schema of rows) that were merged into a survivor, from the log."""
    back = log.where(F.col("facet_node_id") == survivor).select(F.from_json("payload", rows.schema).alias("r"))
    return back.select("r.*")


def payload_value(payload, name: str):
    """A field of a facet's payload, given as a map or as JSON text."""
    return F.element_at(payload, name) if not isinstance(payload, str) else F.get_json_object(F.col(payload), f"$.{name}")


def reviewed(queue: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, left) after decisions(signature, decision): rejected rows leave, deferred and undecided ones stay."""
    rows = queue.drop("decision").join(decisions, "signature", "left")
    return rows.where("decision = 'accept'"), rows.where("decision is null or decision = 'defer'")


def person_fields(people: DataFrame) -> DataFrame:
    """email_domain, first and last name where they can be read from email and full_name."""
    words = F.split(strip(F.col("full_name")), r"\s+")
    return people.withColumns({"email_domain": F.when(F.instr("email", "@") > 0, F.lower(F.substring_index("email", "@", -1))), "first_name": F.nullif(F.get(words, 0), F.lit("")), "last_name": F.when(F.size(words) > 1, F.element_at(words, -1))})


def place_grid(places: DataFrame) -> DataFrame:
    """grid: coordinates to four places."""
    return places.withColumn("grid", F.concat_ws(",", F.format_string("%.4f", F.col("lat").cast("double")), F.format_string("%.4f", F.col("lon").cast("double"))))
