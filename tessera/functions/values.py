"""Dates, decay, distances, hashes and map access as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
_ISO = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd"]


def iso_timestamp(text: Column) -> Column:
    """The instant of an ISO string; without a zone it is in UTC; null if malformed."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in _ISO])


def age_days(text: Column, as_of: str) -> Column:
    """Days from an ISO string to as_of, at least 0; 0 if malformed or null."""
    seconds = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(iso_timestamp(text))) / F.lit(86_400e6)
    return F.coalesce(F.greatest(F.lit(0.0), seconds), F.lit(0.0))


def rate(half_life_days: Column) -> Column:
    """Decay rate of a half life; 0 (none) for one that isn't positive."""
    return F.when(half_life_days > 0, F.lit(math.log(2)) / half_life_days).otherwise(0.0)


def decay(age: Column, rate: Column) -> Column:
    return F.when(rate <= 0, 1.0).otherwise(F.exp(-rate * age))


def apple_seconds(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds + F.lit(978_307_200))


def ambiguous_seconds(seconds: Column) -> Column:
    """Unix seconds if that gives a year of 1995 to 2030, else seconds from 2001 under the same test, else null."""
    unix, apple = F.timestamp_seconds(seconds), apple_seconds(seconds)
    return F.when(F.year(unix).between(1995, 2030), unix).when(F.year(apple).between(1995, 2030), apple)


def in_range(date: Column, since: str | None, until: str | None) -> Column:
    """The first ten characters lie between the bounds, as strings; a null date doesn't where there is a bound."""
    day, kept = F.substring(date, 1, 10), F.lit(True)
    if since:
        kept = kept & (day >= since)
    if until:
        kept = kept & (day <= until)
    return F.coalesce(kept, F.lit(False))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def seed_hash(*parts: Column, nulls: str = "") -> Column:
    """SHA-256 of the parts joined by bars; nulls: what stands for a missing one."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit(nulls)) for p in parts]), 256)


def json_text(document: Column, path: str) -> Column:
    """The value at a path ('$.a.b[0]') of a JSON text, as text; null where there is none or the text is no JSON."""
    return F.get_json_object(document, path)


def json_map(document: Column) -> Column:
    """The fields of a JSON object as a map of texts; null for what is no object."""
    return F.from_json(document, "map<string,string>")


def canonical_json(row: Column) -> Column:
    """A struct or map as JSON with nothing left to chance: fields as declared, nulls written out."""
    return F.to_json(row, {"ignoreNullFields": "false"})
