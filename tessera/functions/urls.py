"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACKING = sorted(
    set(
        "ei ie oq sa _ga _gl aqs bih biw rlz udm ved vet esrc psig uact dclid gclid gs_lp sxsrf yclid client fbclid gbraid gs_ssp iflsig igshid mc_cid mc_eid wbraid "
        "_hsenc _hsmi gs_lcrp msclkid ref_src ref_url sourceid gad_source gad_campaignid utm_id utm_name utm_term utm_brand utm_medium utm_social utm_source utm_content utm_campaign".split()
    )
)
_SPLIT = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_WWW = r"(?:www\.)?"


def _at(host: str, path: str) -> str:
    return "^https?://" + host + path


#: Reason by pattern; the first pattern that matches counts.
JUNK = {
    **{_at(_WWW + site + r"\.com", "/?$"): f"{site}-root" for site in ("gmail", "amazon", "facebook", "twitter", "youtube", "reddit")},
    _at(r"mail\.google\.com", r"/(?:mail/?(?:u/\d+/?)?(?:\?.*)?(?:#inbox/?)?)?$"): "gmail-inbox",
    _at(_WWW + r"google\.com", r"/?(?:\?.*)?$"): "google-root",
    _at(_WWW + r"old\.reddit\.com", "/?$"): "reddit-root",
    _at(r"calendar\.google\.com", r"/calendar/u/\d+/r/?(?:agenda|day|month|week)?/?$"): "google-calendar-landing",
    _at(r"contacts\.google\.com", r"/u/\d+/?$"): "google-contacts-landing",
    _at(r"chrome\.google\.com", "/webstore"): "chrome-webstore",
    _at(r"redirect\.hp\.com", "/"): "hp-factory-redirect",
    _at(r"go\.microsoft\.com", "/fwlink/"): "microsoft-fwlink",
    **{f"^{scheme}": why for scheme, why in (("chrome://", "chrome-internal"), ("javascript:", "javascript-bookmarklet"), ("about:", "browser-internal"), ("file://", "local-file"))},
    _at(r"(?:localhost|127\.0\.0\.1)", r"(?::\d+)?/?"): "localhost",
}
SKIP = {_at(_WWW + r"google\.com", rf"/{page}\?"): f"google-{what}-redundant-with-SearchAction" for page, what in (("search", "search-result"), ("url", "redirect"))}


def _coded(x: Column) -> Column:
    """Decoded and encoded again as a form value, with Python's choice of safe characters."""
    again = F.url_encode(F.coalesce(F.try_url_decode(x), x))
    return F.replace(F.replace(again, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def normalize_url(url: Column) -> Column:
    """https for http, lowercase scheme and host, no default port, trailing slash, tracking parameter or fragment; parameters without '=' go."""
    raw = F.trim(url)
    part = lambda i: F.regexp_extract(raw, _SPLIT, i)
    scheme, host = F.lower(part(1)), F.lower(part(2))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    scheme = F.when(scheme == "http", "https").otherwise(scheme)
    pairs = F.filter(F.split(part(4), "&"), lambda p: (F.instr(p, "=") > 0) & ~F.lower(F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), F.substring_index(p, "=", 1))).isin(*TRACKING))
    query = F.array_join(F.transform(pairs, lambda p: F.concat(_coded(F.substring_index(p, "=", 1)), F.lit("="), _coded(F.regexp_replace(p, r"^[^=]*=", "")))), "&")
    made = F.concat(scheme, F.lit(":"), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""), F.regexp_replace(part(3), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(raw.isNull() | (raw == ""), "").when(raw.rlike(_SPLIT), made).otherwise(raw)


def domain(url: Column) -> Column:
    """Host with its port; null if there is none."""
    return F.nullif(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def _first(url: Column, ladder: dict[str, str], kind: str) -> Column:
    found = F.lit(None).cast("string")
    for pattern, reason in reversed(ladder.items()):
        found = F.when(url.rlike(pattern), f"{kind}:{reason}").otherwise(found)
    return found


def junk(url: Column) -> Column:
    """Why a URL is junk, or null."""
    return F.when(F.coalesce(url, F.lit("")) == "", "junk:empty-url").otherwise(_first(url, JUNK, "junk"))


def skip(url: Column) -> Column:
    """Why a URL isn't taken at all, or null."""
    return _first(url, SKIP, "skip")


def youtube_video(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?:[?&]v=|youtu\.be/|/shorts/|/embed/)([\w\-]{11})", 1), F.lit(""))


def youtube_channel(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/(?:channel/(UC[\w\-]+)|@([\w.\-]+))", 1), F.lit(""))
