"""Parsers of exports, by format. Each takes (name, bytes) and yields records."""

from __future__ import annotations

import csv
import email
import email.policy
import gzip
import hashlib
import html
import io
import json
import os
import re
import sqlite3
import tempfile
import zipfile
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from email.utils import getaddresses, parsedate_to_datetime
from xml.etree import ElementTree as ET

from tessera.sources.records import Record, sha

AUTOMATED = re.compile("no-?reply|do-?not-?reply|notif|alert|update|news|market|promo|deal|broadcast|announce|automat|mailer", re.I)


def _iso(seconds: float | None) -> str | None:
    return None if seconds is None else (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=seconds)).isoformat()


def _number(x: object) -> float | None:
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def _text(raw: bytes, code: str = "utf-8-sig") -> str:
    return str(raw, code, "replace")


def _json(raw: bytes):
    return json.loads(_text(raw))


def _rows(raw: bytes) -> Iterator[dict[str, str]]:
    for row in csv.DictReader(io.StringIO(_text(raw))):
        yield {(k or "").strip(): (v or "").strip() for k, v in row.items() if not isinstance(v, list)}


def _bare(fragment: str) -> str:
    """Text of an HTML fragment."""
    cut = re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", fragment)
    cut = re.sub(r"(?i)<br\s*/?>|</(p|div|tr|li|h\d)>", "\n", cut)
    return re.sub(r"[ \t\xa0]+", " ", html.unescape(re.sub(r"<[^>]*>", "", cut))).strip()


def phone(raw: str | None) -> str:
    digits = re.sub(r"[\s().\-]", "", raw or "")
    if re.fullmatch(r"\d{10}", digits):
        return f"+1{digits}"
    return f"+{digits}" if re.fullmatch(r"1\d{10}", digits) else digits


# mail


def bulk_signal(headers, sender: str) -> str | None:
    """Why a mail counts as bulk, by the first of six signs; None if it doesn't."""
    for name in ("List-Unsubscribe", "List-Id"):
        if headers.get(name):
            return name
    precedence, auto = ((headers.get(h) or "no").strip().lower() for h in ("Precedence", "Auto-Submitted"))
    if precedence in {"bulk", "junk", "list"}:
        return f"Precedence:{precedence}"
    if auto != "no":
        return f"Auto-Submitted:{auto}"
    if headers.get("X-Auto-Response-Suppress"):
        return "X-Auto-Response-Suppress"
    return "noreply-pattern" if AUTOMATED.search(sender.partition("@")[0]) else None


def _mail_date(m) -> str | None:
    for raw in [m.get("Date"), *(r.rpartition(";")[2] for r in m.get_all("Received") or [])]:
        try:
            at = parsedate_to_datetime(str(raw).strip())
        except (TypeError, ValueError):
            continue
        return (at if at.tzinfo else at.replace(tzinfo=UTC)).isoformat()
    return None


def direction(sender: str, recipients: list[str], own: frozenset[str]) -> str:
    """unknown without own addresses or a sender; self from the owner to the owner; else outbound or inbound."""
    if not own or not sender:
        return "unknown"
    if sender in own:
        return "self" if any(r in own for r in recipients) else "outbound"
    return "inbound"


def mbox(name: str, raw: bytes, own: frozenset[str] = frozenset()) -> Iterator[Record]:
    """The mails of a mailbox, or of a part of one that begins with the line of a mail; bodies are whole."""
    for block in re.split(rb"(?:\A|(?<=\n))From [^\n]*\n", raw)[1:]:
        m = email.message_from_bytes(re.sub(rb"(?m)^>(>*From )", rb"\1", block), policy=email.policy.compat32)
        found = getaddresses([str(m.get("From") or "")])
        who, sender = found[0] if found else ("", "")
        sender = sender.strip().lower()
        ident = (m.get("Message-ID") or "").strip()
        digest = hashlib.sha256(block.rstrip(b"\r\n")).hexdigest()  # what ends a mail isn't there before the next one is
        if not sender and not ident:
            continue
        to = [a.strip().lower() for _, a in getaddresses([str(v) for h in ("To", "Cc", "Bcc") for v in m.get_all(h) or []]) if a]
        plain, rich, files = [], [], []
        for part in m.walk():
            if part.is_multipart():
                continue
            if part.get_filename() or part.get_content_disposition() == "attachment":
                files.append(str(part.get_filename() or "unnamed"))
                continue
            data = part.get_payload(decode=True) or b""
            try:
                body = _text(data, part.get_content_charset() or "utf-8")
            except LookupError:
                body = _text(data)
            {"text/plain": plain, "text/html": rich}.get(part.get_content_type(), []).append(body)
        signal = bulk_signal(m, sender)
        body = "\n".join(plain) if plain else _bare("\n".join(rich))
        subject = str(email.header.make_header(email.header.decode_header(str(m.get("Subject"))))) if m.get("Subject") else None
        extra = {"message_id": ident or f"synth:{digest[:16]}", "attachments": json.dumps(files), "labels": str(m.get("X-Gmail-Labels") or "")}
        if signal:
            extra["bulk_signal"] = signal
        yield {"schema_type": "EmailMessage", "raw_hash": digest, "date": _mail_date(m), "subject": subject, "sender_address": sender or None, "sender_name": who or None, "direction": direction(sender, to, own), "body_text": body, "thread_key": m.get("X-GM-THRID"), "is_bulk": signal is not None, "recipients": to, "extra": extra}


# chat


def _sms_body(e: ET.Element) -> tuple[str, int]:
    parts = e.findall(".//part")
    texts = [p.get("text") or "" for p in parts if p.get("ct") == "text/plain" and p.get("text") != "null"]
    return "\n".join(t for t in texts if t), sum(p.get("ct") not in ("text/plain", "application/smil") for p in parts)


_CALLS = dict(zip("1234", "incoming outgoing missed voicemail".split(), strict=True))


def sms_xml(name: str, raw: bytes) -> Iterator[Record]:
    for e in ET.fromstring(raw):
        if e.tag == "call":
            if not (number := phone(e.get("number"))):
                continue
            kind, seconds = e.get("type") or "", int(e.get("duration") or 0)
            way = "outbound" if kind == "2" else "inbound" if kind in ("1", "3", "4") else "unknown"
            yield {"schema_type": "Action", "raw_hash": sha("calls-xml", e.get("date") or "", number, kind, seconds), "date": _iso(float(e.get("date") or 0) / 1000), "sender_address": number, "direction": way, "value": float(seconds), "kind": _CALLS.get(kind, "unknown")}
            continue
        if e.tag not in ("sms", "mms"):
            continue
        body, files = ((e.get("body") or "").replace("null", "", 1) if e.get("body") == "null" else e.get("body") or "", 0) if e.tag == "sms" else _sms_body(e)
        first, *others = (e.get("address") or "").split("~")
        who = phone(first)
        if not who or not (body or files):
            continue
        inbound = (e.get("msg_box") or e.get("type")) == "1"
        label = e.get("contact_name") if e.get("contact_name") not in (None, "", "(Unknown)", "null") else who
        at = _iso(float(e.get("date")) / 1000) if _number(e.get("date")) is not None else None
        way = "inbound" if inbound else "outbound"
        yield {"schema_type": "Message", "raw_hash": sha("sms-xml", at, who, way, body[:128]), "date": at, "sender_address": who if inbound else "self", "sender_name": label if inbound else None, "direction": way, "body_text": body or None, "thread_key": f"sms:{who}", "recipients": [p for p in map(phone, others) if p], "extra": {"attachments": str(files)}}


_LINE = re.compile(r"^[\[(]?(?P<at>(?:\d{4}-\d\d-\d\d[ T])?\d{1,2}:\d\d(?::\d\d)?(?: ?[AP]M)?)[\])]?\s*<?(?P<who>[^:<>]{1,64}?)>?:\s(?P<body>.*)$")


def chat_log(name: str, raw: bytes) -> Iterator[Record]:
    """Lines of 'time name: text', in HTML or plain; the day comes from a heading or the file's name; other lines continue the one before."""
    text = _text(raw)
    if re.search(r"(?i)<html|<body|<br", text):
        text = _bare(text)
    day = next(iter(re.findall(r"\d{4}-\d\d-\d\d", name)), None)
    found, key = None, re.sub(r"\.\w+$", "", name.rsplit("/", 1)[-1])
    n = 0
    for line in text.splitlines():
        if (h := re.search(r"(\d{4}-\d\d-\d\d)", line)) and not _LINE.match(line):
            day = h.group(1)
        m = _LINE.match(line.strip())
        if m:
            if found:
                yield found
            at = m["at"] if "-" in m["at"] else f"{day or ''} {m['at']}".strip()
            found = {"schema_type": "Message", "date": at, "sender_address": m["who"].strip().lower(), "sender_name": m["who"].strip(), "body_text": m["body"], "thread_key": key, "raw_hash": sha(name, 0, n, at, m["who"], m["body"][:100])}
            n += 1
        elif found and line.strip() and not h:
            found["body_text"] += "\n" + line.strip()
    if found:
        yield found


def discord(name: str, raw: bytes) -> Iterator[Record]:
    """Messages of a channel, of either export: a list beside channel.json, or an object with channel and messages."""
    if not re.search(r"\.json$", name):
        return
    data = _json(raw)
    channel = data.get("channel", {}) if isinstance(data, dict) else {}
    rows = data.get("messages", []) if isinstance(data, dict) else data
    label = channel.get("name") or name.rsplit("/", 2)[-2 if "/" in name else -1]
    for m in rows if isinstance(rows, list) else []:
        if not isinstance(m, dict):
            continue
        ident, body = str(m.get("id") or m.get("ID") or ""), m.get("content") or m.get("Contents") or ""
        who = m.get("author") or {}
        if ident and (body or m.get("attachments") or m.get("Attachments")):
            yield {"schema_type": "Message", "raw_hash": sha("discord", channel.get("id") or label, ident, body[:200]), "date": m.get("timestamp") or m.get("Timestamp"), "sender_address": str(who.get("id") or "self"), "sender_name": who.get("name"), "body_text": body, "thread_key": str(label), "direction": "inbound" if who else "outbound"}


def message_html(name: str, raw: bytes) -> Iterator[Record]:
    """Messages in HTML as blocks of time, sender and text (elements of classes timestamp, sender and message, or hChatLog's and Voice's names for them)."""
    text = _text(raw)
    mine = re.compile(r'(?is)class="(?:timestamp|dt|time)[^"]*"[^>]*?(?:title="(?P<t>[^"]*)")?[^>]*>(?P<at>.*?)</.*?class="(?:sender(?! tel)|sender|fn|name)[^"]*"[^>]*>(?P<who>.*?)</.*?(?:class="(?:message|body|text)[^"]*"[^>]*>|<q>)(?P<body>.*?)</(?:span|div|q|p)>')
    thread = re.sub(r"\.html?$", "", name.rsplit("/", 1)[-1])
    people = [p.strip() for p in re.split(r",|&", thread) if p.strip()]
    for i, m in enumerate(mine.finditer(text)):
        who, at, body = _bare(m["who"]), (m["t"] or _bare(m["at"])).strip(), _bare(m["body"])
        if body:
            own = who.lower() in ("me", "self")
            yield {"schema_type": "Message", "raw_hash": sha(thread, i, at, who, body[:100]), "date": at, "sender_address": "self" if own else (phone(who) or who.lower()), "sender_name": who, "direction": "outbound" if own else "inbound", "body_text": body, "thread_key": "|".join(sorted(people)), "recipients": people if own else [], "extra": {"group": str(len(people) > 1).lower()}}


def _content(parts: object) -> str | None:
    if isinstance(parts, str):
        return parts or None
    out = [p.get("text") or p.get("thinking") or "" for p in parts or [] if isinstance(p, dict)]
    return "\n".join(x for x in out if x) or None


def _turn_kind(turn: dict) -> str:
    parts = (turn.get("message") or {}).get("content")
    side = bool(turn.get("isSidechain"))
    if isinstance(parts, str):
        return "sidechain" if side else "message"
    if not isinstance(parts, list):
        return "unknown"
    kinds = [p.get("type") for p in parts if isinstance(p, dict)]
    if turn.get("type") == "user":
        return "tool_result" if "tool_result" in kinds else "message"
    if "tool_use" in kinds:
        return "tool_use"
    return "sidechain" if side or not set(kinds) - {"thinking", None} else "message"


def session_jsonl(name: str, raw: bytes) -> Iterator[Record]:
    """Turns of a coding session, a JSON object a line; broken lines are left out."""
    turns = []
    for line in _text(raw).splitlines():
        try:
            turns.append(json.loads(line))
        except json.JSONDecodeError:
            continue
    turns = [t for t in turns if isinstance(t, dict)]
    thread = next((t["sessionId"] for t in turns if t.get("sessionId")), name.rsplit("/", 1)[-1].removesuffix(".jsonl"))
    for t in turns:
        if t.get("type") in ("user", "assistant") and t.get("uuid"):
            m = t.get("message") or {}
            yield {"schema_type": "Conversation", "raw_hash": f"session:{t['uuid']}", "date": t.get("timestamp"), "kind": _turn_kind(t), "role": t["type"], "thread_key": thread, "body_text": _content(m.get("content")), "extra": {k: str(v) for k, v in {"model": m.get("model"), "parent": t.get("parentUuid"), "cwd": t.get("cwd")}.items() if v}}


def assistant_export(name: str, raw: bytes) -> Iterator[Record]:
    """Conversations of a chat assistant's export: a list with chat_messages, or with a mapping of messages."""
    data = _json(raw)
    for c in data if isinstance(data, list) else []:
        key = str(c.get("uuid") or c.get("id") or "")
        rows = c.get("chat_messages") or [x["message"] for x in (c.get("mapping") or {}).values() if x.get("message")]
        for i, m in enumerate(rows):
            content = m.get("content")
            body = m.get("text") or _content(content) or ("\n".join(str(p) for p in content.get("parts") or []) if isinstance(content, dict) else None)
            role = {"human": "user"}.get(m.get("sender") or (m.get("author") or {}).get("role"), m.get("sender") or (m.get("author") or {}).get("role"))
            yield {"schema_type": "Conversation", "raw_hash": f"{key}:{m.get('uuid') or m.get('id')}:{i}", "date": m.get("created_at") or _iso(_number(m.get("create_time"))), "kind": "message", "role": role, "thread_key": key, "subject": c.get("name") or c.get("title"), "body_text": body}


# people, calendars, health, places, media


def _unfolded(text: str) -> list[str]:
    return re.sub(r"\r?\n[ \t]", "", text).splitlines()


def vcard(name: str, raw: bytes) -> Iterator[Record]:
    group, n = ([*name.split("/")[:-1], "Default"][-2 if "/" in name else -1]), 0
    for card in re.findall(r"(?s)BEGIN:VCARD(.*?)END:VCARD", "\n".join(_unfolded(_text(raw)))):
        got: dict[str, list[str]] = {}
        for line in card.splitlines():
            prop, _, value = line.partition(":")
            got.setdefault(prop.split(";")[0].split(".")[-1].strip().upper(), []).append(value.strip())
        mails, tels = [m.lower() for m in got.get("EMAIL", [])], [re.sub(r"[\s().\-]", "", t) for t in got.get("TEL", [])]
        if not (got.get("FN") or mails or tels):
            continue
        last, first, *_ = [*(got.get("N") or [""])[0].split(";"), "", ""]
        full = (got.get("FN") or [""])[0] or f"{first} {last}".strip() or "Unnamed"
        main = (mails or tels or [full.lower()])[0]
        yield {"schema_type": "Person", "raw_hash": sha("contacts", group, n, full, main), "sender_name": full, "sender_address": main, "recipients": mails + tels, "body_text": "\n".join(got.get("NOTE", [])) or None, "extra": {"organization": ", ".join(o.replace(";", " ").strip() for o in got.get("ORG", [])), "title": ", ".join(got.get("TITLE", [])), "group": group}}
        n += 1


def _ical_time(value: str) -> str | None:
    try:
        at = datetime.fromisoformat(value.strip().removesuffix("Z"))
    except ValueError:
        return None
    return at.isoformat() if "T" in value else at.date().isoformat()


def ical(name: str, raw: bytes) -> Iterator[Record]:
    lines = _unfolded(_text(raw))
    calendar = next((x.partition(":")[2].strip() for x in lines if x.startswith("X-WR-CALNAME")), name.rsplit("/", 1)[-1].partition(".")[0].partition("@")[0])
    event, n = None, 0
    plain = lambda s: None if s is None else re.sub(r"\\([nN,;\\])", lambda m: {"n": "\n", "N": "\n"}.get(m[1], m[1]), s)
    for line in lines:
        if line == "BEGIN:VEVENT":
            event = {}
        elif line == "END:VEVENT" and event is not None:
            at = _ical_time(event.get("DTSTART", ""))
            yield {"schema_type": "Event", "raw_hash": sha("calendar", calendar, event.get("UID") or f"calendar:{calendar}:idx{n}", at), "date": at, "date_end": _ical_time(event.get("DTEND", "")), "subject": plain(event.get("SUMMARY")), "body_text": plain(event.get("DESCRIPTION")), "extra": {"location": plain(event.get("LOCATION")) or "", "all_day": str(at is not None and len(at) == 10).lower(), "calendar": calendar}}
            event, n = None, n + 1
        elif event is not None:
            prop, _, value = line.partition(":")
            event.setdefault(prop.split(";")[0], value)


def apple_health(name: str, raw: bytes) -> Iterator[Record]:
    """Records, workouts and clinical records of a health export, and the track points of its GPX files."""
    if name.endswith(".gpx"):
        for p in ET.fromstring(re.sub(rb'\sxmlns="[^"]*"', b"", raw)).iter("trkpt"):
            yield {"schema_type": "GeoShape", "raw_hash": sha(name, p.get("lat"), p.get("lon"), p.findtext("time")), "date": p.findtext("time"), "lat": float(p.get("lat")), "lon": float(p.get("lon"))}
        return
    if not name.endswith(".xml"):
        return
    for e in ET.fromstring(raw):
        a = e.attrib
        meta = {m.get("key"): m.get("value") for m in e.findall("MetadataEntry")}
        if e.tag == "Record":
            kind = re.sub("^HK(Quantity|Category)TypeIdentifier", "", a.get("type", ""))
            beats = [int(float(b.get("bpm"))) for b in e.iter("InstantaneousBeatsPerMinute")]
            if beats:
                meta["heart_rate_samples"] = json.dumps(beats)
            yield {"schema_type": "Observation", "raw_hash": sha("apple-health", "record", a.get("type"), a.get("startDate"), a.get("endDate"), a.get("value"), a.get("unit"), a.get("sourceName")), "date": a.get("startDate"), "date_end": a.get("endDate"), "subject": f"{kind}: {a.get('value', '')} {a.get('unit', '')}".strip(), "kind": kind, "value": _number(a.get("value")), "is_bulk": True, "extra": meta}
        elif e.tag == "Workout":
            parts = [a.get("workoutActivityType", "").removeprefix("HKWorkoutActivityType"), *(f"{k} {a[k]}" for k in ("duration", "totalDistance", "totalEnergyBurned") if a.get(k))]
            yield {"schema_type": "ExerciseAction", "raw_hash": sha("apple-health", "workout", a.get("workoutActivityType"), a.get("startDate"), a.get("endDate"), a.get("duration")), "date": a.get("startDate"), "date_end": a.get("endDate"), "body_text": " | ".join(parts), "kind": parts[0], "value": _number(a.get("duration")), "extra": meta}
        elif e.tag == "ClinicalRecord":
            yield {"schema_type": "MedicalRecord", "raw_hash": sha("apple-health", "clinical", a.get("type"), a.get("identifier"), a.get("receivedDate")), "date": a.get("receivedDate"), "kind": a.get("type"), "subject": a.get("identifier"), "extra": {"resource": a.get("resourceFilePath", "")}}


_SEGMENTS = {7: "walking", 8: "running", 1: "biking", 3: "still", 0: "in_vehicle", 72: "sleeping", 58: "treadmill", 80: "strength_training", 35: "hiking"}


def google_fit(name: str, raw: bytes) -> Iterator[Record]:
    for p in _json(raw).get("Data Points", []):
        if p.get("startTimeNanos") is None:
            continue
        kind = p.get("dataTypeName") or "unknown"
        values = [next((x["value"][k] for k in ("fpVal", "intVal", "stringVal") if k in (x.get("value") or {})), None) for x in p.get("fitValue") or []]
        value = values[0] if len(values) == 1 else values or None
        metric = kind.removeprefix("com.google.")
        shown = _SEGMENTS.get(value, f"activity_type_{value}") if kind.endswith("activity.segment") and isinstance(value, int) else str(value)
        exercise = kind.endswith(("activity.segment", "workout", "activity.exercise"))
        yield {"schema_type": "ExerciseAction" if exercise else "Observation", "raw_hash": sha("google-fit", metric, p["startTimeNanos"], shown), "date": _iso(int(p["startTimeNanos"]) / 1e9), "date_end": _iso(int(p["endTimeNanos"]) / 1e9) if p.get("endTimeNanos") else None, "kind": metric, "value": _number(value), "body_text": shown}


def spotify(name: str, raw: bytes) -> Iterator[Record]:
    data = _json(raw)
    for e in data if isinstance(data, list) else [data]:
        get = lambda k: str(e.get(k) or "")  # noqa: B023, E731
        pairs = (("music", get("master_metadata_track_name"), get("master_metadata_album_artist_name")), ("podcast", get("episode_name"), get("episode_show_name")), ("audiobook", get("audiobook_title"), get("audiobook_chapter_title")))
        kind, what, by = next(((k, a, b) for k, a, b in pairs if a), ("", "", ""))
        if not e.get("ts") or not what:
            continue
        uri = get("spotify_track_uri") or get("spotify_episode_uri") or get("audiobook_uri") or what
        yield {"schema_type": "ListenAction", "raw_hash": sha("spotify", e["ts"], uri, e.get("ms_played")), "date": e["ts"], "subject": f"{what} — {by}" if by else what, "kind": kind, "sender_name": (what if kind == "audiobook" else by) or None, "value": _number(e.get("ms_played")), "url": uri, "extra": {"album": get("master_metadata_album_album_name"), "skipped": str(bool(e.get("skipped"))).lower()}}


def goodreads(name: str, raw: bytes) -> Iterator[Record]:
    for r in _rows(raw):
        low = {k.lower(): v for k, v in r.items()}
        if title := low.get("title"):
            isbn = re.sub(r'[="]', "", low.get("isbn", ""))
            yield {"schema_type": "Book", "raw_hash": sha("goodreads", isbn, low.get("publisher", ""), title), "subject": title, "sender_name": low.get("author") or low.get("publisher") or None, "date": low.get("date read") or low.get("date added"), "value": _number(low.get("my rating")), "extra": {"isbn": isbn}}


def _point(text: object) -> tuple[float | None, float | None]:
    m = re.search(r"([+-]?\d+\.?\d*)[^\d,]*,\s*([+-]?\d+\.?\d*)", str(text or ""))
    return (float(m[1]), float(m[2])) if m else (None, None)


def timeline(name: str, raw: bytes) -> Iterator[Record]:
    """Visits, activities, and every waypoint of paths, timed by its offset in minutes."""
    for r in _json(raw):
        span = {"date": r.get("startTime"), "date_end": r.get("endTime")}
        if "visit" in r:
            top = (r["visit"] or {}).get("topCandidate") or {}
            lat, lon = _point(top.get("placeLocation"))
            yield {**span, "schema_type": "Place", "kind": "visit", "raw_hash": sha("google-timeline", "visit", *span.values(), top.get("placeID") or "", top.get("placeLocation") or ""), "subject": top.get("semanticType") or "Unknown", "lat": lat, "lon": lon, "thread_key": top.get("placeID")}
        elif "activity" in r:
            act = r["activity"] or {}
            kind = (act.get("topCandidate") or {}).get("type") or "unknown"
            lat, lon = _point(act.get("start"))
            yield {**span, "schema_type": "TravelAction", "kind": kind, "raw_hash": sha("google-timeline", "activity", *span.values(), kind, act.get("start") or "", act.get("end") or "", act.get("distanceMeters") or ""), "value": _number(act.get("distanceMeters")), "lat": lat, "lon": lon}
        elif "timelinePath" in r:
            key = sha("google-timeline", "timelinepath", *span.values(), f"points={len(r['timelinePath'])}")
            for i, p in enumerate(r["timelinePath"]):
                lat, lon = _point(p.get("point"))
                if lat is None:
                    continue
                minutes, at = _number(p.get("durationMinutesOffsetFromStartTime")), None
                if minutes is not None and r.get("startTime"):
                    at = (datetime.fromisoformat(r["startTime"].replace("Z", "+00:00")) + timedelta(minutes=minutes)).isoformat()
                yield {"schema_type": "GeoShape", "kind": "waypoint", "raw_hash": sha(key, i), "thread_key": key, "date": at or r.get("startTime"), "lat": lat, "lon": lon}


_AMAZON = {"Retail.OrderHistory": ("OrderAction", "Order Date"), "Digital-Ordering": ("OrderAction", "OrderDate"), "Retail.CartItems": ("Product", "DateAddedToCart"), "Reviews": ("Review", "Review Date"), "WatchEvent": ("WatchAction", "Event Time"), "Search": ("SearchAction", "First Search Time"), "Subscriptions": ("Action", "SubscriptionDate"), "Returns": ("OrderAction", "CreationDate")}


def amazon(name: str, raw: bytes) -> Iterator[Record]:
    hit = next(((t, d) for k, (t, d) in _AMAZON.items() if k.lower() in name.lower()), None)
    if hit is None or not name.lower().endswith((".csv", ".json")):
        return
    rows = _rows(raw) if name.lower().endswith(".csv") else (x for x in _json(raw) if isinstance(x, dict))
    for i, r in enumerate(rows):
        title = next((r[k] for k in ("Product Name", "Title", "ProductName", "Search Terms", "ASIN") if r.get(k)), None)
        at = r.get(hit[1]) or next((v for k, v in r.items() if "date" in k.lower()), None)
        yield {"schema_type": hit[0], "raw_hash": sha("amazon", name, i, title), "date": at, "subject": title, "value": _number(r.get("Total Owed") or r.get("Price")), "extra": {k: str(v) for k, v in r.items()}}


# web


def _when(text: str) -> str | None:
    m = re.search(r"(\w{3} \d+, \d{4}),? (\d+):(\d\d):(\d\d)[\s\u202f]*([AP])M(?:[\s\u202f]+([A-Z]+))?", text)
    if not m:
        return None
    at = datetime.strptime(m[1], "%b %d, %Y") + timedelta(hours=int(m[2]) % 12 + 12 * (m[5] == "P"), minutes=int(m[3]), seconds=int(m[4]))
    hours = {"EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "UTC": 0, "GMT": 0, "CET": 1, "CEST": 2}.get(m[6] or "UTC", 0)
    return (at - timedelta(hours=hours)).replace(tzinfo=UTC).isoformat()


def activity_html(name: str, raw: bytes) -> Iterator[Record]:
    """Blocks of an activity page: searched for, watched, visited, used; the first link is what, the second by whom."""
    for i, block in enumerate(re.split(r'<div class="outer-cell', _text(raw))[1:]):
        cell = block.split("Products:")[0]
        links = re.findall(r'<a\s[^>]*?href="([^"]+)".*?>(.*?)</a>', cell)
        words = _bare(re.split(r'class="content-cell[^"]*"[^>]*>', cell, maxsplit=1)[-1])
        verb = next((v for v in ("Searched for", "Watched", "Visited", "Viewed", "Used") if words.startswith(v)), None)
        if verb is None:
            continue
        kind = {"Searched for": "SearchAction", "Watched": "WatchAction"}.get(verb, "Action")
        url, what = links[0] if links else ("", words.removeprefix(verb).split("\n")[0])
        at = _when(words)
        video = re.search(r"(?:[?&]v=|youtu\.be/)([\w\-]{11})", url)
        yield {"schema_type": kind, "raw_hash": sha("google-activity", name, i, verb, at, html.unescape(url) or _bare(what)), "date": at, "subject": _bare(what), "url": html.unescape(url) or None, "sender_name": _bare(links[1][1]) if len(links) > 1 else None, "kind": verb, "extra": {"video": video[1]} if video else {}}


def youtube_subscriptions(name: str, raw: bytes) -> Iterator[Record]:
    for r in _rows(raw):
        if ident := r.get("Channel Id"):
            yield {"schema_type": "FollowAction", "raw_hash": sha("youtube-subscription", ident), "subject": r.get("Channel Title"), "url": r.get("Channel Url"), "thread_key": ident}


def bookmarks(name: str, raw: bytes) -> Iterator[Record]:
    """Bookmarks of a CSV, a Netscape page, or a browser's JSON, with their folders."""
    text = _text(raw)
    kind = "raindrop" if name.endswith(".csv") else "netscape" if "NETSCAPE" in text[:400].upper() else "json"

    def one(url: str, title: str, at: str | None, folder: str, tags: list[str], **extra: str) -> Record:
        return {"schema_type": "BookmarkAction", "raw_hash": sha(url, kind), "date": at, "subject": title or None, "url": url, "thread_key": folder or None, "tags": tags, "kind": kind, "extra": {k: v for k, v in extra.items() if v}}

    if kind == "raindrop":
        for r in _rows(raw):
            if r.get("url"):
                yield one(r["url"], r.get("title", ""), r.get("created") or None, r.get("folder", ""), [t.strip() for t in r.get("tags", "").split(",") if t.strip()], excerpt=r.get("excerpt", ""), note=r.get("note", ""), cover=r.get("cover", ""))
    elif kind == "netscape":
        path: list[str] = []
        for m in re.finditer(r'(?is)<h3[^>]*>(.*?)</h3>|</dl>|<a ([^>]*)>(.*?)</a>', text):
            if m[1] is not None:
                path.append(_bare(m[1]))
            elif m[2] is None:
                path = path[:-1]
            else:
                a = {k.lower(): html.unescape(v) for k, v in re.findall(r'([\w-]+)="([^"]*)"', m[2])}
                if a.get("href"):
                    yield one(a["href"], _bare(m[3]), _iso(_number(a.get("add_date"))), "/".join(path), [t for t in a.get("tags", "").split(",") if t])
    else:
        todo: list[tuple[object, tuple[str, ...]]] = [(json.loads(text), ())]
        while todo:
            node, path = todo.pop()
            if isinstance(node, list):
                todo += [(x, path) for x in reversed(node)]
            elif isinstance(node, dict):
                if node.get("url"):
                    micro = _number(node.get("date_added"))
                    at = _iso(micro / 1e6 - 11_644_473_600) if micro and micro > 1e15 else node.get("date") if isinstance(node.get("date"), str) else None
                    yield one(str(node["url"]), str(node.get("name") or node.get("title") or ""), at, "/".join(path), [])
                inner = path + ((str(node.get("name") or node.get("title")),) if node.get("name") or node.get("title") else ())
                todo += [(v, inner) for v in reversed(list(node.values())) if isinstance(v, list | dict)]


def chrome_history(name: str, raw: bytes) -> Iterator[Record]:
    for r in _json(raw).get("Browser History", []):
        if r.get("url") and r.get("time_usec"):
            yield {"schema_type": "BrowseAction", "raw_hash": sha(r["url"], r["time_usec"], "chrome"), "date": _iso(r["time_usec"] / 1e6), "url": r["url"], "subject": r.get("title"), "kind": r.get("page_transition_qualifier") or r.get("page_transition")}


def session_buddy(name: str, raw: bytes) -> Iterator[Record]:
    """Saved sessions and collections of tabs; position says where in its window a tab was."""
    data = _json(raw)
    for s in data.get("history") or []:
        for w in s.get("windows") or []:
            for t in w.get("tabs") or []:
                yield {"schema_type": "SessionTab", "raw_hash": sha("session", s.get("id"), w.get("id"), t.get("url")), "date": _iso((_number(s.get("created")) or 0) / 1000), "url": t.get("url"), "subject": t.get("title"), "thread_key": str(s.get("id") or s.get("created")), "kind": s.get("type") or "history", "extra": {"active": str(bool(t.get("active"))).lower()}}
    for c in data.get("collections") or []:
        for f in c.get("folders") or []:
            for t in f.get("links") or []:
                yield {"schema_type": "SessionTab", "raw_hash": sha("collection", c.get("id"), f.get("id"), t.get("url")), "date": _iso((_number(c.get("created")) or 0) / 1000), "url": t.get("url"), "subject": t.get("title"), "thread_key": str(c.get("id") or c.get("title")), "kind": "collection"}


def facebook(name: str, raw: bytes) -> Iterator[Record]:
    """Sections of an exported page: a heading, text and a date each; the folder tells what they are."""
    folder = name.lower()
    kinds = {"messages": "Message", "posts": "SocialMediaPosting", "comments": "Comment", "likes": "LikeAction", "reactions": "LikeAction", "events": "Event", "groups": "JoinAction", "friends": "BefriendAction", "connections": "BefriendAction"}
    kind = next((t for k, t in kinds.items() if k in folder), "CreativeWork")
    text = _text(raw)
    title = _bare(next(iter(re.findall(r"(?is)<title>(.*?)</title>", text)), ""))
    for i, block in enumerate(re.split(r"(?i)<(?:h2|section)\b[^>]*>", text)[1:]):
        head, _, rest = block.partition("</h2>") if "</h2>" in block else ("", "", block)
        who, body = _bare(head), _bare(rest)
        at = re.search(r"(\w{3} \d+, \d{4},? \d+(?::\d\d)+ ?[apAP][mM])\s*$", body)
        if not (who or body):
            continue
        said = body[: at.start()].strip() if at else body
        yield {"schema_type": kind, "raw_hash": sha("facebook", name, i, at[1] if at else None, who, said[:100]), "date": at[1] if at else None, "sender_name": who or None, "subject": title or None, "body_text": said, "thread_key": title or name}


# databases


def _open(raw: bytes) -> sqlite3.Connection:
    with tempfile.NamedTemporaryFile(suffix=".db", delete=False) as f:
        f.write(raw)
    db = sqlite3.connect(f"file:{f.name}?mode=ro&immutable=1", uri=True)
    db.row_factory = sqlite3.Row
    os.unlink(f.name)  # the open handle keeps it readable
    return db


#: First column that a table must have -> (schema type, seed, query). A file is read by every query that its tables allow.
_TABLES = {
    "sms": ("Message", "phone-sms", "SELECT _id AS pk, address AS who, date / 1000.0 AS at, body, type = 1 AS inbound, NULL AS title, NULL AS amount FROM sms"),
    "ZCALLRECORD": ("Action", "callhistory", "SELECT Z_PK AS pk, ZADDRESS AS who, ZDATE + 978307200 AS at, NULL AS body, NOT ZORIGINATED AS inbound, NULL AS title, ZDURATION AS amount FROM ZCALLRECORD"),
    "voicemail": ("Action", "voicemail", "SELECT ROWID AS pk, sender AS who, date AS at, NULL AS body, 1 AS inbound, NULL AS title, duration AS amount FROM voicemail"),
    "history_visits": ("BrowseAction", "safari", "SELECT v.id AS pk, i.url AS who, v.visit_time + 978307200 AS at, NULL AS body, NULL AS inbound, v.title AS title, NULL AS amount FROM history_visits v JOIN history_items i ON i.id = v.history_item"),
    "message": ("Message", "imessage", "SELECT m.ROWID AS pk, h.id AS who, CASE WHEN m.date > 1e12 THEN m.date / 1e9 ELSE m.date END + 978307200 AS at, m.text AS body, NOT m.is_from_me AS inbound, NULL AS title, NULL AS amount FROM message m LEFT JOIN handle h ON h.ROWID = m.handle_id"),
    "samples": ("Observation", "health-sample", "SELECT s.data_id AS pk, s.data_type AS who, s.start_date + 978307200 AS at, NULL AS body, NULL AS inbound, s.data_type AS title, q.quantity AS amount FROM samples s LEFT JOIN quantity_samples q ON q.data_id = s.data_id"),
}


def database(name: str, raw: bytes) -> Iterator[Record]:
    """Calls, messages, visits, notes, samples and sets of the SQLite files that phones keep."""
    if raw[:15] != b"SQLite format 3":
        return
    db = _open(raw)
    have = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view')")}
    for table, (kind, seed, sql) in _TABLES.items():
        if table not in have:
            continue
        for r in db.execute(sql):
            who = phone(str(r["who"])) if kind in ("Message", "Action") and r["who"] else r["who"]
            way = None if r["inbound"] is None else "inbound" if r["inbound"] else "outbound"
            yield {"schema_type": kind, "raw_hash": sha(seed, r["pk"]), "date": _iso(r["at"]), "sender_address": None if who is None else str(who), "direction": way, "body_text": r["body"], "subject": None if r["title"] is None else str(r["title"]), "value": _number(r["amount"]), "url": str(r["who"]) if kind == "BrowseAction" else None, "kind": seed}
    if "ZICNOTEDATA" in have:
        for r in db.execute("SELECT d.Z_PK AS pk, d.ZDATA AS body, o.ZTITLE1 AS title, o.ZMODIFICATIONDATE1 + 978307200 AS at FROM ZICNOTEDATA d LEFT JOIN ZICCLOUDSYNCINGOBJECT o ON o.ZNOTEDATA = d.Z_PK"):
            yield {"schema_type": "DigitalDocument", "raw_hash": sha("apple-notes", r["pk"]), "date": _iso(r["at"]), "subject": r["title"], "body_text": note_body(r["body"]), "kind": "apple-notes"}
    if {"ZWORKOUT", "ZSET"} <= have:
        for r in db.execute("SELECT s.Z_PK AS pk, w.ZDATE + 978307200 AS at, w.ZNAME AS title, s.ZEXERCISE AS exercise, s.ZWEIGHT AS kg, s.ZREPS AS reps, row_number() OVER (PARTITION BY w.Z_PK ORDER BY s.ZORDER, s.Z_PK) AS n FROM ZSET s JOIN ZWORKOUT w ON w.Z_PK = s.ZWORKOUT"):
            yield {"schema_type": "ExerciseAction", "raw_hash": sha(f"strong:{r['pk']}:set:{r['n']}"), "date": _iso(r["at"]), "subject": r["title"], "kind": str(r["exercise"]), "value": pounds(r["kg"]), "extra": {"set": str(r["n"]), "reps": str(r["reps"])}}
    db.close()


def pounds(kg: float | None) -> float | None:
    """Pounds to the nearest half; None for none or nothing."""
    return round(kg * 2.2046226218 * 2) / 2 if kg else None


def _fields(raw: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(number, wire type, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, kind, varint()
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield tag >> 3, kind, raw[at : at + n]
            at += n
        elif kind == 2:
            n = varint()
            yield tag >> 3, kind, raw[at : at + n]
            at += n
        else:
            return


def note_body(raw: bytes | None) -> str | None:
    """The text of a note: gzip around a document around a note around its text."""
    try:
        now = gzip.decompress(raw or b"")
        for number in (2, 3, 2):
            now = next(v for n, k, v in _fields(now) if n == number and k == 2)
        return _text(now, "utf-8")
    except (OSError, EOFError, StopIteration, IndexError):
        return None


# documents and notes


def front_matter(text: str) -> tuple[dict[str, list[str]], str]:
    """(values by key, body) of a note with a block of keys between '---' lines; a value alone is a list of one."""
    m = re.match(r"\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)(.*)\Z", text, re.S)
    if not m:
        return {}, text
    out: dict[str, list[str]] = {}
    key = None
    bare = lambda s: s.strip().strip("'\"")
    for line in m[1].splitlines():
        if key and (item := re.match(r"\s*-\s+(.*)$", line)):
            out[key].append(bare(item[1]))
        elif pair := re.match(r"([\w@.\- :]+?):(?:\s+(.*))?$", line):
            key, value = pair[1].strip(), (pair[2] or "").strip()
            if re.fullmatch(r"\[(?!\[).*\]", value):
                out[key] = [bare(x) for x in value[1:-1].split(",") if x.strip()]
            else:
                out[key] = [bare(value)] if value else []
    return out, m[2]


def markdown(name: str, raw: bytes) -> Iterator[Record]:
    """A note: its @type, dates, tags and body; keys become extra."""
    meta, body = front_matter(_text(raw))
    one = lambda *keys: next((meta[k][0] for k in keys if meta.get(k)), None)
    fence = re.findall(r"(?s)```[^\n]*\n(.*?)```", body)
    title = one("title", "name") or re.sub(r"\.md$", "", name.rsplit("/", 1)[-1])
    year = re.match(r"\d{4}", one("temporalCoverage") or "")
    at = one("date", "datePublished", "created", "captured") or (f"{year[0]}-01-01" if year else None)
    tags = [t.lstrip("#") for k in ("tags", "keywords", "categories") for t in meta.get(k, [])]
    isbn = re.search(r"\b97[89][\d\-]{10,14}\b", f"{one('isbn') or ''} {body}")
    yield {"schema_type": one("@type", "type") or "CreativeWork", "raw_hash": sha("markdown", name, len(raw)), "date": at, "subject": title, "body_text": "\n".join(fence).strip() if fence and one("staged") else re.sub(r"\A\s*#[^\n]*\n", "", body).strip(), "url": one("url", "source"), "tags": list(dict.fromkeys(tags)), "extra": {**{k: json.dumps(v) for k, v in meta.items()}, **({"isbn": isbn[0].replace("-", "")} if isbn else {})}}


def _office(raw: bytes, pick: str, tag: str) -> str:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        parts = [z.read(n) for n in sorted(z.namelist()) if re.fullmatch(pick, n)]
    paragraphs = [re.findall(rb"(?s)<(?:\w+:)?%s(?: [^>]*)?>(.*?)</(?:\w+:)?%s>" % (tag.encode(), tag.encode()), p) for part in parts for p in re.split(rb"</(?:\w+:)?(?:p|row|si)>", part)]
    return "\n".join(html.unescape(b"".join(p).decode("utf-8", "replace")) for p in paragraphs if p)


def _pdf(raw: bytes) -> str:
    """Text of plain and deflated streams: strings that are shown, without fonts' own encodings."""
    import zlib

    out = []
    for m in re.finditer(rb"(?s)stream\r?\n(.*?)\r?\nendstream", raw):
        try:
            data = zlib.decompress(m[1])
        except zlib.error:
            data = m[1]
        for block in re.findall(rb"(?s)\bBT\b(.*?)\bET\b", data):
            out.append(b"".join(re.findall(rb"\(((?:\\.|[^\\()])*)\)", block)).decode("latin-1"))
    return "\n".join(re.sub(r"\\(.)", r"\1", t) for t in out if t.strip())


def extract(name: str, raw: bytes) -> str | None:
    """The text of a document by its suffix; None for one that isn't known."""
    kind = name.lower().rpartition(".")[2]
    if kind == "docx":
        return _office(raw, r"word/document\.xml", "t")
    if kind == "xlsx":
        return _office(raw, r"xl/(?:sharedStrings|worksheets/.*)\.xml", "t")
    if kind == "pdf":
        return _pdf(raw)
    text = _text(raw)
    if kind in ("html", "htm"):
        return _bare(text)
    if kind == "ipynb":
        return "\n\n".join("".join(c.get("source", [])) for c in json.loads(text).get("cells", []))
    if kind == "rtf":
        cut = re.sub(r"\\par[d]?\b ?", "\n", re.sub(r"(?s)\{\\(?:fonttbl|colortbl|stylesheet|\*).*?\}", "", text))
        return re.sub(r"\\[a-z]+-?\d* ?|[{}]", "", re.sub(r"\\'([0-9a-f]{2})", lambda m: bytes.fromhex(m[1]).decode("latin-1"), cut)).strip()
    return text if kind in ("txt", "md", "csv", "json", "log", "tsv", "yaml", "yml") else None


def document(name: str, raw: bytes) -> Iterator[Record]:
    body = extract(name, raw)
    if body is not None:
        yield {"schema_type": "DigitalDocument", "raw_hash": sha("document", name, len(body)), "subject": name.rsplit("/", 1)[-1], "body_text": body, "kind": name.rpartition(".")[2].lower(), "thread_key": name.rpartition("/")[0] or None}


def photo(name: str, raw: bytes) -> Iterator[Record]:
    """A picture, dated by its EXIF block, else by its name."""
    exif = re.search(rb"(\d{4}):(\d\d):(\d\d) (\d\d):(\d\d):(\d\d)\x00", raw[:65_536])
    named = re.search(r"(20\d\d|19\d\d)[-_]?(\d\d)[-_]?(\d\d)(?:[-_ ]?(\d\d)[-_.]?(\d\d)[-_.]?(\d\d))?", name.rsplit("/", 1)[-1])
    got = [g.decode() for g in exif.groups()] if exif else [g or "00" for g in named.groups()] if named else None
    at = f"{got[0]}-{got[1]}-{got[2]}T{got[3]}:{got[4]}:{got[5]}" if got else None
    yield {"schema_type": "Photograph", "raw_hash": sha("phone-camera", name, len(raw)), "date": at, "subject": name.rsplit("/", 1)[-1], "value": float(len(raw)), "extra": {"dated_by": "exif" if exif else "name" if named else "none"}}


def git_log(name: str, raw: bytes) -> Iterator[Record]:
    """Changed files of `git log --raw --format='commit %H %aI %ae'`."""
    sha1 = at = who = None
    for line in _text(raw).splitlines():
        if m := re.match(r"commit ([0-9a-f]{7,40}) (\S+) (\S*)", line):
            sha1, at, who = m.groups()
        elif (m := re.match(r":\d+ \d+ (\S+) (\S+) ([A-Z])\d*\t([^\t]+)(?:\t(.+))?$", line)) and sha1:
            kind = {"A": "add", "D": "delete", "M": "modify", "R": "rename", "C": "copy"}.get(m[3], "modify")
            yield {"schema_type": "FileRevision", "raw_hash": sha(sha1, m[5] or m[4]), "date": at, "kind": kind, "subject": m[5] or m[4], "sender_address": who, "thread_key": sha1, "extra": {"blob": m[2], **({"old_path": m[4]} if m[5] else {})}}


def writing_deltas(name: str, raw: bytes) -> Iterator[Record]:
    """Events of a writing session, a JSON object a line; a last line cut off is noted as an error."""
    lines = _text(raw).splitlines()
    for i, line in enumerate(lines):
        if not line.strip():
            continue
        try:
            e = json.loads(line)
        except json.JSONDecodeError:
            yield {"schema_type": "Error", "raw_hash": sha(line), "body_text": "partial line" if i == len(lines) - 1 else "malformed line"}
            continue
        yield {"schema_type": "WritingDelta", "raw_hash": sha(line), "date": _iso((_number(e.get("ts")) or 0) / 1000), "kind": e.get("type"), "role": e.get("userEvent"), "thread_key": e.get("sessionId"), "subject": e.get("notePath"), "body_text": e.get("insertedText"), "value": _number(e.get("ts")), "extra": {k: str(e[k]) for k in ("deletedText", "fromA", "toA", "fromB", "toB", "reason", "noteType", "vaultFolder") if e.get(k) is not None}}
