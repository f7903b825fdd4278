"""Parsers on small inputs of their formats."""

import gzip
import io
import json
import sqlite3
import zipfile

from tessera.sources import parsers as p
from tessera.sources import registry

MBOX = b"""From a@x.org Thu Jan  1 00:00:00 2015
From: Ann <Ann@X.org>
To: bob@y.org, Cy <cy@z.org>
Subject: =?utf-8?q?caf=C3=A9?=
Date: Thu, 01 Jan 2015 10:00:00 +0100
Message-ID: <1@x>

Hello
>From here

From news@x.org Thu Jan  1 00:00:00 2015
From: newsletter@x.org
Message-ID: <2@x>
List-Id: <l>
Date: bad

x
"""


def rows(parser, name, raw, **k):
    return list(parser(name, raw if isinstance(raw, bytes) else raw.encode(), **k))


def test_mbox():
    a, b = rows(p.mbox, "m.mbox", MBOX, own=frozenset({"ann@x.org"}))
    assert (a["sender_address"], a["subject"], a["direction"], a["recipients"], a["date"]) == ("ann@x.org", "café", "outbound", ["bob@y.org", "cy@z.org"], "2015-01-01T10:00:00+01:00")
    assert "From here" in a["body_text"] and not a["is_bulk"]
    assert b["is_bulk"] and b["extra"]["bulk_signal"] == "List-Id" and b["date"] is None


def test_direction():
    own = frozenset({"me"})
    assert [p.direction(*x) for x in (("me", ["you"], own), ("you", ["me"], own), ("me", ["me"], own), ("", [], own), ("me", [], frozenset()))] == ["outbound", "inbound", "self", "unknown", "unknown"]


def test_sms_and_calls():
    xml = '<smses><sms address="(555) 010-0000~5550100001" date="0" type="1" body="hi" contact_name="Al"/><sms address="1" date="1" type="2" body="null"/><mms address="5550100000" date="1000" msg_box="2"><parts><part ct="text/plain" text="yo"/><part ct="image/png"/></parts></mms><call number="5550100000" date="2000" type="3" duration="0"/></smses>'
    a, b, c = rows(p.sms_xml, "x", xml)
    assert (a["sender_address"], a["direction"], a["recipients"], a["date"]) == ("+15550100000", "inbound", ["+15550100001"], "1970-01-01T00:00:00+00:00")
    assert (b["body_text"], b["direction"], b["extra"]["attachments"]) == ("yo", "outbound", "1")
    assert (c["kind"], c["direction"]) == ("missed", "inbound")


def test_chat_and_discord():
    a, b = rows(p.chat_log, "2003-04-05 al.txt", "[10:01] Al: hello\nmore\n[10:02] Bo: bye")
    assert (a["date"], a["body_text"], b["sender_name"]) == ("2003-04-05 10:01", "hello\nmore", "Bo")
    (m,) = rows(p.discord, "c.json", json.dumps({"channel": {"id": "9", "name": "general"}, "messages": [{"id": "1", "content": "x", "timestamp": "t", "author": {"id": "5", "name": "N"}}, {"id": "2", "content": ""}]}))
    assert (m["thread_key"], m["sender_address"]) == ("general", "5")


def test_message_html():
    page = '<div><i class="timestamp">Jan 1</i><b class="sender">Me</b><span class="message">one &amp; two</span></div><div><span class="timestamp">Jan 2</span><span class="sender">+1 (555) 010-0000</span><span class="message">three</span></div>'
    a, b = rows(p.message_html, "Al & Bo.html", page)
    assert (a["direction"], a["body_text"], b["sender_address"], a["extra"]["group"]) == ("outbound", "one & two", "+15550100000", "true")


def test_sessions_and_assistant():
    turn = lambda who, n, said, **more: {"type": who, "uuid": n, "message": dict(content=said), **more}
    part = lambda kind, **more: dict(type=kind, **more)
    lines = [turn("user", "1", "q", sessionId="s"), turn("assistant", "2", [part("tool_use", name="t")]), turn("user", "3", [part("tool_result")]), turn("assistant", "4", [part("thinking", thinking="h")]), turn("assistant", "5", "z", isSidechain=True)]
    got = rows(p.session_jsonl, "f.jsonl", "\n".join(map(json.dumps, lines)) + "\n{bad")
    assert [g["kind"] for g in got] == ["message", "tool_use", "tool_result", "sidechain", "sidechain"]
    assert {g["thread_key"] for g in got} == {"s"}
    (m,) = rows(p.assistant_export, "c.json", json.dumps([{"uuid": "c", "name": "n", "chat_messages": [{"uuid": "m", "sender": "human", "text": "hey"}]}]))
    assert (m["role"], m["body_text"], m["subject"]) == ("user", "hey", "n")


def test_people_and_calendar():
    (v,) = rows(p.vcard, "Friends/a.vcf", "BEGIN:VCARD\nFN:An\n  n\nEMAIL;TYPE=x:A@B.c\nTEL:(1) 2-3\nEND:VCARD\nBEGIN:VCARD\nORG:x\nEND:VCARD")
    assert (v["sender_name"], v["sender_address"], v["recipients"]) == ("An n", "a@b.c", ["a@b.c", "123"])
    (e,) = rows(p.ical, "c.ics", "BEGIN:VCALENDAR\r\nX-WR-CALNAME:Home\r\nBEGIN:VEVENT\r\nUID:1\r\nDTSTART;VALUE=DATE:20200102\r\nSUMMARY:a\\, b\r\n  c\r\nEND:VEVENT\r\nEND:VCALENDAR")
    assert (e["date"], e["subject"], e["extra"]["all_day"], e["extra"]["calendar"]) == ("2020-01-02", "a, b c", "true", "Home")


def test_health():
    a, b = rows(p.apple_health, "e.xml", '<HealthData><Record type="HKQuantityTypeIdentifierHeartRate" startDate="d" value="60" unit="bpm"><x><InstantaneousBeatsPerMinute bpm="61.7"/></x></Record><Workout workoutActivityType="HKWorkoutActivityTypeRunning" duration="30"/></HealthData>')
    assert (a["subject"], a["value"], a["extra"]["heart_rate_samples"]) == ("HeartRate: 60 bpm", 60.0, "[61]")
    assert b["body_text"] == "Running | duration 30"
    (g,) = rows(p.apple_health, "r.gpx", '<gpx xmlns="http://x"><trk><trkseg><trkpt lat="1.5" lon="-2"><time>t</time></trkpt></trkseg></trk></gpx>')
    assert (g["lat"], g["lon"]) == (1.5, -2.0)
    f = rows(p.google_fit, "f.json", json.dumps({"Data Points": [{"dataTypeName": "com.google.activity.segment", "startTimeNanos": 10**18, "fitValue": [dict(value=dict(intVal=8))]}, {"dataTypeName": "com.google.weight", "startTimeNanos": 1, "fitValue": [{"value": {"fpVal": 70.5}}]}, {"x": 1}]}))
    assert [(x["schema_type"], x["body_text"]) for x in f] == [("ExerciseAction", "running"), ("Observation", "70.5")]
    assert (p.pounds(100), p.pounds(0), p.pounds(None)) == (220.5, None, None)


def test_media_and_places():
    got = rows(p.spotify, "s.json", json.dumps([{"ts": "1", "master_metadata_track_name": "T", "master_metadata_album_artist_name": "A", "ms_played": 5}, {"ts": "2", "episode_name": "E"}, {"ts": "3"}]))
    assert [(g["subject"], g["kind"]) for g in got] == [("T — A", "music"), ("E", "podcast")]
    (b,) = rows(p.goodreads, "g.csv", "\ufeffTitle,ISBN,My Rating\nBook,\"=\"\"978\"\"\",4\n,,\n")
    assert (b["subject"], b["extra"]["isbn"], b["value"]) == ("Book", "978", 4.0)
    began = "2020-01-01T00:00:00Z"
    t = rows(p.timeline, "t.json", json.dumps([dict(startTime=began, visit=dict(topCandidate=dict(semanticType="Home", placeLocation="geo:1.5,2.5"))), dict(startTime=began, timelinePath=[dict(point="geo:3,4", durationMinutesOffsetFromStartTime="5"), dict(point="x")])]))
    assert (t[0]["lat"], t[0]["lon"]) == (1.5, 2.5) and t[1]["date"] == "2020-01-01T00:05:00+00:00" and len(t) == 2
    (o,) = rows(p.amazon, "Retail.OrderHistory.1.csv", "Order Date,Product Name,Total Owed\n2020,Cup,3.5\n")
    assert (o["schema_type"], o["subject"], o["date"]) == ("OrderAction", "Cup", "2020")


def test_web():
    page = '<div class="outer-cell x"><div class="content-cell y">Searched for <a href="https://g.com/search?q=a">a b</a><br>Jan 2, 2020, 1:02:03 PM EST</div></div><div class="outer-cell"><div class="content-cell">Watched <a href="https://youtu.be/abcdefghijk">V</a><br><a href="https://y.com/c">Chan</a><br>Jan 2, 2020, 12:00:00 AM UTC</div></div>'
    a, b = rows(p.activity_html, "MyActivity.html", page)
    assert (a["schema_type"], a["subject"], a["date"]) == ("SearchAction", "a b", "2020-01-02T18:02:03+00:00")
    assert (b["extra"]["video"], b["sender_name"], b["date"]) == ("abcdefghijk", "Chan", "2020-01-02T00:00:00+00:00")
    n = rows(p.bookmarks, "b.html", '<!DOCTYPE NETSCAPE-Bookmark-file-1><DL><DT><H3>F</H3><DL><DT><A HREF="https://a" ADD_DATE="0">A</A></DL><DT><A HREF="https://b">B</A></DL>')
    assert [(x["url"], x["thread_key"]) for x in n] == [("https://a", "F"), ("https://b", None)]
    j = rows(p.bookmarks, "Bookmarks.json", json.dumps({"roots": {"bar": {"name": "Bar", "children": [{"name": "S", "children": [{"name": "x", "url": "https://x", "date_added": str(11644473600 * 10**6)}]}]}}}))
    assert [(x["url"], x["thread_key"], x["date"]) for x in j] == [("https://x", "Bar/S", "1970-01-01T00:00:00+00:00")]
    (h,) = rows(p.chrome_history, "h.json", json.dumps({"Browser History": [{"url": "u", "time_usec": 1_000_000}, {"url": ""}]}))
    assert h["date"] == "1970-01-01T00:00:01+00:00"
    assert len(rows(p.session_buddy, "s.json", json.dumps({"history": [{"id": 1, "created": 0, "windows": [{"tabs": [{"url": "a"}, {"url": "b"}]}]}], "collections": [{"folders": [{"links": [{"url": "c"}]}]}]}))) == 3
    assert rows(p.youtube_subscriptions, "s.csv", "Channel Id,Channel Url,Channel Title\nUC1,u,t\n")[0]["thread_key"] == "UC1"
    assert rows(p.facebook, "posts/1.html", "<title>T</title><section><h2>Al</h2><div>said</div><div>Jan 2, 2020, 1:02 PM</div></section>")[0]["body_text"] == "said"


def test_database(tmp_path):
    path = tmp_path / "x.db"
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE sms (_id, address, date, body, type)")
    db.execute("INSERT INTO sms VALUES (1, '5550100000', 1000, 'hi', 1)")
    db.execute("CREATE TABLE ZICNOTEDATA (Z_PK, ZDATA)")
    db.execute("CREATE TABLE ZICCLOUDSYNCINGOBJECT (ZNOTEDATA, ZTITLE1, ZMODIFICATIONDATE1)")
    inner = b"\x12\x03abc"
    for _ in range(2):
        inner = (b"\x1a" if inner[:2] == b"\x12\x03" and len(inner) == 5 else b"\x12") + bytes([len(inner)]) + inner
    db.execute("INSERT INTO ZICNOTEDATA VALUES (1, ?)", (gzip.compress(inner),))
    db.execute("INSERT INTO ZICCLOUDSYNCINGOBJECT VALUES (1, 'N', 0)")
    db.commit()
    db.close()
    a, b = rows(p.database, "x.db", path.read_bytes())
    assert (a["sender_address"], a["direction"], a["date"]) == ("+15550100000", "inbound", "1970-01-01T00:00:01+00:00")
    assert (b["body_text"], b["date"]) == ("abc", "2001-01-01T00:00:00+00:00")


def test_documents_and_notes():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as w:
        w.writestr("word/document.xml", "<w:document><w:p><w:t>a &amp;</w:t><w:t xml:space='preserve'> b</w:t></w:p><w:p><w:t>c</w:t></w:p></w:document>")
    assert p.extract("d.docx", z.getvalue()) == "a & b\nc"
    assert p.extract("d.html", b"<p>x<br>y</p><script>no</script>") == "x\ny"
    assert p.extract("d.ipynb", json.dumps({"cells": [{"source": ["a", "b"]}]}).encode()) == "ab"
    assert p.extract("d.rtf", rb"{\rtf1{\fonttbl x}a\par b\'e9}") == "a\nbé"
    assert p.extract("d.pdf", b"stream\nBT (ab) Tj (c\\)) Tj ET\nendstream") == "abc)"
    assert p.extract("d.bin", b"x") is None
    meta, body = p.front_matter("---\na: 'x'\nb:\n  - 1\n  - 2\nc: [p, q]\nd:\n---\nrest")
    assert (meta, body) == ({"a": ["x"], "b": ["1", "2"], "c": ["p", "q"], "d": []}, "rest")
    (m,) = rows(p.markdown, "n.md", "---\n\"@type\": Book\ntags: [a, '#b']\ntemporalCoverage: 1999/2000\n---\n# Head\nText 978-0-00-000000-2")
    assert (m["tags"], m["date"], m["body_text"].startswith("Text"), m["extra"]["isbn"]) == (["a", "b"], "1999-01-01", True, "9780000000002")
    assert rows(p.photo, "IMG_20200102_030405.jpg", b"x")[0]["date"] == "2020-01-02T03:04:05"
    a, b = rows(p.git_log, "l", "commit abcdef1 2020-01-01T00:00:00Z a@b\n:100644 100644 1111 2222 M\tf\n:100644 100644 1111 2222 R100\told\tnew")
    assert (a["kind"], b["kind"], b["subject"], b["extra"]["old_path"]) == ("modify", "rename", "new", "old")
    w = rows(p.writing_deltas, "d.ndjson", '{"ts": 5, "type": "change", "sessionId": "s"}\n{"ts"')
    assert (w[0]["value"], w[1]["body_text"]) == (5.0, "partial line")


def test_read_and_ingest(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Title,ISBN\nOne,1\nTwo,2\nOne,1\n")
    with zipfile.ZipFile(tmp_path / "z.csv", "w") as z:
        z.writestr("in.csv", "Title,ISBN\nThree,3\n")
    got = registry.ingest(spark, "goodreads", str(tmp_path))
    assert sorted(r.subject for r in got.collect()) == ["One", "Three", "Two"]
    assert registry.ingest(spark, "goodreads", str(tmp_path), got).count() == 0
    (tmp_path / "bad.json").write_text("{")
    assert [r.schema_type for r in registry.read(spark, "chrome_history", str(tmp_path)).collect()] == ["Error"]
    assert registry.invalid(registry.SOURCES) == []


def test_broken_files_are_rows(spark, tmp_path):
    db = tmp_path / "ok.sqlite"
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE sms (_id, address, date, body, type)")
        c.executemany("INSERT INTO sms VALUES (?, '5550100000', ?, ?, 1)", [(i, 1000.0 * i, "x" * 500) for i in range(200)])
    (tmp_path / "cut.sqlite").write_bytes(db.read_bytes()[:20_000])
    (tmp_path / "far.sqlite").write_bytes(b"")
    with sqlite3.connect(tmp_path / "far.sqlite") as c:
        c.execute("CREATE TABLE sms (_id, address, date, body, type)")
        c.execute("INSERT INTO sms VALUES (1, '5550100000', 1e23, 'x', 1)")
    (tmp_path / "torn.zip").write_bytes(b"PK\x03\x04 and nothing more")
    got = registry.read(spark, "phone_sms", str(tmp_path))
    wrong = {r.source_path.rsplit("/", 1)[-1]: r.what for r in registry.errors(got).collect()}
    assert set(wrong) == {"cut.sqlite", "far.sqlite", "torn.zip"} and "BadZipFile" in wrong["torn.zip"] and "DatabaseError" in wrong["cut.sqlite"]
    assert got.where("schema_type = 'Message' and source_path like '%ok.sqlite'").count() == 200


def test_mailbox_is_read_by_many_tasks(spark, tmp_path):
    def mail(i, body):
        return f"From a@x.org Thu Jan  1 00:00:00 2015\nFrom: a{i}@x.org\nMessage-ID: <{i}@x>\nSubject: s{i}\n\n{body}\n\n".encode()

    box = tmp_path / "all.mbox"
    box.write_bytes(b"".join(mail(i, f"body {i} \xe9" * 50 if i else "y" * 300_000) for i in range(400)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        got = registry.read(spark, "mbox", str(tmp_path))
        assert got.rdd.getNumPartitions() > 8
        rows_ = got.select("sender_address", "body_text", "raw_hash", "position").collect()
        assert sorted(r.sender_address for r in rows_) == sorted(f"a{i}@x.org" for i in range(400)) and len({r.position for r in rows_}) > 4
        assert max(len(r.body_text) for r in rows_) >= 300_000
        assert {r.raw_hash for r in rows_} == {r["raw_hash"] for r in p.mbox("all.mbox", box.read_bytes())}
        stored, size = registry.ingest(spark, "mbox", str(tmp_path)).cache(), box.stat().st_size
        assert stored.count() == 400
        with box.open("ab") as f:
            f.write(mail(400, "later") + mail(401, "last"))
        new = registry.ingest(spark, "mbox", str(tmp_path), stored, after=size)
        assert sorted(r.sender_address for r in new.collect()) == ["a400@x.org", "a401@x.org"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sources_are_described():
    import sys
    import types

    import pytest

    assert {m["name"] for m in registry.manifest()} == set(registry.SOURCES) and [m["name"] for m in registry.manifest() if m["splittable"]] == ["mbox"]
    sys.modules["more_sources"] = types.SimpleNamespace(SOURCES={"mine": registry.SOURCES["spotify"]})
    sys.modules["same_sources"] = types.SimpleNamespace(SOURCES={"mbox": registry.SOURCES["mbox"]})
    sys.modules["bad_sources"] = types.SimpleNamespace(SOURCES={"no name": registry.Source(None, ())})
    assert "mine" in registry.discovered(["more_sources"])
    for name in ("same_sources", "bad_sources"):
        with pytest.raises(ValueError):
            registry.discovered([name])
