"""Streams driven to their end from files."""

import json

import pytest

from tessera.streaming import ingest


def write(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def row(session, ts, seq=1, **k):
    return {"session_id": session, "note_path": "n", "ts": ts, "seq": seq, "event_type": "change", "user_event": "x", "inserted": 1, "deleted": 0, **k}


def test_watched_files_come_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("x")
    seen = []
    run = lambda: ingest.watched(spark, str(tmp_path / "in"), lambda p, _: seen.append([x.rsplit("/", 1)[-1] for x in p]), str(tmp_path / "c"), "*.md").awaitTermination()
    run()
    (tmp_path / "in/b.md").write_text("y")
    (tmp_path / "in/c.txt").write_text("y")
    run()
    run()
    assert seen == [["a.md"], ["b.md"]]


def test_sessions_close_and_take_late_starts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    minute = 60_000
    write(tmp_path / "in/1.json", [row("s", 40 * minute), row("s", 45 * minute, 2)])
    (tmp_path / "in/2.json").write_text(json.dumps(row("s", 35 * minute, 0)) + '\n{"session_id": ')
    write(tmp_path / "in/3.json", [row("t", 500 * minute)])
    q = ingest.sessions(ingest.deltas(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    write(tmp_path / "in/4.json", [row("u", 2000 * minute)])
    got = {r.session_id: (r.started_at // minute, r.ended_at // minute, r.events) for r in spark.table("closed").collect()}
    assert got == {"s": (35, 45, 3)}


def test_repeats_and_rates(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in/1.json", [row("s", 1), row("s", 1), row("s", 2, 2), row("s", 3, 3, event_type="selection")])
    rows = ingest.deltas(spark, str(tmp_path / "in"))
    for name, df, mode in (("once", ingest.without_repeats(rows, ["session_id", "seq"]), "append"), ("rates", ingest.rates(rows), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == 3
    assert {r.event_type: r.n for r in spark.table("rates").collect()} == {"change": 3, "selection": 1}


def test_intervals():
    assert [ingest.seconds_of(x) for x in ("15m", "1h", "weekly", "2d", "9s")] == [900, 3600, 604_800, 172_800, 9]
    for bad in ("", "m", "1w", "x1h"):
        with pytest.raises(ValueError):
            ingest.seconds_of(bad)
