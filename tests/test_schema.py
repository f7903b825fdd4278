"""Declared tables and rendered results."""

import json

import pytest
from pyspark.sql import types as T

from tessera.plans import render
from tessera.schema import catalog, specs


@pytest.mark.parametrize("name", sorted(catalog.TABLES))
def test_every_table(spark, name):
    t = catalog.TABLES[name]
    names = [f.name for f in t.fields]
    assert len(set(names)) == len(names) and set(t.key) <= set(names) and (t.date is None or t.date in names)
    assert specs.differences(t, t.struct()) == []
    assert T.StructType.fromJson(json.loads(t.struct().json())) == t.struct()
    assert t.ddl().startswith(f"CREATE TABLE IF NOT EXISTS {name} (") and "id bigint NOT NULL" in t.ddl()


def test_lookups():
    assert catalog.communication() == ["emails", "chat_messages", "conversations_messages"]
    assert [t.name for t in catalog.by_schema_type("DigitalDocument")] == ["digital_documents", "documents"]
    assert catalog.date_column("events") == "date_occurred" and catalog.date_column("nowhere") == "date_sent"
    assert {"articles", "clippings"} <= set(catalog.embeddable()) and catalog.document().count("\n") == len(catalog.TABLES) + 2


def test_differences_and_rows(spark):
    t = catalog.TABLES["session_tabs"]
    found = T.StructType([T.StructField("id", T.StringType()), T.StructField("x", T.LongType())])
    assert {(c, p) for c, p, _ in specs.differences(t, found)} == {("id", "type"), ("x", "undeclared"), ("session_id", "missing"), ("url", "missing"), ("title", "missing"), ("active", "missing"), ("created_at", "missing")}
    rows = specs.conformed(t, spark.createDataFrame([("1", 2, None), ("3", None, "u")], "id string, session_id int, url string"))
    assert [f.dataType for f in rows.schema] == [f.dataType for f in t.struct()] and rows.first().active is False
    assert {r.column: r.n for r in specs.missing_required(t, rows).collect()} == {"session_id": 1}
    assert specs.orphans(rows, "session_id", spark.createDataFrame([(9,)], "id long")).count() == 1


def test_rendering(spark):
    cells = spark.createDataFrame([(2000, "a", 1), (2000, "b", 0), (2001, "a", 2), (2001, "b", 5)], "year int, domain string, n long")
    assert render.coverage_markdown(cells).splitlines()[2:] == ["| 2000 | 1 | 0 |", "| 2001 | 2 | 5 |"]
    total = spark.createDataFrame([(8, 1.5)], "total_rows long, unclassified_pct double")
    assert json.loads(render.coverage_json(cells, total, "t"))["years"] == [2000, 2001]
    digest = render.skill_digest(spark.createDataFrame([("x", "unaddressed")], "label string, reason string"), spark.createDataFrame([("x", "do", 1.0, 1), ("x", "no", 0.5, 9)], "label string, action string, score double, place int"))
    assert digest == "- x: unaddressed — do (1.00)\n"
    drawn = json.loads(render.canvas(spark.createDataFrame([("a", 0), ("b", 1)], "node string, depth int"), spark.createDataFrame([("b", "a")], "child string, parent string")))
    assert len(drawn["nodes"]) == 2 and drawn["edges"][0]["toNode"] == "b"
