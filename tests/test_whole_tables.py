"""Queries over all rows of their tables, against simple versions."""

import difflib
from itertools import groupby

import __spark_entry__ as entry
from tessera.sources import driver as d

SF = "/root/testdata/sf0.001"


def test_diffs_and_deltas_of_all_revisions(spark):
    revisions = sorted(d.revisions(spark, SF).collect(), key=lambda r: (r.file_path, r.captured_at, r.commit_sha))
    diffs, deltas = [], []
    for path, rows in groupby(revisions, key=lambda r: r.file_path):
        before, was = [], set()
        for r in rows:
            now = set() if r.change_type == "delete" else {r.change_type, r.authorship, r.captured_at[:4]}
            after = [r.change_type, r.captured_at]
            diffs.append((path, r.commit_sha, "\n".join(difflib.unified_diff(before, after, "before", "after", lineterm=""))))
            deltas.append((path, r.commit_sha, ",".join(sorted(now - was)), ",".join(sorted(was - now))))
            before, was = after, now
    assert sorted((r.file_path, r.commit_sha, r["diff"]) for r in entry.queries()["r01_diffs"](spark, SF).collect()) == sorted(diffs)
    assert sorted((r.file_path, r.commit_sha, r.added, r.removed) for r in entry.queries()["r02_triple_deltas"](spark, SF).collect()) == sorted(deltas)


def test_diffs_move_each_row_once(spark):
    plan = entry.queries()["r01_diffs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_components_of_all_orders(spark):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for o in d.table(spark, SF, "orders").collect():
        a, b = sorted((root(o.o_custkey + 1_000_000), root(o.o_orderdate.month * 100 + o.o_orderdate.year % 100)))
        parent[b] = a
    assert sorted(entry.queries()["x_components"](spark, SF).collect()) == sorted((x, root(x)) for x in parent)


def test_snapshot_is_of_all_practice(spark):
    want = {r.label: r.readiness for r in entry.queries()["k01_readiness"](spark, SF).collect() if r.readiness is not None}
    got = [r for r in entry.queries()["k06_snapshot"](spark, SF).collect() if "readiness" in r]
    assert {float(v) for r in got for k, v in r.asDict().items() if k == "readiness" and v is not None} == set(want.values())


def test_whole_tables(spark):
    orders, lines = d.table(spark, SF, "orders").count(), d.table(spark, SF, "lineitem").count()
    events = entry.queries()["l02_lifecycle"](spark, SF).groupBy("event").count().collect()
    by = {r.event: r["count"] for r in events}
    assert by["materialization"] == orders and sum(v for k, v in by.items() if k.startswith("revision:")) == lines
