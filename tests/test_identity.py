"""Places round the globe, reviews and logs of merges, positions, the graph as a whole, the bus and instance checks, against simple versions."""

import math
import random
from itertools import combinations

from pyspark.sql import functions as F

from tessera.operators import coalesce, graph, history
from tessera.schema import instance
from tessera.streaming.bus import Bus


def metres(a, b):
    (la, lo), (lb, lp) = ((math.radians(x) for x in p) for p in (a, b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6_371_000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_places_round_the_globe(spark):
    r = random.Random(4)
    points = []
    for lat, lon in ((0, 180), (0, -180), (60, 179.999), (-85, 180), (89.95, 0), (89.95, 180), (40, 0), (-40, -0.001), (12, 77)):
        points += [(max(-90, min(90, lat + r.uniform(-0.006, 0.006))), (lon + r.uniform(-0.008, 0.008) + 180) % 360 - 180) for _ in range(14)]
    places = [(i, f"Place {i % 50}", lat, lon) for i, (lat, lon) in enumerate(points)] + [(900, "place 3", None, None), (901, None, 91.0, 0.0)]
    got = {(x.a, x.b): x.rule for x in coalesce.candidate_pairs(spark.createDataFrame(places, "id long, name string, lat double, lon double"), coalesce.PLACES).collect()}
    want = {}
    for a, b in combinations(range(len(points)), 2):
        far = metres(points[a], points[b])
        if far <= 500:
            want[a, b] = "geo_within_100m" if far <= 100 else "geo_within_500m"
    named = {}
    for i, name, *_ in places:
        if name is not None:
            named.setdefault(name.lower(), []).append(i)
    for ids in named.values():
        for i in ids[1:]:
            if want.get((ids[0], i)) != "geo_within_100m":
                want[ids[0], i] = "named_location_exact"
    assert got == want
    assert any(points[a][1] * points[b][1] < -30_000 for a, b in got if b < 900)


def test_places_of_many_ids(spark, monkeypatch):
    monkeypatch.setattr(coalesce, "BLOCK", 3, raising=False)
    r = random.Random(8)
    points = [(40 + k * 0.0004, -75.0) for k in range(6)]
    rows = [(i, *r.choice(points)) for i in range(60)] + [(i, *p) for i in (3, 70, 71) for p in points[:3] + points[:1]]
    near = coalesce.candidate_pairs(spark.createDataFrame(rows, "id long, lat double, lon double"), coalesce.PLACES[:1])
    want = sorted({(min(a[0], b[0]), max(a[0], b[0])) for a, b in combinations(rows, 2) if a[0] != b[0] and metres(a[1:], b[1:]) <= 100})
    assert sorted((x.a, x.b) for x in near.collect()) == want
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Generate")]  # pairs of ids aren't gathered again


def test_reviews_and_log(spark):
    people = spark.createDataFrame([(1, "Ann", "555"), (2, "ann", "555"), (3, "Bo", None)], "id long, full_name string, phone string")
    merges = spark.createDataFrame([(2, 1, "phone_e164", 0.95, "auto"), (3, 1, "same_full_name", 0.5, "review"), (4, 1, "discord_handle", 0.85, "review")], "id long, survivor long, rule string, confidence double, decision string")
    log = coalesce.audit_log(people, "id", merges, "people")
    assert sorted((x.merged_id, x.rule) for x in log.collect()) == [(2, "phone_e164"), (3, "same_full_name")]
    assert sorted(map(tuple, coalesce.restored(log, people, 1).collect())) == [(2, "ann", "555"), (3, "Bo", None)]
    assert {x[0] for x in log.select(coalesce.payload_value("payload", "full_name")).collect()} == {"ann", "Bo"}
    sure, shown = coalesce.shown_for_review(merges, auto_accept=0.9, limit=1)
    assert [x.id for x in sure.collect()] == [2] and [x.id for x in shown.collect()] == [4]
    assert [x.id for x in coalesce.shown_for_review(merges, rule="same_full_name")[1].collect()] == [3]


def test_positions_are_those_of_the_order(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), r.randint(0, 50), i) for i in range(3000)]
    got = history.positions(spark.createDataFrame(rows, "g string, x int, id int").repartition(7), ["g"], ["x", "id"]).collect()
    for g in "ab":
        assert [(x.x, x.id) for x in sorted((x for x in got if x.g == g), key=lambda x: x.position)] == sorted((x, i) for h, x, i in rows if h == g)
        assert sorted(x.position for x in got if x.g == g) == list(range(sum(h == g for h, _, _ in rows)))


def test_graph_as_a_whole(spark):
    schema = ", ".join(f"{c} string" for c in graph.STATEMENT)
    g = graph.Graph.of(spark.createDataFrame([("a", "x", "childOf", "a", "y", "p", None)], schema))
    g = g.add(spark.createDataFrame([("a", "x", "childOf", "a", "y", "p", None), ("a", "z", "mentions", "b", "w", "p", None)], schema))
    assert g.nodes.count() == 4 and g.triples.count() == 2 and [r.object for r in g.query(subject="z").collect()] == ["w"]
    first = g.triples.where("predicate = 'childOf'").select(F.col("id").alias("triple_id"), F.lit("k").alias("key"), F.lit("1").alias("value"))
    g = g.qualify(first).qualify(first.withColumn("value", F.lit("2")))
    assert [(r.key, r.value) for r in g.qualifiers.collect()] == [("k", "2")]
    assert len(g.around("a", "y").collect()) == 1 and g.stats()["totals"].first().triples == 2


def test_dissolution_signs(spark):
    revisions = spark.createDataFrame([(f"Tasks/{i}.md", "c1", "delete") for i in range(12)] + [("x/Entities/People/a.md", "c2", "delete"), ("b.md", "c3", "delete"), ("c.md", "c2", "add")], "file_path string, commit_sha string, change_type string")
    subjects = spark.createDataFrame([("c2", "Migrate people"), ("c3", "tidy")], "commit_sha string, subject string")
    got = {r.commit_sha: (r.signal, r.files, r.schemas) for r in history.detected(revisions, subjects).collect()}
    assert got == {"c1": ("bulk_delete", 12, ["Action"]), "c2": ("subject_keyword", 1, ["Person"])}


def test_bus(spark):
    bus, seen = Bus(), []
    bus.on("Message", lambda df: seen.append(("m", df.count())))
    bus.on("Message", lambda df: 1 / 0)
    bus.on("*", lambda df: seen.append(("all", df.count())))
    bus.emit(spark.createDataFrame([("Message", 1), ("Event", 2), ("Message", 3)], "schema_type string, id int"))
    assert seen == [("m", 2), ("all", 3)] and [k for k, _ in bus.failed] == ["Message"]


def test_instance(tmp_path):
    assert instance.warnings_of(None, None, 1) == [] and "no such folder" in instance.warnings_of(str(tmp_path / "x"), {}, 768)[0]
    assert len(instance.warnings_of(str(tmp_path), {}, 64)) == 3
    (tmp_path / "identity.toml").write_text("")
    assert instance.warnings_of(str(tmp_path), {"emails": ["a@b.c"]}, 768) == []
