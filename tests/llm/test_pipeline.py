"""The pipeline's stages on the small tables, each against its operator's rule."""

import corpus_pipeline as cp
from tessera.llm import queries
from tessera.llm.shared import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now and now <= ids
        ids = now
    bins = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert {i for b in bins for i in b.doc_ids} == ids
    assert {i for b in cp.run(spark, SF).collect() for i in b.doc_ids} == ids


def test_empty_and_extra_columns(spark):
    docs = table(spark, SF, "documents").selectExpr("*", "1 as gone", "2 as quality", "3 as item_id", "4 as size", "5 as node")
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert cp.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_names():
    assert {f"op{n}_" for n in range(1, 11)} == {n.split("_")[0] + "_" for n in queries.QUERIES if n != "pipeline"}
    assert set(queries.ORACLES) <= set(queries.QUERIES)
