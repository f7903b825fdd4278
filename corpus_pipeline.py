"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns
the rows it keeps with the columns of docs; packing returns bins. run() writes
each stage's result into the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_windows, ngram_join, packing, passages, quality_rules
from tessera.llm.shared import fresh, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules reject go, and so do null and empty texts; without labels of both classes all rows stay.

    Long texts are scored whole, rows that repeat each alike, whatever their doc_id.
    """
    return quality_rules.not_rejected(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; so does a document that loses its last line with them.

    Null texts stay, and texts of fewer than three lines; rows that agree in
    doc_id (null included) and text are one document and keep the same lines.
    """
    removed, left = fresh(docs.columns, "removed_lines"), fresh(docs.columns, "left_lines")
    found = line_windows.without_repeated_windows(docs, removed, left)
    return found.where(F.coalesce((F.col(removed) == 0) | (F.col(left) > 0), F.lit(True))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones stays, that of the least doc_id, a null one last.

    Then later copies of passages of 50 words go from what stays, and so does a
    document that loses its last word with them. Done before, this would leave
    scraps of near copies that are no longer similar. Null texts and those
    without words stay; of rows that repeat, one stays.
    """
    kept, removed = written(ngram_join.one_of_each(docs), "one-of-each"), fresh(docs.columns, "removed_words")
    found = passages.without_repeated_passages(kept, removed)
    return found.where(F.coalesce((F.col(removed) == 0) | F.col("text").rlike(passages.A_WORD), F.lit(True))).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, whatever their doc_id; null texts stay, repeated rows go alike."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins into which the documents are packed, with lists of doc_ids.

    Null texts and those without words are in no bin; a null doc_id is a null
    in the list; texts longer than a bin are cut. An empty table gives no bins,
    and an empty table to the other stages; further columns are kept until here.
    """
    return packing.packed(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("packing", bins)]

#: SQL can't express the trained model of the first stage or first-fit decreasing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
