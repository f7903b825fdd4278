"""Line dedup by overlapping windows of three lines.

Windows are compared by 96 bits of hash, so text crosses the network once, in
the join that takes the covered lines out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import fresh, row_key, written

WIDTH = 3


def line_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, row, k, lines, h1, h2): each window of three consecutive lines that aren't blank, with the numbers of its lines."""
    lines = docs.select("doc_id", row_key("doc_id", "text").alias("row"), F.split("text", "\n", -1).alias("line")).where("text is not null")
    lines = lines.select("doc_id", "row", F.expr("filter(transform(line, (x, i) -> struct(trim(x) as x, i as i)), s -> s.x <> '')").alias("s")).where(F.size("s") >= WIDTH)
    cut = lines.select(
        "doc_id", "row",
        F.posexplode(F.expr("transform(sequence(0, size(s) - 3), k -> struct(array(s[k].i, s[k + 1].i, s[k + 2].i) as lines, xxhash64(s[k].x, s[k + 1].x, s[k + 2].x) as h1, hash(s[k + 2].x, s[k + 1].x, s[k].x) as h2))")).alias("k", "w"),
    )
    return cut.select("doc_id", "row", "k", "w.lines", "w.h1", "w.h2")


def covered_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, gone): the numbers of the lines of each row that later occurrences of windows cover, each once."""
    windows = written(line_windows(docs), "line-windows")
    at = F.struct("doc_id", "row", "k")
    first = windows.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min(at).alias("first")).where("times > 1").select("h1", "h2", "first")
    later = windows.join(first, ["h1", "h2"]).where(~at.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "row").agg(F.array_distinct(F.flatten(F.collect_set("lines"))).alias("gone"))


def without_repeated_windows(docs: DataFrame, removed: str = "removed_lines", left_lines: str = "left_lines") -> DataFrame:
    """docs with their lines deduplicated, and two counts (bigint) beside their columns, of names that docs doesn't have.

    A window is three consecutive lines; lines are compared without the spaces
    around them, and blank lines don't count (they stay where they are, in
    no window). Of the occurrences of a window, that of the least (doc_id, then
    row content, then position) stays, with a null doc_id before all others;
    from every other occurrence all three lines go. Overlapping windows cover
    their lines together. Rows that agree in doc_id and text are one document:
    what one of them loses, the others lose as well. A text of fewer than three
    lines has no window and stays; so does a null text, with nulls for both
    counts. n_chars, where there is such a column, is that of the new text.
    The second count is of the lines left that aren't blank. Texts of any
    length are taken whole; an empty table stays empty.
    """
    row, of, away = (fresh(docs.columns, x) for x in ("row", "row_of", "gone"))
    gone = covered_lines(docs).select(F.col("row").alias(of), F.struct("doc_id", "gone").alias(away))
    joined = docs.withColumn(row, row_key("doc_id", "text")).join(gone, (F.col(row) == F.col(of)) & F.col("doc_id").eqNullSafe(F.col(f"{away}.doc_id")), "left").withColumn(away, F.col(f"{away}.gone"))
    touched = F.col(away).isNotNull()
    lines = F.split("text", "\n", -1)
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(away)), lambda i: F.get(lines, i))
    joined = joined.withColumn("text", F.when(touched, F.array_join(left, "\n")).otherwise(F.col("text")))
    count = F.when(F.col("text").isNotNull(), F.when(touched, F.size(away)).otherwise(0).cast("long"))
    rest = F.when(F.col("text").isNotNull(), F.size(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")).cast("long"))
    more = {removed: count, left_lines: rest}
    if "n_chars" in docs.columns:
        more["n_chars"] = F.when(touched, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return joined.withColumns(more).select(*docs.columns, removed, left_lines)


def op7_line_window_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeated_windows(docs)


SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, i, trim(raw) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE trim(raw) <> ''),
w AS (SELECT doc_id, k, i AS i0, lead(i, 1) OVER p AS i1, lead(i, 2) OVER p AS i2, line || chr(10) || lead(line, 1) OVER p || chr(10) || lead(line, 2) OVER p AS win
      FROM b WINDOW p AS (PARTITION BY doc_id ORDER BY k)),
f AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) AS occurrence FROM w WHERE i2 IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest([i0, i1, i2]) AS i FROM f WHERE occurrence > 1),
a AS (SELECT l.doc_id,
             coalesce(string_agg(l.raw, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL), '') AS text,
             count(gone.i) AS removed_lines,
             count(*) FILTER (WHERE gone.i IS NULL AND trim(l.raw) <> '') AS left_lines
      FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, a.text, a.removed_lines, a.left_lines FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id
"""
