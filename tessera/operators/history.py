"""File revisions, notes, deliberate deletions and their audit."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import excerpt, query_parts
from tessera.functions.types import Text
from tessera.operators.search import bm25_search
from tessera.operators.shared import kept


def revisions_of(revisions: DataFrame, path: Text = None, since: Text = None, until: Text = None, change_type: Text = None, limit: int = 50) -> DataFrame:
    """Revisions that meet the filters, newest first."""
    rows = revisions
    for test in (path is not None and F.col("file_path") == path, since is not None and F.col("captured_at") >= since, until is not None and F.col("captured_at") <= until, change_type is not None and F.col("change_type") == change_type):
        if test is not False:
            rows = rows.where(test)
    return rows.orderBy(F.desc_nulls_last("captured_at"), F.desc("commit_sha")).limit(limit)


def latest(revisions: DataFrame) -> DataFrame:
    """The newest revision of each path."""
    cols = [c for c in revisions.columns if c not in ("repo", "file_path")]
    top = F.max(F.struct("captured_at", "commit_sha", *[c for c in cols if c not in ("captured_at", "commit_sha")])).alias("s")
    return revisions.groupBy("repo", "file_path").agg(top).select("repo", "file_path", *[F.col(f"s.{c}").alias(c) for c in cols])


def stats(revisions: DataFrame) -> DataFrame:
    """(what, name, n): by authorship, by kind of change, and the total."""
    legs = [revisions.groupBy(F.lit(what).alias("what"), F.col(c).alias("name")).agg(F.count("*").alias("n")) for what, c in (("authorship", "authorship"), ("change_type", "change_type"))]
    return legs[0].union(legs[1]).union(revisions.agg(F.count("*").alias("n")).select(F.lit("total").alias("what"), F.lit("all").alias("name"), "n"))


def summary_coverage(revisions: DataFrame) -> DataFrame:
    return revisions.agg(F.count("*").alias("total"), F.count("summary").alias("filled")).withColumn("pct", F.round(F.col("filled") * 100 / F.col("total"), 2))


def top_files(revisions: DataFrame, k: int = 10) -> DataFrame:
    return revisions.groupBy("file_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file_path").limit(k)


def by_day(revisions: DataFrame, last: int = 14) -> DataFrame:
    return revisions.groupBy(F.substring("captured_at", 1, 10).alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("day")).limit(last)


def classify_commits(commits: DataFrame) -> DataFrame:
    """authorship of commits(commit_sha, message) by their trailers."""
    m = F.lower("message")
    kind = F.when(m.rlike(r"co-authored-by:[^\n]*(bot|assistant|\bai\b|noreply)"), "ai-coauthored").when(m.rlike(r"generated with"), "ai-generated").otherwise("owner-authored")
    return commits.select("commit_sha", kind.alias("authorship"))


def with_authorship(revisions: DataFrame, commits: DataFrame, repos: DataFrame) -> DataFrame:
    """authorship of the commit, else the default of the repository, else 'ai-coauthored'."""
    rows = revisions.drop("authorship").join(commits.select("commit_sha", F.col("authorship").alias("_c")), "commit_sha", "left").join(repos.select("repo", F.col("authorship").alias("_r")), "repo", "left")
    return rows.withColumn("authorship", F.coalesce("_c", "_r", F.lit("ai-coauthored"))).drop("_c", "_r")


def _range(begin: int, n: int) -> str:
    """A range of lines as difflib writes it."""
    return f"{begin + 1}" if n == 1 else f"{begin + (n > 0)},{n}"


def diff_of(before: str | None, after: str | None) -> str:
    """The unified difference of two texts, as difflib gives it.

    Where one run of lines is replaced, the lines in it occur on its side alone
    and those around it are all distinct, they can be matched in one way only,
    and nothing is searched.
    """
    if before == after:
        return ""
    a, b = before.splitlines() if before else [], after.splitlines() if after else []
    if a == b:
        return ""
    n, m = len(a), len(b)
    most, i = min(n, m), 0
    while i < most and a[i] == b[i]:
        i += 1
    k = 0
    while k < most - i and a[n - 1 - k] == b[m - 1 - k]:
        k += 1
    out, new = a[i : n - k], b[i : m - k]
    around = a[:i] + a[n - k :]
    if len({*around}) < len(around) or not {*out}.isdisjoint(b) or not {*new}.isdisjoint(a):
        return "\n".join(difflib.unified_diff(a, b, "before", "after", lineterm=""))
    lo, end = max(0, i - 3), min(k, 3)
    head = f"@@ -{_range(lo, n - k + end - lo)} +{_range(lo, m - k + end - lo)} @@"
    return "\n".join(["--- before", "+++ after", head, *[" " + x for x in a[lo:i]], *["-" + x for x in out], *["+" + x for x in new], *[" " + x for x in a[n - k : n - k + end]]])


@F.pandas_udf(T.StringType())
def unified_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([diff_of(a, b) for a, b in zip(before, after, strict=True)], dtype=object)


def diffs(revisions: DataFrame, blobs: DataFrame) -> DataFrame:
    """Each revision's difference from the one before it of the same path; blobs(commit_sha, file_path, body).

    Join and order both take place where the path's hash puts the revisions; blobs that are partitioned by file_path aren't moved again.
    """
    w = Window.partitionBy("repo", "file_path").orderBy("captured_at", "commit_sha")
    rows = revisions.repartition("file_path").join(blobs, ["commit_sha", "file_path"], "left").withColumn("_before", F.lag("body").over(w))
    return rows.select("repo", "file_path", "commit_sha", "captured_at", unified_diff("_before", "body").alias("diff"))


def triple_deltas(states: DataFrame) -> DataFrame:
    """(file_path, commit_sha, added, removed) of states(repo, file_path, commit_sha, captured_at, statements array<string>, change_type).

    A deletion removes all; a rename removes all of the old path and adds all.
    """
    w = Window.partitionBy("repo", "file_path").orderBy("captured_at", "commit_sha")
    none = F.array().cast("array<string>")
    now = F.when(F.col("change_type") == "delete", none).otherwise(F.coalesce("statements", none))
    rows = states.withColumn("_now", now).withColumn("_was", F.coalesce(F.lag("_now").over(w), none))
    renamed = F.col("change_type") == "rename"
    return rows.select("repo", "file_path", "commit_sha", F.when(renamed, F.col("_now")).otherwise(F.array_except("_now", "_was")).alias("added"), F.when(renamed, F.col("_was")).otherwise(F.array_except("_was", "_now")).alias("removed"))


def summary_queue(revisions: DataFrame, large: int = 5120, bundle: int = 10) -> DataFrame:
    """Revisions without a summary, oldest first, each with a model and the bundle it goes in.

    Renames, deletions and what is over `large` bytes go to the small model;
    bundles are filled in order within a model.
    """
    model = F.when(F.col("change_type").isin("rename", "delete") | (F.col("size_bytes") > large), "small").otherwise("large")
    rows = revisions.where("summary is null").select("commit_sha", "file_path", "captured_at", model.alias("model"))
    placed = positions(rows, ["model"], ["captured_at", "commit_sha", "file_path"])
    return placed.select("commit_sha", "file_path", "captured_at", "model", F.floor(F.col("position") / bundle).cast("long").alias("bundle"))


def positions(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with their position from 0 in the order within each group, however large a group is.

    The rows are put in order over all tasks and written; a task's share is
    numbered by itself and begins where the shares before it end, so that no
    group has to be in one task.
    """
    sorted_ = kept(rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("part", F.spark_partition_id()), "positions")
    held = sorted_.groupBy("part", *group).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.withColumn("start", before).drop("n")
    own = F.row_number().over(Window.partitionBy("part", *group).orderBy(*order)) - 1
    return sorted_.withColumn("own", own).join(starts, ["part", *group]).withColumn("position", F.col("own") + F.col("start")).drop("part", "own", "start")


def skipped(revisions: DataFrame, patterns: list[str], note: str = "skipped") -> DataFrame:
    """Revisions without a summary whose path is like a pattern get a note for one."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col("file_path").ilike(p)
    return revisions.withColumn("summary", F.when(F.col("summary").isNull() & hit, note).otherwise(F.col("summary")))


def with_summaries(revisions: DataFrame, written: DataFrame) -> DataFrame:
    rows = revisions.join(written.select("commit_sha", "file_path", F.col("summary").alias("_s")), ["commit_sha", "file_path"], "left")
    return rows.withColumn("summary", F.coalesce("_s", "summary")).drop("_s")


def without_commit(revisions: DataFrame, deltas: DataFrame, commit_sha: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without a commit, so that it can be read again."""
    return revisions.where(F.col("commit_sha") != commit_sha), deltas.where(F.col("commit_sha") != commit_sha)


def notes(revisions: DataFrame) -> DataFrame:
    """One note for each path: state of its latest revision, first and last time added or deleted."""
    kind = F.col("change_type")
    return revisions.groupBy("repo", "file_path").agg(
        F.max_by("change_type", F.struct("captured_at", "commit_sha")).alias("last_change"), F.max("captured_at").alias("modified_at"), F.min("captured_at").alias("created_at"),
        F.max(F.when(kind == "add", F.col("captured_at"))).alias("last_added_at"), F.max(F.when(kind == "delete", F.col("captured_at"))).alias("last_deleted_at"), F.count("*").alias("revisions"),
    )


def note_states(notes: DataFrame, dissolutions: DataFrame) -> DataFrame:
    """status: 'active'; or, if deleted last, 'dissolved' where a dissolution names the path, else 'deleted'."""
    rows = notes.join(dissolutions.select("file_path", F.lit(True).alias("_d")).distinct(), "file_path", "left")
    return rows.withColumn("status", F.when(F.col("last_change") != "delete", "active").when(F.col("_d"), "dissolved").otherwise("deleted")).drop("_d")


def note_stats(states: DataFrame) -> DataFrame:
    return states.groupBy("status").agg(F.count("*").alias("n"), F.sum("revisions").alias("revisions"))


def declared(dissolutions: DataFrame, more: DataFrame) -> DataFrame:
    """Dissolutions and those of `more` that are new by (plan_id, migration_id); without a reason or path they aren't taken."""
    new = more.where("trim(coalesce(reason, '')) <> '' and file_path is not null").dropDuplicates(["plan_id", "migration_id"])
    return dissolutions.unionByName(new.join(dissolutions.select("plan_id", "migration_id"), ["plan_id", "migration_id"], "left_anti"))


def classified(revisions: DataFrame, dissolutions: DataFrame) -> DataFrame:
    """Revisions with whether a dissolution explains their deletion."""
    rows = revisions.join(dissolutions.select("file_path", "commit_sha", F.col("dissolution_id")), ["file_path", "commit_sha"], "left")
    return rows.withColumn("deletion", F.when(F.col("change_type") != "delete", None).when(F.col("dissolution_id").isNotNull(), "dissolved").otherwise("unexplained"))


def lifecycle(revisions: DataFrame, dissolutions: DataFrame, materializations: DataFrame) -> DataFrame:
    """(file_path, at, event, ref): what befell a path, in order of time."""
    legs = [
        revisions.select("file_path", F.col("captured_at").alias("at"), F.concat(F.lit("revision:"), "change_type").alias("event"), F.col("commit_sha").alias("ref")),
        dissolutions.select("file_path", F.col("dissolved_at").alias("at"), F.lit("dissolution").alias("event"), F.col("dissolution_id").cast("string").alias("ref")),
        materializations.select("file_path", F.col("materialized_at").alias("at"), F.lit("materialization").alias("event"), F.col("run_id").cast("string").alias("ref")),
    ]
    return legs[0].union(legs[1]).union(legs[2]).orderBy("file_path", F.asc_nulls_first("at"), "event", "ref")


def audit(revisions: DataFrame, dissolutions: DataFrame, materializations: DataFrame) -> DataFrame:
    """(check, severity, n): what doesn't fit together; checks without findings are listed with 0."""
    deleted = revisions.where("change_type = 'delete'")
    checks = [
        ("dissolution_without_revision", "error", dissolutions.join(revisions, ["file_path", "commit_sha"], "left_anti")),
        ("dissolution_of_no_deletion", "error", dissolutions.join(revisions.where("change_type <> 'delete'"), ["file_path", "commit_sha"], "left_semi")),
        ("unexplained_deletion", "warning", deleted.join(dissolutions, ["file_path", "commit_sha"], "left_anti")),
        ("dissolution_without_reason", "warning", dissolutions.where("trim(coalesce(reason, '')) = ''")),
        ("dissolution_without_targets", "info", dissolutions.where("coalesce(target_tables, '[]') = '[]'")),
        ("materialization_of_unknown_path", "warning", materializations.join(revisions, "file_path", "left_anti")),
    ]
    out = None
    for name, severity, rows in checks:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), F.lit(severity).alias("severity"), "n")
        out = one if out is None else out.union(one)
    return out


def log_materialization(path: str, event: DataFrame) -> None:
    """Append the record of a run: (run_id, file_path, materialized_at, rows)."""
    event.write.mode("append").parquet(path)


def materialized(revisions: DataFrame, blobs: DataFrame, path: str, at: str | None = None) -> DataFrame:
    """(file_path, commit_sha, captured_at, body): a path as it was at a time, by default now; no row before its first revision or once it is deleted."""
    rows = revisions.where(F.col("file_path") == path)
    if at is not None:
        rows = rows.where(F.col("captured_at") <= at)
    last = rows.orderBy(F.desc("captured_at"), F.desc("commit_sha")).limit(1).where("change_type <> 'delete'")
    return last.join(blobs.where(F.col("file_path") == path), ["commit_sha", "file_path"], "left").select("file_path", "commit_sha", "captured_at", "body")


def note_lookup(notes: DataFrame, name_or_path: str) -> DataFrame:
    """The note of that path, else of that name."""
    found = notes.where((F.col("file_path") == name_or_path) | (F.col("name") == name_or_path))
    return found.orderBy(F.col("file_path") != name_or_path, "file_path").limit(1)


def list_notes(notes: DataFrame, status: Text = None, at_type: Text = None, limit: int = 50) -> DataFrame:
    """Notes that meet the filters, last changed first."""
    for name, value in (("status", status), ("at_type", at_type)):
        if value is not None:
            notes = notes.where(F.col(name) == value)
    return notes.orderBy(F.desc_nulls_last("updated_at"), "file_path").limit(limit)


def note_search(notes: DataFrame, query: str, limit: int = 20, words: int = 40) -> DataFrame:
    """(id, file_path, name, score, snippet): the best notes(id, file_path, name, description, body) by what name, description and body hold, all parts of the query being needed.

    The snippet is of the body; without a hit in it, its beginning.
    """
    text = F.concat_ws("\n", "name", "description", "body")
    best = bm25_search(notes.select("id", F.lit(None).cast("string").alias("date_sent"), text.alias("content")), query, limit)
    phrases, terms = query_parts(query)
    marked = excerpt(F.coalesce("body", F.lit("")), [*terms, *(w for p in phrases for w in p.split())], words)
    return notes.join(F.broadcast(best), "id").select("id", "file_path", "name", "score", marked.alias("snippet")).orderBy(F.desc("score"), "id")


def renamed(notes: DataFrame, renames: DataFrame) -> DataFrame:
    """notes with paths moved by renames(old_path, new_path): the note keeps its id and history."""
    moved = renames.select(F.col("old_path").alias("file_path"), "new_path").dropDuplicates(["file_path"])
    return notes.join(moved, "file_path", "left").withColumn("file_path", F.coalesce("new_path", "file_path")).select(*notes.columns)


def under_paths(revisions: DataFrame, patterns: list[str]) -> DataFrame:
    """Deletions whose path, and renames whose former path (prior_file_path), is like one of the patterns."""
    gone, moved = F.lit(False), F.lit(False)
    for p in patterns:
        gone, moved = gone | F.col("file_path").like(p), moved | F.col("prior_file_path").like(p)
    return revisions.where(((F.col("change_type") == "delete") & gone) | ((F.col("change_type") == "rename") & moved))


def linked(links: DataFrame, dissolution_id: str, revisions: DataFrame) -> DataFrame:
    """links(dissolution_id, file_path, commit_sha) and those of revisions to a dissolution that aren't there yet."""
    more = revisions.select(F.lit(dissolution_id).alias("dissolution_id"), "file_path", "commit_sha").distinct()
    return links.unionByName(more.join(links, ["dissolution_id", "file_path", "commit_sha"], "left_anti"))


def reclassified(links: DataFrame, revisions: DataFrame, dissolution_id: str, patterns: list[str], commits: list[str] | None = None) -> DataFrame:
    """links with the revisions of one wave: what the patterns find, of some commits only if these are named. Doing it again changes nothing."""
    found = under_paths(revisions, patterns)
    return linked(links, dissolution_id, found.where(F.col("commit_sha").isin(*commits)) if commits else found)


def dissolutions_of(dissolutions: DataFrame, column: str, value: str) -> DataFrame:
    """Dissolutions of a plan (plan_id) or migration (migration_id), newest first."""
    return dissolutions.where(F.col(column) == value).orderBy(F.desc_nulls_last("dissolved_at"), "dissolution_id")


def overview(revisions: DataFrame, dissolutions: DataFrame, links: DataFrame, materializations: DataFrame) -> DataFrame:
    """One row on the registry: how many dissolutions, linked revisions, materialisations and dissolutions without a migration there are, and what the audit finds."""
    found = audit(revisions, dissolutions, materializations)
    sums = found.agg(F.coalesce(F.sum(F.when(F.col("severity") == "error", F.col("n"))), F.lit(0)).alias("audit_errors"), F.coalesce(F.sum(F.when(F.col("severity") == "warning", F.col("n"))), F.lit(0)).alias("audit_warnings"))
    counts = dissolutions.agg(F.count("*").alias("dissolutions"), F.count_if(F.col("migration_id").isNull()).alias("without_migration"))
    rows = counts.crossJoin(links.agg(F.count("*").alias("linked_revisions"))).crossJoin(materializations.agg(F.count("*").alias("materializations"))).crossJoin(sums)
    return rows.withColumn("audit_pass", F.col("audit_errors") == 0)


#: Deleted notes in one commit from which it looks like a dissolution; words of a subject that say so; the type that a folder's notes become.
MANY_DELETED = 10
_SAYS_SO = r"(?i)\b(dissol\w*|migrat\w*|retire\w*|carry[- ]forward)\b"
_BECOMES = (("%Entities/People/%", "Person"), ("%Entities/Organizations/%", "Organization"), ("%Entities/Places/%", "Place"), ("%Entities/Books/%", "Book"), ("%Entities/Movies/%", "Movie"), ("%Tasks/%", "Action"), ("System/Handoffs/%", "Action"), ("References/%", "Article"), ("%/Articles/%", "Article"), ("%/Clippings/%", "Article"))


def detected(revisions: DataFrame, subjects: DataFrame, many: int = MANY_DELETED) -> DataFrame:
    """(commit_sha, signal, files, schemas) of the commits that look like dissolutions.

    subjects(commit_sha, subject). A commit that deletes notes counts if its
    subject says so ('subject_keyword') or if they are many ('bulk_delete').
    schemas are the types that the folders of the deleted notes suggest.
    """
    deleted = revisions.where("change_type = 'delete' and file_path like '%.md'")
    kind = F.lit(None).cast("string")
    for pattern, name in reversed(_BECOMES):
        kind = F.when(F.col("file_path").like(pattern), name).otherwise(kind)
    per = deleted.groupBy("commit_sha").agg(F.countDistinct("file_path").alias("files"), F.sort_array(F.collect_set(kind)).alias("schemas"))
    rows = per.join(subjects.select("commit_sha", "subject"), "commit_sha", "left")
    signal = F.when(F.col("subject").rlike(_SAYS_SO), "subject_keyword").when(F.col("files") >= many, "bulk_delete")
    return rows.withColumn("signal", signal).where("signal is not null").select("commit_sha", "signal", "files", "schemas")
