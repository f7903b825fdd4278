"""Statements about things: nodes, predicates, triples and qualifiers.

A node's id is a hash of (kind, normalized label), a triple's of its five
identifying parts, so both can be made anywhere and merged without a lookup.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import label, strip, wikilinks
from tessera.operators.shared import kept

#: name -> inverse; a predicate that is its own inverse is symmetric.
PREDICATES = {
    "childOf": "parentOf", "relatesTo": "relatesTo", "mentions": "mentionedBy", "taggedWith": "tagOf", "partOf": "hasPart", "authoredBy": "authorOf", "derivedFrom": "sourceOf", "supersedes": "supersededBy", "locatedIn": "locationOf", "participatesIn": "hasParticipant",
    "sentTo": "receivedFrom", "inThread": "threadContains", "hasChunk": "chunkOf", "hasAttachment": "attachmentOf", "hasHeartRateSample": "heartRateSampleOf", "hasGeoTrace": "geoTraceOf", "hasMetadata": "metadataOf", "hasWorkoutEvent": "workoutEventOf", "hasWorkoutStatistic": "workoutStatisticOf", "inFolder": "folderContains", "prerequisiteOf": "hasPrerequisite", "hasReadiness": "readinessOf",
}
STATEMENT = ["subject_kind", "subject", "predicate", "object_kind", "object", "provenance", "ref"]


def node_id(kind, name):
    return F.xxhash64(kind, label(name))


def predicates(spark) -> DataFrame:
    """(name, inverse, symmetric): the vocabulary, inverses included."""
    rows = {**PREDICATES, **{v: k for k, v in PREDICATES.items()}}
    return spark.createDataFrame([(k, v, k == v) for k, v in sorted(rows.items())], "name string, inverse string, symmetric boolean")


def resolve_nodes(mentions: DataFrame) -> DataFrame:
    """(id, kind, label, normalized_label, source_table, source_id) of mentions(kind, label[, source_table, source_id]).

    One node for a kind and normalized label; the least label in writing
    stands for it, and the least source that is given fills in for those
    without one.
    """
    for name, kind in (("source_table", "string"), ("source_id", "long")):
        if name not in mentions.columns:
            mentions = mentions.withColumn(name, F.lit(None).cast(kind))
    rows = mentions.where("kind is not null and label is not null").withColumn("normalized_label", label(F.col("label")))
    source = F.min(F.when(F.col("source_table").isNotNull(), F.struct("source_table", "source_id"))).alias("s")
    out = rows.groupBy("kind", "normalized_label").agg(F.min("label").alias("label"), source)
    return out.select(F.xxhash64("kind", "normalized_label").alias("id"), "kind", "label", "normalized_label", "s.source_table", "s.source_id")


def add_triples(statements: DataFrame, known: DataFrame) -> DataFrame:
    """Triples of statements (STATEMENT), each once by subject, predicate, object, provenance and ref; a null object or ref is a value of its own.

    A statement whose predicate isn't known fails the job that reads it;
    unknown_predicates() lists them beforehand.
    """
    rows = statements.join(known.select(F.col("name").alias("predicate"), F.lit(True).alias("_known")), "predicate", "left")
    rows = rows.where(F.coalesce("_known", F.raise_error(F.concat(F.lit("unknown predicate: "), F.coalesce("predicate", F.lit("null")))).cast("boolean")))
    out = rows.select(node_id(F.col("subject_kind"), F.col("subject")).alias("subject_id"), "predicate", F.when(F.col("object").isNotNull(), node_id(F.col("object_kind"), F.col("object"))).alias("object_id"), "provenance", F.coalesce("ref", F.lit("")).alias("ref")).distinct()
    return out.withColumn("id", F.xxhash64("subject_id", "predicate", F.coalesce("object_id", F.lit(-1)), "provenance", "ref"))


def unknown_predicates(statements: DataFrame, known: DataFrame) -> DataFrame:
    """(predicate, n) of statements that add_triples leaves out."""
    return statements.join(F.broadcast(known), F.col("predicate") == F.col("name"), "left_anti").groupBy("predicate").agg(F.count("*").alias("n"))


def statements_of(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Triples with the kinds and labels of both ends; an object may be missing."""
    s = nodes.select(F.col("id").alias("subject_id"), F.col("kind").alias("subject_kind"), F.col("label").alias("subject"), F.col("normalized_label").alias("_s"))
    o = nodes.select(F.col("id").alias("object_id"), F.col("kind").alias("object_kind"), F.col("label").alias("object"), F.col("normalized_label").alias("_o"))
    return triples.join(s, "subject_id").join(o, "object_id", "left")


def query_triples(triples: DataFrame, nodes: DataFrame, known: DataFrame, subject: str | None = None, predicate: str | None = None, object_: str | None = None, provenance: str | None = None, include_inverse: bool = False, limit: int | None = 100, offset: int = 0) -> DataFrame:
    """(direction, subject, predicate, object, ...) that meet every filter given, by subject, predicate and object.

    A label that no node has gives no rows. With include_inverse the triples of
    the inverse predicate, ends exchanged, are added as 'inverse'; a symmetric
    predicate has none of its own.
    """
    rows = statements_of(triples, nodes)
    shown = ["direction", "subject_kind", "subject", "predicate", "object_kind", "object", "provenance", "ref"]

    def kept(df: DataFrame, s: str | None, p: str | None, o: str | None) -> DataFrame:
        if s is not None:
            df = df.where(F.col("_s") == s.strip().lower())
        if p is not None:
            df = df.where(F.col("predicate") == p)
        if o is not None:
            df = df.where(F.col("_o") == o.strip().lower())
        return df.where(F.col("provenance") == provenance) if provenance is not None else df

    out = kept(rows, subject, predicate, object_).withColumn("direction", F.lit("forward")).select(shown)
    if include_inverse:
        back = kept(rows, object_, None, subject).where("object_id is not null").join(F.broadcast(known.where("not symmetric")), F.col("predicate") == F.col("name"))
        if predicate is not None:
            back = back.where(F.col("inverse") == predicate)
        back = back.select(F.lit("inverse").alias("direction"), F.col("object_kind").alias("subject_kind"), F.col("object").alias("subject"), F.col("inverse").alias("predicate"), F.col("subject_kind").alias("object_kind"), F.col("subject").alias("object"), "provenance", "ref")
        out = out.union(back)
    out = out.orderBy("subject", "predicate", F.asc_nulls_first("object"), "direction", "subject_kind", "object_kind", "provenance", "ref")
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def neighborhood(triples: DataFrame, nodes: DataFrame, kind: str, name: str, limit: int = 50) -> DataFrame:
    """(direction, predicate, kind, label) of what is one step from a node."""
    rows = statements_of(triples, nodes)
    n = name.strip().lower()
    away = rows.where((F.col("subject_kind") == kind) & (F.col("_s") == n)).select(F.lit("out").alias("direction"), "predicate", F.col("object_kind").alias("kind"), F.col("object").alias("label"))
    into = rows.where((F.col("object_kind") == kind) & (F.col("_o") == n)).select(F.lit("in").alias("direction"), "predicate", F.col("subject_kind").alias("kind"), F.col("subject").alias("label"))
    return away.union(into).distinct().orderBy("direction", "predicate", F.asc_nulls_first("label"), "kind").limit(limit)


def reachable(triples: DataFrame, start: DataFrame, predicate: str, steps: int) -> DataFrame:
    """(start, node, depth): nodes within some steps along a predicate, with the least depth."""
    hop = triples.where((F.col("predicate") == predicate) & F.col("object_id").isNotNull()).select(F.col("subject_id").alias("node"), F.col("object_id").alias("next")).distinct()
    front = start.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("depth"))
    seen = front
    for i in range(1, steps + 1):
        front = front.join(hop, "node").select("start", F.col("next").alias("node"), F.lit(i).alias("depth")).distinct()
        front = front.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        seen = seen.union(front)
    return seen.groupBy("start", "node").agg(F.min("depth").alias("depth"))


def stats(triples: DataFrame, nodes: DataFrame, known: DataFrame) -> dict[str, DataFrame]:
    """Totals, use of every predicate (unused ones too), and nodes by kind."""
    totals = nodes.agg(F.count("*").alias("nodes")).crossJoin(triples.agg(F.count("*").alias("triples"), F.count_if(F.col("object_id").isNull()).alias("without_object")))
    used = triples.groupBy("predicate").agg(F.count("*").alias("n"))
    usage = known.select(F.col("name").alias("predicate")).join(used, "predicate", "left").select("predicate", F.coalesce("n", F.lit(0)).alias("n"))
    return {"totals": totals, "usage": usage, "kinds": nodes.groupBy("kind").agg(F.count("*").alias("n"))}


def qualifiers_of(qualifiers: DataFrame, triple_id: int) -> DataFrame:
    return qualifiers.where(F.col("triple_id") == triple_id).select("key", "value").orderBy("key", "value")


def with_qualifiers(qualifiers: DataFrame, more: DataFrame) -> DataFrame:
    """qualifiers(triple_id, key, value) and those of more; for one triple and key the later value stays."""
    both = qualifiers.select("triple_id", "key", "value", F.lit(0).alias("_n")).union(more.select("triple_id", "key", "value", F.lit(1)))
    return both.groupBy("triple_id", "key").agg(F.max_by("value", F.struct("_n", "value")).alias("value"))


@dataclass
class Graph:
    """Nodes, triples, qualifiers and the vocabulary, and what can be asked and added."""

    nodes: DataFrame
    triples: DataFrame
    qualifiers: DataFrame
    known: DataFrame

    @classmethod
    def of(cls, statements: DataFrame) -> Graph:
        """The graph of statements (STATEMENT)."""
        spark = statements.sparkSession
        ends = statements.select(F.col("subject_kind").alias("kind"), F.col("subject").alias("label")).union(statements.where("object is not null").select("object_kind", "object"))
        known = predicates(spark)
        return cls(resolve_nodes(ends), add_triples(statements, known), spark.createDataFrame([], "triple_id long, key string, value string"), known)

    def add(self, statements: DataFrame) -> Graph:
        """This graph and further statements; what is there already stays as it is."""
        new = Graph.of(statements)
        nodes = self.nodes.unionByName(new.nodes.join(self.nodes.select("id"), "id", "left_anti"))
        triples = self.triples.unionByName(new.triples.join(self.triples.select("id"), "id", "left_anti"))
        return Graph(nodes, triples, self.qualifiers, self.known)

    def qualify(self, more: DataFrame) -> Graph:
        return Graph(self.nodes, self.triples, with_qualifiers(self.qualifiers, more), self.known)

    def query(self, **filters) -> DataFrame:
        return query_triples(self.triples, self.nodes, self.known, **filters)

    def around(self, kind: str, name: str, limit: int = 50) -> DataFrame:
        return neighborhood(self.triples, self.nodes, kind, name, limit)

    def stats(self) -> dict[str, DataFrame]:
        return stats(self.triples, self.nodes, self.known)


def wikilink_nodes(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """links(link) with the node each means: a file of that label, else a concept."""
    files = nodes.where("kind = 'file'").select(F.col("normalized_label").alias("_l"), F.col("id").alias("_file"))
    rows = links.withColumn("_l", label(F.col("link"))).join(files, "_l", "left")
    return rows.select(*links.columns, F.when(F.col("_file").isNotNull(), "file").otherwise("concept").alias("kind"), F.coalesce("_file", F.xxhash64(F.lit("concept"), "_l")).alias("node_id"))


def frontmatter_statements(notes: DataFrame) -> DataFrame:
    """Statements of notes(path, meta map<string, array<string>>): up, links, keywords and tags, and any key named 'predicate:NAME'."""
    kinds = {"up": ("childOf", "concept"), "links": ("relatesTo", "concept"), "keywords": ("mentions", "concept"), "tags": ("taggedWith", "tag")}
    rows = notes.select("path", F.explode("meta").alias("key", "values")).select("path", "key", F.explode("values").alias("value"))
    name = F.element_at(F.create_map(*[F.lit(x) for k, (p, _) in kinds.items() for x in (k, p)]), F.col("key"))
    name = F.coalesce(name, F.nullif(F.regexp_extract("key", r"^predicate:\s*(\w+)$", 1), F.lit("")))
    bare = strip(F.regexp_replace("value", r"^\[\[|(\|[^\]]*)?\]\]$", ""))
    out = rows.select(F.lit("file").alias("subject_kind"), F.col("path").alias("subject"), name.alias("predicate"), F.when(F.col("key") == "tags", "tag").otherwise("concept").alias("object_kind"), F.when(F.col("key") == "tags", F.regexp_replace(bare, "^#", "")).otherwise(bare).alias("object"), F.lit("frontmatter").alias("provenance"), F.col("path").alias("ref"))
    return out.where("predicate is not null and object <> ''").distinct()


def body_statements(notes: DataFrame) -> DataFrame:
    """relatesTo statements of the wikilinks in notes(path, body)."""
    return notes.select(F.lit("file").alias("subject_kind"), F.col("path").alias("subject"), F.lit("relatesTo").alias("predicate"), F.lit("concept").alias("object_kind"), F.explode(wikilinks(F.col("body"))).alias("object"), F.lit("wikilink").alias("provenance"), F.col("path").alias("ref"))


def bookmark_statements(bookmarks: DataFrame, concept) -> DataFrame:
    """Statements of bookmarks(url, title, domain, tags, folder): domain, tags, folder, and concepts of the title."""
    one = lambda p, kind, name: (F.lit(p).alias("predicate"), F.lit(kind).alias("object_kind"), name.alias("object"))
    base = (F.lit("web_page").alias("subject_kind"), F.col("url").alias("subject"))
    end = (F.lit("bookmark").alias("provenance"), F.col("url").alias("ref"))
    legs = [
        bookmarks.select(*base, *one("relatesTo", "domain", F.col("domain")), *end),
        bookmarks.select(*base, *one("taggedWith", "tag", F.explode("tags")), *end),
        bookmarks.select(*base, *one("inFolder", "folder", F.col("folder")), *end),
        bookmarks.select(*base, *one("mentions", "concept", F.explode(concept(F.col("title")))), *end),
    ]
    out = legs[0].union(legs[1]).union(legs[2]).union(legs[3])
    return out.where("object is not null and object <> ''").distinct()


def message_statements(recipients: DataFrame, threads: DataFrame) -> DataFrame:
    """sentTo and inThread statements; a message's label is its table and id."""
    subject = F.concat_ws(":", "source_table", "id")
    sent = recipients.select(F.lit("message").alias("subject_kind"), subject.alias("subject"), F.lit("sentTo").alias("predicate"), F.lit("contact").alias("object_kind"), F.col("address").alias("object"), F.col("source_table").alias("provenance"), F.lit(None).cast("string").alias("ref"))
    held = threads.select(F.lit("message").alias("subject_kind"), subject.alias("subject"), F.lit("inThread").alias("predicate"), F.lit("thread").alias("object_kind"), F.col("thread").alias("object"), F.col("source_table").alias("provenance"), F.lit(None).cast("string").alias("ref"))
    return sent.union(held)


def depths(edges: DataFrame) -> DataFrame:
    """(node, depth) of edges(child, parent): the longest way up; 0 without a parent. A node in a cycle, or below one, is in no row.

    Each round takes the nodes all of whose parents have a depth, and the rest
    of the edges is written down, so a round costs what is left and nothing of
    the earlier ones is computed again. There are as many rounds as levels.
    """
    left = kept(edges.where("child is not null and parent is not null").select("child", "parent").distinct(), "depths")
    nodes = left.select(F.col("child").alias("node")).union(left.select("parent")).distinct()
    level, found = 0, kept(nodes.join(left.select(F.col("child").alias("node")), "node", "left_anti").withColumn("depth", F.lit(0)), "depths")
    done = found
    while not found.isEmpty():
        level += 1
        rest = kept(left.join(found.select(F.col("node").alias("parent")), "parent", "left_anti"), "depths")
        free = left.join(found.select(F.col("node").alias("parent")), "parent", "left_semi").select(F.col("child").alias("node")).distinct()
        found = kept(free.join(rest.select(F.col("child").alias("node")), "node", "left_anti").withColumn("depth", F.lit(level)), "depths")
        done, left = done.union(found), rest
    return done
