"""URL filters: hosts and paths as words, scored by multinomial naive Bayes.

Names that run words together are split by a unigram model (Viterbi). The
model's words aren't sent to tasks: the substrings of the distinct names are
joined with the word counts, so either side may grow with the corpus.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import written

#: Words of the usual blocklist categories (gambling, adult, drugs, credit, piracy, advertising, spam). Without labels, a host that holds one is of the bad class.
SEED = tuple(
    "casino casinos poker roulette blackjack slots lottery jackpot bet bets betting adult porn porno sex xxx nude escort escorts hookup viagra cialis pharmacy pills steroids payday loan loans forex warez keygen torrent torrents malware phishing"
    " ads adserver banner banners popup popups tracker trackers clickbait spam".split()
)
#: Longest word of the unigram model; least share of the corpus that a seed word counts as; Laplace's addend; odds from which a URL is blocked.
LONGEST, FLOOR, ALPHA, BLOCK_AT = 24, 1e-6, 1.0, 0.0
#: Letters of a name that are looked through for words at a time.
PIECE = 256


def word_counts(pages: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(word, n): words of the visible text of all pages; what isn't closed goes on to the end of the page."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b(?:.*?</\1>|.*+)", " "), "<[^>]*+>?", " ")
    words = pages.where("html is not null").select(F.explode(F.split(F.lower(bare), r"[^\p{L}]+")).alias("word"))
    return words.where((F.length("word") >= 2) & (F.length("word") <= longest)).groupBy("word").agg(F.count("*").alias("n"))


def hyphenated(urls: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(word, n): words that distinct URLs join by hyphens or underscores."""
    runs = urls.select(F.explode(F.regexp_extract_all(F.lower("url"), F.lit(r"(?<!\p{L})\p{L}++(?:[\-_]\p{L}++)+"), F.lit(0))).alias("run"))
    words = runs.select(F.explode(F.split("run", r"[\-_]")).alias("word"))
    return words.where((F.length("word") >= 2) & (F.length("word") <= longest)).groupBy("word").agg(F.count("*").alias("n"))


def segment(name: str, known: list[tuple[int, int, float]], total: float) -> list[str]:
    """The likeliest split of name, in time that follows its length.

    known: (start, length, log probability) of the words in it; any other span
    costs as an unknown word does, a tenth for each letter after 10 / total.
    Of equally likely splits the one of fewer words is taken, then the one
    whose last word is longer.
    """
    ending: dict[int, list[tuple[int, float]]] = {}
    for start, length, p in known:
        ending.setdefault(start + length, []).append((start, p))
    opened, letter = math.log(10 / total), math.log(10)
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    run: tuple[float, int, int] | None = None  # the best split that ends in an unknown word
    for end in range(1, len(name) + 1):
        p, words, start = best[end - 1]
        begun = (round(p + opened - letter, 9), words - 1, 1 - end)
        longer = (round(run[0] - letter, 9), run[1], run[2]) if run else begun
        run = max(begun, longer)
        options = [run, *((round(best[start][0] + p, 9), best[start][1] - 1, -start) for start, p in ending.get(end, ()))]
        best.append(max(options))
    out, end = [], len(name)
    while end:
        start = -best[end][2]
        out.append(name[start:end])
        end = start
    return out[::-1]


def _segmented(total: float):
    def run(it):
        for batch in it:
            names, found = batch.column("name").to_pylist(), batch.column("known").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([segment(n, [(k["start"], k["length"], k["p"]) for k in f or ()], total) for n, f in zip(names, found, strict=True)], pa.list_(pa.string()))], ["name", "words"])

    return run


def segmented(names: DataFrame, counts: DataFrame, longest: int = LONGEST, seed=SEED) -> DataFrame:
    """(name, words) of each distinct name, by the words of counts(word, n) and seed."""
    spark = names.sparkSession
    total = float(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) + 1.0
    lexicon = spark.createDataFrame([(w, max(1, math.ceil(total * FLOOR))) for w in sorted(set(seed))], "word string, n long")
    model = counts.union(lexicon).groupBy("word").agg(F.max("n").alias("n")).select("word", F.log(F.col("n") / F.lit(total)).alias("p"))
    keyed = names.select("name", F.xxhash64("name").alias("of"))
    pieces = keyed.select(
        "of",
        F.explode(F.expr(f"transform(sequence(0, (length(name) - 1) div {PIECE}), c -> struct(c * {PIECE} as base, substring(name, c * {PIECE} + 1, {PIECE + longest - 1}) as piece))")).alias("x"),
    ).select("of", "x.*")
    spans = pieces.select(
        "of", "base",
        F.explode(F.expr(f"flatten(transform(sequence(0, least({PIECE}, length(piece)) - 1), s -> transform(sequence(1, least({longest}, length(piece) - s)), l -> struct(s, l as length, substring(piece, s + 1, l) as word))))")).alias("x"),
    ).select("of", (F.col("base") + F.col("x.s")).cast("int").alias("start"), "x.length", "x.word")
    known = spans.join(model, "word").groupBy("of").agg(F.collect_list(F.struct("start", "length", "p")).alias("known"))
    return keyed.join(known, "of", "left").select("name", "known").mapInArrow(_segmented(total), "name string, words array<string>")


KEY = ["u", "v"]


def _keyed(urls: DataFrame) -> DataFrame:
    """urls with 96 bits of hash, which stand for a URL of any length in joins; null for a null."""
    return urls.withColumns({"u": F.when(F.col("url").isNotNull(), F.xxhash64("url")), "v": F.hash("url")})


def _named(urls: DataFrame) -> DataFrame:
    """(u, v, kind, at, name): the letter runs of host and path. The last label of a host, 'www' and the user and port are left out."""
    url = F.trim(F.lower("url"))
    parts = urls.select(*KEY, F.regexp_replace(F.regexp_extract(url, r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1), r"^.*@|:\d*$", "").alias("host"), F.regexp_extract(url, r"^[a-z][a-z0-9+.\-]*://[^/?#]*([^?#]*)", 1).alias("path"))
    parts = parts.where("host <> ''")
    label = F.regexp_replace(F.regexp_replace("host", r"^www\.", ""), r"\.[^.]*$", "")
    names = F.concat(
        F.transform(F.filter(F.split(label, r"[^\p{L}]+"), lambda x: x != ""), lambda x: F.struct(F.lit("h").alias("kind"), x.alias("name"))),
        F.transform(F.filter(F.split("path", r"[^\p{L}]+"), lambda x: x != ""), lambda x: F.struct(F.lit("p").alias("kind"), x.alias("name"))),
    )
    return parts.select(*KEY, F.posexplode_outer(names).alias("at", "x")).select(*KEY, "at", "x.kind", "x.name")


def filtered(pages: DataFrame, labels: DataFrame | None = None, counts: DataFrame | None = None, block_at: float = BLOCK_AT, seed=SEED) -> DataFrame:
    """(page_id, url, host_words, log_odds, verdict) of every row of pages(page_id, url, html).

    The unigram model counts the words of the text of all pages and those that
    URLs join by hyphens, or is given as counts(word, n). Naive Bayes is trained on all
    distinct URLs: labels(url, bad boolean) says which are bad, or, without it,
    those are whose host, split into words, holds one of seed: the model then
    finds what else such hosts and their paths are made of. log_odds sums, over
    the words of host and path, the log ratio of their shares in bad and other
    URLs, and that of the classes; from block_at on the verdict is 'block',
    below it 'allow'. Words that one class lacks count by Laplace's rule. A URL
    that is null or names no host has nulls and 'invalid'. Names and pages of
    any length are taken whole; only words of up to LONGEST letters are known
    ones. Repeated URLs get one result each row; a null page_id stays null;
    other columns are ignored. With an empty table there are no rows; without
    bad URLs, or without others, log_odds is null and the verdict 'allow'.
    """
    urls = _keyed(pages.select("url").where("url is not null").distinct())
    names = written(_named(urls), "url-names")
    if counts is None:
        counts = written(word_counts(pages).union(hyphenated(urls)).groupBy("word").agg(F.sum("n").alias("n")), "url-word-counts")
    seg = segmented(names.where("name is not null").select("name").distinct(), counts, seed=seed)
    words = names.join(seg, "name", "left").select(*KEY, "kind", "at", F.posexplode_outer("words").alias("n", "word"))
    words = written(words.withColumn("token", F.concat("kind", F.lit(":"), "word")), "url-words")
    if labels is None:
        flags = words.groupBy(*KEY).agg((F.count_if((F.col("kind") == "h") & F.col("word").isin(*seed)) > 0).alias("bad"))
    else:
        flags = _keyed(labels.where("url is not null")).groupBy(*KEY).agg(F.max("bad").alias("bad"))
    words = words.join(flags, KEY, "left")
    classes = words.groupBy(*KEY).agg(F.max("bad").alias("bad")).agg(F.count_if("bad"), F.count_if(~F.col("bad"))).first()
    tokens = words.where("token is not null").groupBy("token").agg(F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("g"))
    sums = tokens.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("g"), F.lit(0)), F.count("*")).first()
    if classes[0] and classes[1]:
        size = ALPHA * max(1, sums[2])
        odds = tokens.select("token", (F.log((F.col("b") + ALPHA) / F.lit(sums[0] + size)) - F.log((F.col("g") + ALPHA) / F.lit(sums[1] + size))).alias("odds"))
        joined = words.join(odds, "token", "left")
        score = F.sum(F.coalesce("odds", F.lit(0.0))) + F.lit(math.log(classes[0] / classes[1]))
    else:
        joined, score = words, F.lit(None).cast("double")
    host = F.array_sort(F.collect_list(F.when((F.col("kind") == "h") & F.col("word").isNotNull(), F.struct("at", "n", "word"))))
    by_url = joined.groupBy(*KEY).agg(F.transform(host, lambda x: x["word"]).alias("host_words"), score.alias("log_odds"))
    out = _keyed(pages.select("page_id", "url")).join(by_url, KEY, "left")
    verdict = F.when(F.col("host_words").isNull(), "invalid").when(F.col("log_odds") >= block_at, "block").otherwise("allow")
    return out.select("page_id", "url", F.array_join("host_words", " ").alias("host_words"), "log_odds", verdict.alias("verdict"))


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return filtered(spark.read.parquet(f"{sf_dir}/pages.parquet"))
