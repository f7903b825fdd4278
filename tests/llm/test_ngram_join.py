"""The prefix-tree join against all pairs, and its odd cases."""

import random
import re
import tracemalloc
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import ngram_join as nj
from tessera.llm import passages as ps
from tessera.llm.components import connected_components


def grams(text, n):
    w = re.findall(r"[0-9a-z_\x80-\U0010ffff]+", text.lower())
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def all_classes(docs, n, t):
    """(doc_id, class_id, links) by comparing all pairs of rows."""
    sets = [grams(x or "", n) for _, x in docs]
    links, up = [0] * len(docs), list(range(len(docs)))
    for i, j in combinations(range(len(docs)), 2):
        x, y = sets[i], sets[j]
        if x and y and Fraction(len(x & y), len(x | y)) >= t:
            links[i] += 1
            links[j] += 1
            a, b = up[i], up[j]
            up = [min(a, b) if u in (a, b) else u for u in up]
    ids = [min((docs[j][0] for j in range(len(docs)) if up[j] == up[i] and docs[j][0] is not None), default=None) for i in range(len(docs))]
    return sorted(((docs[i][0], ids[i], links[i]) for i in range(len(docs)) if links[i]), key=str)


def corpus(seed, size=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    base = [[r.choice(words) for _ in range(r.randint(1, 40))] for _ in range(8)]
    docs = []
    for i in range(size):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(words)
        docs.append((i, " ".join(w)))
    return docs


@pytest.mark.parametrize(
    ("seed", "t", "more"),
    [
        (1, Fraction(2, 5), {}),
        (2, Fraction(2, 5), {"block": 30}),
        (3, Fraction(7, 10), {"bucket_bytes": 500}),
        (4, Fraction(1), {"block": 10, "bucket_bytes": 2000}),
        (5, Fraction(1, 2), {"hot_share": 2.0, "bucket_bytes": 900}),
        (6, Fraction(2, 5), {"hot_share": 0.2, "bucket_bytes": 900, "block": 100}),
    ],
)
def test_same_as_all_pairs(spark, seed, t, more):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in nj.similar_documents(df, 3, t, **more).collect()), key=str)
    assert got == all_classes(docs, 3, t) and got
    kept = {r.doc_id for r in nj.one_of_each(df, 3, t, **more).collect()}
    assert kept == {i for i, _ in docs} - {i for i, c, _ in got if i != c}


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(70_000))
    docs = [(1, "a b c d e"), (1, "a b c d e"), (2, "A, b; c\nd e!"), (None, "a b c d e"), (3, None), (4, ""), (5, "..."), (6, "é"), (7, "É"), (8, long), (9, long + " end"), (1, "z z z z z z"), (None, "q r s t u"), (None, "q r s t u"), (None, None), (10, "only once here now"), (10, "only once here now")]
    df = spark.createDataFrame([(i, t, i, "x") for i, t in docs], "doc_id long, text string, node long, tokens string")
    got = sorted((tuple(r) for r in nj.similar_documents(df).collect()), key=str)
    assert got == all_classes(docs, 4, Fraction(2, 5))
    assert (None, 1, 3) in got and (None, None, 1) in got and (9, 8, 1) in got
    kept = nj.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)[:9]) for r in kept.collect()) == sorted([("1", "a b c d e"), ("3", "None"), ("4", ""), ("5", "..."), ("6", "é"), ("8", "x0 x1 x2 "), ("1", "z z z z z"), ("None", "q r s t u"), ("None", "None"), ("10", "only once")])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nj.similar_documents(df).count() == 0
    assert nj.one_of_each(df).count() == 0


def test_chains_of_intervals_are_those_of_points():
    r = np.random.default_rng(3)
    for _ in range(50):
        h, n = np.sort(r.integers(0, 3, 40)).astype(np.uint64), r.integers(1, 200, 40)
        h, n = h[(order := np.lexsort((n, h)))], n[order]
        at = nj._chains(h, n, n, 2, 5)
        whole = np.repeat(np.arange(len(at)), np.diff(np.r_[at, 40]))
        half = r.random(40) < 0.5
        parts = []
        for some in (np.flatnonzero(half), np.flatnonzero(~half)):
            a = nj._chains(h[some], n[some], n[some], 2, 5)
            parts += [(h[some][i], n[some][i:j].min(), n[some][i:j].max(), {*whole[some[i:j]]}) for i, j in zip(a, np.r_[a[1:], len(some)], strict=True)]
        parts.sort(key=lambda x: x[:2])
        merged = nj._chains(np.array([p[0] for p in parts]), np.array([p[1] for p in parts]), np.array([p[2] for p in parts]), 2, 5)
        groups = [set().union(*(p[3] for p in parts[i:j])) for i, j in zip(merged, np.r_[merged[1:], len(parts)], strict=True)]
        assert groups == [{k} for k in range(len(at))]


def test_tree_finds_all():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 30, r.integers(1, 20))).astype(np.uint32) for _ in range(80)]
    sizes = np.array([len(s) for s in sets]) + r.integers(0, 3, 80)
    tree, mark = nj.PrefixTree(sets, sizes), np.zeros(30, np.uint8)
    for q, s in enumerate(sets):
        found, overlap = tree.similar(s, int(sizes[q]), mark, 1, 2)
        want = {k: len(np.intersect1d(s, x)) for k, x in enumerate(sets) if 2 * len(np.intersect1d(s, x)) >= sizes[q] + sizes[k] - len(np.intersect1d(s, x))}
        assert dict(zip(found.tolist(), overlap.tolist(), strict=True)) == want
    assert not mark.any()


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_components(spark, limit):
    r = random.Random(5)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(None, 1), (7, 7)] + [(100 + i, 101 + i) for i in range(30)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    nodes = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), limit).collect()
    assert {(r.node, r.component) for r in got} == {(x, root(x)) for x in nodes}
    assert connected_components(spark.createDataFrame([], "a long, b long"), limit).count() == 0


def test_links_hold_every_pair_and_few_others():
    """Rows (n-gram, size, most, set) in two halves, as two map tasks send them: sets that are within each other's bound are linked, others only by way of such or of two wide ones."""
    r = np.random.default_rng(7)
    for least in (1, 1000):
        for _ in range(60):
            h, n, who = r.integers(0, 3, 24), r.integers(1, 40, 24), r.permutation(24)
            most = (r.random(24) * 2.5 * n).astype(np.int64) + 1
            half, sent, edges = r.random(24) < 0.5, [], []
            for some in (half, ~half):
                chains, found, rest = nj._chained(h[some], n[some], most[some], who[some])
                if least == 1:
                    rest = rest[np.lexsort(rest.T[::-1])]
                sent += [chains, rest]
                edges.append(found)
            edges = [*np.concatenate(edges), *nj._chained(*np.concatenate(sent).T)[1]]
            up = np.arange(24)
            for a, b in edges:
                up[up == up[a]] = up[b]
            for i, j in combinations(range(24), 2):
                if h[i] == h[j] and n[i] <= most[j] and n[j] <= most[i]:
                    assert up[who[i]] == up[who[j]]
            for a, b in edges:
                i, j = (int(np.flatnonzero(who == x)[0]) for x in (a, b))
                assert h[i] == h[j] and (most[i] >= n[i] or most[j] >= n[j])


def test_equal_rows_that_no_chain_holds_go_together_beyond_rest():
    rest = np.array([(5, 9, 4, i) for i in range(2 * nj.REST)] + [(6, 9, 4, 7), (6, 9, 4, 8)])
    rows, edges = nj._fewer(rest)
    assert sorted(map(tuple, rows.tolist())) == [(5, 9, 4, 0), (6, 9, 4, 7), (6, 9, 4, 8)]
    assert sorted(map(tuple, edges.tolist())) == [(0, i) for i in range(1, 2 * nj.REST)]
    assert nj._fewer(rest[:0])[0].shape == (0, 4)


def packed_sets(sets, lead):
    """Sets of n-grams in the global order as _postings reads them."""
    tokens = pa.array([np.array(s, np.uint64).tobytes() for s in sets], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(range(len(sets)), pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([lead] * len(sets), pa.int32()), tokens], ["node", "n", "lead", "tokens"])


def linked(sets, lead):
    found = list(nj._postings(1, 2, 5)(iter([packed_sets(sets, lead)])))
    table = nj._links(*(2, 5)[: nj._links.__code__.co_argcount])(pa.Table.from_batches(found))
    return sorted(zip(table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True))


def test_sets_that_share_too_few_ngrams_from_their_first_common_one_on_are_not_linked():
    """Two sets of 10 with Jaccard 0.4 share 6 n-grams: if the first common one is the sixth of either, 5 are left at most."""
    late = [[*range(100 * i, 100 * i + 5), 900, *range(100 * i + 10, 100 * i + 14)] for i in range(3)]
    assert linked(late, 7) == []
    early = [[*range(100 * i, 100 * i + 4), 900, *range(100 * i + 10, 100 * i + 15)] for i in range(3)]
    assert linked(early, 7) == [(0, 1), (0, 2)]


def bucket(sets, each, own):
    """What a bucket gets: so many sets of `each` n-grams, of which `own` are in one set alone."""
    r = np.random.default_rng(1)
    common = r.integers(0, 2**40, each - own).astype(np.uint64)
    h = np.concatenate([np.r_[r.integers(0, 2**40, own).astype(np.uint64), common] for _ in range(sets)])
    packed = [nj._five_bytes(h), np.arange(sets, dtype=np.uint64), np.full(sets, each, np.uint16)]
    return pa.table({"part": pa.array([0], pa.int32())} | {c: pa.array([packed.pop(0).tobytes() if packed else b""], pa.binary()) for c in ("tokens", "sets", "counts", "hot", "hot_sets", "hot_counts", "meta", "members")})


def test_a_bucket_takes_few_bytes_an_ngram():
    table = bucket(1000, 1000, 950)
    tracemalloc.start()
    nj._shared(4)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * 1_000_000


def test_slices_change_no_row(monkeypatch):
    table = bucket(50, 100, 60)
    whole = nj._shared(4)(table)
    monkeypatch.setattr(nj, "SLICE", 100)
    assert nj._shared(4)(table).equals(whole) and whole.num_rows == 5


def test_what_the_driver_sends_to_all_tasks_is_bounded_by_bytes(spark):
    """Rows of few numbers take 150 bytes each there."""
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()
    for n, small in ((50_000, True), (150_000, False)):
        assert hinted(nj._sent(spark.range(n))) is small
        assert hinted(ps._small(spark.range(n).selectExpr("id AS row", "array(id) AS again"), "again")) is small
    assert not hinted(ps._small(spark.range(3).selectExpr("id AS row", "sequence(1, 1000000) AS again"), "again"))
