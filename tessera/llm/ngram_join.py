"""N-gram Jaccard join by prefix trees.

The n-gram sets of all documents are put into one global order (rarest
n-grams first). Documents with equal sets become one; n-grams that occur in a
single set are only counted, for they can't be shared. By the prefix bound a
pair of Jaccard similarity t shares one of the first
size - ceil(t * size) + 1 n-grams of either, and from the first common one on
either has as many left as they have in common; so these link the sets that can
be similar into components. The sets of a component are stored, commonest
n-grams first, in a prefix tree, which every set of the component traverses:
paths share the overlap of their common beginning, and subtrees whose
remaining length can't bring the overlap to the least needed are pruned. The
join is exact: there is no cap or sketch.

What crosses the network is packed: a row holds the n-grams that a few
thousand documents have in one bucket, as bytes. The number of buckets follows
the bytes of the texts, and no group of copies falls into one of them: a map
task sends equal sets once, documents are spread by their own hash, n-grams
that a hundredth of all documents hold go straight to their sets, and equal
beginnings of sets cross as intervals of sizes.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textbytes as tb
from tessera.llm.components import connected_components
from tessera.llm.shared import fresh, row_key, written

U64 = np.uint64
N, THRESHOLD = 4, Fraction(2, 5)
#: n-grams of a bucket that are sorted at a time, or a sixty-fourth of them if that is more.
SLICE = 250_000
#: n-grams gathered by a map task before it writes them out; n-grams, and sets, of one side of a block of a large component; n-grams of a bundle of small ones.
GATHER, BLOCK, BLOCK_SETS, BUNDLE = 500_000, 250_000, 1000, 250_000
#: Bytes of text of which a bucket holds the n-grams; a task needs about five times as much memory for them. Buckets are smaller, down to the second figure, where cores would be idle.
BUCKET_BYTES, LEAST_BUCKET_BYTES = 20_000_000, 4_000_000
#: Rows that are sent to all tasks by way of the driver, about 150 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: n-grams that this share of about so many documents hold go around the buckets. Which these are changes no result.
HOT_SHARE, HOT_DOCUMENTS = 0.01, 4096
#: Sets in no chain that a batch sends for one n-gram, one by one.
REST = 1000
NONE = np.int64(2**63 - 1)

_PACKED = "part int, tokens binary, sets binary, counts binary, hot binary, hot_sets binary, hot_counts binary, meta binary, members binary"
_SHARED = "part int, origin int, tokens binary, sets binary, counts binary, df binary, meta binary, members binary"
_SETS = "node long, doc_id long, row long, n long, members long, shared int, tokens binary, df binary, lead int"


def _bounds(sorted_keys: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(sorted_keys, np.arange(n + 1))


def _runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    if len(keys) == 0:
        return np.zeros(1, np.int64)
    return np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]


def _by_part(part: np.ndarray, sets: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of items ordered by part, then set: the sets named in each part, how many items each has there, and where each part's begin."""
    change = _runs(sets) if len(part) == 0 else np.r_[0, np.flatnonzero((part[1:] != part[:-1]) | (sets[1:] != sets[:-1])) + 1, len(part)]
    size = np.diff(change)
    if size.max(initial=0) > 65_535:  # a count has two bytes: a longer run is named again for each further 65,535
        change = np.r_[np.concatenate([np.arange(a, b, 65_535) for a, b in zip(change, change[1:], strict=False)]), len(part)]
    first = change[:-1]
    return sets[first], np.diff(change).astype(np.uint16), np.searchsorted(part[first], np.arange(parts + 1))


def _five_bytes(h: np.ndarray) -> np.ndarray:
    """The low 40 bits. Buckets are chosen by the others, so what is kept of a hash grows with their number."""
    return np.ascontiguousarray(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :5]).reshape(-1)


def _from_five_bytes(raw: np.ndarray) -> np.ndarray:
    h = np.zeros((len(raw) // 5, 8), np.uint8)
    h[:, :5] = raw.reshape(-1, 5)
    return h.reshape(-1).view(U64)


def _whole(run):
    """The function of a whole partition, for mapInArrow."""

    def over(it):
        batches = list(it)
        if batches:
            yield from run(pa.Table.from_batches(batches)).to_batches()

    return over


def _grams_of(part: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, names of the sets, their sizes, their rows) of the texts that have any."""
    h, t = tb.distinct_grams(part.column("text"), n)
    at = _runs(t)
    sizes = np.diff(at)
    if not len(h):
        return h, h, sizes, t
    return h, tb.mix(np.add.reduceat(tb.mix(h ^ U64(0x5851F42D4C957F2D)), at[:-1]) + sizes.astype(U64)), sizes, t[at[:-1]]


def _pack(n: int, parts: int, hot):
    """What a few thousand documents have for each bucket: n-grams with their sets, hot ones apart, sets, documents."""

    def rows(h, name, size, doc_id, row):
        members = np.stack([name, doc_id.view(U64), row.view(U64)], 1)
        order = np.argsort(name, kind="stable")
        at = _runs(name[order])
        own = order[at[:-1]]
        meta = np.stack([name[own], size[own].astype(U64), np.diff(at).astype(U64), np.minimum.reduceat(doc_id[order], at[:-1]).view(U64)], 1)
        once = np.zeros(len(name), bool)
        once[own] = True
        h, sets = h[np.repeat(once, size)], np.repeat(name[once], size[once])
        often = np.zeros(len(h), bool)
        if len(hot.value):
            place = np.minimum(np.searchsorted(hot.value, h), len(hot.value) - 1)
            often = hot.value[place] == h
        columns = [pa.array(np.arange(parts), pa.int32())]
        for part, value, who in (((h >> U64(40)) % U64(parts), h, sets), (sets % U64(parts), place.astype(U64) if often.any() else h, sets)):
            mask = often if len(columns) > 1 else ~often
            part, value, who = part[mask].astype(np.uint16 if parts < 65536 else np.uint32), value[mask], who[mask]
            order = np.argsort(part, kind="stable")
            value, who, part = value[order], who[order], part[order]
            named, counts, named_at = _by_part(part, who, parts)
            columns += [tb.binary(_five_bytes(value), _bounds(part, parts) * 5), tb.binary(named, named_at), tb.binary(counts, named_at)]
        for table, home in ((meta, meta[:, 0] % U64(parts)), (members, members[:, 2] % U64(parts))):
            order = np.argsort(home, kind="stable")
            columns.append(tb.binary(np.ascontiguousarray(table[order]).reshape(-1), _bounds(home[order].astype(np.int64), parts) * table.shape[1]))
        batch = pa.RecordBatch.from_arrays(columns, ["part", "tokens", "sets", "counts", "hot", "hot_sets", "hot_counts", "meta", "members"])
        return batch.filter(pa.array(np.sum([np.diff(tb.text_bytes(c)[1]) for c in columns[1:]], axis=0) > 0))

    def run(it):
        kept, size = [], 0
        for batch in it:
            for part in tb.chunks(batch, "text"):
                h, name, sizes, at = _grams_of(part, n)
                if len(h):
                    ids = part.column("doc_id").fill_null(int(NONE)).to_numpy(zero_copy_only=False)[at]
                    kept.append((h, name, sizes, ids, part.column("row").to_numpy()[at]))
                    size += len(h)
                if size >= GATHER:
                    yield rows(*map(np.concatenate, zip(*kept, strict=True)))
                    kept, size = [], 0
        if size:
            yield rows(*map(np.concatenate, zip(*kept, strict=True)))

    return run


def _of_several(h: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, sets, number of sets) of the n-grams that more than one set has, ordered by n-gram, then set."""
    order = np.lexsort((sets, h))
    h, sets = h[order], sets[order]
    if len(h):
        keep = np.r_[True, (h[1:] != h[:-1]) | (sets[1:] != sets[:-1])]
        h, sets = h[keep], sets[keep]
    at = _runs(h)
    df = np.repeat(np.diff(at), np.diff(at))
    keep = df > 1
    return h[keep], sets[keep], df[keep]


def _shared(parts: int):
    """Of one bucket's n-grams, those that more than one set has, sent on to the bucket of each set."""
    names = ["part", "origin", "tokens", "sets", "counts", "df", "meta", "members"]

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        h = _from_five_bytes(tb.unpacked(table.column("tokens"), np.uint8))
        sets = np.repeat(tb.unpacked(table.column("sets"), U64), tb.unpacked(table.column("counts"), np.uint16))
        bits = min(6, (len(h) // SLICE).bit_length())
        slice_of = (h >> U64(40 - bits)).astype(np.uint32)
        found = [_of_several(h[some], sets[some]) for some in (slice_of == k for k in range(1 << bits))]
        del h, sets, slice_of
        h, sets, df = map(np.concatenate, zip(*found, strict=True))
        home = (sets % U64(parts)).astype(np.int64)
        order = np.lexsort((sets, home))
        h, sets, df, home = h[order], sets[order], df[order], home[order]
        at = _bounds(home, parts)
        named, counts, named_at = _by_part(home, sets, parts)
        empty = tb.binary(np.zeros(0, np.uint8), np.zeros(parts + 1, np.int64))
        out = pa.Table.from_arrays([pa.array(np.arange(parts), pa.int32()), pa.array([part] * parts, pa.int32()), tb.binary(_five_bytes(h), at * 5), tb.binary(named, named_at), tb.binary(counts, named_at), tb.binary(_levels(df), at), empty, empty], names).filter(pa.array(np.diff(at) > 0))
        hot, hot_sets, hot_counts, meta, members = (tb.unpacked(table.column(c), np.uint8).tobytes() for c in ("hot", "hot_sets", "hot_counts", "meta", "members"))
        own = pa.Table.from_arrays([pa.array([part], pa.int32()), pa.array([parts], pa.int32()), *(pa.array([x], pa.binary()) for x in (hot, hot_sets, hot_counts, b"\xff" * (len(hot) // 5), meta, members))], names)
        return pa.concat_tables([out, own])

    return run


def _levels(df: np.ndarray) -> np.ndarray:
    """Frequency as one byte: exact to 128, then by powers of 2 to the eighth; any monotone levels serve as a global order."""
    big = 128 + np.floor(8 * np.log2(np.maximum(df, 128) / 128)).astype(np.int64)
    return np.minimum(np.where(df <= 128, df, big), 255).astype(np.uint8)


def _collected(num: int, den: int):
    """A row for each set: its shared n-grams in the global order, and how many of these are in its prefix; and one for each document, with nulls for n and all after."""

    def run(table: pa.Table) -> pa.Table:
        origin = np.repeat(table.column("origin").to_numpy(), tb.lengths_of(table.column("tokens"), 5))
        h = _from_five_bytes(tb.unpacked(table.column("tokens"), np.uint8)) | (origin.astype(U64) << U64(40))
        df = tb.unpacked(table.column("df"), np.uint8)
        sets = np.repeat(tb.unpacked(table.column("sets"), U64), tb.unpacked(table.column("counts"), np.uint16))
        order = np.lexsort((h, df, sets))
        h, df, sets = h[order], df[order], sets[order]
        if len(h):  # a hot n-gram of a set comes from each map task that has the set
            keep = np.r_[True, (h[1:] != h[:-1]) | (sets[1:] != sets[:-1])]
            h, df, sets = h[keep], df[keep], sets[keep]
        meta = tb.unpacked(table.column("meta"), U64).reshape(-1, 4)
        meta = meta[np.argsort(meta[:, 0], kind="stable")]
        at = _runs(meta[:, 0])
        names, n = meta[at[:-1], 0], meta[at[:-1], 1].astype(np.int64)
        members, least = (np.add.reduceat(meta[:, 2], at[:-1]), np.minimum.reduceat(meta[:, 3], at[:-1])) if len(meta) else (meta[:, 2], meta[:, 3])
        lo, hi = np.searchsorted(sets, names, "left"), np.searchsorted(sets, names, "right")
        once = n - (hi - lo)
        lead = np.clip(n - -(-n * num // den) + 1 - once, 0, hi - lo)
        keep = np.flatnonzero((lead > 0) | (members > 1))
        lo, hi = np.where(lead > 0, lo, 0)[keep], np.where(lead > 0, hi, 0)[keep]
        who = tb.unpacked(table.column("members"), U64).reshape(-1, 3)
        long = lambda a: np.ascontiguousarray(a).view(np.int64)
        ids = np.r_[long(least[keep]), long(who[:, 1])]
        columns = [pa.array(n[keep]), pa.array(long(members[keep])), pa.array(hi - lo, pa.int32()), pa.array([h[a:b].tobytes() for a, b in zip(lo, hi, strict=True)], pa.binary()), pa.array([df[a:b].tobytes() for a, b in zip(lo, hi, strict=True)], pa.binary()), pa.array(lead[keep], pa.int32())]
        columns = [pa.concat_arrays([c, pa.nulls(len(who), c.type)]) for c in columns]
        return pa.Table.from_arrays(
            [pa.array(np.r_[long(names[keep]), long(who[:, 0])]), pa.array(ids, pa.int64(), mask=ids == NONE), pa.concat_arrays([pa.nulls(len(keep), pa.int64()), pa.array(long(who[:, 2]))]), *columns],
            ["node", "doc_id", "row", "n", "members", "shared", "tokens", "df", "lead"],
        )

    return run


def _chains(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, num: int, den: int) -> np.ndarray:
    """Where chains begin among intervals of sizes ordered by n-gram, then lo: a step to a size that can't be similar ends one."""
    if len(h) == 0:
        return np.zeros(0, np.int64)
    group = np.cumsum(np.r_[0, h[1:] != h[:-1]]).astype(np.int64) << np.int64(33)
    reach = np.maximum.accumulate(group + hi) - group
    return np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (reach[:-1] * den < lo[1:] * num)])


def _chained(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chains, edges, rest) of rows (n-gram, lo, hi, set).

    A set of n n-grams, r of them from a common one on, is similar by way of
    it to sets of at most u = r (num + den) / num - n n-grams. Two sets are so
    only if each has at most the u of the other. Where u is at least n, this is
    that the intervals from n to u overlap; their unions are the chains, with
    edges to the least set of each. Where u is less (lo is n, hi is u), it is
    that the interval of the other set holds both numbers; such a row has an
    edge to the chain that holds both, and is in rest if there is none.
    """
    wide = hi >= lo
    order = np.flatnonzero(wide)[np.lexsort((lo[wide], h[wide]))]
    g, a, b, w = h[order], lo[order], hi[order], who[order]
    at = _chains(g, a, b, 1, 1)
    if not len(at):
        return np.zeros((0, 4), np.int64), np.zeros((0, 2), np.int64), np.stack([h, lo, hi, who], 1)
    least = np.minimum.reduceat(w, at)
    chains = np.stack([g[at], a[at], np.maximum.reduceat(b, at), least], 1)
    edges = np.stack([np.repeat(least, np.diff(np.r_[at, len(g)])), w], 1)
    rest = np.flatnonzero(~wide)
    names, first = np.unique(chains[:, 0], return_index=True)
    name = np.minimum(np.searchsorted(names, h[rest]), len(names) - 1)
    known = names[name] == h[rest]
    code = (np.repeat(np.arange(len(names)), np.diff(np.r_[first, len(chains)])) << 33) + chains[:, 1]
    place = np.maximum(np.searchsorted(code, (name << 33) + np.maximum(hi[rest], 0), "right") - 1, 0)
    held = known & (chains[place, 0] == h[rest]) & (chains[place, 1] <= hi[rest]) & (lo[rest] <= chains[place, 2])
    edges = np.concatenate([edges, np.stack([chains[place[held], 3], who[rest[held]]], 1)])
    rest = rest[~held]
    return chains, edges[edges[:, 0] != edges[:, 1]], np.stack([h[rest], lo[rest], hi[rest], who[rest]], 1)


def _fewer(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, edges): of n-grams with many rows that no chain holds, one row stays of each pair of numbers, with edges to it. They link more sets than is needed, but none less."""
    order = np.lexsort((rest[:, 3], rest[:, 2], rest[:, 1], rest[:, 0]))
    rest = rest[order]
    many = np.repeat((size := np.diff(_runs(rest[:, 0]))) > REST, size)
    some = rest[many]
    new = np.r_[True, (some[1:, :3] != some[:-1, :3]).any(1)][: len(some)]
    least = some[new, 3][np.cumsum(new) - 1]
    return np.concatenate([rest[~many], some[new]]), np.stack([least[~new], some[~new, 3]], 1)


def _postings(parts: int, num: int, den: int):
    """The prefix n-grams of sets, packed by bucket of n-gram as (n-gram, least and most size, least set) of each chain of sizes and each set in no chain, and edges within chains."""

    def run(it):
        for batch in it:
            lead = batch.column("lead").to_numpy()
            sizes = tb.lengths_of(batch.column("tokens"), 8)
            first = np.cumsum(sizes) - sizes
            at = np.arange(int(lead.sum())) - np.repeat(np.cumsum(lead) - lead, lead)
            h = tb.unpacked(batch.column("tokens"), U64)[at + np.repeat(first, lead)].view(np.int64)
            who, n = (np.repeat(batch.column(c).to_numpy(), lead) for c in ("node", "n"))
            most = np.minimum((np.repeat(sizes, lead) - at) * (num + den) // num - n, 2**33 - 1)
            chains, edges, rest = _chained(h, n, most, who)
            rest, more = _fewer(rest)
            chains, edges = np.concatenate([chains, rest]), np.unique(np.concatenate([edges, more]), axis=0)
            columns = [pa.array(np.arange(parts), pa.int32())]
            for rows, part in ((chains, tb.mix(np.ascontiguousarray(chains[:, 0]).view(U64)) % U64(parts)), (edges, np.ascontiguousarray(edges[:, 1]).view(U64) % U64(parts))):
                order = np.argsort(part, kind="stable")
                columns.append(tb.binary(np.ascontiguousarray(rows[order]).reshape(-1), _bounds(part[order].astype(np.int64), parts) * rows.shape[1]))
            out = pa.RecordBatch.from_arrays(columns, ["part", "chains", "edges"])
            yield out.filter(pa.array(np.sum([np.diff(tb.text_bytes(c)[1]) for c in columns[1:]], axis=0) > 0))

    return run


def _links():
    """Edges that join the sets which share a prefix n-gram, by chains of compatible sizes."""

    def run(table: pa.Table) -> pa.Table:
        _, edges, _ = _chained(*tb.unpacked(table.column("chains"), np.int64).reshape(-1, 4).T)
        edges = np.unique(np.concatenate([edges, tb.unpacked(table.column("edges"), np.int64).reshape(-1, 2)]), axis=0)
        return pa.Table.from_arrays([pa.array(edges[:, 0], pa.int64()), pa.array(edges[:, 1], pa.int64())], ["a", "b"])

    return run


class PrefixTree:
    """Sets of ascending ranks in a compact prefix tree; sizes are those of the whole sets, n-grams of one set alone included."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.sizes = sizes
        offset, depth, parent, owner, stack = [], [0], [-1], [0], [0]
        ends = np.zeros(len(sets), np.int64)
        self.flat = np.concatenate([sets[i] for i in order]) if sets else np.zeros(0, np.uint32)
        at, before = 0, None
        for k, i in enumerate(order):
            own, shared, last = sets[i], 0, None
            if before is not None:
                m = min(len(own), len(before))
                differ = own[:m] != before[:m]
                shared = int(differ.argmax()) if differ.any() else m
            while depth[stack[-1]] > shared:
                last = stack.pop()
            if depth[stack[-1]] < shared:
                depth.append(shared)
                parent.append(stack[-1])
                owner.append(owner[last])
                parent[last] = len(depth) - 1
                stack.append(len(depth) - 1)
            if len(own) > shared:
                depth.append(len(own))
                parent.append(stack[-1])
                owner.append(k)
                stack.append(len(depth) - 1)
            ends[i] = stack[-1]
            offset.append(at)
            at += len(own)
            before = own
        self.depth, self.parent = np.array(depth), np.array(parent)
        nodes = len(depth)
        base = np.array(offset or [0])[np.array(owner)]
        self.lo = base + np.where(self.parent >= 0, self.depth[self.parent], 0)
        self.hi = base + self.depth
        self.ended = np.argsort(ends, kind="stable")
        self.ended_at = np.searchsorted(ends[self.ended], np.arange(nodes + 1))
        self.children = np.argsort(self.parent, kind="stable")
        self.children_at = np.searchsorted(self.parent[self.children], np.arange(nodes + 1))
        self.least, self.most, self.deepest = np.full(nodes, 2**62), np.zeros(nodes, np.int64), self.depth.copy()
        np.minimum.at(self.least, ends, sizes)
        np.maximum.at(self.most, ends, sizes)
        for i in np.argsort(-self.depth, kind="stable"):
            p = self.parent[i]
            if p >= 0:
                self.least[p], self.most[p], self.deepest[p] = min(self.least[p], self.least[i]), max(self.most[p], self.most[i]), max(self.deepest[p], self.deepest[i])
        self.left = self.deepest - self.depth

    def similar(self, query: np.ndarray, size: int, mark: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """(sets, overlaps) of all sets with overlap / union >= num / den. mark: zeros, one for each rank; it is left so."""
        mark[query] = 1
        found, overlaps = [], []
        now, had = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while True:
            counts = self.children_at[now + 1] - self.children_at[now]
            if not counts.sum():
                break
            nodes = self.children[_spread(self.children_at[now], counts)]
            had = np.repeat(had, counts)
            lengths = self.hi[nodes] - self.lo[nodes]
            hits = np.add.reduceat(mark[self.flat[_spread(self.lo[nodes], lengths)]], np.cumsum(lengths) - lengths, dtype=np.int64)
            had = had + hits
            rest = len(query) - np.searchsorted(query, self.flat[self.hi[nodes] - 1], "right")
            reach = had + np.minimum(rest, self.left[nodes])
            keep = (reach * (num + den) >= num * (size + self.least[nodes])) & (self.most[nodes] * den >= num * size) & (self.least[nodes] * num <= den * size)
            now, had = nodes[keep], had[keep]
            counts = self.ended_at[now + 1] - self.ended_at[now]
            sets, overlap = self.ended[_spread(self.ended_at[now], counts)], np.repeat(had, counts)
            fits = overlap * (num + den) >= num * (size + self.sizes[sets])
            found.append(sets[fits])
            overlaps.append(overlap[fits])
        mark[query] = 0
        return (np.concatenate(found), np.concatenate(overlaps)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _spread(start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... counts[i] of them, for all i."""
    return np.arange(int(counts.sum())) + np.repeat(start - (np.cumsum(counts) - counts), counts)


def _joined(num: int, den: int):
    """Of each set that is similar to another within the components of a bundle, or between two blocks of a large one: a set of its class and the number of documents that it is similar to."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("component", "ascending"), ("block", "ascending"), ("node", "ascending")])
        component, block, n, members, node = (table.column(c).to_numpy() for c in ("component", "block", "n", "members", "node"))
        bounds = np.r_[0, np.cumsum(tb.lengths_of(table.column("tokens"), 8))]
        tokens, df = tb.unpacked(table.column("tokens"), U64), tb.unpacked(table.column("df"), np.uint8)
        cross = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        links, up = np.zeros(len(node), np.int64), np.arange(len(node))

        def root(x: np.ndarray) -> np.ndarray:
            while True:
                y = up[x]
                if (y == x).all():
                    return x
                x = y

        for lo, hi in zip((at := _runs(component))[:-1], at[1:], strict=True):
            own, level = tokens[bounds[lo] : bounds[hi]], df[bounds[lo] : bounds[hi]]
            names, inverse = np.unique(own, return_inverse=True)
            levels = np.zeros(len(names), np.int64)
            levels[inverse] = level
            order = np.lexsort((names, -levels))
            rank = np.empty(len(names), np.uint32)
            rank[order] = np.arange(len(names), dtype=np.uint32)
            ranks = rank[inverse]
            sets = [np.sort(ranks[bounds[k] - bounds[lo] : bounds[k + 1] - bounds[lo]]) for k in range(lo, hi)]
            split = int(np.searchsorted(block[lo:hi], block[lo], "right")) if cross else hi - lo
            if cross and split == hi - lo:
                continue
            tree = PrefixTree(sets[:split], n[lo : lo + split])
            mark = np.zeros(len(names), np.uint8)
            for k in range(split if cross else 0, hi - lo):
                found, _ = tree.similar(sets[k], int(n[lo + k]), mark, num, den)
                found = found[found != k] + lo
                if len(found):
                    links[lo + k] += members[found].sum()
                    if cross:
                        links[found] += members[lo + k]
                    tops = root(np.r_[lo + k, found])
                    up[tops] = tops.min()
        some = np.flatnonzero(links)
        return pa.Table.from_arrays([pa.array(node[some]), pa.array(node[root(some)]), pa.array(links[some])], ["node", "root", "links"])

    return run


def _hot(rows: DataFrame, n: int, count: int, share: float) -> np.ndarray:
    """n-grams that at least this share of about HOT_DOCUMENTS documents hold: at most 1 / share times the n-grams of a document."""
    some = min(1.0, HOT_DOCUMENTS / max(1, count))
    if some < 1:
        rows = rows.where(F.col("row") < int(-(2**63) + some * 2**64))

    def grams(it):
        for batch in it:
            for part in tb.chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(_grams_of(part, n)[0].view(np.int64))], ["h"])

    often = rows.select("text").mapInArrow(tb.trimmed(grams), "h long").groupBy("h").count().where(F.col("count") >= max(2, share * min(count, HOT_DOCUMENTS)))
    return np.sort(np.array([r.h for r in often.select("h").collect()], np.int64).view(U64))


def _sent(df: DataFrame) -> DataFrame:
    """df, sent to all tasks if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def similar_rows(docs: DataFrame, n: int = N, threshold: Fraction | float = THRESHOLD, block: int = BLOCK, bucket_bytes: int = BUCKET_BYTES, hot_share: float = HOT_SHARE) -> DataFrame:
    """(doc_id, row, class, class_id, links) of every row of docs that is similar to another; row is shared.row_key of doc_id and text, class the name of its class."""
    spark = docs.sparkSession
    t = Fraction(threshold).limit_denominator(1000)
    if not 0 < t <= 1:
        raise ValueError("threshold has to be above 0 and at most 1")
    num, den = t.numerator, t.denominator
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("row"), F.lower("text").alias("text")).where("text is not null")
    total, count = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    parts = min(2**24 - 2, max(1, math.ceil(total / bucket_bytes), min(spark.sparkContext.defaultParallelism, math.ceil(total / LEAST_BUCKET_BYTES))))
    by_part = lambda df, run, schema: df.repartitionById(parts, F.col("part")).mapInArrow(tb.trimmed(_whole(run)), schema)
    hot = spark.sparkContext.broadcast(_hot(rows, n, count, hot_share))
    shared = by_part(rows.mapInArrow(tb.trimmed(_pack(n, parts, hot)), _PACKED), _shared(parts), _SHARED)
    found = written(by_part(shared, _collected(num, den), _SETS), "ngram-sets")
    sets, members = found.where("n is not null").drop("row"), found.where("n is null").select("node", "doc_id", "row")
    linked = sets.where("lead > 0")
    postings = linked.select("node", "n", "tokens", "lead").mapInArrow(tb.trimmed(_postings(parts, num, den)), "part int, chains binary, edges binary")
    components = connected_components(by_part(postings, _links(), "a long, b long"))
    place = linked.select("node", "shared").join(components, "node")
    large = place.groupBy("component").agg(F.greatest(F.ceil(F.sum("shared") / F.lit(block)), F.ceil(F.count("*") / F.lit(BLOCK_SETS))).cast("int").alias("blocks")).where("blocks > 1")
    place = place.join(large, "component", "left").select("node", "component", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    place = place.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    place = place.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    bundles = max(1, math.ceil((linked.agg(F.sum("shared")).first()[0] or 0) / BUNDLE))
    place = written(
        place.select(
            F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(bundles))).otherwise(F.col("component")).alias("bundle"),
            F.when(F.col("blocks") == 1, -1).otherwise(F.least("block", "other")).alias("i"),
            F.when(F.col("blocks") == 1, -1).otherwise(F.greatest("block", "other")).alias("j"),
            "component", "block", "node",
        ),
        "ngram-places",
    )
    placed = linked.select("node", "n", "members", "tokens", "df").join(_sent(place), "node")
    links = written(placed.groupBy("bundle", "i", "j").applyInArrow(tb.trimmed_group(_joined(num, den)), "node long, root long, links long"), "ngram-links")
    classes = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    each = sets.select("node", "doc_id", "members").join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").where("links is not null or members > 1")
    each = each.join(classes, "node", "left").select("node", F.coalesce("component", "node").alias("class"), "doc_id", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("links"))
    named = each.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    each = written(each.join(named, "class").select("node", "class", "class_id", "links"), "ngram-classes")
    return members.join(_sent(each), "node").select("doc_id", "row", "class", "class_id", "links")


def similar_documents(docs: DataFrame, n: int = N, threshold: Fraction | float = THRESHOLD, **more) -> DataFrame:
    """(doc_id, class_id, links): a row for each document that is similar to another one.

    docs needs doc_id and text; other columns are ignored. A document's set
    holds the n-grams of its whole text's lowercase words; one of fewer than n
    words has its whole text as its only n-gram. Two documents are similar if
    the Jaccard similarity of their sets is at least threshold; links counts
    the documents that one is similar to. Classes are the connected components
    of all links, and class_id is the least doc_id of a class. A document in no
    row is a class of its own and has no link. Each row of docs is a document:
    rows that repeat are copies of each other. A row with a null doc_id is a
    document too; class_id is null only where no doc_id of the class is known.
    Texts that are null or without words are in no row. Very long texts are
    taken whole. An empty table gives no rows.
    """
    return similar_rows(docs, n, threshold, **more).select("doc_id", "class_id", "links")


def one_of_each(docs: DataFrame, n: int = N, threshold: Fraction | float = THRESHOLD, **more) -> DataFrame:
    """docs with one document of each class of similar ones: that of the least doc_id (null after all others), then of the least hash of doc_id and text.

    Documents in no class stay, and with them null texts and those without
    words. Of rows that repeat one stays. All columns are kept; of repeated
    rows that differ in other columns, any one. An empty table stays empty.
    """
    row, here = fresh(docs.columns, "row"), fresh(docs.columns, "here")
    found = similar_rows(docs, n, threshold, **more)
    best = found.groupBy("class").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "row")).alias("best"))
    found = found.join(best, "class").groupBy("row", "doc_id").agg(F.first((F.col("best.row") == F.col("row")) & F.col("best.doc_id").eqNullSafe(F.col("doc_id"))).alias("stays"), F.count("*").alias("times"))
    found = written(found.where("not stays or times > 1"), "ngram-copies")
    repeated = found.where("stays").limit(1).count()
    keys = _sent(found.select(F.col("row").alias(row), F.struct("doc_id", "stays").alias(here)))
    joined = docs.withColumn(row, row_key("doc_id", "text"))
    joined = joined.join(keys.withColumnRenamed(row, f"{row}_of"), (F.col(row) == F.col(f"{row}_of")) & F.col("doc_id").cast("long").eqNullSafe(F.col(f"{here}.doc_id")), "left")
    kept = joined.where(F.col(here).isNull())
    if repeated:
        kept = kept.unionByName(joined.where(F.col(f"{here}.stays")).dropDuplicates([row, "doc_id"]))
    return kept.select(*docs.columns)


def op10_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+3], ' ') END AS gram
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
s AS (SELECT doc_id, list(gram ORDER BY gram) AS grams, count(*) AS n FROM g GROUP BY doc_id),
r AS (SELECT min(doc_id) AS rep, list(doc_id) AS members, n FROM s GROUP BY grams, n),
rg AS (SELECT r.rep, r.n, len(r.members) AS m, g.gram FROM r JOIN g ON g.doc_id = r.rep),
o AS (SELECT a.rep AS x, b.rep AS y, a.n AS nx, b.n AS ny, b.m AS my, count(*) AS o FROM rg a JOIN rg b ON a.gram = b.gram AND a.rep <> b.rep GROUP BY ALL),
e AS (SELECT x, y, my FROM o WHERE 5 * o >= 2 * (nx + ny - o)),
c(x, y) AS (SELECT rep, rep FROM r UNION SELECT c.x, e.y FROM c JOIN e ON e.x = c.y),
k AS (SELECT x, min(y) AS class_id FROM c GROUP BY x),
l AS (SELECT x, sum(my) AS links FROM e GROUP BY x)
SELECT unnest(r.members) AS doc_id, k.class_id, CAST(coalesce(l.links, 0) + len(r.members) - 1 AS BIGINT) AS links
FROM r JOIN k ON k.x = r.rep LEFT JOIN l ON l.x = r.rep WHERE coalesce(l.links, 0) + len(r.members) > 1
"""
