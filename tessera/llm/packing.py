"""First-fit decreasing with a tournament tree, in random groups of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textbytes as tb
from tessera.llm.shared import row_key

CAPACITY, GROUP, SEED = 2048, 4096, 7


class Tournament:
    """Room left in bins. Each inner node holds the most room below it, so the first bin that fits is one walk down."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Put an item into the first bin with room for it and return that bin; there has to be one."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        found = at - self.leaves
        room[at] -= size
        at >>= 1
        while at:
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
            at >>= 1
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, by first-fit in the order given; sizes are at most capacity."""
    tree = Tournament(max(1, len(sizes)), capacity)
    return [tree.first_fit(s) for s in sizes]


def _sizes(it):
    for batch in it:
        for part in tb.chunks(batch, "text"):
            data, offsets = tb.text_bytes(part.column("text"))
            _, _, text = tb.words(data, offsets)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(np.bincount(text, minlength=part.num_rows).astype(np.int64))], ["doc_id", "row", "size"])


def _packed(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.repeat(np.arange(table.num_rows), table.column("times").to_numpy()))).sort_by([("doc_id", "ascending"), ("size", "ascending")])
        ids, sizes = table.column("doc_id").to_pylist(), table.column("size").to_numpy()
        pieces = -(-sizes // capacity)
        who = np.repeat(np.arange(len(sizes)), pieces)
        piece = np.arange(len(who)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * capacity
        size = np.minimum(sizes[who] - start, capacity)
        order = np.lexsort((piece, who, -size))
        bins = np.array(first_fit_decreasing(size[order].tolist(), capacity), np.int64)
        by_bin = np.argsort(bins, kind="stable")
        order, bins = order[by_bin], bins[by_bin]
        at = np.r_[np.searchsorted(bins, np.arange(bins.max() + 1)), len(bins)].astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(at), v) for v in (pa.array([ids[i] for i in who[order]], pa.int64()), pa.array(start[order], pa.int64()), pa.array(size[order], pa.int64()))]
        used = np.add.reduceat(size[order], at[:-1])
        n = len(used)
        return pa.Table.from_arrays([pa.array([table.column("pack")[0].as_py()] * n, pa.int64()), pa.array(np.arange(n), pa.int64()), *lists, pa.array(used, pa.int64()), pa.array([capacity] * n, pa.int64())], ["pack", "bin", "doc_ids", "starts", "sizes", "used", "capacity"])

    return run


def packed(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, seed: int = SEED) -> DataFrame:
    """Bins of at most capacity words: (pack, bin, doc_ids, starts, sizes, used, capacity).

    Documents fall into random groups of about that many by a hash of doc_id
    and text; each group is packed alone by first-fit decreasing, so that only
    hashes and sizes are shuffled and groups run side by side at any size of
    the corpus. Rows that repeat are counted first and dealt out in lots of at
    most a sixteenth of a group, so that none grows with their number.
    Items go by falling size, then doc_id, then place. A text of more than
    capacity words is cut into pieces of capacity and a rest; starts has the
    word at which each piece begins. Texts that are null or without words take
    no room and are in no bin. A row with a null doc_id is packed with a null
    in doc_ids; repeated rows are packed as often as they occur. An empty table
    gives no bins. Other columns are ignored.
    """
    groups = max(1, -(-docs.count() // group))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("row"), "text")
    sizes = rows.mapInArrow(tb.trimmed(_sizes), "doc_id long, row long, size long").where("size > 0").groupBy("doc_id", "row", "size").agg(F.count("*").alias("n"))
    lot = max(1, group // 16)
    lots = sizes.withColumn("lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / lot))))
    lots = lots.withColumn("times", F.least(F.lit(lot), F.col("n") - F.col("lot") * lot))
    keyed = lots.select("doc_id", "size", "times", F.pmod(F.xxhash64("doc_id", "row", "lot", F.lit(seed)), F.lit(groups)).alias("pack"))
    return keyed.groupBy("pack").applyInArrow(tb.trimmed_group(_packed(capacity)), "pack long, bin long, doc_ids array<long>, starts array<long>, sizes array<long>, used long, capacity long")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
