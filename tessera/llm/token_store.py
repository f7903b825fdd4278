"""Token ids as compressed binary: one zstandard frame a document, all with one trained dictionary.

Ids of a vocabulary of at most 65,536 are written as two bytes each, little
end first, else as four. A frame stands alone, so a short document is read by
its offset and length without its neighbours; the dictionary gives it the
context that it lacks by itself.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textbytes as tb
from tessera.llm.shared import least_hashed

TOKENIZERS = os.environ.get("TESSERA_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents that the dictionary is trained on, at most; its size in bytes; zstandard's level.
SAMPLE, DICTIONARY_BYTES, LEVEL = 2000, 65_536, 3

_SPACE = "\t-\r \x85\xa0  -     　"
#: The tokenizer's pattern never joins what this one parts, so parts are encoded alone and remembered.
_PARTS = re.compile(f"[{_SPACE}]+(?![^{_SPACE}])| ?[^{_SPACE}]+|[{_SPACE}]+")
_REMEMBERED = 400_000
_encoders: dict[str, Encoder] = {}


class Encoder(dict):
    """Serialized ids by part of text."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("tessera", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.dtype = np.dtype("<u2" if max(ranks.values()) < 65_536 else "<u4")

    def __missing__(self, part: str) -> bytes:
        ids = np.array(self.encoding.encode_ordinary(part), self.dtype).tobytes()
        if len(part) <= 64:
            if len(self) >= _REMEMBERED:
                self.clear()
            self[part] = ids
        return ids

    def serialized(self, text: str) -> bytes:
        return b"".join([self[p] for p in _PARTS.findall(text)])


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; where samples are too few for the trainer, their own bytes; b'' without any."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if raw else None


def decoded(frame: bytes, dictionary: bytes, dtype: str = "<u2") -> np.ndarray:
    """The ids of one document's frame."""
    d = _dictionary(dictionary)
    return np.frombuffer((zstandard.ZstdDecompressor(dict_data=d) if d else zstandard.ZstdDecompressor()).decompress(frame), dtype)


def read_document(shard: bytes, offset: int, n_bytes: int, dictionary: bytes, dtype: str = "<u2") -> np.ndarray:
    """The ids of one document out of a shard, the frames of which lie one after the other."""
    return decoded(shard[offset : offset + n_bytes], dictionary, dtype)


def _trained(path: str, size: int):
    def run(it):
        texts = [t for batch in it for t in batch.column("text").to_pylist()]
        code = encoder(path)
        yield pa.RecordBatch.from_arrays([pa.array([train_dictionary([code.serialized(t) for t in texts], size)], pa.binary())], ["payload"])

    return run


def _frames(path: str, dictionary, level: int):
    def run(it):
        code, raw = encoder(path), dictionary.value
        d, name = _dictionary(raw), hashlib.sha256(raw).hexdigest()
        compress = zstandard.ZstdCompressor(level=level, dict_data=d) if d else zstandard.ZstdCompressor(level=level)
        shard, at = TaskContext.get().partitionId(), 0
        for batch in it:
            for part in tb.chunks(batch, "text"):
                n, frames = [], []
                for text in part.column("text").to_pylist():
                    ids = None if text is None else code.serialized(text)
                    n.append(None if ids is None else len(ids) // code.dtype.itemsize)
                    frames.append(None if ids is None else compress.compress(ids))
                sizes = np.array([len(f or b"") for f in frames], np.int64)
                offsets = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["document"] * len(n)), pa.array([shard] * len(n), pa.int64()), part.column("doc_id"), pa.array(offsets), pa.array(sizes), pa.array(n, pa.int64()), pa.array([name] * len(n)), pa.array(frames, pa.binary())],
                    ["kind", "shard", "doc_id", "offset", "n_bytes", "n_tokens", "dictionary", "payload"],
                )

    return run


def token_store(docs: DataFrame, vocabulary: str = VOCABULARY, tokenizers: str = TOKENIZERS, sample: int = SAMPLE, dictionary_bytes: int = DICTIONARY_BYTES, level: int = LEVEL) -> DataFrame:
    """(kind, shard, doc_id, offset, n_bytes, n_tokens, dictionary, payload).

    One row of kind 'dictionary' holds the dictionary in payload and its SHA-256
    in dictionary. A row of kind 'document' holds a document's frame, and its
    place if the frames of a shard are laid one after the other in the order of
    offset; its dictionary names what it needs to be read. The dictionary is
    trained on the whole texts of at most `sample` documents, those of the least
    hash of doc_id: zstandard's trainer takes about a hundred times the size of
    the dictionary and holds it in memory. An empty text is a frame of no ids; a
    null text has no frame: n_bytes 0 and nulls. Repeated rows are each stored,
    a null doc_id stays null, other columns are ignored. An empty table gives
    the row of an empty dictionary alone. Shards are the partitions of the
    scan; nothing is shuffled.
    """
    spark = docs.sparkSession
    path = os.path.join(tokenizers, vocabulary)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = least_hashed(rows.where("text <> ''").select("doc_id", F.lit(0).alias("all")), "all", sample).select("doc_id")
    some = rows.where("text <> ''").join(F.broadcast(ids), "doc_id").select("doc_id", "text").repartition(1).sortWithinPartitions("doc_id", "text").select("text")
    made = some.mapInArrow(_trained(path, dictionary_bytes), "payload binary").first()
    raw = bytes(made.payload) if made else b""
    shared = spark.sparkContext.broadcast(raw)
    schema = "kind string, shard long, doc_id long, offset long, n_bytes long, n_tokens long, dictionary string, payload binary"
    own = spark.createDataFrame([("dictionary", None, None, None, len(raw), None, hashlib.sha256(raw).hexdigest(), bytearray(raw))], schema)
    return own.union(rows.mapInArrow(_frames(path, shared, level), schema))


def write_shards(store: DataFrame, path: str) -> None:
    """The rows of a store as Parquet, by shard and offset within each file; the frames keep their offsets."""
    store.repartition("shard").sortWithinPartitions("shard", "offset").write.parquet(path)


def op3_token_store(spark, sf_dir: str) -> DataFrame:
    return token_store(spark.read.parquet(f"{sf_dir}/documents.parquet"))
