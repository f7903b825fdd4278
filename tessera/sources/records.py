"""The shape of what parsers yield, and how files are read in parallel.

A file is one row of Spark's binaryFile source; a parser turns it into records
in the task that reads it. Archives are opened there too, entry by entry.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = "source_path entry schema_type raw_hash date date_end subject sender_address sender_name direction body_text kind role thread_key url".split()
SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in _TEXT]
    + [T.StructField(n, T.DoubleType()) for n in ("value", "lat", "lon")]
    + [T.StructField("is_bulk", T.BooleanType()), T.StructField("position", T.LongType()), T.StructField("recipients", T.ArrayType(T.StringType())), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("extra", T.MapType(T.StringType(), T.StringType()))]
)
NAMES = SCHEMA.fieldNames()

Record = dict
Entry = tuple[str, bytes]
Parser = Callable[[str, bytes], Iterator[Record]]


def sha(*parts: object) -> str:
    """SHA-256 of the parts, None written out, joined by bars."""
    return hashlib.sha256("|".join(str(p) for p in parts).encode()).hexdigest()


def entries(name: str, raw: bytes) -> Iterator[Entry]:
    """A file, or the entries of a ZIP archive in order of name."""
    if raw[:4] == b"PK\x03\x04" and not name.lower().endswith((".docx", ".xlsx", ".pptx", ".epub")):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for info in sorted(z.namelist()):
                if not info.endswith("/"):
                    yield info, z.read(info)
    else:
        yield name, raw


def records_of(name: str, raw: bytes, parser: Parser) -> Iterator[Record]:
    """Records of a file; whatever fails gives one of schema_type 'Error' with what was raised, and the next entry goes on."""
    opened = entries(name, raw)
    while True:
        entry, at = name, 0
        try:
            entry, data = next(opened)
            for r in parser(entry, data):
                yield {"source_path": name, "entry": entry, "position": at, **{k: v for k, v in r.items() if v is not None}}
                at += 1
        except StopIteration:
            return
        except Exception as e:  # noqa: BLE001 - files come from anywhere; a broken one mustn't end the job
            yield {"source_path": name, "entry": entry, "position": at, "schema_type": "Error", "body_text": repr(e)[:500], "raw_hash": sha(name, entry)}


def frame(rows: list[Record]) -> pd.DataFrame:
    return pd.DataFrame(rows).reindex(columns=NAMES).astype(object).where(lambda f: f.notna(), None)


def read_files(spark: SparkSession, path: str, parser: Parser, glob: str | None = None, batch: int = 5000) -> DataFrame:
    """Records (SCHEMA) of all files below path. What can't be read or parsed gives one record of schema_type 'Error'."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, raw in zip(f["path"], f["content"], strict=True):
                rows = []
                for r in records_of(name, bytes(raw), parser):
                    rows.append(r)
                    if len(rows) == batch:
                        yield frame(rows)
                        rows = []
                if rows:
                    yield frame(rows)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_split(spark: SparkSession, path: str, parser: Parser, separator: str, glob: str | None = None, after: int = 0) -> DataFrame:
    """Records of files whose parts stand after a separator, such as mailboxes: a file of any size is read by many tasks, each part by itself.

    Spark's text source cuts the files, in byte ranges, at the separator; the
    parser is given it back before every part. after: bytes of the files that
    have been read before; byte ranges that end there aren't parsed again, and
    what they share with the next is left out by ingest(). Archives aren't
    opened here.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", separator)
    parts = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    place = "_metadata.file_path", "_metadata.file_block_start", "_metadata.file_block_length"
    parts = parts.select(F.col(place[0]).alias("path"), F.col(place[1]).alias("start"), (F.col(place[1]) + F.col(place[2])).alias("end"), F.col("value").cast("binary").alias("content")).where(F.col("end") > after)
    lead = separator.lstrip("\n").encode()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for name, start, raw in zip(f["path"], f["start"], f["content"], strict=True):
                part = bytes(raw)
                for r in records_of(name, part if part.startswith(lead) else lead + part, parser):
                    rows.append({**r, "position": int(start)})
            if rows:
                yield frame(rows)

    return parts.select("path", "start", "content").mapInPandas(run, SCHEMA)
