"""Tables that several tasks or jobs share, and loading of inputs.

Lineage is cut by writing a Parquet table into the folder that the cluster
names in ``spark.checkpoint.dir``: every executor reads the same copy, so the
loss of one costs nothing.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in the session; in local mode without one, a temporary folder is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    named = spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tessera-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once and return a DataFrame that reads what was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def dropped(df_or_path: str, spark: SparkSession) -> None:
    """Delete a written table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df_or_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            dropped(path, spark)
        except Exception:  # noqa: BLE001 - the session may have ended already; the files are then left to the cluster
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_of(spark: SparkSession) -> int:
    """Buckets of a packed exchange: as many as the session's shuffle partitions, which follow the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def least_hashed(rows: DataFrame, group: str, n: int) -> DataFrame:
    """(doc_id, group): of every value of group, the n doc_ids of the least hash; group isn't null.

    One count by group tells below which hash about 4 n + 64 rows lie, so that
    no partition sends more than its few of these, at any size of the input.
    Where fewer than n are there, for doc_ids that repeat, all rows of that
    group are looked at. The rows are sent by Arrow: a list of tuples would start
    Python workers of their own on each executor, which stay beside the others.
    """
    spark = rows.sparkSession
    rows = rows.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), group)
    counts = {r[0]: r[1] for r in rows.groupBy(group).count().collect()}
    if not counts:
        return rows.limit(0)
    h, test = F.xxhash64("doc_id"), F.lit(False)
    for value, count in counts.items():
        share = (4 * n + 64) / count
        test = F.when(F.col(group) == value, F.lit(True) if share >= 1 else h < int(-(2**63) + share * 2**64)).otherwise(test)
    found: dict = {value: [] for value in counts}
    for r in rows.where(test).withColumn("_h", h).distinct().collect():
        found[r[group]].append((r["_h"], r.doc_id))
    for value, count in counts.items():
        if len(found[value]) < min(n, count):
            found[value] = [(r["_h"], r.doc_id) for r in rows.where(F.col(group) == value).withColumn("_h", h).distinct().orderBy("_h").limit(n).collect()]
    chosen = [(i, value) for value, got in found.items() for _, i in sorted(got)[:n]]
    return spark.createDataFrame(pa.table({"doc_id": [i for i, _ in chosen], group: [value for _, value in chosen]}), rows.schema)


def fresh(columns: list[str], name: str) -> str:
    """A column name like `name` that isn't among columns, upper and lower case being one."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_key(*cols: str):
    """A key of a row's content: rows that agree in all cols are one row to an operator that uses it."""
    return F.xxhash64(*[F.col(c) for c in cols])
