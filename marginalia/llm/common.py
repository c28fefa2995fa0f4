"""Scratch tables, hashing fractions and Arrow helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []

#: ASCII white space; every contract of this subpackage splits words on it.
WHITE = " \t\n\x0b\x0c\r"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Arrow batches of about so many rows and bytes at most, where the session has left Spark's own defaults: rows here hold
    whole texts, and a batch stands several times in the memory of the JVM and of its Python worker. One longer text is a batch."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(rows))
    if spark.conf.get(BYTES) == "67108864b":
        spark.conf.set(BYTES, str(size))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; a folder of our own only in local mode (tests)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="marginalia-"))
    return _own[0]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared scratch folder and read it back: cuts the lineage, survives lost executors."""
    small_batches(df.sparkSession)
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the scratch files that df reads; only for tables that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def unit_hash(*cols: Column | str, seed: int = 0) -> Column:
    """A double in (0, 1) from a hash of cols; equal on every run and for every partitioning."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def remainder(doc_id: str, mod: int) -> Column:
    """crc32 of the decimal text of doc_id, modulo mod; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(mod)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each string; nulls become empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores, so that it clashes with no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most rows rows, which bounds what one step holds."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
