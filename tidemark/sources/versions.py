"""Tables with versions: a write makes a new folder, and a pointer is moved to it when it is whole.

A reader follows the pointer, so it never sees a part of a write, and a write that fails leaves the version before. The pointer is a small
file that is replaced by a rename, which file systems do at once. Versions beyond the last KEEP are deleted.
"""

from __future__ import annotations

import io
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEEP = 2
POINTER = "CURRENT"


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), lambda name: spark._jvm.org.apache.hadoop.fs.Path(path, name)


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Names of the versions, oldest first, finished or not."""
    fs, at = _files(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at(".")) if s.isDirectory() and s.getPath().getName().startswith("v")) if fs.exists(at(".")) else []


def current(spark: SparkSession, folder: str) -> str | None:
    """The path of the version that the pointer names, if any."""
    fs, at = _files(spark, folder)
    if not fs.exists(at(POINTER)):
        return None
    return f"{folder}/{spark.read.text(f'{folder}/{POINTER}').first()[0]}"


def _point(spark: SparkSession, folder: str, version: str) -> None:
    fs, at = _files(spark, folder)
    draft = at(f"{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(version.encode()))
    out.close()
    jvm = spark._jvm
    over = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = over
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, at(POINTER), options)


def publish(df: DataFrame, folder: str) -> str:
    """Write df as the next version and move the pointer to it. Gives the version's name."""
    spark = df.sparkSession
    known = versions(spark, folder)
    version = f"v{int(known[-1][1:9]) + 1 if known else 0:08d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{folder}/{version}")
    _point(spark, folder, version)
    fs, at = _files(spark, folder)
    for old in versions(spark, folder)[:-KEEP]:
        fs.delete(at(old), True)
    return version


def read(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table as last published, if it was."""
    path = current(spark, folder)
    return None if path is None else spark.read.parquet(path)


def merge(fresh: DataFrame, folder: str, keys: list[str]) -> str:
    """Overlay rows on the table, the fresh ones first; a merge that is done again gives the same table."""
    from tidemark.operators.bars import upsert

    old = read(fresh.sparkSession, folder)
    return publish(upsert(fresh.limit(0) if old is None else old, fresh, keys), folder)


def set_aside(spark: SparkSession, folder: str) -> list[str]:
    """Move files of the current version that can't be read into a folder of their own, so that the rest can. Footers are checked by tasks."""
    path = current(spark, folder)
    if path is None:
        return []

    def bad(batches):
        for batch in batches:
            wrong = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    pq.ParquetFile(io.BytesIO(content.as_py())).metadata  # noqa: B018
                except (pa.ArrowInvalid, OSError):
                    wrong.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(wrong, pa.string())], names=["path"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path", "content").mapInArrow(bad, "path string")
    fs, at = _files(spark, folder)
    moved = []
    for r in found.collect():  # files that are damaged, a few
        fs.mkdirs(at("aside"))
        source = spark._jvm.org.apache.hadoop.fs.Path(r["path"])
        fs.rename(source, at(f"aside/{source.getName()}"))
        moved.append(source.getName())
    return moved


def ages(spark: SparkSession, folder: str, key: str = "ticker", now: str | None = None) -> DataFrame:
    """By key: when its newest file was written, its age in seconds, and the first and last date that it covers."""
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    rows = read(spark, folder).select(key, "date", F.col("_metadata.file_modification_time").alias("written"))
    by = rows.groupBy(key).agg(F.max("written").alias("written"), F.min("date").alias("first"), F.max("date").alias("last"))
    return by.withColumn("age_seconds", F.unix_timestamp(at) - F.unix_timestamp("written"))


def fresh(spark: SparkSession, folder: str, seconds: int, session: str, key: str = "ticker", now: str | None = None) -> DataFrame:
    """ages with `fresh`: written within so many seconds and covering the last closed session."""
    return ages(spark, folder, key, now).withColumn("fresh", (F.col("age_seconds") <= seconds) & (F.col("last") >= F.lit(session).cast("date")))
