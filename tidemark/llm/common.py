"""Shared helpers: table access, durable intermediate tables and evenly sized partitions."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: A word is a maximal run of characters other than ASCII white space.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir or has set it.

    Where neither is there it is set beside the warehouse; on a cluster that must not be a machine's own folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        one_machine = context.master.startswith("local") and not context.master.startswith("local-cluster")
        if not one_machine and found.partition(":")[0] in ("file", found):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(found)
    return found.rstrip("/")


@lru_cache(maxsize=8)
def _application_dir(spark: SparkSession, shared: str, application: str) -> str:
    """The application's own folder in the shared one; it goes when the driver's JVM ends."""
    place = f"{shared}/tidemark/{application}"
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return place


#: On ``file:`` without Hadoop's native library each new file, checksum file and folder costs a ``chmod`` process,
#: started from the executor's JVM. The raw file system writes no checksum files, Parquet's own page checksums
#: are verified instead; nothing reads the marker of success. Other schemes keep their file system.
_WRITE = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
    "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
    "parquet.page.write-checksum.enabled": "true",
}
_READ = {"parquet.page.verify-checksum.enabled": "true"}


def durable(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back.

    The lineage ends at that table, so a lost executor costs only the tasks that were running.
    """
    spark = df.sparkSession
    path = f"{_application_dir(spark, shared_dir(spark), spark.sparkContext.applicationId)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**_WRITE, compression=codec).parquet(path)
    held = spark.read.schema(df.schema).options(**_READ).parquet(path)
    held._written = path
    return held


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``durable`` returned, once what reads it has been written."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` partitions a number that ``repartition(n, ...)`` deals to it."""
    tried = spark.range(64 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id"))
    found = {r["p"]: r["id"] for r in tried.collect()}
    return [found.get(p, 0) for p in range(n)]


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, also those whose names hold dots or backticks."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def unused_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until it clashes with no column of ``df`` in any letter case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
