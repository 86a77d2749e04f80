"""What the corpus operators share: table access, durable intermediates and hot-key lookups."""

from __future__ import annotations

import ctypes
import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.session import shared_dir, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back, so that the lineage ends in replicated files.

    A lost executor costs a re-read and not a re-computation, and later size checks see true file sizes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete intermediates written by materialize() that no later plan reads."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if folder.getName().startswith("tessera-"):
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def tidy() -> None:
    """Give back to the system the memory that a Python worker no longer uses: workers live on through later stages."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def salts(spark: SparkSession) -> int:
    """Into how many parts the rows of one key may be dealt: one per shuffle partition."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))


def salted_lookup(rows: DataFrame, key: str, lookup: DataFrame, spread: Column, how: str = "inner") -> DataFrame:
    """rows joined to lookup (one row a key) on key, where one key may hold a third of all rows.

    Rows are dealt by (key, salt), with spread a column that differs between rows of a key. The distinct
    (key, salt) pairs, combined map-side, fetch their lookup row once each and meet the rows on both columns:
    no task ever gets a whole hot key.
    """
    n = salts(rows.sparkSession)
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(n)).cast("int"))
    pairs = rows.select(key, "_salt").distinct().join(lookup, key)
    return rows.join(pairs, [key, "_salt"], how).drop("_salt")
