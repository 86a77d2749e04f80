"""Sessions and field state as Structured Streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.session import shared_dir


def session_stream(events: DataFrame, user: str, ts: str, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """A session ends a gap after its last event. In append mode a session comes out once the watermark has passed
    its end, its state goes, and events later than the watermark are dropped; in complete mode all sessions stay."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.session_window(ts, gap)
    found = marked.groupBy(user, w.alias("w")).agg(F.count("*").alias("events"), F.max(ts).alias("ended"))
    return found.select(user, F.col("w.start").alias("started"), "ended", "events")


def state_stream(updates: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """A key's value of the highest rank, then the latest; the state is one row a key."""
    rest = [c for c in updates.columns if c not in keys]
    best = updates.withColumn("_rank", rank).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_rank", "ts", "event_id")).alias("_b"), F.count("*").alias("updates"))
    return best.select(*keys, "_b.*", "updates")


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a streaming query over all that is there now, into a table in the shared folder, and read that.

    Each batch replaces the table it wrote last, so that a batch that is run again after a failure leaves one result.
    """
    done = _run(stream, mode)
    return stream.sparkSession.read.schema(stream.schema).parquet(done[-1]) if done else stream.sparkSession.createDataFrame([], stream.schema)


def upsert_to_table(stream: DataFrame, keys: list[str], base: str | None = None) -> DataFrame:
    """Run a streaming query in update mode: a batch writes the keys it changed, and a key's row is that of the last batch
    that has it. A batch that is run again overwrites its own folder. With a base folder a later call goes on where the
    last one stopped, state and all."""
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/tessera-stream-{uuid.uuid4().hex}"
    _run(stream, "update", base)
    every = spark.read.schema(stream.schema).option("recursiveFileLookup", "false").parquet(f"{base}/batches/*")
    number = F.regexp_extract(F.input_file_name(), r"batch-(\d+)/", 1).cast("long")
    rest = [c for c in stream.columns if c not in keys]
    last = every.withColumn("_batch", number).groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_b"))
    return last.select(*[c if c in keys else f"_b.{c}" for c in stream.columns])


def _run(stream: DataFrame, mode: str, base: str | None = None) -> list[str]:
    spark: SparkSession = stream.sparkSession
    base = base or f"{shared_dir(spark)}/tessera-stream-{uuid.uuid4().hex}"
    done: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        path = f"{base}/batches/batch-{number}"
        batch.write.mode("overwrite").parquet(path)
        done.append(path)

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(write).start()
    query.awaitTermination()
    return done
