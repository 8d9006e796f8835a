"""Structured Streaming twins of the incremental operators. Each works on any stream; ``replayed`` runs one over stored files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_path


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream over a Parquet file or folder."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(fs_path).isFile():
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def tumbling_counts(stream: DataFrame, at: str, width: str, key: Sequence[str], value: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums of fixed windows; rows later than ``late`` behind the newest are dropped in append mode."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    g = timed.groupBy(F.window(at, width).alias("w"), *key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("slot"), *key, "n", "total")


def first_seen(stream: DataFrame, key: Sequence[str]) -> DataFrame:
    """The first row of each key that arrives, over restarts as well.

    The state holds every key ever seen: without a bound on how late a key can come back, none can be forgotten.
    """
    return stream.dropDuplicates(list(key))


def replayed(spark: SparkSession, path: str, job: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Runs a job over the stored rows until all are read; returns what the sink then holds. A batch that is run again overwrites its part."""
    out, state = shared_path(spark, "stream-out"), shared_path(spark, "stream-state")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    q = job(file_stream(spark, path)).writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.read.parquet(out)
    return found if mode == "complete" else found.drop("batch")


def routed(spark: SparkSession, path: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """One stream to a table per kind, other rows to ``dead``; returns each table's rows counted.

    A batch that is run again overwrites its own part of every table, so each row counts once.
    """
    out, state = shared_path(spark, "routes"), shared_path(spark, "routes-state")

    def route(batch: DataFrame, number: int) -> None:
        b = batch.persist()
        for k in kinds:
            b.where(F.col(kind) == k).write.mode("overwrite").parquet(f"{out}/kind={k}/batch={number}")
        b.where(~F.coalesce(F.col(kind).isin(*kinds), F.lit(False))).write.mode("overwrite").parquet(f"{out}/kind=dead/batch={number}")
        b.unpersist()

    q = file_stream(spark, path).writeStream.foreachBatch(route).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.option("basePath", out).parquet(f"{out}/kind=*").groupBy("kind").agg(F.count("*").alias("n"))
