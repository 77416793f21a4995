"""Scheduled incremental ingestion: files that arrive are merged into the store in micro-batches."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapisan.functions import text, urls


def keys(df: DataFrame) -> DataFrame:
    """The two keys under which the store refuses an article."""
    return df.withColumn("_k", F.nullif(urls.store_key(F.coalesce("source_url", F.lit(""))), F.lit(""))).withColumn("_n", F.lower(text.utrim(F.coalesce("title", F.lit("")))))


def merge_batch(batch: DataFrame, batch_id: int, store: str) -> None:
    """Appends the batch's articles that are new to the store and to each other. A batch has its own folder, so one that is replayed after a failure replaces its own rows."""
    from tapisan.operators.greedy import store_unique

    spark = batch.sparkSession
    target = os.path.join(store, f"batch={batch_id}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    own = keys(batch)
    if fs.exists(hadoop):
        old = keys(spark.read.schema(T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType())])).parquet(store).filter(F.col("batch") != batch_id))
        own = own.join(old.select("_k").filter("_k is not null").distinct(), "_k", "left_anti").join(old.select("_n").distinct(), "_n", "left_anti")
    kept = store_unique(own.select(*batch.columns), "ordinal", "title", "source_url").filter("accepted").drop("accepted")
    kept.write.mode("overwrite").option("compression", "zstd").parquet(target)


def ingest(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str, files: int = 1) -> None:
    """All files of `source` not seen before, `files` a batch, merged into `store`; ends when they are done."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    stream.writeStream.foreachBatch(lambda b, i: merge_batch(b, i, store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def late_counts(events: DataFrame, at: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each kind in each window of event time; those later than the watermark are left out once a window is done."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), kind).agg(F.count("*").alias("n")).select("window.start", kind, "n")
