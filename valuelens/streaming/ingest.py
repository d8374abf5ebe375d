"""Streaming canonical ingest: source files -> canonical transactions (Parquet,
partitioned by invoice month).

Each micro-batch runs ``contract.canonicalize`` (trim, coercion, validity,
customer ids, cancellations, signed revenue, in-batch exact dedup) and appends
only rows not already present in the months the batch touches (anti-join
against those partitions only).  The anti-join makes a replayed batch
idempotent, so the file source + checkpoint give exactly-once output without
unbounded streaming state.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.contract import CANONICAL_COLUMNS, canonicalize
from ..sources.raw import RAW_SCHEMA


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def merge_batch(batch: DataFrame, target_path: str) -> None:
    spark = batch.sparkSession
    canon = canonicalize(batch).withColumn("invoice_month", F.date_format("invoice_date", "yyyy-MM"))
    canon = canon.persist()
    try:
        months = [r[0] for r in canon.select("invoice_month").distinct().collect()]   # <= months in batch
        if not months:
            return
        new = canon
        if _exists(spark, os.path.join(target_path, "_SUCCESS")) or _exists(spark, target_path):
            try:
                existing = spark.read.parquet(target_path).filter(F.col("invoice_month").isin(months))
                new = canon.join(existing.select(*CANONICAL_COLUMNS, "invoice_month"),
                                 [*CANONICAL_COLUMNS, "invoice_month"], "left_anti")
            except Exception as exc:  # empty folder without parquet files yet
                if "UNABLE_TO_INFER_SCHEMA" not in str(exc) and "PATH_NOT_FOUND" not in str(exc):
                    raise
        new.write.mode("append").partitionBy("invoice_month").parquet(target_path)
    finally:
        canon.unpersist()


def start_canonical_ingest(spark: SparkSession, source_dir: str, source_name: str, target_path: str,
                           checkpoint_location: str, fmt: str = "csv", available_now: bool = True,
                           processing_time: str | None = None) -> StreamingQuery:
    """Start the ingest stream; ``available_now`` drains the files present and stops.

    A CSV whose header doesn't have the raw columns in their order is refused: the stream
    fails and the file is not taken as read.
    """
    reader = spark.readStream.format(fmt).schema(RAW_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", "true").option("enforceSchema", "false")
    stream = reader.load(source_dir).withColumn("source_sheet", F.lit(source_name))
    writer = (stream.writeStream.foreachBatch(lambda df, _id: merge_batch(df, target_path))
              .option("checkpointLocation", checkpoint_location))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
