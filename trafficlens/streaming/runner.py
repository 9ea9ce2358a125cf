"""Finite runs of streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import shared_dir


def drain(stream: DataFrame, name: str, mode: str = "append", path: str | None = None,
          checkpoint: str | None = None) -> DataFrame:
    """Process all available input into a Parquet sink and return the sink."""
    spark = stream.sparkSession
    base = shared_dir(spark, name)
    path, checkpoint = path or f"{base}/data", checkpoint or f"{base}/checkpoint"
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").start(path)
    else:
        def replace(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(path)

        query = writer.outputMode(mode).foreachBatch(replace).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_newest(stream: DataFrame, name: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Keep the newest version of a table with a ``version`` column and return it.

    Versions take turns in two folders: readers have the one before while the
    next is written, a repeated batch writes the same folder again, and a batch
    without rows writes none.
    """
    spark = stream.sparkSession
    base = shared_dir(spark, name)
    path, checkpoint = path or f"{base}/data", checkpoint or f"{base}/checkpoint"

    def keep(batch: DataFrame, _: int) -> None:
        (batch.withColumn("turn", F.col("version") % 2).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("turn").parquet(path))

    query = (stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
             .outputMode("append").foreachBatch(keep).start())
    query.awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(path)
    last = rows.agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(last), "version").select(*stream.columns)  # one row
