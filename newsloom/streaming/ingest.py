"""Feeds as a stream: landed rows arrive, are deduplicated and merged with the table of items.

``merge_stream`` keeps the first date, score and signal of a known item; a restart goes on where it stopped. The table is
partitioned by a hash of the id: a batch reads and overwrites only the parts its ids fall into, and a batch that runs
twice leaves the same table. A table that can't be read stops the stream; it is never taken for an empty one.
``tumbling`` and ``deduplicated`` are bounded in state by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import item_id
from ..operators.relational import first_per_key, merge_newer
from ..session import exists

#: Parts of the merged table.
PARTS = 32
KEPT = ["published", "score", "signal"]
COLUMNS = ["id", "title", "url", "source", "published", "score", "signal"]


def read_landed(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def merge_stream(landed: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Merges batches of (title, url, source, published, score, signal) into the parquet table ``table``."""
    spark = landed.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.where("title is not null and url is not null").withColumn("id", item_id(F.col("title")))
        new = first_per_key(new.select(*COLUMNS), ["id"], [F.desc_nulls_last("published"), F.col("url")])
        new = new.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int"))
        if exists(spark, table):
            touched = [r[0] for r in new.select("part").distinct().collect()]  # at most PARTS
            old = spark.read.parquet(table).where(F.col("part").isin(touched))
            new = merge_newer(new, old.select(*COLUMNS, "part"), "id", KEPT)
        new.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(table)

    return landed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(events: DataFrame, key: str, ts: str, delay: str = "120 days") -> DataFrame:
    """The first row per key within the watermark."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, ts: str, span: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Rows per span of event time, late rows up to ``delay``."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, span)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")
