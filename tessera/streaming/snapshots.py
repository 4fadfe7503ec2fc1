"""Snapshots of a stream of listings, whatever batches they come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import history

_GRAIN = ("snapshot_date", "supplier_id", "name_norm", "thickness", "product_form")


def follow(listings: DataFrame, path: str, checkpoint: str, unit: str = "day") -> StreamingQuery:
    """Writes sums of a stream of listings (as materials, with crawled_at, and crawl where a supplier may be read again on its day) to path: a folder for each batch, which a batch that is run again replaces. Ends when the stream has been read."""

    def take(batch: DataFrame, number: int) -> None:
        rows = batch if "crawl" in batch.columns else batch.withColumn("crawl", F.lit(0))
        at = F.struct(F.date_trunc(unit, "crawled_at").alias("day"), F.col("crawl").cast("long").alias("crawl"))
        made = history.snapshots(rows, at).select(F.col("snapshot_date.day").alias("snapshot_date"), F.col("snapshot_date.crawl").alias("crawl"), *(c for c in ("supplier_id", "name_norm", "thickness", "product_form", "slabs", "material_type", "material_key", "image_url")))
        made.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return listings.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The snapshots that follow has written, as history.snapshots has them: the parts of a crawl that came in several batches together, and of several crawls of a supplier on a day the last."""
    rows = spark.read.parquet(path).drop("batch")
    last = rows.groupBy("snapshot_date", "supplier_id").agg(F.max("crawl").alias("crawl"))
    kept = rows.join(last, ["snapshot_date", "supplier_id", "crawl"], "left_semi")
    return kept.groupBy(*_GRAIN).agg(F.sum("slabs").alias("slabs"), F.max("material_type").alias("material_type"), F.max("material_key").alias("material_key"), F.max("image_url").alias("image_url"), F.lit(0).alias("rebased"))
