"""What state suppliers and candidates are in, and how many wait for somebody."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import entity, policy

#: States of suppliers in the order in which they are shown, and of candidates.
ORDER = ("broken", "stale", "empty", "blocked", "challenged", "ok", "paused", "delisted")
BUCKETS = ("unprobed", "empty", "broken", "challenged", "blocked", "live", "rejected")


def supplier_status(error: Column, items: Column) -> Column:
    """A supplier's state by its last error and what it has."""
    failed, has = F.coalesce(error, F.lit("")) != "", F.coalesce(items, F.lit(0)) > 0
    return F.coalesce(F.nullif(policy.decline(error), F.lit("")), F.when(has, F.when(failed, "stale").otherwise("ok")).otherwise(F.when(failed, "broken").otherwise("empty")))


def candidate_status(probed: Column, items: Column, error: Column) -> Column:
    """A candidate's state: its error goes before what an earlier crawl has left."""
    failed = F.coalesce(error, F.lit("")) != ""
    return F.when(~probed, "unprobed").when(policy.decline(error) != "", policy.decline(error)).when(failed, "broken").otherwise(F.when(F.coalesce(items, F.lit(0)) > 0, "live").otherwise("empty"))


def health(suppliers: DataFrame, reach: DataFrame) -> DataFrame:
    """suppliers (host, last_error, item_count, ...) with status, crawled and nth: those that the next crawl asks first, by state, then by size. reach: (host, reach) of policy.reach."""
    rows = suppliers.join(reach.withColumnRenamed("host", "_h"), F.lower("host") == F.col("_h"), "left").drop("_h")
    own = supplier_status(F.col("last_error"), F.col("item_count"))
    status = F.when(F.col("reach").isNull(), "delisted").when((F.col("reach") == "paused") & ~own.isin("blocked", "challenged"), "paused").otherwise(own)
    return rows.withColumn("status", status).withColumn("crawled", F.coalesce(F.col("reach") == "crawl", F.lit(False))).drop("reach")


def by_priority(rows: DataFrame) -> DataFrame:
    """Rows of health in the order in which they are shown."""
    return rows.orderBy(~F.col("crawled"), F.array_position(F.array(*map(F.lit, ORDER)), F.col("status")), F.desc(F.coalesce("item_count", F.lit(0))), "host")


def triage(entries: DataFrame, suppliers: DataFrame, today: Column) -> DataFrame:
    """entries (host, provider, rejected, rejected_at) of the registry with items, error and status; a rejection goes before all else. days_left: until it lapses."""
    rows = entries.join(suppliers.select("host", F.coalesce("item_count", F.lit(0)).alias("items"), F.coalesce("last_error", F.lit("")).alias("error"), F.lit(True).alias("_probed")), "host", "left")
    own = candidate_status(F.coalesce("_probed", F.lit(False)), F.col("items"), F.col("error"))
    rejected = F.coalesce("rejected", F.lit(False))
    left = policy.LAPSE_DAYS - F.datediff(today, F.try_to_date("rejected_at"))
    return rows.select("host", F.coalesce("provider", F.lit("stoneprofits")).alias("provider"), F.coalesce("items", F.lit(0)).alias("items"), F.when(rejected, "rejected").otherwise(own).alias("status"), F.when(rejected, left).alias("days_left"))


def by_provider(rows: DataFrame) -> DataFrame:
    """(provider, total, live, materials) of triage."""
    return rows.groupBy("provider").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("status") == "live", 1)).alias("live"), F.sum("items").alias("materials"))


def pending(materials: DataFrame, spelling_clusters: DataFrame) -> DataFrame:
    """One row: clusters of types and of spellings that wait for a curator."""
    kinds = entity.key_aggregates(materials).groupBy("base").agg(F.count_distinct("type").alias("n")).where("n >= 2").agg(F.count(F.lit(1)).alias("conflicts"))
    return kinds.join(F.broadcast(spelling_clusters.agg(F.count_distinct("sig").alias("spellings"))), F.lit(True), "left")  # one row each


def badge(health_rows: DataFrame, triage_rows: DataFrame, pending_row: DataFrame) -> DataFrame:
    """One row (health, discovery, quality, total): what waits for somebody."""
    one = health_rows.agg(F.count(F.when(F.col("status").isin("broken", "stale", "empty"), 1)).alias("health"))
    two = triage_rows.agg(F.count(F.when(F.col("status") == "unprobed", 1)).alias("discovery"))
    three = pending_row.select((F.col("conflicts") + F.col("spellings")).alias("quality"))
    return one.join(F.broadcast(two), F.lit(True), "left").join(F.broadcast(three), F.lit(True), "left").withColumn("total", F.col("health") + F.col("discovery") + F.col("quality"))


def health_page(suppliers: DataFrame, materials: DataFrame, residue: DataFrame, now: Column) -> DataFrame:
    """(id, name, phone, email, items, status, age_hours, data_age_hours, residue) of every supplier: when it was last tried, and how old what it serves is. residue: (supplier_id) of those that serve what the last try failed to replace."""
    data = materials.groupBy("supplier_id").agg(F.max("crawled_at").alias("_data_at"), F.count(F.lit(1)).alias("_listings"))
    items = F.coalesce("item_count", "_listings") if "item_count" in suppliers.columns else F.col("_listings")
    hours = lambda at: F.round((F.unix_timestamp(now) - F.unix_timestamp(at)) / 3600, 2)
    own = lambda c: F.col(c) if c in suppliers.columns else F.lit(None).cast("string")
    rows = suppliers.join(data, F.col("id") == F.col("supplier_id"), "left").drop("supplier_id").join(residue.select(F.col("supplier_id").alias("id"), F.lit(True).alias("_old")).distinct(), "id", "left")
    return rows.select(
        "id", F.coalesce(F.nullif("company", F.lit("")), "host").alias("name"), own("phone").alias("phone"), own("email").alias("email"), F.coalesce(items, F.lit(0)).alias("items"),
        supplier_status(F.col("last_error"), items).alias("status"), hours(F.try_to_timestamp(F.col("last_crawled").cast("string"))).alias("age_hours"), hours(F.col("_data_at")).alias("data_age_hours"), F.coalesce("_old", F.lit(False)).alias("residue"),
    )


def quality_counts(materials: DataFrame) -> DataFrame:
    """One row: listings, and how many lack a photo, a colour, a thickness or an identifier."""
    none = lambda c: F.count(F.when(F.coalesce(c, F.lit("")) == "", 1))
    return materials.agg(F.count(F.lit(1)).alias("listings"), none("image_url").alias("no_image"), none("color").alias("no_color"), none("thickness").alias("no_thickness"), none("idone").alias("no_ident"))


def cluster_preview(clusters: DataFrame, by: list[str], most: int = 4) -> DataFrame:
    """(nth, *by, canonical, suppliers, slabs) of the clusters with the widest reach, then the deepest; members are as conflict_clusters and spelling_clusters have them."""
    sums = clusters.groupBy(*by, "canonical").agg(F.sum("suppliers").alias("suppliers"), F.sum("slabs").alias("slabs"))
    first = sums.orderBy(F.desc("suppliers"), F.desc("slabs"), *by).limit(most)
    return first.select(F.row_number().over(Window.orderBy(F.desc("suppliers"), F.desc("slabs"), *by)).alias("nth"), *by, "canonical", "suppliers", "slabs")
