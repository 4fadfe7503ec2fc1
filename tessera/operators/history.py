"""Snapshots of suppliers' listings, and what changed between each supplier's last two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rollup import slabs

#: A supplier that lost more than this share of its listings at once was re-scoped or half read.
COLLAPSE = 0.5
#: A drop is to half or less and by so many slabs at least.
DROP = 5


def snapshots(materials: DataFrame, at: Column, rebased: int = 0) -> DataFrame:
    """(snapshot_date, supplier_id, name_norm, thickness, ...) by the date expression `at`; rebased marks snapshots that count slabs anew."""
    return materials.groupBy(at.alias("snapshot_date"), "supplier_id", F.col("base").alias("name_norm"), "thickness", "product_form").agg(
        F.sum(slabs()).alias("slabs"), F.max("material_type").alias("material_type"), F.max("material_key").alias("material_key"), F.max("image_url").alias("image_url"), F.lit(rebased).alias("rebased")
    )


def resnapshot(history: DataFrame, materials: DataFrame, today: Column) -> DataFrame:
    """history with the snapshots that suppliers already have of today taken again from their materials, marked as rebased."""
    done = history.where(F.col("snapshot_date") == today).select("supplier_id").distinct()
    again = snapshots(materials.join(done, "supplier_id", "left_semi"), today, rebased=1)
    return history.where(F.col("snapshot_date") != today).unionByName(again, allowMissingColumns=True)


def numbered(history: DataFrame) -> DataFrame:
    """(supplier_id, snapshot_date, nth): a supplier's snapshots, the latest first."""
    return history.select("supplier_id", "snapshot_date").distinct().withColumn("nth", F.dense_rank().over(Window.partitionBy("supplier_id").orderBy(F.desc("snapshot_date"))))


def prune(history: DataFrame, keep: int) -> DataFrame:
    """The last `keep` snapshots of each supplier, two at least: what readers compare. Dates are ranked where the rows lie, as history may be a long plan that a join with its own dates would run twice."""
    dated = history.where(F.col("supplier_id").isNotNull() & F.col("snapshot_date").isNotNull())
    nth = F.dense_rank().over(Window.partitionBy("supplier_id").orderBy(F.desc("snapshot_date")))
    rest = (c for c in history.columns if c not in ("supplier_id", "snapshot_date"))
    return dated.withColumn("_nth", nth).where(F.col("_nth") <= max(keep, 2)).select("supplier_id", "snapshot_date", *rest)


def listings(history: DataFrame) -> DataFrame:
    """Each supplier's listings at its latest and previous snapshot, side by side: latest and previous are null where absent. Suppliers with one snapshot have none.

    The dates are ranked once, on their distinct pairs, and all that readers need comes from one
    grouping of the listings; what holds for a supplier or a name then is a window over that.
    """
    dates = numbered(history)
    both = Window.partitionBy("supplier_id")
    dates = dates.where("nth <= 2").select("*", F.max(F.when(F.col("nth") == 1, F.col("snapshot_date"))).over(both).alias("latest_date"), F.max(F.when(F.col("nth") == 2, F.col("snapshot_date"))).over(both).alias("previous_date"))
    at = history.join(dates.where("previous_date is not null"), ["supplier_id", "snapshot_date"])
    of = lambda n, c: F.when(F.col("nth") == n, c)
    rebased = F.coalesce(F.col("rebased"), F.lit(0)) if "rebased" in history.columns else F.lit(0)
    return at.groupBy("supplier_id", "name_norm", "thickness").agg(
        F.sum(of(1, F.col("slabs"))).alias("latest"),
        F.sum(of(2, F.col("slabs"))).alias("previous"),
        F.max("material_type").alias("material_type"),
        F.max(of(1, rebased)).alias("latest_rebased"),
        F.max(of(2, rebased)).alias("previous_rebased"),
        F.max("latest_date").alias("latest_date"),
        F.max("previous_date").alias("previous_date"),
    )


def alert_kind(latest: Column, previous: Column, crossed: Column | None = None) -> Column:
    """What a listing that is there now has come to, or null. crossed: whether the two snapshots count slabs differently, so that a fall says nothing."""
    down = ~crossed if crossed is not None else F.lit(True)
    return (
        F.when(previous.isNull(), F.when(latest > 0, "listed"))
        .when(previous == 0, F.when(latest > 0, "restock"))
        .when(latest == 0, F.when(down, "soldout"))
        .when((latest * 2 <= previous) & (previous - latest >= DROP), F.when(down, "dropped"))
    )


def _named(both: DataFrame) -> DataFrame:
    """(supplier_id, now_names, prev_names): names of each supplier at its two snapshots."""
    names = both.groupBy("supplier_id", "name_norm").agg(F.max(F.col("latest").isNotNull().cast("int")).alias("_now"), F.max(F.col("previous").isNotNull().cast("int")).alias("_prev"))
    return names.groupBy("supplier_id").agg(F.sum("_now").alias("now_names"), F.sum("_prev").alias("prev_names"))


def collapsed(history: DataFrame, share: float = COLLAPSE) -> DataFrame:
    """(supplier_id, now_names, prev_names) of suppliers whose listings fell by more than the share."""
    return _named(listings(history)).where((F.col("prev_names") > 0) & (F.col("now_names") < (1 - share) * F.col("prev_names")))


def digest(history: DataFrame) -> DataFrame:
    """(supplier_id, name_norm, thickness, kind, latest, previous, sig) of all alerts, delisted ones but for collapsed suppliers."""
    each = F.struct("thickness", "latest", "previous", "latest_rebased", "previous_rebased", "latest_date")
    # by name, a listing for each of its few thicknesses, then the sums by supplier: no group is as large as a supplier
    names = listings(history).groupBy("supplier_id", "name_norm").agg(F.collect_list(each).alias("_l"), F.max(F.col("latest").isNotNull().cast("int")).alias("_here"), F.max(F.col("previous").isNotNull().cast("int")).alias("_was"))
    scale = names.groupBy("supplier_id").agg(F.sum("_here").alias("_now"), F.sum("_was").alias("_prev"))
    both = names.join(scale, "supplier_id").select("*", F.inline("_l"))
    crossed = (F.coalesce("latest_rebased", F.lit(0)) == 1) & (F.coalesce("previous_rebased", F.lit(0)) == 0)
    fell = (F.col("_prev") > 0) & (F.col("_now") < (1 - COLLAPSE) * F.col("_prev"))
    gone = F.col("latest").isNull() & (F.col("previous") > 0) & (F.col("_here") == 0) & ~fell
    kinds = both.withColumn("kind", F.when(F.col("latest").isNotNull(), alert_kind(F.col("latest"), F.col("previous"), crossed)).when(gone, "delisted")).where("kind is not null")
    sig = F.concat_ws("|", "kind", F.col("supplier_id").cast("string"), "name_norm", "thickness", F.date_format("latest_date", "yyyy-MM-dd"))
    return kinds.select("supplier_id", "name_norm", "thickness", "kind", "latest", "previous", sig.alias("sig"))


def shown(alerts: DataFrame, most: int = 300) -> DataFrame:
    """The alerts of each kind that a page shows, the largest first, with nth."""
    now, was = F.coalesce("latest", F.lit(0)), F.coalesce("previous", F.lit(0))
    size = F.when(F.col("kind").isin("restock", "listed"), now).when(F.col("kind") == "dropped", was - now).otherwise(was)
    order = Window.partitionBy("kind").orderBy(size.desc(), "supplier_id", "name_norm", "thickness")
    return alerts.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)


def unread(alerts: DataFrame, seen: DataFrame) -> DataFrame:
    """Alerts whose signature (sig) hasn't been seen."""
    return alerts.join(seen.select("sig").distinct(), "sig", "left_anti")


def stock_changes(history: DataFrame, materials: DataFrame, most: int = 600, each: int = 300) -> DataFrame:
    """(kind, nth, supplier_id, name_norm, thickness, slabs, id) of what is back in stock or newly listed since each supplier's previous snapshot and still has a listing (id: the first): the `most` deepest, of them `each` of a kind."""
    up = listings(history).where("latest > 0 and (previous is null or previous = 0)")
    kind = F.when(F.col("previous").isNull(), "listed").otherwise("restock")
    rows = up.select(kind.alias("kind"), "supplier_id", "name_norm", "thickness", F.col("latest").alias("slabs"))
    now = materials.groupBy("supplier_id", F.col("base").alias("name_norm"), "thickness").agg(F.min("id").alias("id"))
    deepest = rows.orderBy(F.desc("slabs"), "supplier_id", "name_norm", "thickness").limit(most).join(now, ["supplier_id", "name_norm", "thickness"])
    nth = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("slabs"), "supplier_id", "name_norm", "thickness"))
    return deepest.withColumn("nth", nth).where(F.col("nth") <= each).select("kind", "nth", "supplier_id", "name_norm", "thickness", "slabs", "id")
