"""Products side by side for each user's tray: evidence under their present keys, miles from the user's origin, and who leads in what."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import entity, places, rollup

#: Figures of which the largest leads, and those of which the smallest does.
MOST, LEAST = ("suppliers", "deepest", "total"), ("price_sqft", "miles")


def evidence(materials: DataFrame) -> DataFrame:
    """(material_key, suppliers, deepest, total, price_sqft) of products."""
    held = materials.groupBy("material_key", "supplier_id").agg(F.sum(rollup.slabs()).alias("n"))
    yards = held.groupBy("material_key").agg(F.count(F.lit(1)).alias("suppliers"), F.max("n").alias("deepest"), F.sum("n").alias("total"))
    price = N.price(F.col("price_range"))
    low = materials.select("material_key", price.alias("p")).where("p.basis = 'sqft'").groupBy("material_key").agg(F.min("p.amount").alias("price_sqft"))
    return yards.join(low, "material_key", "left")


def yards_of(materials: DataFrame, suppliers: DataFrame, geo: DataFrame, keys: DataFrame) -> DataFrame:
    """(material_key, location, lat, lon) of the places where some products (material_key) are kept that are on the map: an item's own, else its supplier's."""
    own = F.col("locations") if "locations" in materials.columns else F.lit("")
    theirs = suppliers.select(F.col("id").alias("supplier_id"), F.col("locations" if "locations" in suppliers.columns else "location").alias("_theirs"))
    rows = materials.join(keys, "material_key", "left_semi").join(theirs, "supplier_id")
    text = F.coalesce(F.nullif(own, F.lit("")), "_theirs")
    at = rows.select("material_key", F.explode(F.split(text, ",")).alias("_p")).select("material_key", F.lower(F.trim("_p")).alias("_place")).distinct()
    known = geo.where("lat is not null").select(F.lower(F.trim("location")).alias("_place"), "lat", "lon")
    return at.join(known, "_place").select("material_key", F.col("_place").alias("location"), "lat", "lon")


def nearest_yards(asked: DataFrame, yards: DataFrame, origins: DataFrame) -> DataFrame:
    """(user_id, material_key, miles): how far each user (origins: user_id, lat, lon) is from the nearest yard of each product that they ask for (user_id, material_key). Distances are worked out once for each pair of points."""
    wanted = asked.join(origins, "user_id").join(yards.select("material_key", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")), "material_key")
    pairs = wanted.select("lat", "lon", "_lat", "_lon").distinct().withColumn("_m", places.miles_between(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")))
    return wanted.join(pairs, ["lat", "lon", "_lat", "_lon"]).groupBy("user_id", "material_key").agg(F.round(F.min("_m"), 1).alias("miles"))


def columns(trays: DataFrame, materials: DataFrame, suppliers: DataFrame, aliases: DataFrame, origins: DataFrame, geo: DataFrame) -> DataFrame:
    """(user_id, asked, material_key, gone, suppliers, deepest, total, price_sqft, miles, and wins_* of each figure) of every product in users' trays (user_id, material_key).

    Keys follow aliases to their end. A product that no catalog has any more is gone and has no
    figures. A figure is won by the only best one where two products at least have it.
    """
    resolved = entity.resolve_aliases(aliases)
    tray = trays.select("user_id", F.col("material_key").alias("asked")).join(resolved, F.col("asked") == F.col("alias_key"), "left").select("user_id", "asked", F.coalesce("canonical_key", "asked").alias("material_key"))
    keys = tray.select("material_key").distinct()
    ev = evidence(materials.join(keys, "material_key", "left_semi"))
    near = nearest_yards(tray.select("user_id", "material_key").distinct(), yards_of(materials, suppliers, geo, keys), origins)
    out = tray.join(ev, "material_key", "left").join(near, ["user_id", "material_key"], "left").withColumn("gone", F.col("suppliers").isNull())
    mine = Window.partitionBy("user_id")
    for figures, best_of in ((MOST, F.max), (LEAST, F.min)):
        for c in figures:
            value = F.when(F.col(c) > 0, F.col(c)) if c == "total" else F.col(c)
            out = out.withColumns({"_v": value, "_b": best_of(value).over(mine), "_n": F.count(value).over(mine)})
            leads = F.coalesce(F.col("_v") == F.col("_b"), F.lit(False))
            out = out.withColumn("_l", F.sum(leads.cast("int")).over(mine)).withColumn(f"wins_{c}", leads & (F.col("_n") >= 2) & (F.col("_l") == 1)).drop("_v", "_b", "_n", "_l")
    return out
