"""Honest product totals: first per product and supplier, then per product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import vocab


#: Parts of addresses of photos that are thumbnails.
THUMBNAILS = ("slabcloud.com/slabs/",)


def is_tile() -> Column:
    return F.upper(F.coalesce("product_form", F.lit(""))).contains("TILE")


def is_thumbnail(thumbnails: tuple[str, ...] = THUMBNAILS) -> Column:
    return F.exists(F.array(*map(F.lit, thumbnails)), lambda t: F.contains("image_url", t))


def slabs() -> Column:
    """Slabs of a row; a tile row's quantity isn't slabs."""
    return F.when(is_tile(), F.lit(0)).otherwise(F.coalesce("available_slabs", F.lit(0)))


def group_key() -> Column:
    return F.when(F.coalesce("material_key", F.lit("")) == "", F.concat(F.lit("id:"), F.col("id").cast("string"))).otherwise(F.col("material_key"))


def _numbers() -> list[Column]:
    """What a supplier has of a product, in numbers."""
    area = slabs() * F.coalesce("avg_length", F.lit(0.0)) * F.coalesce("avg_width", F.lit(0.0))
    return [
        F.min("id").alias("id"),
        F.max("new_arrival").alias("new_arrival"),
        F.max("avg_length").alias("avg_length"),
        F.max("avg_width").alias("avg_width"),
        F.sum(slabs()).alias("sup_slabs"),
        F.sum(F.when(is_tile() & (F.upper(F.coalesce("uom", F.lit(""))) == "SF"), F.coalesce("available_slabs", F.lit(0))).otherwise(0)).alias("sup_tile_sf"),
        F.max(is_tile().cast("int")).alias("sup_has_tile"),
        (F.sum(area) / 144.0).alias("sup_sqft"),
    ]


def _texts(thumbnails: tuple[str, ...]) -> list[Column]:
    real = (F.coalesce("image_url", F.lit("")) != "") & ~is_thumbnail(thumbnails)
    return [
        F.min("item_name").alias("item_name"),
        F.max("material_type").alias("material_type"),
        F.max("color").alias("color"),
        F.max(F.when(real, F.col("image_url"))).alias("real_img"),
        F.max("image_url").alias("any_img"),
    ]


def _totals() -> list[Column]:
    """What all suppliers have together, in numbers, from those of each."""
    return [
        F.min("id").alias("id"),
        F.max("new_arrival").alias("new_arrival"),
        F.count(F.lit(1)).alias("suppliers"),
        F.max("sup_slabs").alias("available_slabs"),
        F.sum("sup_slabs").alias("total_slabs"),
        F.sum("sup_tile_sf").alias("tile_sf"),
        F.max("sup_has_tile").alias("has_tile"),
        F.max("avg_length").alias("avg_length"),
        F.max("avg_width").alias("avg_width"),
        F.round(F.max("sup_sqft"), 4).alias("total_sqft"),
    ]


#: The columns of a rollup, in their order.
ROLLUP = ("grp", "id", "material_key", "item_name", "material_type", "color", "new_arrival", "suppliers", "available_slabs", "total_slabs", "tile_sf", "has_tile", "avg_length", "avg_width", "total_sqft", "image_url")


def per_supplier(materials: DataFrame, thumbnails: tuple[str, ...] = THUMBNAILS, more: tuple[Column, ...] = (), within: tuple[str, ...] = ()) -> DataFrame:
    """One row for each product and supplier. more: further named aggregates. within: columns that follow from product and supplier, by which rows already lie together; they come last."""
    by = materials.groupBy(group_key().alias("grp"), "supplier_id", *within)
    made = by.agg(*_numbers(), F.max("material_key").alias("material_key"), *_texts(thumbnails), *more)
    return made.select(*(c for c in made.columns if c not in within), *within)


def _known(materials: DataFrame, suppliers: DataFrame) -> DataFrame:
    return materials.join(suppliers.select(F.col("id").alias("supplier_id")), "supplier_id", "left_semi")


def product_totals(materials: DataFrame, suppliers: DataFrame) -> DataFrame:
    """The rollup without its texts but the key. Least and greatest texts would have Spark sort all listings in place of hashing them, and a product's only key is its group."""
    keyed = F.max((F.coalesce("material_key", F.lit("")) != "").cast("int")).alias("_keyed")
    held = _known(materials, suppliers).groupBy(group_key().alias("grp"), "supplier_id").agg(*_numbers(), keyed)
    return held.groupBy("grp").agg(*_totals(), F.max("_keyed").alias("_keyed")).withColumn("material_key", F.when(F.col("_keyed") == 1, F.col("grp")).otherwise("")).select(*(c for c in ROLLUP if c not in _TEXTS))


#: Texts of a rollup, which don't depend on who has a product.
_TEXTS = ("item_name", "material_type", "color", "image_url")


def product_rollup(materials: DataFrame, suppliers: DataFrame) -> DataFrame:
    """One row for each product: what the deepest supplier has, and what all have together."""
    # each combination of texts once; as its number is looked at, Spark doesn't drop that grouping, by hash, for the next, by sorting
    used = _known(materials, suppliers).groupBy(group_key().alias("grp"), *_TEXTS).agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    texts = used.groupBy("grp").agg(*_texts(THUMBNAILS)).withColumn("image_url", F.coalesce("real_img", "any_img"))
    return product_totals(materials, suppliers).join(texts, "grp", "left").select(*ROLLUP)


def across_suppliers(held: DataFrame) -> DataFrame:
    """One row for each product from those of per_supplier."""
    key = F.coalesce(F.max("material_key"), F.lit("")).alias("material_key")
    texts = (F.min("item_name").alias("item_name"), F.max("material_type").alias("material_type"), F.max("color").alias("color"), F.coalesce(F.max("real_img"), F.max("any_img")).alias("image_url"))
    return held.groupBy("grp").agg(*_totals(), key, *texts).select(*ROLLUP)


def in_stock(rollup: DataFrame, min_sqft: float | None = None) -> DataFrame:
    """Products that some supplier has in stock or as tiles; with min_sqft, one supplier must hold the area."""
    out = rollup.where((F.col("available_slabs") > 0) | (F.col("has_tile") == 1))
    return out if min_sqft is None else out.where(F.col("total_sqft") >= min_sqft)


#: Orders of search results, each ending in the product so that pages agree. distance needs miles.
SORTS = {
    "relevance": lambda: [F.desc("suppliers"), F.desc("available_slabs"), F.asc("material_key")],
    "slabs": lambda: [F.desc("available_slabs"), F.asc("material_key")],
    "size": lambda: [F.desc("avg_length"), F.asc("material_key")],
    "new": lambda: [F.desc("new_arrival"), F.asc("material_key")],
    "area": lambda: [F.desc("total_sqft"), F.asc("material_key")],
    "distance": lambda: [F.asc("miles"), F.desc("available_slabs"), F.asc("material_key")],
}


def page(rollup: DataFrame, sort: str, size: int, number: int = 1) -> DataFrame:
    """A page of products; an order that isn't known, or distance without miles, is by relevance."""
    order = sort if sort in SORTS and (sort != "distance" or "miles" in rollup.columns) else "relevance"
    return rollup.orderBy(*SORTS[order](), F.asc("grp")).offset(size * (number - 1)).limit(size)


def collapse_counts(materials: DataFrame) -> DataFrame:
    """materials with each item's slabs on one representative row: as many as it has identifier rows, or its largest figure; tiles stay."""
    named = F.coalesce("idone", F.lit("")) != ""
    sized = F.coalesce("avg_length", F.lit(0.0)) > 0
    rank = F.when(named & sized, 0).when(named, 1).when(sized, 2).otherwise(3)
    item = Window.partitionBy("supplier_id", "item_id", "_tile")
    first = item.orderBy(rank, F.coalesce("available_slabs", F.lit(0)).desc(), "id")
    ranked = materials.withColumn("_tile", is_tile()).select(
        "*",
        F.count(F.lit(1)).over(item).alias("_n"),
        F.row_number().over(first).alias("_rn"),
        F.sum(named.cast("long")).over(item).alias("_named"),
        F.max(F.coalesce("available_slabs", F.lit(0))).over(item).alias("_most"),
    )
    fixed = F.when(F.col("_rn") > 1, 0).otherwise(F.when(F.col("_named") > 0, F.col("_named")).otherwise(F.col("_most")))
    return ranked.withColumn(
        "available_slabs", F.when(F.col("_tile") | (F.col("_n") == 1), F.col("available_slabs")).otherwise(fixed).cast("long")
    ).select(*materials.columns)


def stats(materials: DataFrame, suppliers: DataFrame, mirrors: DataFrame | None = None) -> DataFrame:
    """One row: storefronts that have stock and mirror no other, and listings, products and listings with a photo, accessories left out. suppliers may have item_count, else those with listings have stock. mirrors: (host)."""
    if "item_count" in suppliers.columns:
        stocked = suppliers.where("item_count > 0")
    else:
        stocked = suppliers.join(materials.select(F.col("supplier_id").alias("id")).distinct(), "id", "left_semi")
    stocked = stocked if mirrors is None else stocked.join(mirrors.select("host"), "host", "left_anti")
    one = materials.where(F.col("material_type") != vocab.ACCESSORY).agg(
        F.count(F.lit(1)).alias("listings"), F.count_distinct(F.nullif("material_key", F.lit(""))).alias("products"), F.count(F.when(F.col("image_url") != "", 1)).alias("images")
    )
    return one.join(F.broadcast(stocked.agg(F.count(F.lit(1)).alias("suppliers"))), F.lit(True), "left")  # one row each


def by_type(materials: DataFrame) -> DataFrame:
    """(material_type, listings, products) of each named type but accessories, the most frequent first."""
    named = materials.where((F.col("material_type") != "") & (F.col("material_type") != vocab.ACCESSORY))
    return named.groupBy("material_type").agg(F.count(F.lit(1)).alias("listings"), F.count_distinct("material_key").alias("products")).orderBy(F.desc("listings"), "material_type")


def thickness_order() -> list:
    """The order of thicknesses by their number, then as text."""
    return [F.coalesce(F.regexp_extract("thickness", r"^([\d.]+)", 1).try_cast("double"), F.lit(0.0)).asc(), F.asc("thickness")]


def color_options(materials: DataFrame) -> DataFrame:
    """(family, n): colour families by how many listings have them, a listing counting in each of its own; those of none come last, as Other."""
    used = materials.where(F.coalesce("color", F.lit("")) != "").groupBy("color").agg(F.count(F.lit(1)).alias("n"))
    of = N.families(F.col("color"))
    named = used.select(F.explode(F.when(F.size(of) == 0, F.array(F.lit("Other"))).otherwise(of)).alias("family"), "n")
    return named.groupBy("family").agg(F.sum("n").alias("n")).orderBy(F.col("family") == "Other", F.desc("n"), "family")


def by_choice(materials: DataFrame, choices: list[str]) -> DataFrame:
    """(choice, material_key, n): listings of each product that colour choices find, in one pass for all choices."""
    used = materials.groupBy("material_key", "color").agg(F.count(F.lit(1)).alias("n"))  # a colour is looked at once for each product, not for each listing
    found = F.array_compact(F.array(*(F.when(N.in_choice(F.col("color"), c), F.lit(c)) for c in choices)))
    return used.select("material_key", "n", F.explode(found).alias("choice")).groupBy("choice", "material_key").agg(F.sum("n").alias("n"))


def residue(materials: DataFrame, suppliers: DataFrame, hours: int = 24) -> DataFrame:
    """(supplier_id, newest): suppliers whose newest listing is older than their last attempt (last_crawled) by more than so many hours."""
    newest = materials.groupBy("supplier_id").agg(F.max("crawled_at").alias("newest"))
    tried = suppliers.where("last_crawled is not null").select(F.col("id").alias("supplier_id"), "last_crawled")
    return newest.join(tried, "supplier_id").where(F.unix_timestamp("newest") < F.unix_timestamp("last_crawled") - hours * 3600).select("supplier_id", "newest")
