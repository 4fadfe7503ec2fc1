"""What curators decide: spellings folded, aliases added, storefronts scoped, proposals rejected, products compared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import vocab
from . import entity, rollup


def spelling(base: Column) -> Column:
    """A base name without the differences that spellings make: known misspellings, spaces and punctuation."""
    fixed = reduce(lambda c, kv: F.regexp_replace(c, rf"(?<![a-z]){kv[0]}(?![a-z])", kv[1]), vocab.SPELLINGS.items(), F.lower(base))
    return F.regexp_replace(fixed, "[^a-z0-9]", "")


def spelling_clusters(materials: DataFrame) -> DataFrame:
    """Keys of one type whose bases differ in spelling only, with the key to fold them into and a signature that stays when members change."""
    keys = entity.key_aggregates(materials).withColumn("norm", spelling(F.col("base")))
    group = Window.partitionBy("type", "norm")
    best = group.orderBy(F.desc("suppliers"), F.desc("slabs"), "material_key")
    named = keys.select("*", F.size(F.collect_set("base").over(group)).alias("spellings"), F.first("material_key").over(best).alias("canonical"), F.concat_ws(":", F.lit("fuzzy"), "type", "norm").alias("sig"))
    # one condition: a filter of norm alone would go below the grouping, to every listing
    return named.where(F.when(F.col("norm") != "", F.col("spellings")) >= 2)


def without_rejected(clusters: DataFrame, rejected: DataFrame) -> DataFrame:
    """Clusters whose signature nobody has rejected."""
    return clusters.join(rejected.select("sig").distinct(), "sig", "left_anti")


def fold_edges(clusters: DataFrame) -> DataFrame:
    """(alias_key, canonical_key) that fold each cluster into its canonical key."""
    return clusters.where("material_key <> canonical").select(F.col("material_key").alias("alias_key"), F.col("canonical").alias("canonical_key"))


def add_aliases(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges with new ones (alias_key, canonical_key), which take the place of those with their alias, all at once.

    Every chain is followed to its end, also through new edges. On a cycle the new edge that comes
    last, by alias, is left out. Stored edges are expected to have no cycles.
    """
    fresh = new.where("alias_key <> canonical_key").groupBy("alias_key").agg(F.min("canonical_key").alias("canonical_key"))
    kept = edges.select("alias_key", "canonical_key").join(fresh, "alias_key", "left_anti")
    every = kept.withColumn("new", F.lit(0)).unionByName(fresh.withColumn("new", F.lit(1)))
    return entity.resolve_aliases(every.join(entity.cycle_closers(every, "new"), "alias_key", "left_anti"))


def without_aliases(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """edges but for the removed (alias_key); products come apart when their keys are next made from their names."""
    return edges.join(removed.select("alias_key"), "alias_key", "left_anti")


def remapped_aliases(edges: DataFrame, order: Column) -> DataFrame:
    """Stored aliases under the present rules of keys: self-maps go, of those that collide the last by order stays."""
    again = edges.select(N.remap_key(F.col("alias_key")).alias("alias_key"), N.remap_key(F.col("canonical_key")).alias("canonical_key"), order.alias("_at")).where("alias_key <> canonical_key")
    return again.groupBy("alias_key").agg(F.max_by("canonical_key", "_at").alias("canonical_key"))


def scope_proposals(suppliers: DataFrame, materials: DataFrame, mirrors: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """(host, material_type, matched, total) of every mirror (host): the one stocked type that the storefront (id, host, text) names as a whole word; null and zeros where it names none or several, or where that has been rejected (host, material_type)."""
    shown = suppliers.join(mirrors.select("host").distinct(), "host", "left_semi")
    mine = materials.join(shown.select(F.col("id").alias("supplier_id")), "supplier_id", "left_semi")
    item = F.nullif("item_id", F.lit(""))
    total = mine.groupBy("supplier_id").agg(F.count_distinct(item).alias("total"))
    types = mine.where("material_type <> ''").groupBy("supplier_id", "material_type").agg(F.count_distinct(item).alias("matched"))
    whole = F.concat(F.lit(r"\b\Q"), F.lower("material_type"), F.lit(r"\E\b"))
    hits = shown.join(types, F.col("id") == F.col("supplier_id")).where(F.regexp_like(F.lower("text"), whole))
    one = hits.groupBy("supplier_id", "host").agg(F.count(F.lit(1)).alias("_n"), F.first("material_type").alias("material_type"), F.first("matched").alias("matched")).where("_n = 1")
    one = one if rejected is None else one.join(rejected.select("host", "material_type"), ["host", "material_type"], "left_anti")
    one = one.join(total, "supplier_id").drop("host")
    return shown.join(one, F.col("id") == F.col("supplier_id"), "left").select("host", "material_type", F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("total", F.lit(0)).alias("total"))


def apply_scopes(materials: DataFrame, suppliers: DataFrame, scopes: DataFrame) -> DataFrame:
    """materials without rows outside their storefront's scope (host, material_type); a scope that would empty a storefront is skipped."""
    mine = suppliers.select(F.col("id").alias("supplier_id"), "host").join(scopes.select("host", F.col("material_type").alias("_scope")), "host").select("supplier_id", "_scope")
    held = mine.join(materials.select("supplier_id", F.col("material_type").alias("_scope")).distinct(), ["supplier_id", "_scope"], "left_semi")
    return materials.join(held, "supplier_id", "left").where(F.col("_scope").isNull() | (F.col("material_type") == F.col("_scope"))).select(*materials.columns)


def list_items(items: DataFrame, materials: DataFrame) -> DataFrame:
    """items (supplier_id, item_id, ...) with live_id, slabs, tile_sf and gone: what a saved item has become."""
    now = materials.groupBy("supplier_id", "item_id").agg(
        F.min("id").alias("live_id"), F.sum(rollup.slabs()).alias("slabs"), F.sum(F.when(rollup.is_tile() & (F.col("uom") == "SF"), F.col("available_slabs")).otherwise(0)).alias("tile_sf")
    )
    return items.join(now, ["supplier_id", "item_id"], "left").withColumn("gone", F.col("live_id").isNull())


def compared(materials: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence for each of a few products side by side, and in which figure each is the only best one."""
    y = materials.where(F.col("material_key").isin(*keys)).groupBy("material_key", "supplier_id").agg(F.sum(rollup.slabs()).alias("n"))
    out = y.groupBy("material_key").agg(F.count(F.lit(1)).alias("suppliers"), F.sum("n").alias("total"), F.max("n").alias("deepest"))
    best = out.agg(*(F.max(c).alias(f"_{c}") for c in ("suppliers", "total", "deepest")))  # one row; at most len(keys) rows are compared
    tops = out.join(F.broadcast(best), F.lit(True), "left")
    leads = tops.agg(*(F.sum((F.col(c) == F.col(f"_{c}")).cast("int")).alias(f"_n_{c}") for c in ("suppliers", "total", "deepest")))
    won = lambda c: ((F.col(c) == F.col(f"_{c}")) & (F.col(f"_n_{c}") == 1)).alias(f"wins_{c}")
    return tops.join(F.broadcast(leads), F.lit(True), "left").select("material_key", "suppliers", "total", "deepest", won("suppliers"), won("total"), won("deepest"))


def shown_clusters(members: DataFrame) -> DataFrame:
    """(cluster, name, photo) of clusters' members (cluster, item_name, base, image_url, suppliers, slabs, at): the name of the widest one, and the first photo in that order; of equal ones the first by at."""
    reach = F.struct((-F.col("suppliers")).alias("s"), (-F.col("slabs")).alias("n"), "at")
    name = F.coalesce(F.nullif("item_name", F.lit("")), F.initcap("base"))
    return members.groupBy("cluster").agg(F.min_by(name, reach).alias("name"), F.min_by("image_url", F.when(F.coalesce("image_url", F.lit("")) != "", reach)).alias("photo"))
