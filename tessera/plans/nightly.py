"""The ordered tail of a refresh, and reclassification, as functions of tables: each step sees what the one before decided."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import curation, entity, history, rollup
from ..sources.staging import staged


def normalized(raw: DataFrame) -> DataFrame:
    """Raw listings (category, subcategory, item_name, color, finish, thickness, uom, ...) with derived attributes and key."""
    kind = N.canonical_type(F.col("category"), F.col("subcategory"), F.col("item_name"))
    typed = raw.withColumn("material_type", kind)
    color = N.clean_color(F.col("color"))
    return typed.withColumns(
        {
            "material_key": N.material_key(F.col("item_name"), F.col("material_type")),
            "color": F.when(color != "", color).otherwise(N.color_in_name(F.col("item_name"))),
            "finish": N.finish(F.col("item_name"), F.col("finish")),
            "thickness": N.thickness(F.col("thickness"), F.col("item_name"), F.col("uom")),
        }
    )


def vote(materials: DataFrame) -> DataFrame:
    """Listings of unknown type take the type that most of their name's siblings have; their key follows."""
    won = entity.majority(materials, "base", "material_type").select("base", F.col("material_type").alias("_won"))
    known = F.coalesce(F.when(F.col("material_type").isin("Other", ""), F.col("_won")), F.col("material_type"))
    out = materials.join(won, "base", "left").withColumn("_type", known)
    key = F.when(F.col("_type") != F.col("material_type"), F.concat_ws("|", "base", F.lower("_type"))).otherwise(F.col("material_key"))
    return out.withColumns({"material_key": key, "material_type": F.col("_type")}).select(*materials.columns)


def repaired(materials: DataFrame, suppliers: DataFrame, metric_hosts: DataFrame, inch_hosts: DataFrame) -> DataFrame:
    """Stored listings with sides of metric hosts (host) and thicknesses of inch hosts (host) as they should be; others, and those that are right, stay. Doing it again changes nothing."""
    mark = lambda hosts, name: hosts.select(F.lower("host").alias("_host"), F.lit(True).alias(name)).distinct()
    known = suppliers.select(F.col("id").alias("supplier_id"), F.lower("host").alias("_host")).join(mark(metric_hosts, "_metric"), "_host", "left").join(mark(inch_hosts, "_inch"), "_host", "left")
    named = materials.join(known, "supplier_id", "left")
    metric, inch = F.coalesce("_metric", F.lit(False)), F.coalesce("_inch", F.lit(False))
    side = lambda c: F.when(metric, N.inches(F.col(c))).otherwise(F.col(c))
    fixed = {"avg_length": side("avg_length"), "avg_width": side("avg_width"), "thickness": F.when(inch & (F.coalesce("thickness", F.lit("")) != ""), N.repair_inches(F.col("thickness"))).otherwise(F.col("thickness"))}
    return named.withColumns(fixed).select(*materials.columns)


def reclassified(stored: DataFrame, suppliers: DataFrame, aliases: DataFrame, metric_hosts: DataFrame | None = None, inch_hosts: DataFrame | None = None) -> dict[str, DataFrame]:
    """Stored listings under the present rules, in this order: millimetres and sides repaired, attributes and keys made anew, unknown types by vote, aliases under the new keys and applied, mirrors found, and the rollup."""
    mm = stored.withColumn("thickness", N.repair_mm(F.col("thickness"), F.col("uom")))
    fixed = staged(normalized(repaired(mm, suppliers, suppliers.limit(0) if metric_hosts is None else metric_hosts, suppliers.limit(0) if inch_hosts is None else inch_hosts)), "normalized")  # read three times below
    voted = vote(fixed.withColumn("base", F.regexp_extract("material_key", r"^(.*)\|", 1)))
    again = curation.remapped_aliases(aliases, F.col("alias_key"))
    folded = entity.apply_aliases(voted, entity.resolve_aliases(again))
    found = entity.mirrors(folded, suppliers)
    return {"materials": folded, "aliases": again, "mirrors": found, "rollup": rollup.product_rollup(folded, suppliers)}


class Tail:
    """What follows a refresh, in this order: vote, aliases, storefront scopes, honest counts, today's snapshots taken again, retention, mirrors, proposals of scopes, rollup and figures.

    Each step is a plan over those before; mirrors, which take rounds of their own, are only looked
    for where they, proposals or figures are asked for. suppliers may have text, from which scopes
    are proposed; past has the snapshots that the crawl took today, before counts were made honest.
    """

    def __init__(self, materials: DataFrame, suppliers: DataFrame, aliases: DataFrame, scopes: DataFrame, past: DataFrame, today: Column, keep: int = 3, rejected: DataFrame | None = None) -> None:
        self._in = (suppliers, past, today, keep, rejected)
        folded = entity.apply_aliases(vote(materials), entity.resolve_aliases(aliases))
        self.materials = rollup.collapse_counts(curation.apply_scopes(folded, suppliers, scopes))

    @cached_property
    def history(self) -> DataFrame:
        """The last snapshots of each supplier, today's marked as rebased."""
        _, past, today, keep, _ = self._in
        return history.prune(history.resnapshot(past, self.materials, today), keep)

    @cached_property
    def mirrors(self) -> DataFrame:
        return entity.mirrors(self.materials, self._in[0])

    @cached_property
    def proposals(self) -> DataFrame:
        suppliers, _, _, _, rejected = self._in
        texts = suppliers if "text" in suppliers.columns else suppliers.withColumn("text", F.concat_ws(" ", "host", "company"))
        return curation.scope_proposals(texts, self.materials, self.mirrors, rejected)

    @cached_property
    def rollup(self) -> DataFrame:
        return rollup.product_rollup(self.materials, self._in[0])

    @cached_property
    def stats(self) -> DataFrame:
        kept = staged(self.materials.select("supplier_id", "item_id", "material_type", "material_key", "image_url"), "kept")  # read for mirrors, storefronts and listings
        if "mirrors" not in self.__dict__:
            self.mirrors = entity.mirrors(kept, self._in[0])
        return rollup.stats(kept, self._in[0], self.mirrors)
