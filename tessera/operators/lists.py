"""What users keep: lists, the tray of products to compare, saved searches, alerts seen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Products in the tray at most.
TRAY = 4


def added(kept: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """kept with new rows (the same columns); what is there by its keys stays as it is, blank keys aren't added. Of new rows with one key the first by added_at counts."""
    filled = reduce(lambda a, b: a & b, (F.trim(F.coalesce(F.col(k).cast("string"), F.lit(""))) != "" for k in keys))
    one = new.where(filled).groupBy(*keys).agg(F.min(F.struct("added_at", *(c for c in new.columns if c not in (*keys, "added_at")))).alias("_r")).select(*keys, "_r.*")
    return kept.unionByName(one.join(kept, keys, "left_anti").select(*kept.columns))


def into_tray(tray: DataFrame, new: DataFrame, most: int = TRAY) -> tuple[DataFrame, DataFrame]:
    """The tray (user_id, material_key, added_at) with new products, and (user_id, material_key, answer): exists, added, or full beyond `most` a user."""
    both = added(tray, new, ["user_id", "material_key"])
    placed = both.join(tray.select("user_id", "material_key", F.lit(0).alias("_new")), ["user_id", "material_key"], "left").withColumn("_new", F.coalesce("_new", F.lit(1)))
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("_new", "added_at", "material_key"))
    numbered = placed.withColumn("_nth", nth)
    answer = F.when(F.col("_new") == 0, "exists").when(F.col("_nth") <= most, "added").otherwise("full")
    asked = new.select("user_id", "material_key").distinct().join(numbered, ["user_id", "material_key"]).select("user_id", "material_key", answer.alias("answer"))
    return numbered.where((F.col("_new") == 0) | (F.col("_nth") <= most)).select(*tray.columns), asked


def noted(kept: DataFrame, notes: DataFrame, keys: list[str]) -> DataFrame:
    """kept with the notes (keys, note) of those rows that have new ones."""
    return kept.join(notes.withColumnRenamed("note", "_note"), keys, "left").withColumn("note", F.coalesce("_note", "note")).select(*kept.columns)


def without_lists(lists: DataFrame, items: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lists (list_id) and their items without the lists that are gone (list_id)."""
    return lists.join(gone, "list_id", "left_anti"), items.join(gone, "list_id", "left_anti")


def request_texts(items: DataFrame) -> DataFrame:
    """(supplier, text) of list items (supplier, item_name, thickness, slabs): a request for a quote to each supplier, suppliers and items in order whatever their case."""
    line = F.concat(F.lit("- "), "item_name", F.when(F.coalesce("thickness", F.lit("")) != "", F.concat(F.lit(" ("), "thickness", F.lit(")"))).otherwise(""), F.lit(": "), F.col("slabs").cast("string"), F.lit(" slabs"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.lower("item_name").alias("o"), line.alias("line")))), lambda x: x["line"])
    return items.groupBy("supplier").agg(F.concat(F.lit("Please quote:\n"), F.array_join(lines, "\n")).alias("text")).orderBy(F.lower("supplier"))
