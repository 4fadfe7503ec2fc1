"""Saved searches matched backwards: each stands under what is rarest of that which it requires, listings probe for it, and the rest is verified. One pass for any number of searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import close, rollup
from ..sources.staging import staged
from . import search

#: Letters of a name that listings probe with; shorter terms with as many as they have.
GRAM = 3
_BASES = tuple(sorted({search.color_word(c) for c in vocab.COLORS}))


def _grams(name: Column, size: int) -> Column:
    n = F.length(name)
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(name, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def _tagged(tag: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(tag), v))


def _probes(name: Column) -> Column:
    """All keys that a kind of listing is looked up by."""
    colors = F.filter(F.array(*map(F.lit, _BASES)), lambda b: F.array_contains("color_words", b) | F.contains("color_name", b))
    forms = F.filter(F.array(*map(F.lit, sorted(set(vocab.FORMS.values())))), lambda f: _form_fits(f))
    one = lambda tag, c: F.array(F.concat(F.lit(tag), c))
    return F.array_distinct(F.concat(*(_tagged(f"{k}:", _grams(name, k)) for k in range(1, GRAM + 1)), one("type:", F.col("kind")), one("thick:", F.coalesce("thickness", F.lit(""))), _tagged("color:", colors), _tagged("form:", forms), F.array(F.lit("*"))))


def _form_fits(form: Column) -> Column:
    by_form = F.contains("form_up", F.upper(form))
    return by_form | ((form != "slab") & F.contains(F.upper("name"), F.upper(form)))


def kinds(materials: DataFrame, suppliers: DataFrame) -> DataFrame:
    """The distinct kinds of listing that searches can tell apart, by product."""
    held = materials.join(suppliers.select(F.col("id").alias("supplier_id")), "supplier_id", "left_semi")
    name = F.lower("item_name")
    rows = held.select(
        rollup.group_key().alias("grp"), name.alias("name"), F.lower("material_type").alias("kind"), (F.col("material_type") == vocab.ACCESSORY).alias("accessory"), "thickness", F.upper(F.coalesce("product_form", F.lit(""))).alias("form_up"),
        F.split(F.lower(F.regexp_replace(F.coalesce("color", F.lit("")), "(?i)grey", "gray")), r"[\s,/&-]+").alias("color_words"), F.regexp_replace(name, "grey", "gray").alias("color_name"), (F.coalesce("new_arrival", F.lit(0)) == 1).alias("new"),
    ).where("material_type is not null")
    return rows.distinct()


def _required(asked: Column, variants: Column) -> Column:
    """What a search requires, as groups of alternatives, each a list of keys that a match has all of."""
    term = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - GRAM + 1, F.lit(1))), lambda i: F.concat(F.least(F.length(t), F.lit(GRAM)).cast("string"), F.lit(":"), F.substring(t, i, F.lit(GRAM))))
    group = lambda there, tag, v: F.when(there, F.array(F.array(F.array(F.concat(F.lit(tag), v))))).otherwise(F.array().cast("array<array<array<string>>>"))
    words = F.transform(variants, lambda some: F.transform(some, term))
    color = F.regexp_replace(F.regexp_extract(asked["color"], r"([^\s-]*)$", 1), "grey", "gray")
    return F.concat(
        words, group(asked["material_type"] != "", "type:", F.lower(asked["material_type"])), group(asked["thickness"] != "", "thick:", asked["thickness"]),
        group(asked["color"] != "", "color:", color), group(asked["form"] != "", "form:", asked["form"]), F.array(F.array(F.array(F.lit("*")))),
    )


def matches(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, grp, new) of the distinct queries (query, asked, variants: alternatives of each term) and products of kinds (rows) that have a listing as asked for; new: whether one that is new."""
    probing = staged(rows.withColumn("id", F.monotonically_increasing_id()), "kinds")
    probes = staged(probing.select("id", F.explode(_probes(F.col("name"))).alias("key")), "probes")
    often = probes.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    each = queries.select("query", F.posexplode(_required(F.col("asked"), F.col("variants"))).alias("g", "alternatives")).select("query", "g", F.posexplode("alternatives").alias("a", "keys")).select("query", "g", "a", F.explode("keys").alias("key"))
    # the rarest key of each alternative, and the group of alternatives that listings probe for least
    rare = each.join(often, "key", "left").groupBy("query", "g", "a").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("k"))
    groups = rare.groupBy("query", "g").agg(F.sum("k.n").alias("n"), F.collect_set("k.key").alias("keys"))
    under = groups.groupBy("query").agg(F.min_by("keys", F.struct("n", "g")).alias("keys")).select("query", F.explode("keys").alias("key"))
    met = under.join(probes, "key").select("query", "id").distinct().join(probing, "id").join(queries, "query")
    color = F.regexp_replace(F.regexp_extract(F.col("asked.color"), r"([^\s-]*)$", 1), "grey", "gray")
    fits = (
        F.forall("variants", lambda some: F.exists(some, lambda t: F.contains("name", t)))
        & ((F.col("asked.material_type") == "") | (F.col("kind") == F.lower("asked.material_type")))
        & (~F.col("accessory") | (F.col("asked.material_type") == vocab.ACCESSORY))
        & ((F.col("asked.thickness") == "") | (F.coalesce("thickness", F.lit("")) == F.col("asked.thickness")))
        & ((F.col("asked.color") == "") | F.array_contains("color_words", color) | F.contains("color_name", color))
        & ((F.col("asked.form") == "") | _form_fits(F.col("asked.form")))
    )
    return met.where(fits).groupBy("query", "grp").agg(F.max("new").alias("new"))


def totals(materials: DataFrame, suppliers: DataFrame, saved: DataFrame, few: int = 5, most: int = 4) -> DataFrame:
    """(search_id, query, total, new, fuzzy) of saved searches (search_id, query): products that match, those with a new listing among the matching ones, and whether terms were taken for misspelt ones, as search does where fewer than `few` match and that finds more."""
    rows = staged(kinds(materials, suppliers), "kinds")
    asked = staged(saved.select("query").distinct().select("query", search.asked(F.col("query")).alias("asked")), "asked")
    exact = asked.withColumn("variants", F.transform("asked.terms", lambda t: F.array(t)))
    count = lambda found: found.groupBy("query").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("new"), 1)).alias("new"))
    first = staged(count(matches(rows, exact)), "counts")
    short = asked.join(first.select("query", F.col("total").alias("_t")), "query", "left").where((F.coalesce("_t", F.lit(0)) < few) & (F.size("asked.terms") > 0)).drop("_t")
    terms = short.select("query", F.posexplode("asked.terms").alias("at", "t"))
    near = close.closest(close.close_pairs(terms.select(F.upper("t").alias("term")), search.name_words(materials)), most).where("w <> term")
    more = near.groupBy("term").agg(F.collect_list(F.lower("w")).alias("ws"))
    wider = terms.join(more, F.upper("t") == F.col("term"), "left").groupBy("query").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", F.concat(F.array("t"), F.coalesce("ws", F.array().cast("array<string>"))).alias("v")))), lambda x: x["v"]).alias("variants"), F.count("ws").alias("_n")
    )
    second = count(matches(rows, short.join(wider.where("_n > 0").drop("_n"), "query"))).select("query", F.col("total").alias("_total"), F.col("new").alias("_new"))
    both = saved.select("search_id", "query").join(first, "query", "left").join(second, "query", "left")
    better = F.coalesce("_total", F.lit(0)) > F.coalesce("total", F.lit(0))
    pick = lambda c: F.coalesce(F.when(better, F.col(f"_{c}")).otherwise(F.col(c)), F.lit(0)).alias(c)
    return both.select("search_id", "query", pick("total"), pick("new"), better.alias("fuzzy"))
