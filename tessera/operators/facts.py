"""Curated facts about products: which may be shown, and which entry answers for a product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import vocab

#: Types that are manufactured.
ENGINEERED = ("quartz", "porcelain", "sintered stone", "engineered stone", "engineered glass", "engineered marble", "solid surface", "ceramic", "terrazzo")


def norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def shown(sources: Column, confidence: Column, *values: Column) -> Column:
    """Whether a fact may be shown: it has a source, a known confidence and a value."""
    return (F.coalesce(F.size(sources), F.lit(0)) > 0) & (F.coalesce(confidence, F.lit("unknown")) != "unknown") & F.coalesce(*(v.cast("string") for v in values)).isNotNull()


def _base(key: Column) -> Column:
    return F.regexp_replace(key, r"\|[^|]*$", "")


def lookup(products: DataFrame, facts: DataFrame) -> DataFrame:
    """products (material_key, name) with fact, the number of the entry that answers for it, or null.

    facts: (fact, key, display_name, also_known_as, formation), fact numbering the entries. A key, its
    base and the name are looked up in this order among keys and names; a natural entry never answers
    for a manufactured type. Then the engineered brand with the most words, all of which stand in the
    name (else in the base), answers; of equal ones the first.
    """
    names = F.concat(F.array("display_name"), F.coalesce("also_known_as", F.array().cast("array<string>")))
    probes = F.concat(F.array(F.lower("key"), norm(_base(F.col("key")))), F.transform(names, norm))
    index = facts.select("fact", "formation", F.explode(probes).alias("probe")).where("probe <> ''").groupBy("probe").agg(F.min_by(F.struct("fact", "formation"), "fact").alias("e"))
    rows = products.select("material_key", "name").distinct()
    asked = rows.select("*", F.posexplode(F.array(F.lower("material_key"), norm(_base(F.col("material_key"))), norm(F.col("name")))).alias("rank", "probe"))
    made = F.lower(F.trim(F.split_part("material_key", F.lit("|"), F.lit(-1)))).isin(*ENGINEERED)
    met = asked.join(index, "probe").where(~(made & F.coalesce(F.col("e.formation") == "natural", F.lit(False)))).select("material_key", "name", "rank", F.lit(0).alias("words"), F.col("e.fact").alias("fact"))
    brands = facts.where("formation = 'engineered'").select("fact", F.explode(F.transform(names, norm)).alias("brand")).where("brand <> ''")
    tokens = brands.select("fact", "brand", F.explode(F.array_distinct(F.split("brand", " "))).alias("word"))
    need = tokens.groupBy("fact", "brand").agg(F.count(F.lit(1)).alias("_need"))
    said = rows.select("*", F.posexplode(F.array(norm(F.col("name")), norm(_base(F.col("material_key"))))).alias("rank", "said"))
    words = said.select("material_key", "name", "rank", F.explode(F.array_distinct(F.split("said", " "))).alias("word"))
    hit = words.join(tokens, "word").groupBy("material_key", "name", "rank", "fact", "brand").agg(F.count(F.lit(1)).alias("_n")).join(need, ["fact", "brand"]).where("_n = _need")
    by_brand = hit.select("material_key", "name", (F.col("rank") + 3).alias("rank"), (-F.size(F.split("brand", " "))).alias("words"), "fact")
    none = rows.select("*", F.lit(99).alias("rank"), F.lit(0).alias("words"), F.lit(None).cast(facts.schema["fact"].dataType).alias("fact"))  # comes last
    best = met.unionByName(by_brand).unionByName(none).groupBy("material_key", "name").agg(F.min(F.struct("rank", "words", "fact")).alias("b"))
    return best.select("material_key", "name", F.col("b.fact").alias("fact"))


def merged(own: DataFrame, bundled: DataFrame, key: str) -> DataFrame:
    """own with those bundled entries whose key it lacks."""
    return own.unionByName(bundled.join(own.select(key), key, "left_anti"))


def latest(facts: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """facts with found ones added, or in place of those with their key."""
    return facts.join(found.select(key), key, "left_anti").unionByName(found)


def places(locations: DataFrame, overrides: DataFrame, cities: DataFrame) -> DataFrame:
    """locations (location) with lat, lon, label and source (override, exact, ambiguous or null).

    overrides: (name, lat, lon, label), unfilled ones are no answer; cities: (name, population, lat,
    lon, label). Of cities with one name the largest counts, ambiguous unless four times the next.
    """
    by_hand = overrides.where("lat is not null and lon is not null").select(F.lower(F.trim("name")).alias("_k"), F.lit("override").alias("source"), "lat", "lon", "label", F.lit(0).alias("_rank"))
    size = Window.partitionBy(F.lower("name")).orderBy(F.desc("population"), "lat", "lon")
    ranked = cities.select("*", F.row_number().over(size).alias("_rn"), F.lead("population").over(size).alias("_next"))
    source = F.when((F.coalesce("_next", F.lit(0)) > 0) & (F.col("_next") * 4 > F.col("population")), "ambiguous").otherwise("exact")
    by_name = ranked.where("_rn = 1").select(F.lower("name").alias("_k"), source.alias("source"), "lat", "lon", "label", F.lit(1).alias("_rank"))
    best = by_hand.unionByName(by_name).groupBy("_k").agg(F.min_by(F.struct("lat", "lon", F.coalesce("label", "_k").alias("label"), "source"), "_rank").alias("b"))
    return locations.withColumn("_k", F.lower(F.trim("location"))).join(best, "_k", "left").select(*locations.columns, "b.lat", "b.lon", "b.label", "b.source")


def about(name: Column, title: Column, body: Column) -> Column:
    """Whether a page is about a stone: its name stands as a phrase in the title or text, which also speaks of stone."""
    n = norm(name)
    return (n != "") & F.contains(norm(F.concat_ws(" ", title, body)), n) & F.coalesce(body, F.lit("")).rlike(vocab.STONE_WORDS)


def sourced(entries: DataFrame) -> DataFrame:
    """entries without what has no source: origin and price become unknown, quarries without a source or name go; removed names what has gone."""
    blank = lambda c: F.col(c).isNotNull() & (F.coalesce(F.size(F.col(f"{c}.sources")), F.lit(0)) == 0)
    quarries = F.coalesce("quarries", F.array().cast(entries.schema["quarries"].dataType))
    kept = F.filter(quarries, lambda q: (F.coalesce(F.size(q["sources"]), F.lit(0)) > 0) & (F.coalesce(q["name"], F.lit("")) != ""))
    lost = F.size(quarries) - F.size(kept)
    names = [F.when(blank(c), F.lit(c)) for c in ("origin", "price")] + [F.when(lost > 0, F.concat(lost.cast("string"), F.lit(" quarry claim(s)")))]
    none = {c: F.from_json(F.lit('{"confidence": "unknown", "sources": []}'), entries.schema[c].dataType.simpleString()) for c in ("origin", "price")}
    return entries.withColumns({"removed": F.array_compact(F.array(*names)), "quarries": kept, **{c: F.when(blank(c), none[c]).otherwise(F.col(c)) for c in none}})


def imported(known: DataFrame, entries: DataFrame) -> DataFrame:
    """known with researched entries (key, display_name, ..., at), sourced, in place of those with their key or, without one, their name; of several the last by at. Entries without a name are left out."""
    ident = F.coalesce(F.nullif(norm(F.col("key")), F.lit("")), norm(F.col("display_name")))
    fresh = sourced(entries.where(F.coalesce("display_name", F.lit("")) != "")).withColumn("_id", ident)
    one = fresh.groupBy("_id").agg(F.max_by(F.struct(*(c for c in fresh.columns if c != "_id")), "at").alias("_r")).select("_id", "_r.*")
    old = known.withColumn("_id", ident).join(one.select("_id"), "_id", "left_anti")
    return old.select(*known.columns).unionByName(one.select(*known.columns))


def coverage(entries: DataFrame) -> DataFrame:
    """One row: how many entries there are, where they come from, and for which facts may be shown."""
    provenance = F.coalesce("provenance", F.lit("curated"))
    has = lambda *c: F.count(F.when(shown(*c), 1))
    return entries.agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(provenance == "curated", 1)).alias("curated"), F.count(F.when(provenance == "looked_up", 1)).alias("looked_up"),
        F.count(F.when(F.coalesce(F.size("quarries"), F.lit(0)) > 0, 1)).alias("with_quarries"), has(F.col("price.sources"), F.col("price.confidence"), F.col("price.low"), F.col("price.high")).alias("with_price"),
        has(F.col("origin.sources"), F.col("origin.confidence"), F.col("origin.country")).alias("with_origin"), F.count(F.when(F.col("formation") == "engineered", 1)).alias("engineered"),
    )


def summaries(entries: DataFrame) -> DataFrame:
    """(key, origin_text, price_text, n_quarries, gaps): what may be said of each entry, and what is missing."""
    origin = shown(F.col("origin.sources"), F.col("origin.confidence"), F.col("origin.country"))
    price = shown(F.col("price.sources"), F.col("price.confidence"), F.col("price.low"), F.col("price.high"))
    quarries = F.filter(F.coalesce("quarries", F.array().cast(entries.schema["quarries"].dataType)), lambda q: (F.coalesce(F.size(q["sources"]), F.lit(0)) > 0) & (F.coalesce(q["name"], F.lit("")) != ""))
    gaps = F.array_compact(F.array(F.when(~origin, "origin"), F.when(~price, "price"), F.when(F.size(quarries) == 0, "quarries")))
    label = L.price_label(F.col("price.sources"), F.col("price.confidence"), F.col("price.low"), F.col("price.high"), F.col("price.currency"), F.col("price.basis"))
    return entries.select("key", F.when(origin, F.concat_ws(", ", F.nullif("origin.region", F.lit("")), F.nullif("origin.country", F.lit("")))).otherwise("").alias("origin_text"), label.alias("price_text"), F.size(quarries).alias("n_quarries"), gaps.alias("gaps"))


def with_care(products: DataFrame, care: DataFrame) -> DataFrame:
    """products (material_type) with what is known of their type's care (type, care), whatever the case; nothing where there is none."""
    return products.join(care.select(F.lower(F.trim("type")).alias("_t"), "care"), F.lower(F.trim(F.coalesce("material_type", F.lit("")))) == F.col("_t"), "left").drop("_t")


# --- places --------------------------------------------------------------------------------------


def _cities(cities: DataFrame) -> DataFrame:
    """(k, state, lat, lon, label, unsure) of each name, and of each name in a state: the largest; unsure where another of the name has a quarter of its people or more."""
    label = F.concat_ws(", ", "name", F.when(F.col("country") == "US", F.nullif("state", F.lit(""))).otherwise(F.col("country")))
    rows = cities.select(F.lower("name").alias("k"), F.upper(F.coalesce("state", F.lit(""))).alias("state"), F.col("population").alias("n"), "lat", "lon", label.alias("label"))
    by = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("n"), "lat", "lon")
    top = rows.withColumns({"_rn": F.row_number().over(by("k")), "_next": F.lead("n").over(by("k"))}).where("_rn = 1")
    named = top.select("k", F.lit("").alias("state"), "lat", "lon", "label", ((F.coalesce("_next", F.lit(0)) > 0) & (F.col("_next") * 4 > F.col("n"))).alias("unsure"))
    in_state = rows.where("state <> ''").withColumn("_rn", F.row_number().over(by("k", "state"))).where("_rn = 1").select("k", "state", "lat", "lon", "label", F.lit(False).alias("unsure"))
    return named.unionByName(in_state)


def zip_places(locations: DataFrame, zips: DataFrame) -> DataFrame:
    """(location, lat, lon, label, source) of locations that are a zip code of five digits, or with four more (zips: zip, lat, lon, label)."""
    code = F.regexp_extract(F.trim("location"), r"^(\d{5})(?:-\d{4})?$", 1)
    return locations.select("location", code.alias("zip")).where("zip <> ''").join(zips, "zip").select("location", "lat", "lon", "label", F.lit("zip").alias("source"))


def resolved(locations: DataFrame, overrides: DataFrame, zips: DataFrame, cities: DataFrame) -> DataFrame:
    """locations (location) with lat, lon, label and source: override, zip, state ("City, ST"), exact or ambiguous (the name of a city), parsed or ambiguous (part of the text), or null.

    Of parts between separators the longest is tried first, then runs of four words and less, from
    the left; none that is shorter than five letters. Distinct names are looked up once, by joins.
    """
    at = locations.select("location").distinct().where(F.trim(F.coalesce("location", F.lit(""))) != "").withColumn("raw", F.lower(F.trim("location")))
    by_hand = at.join(overrides.where("lat is not null and lon is not null").select(F.lower(F.trim("name")).alias("raw"), "lat", "lon", F.coalesce(F.nullif("label", F.lit("")), "name").alias("label")), "raw").select("location", F.struct(F.lit(0).alias("step"), F.lit(0).alias("nth"), F.lit(0).alias("i")).alias("rank"), F.lit("override").alias("source"), "lat", "lon", "label")
    by_zip = zip_places(at.select("location"), zips).select("location", F.struct(F.lit(1).alias("step"), F.lit(0).alias("nth"), F.lit(0).alias("i")).alias("rank"), "source", "lat", "lon", "label")
    state = F.upper(F.regexp_extract(F.trim("location"), r"^(.*?),\s*([A-Za-z]{2})\.?$", 2))
    one = lambda step, k, state, nth, i, kind: F.struct(F.lit(step).alias("step"), k.alias("k"), state.alias("state"), nth.alias("nth"), i.alias("i"), F.lit(kind).alias("kind"))
    none = F.lit(0)
    parts = F.filter(F.transform(F.split("raw", r"\s*[-–—/|]\s*|\s{2,}"), lambda p: F.trim(p)), lambda p: F.length(p) >= 5)
    words = F.filter(F.split("raw", "[^a-z]+"), lambda w: w != "")
    runs = F.flatten(F.transform(F.array(*map(F.lit, (4, 3, 2, 1))), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1)), lambda i: one(5, F.array_join(F.slice(words, i, n), " "), F.lit(""), -n, i, "parsed"))))
    tried = F.concat(
        F.array(one(2, F.lower(F.trim(F.regexp_extract(F.trim("location"), r"^(.*?),\s*([A-Za-z]{2})\.?$", 1))), state, none, none, "state"), one(3, F.col("raw"), F.lit(""), none, none, "exact")),
        F.transform(parts, lambda p, i: one(4, p, F.lit(""), -F.length(p), i, "parsed")),
        F.filter(runs, lambda x: F.length(x["k"]) >= 5),
    )
    asked = at.select("location", F.explode(tried).alias("t")).select("location", "t.*").where("k <> '' and (step <> 2 or state <> '')")
    met = asked.join(_cities(cities), ["k", "state"]).select("location", F.struct("step", "nth", "i").alias("rank"), F.when(F.col("unsure"), "ambiguous").otherwise(F.col("kind")).alias("source"), "lat", "lon", "label")
    best = by_hand.unionByName(by_zip).unionByName(met).groupBy("location").agg(F.min_by(F.struct("lat", "lon", "label", "source"), "rank").alias("b"))
    return locations.join(best, "location", "left").select(*locations.columns, "b.lat", "b.lon", "b.label", "b.source")


def all_resolved(known: DataFrame, locations: DataFrame, overrides: DataFrame, zips: DataFrame, cities: DataFrame, recheck: bool = False) -> DataFrame:
    """known (location, lat, lon, label, source) with all locations that aren't in it, those without an answer too, so that they aren't asked again; with recheck all are asked."""
    new = locations.select("location").where(F.coalesce("location", F.lit("")) != "").distinct()
    new = new if recheck else new.join(known.select("location"), "location", "left_anti")
    found = resolved(new, overrides, zips, cities)
    return known.join(found.select("location"), "location", "left_anti").unionByName(found.select(*known.columns))


def place_options(locations: DataFrame, geo: DataFrame) -> DataFrame:
    """(value, kind, members): what a place can be chosen by. Spellings that are equal to their city (geo: location, label, source) but for signs and case stand under it, unless it is ambiguous; all others stand for themselves."""
    at = locations.select("location").where(F.coalesce("location", F.lit("")) != "").distinct().join(geo.select("location", "label", "source").where("label is not null"), "location", "left")
    city = F.split_part("label", F.lit(","), F.lit(1))
    folds = (F.coalesce("label", F.lit("")) != "") & (F.coalesce("source", F.lit("")) != "ambiguous") & (norm(F.col("location")) == norm(city)) & (city != "")
    named = at.withColumn("kind", F.when(folds, "city").otherwise("yard")).withColumn("value", F.when(F.col("kind") == "city", F.col("label")).otherwise(F.col("location")))
    return named.groupBy("value", "kind").agg(F.array_sort(F.collect_list("location")).alias("members"))
