"""Free-text search over the catalog: a query in words becomes facets and terms, and those one plan."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import vocab
from ..operators import close, rollup
from ..sources import catalog_index, commits


@dataclass
class Asked:
    """What a query asks for."""

    material_type: str = ""
    color: str = ""
    thickness: str = ""
    form: str = ""
    terms: list[str] = field(default_factory=list)


@dataclass
class Filters:
    """What is chosen beside the words; a choice goes before what the words say. near: (latitude, longitude, miles)."""

    material_type: str = ""
    color: str = ""
    thickness: str = ""
    finish: str = ""
    supplier: str = ""
    locations: tuple[str, ...] = ()
    near: tuple[float, float, float] | None = None
    min_length: float = 0
    min_width: float = 0
    min_sqft: float = 0
    new_only: bool = False
    in_stock: bool = False


def parse(text: str) -> Asked:
    """Facets named in the query, and the words that are left."""
    out = Asked()
    if not text:
        return out
    left = text.lower().strip()
    for wrong, right in vocab.SPELLINGS.items():
        left = re.sub(rf"(?<![a-z]){re.escape(wrong)}(?![a-z])", right, left)
    left = f" {left} "
    if m := re.search(r"(\d+(?:\.\d+)?)\s*(cm|mm)\b", left):
        out.thickness = f"{float(m[1]) / (10 if m[2] == 'mm' else 1):g}cm"
        left = f"{left[: m.start()]} {left[m.end() :]}"

    def take(word: str) -> bool:
        nonlocal left
        m = re.search(rf"(?<![a-z]){re.escape(word)}s?(?![a-z])", left)
        if m:
            left = f"{left[: m.start()]} {left[m.end() :]}"
        return m is not None

    out.material_type = next((t for word, t in vocab.QUERY_TYPES if take(word)), "")
    out.color = next((c for c in vocab.COLORS if take(c)), "")
    out.form = next((form for word, form in vocab.FORMS.items() if take(word)), "")
    finishes = [word for word in vocab.QUERY_FINISHES if take(word)]
    words = [w for w in re.split("[^a-z0-9]+", left) if len(w) > 1 and w not in vocab.STOP]
    out.terms = list(dict.fromkeys(finishes + words))
    return out


#: Fixed value: a thickness in a query.
_SIZE = r"(\d+(?:\.\d+)?)\s*(cm|mm)\b"


def _taken(left: Column, words: list[tuple[str, str]], many: bool) -> Column:
    """(left, got): the text without the words that it names, one after the other, and their values; only the first of them unless many."""
    asked = F.array(*(F.struct(F.lit(rf"(?<![a-z])\Q{word}\Es?(?![a-z])").alias("p"), F.lit(value).alias("v")) for word, value in words))

    def step(acc: Column, w: Column) -> Column:
        hit = F.regexp_like(acc["left"], w["p"])
        hit = hit if many else (F.size(acc["got"]) == 0) & hit
        without = F.regexp_replace(acc["left"], F.concat(F.lit("(?s)^(.*?)"), w["p"]), F.lit("$1 "))
        return F.struct(F.when(hit, without).otherwise(acc["left"]).alias("left"), F.when(hit, F.array_append(acc["got"], w["v"])).otherwise(acc["got"]).alias("got"))

    return F.aggregate(asked, F.struct(left.alias("left"), F.array().cast("array<string>").alias("got")), step)


def asked(text: Column) -> Column:
    """(material_type, color, thickness, form, terms) of queries in words: parse, for a column."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^\s+|\s+$", "")
    for wrong, right in vocab.SPELLINGS.items():
        clean = F.regexp_replace(clean, rf"(?<![a-z]){re.escape(wrong)}(?![a-z])", right)

    def facets(clean: Column) -> Column:
        value, unit = (F.regexp_extract(clean, _SIZE, i) for i in (1, 2))
        thickness = F.when(value != "", F.concat(N.number(value.cast("double") / F.when(unit == "mm", 10).otherwise(1)), F.lit("cm"))).otherwise("")
        first = lambda got: F.coalesce(F.get(got, F.lit(0)), F.lit(""))
        left = F.regexp_replace(clean, f"(?s)^(.*?){_SIZE}", "$1 ")
        return N.let(_taken(left, list(vocab.QUERY_TYPES), False), lambda t: N.let(_taken(t["left"], [(c, c) for c in vocab.COLORS], False), lambda c: N.let(_taken(c["left"], list(vocab.FORMS.items()), False), lambda f: N.let(
            _taken(f["left"], [(w, w) for w in vocab.QUERY_FINISHES], True),
            lambda e: F.struct(first(t["got"]).alias("material_type"), first(c["got"]).alias("color"), thickness.alias("thickness"), first(f["got"]).alias("form"), F.array_distinct(F.concat(e["got"], _words(e["left"]))).alias("terms")),
        ))))

    return N.let(F.concat(F.lit(" "), clean, F.lit(" ")), facets)


def _words(left: Column) -> Column:
    return F.filter(F.split(left, "[^a-z0-9]+"), lambda w: (F.length(w) > 1) & ~w.isin(*vocab.STOP))


def color_word(color: str) -> str:
    """The last word of a colour, in one spelling."""
    return re.split(r"[\s-]", color.lower())[-1].replace("grey", "gray")


def has_color(color: str) -> Column:
    """Whether a listing's colour has the word or its name has it."""
    base = color_word(color)
    words = F.split(F.lower(F.regexp_replace(F.coalesce("color", F.lit("")), "(?i)grey", "gray")), r"[\s,/&-]+")
    return F.array_contains(words, base) | F.contains(F.regexp_replace(F.lower("item_name"), "grey", "gray"), F.lit(base))


def has_form(form: str) -> Column:
    """Slabs by their form; tiles and remnants also by their name."""
    by_form = F.contains(F.upper(F.coalesce("product_form", F.lit(""))), F.lit(form.upper()))
    return by_form if form == "slab" else by_form | F.contains(F.upper("item_name"), F.lit(form.upper()))


def has_terms(variants: list[list[str]]) -> Column:
    """Whether a name has one variant of each term."""
    name = F.lower("item_name")
    return reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, (F.contains(name, F.lit(v.lower())) for v in some)) for some in variants), F.lit(True))


def matching(materials: DataFrame, asked: Asked, chosen: Filters | None = None, suppliers: DataFrame | None = None) -> DataFrame:
    """The listings that the facets leave, whatever their names and places."""
    chosen = chosen or Filters()
    rows = materials
    kind = chosen.material_type or asked.material_type
    if kind:
        rows = rows.where(F.lower("material_type") == kind.lower())
    if kind != vocab.ACCESSORY:
        rows = rows.where(F.col("material_type") != vocab.ACCESSORY)
    if chosen.color:
        rows = rows.where(N.in_choice(F.col("color"), chosen.color))
    elif asked.color:
        rows = rows.where(has_color(asked.color))
    if thickness := chosen.thickness or asked.thickness:
        rows = rows.where(F.col("thickness") == thickness)
    if chosen.finish:
        rows = rows.where(F.col("finish") == chosen.finish)
    if chosen.supplier:
        named = suppliers.where((F.col("company") == chosen.supplier) | (F.col("host") == chosen.supplier)).select(F.col("id").alias("supplier_id"))
        rows = rows.join(named, "supplier_id", "left_semi")
    if chosen.min_length:
        rows = rows.where(F.col("avg_length") >= chosen.min_length)
    if chosen.min_width:
        rows = rows.where(F.col("avg_width") >= chosen.min_width)
    if chosen.new_only:
        rows = rows.where("new_arrival = 1")
    return rows.where(has_form(asked.form)) if asked.form else rows


def located(rows: DataFrame, suppliers: DataFrame) -> DataFrame:
    """rows with places: the names of an item's places (locations, comma-joined), else of its supplier's."""
    own = F.col("locations") if "locations" in rows.columns else F.lit("")
    theirs = suppliers.select(F.col("id").alias("supplier_id"), F.col("locations" if "locations" in suppliers.columns else "location").alias("_theirs"))
    text = F.coalesce(F.nullif(own, F.lit("")), F.nullif(F.col("_theirs"), F.lit("")))
    return rows.join(theirs, "supplier_id").withColumn("places", F.transform(F.split(text, ","), lambda p: F.lower(F.trim(p)))).drop("_theirs")


def placed(rows: DataFrame, chosen: Filters, geo: DataFrame | None) -> DataFrame:
    """Located rows that stand at a chosen place, and within reach, with miles to the nearest such place where that is asked for."""
    if chosen.locations:
        rows = rows.where(F.arrays_overlap("places", F.array(*(F.lit(p.lower()) for p in chosen.locations))))
    if not chosen.near or chosen.near[2] <= 0:
        return rows
    lat, lon, reach = chosen.near
    within = geo.where("lat is not null").select(F.lower(F.trim("location")).alias("_place"), N.miles(F.col("lat"), F.col("lon"), lat, lon).alias("_miles")).where(F.col("_miles") <= reach)
    sets = rows.select("places").distinct()  # places repeat much more than listings
    near = sets.select("places", F.explode(F.array_distinct("places")).alias("_place")).join(within, "_place").groupBy("places").agg(F.round(F.min("_miles"), 1).alias("miles"))
    return rows.join(near, "places")


def name_words(materials: DataFrame) -> DataFrame:
    """(w): the distinct words of names that are longer than three letters and no numbers."""
    words = materials.select("item_name").distinct().select(F.explode(F.split(F.upper("item_name"), "[^A-Z0-9]+")).alias("w"))
    return words.where((F.length("w") > 3) & ~F.col("w").rlike("^[0-9]+$")).distinct()


def close_words(materials: DataFrame, terms: list[str], cutoff: float = 0.82, most: int = 4) -> DataFrame:
    """(term, w, ratio, rank): for each misspelt term the words of names that share the most characters with it."""
    asked = materials.sparkSession.createDataFrame([(t.upper(),) for t in terms], "term string")
    return close.closest(close.close_pairs(asked, name_words(materials), cutoff), most)


@dataclass
class Found:
    """products: the page; total: products in all; fuzzy: words taken for misspelt ones; unlocated: (suppliers, products) that match but for their place, which nobody knows; way: rollup, tokens or live."""

    products: DataFrame
    total: int
    fuzzy: list[str]
    unlocated: tuple[int, int]
    way: str = "live"


def by_product(chosen: Filters) -> bool:
    """Whether the filters hold for whole products, so that stored sums of them can answer."""
    return not (chosen.color or chosen.thickness or chosen.finish or chosen.supplier or chosen.locations or (chosen.near and chosen.near[2] > 0) or chosen.min_length or chosen.min_width or chosen.new_only)


def search(
    materials: DataFrame, suppliers: DataFrame, text: str, chosen: Filters | None = None, geo: DataFrame | None = None, sort: str = "relevance", size: int = 30, number: int = 1, few: int = 5
) -> Found:
    """A page of products for a query in words. Where fewer than `few` products match, terms also match words that are spelt much like them, if that finds more."""
    asked, chosen = parse(text), chosen or Filters()
    rows = located(matching(materials, asked, chosen, suppliers), suppliers)
    by_place = bool(chosen.locations or (chosen.near and chosen.near[2] > 0))

    def products(variants: list[list[str]]) -> DataFrame:
        kept = placed(rows.where(has_terms(variants)), chosen, geo)
        made = rollup.product_rollup(kept, suppliers)
        if "miles" in kept.columns:
            made = made.join(kept.groupBy(rollup.group_key().alias("grp")).agg(F.min("miles").alias("miles")), "grp")
        return rollup.in_stock(made, chosen.min_sqft or None) if chosen.in_stock or chosen.min_sqft else made

    variants = [[t] for t in asked.terms]
    found, fuzzy = products(variants), []
    total = found.count()
    if total < few and asked.terms:
        close = close_words(materials, asked.terms).collect()  # four words for each term at most
        wider = [[t, *(r["w"] for r in close if r["term"] == t.upper() and r["w"] != t.upper())] for t in asked.terms]
        if any(len(v) > 1 for v in wider):
            more = products(wider)
            if (n := more.count()) > total:
                found, total, variants = more, n, wider
                fuzzy = sorted({w for v in wider for w in v[1:]})
    lost = (0, 0)
    if by_place:
        r = rows.where(has_terms(variants)).where(F.coalesce(F.size("places"), F.lit(0)) < 1).agg(F.count_distinct("supplier_id"), F.count_distinct(rollup.group_key())).first()
        lost = (r[0], r[1])
    return Found(rollup.page(found, sort, size, number), total, fuzzy, lost)


def search_stored(
    spark: SparkSession, path: str, materials: DataFrame, suppliers: DataFrame, text: str, chosen: Filters | None = None, geo: DataFrame | None = None, sort: str = "relevance", size: int = 30, number: int = 1, few: int = 5
) -> Found:
    """search, answered from the stored rollup where nothing is asked for in words, and through the index of tokens where only names are; live where listings are filtered, where the index finds fewer than `few` products, or where nothing is stored."""
    asked, chosen = parse(text), chosen or Filters()
    version, now = commits.manifest(spark, path)
    stored = now.get("tables", {})
    live = lambda: search(materials, suppliers, text, chosen, geo, sort, size, number, few)
    if not by_product(chosen) or not stored.get("rollup", {}).get("folders"):
        return live()
    kind = chosen.material_type or asked.material_type
    products = commits.table(spark, path, "rollup", version)
    products = products.where(F.lower("material_type") == kind.lower()) if kind else products
    products = products.where(F.col("material_type") != vocab.ACCESSORY) if kind != vocab.ACCESSORY else products
    if chosen.in_stock or chosen.min_sqft:
        products = rollup.in_stock(products, chosen.min_sqft or None)
    if not (text or "").strip():
        return Found(rollup.page(products, sort, size, number), products.count(), [], (0, 0), "rollup")
    prefixes = [p for p in (re.sub("[^a-z0-9]", "", t.lower()) for t in asked.terms) if p]
    if not prefixes or asked.color or asked.thickness or asked.form or not stored.get("postings", {}).get("folders"):
        return live()
    named = products.join(catalog_index.with_prefixes(commits.table(spark, path, "postings", version), prefixes), "grp", "left_semi")
    total = named.count()
    return Found(rollup.page(named, sort, size, number), total, [], (0, 0), "tokens") if total >= few else live()


def chips(chosen: Filters) -> list[tuple[str, str]]:
    """(name, value) of the filters in effect, in order, for display."""
    shown = []
    for name, value in vars(chosen).items():
        if name == "near":
            shown += [("near", f"within {value[2]:g} mi")] if value and value[2] > 0 else []
        elif value:
            shown.append((name, ", ".join(value) if isinstance(value, tuple) else "yes" if value is True else f"{value:g}" if isinstance(value, int | float) else value))
    return shown


def page_window(number: int, pages: int, around: int = 2) -> list[int]:
    """The pages to link to: those around the present one."""
    return list(range(max(1, number - around), min(pages, number + around) + 1))


def pages_around(number: Column, pages: Column, around: int = 2) -> Column:
    """The same for columns: the pages to link to beside each present one."""
    return F.sequence(F.greatest(F.lit(1), number - around), F.least(pages, number + around))
