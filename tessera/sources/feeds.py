"""Feeds as they have landed: products in pages, hosts in texts, rows that repeat."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import normalize as N
from ..functions import vocab
from .staging import staged

_PRODUCT = "struct<`@type`:string,name:string,sku:string,image:string,category:string,offers:string>"
_BLOCK = r'(?is)<script[^>]*type=["\']application/ld\+json["\'][^>]*>(.*?)</script>'


def offer_price(offers: Column) -> Column:
    """The first price in offers (JSON text), as $x; '' without one."""
    paths = ("$.price", "$[0].price", "$.priceSpecification.price", "$.priceSpecification[0].price", "$.priceSpecification.0.price", "$[0].priceSpecification.price", "$[0].priceSpecification[0].price")
    found = F.coalesce(*(F.nullif(F.get_json_object(offers, p), F.lit("")) for p in paths))
    return F.coalesce(F.concat(F.lit("$"), found), F.lit(""))


def products(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) with one row for each product in their linked data: name, sku, category, image and price. Blocks that can't be read are left out."""
    blocks = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(_BLOCK), F.lit(1))).alias("block"))
    block = F.trim("block")
    graph = F.from_json(block, f"struct<`@graph`:array<{_PRODUCT}>>")["@graph"]
    several = F.when(block.startswith("["), F.from_json(block, f"array<{_PRODUCT}>"))
    one = F.array(F.from_json(block, _PRODUCT))
    rows = blocks.select("page_id", F.explode(F.coalesce(several, graph, one)).alias("p")).where(F.lower("p.@type").contains("product"))
    return rows.select("page_id", "p.name", "p.sku", "p.category", "p.image", offer_price(F.col("p.offers")).alias("price"))


def hosts_of(texts: DataFrame, base: str, infra: tuple[str, ...]) -> DataFrame:
    """(source, host): hosts under base in texts (source, text) that end where they are named, without infrastructure."""
    pattern = rf"([a-z0-9][a-z0-9-]*\.{re.escape(base)})(?![a-z0-9.-])"
    hosts = texts.select("source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(1))).alias("host"))
    label = F.split_part("host", F.lit("."), F.lit(1))
    none = F.exists(F.array(*map(F.lit, infra)), lambda s: (label == s) | label.startswith(F.concat(s, F.lit("-")))) if infra else F.lit(False)
    return hosts.where(~none)


def hosts_in(texts: DataFrame, base: str, infra: tuple[str, ...]) -> DataFrame:
    """(host, source): the hosts of texts, each with the first source that names it."""
    return hosts_of(texts, base, infra).groupBy("host").agg(F.min("source").alias("source"))


def hosts_by_source(texts: DataFrame, base: str, infra: tuple[str, ...]) -> DataFrame:
    """(source, hosts, new) of texts (rank, source, text): how many hosts each index names, and how many that none of a smaller rank does. Texts are read alike whatever their form."""
    ranked = texts.select(F.struct("rank", "source").alias("source"), "text")
    each = ranked.select("source").distinct()
    named = hosts_of(ranked, base, infra).distinct()
    first = named.groupBy("host").agg(F.min("source").alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("new"))
    counts = each.join(named.groupBy("source").agg(F.count(F.lit(1)).alias("hosts")), "source", "left").join(first, "source", "left")
    return counts.select("source.source", F.coalesce("hosts", F.lit(0)).alias("hosts"), F.coalesce("new", F.lit(0)).alias("new"))


def new_hosts(found: DataFrame, known: DataFrame, denied: DataFrame, test_labels: tuple[str, ...] = ("test", "staging", "demo", "dev")) -> DataFrame:
    """Hosts found that are neither known, denied (or under a denied domain) nor test tenants."""
    dots = F.size(F.split("host", r"\."))
    under = found.select("host", F.explode(F.transform(F.sequence(F.lit(1), dots), lambda i: F.array_join(F.slice(F.split("host", r"\."), i, dots), "."))).alias("domain"))
    refused = under.join(denied.select("domain"), "domain", "left_semi").select("host").distinct()
    test = F.split_part("host", F.lit("."), F.lit(1)).rlike("^(?:" + "|".join(test_labels) + ")(?:-|$)")
    return found.join(known.select("host"), "host", "left_anti").join(refused, "host", "left_anti").where(~test)


def one_per_name(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Feeds that repeat an item for each slab: the first row by order of each name, whatever its case."""
    keyed = rows.withColumn("_k", F.upper(F.trim(name))).where("_k <> ''")
    return keyed.groupBy("_k").agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def form_in_name(name: Column) -> Column:
    n = F.lower(F.coalesce(name, F.lit("")))
    return F.when(n.contains("slab"), "SLAB").when(n.contains("mosaic"), "MOSAIC").when(n.contains("tile"), "TILE").otherwise("")


def metres_to_inches(value: Column) -> Column:
    return F.when(value > 0, F.round(value * 39.3701, 1))


def expanded_sitemaps(maps: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """(url, depth): the distinct pages that landed sitemaps (url, body) lead to from roots (url), each with the fewest maps of maps before it.

    A map that names other maps (addresses that end in .xml) leads to those only, else to pages. Each
    level is one join of its frontier with the maps; maps that an earlier level had aren't read
    again, so that cycles end, and none is followed more than `depth` levels below a root.
    """
    names = F.regexp_extract_all("body", F.lit(vocab.SITEMAP_LOC), F.lit(1))
    listed = maps.groupBy("url").agg(F.min("body").alias("body")).select("url", F.array_distinct(names).alias("locs"))
    listed = listed.select("url", "locs", F.filter("locs", lambda u: F.lower(u).endswith(".xml")).alias("maps"))
    frontier = staged(roots.select("url").distinct(), "frontier")
    seen, pages = frontier, None
    for level in range(depth + 1):
        read = staged(frontier.join(listed, "url"), "sitemaps")
        found = read.where(F.size("maps") == 0).select(F.explode("locs").alias("url"), F.lit(level).alias("depth"))
        pages = found if pages is None else pages.unionByName(found)
        after = staged(read.select(F.explode("maps").alias("url")).distinct().join(seen, "url", "left_anti"), "frontier")
        if level == depth or after.limit(1).count() == 0:
            break
        frontier, seen = after, seen.unionByName(after)
    return pages.groupBy("url").agg(F.min("depth").alias("depth"))


# --- the formats of single providers ------------------------------------------------------------


def umi(branches: DataFrame, lots: DataFrame) -> DataFrame:
    """Materials of branches (rank, branch, json: a list, or a list in a list, with item, MaterialName, GroupName, newArrival, url) and lots (item, Qty, length, wide): the first branch that lists an item has it; sizes are means of its slabs."""
    kind = "struct<item:string,MaterialName:string,GroupName:string,newArrival:boolean,url:string>"
    text = F.regexp_replace(F.regexp_replace("json", "^﻿", ""), r"^\s*\[\s*\[|\]\s*\]\s*$", "")
    nested = F.col("json").rlike("^﻿?\\s*\\[\\s*\\[")
    rows = branches.select("rank", "branch", F.posexplode(F.from_json(F.when(nested, F.concat(F.lit("["), text, F.lit("]"))).otherwise(text), f"array<{kind}>")).alias("at", "m"))
    named = rows.select("rank", "at", "branch", F.trim("m.item").alias("item_id"), F.trim("m.MaterialName").alias("item_name"), F.trim("m.GroupName").alias("group"), "m.newArrival", F.trim("m.url").alias("image_url")).where("item_id <> ''")
    first = named.groupBy("item_id").agg(F.min_by(F.struct("branch", "item_name", "group", "newArrival", "image_url"), F.struct("rank", "at")).alias("m")).select("item_id", "m.*").where("item_name <> ''")
    sizes = lots.groupBy(F.col("item").alias("item_id")).agg(F.sum("Qty").alias("available_slabs"), *(F.round(F.avg(F.when((F.col("length") > 0) & (F.col("wide") > 0), F.col(c))), 1).alias(n) for c, n in (("length", "avg_length"), ("wide", "avg_width"))))
    hint = F.regexp_extract("group", vocab.GROUP_TYPES, 1)
    return first.join(sizes, "item_id", "left").select(
        "item_id", "branch", "item_name", F.when(hint != "", hint).otherwise(F.col("group")).alias("category"), form_of_group(F.col("group")).alias("product_form"),
        F.coalesce("available_slabs", F.lit(0)).alias("available_slabs"), "avg_length", "avg_width", F.coalesce(F.col("newArrival").cast("int"), F.lit(0)).alias("new_arrival"), "image_url",
    )


def form_of_group(group: Column) -> Column:
    g = F.lower(F.coalesce(group, F.lit("")))
    return F.when(g.contains("remnant"), "REMNANT").when(g.contains("tile"), "TILE").otherwise("SLAB")


def composition(raw: Column) -> Column:
    """The first of the parts that slashes separate."""
    return F.trim(F.split_part(F.coalesce(raw, F.lit("")), F.lit("/"), F.lit(1)))


def shown_price(raw: Column) -> Column:
    """A price, but '' where a feed asks to call or to log in for it."""
    p = F.trim(F.coalesce(raw, F.lit("")))
    return F.when((F.upper(p) == "CALL") | F.contains(F.lower(p), F.lit("login")), "").otherwise(p)


def slabware(pages: DataFrame) -> DataFrame:
    """Bundles of pages (host, json: a list in `Bundles`, as text or not) as materials; a bundle that two pages have counts once."""
    kind = "array<struct<id:string,nomeMaterial:string,nomeComposicao:string,acabamento:string,nomeEspessura:string,qtdChapas:string,averageSize:string,bloco:string,preco1:string,fotoPrincipal:string>>"
    b = pages.select("host", F.explode(F.from_json(F.get_json_object("json", "$.Bundles"), kind)).alias("b")).select("host", "b.*").where("trim(nomeMaterial) <> ''")
    b = b.groupBy("host", "id").agg(F.min(F.struct(*(c for c in b.columns if c not in ("host", "id")))).alias("b")).select("host", "id", "b.*")
    size = lambda i: F.regexp_extract(F.coalesce("averageSize", F.lit("")), vocab.SLAB_SIZE, i).try_cast("double")
    return b.select(
        "host", F.col("id").alias("item_id"), F.trim("nomeMaterial").alias("item_name"), composition(F.col("nomeComposicao")).alias("category"), F.col("acabamento").alias("finish"),
        F.replace("nomeEspessura", F.lit(" "), F.lit("")).alias("thickness"), F.coalesce(F.col("qtdChapas").try_cast("long"), F.lit(0)).alias("available_slabs"), size(1).alias("avg_length"), size(2).alias("avg_width"),
        shown_price(F.col("preco1")).alias("price_range"),
    )


def sixteenths_to_cm(value: Column) -> Column:
    """A thickness in sixteenths of an inch as text in centimetres, to the next half; halves between two go to the even one."""
    n = value.try_cast("double")
    return F.when(F.coalesce(n, F.lit(0.0)) != 0, F.concat(F.regexp_replace((F.bround(n / 16 * 2.54 * 2, 0) / 2).cast("string"), r"\.0$", ""), F.lit("cm"))).otherwise("")


def stonetrash(listings: DataFrame) -> DataFrame:
    """Materials of listings (id, json with title, status, qtyUnitsAvailable, materials_Tags, dimensions, pricePerSqFt_USD); what isn't for sale has no slabs."""
    at = lambda path: F.get_json_object("json", f"$.{path}")
    tags = F.from_json(at("materials_Tags"), "array<string>")
    price = at("pricePerSqFt_USD").try_cast("double")
    return listings.where(F.trim(F.coalesce(at("title"), F.lit(""))) != "").select(
        F.col("id").cast("string").alias("item_id"), at("title").alias("item_name"), F.coalesce(F.get(tags, F.lit(0)), at("category.segment"), F.lit("")).alias("category"),
        sixteenths_to_cm(at("dimensionThickness_SixteenthInches")).alias("thickness"), F.coalesce(at("format_Tag"), F.lit("SLAB")).alias("product_form"),
        F.when(at("status") == "ListedForSale", F.coalesce(at("qtyUnitsAvailable").try_cast("long"), F.lit(0))).otherwise(0).alias("available_slabs"),
        F.when(F.coalesce(price, F.lit(0.0)) != 0, F.concat(F.lit("$"), N.number(price), F.lit("/sf"))).otherwise("").alias("price_range"),
    )


def sitemap_ids(maps: DataFrame) -> DataFrame:
    """(id): the distinct ids of listings in sitemaps (xml)."""
    return maps.select(F.explode(F.regexp_extract_all("xml", F.lit(vocab.LISTING_ID), F.lit(1))).alias("id")).distinct()


def unbuilt(pages: DataFrame) -> DataFrame:
    """Materials of pages (rank, json with data): those whose category is of slabs, the first page that has an item counts."""
    kind = "array<struct<id:string,title:string,brand:string,canonicalColor:string,category_path:string,quantity:long,price:string,dimensions:struct<height_thickness:string,length_depth:double,width_diameter:double>,location:struct<city:string,state:string>>>"
    rows = pages.select("rank", F.posexplode(F.from_json(F.get_json_object("json", "$.data"), kind)).alias("at", "d")).select("rank", "at", "d.*")
    kept = rows.where("coalesce(id, '') <> ''").where(F.contains(F.lower(F.coalesce("category_path", F.lit(""))), F.lit("slab")))
    one = kept.groupBy("id").agg(F.min_by(F.struct(*(c for c in kept.columns if c not in ("id", "rank", "at"))), F.struct("rank", "at")).alias("d")).select("id", "d.*")
    return one.select(
        F.col("id").alias("item_id"), F.coalesce(F.nullif("title", F.lit("")), F.trim(F.concat_ws(" ", "brand", "canonicalColor"))).alias("item_name"), F.coalesce("brand", F.lit("")).alias("category"),
        N.thickness(F.concat(F.col("dimensions.height_thickness"), F.lit(" in")), F.lit(""), F.lit("")).alias("thickness"), F.coalesce(F.nullif("quantity", F.lit(0)), F.lit(1)).alias("available_slabs"),
        F.concat_ws(", ", F.nullif("location.city", F.lit("")), F.nullif("location.state", F.lit(""))).alias("origin"), L.whole_price(F.col("price")).alias("price_range"),
    )


def iblocky(pages: DataFrame) -> DataFrame:
    """Materials of pages (form, json with commesse): active ones, each once, types and origins in our words, sizes from centimetres."""
    kind = "array<struct<id:string,material:string,petroDesc:string,origin:string,isActive:boolean,code:string,stats:struct<dimensions:string,finishes:array<string>,thickness:array<string>,availableSlabs:long>>>"
    rows = pages.select("form", F.explode(F.from_json(F.get_json_object("json", "$.commesse"), kind)).alias("c")).select("form", "c.*")
    kept = rows.where(F.coalesce("isActive", F.lit(True)) & (F.trim(F.coalesce("material", F.lit(""))) != "") & (F.coalesce("id", F.lit("")) != ""))
    one = kept.groupBy("id").agg(F.min_by(F.struct(*(c for c in kept.columns if c != "id")), F.struct("form", "code")).alias("c")).select("id", "c.*")
    word = F.lower(F.trim(F.coalesce("petroDesc", F.lit(""))))
    lookup = lambda table, c: F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c)
    side = lambda i: F.nullif(F.replace(F.regexp_extract(F.coalesce("stats.dimensions", F.lit("")), r"^\s*(\d+(?:[.,]\d+)?)\s*[xX×]\s*(\d+(?:[.,]\d+)?)", i), F.lit(","), F.lit(".")), F.lit("")).try_cast("double")
    inches = lambda c: F.when(c > 0, F.round(c / 2.54, 1))
    return one.select(
        F.col("id").alias("item_id"), F.trim("material").alias("item_name"),
        F.when((word == "") | word.isin(*vocab.FEED_NO_TYPE), "").otherwise(F.coalesce(lookup(vocab.FEED_TYPES, word), F.trim("petroDesc"))).alias("category"),
        F.coalesce(lookup(vocab.FEED_ORIGINS, F.lower(F.trim(F.coalesce("origin", F.lit(""))))), F.lit("")).alias("origin"), F.col("form").alias("product_form"),
        F.coalesce(F.get("stats.finishes", F.lit(0)), F.lit("")).alias("finish"), F.coalesce(F.get("stats.thickness", F.lit(0)), F.lit("")).alias("thickness"),
        F.coalesce("stats.availableSlabs", F.lit(0)).alias("available_slabs"), inches(side(1)).alias("avg_length"), inches(side(2)).alias("avg_width"),
    )


#: The reader of each provider's landed feed by its name in the registry.
PROVIDERS = {"umi": umi, "slabware": slabware, "stonetrash": stonetrash, "slabcloud": one_per_name, "unbuilt": unbuilt, "genericfeed": products, "iblocky": iblocky}


def provider(name: str | None):
    """The reader of a provider; without a name the main connector's rows need none. Names that nobody knows are an error."""
    key = (name or "stoneprofits").strip().lower()
    if key != "stoneprofits" and key not in PROVIDERS:
        raise KeyError(f"unknown provider {name!r}; known: {sorted([*PROVIDERS, 'stoneprofits'])}")
    return PROVIDERS.get(key)
