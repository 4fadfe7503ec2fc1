"""The catalog's queries over the fixture tables, and the same in SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import normalize as N
from .operators import entity, facts, history, ledger, matching, photos, policy, rollup, status
from .plans import nightly, pages, search
from .sources import fixture
from .sources.fixture import PREFIX
from .sources.staging import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of (materials, suppliers, spark, sf_dir) with its SQL, which follows PREFIX."""

    def wrap(f: Callable) -> Callable:
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(fixture.materials(spark, sf_dir), fixture.suppliers(spark, sf_dir), spark, sf_dir)
        if sql:
            ORACLE_SQL[name] = sql.removeprefix("RAW ") if sql.startswith("RAW ") else PREFIX + sql
        return f

    return wrap


# --- product rollup ----------------------------------------------------------------------------

TILE = "upper(coalesce(product_form, '')) LIKE '%TILE%'"
SLABS = f"CASE WHEN {TILE} THEN 0 ELSE coalesce(available_slabs, 0) END"
INNER = f""", inner_ AS (SELECT material_key AS grp, supplier_id, min(id) AS id, max(material_key) AS material_key, min(item_name) AS item_name, max(material_type) AS material_type,
  max(color) AS color, max(new_arrival) AS new_arrival, max(avg_length) AS avg_length, max(avg_width) AS avg_width, sum({SLABS}) AS sup_slabs,
  sum(CASE WHEN {TILE} AND uom = 'SF' THEN available_slabs ELSE 0 END) AS sup_tile_sf, max(CASE WHEN {TILE} THEN 1 ELSE 0 END) AS sup_has_tile,
  sum({SLABS} * avg_length * avg_width) / 144.0 AS sup_sqft, max(CASE WHEN image_url <> '' AND image_url NOT LIKE '%slabcloud.com/slabs/%' THEN image_url END) AS real_img, max(image_url) AS any_img
  FROM materials GROUP BY material_key, supplier_id),
rollup_ AS (SELECT grp, min(id) AS id, max(material_key) AS material_key, min(item_name) AS item_name, max(material_type) AS material_type, max(color) AS color, max(new_arrival) AS new_arrival,
  count(*) AS suppliers, CAST(max(sup_slabs) AS BIGINT) AS available_slabs, CAST(sum(sup_slabs) AS BIGINT) AS total_slabs, CAST(sum(sup_tile_sf) AS BIGINT) AS tile_sf, max(sup_has_tile) AS has_tile,
  max(avg_length) AS avg_length, max(avg_width) AS avg_width, round(max(sup_sqft), 4) AS total_sqft, coalesce(max(real_img), max(any_img)) AS image_url FROM inner_ GROUP BY grp)
"""


@query(INNER + "SELECT * FROM rollup_")
def a1_product_rollup(m, s, spark, sf):
    return rollup.product_rollup(m, s)


@query(INNER + "SELECT grp, suppliers, available_slabs, total_sqft FROM rollup_ ORDER BY suppliers DESC, available_slabs DESC, material_key, grp LIMIT 20")
def t1_top_products(m, s, spark, sf):
    return rollup.page(rollup.product_totals(m, s), "relevance", 20).select("grp", "suppliers", "available_slabs", "total_sqft")


@query(INNER + """, o AS (SELECT grp, 'slabs' AS sort, row_number() OVER (ORDER BY available_slabs DESC, material_key, grp) AS nth FROM rollup_ UNION ALL SELECT grp, 'size', row_number() OVER (ORDER BY avg_length DESC, material_key, grp) FROM rollup_
UNION ALL SELECT grp, 'new', row_number() OVER (ORDER BY new_arrival DESC, material_key, grp) FROM rollup_ UNION ALL SELECT grp, 'area', row_number() OVER (ORDER BY total_sqft DESC, material_key, grp) FROM rollup_
UNION ALL SELECT grp, 'distance', row_number() OVER (ORDER BY suppliers DESC, available_slabs DESC, material_key, grp) FROM rollup_) SELECT sort, grp FROM o WHERE nth <= 25""")
def t3_first_page_by_each_order(m, s, spark, sf):
    made = staged(rollup.product_totals(m, s), "totals")  # read once for all orders; distance without an origin is by relevance
    return reduce(DataFrame.unionByName, (rollup.page(made, sort, 25).select(F.lit(sort).alias("sort"), "grp") for sort in ("slabs", "size", "new", "area", "distance")))


@query(INNER + "SELECT grp, total_sqft FROM rollup_ ORDER BY total_sqft DESC, grp LIMIT 30 OFFSET 30")
def t2_second_page_by_area(m, s, spark, sf):
    return rollup.page(rollup.product_totals(m, s), "area", 30, 2).select("grp", "total_sqft")


@query(INNER + "SELECT grp, available_slabs, total_sqft FROM rollup_ WHERE (available_slabs > 0 OR has_tile = 1) AND total_sqft >= 9000")
def f13_one_supplier_holds_area(m, s, spark, sf):
    return rollup.in_stock(rollup.product_totals(m, s), 9000).select("grp", "available_slabs", "total_sqft")


@query("SELECT material_key, supplier_id, CAST(sum(available_slabs) AS BIGINT) AS tile_sf FROM materials WHERE product_form = 'Tile' AND uom = 'SF' GROUP BY material_key, supplier_id")
def a3_tile_area(m, s, spark, sf):
    return m.where(rollup.is_tile() & (F.col("uom") == "SF")).groupBy("material_key", "supplier_id").agg(F.sum("available_slabs").alias("tile_sf"))


_COLLAPSE = f""", r AS (SELECT *, {TILE} AS tile, coalesce(idone, '') <> '' AS named FROM materials),
w AS (SELECT *, count(*) OVER i AS n, CAST(sum(CAST(named AS INT)) OVER i AS BIGINT) AS idents, max(available_slabs) OVER i AS most,
  row_number() OVER (PARTITION BY supplier_id, item_id, tile ORDER BY CASE WHEN named AND avg_length > 0 THEN 0 WHEN named THEN 1 WHEN avg_length > 0 THEN 2 ELSE 3 END, available_slabs DESC, id) AS rn
  FROM r WINDOW i AS (PARTITION BY supplier_id, item_id, tile))
SELECT id, supplier_id, item_id, CAST(CASE WHEN tile OR n = 1 THEN available_slabs WHEN rn > 1 THEN 0 WHEN idents > 0 THEN idents ELSE most END AS BIGINT) AS available_slabs FROM w"""


@query(_COLLAPSE)
def w3_collapse_counts(m, s, spark, sf):
    return rollup.collapse_counts(m).select("id", "supplier_id", "item_id", "available_slabs")


# --- filters -----------------------------------------------------------------------------------


def _totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("material_key").agg(F.count(F.lit(1)).alias("n"), F.sum("available_slabs").alias("slabs"))


_TOTALS = "SELECT material_key, count(*) AS n, CAST(sum(available_slabs) AS BIGINT) AS slabs FROM materials"
_BY = " GROUP BY material_key"


@query(_TOTALS + " WHERE material_type = 'PROMO' AND thickness = '3cm'" + _BY)
def f1_facets(m, s, spark, sf):
    return _totals(m.where((F.col("material_type") == "PROMO") & (F.col("thickness") == "3cm")))


@query(_TOTALS + " WHERE material_type <> 'ECONOMY'" + _BY)
def f2_excluded_bucket(m, s, spark, sf):
    return _totals(m.where(F.col("material_type") != "ECONOMY"))


_COLORS = ", z AS (SELECT * REPLACE (CASE WHEN base LIKE 'hot %' THEN 'Rainforest' WHEN base LIKE 'old %' THEN 'Golden Sand' ELSE color END AS color) FROM materials)"


def _colored(m: DataFrame) -> DataFrame:
    return m.withColumn("color", F.when(F.col("base").startswith("hot "), "Rainforest").when(F.col("base").startswith("old "), "Golden Sand").otherwise(F.col("color")))


@query(_COLORS + """, p AS (SELECT 'Gray' AS choice, * FROM z WHERE color = 'Gray, White' UNION ALL SELECT 'Other', * FROM z WHERE color = 'Rainforest' UNION ALL SELECT 'Dark Navy Blue', * FROM z WHERE color = 'Navy Blue' UNION ALL SELECT 'Rainforest', * FROM z WHERE color = 'Rainforest')
SELECT choice, material_key, count(*) AS n FROM p GROUP BY 1, 2""")
def f3_color_family(m, s, spark, sf):
    """A family, the rest, a raw value that widens to its family, and one that has none."""
    return rollup.by_choice(_colored(m), ["Gray", "Other", "Dark Navy Blue", "Rainforest"])


@query(_TOTALS + " WHERE list_contains(string_split_regex(lower(color), '[\\s,/&-]+'), 'blue') OR contains(upper(item_name), 'BLUE')" + _BY)
def f4_color_word_or_name(m, s, spark, sf):
    return _totals(m.where(F.array_contains(F.split(F.lower("color"), r"[\s,/&-]+"), "blue") | F.upper("item_name").contains("BLUE")))


@query(_TOTALS + " JOIN suppliers s ON s.id = supplier_id WHERE coalesce(nullif(company, ''), host) IN ('Supplier#000000003', 'supplier-000000007.example.com')" + _BY)
def f5_supplier_by_company_or_host(m, s, spark, sf):
    named = s.where(F.coalesce(F.nullif("company", F.lit("")), "host").isin("Supplier#000000003", "supplier-000000007.example.com"))
    return _totals(m.join(named.select(F.col("id").alias("supplier_id")), "supplier_id", "left_semi"))


@query(_TOTALS + " WHERE avg_length >= 90 AND avg_width >= 60" + _BY)
def f6_minimum_size(m, s, spark, sf):
    return _totals(m.where("avg_length >= 90 and avg_width >= 60"))


@query(_TOTALS + " WHERE new_arrival = 1" + _BY)
def f7_new_arrivals(m, s, spark, sf):
    return _totals(m.where("new_arrival = 1"))


@query(", z AS (SELECT m.*, CASE WHEN m.id % 3 = 0 THEN 'Yard 7,nation_11' WHEN m.id % 3 = 1 THEN '' ELSE 'elsewhere' END AS own, s.location AS theirs FROM materials m JOIN suppliers s ON s.id = supplier_id) SELECT material_key, count(*) AS n FROM z WHERE CASE WHEN own = '' THEN theirs IN ('NATION_3', 'NATION_11') ELSE id % 3 = 0 END GROUP BY 1")
def f8_locations(m, s, spark, sf):
    """An item's own places, else its supplier's; whole names, whatever their case."""
    own = m.withColumn("locations", F.when(F.col("id") % 3 == 0, "Yard 7, nation_11").when(F.col("id") % 3 == 1, "").otherwise("elsewhere"))
    rows = search.placed(search.located(own, s), search.Filters(locations=("Nation_3", "NATION_11", "nation")), None)
    return rows.groupBy("material_key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'slab' AS form, count(*) AS n FROM materials WHERE upper(product_form) LIKE '%SLAB%' UNION ALL SELECT 'tile', count(*) FROM materials WHERE product_form = 'Tile' OR base LIKE 'red %' UNION ALL SELECT 'remnant', count(*) FROM materials WHERE product_form = 'Remnant'")
def f10_product_form(m, s, spark, sf):
    """Slabs by their form only; tiles and remnants also by name."""
    rows = m.withColumn("item_name", F.when(F.col("base").startswith("red "), F.concat("item_name", F.lit(" slab Tile"))).otherwise(F.col("item_name")))
    return rows.agg(*(F.count(F.when(search.has_form(f), 1)).alias(f) for f in ("slab", "tile", "remnant"))).unpivot([], ["slab", "tile", "remnant"], "form", "n")


@query(_TOTALS + " WHERE (item_name LIKE '%bolt%' OR item_name LIKE '%rod%') AND item_name LIKE '%red%'" + _BY)
def f11_name_terms(m, s, spark, sf):
    return _totals(m.where((F.col("item_name").contains("bolt") | F.col("item_name").contains("rod")) & F.col("item_name").contains("red")))


@query("SELECT DISTINCT material_key FROM materials WHERE len(list_filter(string_split(lower(item_name), ' '), lambda w: starts_with(w, 'wid'))) > 0 AND len(list_filter(string_split(lower(item_name), ' '), lambda w: starts_with(w, 're'))) > 0")
def f12_token_prefixes(m, s, spark, sf):
    tokens = m.select("material_key", F.explode(F.split(F.lower("item_name"), " ")).alias("token")).distinct()
    met = [tokens.where(F.col("token").startswith(t)).select("material_key").distinct() for t in ("wid", "re")]
    return met[0].join(met[1], "material_key", "left_semi")


@query(_TOTALS + " WHERE material_key >= 'red bolt|' AND material_key < 'red bolt}'" + _BY)
def f14_key_range(m, s, spark, sf):
    return _totals(m.where((F.col("material_key") >= "red bolt|") & (F.col("material_key") < "red bolt}")))


@query("SELECT id, host, CASE WHEN id = 5 THEN 'asked to be left out' ELSE 'seventh' END AS reason FROM suppliers WHERE id = 5 OR id % 10 = 7")
def f16_denied_hosts(m, s, spark, sf):
    domain = F.when(F.col("id") == 5, F.upper("host")).otherwise(F.col("host"))
    denied = s.where("id = 5 or id % 10 = 7").select(domain.alias("domain"), F.when(F.col("id") == 5, "asked to be left out").otherwise("seventh").alias("reason"))
    far = denied.unionByName(s.where("id % 10 = 3").select(F.concat(F.lit("no."), "host").alias("domain"), F.lit("never").alias("reason")))
    return policy.denied(s, far).select("id", "host", "reason")


@query("SELECT id, 'shop.' || host AS host, CASE WHEN id % 10 = 7 THEN 'seventh' ELSE 'all of them' END AS reason FROM suppliers")
def n12_denial_of_subdomains(m, s, spark, sf):
    denied = s.where("id % 10 = 7").select(F.col("host").alias("domain"), F.lit("seventh").alias("reason")).unionByName(s.limit(1).select(F.lit("Example.com").alias("domain"), F.lit("all of them").alias("reason")))
    return policy.denied(s.withColumn("host", F.concat(F.lit("shop."), "host")), denied).select("id", "host", "reason")


_ERROR = "CASE id % 4 WHEN 0 THEN 'HTTPStatusError: 403 Forbidden' WHEN 1 THEN 'Disallowed: robots-blocked: HTTP 403' WHEN 2 THEN 'Challenged: challenge-blocked: 503' ELSE 'ConnectTimeout' END"


@query(f", e AS (SELECT id, {_ERROR} AS last_error FROM suppliers) SELECT id, last_error FROM e WHERE id % 4 = 0")
def f21_unclassified_refusals(m, s, spark, sf):
    return policy.unclassified_refusals(s.withColumn("last_error", F.expr(_ERROR))).select("id", "last_error")


@query(f"SELECT id, CASE id % 4 WHEN 1 THEN 'blocked' WHEN 2 THEN 'challenged' ELSE '' END AS said FROM suppliers")
def f20_declined_errors(m, s, spark, sf):
    return s.select("id", policy.decline(F.expr(_ERROR)).alias("said"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'robots-blocked: ' ELSE 'challenge-blocked: ' END || host AS error FROM suppliers")
def x23_marked_errors(m, s, spark, sf):
    return s.select("id", policy.marked(F.when(F.col("id") % 2 == 0, "blocked").otherwise("challenged"), F.col("host")).alias("error"))


@query("SELECT host, id % 12 AS days FROM suppliers WHERE id % 4 = 2 AND id % 12 < 7 AND id % 9 <> 0")
def f19_backing_off(m, s, spark, sf):
    at = F.when(F.col("id") % 9 == 0, "not a date").otherwise(F.date_format(F.timestamp_seconds(F.lit(1706745600) - (F.col("id") % 12) * 86400 - 60), "yyyy-MM-dd HH:mm:ss"))
    rows = s.select(F.upper("host").alias("host"), F.expr(_ERROR).alias("last_error"), at.alias("last_crawled"))
    ahead = rows.withColumns({"last_crawled": F.lit("2031-01-01 00:00:00"), "last_error": F.lit("challenge-blocked:")})  # lies ahead: counts as nothing
    return policy.backing_off(rows.unionByName(ahead), F.timestamp_seconds(F.lit(1706745600)))


@query("SELECT s.id, s.host FROM suppliers s WHERE NOT EXISTS (SELECT 1 FROM materials m WHERE m.supplier_id = s.id AND m.crawled_at >= TIMESTAMP '2001-10-25')")
def f18_stale_suppliers(m, s, spark, sf):
    fresh = m.where(F.col("crawled_at") >= F.lit("2001-10-25").cast("timestamp")).select(F.col("supplier_id").alias("id"))
    return s.join(fresh, "id", "left_anti").select("id", "host")


# --- joins -------------------------------------------------------------------------------------


@query("SELECT image_url, CAST(sum(available_slabs) AS BIGINT) AS slabs FROM materials WHERE image_url <> '' AND CAST(item_id AS BIGINT) NOT IN (SELECT vec_id FROM vectors) GROUP BY image_url")
def j2_images_without_vector(m, s, spark, sf):
    have = fixture.vectors(spark, sf).select(F.col("vec_id").cast("string").alias("item_id"))
    return m.where("image_url <> ''").join(have, "item_id", "left_anti").groupBy("image_url").agg(F.sum("available_slabs").alias("slabs"))


@query("SELECT n_name, count(s.id) AS suppliers, count(DISTINCT token) AS tokens FROM nation LEFT JOIN suppliers s ON s.location = n_name GROUP BY n_name")
def j3_left_join_count(m, s, spark, sf):
    n = fixture.table(spark, sf, "nation").select("n_name")
    return n.join(s, n["n_name"] == s["location"], "left").groupBy("n_name").agg(F.count("id").alias("suppliers"), F.count_distinct("token").alias("tokens"))


_MILES = "2 * 3958.8 * asin(sqrt(pow(sin(radians(lat - 10.0) / 2), 2) + cos(radians(lat)) * cos(radians(10.0)) * pow(sin(radians(lon - 20.0) / 2), 2)))"


@query(f"SELECT s.id, round({_MILES}, 1) AS miles FROM suppliers s JOIN location_geo g ON g.location = s.location WHERE lat IS NOT NULL AND {_MILES} <= 3000")
def j9_within_radius(m, s, spark, sf):
    near = fixture.location_geo(spark, sf).withColumn("miles", N.miles(F.col("lat"), F.col("lon"), 10.0, 20.0)).where("miles <= 3000")
    return s.join(near, "location").select("id", F.round("miles", 1).alias("miles"))


@query(f"SELECT material_key, min(round({_MILES}, 1)) AS miles FROM materials JOIN suppliers s ON s.id = supplier_id JOIN location_geo g ON g.location = s.location WHERE lat IS NOT NULL AND {_MILES} <= 3000 GROUP BY material_key")
def f9_nearest_stock(m, s, spark, sf):
    near = j9_within_radius(m, s, spark, sf).withColumnRenamed("id", "supplier_id")
    return m.join(near, "supplier_id").groupBy("material_key").agg(F.min("miles").alias("miles"))


@query(""", items AS (SELECT DISTINCT supplier_id, item_id FROM materials), n AS (SELECT supplier_id, count(*) AS n FROM items GROUP BY 1),
t AS (SELECT i.*, token FROM items i JOIN suppliers s ON s.id = supplier_id),
p AS (SELECT x.supplier_id AS a, y.supplier_id AS b, x.token, count(*) AS shared FROM t x JOIN t y ON x.token = y.token AND x.item_id = y.item_id AND x.supplier_id < y.supplier_id GROUP BY ALL)
SELECT a, b, token, shared, round(shared / (u.n + v.n - shared), 6) AS jaccard FROM p JOIN n u ON u.supplier_id = a JOIN n v ON v.supplier_id = b""")
def j10_mirror_overlap(m, s, spark, sf):
    return entity.item_overlap(m, s).withColumn("jaccard", F.round("jaccard", 6))


_ONE_WORD = "CASE WHEN base LIKE 'hot %' THEN 'hot' ELSE base END"


@query(f""", z AS (SELECT * REPLACE ({_ONE_WORD} AS base, CASE WHEN material_type = 'SMALL' THEN 'Accessory / Non-Slab' ELSE material_type END AS material_type) FROM materials),
one AS (SELECT base, image_url, available_slabs, id FROM z WHERE image_url <> '' AND base LIKE '% %' AND material_type <> 'Accessory / Non-Slab'),
p AS (SELECT base, image_url FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY available_slabs DESC, id) AS rn FROM one) WHERE rn = 1)
SELECT m.id, p.image_url FROM z m JOIN p ON p.base = m.base WHERE m.image_url = ''""")
def j15_borrowed_photo(m, s, spark, sf):
    kind = F.when(F.col("material_type") == "SMALL", "Accessory / Non-Slab").otherwise(F.col("material_type"))
    return photos.borrowed(m.withColumns({"base": F.expr(_ONE_WORD), "material_type": kind})).select("id", F.col("rep_image").alias("image_url"))


@query(f"""SELECT material_key, min(id) AS id, max(image_url) AS image_url, count(DISTINCT supplier_id) AS suppliers, CAST(sum({SLABS}) AS BIGINT) AS slabs FROM materials
WHERE material_type = 'PROMO' AND material_key <> 'red plate|promo' AND (color = 'Red' OR color = 'Navy Blue' OR base LIKE 'red%') GROUP BY 1 ORDER BY max(image_url) = '', 5 DESC, 1 LIMIT 12""")
def j17_similar_products(m, s, spark, sf):
    return pages.similar(m, "red plate|promo", "PROMO", "Royal Blue", "red plate")


@query(f"""SELECT * FROM (SELECT 'none' AS color, material_key, CAST(sum({SLABS}) AS BIGINT) AS slabs FROM materials WHERE material_type = 'PROMO' AND material_key <> 'new nut|promo' GROUP BY 2 ORDER BY max(image_url) = '', 3 DESC, 2 LIMIT 12)
UNION ALL SELECT * FROM (SELECT 'blue', material_key, CAST(sum({SLABS}) AS BIGINT) AS slabs FROM materials WHERE material_type = 'PROMO' AND material_key <> 'blue nut|promo' AND color = 'Navy Blue' GROUP BY 2 ORDER BY max(image_url) = '', 3 DESC, 2 LIMIT 12)""")
def j17_similar_on_product_pages(m, s, spark, sf):
    """A product without a colour is like all others of its type; one with a colour like those of its family."""
    none, blue = pages.similar(m, "new nut|promo", "PROMO", ""), pages.similar(m, "blue nut|promo", "PROMO", "Royal Blue")
    return none.select(F.lit("none").alias("color"), "material_key", "slabs").unionByName(blue.select(F.lit("blue").alias("color"), "material_key", "slabs"))


# --- aggregates --------------------------------------------------------------------------------


_KINDS = ", z AS (SELECT * REPLACE (CASE material_type WHEN 'SMALL' THEN 'Accessory / Non-Slab' WHEN 'ECONOMY' THEN '' ELSE material_type END AS material_type, CASE WHEN base LIKE 'old %' THEN '' ELSE material_key END AS material_key) FROM materials)"


def _kinds(m: DataFrame) -> DataFrame:
    """Listings some of which are accessories, some of no type, and some without a key."""
    kind = F.when(F.col("material_type") == "SMALL", "Accessory / Non-Slab").when(F.col("material_type") == "ECONOMY", "").otherwise(F.col("material_type"))
    return m.withColumns({"material_type": kind, "material_key": F.when(F.col("base").startswith("old "), "").otherwise(F.col("material_key"))})


@query(_KINDS + """, u AS (SELECT host, CASE WHEN id % 4 = 0 THEN 0 ELSE id END AS item_count, CASE WHEN id % 7 = 3 THEN 'x' END AS mirror_of FROM suppliers)
SELECT (SELECT count(*) FROM u WHERE item_count > 0 AND mirror_of IS NULL) AS suppliers, count(*) AS listings, count(DISTINCT material_key) FILTER (WHERE material_key <> '') AS products, count(*) FILTER (WHERE image_url <> '') AS images FROM z WHERE material_type <> 'Accessory / Non-Slab'""")
def a6_catalog_stats(m, s, spark, sf):
    return rollup.stats(_kinds(m), s.withColumn("item_count", F.when(F.col("id") % 4 == 0, 0).otherwise(F.col("id"))), s.where("id % 7 = 3"))


@query(", f AS (SELECT supplier_id, max(crawled_at) AS c FROM materials GROUP BY 1) SELECT min(c) AS oldest, max(c) AS newest, count(*) AS suppliers, count(CASE WHEN c >= TIMESTAMP '2001-10-25' THEN 1 END) AS current_ FROM f")
def a7_freshness(m, s, spark, sf):
    f = m.groupBy("supplier_id").agg(F.max("crawled_at").alias("c"))
    return f.agg(F.min("c").alias("oldest"), F.max("c").alias("newest"), F.count(F.lit(1)).alias("suppliers"), F.count(F.when(F.col("c") >= F.lit("2001-10-25").cast("timestamp"), 1)).alias("current_"))


@query("SELECT location, CAST(sum(available_slabs) AS BIGINT) AS slabs, count(DISTINCT supplier_id) AS suppliers, count(DISTINCT supplier_id || '/' || item_id) AS items FROM materials JOIN suppliers s ON s.id = supplier_id GROUP BY location")
def a8_location_totals(m, s, spark, sf):
    at = m.join(s.select(F.col("id").alias("supplier_id"), "location"), "supplier_id")
    return at.groupBy("location").agg(F.sum("available_slabs").alias("slabs"), F.count_distinct("supplier_id").alias("suppliers"), F.count_distinct("supplier_id", "item_id").alias("items"))


@query("SELECT material_key, string_agg(DISTINCT location, ',' ORDER BY location) AS locations FROM materials JOIN suppliers s ON s.id = supplier_id GROUP BY material_key")
def a9_distinct_locations(m, s, spark, sf):
    at = m.join(s.select(F.col("id").alias("supplier_id"), "location"), "supplier_id")
    return at.groupBy("material_key").agg(F.array_join(F.array_sort(F.collect_set("location")), ",").alias("locations"))


@query("SELECT material_key, split_part(material_key, '|', 1) AS base, split_part(material_key, '|', -1) AS type, count(DISTINCT supplier_id) AS suppliers, CAST(sum(available_slabs) AS BIGINT) AS slabs, count(*) AS listings, min(id) AS sample_id FROM materials GROUP BY material_key")
def a11_key_aggregates(m, s, spark, sf):
    return entity.key_aggregates(m)


_VOTES = ", v AS (SELECT base, material_type, count(*) AS votes FROM materials WHERE material_type NOT IN ('Other', '', 'ECONOMY') GROUP BY 1, 2), t AS (SELECT *, rank() OVER (PARTITION BY base ORDER BY votes DESC) AS r FROM v), u AS (SELECT base, min(material_type) AS material_type, min(votes) AS votes FROM t WHERE r = 1 GROUP BY base HAVING count(*) = 1)"


@query(_VOTES + " SELECT * FROM u")
def a12_majority_vote(m, s, spark, sf):
    return entity.majority(m, "base", "material_type", ("Other", "", "ECONOMY"))


@query(", v AS (SELECT base, material_type, count(*) AS votes FROM materials WHERE material_type <> 'ECONOMY' GROUP BY 1, 2), t AS (SELECT *, rank() OVER (PARTITION BY base ORDER BY votes DESC) AS r FROM v), u AS (SELECT base, min(material_type) AS won FROM t WHERE r = 1 GROUP BY base HAVING count(*) = 1) SELECT m.id, coalesce(won, 'Other') AS material_type, CASE WHEN won IS NULL THEN m.base || '|other' ELSE m.base || '|' || lower(won) END AS material_key FROM materials m LEFT JOIN u ON u.base = m.base WHERE m.material_type = 'ECONOMY'")
def e10_recover_by_vote(m, s, spark, sf):
    """Listings that nobody knows the type of take that of most of their siblings, and their key follows."""
    lost = F.col("material_type") == "ECONOMY"
    rows = m.withColumns({"material_key": F.when(lost, F.concat("base", F.lit("|other"))).otherwise(F.col("material_key")), "material_type": F.when(lost, "Other").otherwise(F.col("material_type")), "new_arrival": lost.cast("int")})
    return nightly.vote(rows).where("new_arrival = 1").select("id", "material_type", "material_key")


@query(""", p AS (SELECT material_key, CASE WHEN price_range LIKE '%/sf' THEN 'sqft' ELSE 'unit' END AS basis, CAST(replace(replace(price_range, '$', ''), '/sf', '') AS DOUBLE) AS amount, supplier_id FROM materials WHERE price_range LIKE '$%')
SELECT material_key, basis, min(amount) AS low, max(amount) AS high, list_sort(list(amount))[count(*) // 2 + 1] AS median, count(*) AS n, count(DISTINCT supplier_id) AS suppliers FROM p GROUP BY material_key, basis""")
def a13_price_bands(m, s, spark, sf):
    p = m.select("material_key", "supplier_id", N.price(F.col("price_range")).alias("p")).where("p is not null").select("material_key", "supplier_id", "p.*")
    prices = p.groupBy("material_key", "basis", "amount").agg(F.count(F.lit(1)).alias("c"))  # a product's distinct prices are few; its listings needn't be
    upto = Window.partitionBy("material_key", "basis").orderBy("amount").rowsBetween(Window.unboundedPreceding, 0)
    run = prices.select("*", F.sum("c").over(upto).alias("upto"), F.sum("c").over(Window.partitionBy("material_key", "basis")).alias("n"))
    bands = run.groupBy("material_key", "basis").agg(F.min("amount").alias("low"), F.max("amount").alias("high"), F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("amount"))).alias("median"), F.first("n").alias("n"))
    return bands.join(p.groupBy("material_key", "basis").agg(F.count_distinct("supplier_id").alias("suppliers")), ["material_key", "basis"])


@query(f""", y AS (SELECT material_key, supplier_id, count(*) AS n, sum({SLABS}) AS slabs FROM materials GROUP BY 1, 2), b AS (SELECT material_key, min(supplier_id) AS best FROM y WHERE slabs = (SELECT max(slabs) FROM y z WHERE z.material_key = y.material_key) GROUP BY 1),
w AS (SELECT y.*, coalesce(nullif(company, ''), host) AS name FROM y JOIN suppliers s ON s.id = supplier_id),
t AS (SELECT material_key, string_agg(thickness, ',' ORDER BY CAST(replace(thickness, 'cm', '') AS DOUBLE)) AS thicknesses FROM (SELECT DISTINCT material_key, thickness FROM materials WHERE thickness <> '') GROUP BY 1),
l AS (SELECT material_key, string_agg(location, ',' ORDER BY location) AS locations FROM (SELECT *, row_number() OVER (PARTITION BY material_key ORDER BY location) AS rn FROM (SELECT DISTINCT material_key, location FROM materials JOIN suppliers s ON s.id = supplier_id)) WHERE rn <= 8 GROUP BY 1)
SELECT w.material_key, count(*) AS suppliers, CAST(sum(n) AS BIGINT) AS listings, CASE WHEN max(slabs) > 0 THEN CAST(max(slabs) AS BIGINT) END AS deepest, CASE WHEN max(slabs) > 0 THEN max(name) FILTER (WHERE supplier_id = best) END AS deepest_supplier, CAST(sum(slabs) AS BIGINT) AS total,
  coalesce(any_value(thicknesses), '') AS thicknesses, any_value(locations) AS locations, upper(split_part(w.material_key, '|', 2)) AS types FROM w JOIN b USING (material_key) LEFT JOIN t USING (material_key) LEFT JOIN l USING (material_key) GROUP BY w.material_key""")
def a14_evidence(m, s, spark, sf):
    out = pages.evidence(m, s)
    return out.drop("finishes").withColumns({c: F.array_join(c, ",") for c in ("thicknesses", "locations", "types")})


@query(_COLORS + """, c AS (SELECT unnest(CASE color WHEN 'Red' THEN ['Red'] WHEN 'Navy Blue' THEN ['Blue'] WHEN 'Gray, White' THEN ['White', 'Gray'] WHEN 'Golden Sand' THEN ['Gold'] ELSE ['Other'] END) AS family FROM z WHERE color <> '') SELECT family, count(*) AS n FROM c GROUP BY family""")
def a17_color_facets(m, s, spark, sf):
    return rollup.color_options(_colored(m))


@query("SELECT DISTINCT material_type, thickness, product_form FROM materials")
def a18_facet_values(m, s, spark, sf):
    return m.select("material_type", "thickness", "product_form").distinct()


@query("RAW SELECT CASE WHEN k % 4 < 2 AND k // 4 % 3 <> 0 THEN 'Town ' || (k // 4) || ', TX' ELSE n_name || CASE k % 4 WHEN 0 THEN '' ELSE ' yard' END END AS value, CASE WHEN k % 4 < 2 AND k // 4 % 3 <> 0 THEN 'city' ELSE 'yard' END AS kind, string_agg(loc, ';' ORDER BY loc) AS members FROM (SELECT n_nationkey AS k, n_name, CASE WHEN n_nationkey // 4 % 3 <> 0 AND n_nationkey % 4 = 0 THEN 'TOWN-' || (n_nationkey // 4) WHEN n_nationkey // 4 % 3 <> 0 AND n_nationkey % 4 = 1 THEN 'town ' || (n_nationkey // 4) || '.' WHEN n_nationkey % 4 = 0 THEN n_name ELSE n_name || ' yard' END AS loc FROM nation) GROUP BY 1, 2")
def a19_location_groups(m, s, spark, sf):
    """Spellings of a city stand under it, those of ambiguous ones and yards with other names for themselves."""
    n = fixture.table(spark, sf, "nation")
    k = F.col("n_nationkey")
    town, clear = F.floor(k / 4).cast("string"), F.floor(k / 4) % 3 != 0
    loc = F.when(clear & (k % 4 == 0), F.concat(F.lit("TOWN-"), town)).when(clear & (k % 4 == 1), F.concat(F.lit("town "), town, F.lit("."))).when(k % 4 == 0, F.col("n_name")).otherwise(F.concat("n_name", F.lit(" yard")))
    geo = n.select(loc.alias("location"), F.concat(F.lit("Town "), town, F.lit(", TX")).alias("label"), F.when(clear, "exact").otherwise("ambiguous").alias("source"))
    return facts.place_options(geo, geo).withColumn("members", F.array_join("members", ";"))


@query("SELECT count(DISTINCT supplier_id) AS suppliers, count(DISTINCT material_key) AS products FROM materials JOIN suppliers s ON s.id = supplier_id LEFT JOIN location_geo g ON g.location = s.location WHERE lat IS NULL")
def a20_without_location(m, s, spark, sf):
    known = fixture.location_geo(spark, sf).where("lat is not null").select("location")
    lost = s.join(known, "location", "left_anti").select(F.col("id").alias("supplier_id"))
    return m.join(lost, "supplier_id", "left_semi").agg(F.count_distinct("supplier_id").alias("suppliers"), F.count_distinct("material_key").alias("products"))


@query("SELECT count(*) AS listings, count(CASE WHEN image_url = '' THEN 1 END) AS no_image, count(CASE WHEN color = '' THEN 1 END) AS no_color, count(CASE WHEN thickness = '' THEN 1 END) AS no_thickness, count(CASE WHEN idone IS NULL THEN 1 END) AS no_ident FROM materials")
def a21_quality_counts(m, s, spark, sf):
    return status.quality_counts(m)


@query("SELECT base, count(*) AS n FROM materials WHERE material_type = 'ECONOMY' GROUP BY base ORDER BY n DESC, base LIMIT 25")
def a22_common_names(m, s, spark, sf):
    return m.where("material_type = 'ECONOMY'").groupBy("base").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "base").limit(25)


@query(", k AS (SELECT base, count(DISTINCT material_type) AS t FROM materials GROUP BY base) SELECT count(CASE WHEN t >= 2 THEN 1 END) AS conflicts, count(*) AS bases FROM k")
def a26_pending_candidates(m, s, spark, sf):
    k = m.groupBy("base").agg(F.count_distinct("material_type").alias("t"))
    return k.agg(F.count(F.when(F.col("t") >= 2, 1)).alias("conflicts"), F.count(F.lit(1)).alias("bases"))


_TRIED = ", f AS (SELECT supplier_id, max(crawled_at) AS newest FROM materials GROUP BY 1), r AS (SELECT supplier_id, newest FROM f WHERE supplier_id % 5 = 1 OR supplier_id % 5 = 2 AND newest < TIMESTAMP '2001-10-30')"


def _tried(m: DataFrame, s: DataFrame) -> DataFrame:
    """Suppliers that were last asked at one time; a few right after what they have, a day and more after it, or never."""
    k = F.col("id")
    newest = m.groupBy(F.col("supplier_id").alias("id")).agg(F.max("crawled_at").alias("_n"))
    at = F.when(k % 5 == 0, F.col("_n") + F.expr("interval 24 hours")).when(k % 5 == 1, F.col("_n") + F.expr("interval 25 hours")).when(k % 5 == 2, F.lit("2001-10-31").cast("timestamp")).when(k % 5 == 3, F.col("_n"))
    return s.join(newest, "id").withColumn("last_crawled", at)


@query(_TRIED + " SELECT * FROM r")
def a27_residue(m, s, spark, sf):
    return rollup.residue(m, _tried(m, s))


@query(_TRIED + " SELECT DISTINCT material_key FROM materials WHERE supplier_id IN (SELECT supplier_id FROM r) ")
def a28_products_with_residue(m, s, spark, sf):
    return m.join(rollup.residue(m, _tried(m, s)), "supplier_id", "left_semi").select("material_key").distinct()


@query("SELECT CASE WHEN id % 4 = 0 THEN CASE WHEN last_error <> '' THEN 'broken' ELSE 'empty' END WHEN last_error <> '' THEN 'stale' ELSE 'ok' END AS status, count(*) AS n FROM suppliers GROUP BY 1")
def a29_health_buckets(m, s, spark, sf):
    state = status.supplier_status(F.col("last_error"), F.when(F.col("id") % 4 == 0, 0).otherwise(F.col("id")))
    return s.groupBy(state.alias("status")).agg(F.count(F.lit(1)).alias("n"))


# --- history -----------------------------------------------------------------------------------

HISTORY = f""", history AS (SELECT date_trunc('year', crawled_at) AS snapshot_date, supplier_id, base AS name_norm, thickness, product_form, CAST(sum({SLABS}) AS BIGINT) AS slabs FROM materials GROUP BY ALL),
d AS (SELECT *, dense_rank() OVER (PARTITION BY supplier_id ORDER BY snapshot_date DESC) AS nth FROM (SELECT DISTINCT supplier_id, snapshot_date FROM history)),
two AS (SELECT supplier_id, max(CASE WHEN nth = 1 THEN snapshot_date END) AS ld, max(CASE WHEN nth = 2 THEN snapshot_date END) AS pd FROM d GROUP BY 1),
both_ AS (SELECT h.supplier_id, name_norm, thickness, CAST(sum(CASE WHEN nth = 1 THEN slabs END) AS BIGINT) AS latest, CAST(sum(CASE WHEN nth = 2 THEN slabs END) AS BIGINT) AS previous, any_value(ld) AS ld
  FROM history h JOIN d ON d.supplier_id = h.supplier_id AND d.snapshot_date = h.snapshot_date AND nth <= 2 JOIN two t ON t.supplier_id = h.supplier_id AND pd IS NOT NULL GROUP BY 1, 2, 3)
"""


def _history(m: DataFrame) -> DataFrame:
    return history.snapshots(m, F.date_trunc("year", "crawled_at"))


@query(HISTORY + "SELECT snapshot_date, supplier_id, name_norm, thickness, product_form, slabs FROM history")
def a10_snapshots(m, s, spark, sf):
    return _history(m).select("snapshot_date", "supplier_id", "name_norm", "thickness", "product_form", "slabs")


@query(HISTORY + "SELECT h.supplier_id, h.snapshot_date, count(*) AS n FROM history h JOIN d ON d.supplier_id = h.supplier_id AND d.snapshot_date = h.snapshot_date WHERE nth <= 3 GROUP BY 1, 2")
def w1_pruned_history(m, s, spark, sf):
    return history.prune(_history(m), 3).groupBy("supplier_id", "snapshot_date").agg(F.count(F.lit(1)).alias("n"))


@query(HISTORY + "SELECT supplier_id, ld AS latest_date, pd AS previous_date FROM two")
def w2_latest_and_previous(m, s, spark, sf):
    n = history.numbered(_history(m))
    return n.groupBy("supplier_id").agg(F.max(F.when(F.col("nth") == 1, F.col("snapshot_date"))).alias("latest_date"), F.max(F.when(F.col("nth") == 2, F.col("snapshot_date"))).alias("previous_date"))


@query(HISTORY + "SELECT supplier_id, name_norm, thickness, latest, CASE WHEN previous IS NULL THEN 'listed' ELSE 'restock' END AS kind FROM both_ WHERE latest > 0 AND (previous IS NULL OR previous = 0)")
def q6_stock_changes(m, s, spark, sf):
    both = history.listings(_history(m))
    return both.where("latest > 0 and (previous is null or previous = 0)").select("supplier_id", "name_norm", "thickness", "latest", F.when(F.col("previous").isNull(), "listed").otherwise("restock").alias("kind"))


_DIGEST = HISTORY + """, n AS (SELECT h.supplier_id, count(DISTINCT CASE WHEN nth = 1 THEN name_norm END) AS now_, count(DISTINCT CASE WHEN nth = 2 THEN name_norm END) AS prev_ FROM history h JOIN d ON d.supplier_id = h.supplier_id AND d.snapshot_date = h.snapshot_date WHERE nth <= 2 GROUP BY 1),
k AS (SELECT *, CASE WHEN latest IS NOT NULL THEN CASE WHEN previous IS NULL THEN CASE WHEN latest > 0 THEN 'listed' END WHEN previous = 0 THEN CASE WHEN latest > 0 THEN 'restock' END WHEN latest = 0 THEN 'soldout' WHEN latest * 2 <= previous AND previous - latest >= 5 THEN 'dropped' END
  WHEN previous > 0 AND NOT EXISTS (SELECT 1 FROM both_ o WHERE o.supplier_id = b.supplier_id AND o.name_norm = b.name_norm AND o.latest IS NOT NULL) THEN 'delisted' END AS kind FROM both_ b)
SELECT k.supplier_id, name_norm, thickness, kind, latest, previous, kind || '|' || k.supplier_id || '|' || name_norm || '|' || thickness || '|' || strftime(ld, '%Y-%m-%d') AS sig
FROM k JOIN n ON n.supplier_id = k.supplier_id WHERE kind IS NOT NULL AND NOT (kind = 'delisted' AND prev_ > 0 AND now_ < 0.5 * prev_)"""


@query(_DIGEST)
def q7_alert_digest(m, s, spark, sf):
    return history.digest(_history(m))


@query(_DIGEST.replace("SELECT k.supplier_id, name_norm", "SELECT kind, count(*) AS n FROM (SELECT k.supplier_id, name_norm") + ") GROUP BY kind")
def x17_alert_kinds(m, s, spark, sf):
    return history.digest(_history(m)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(HISTORY + "SELECT h.supplier_id, count(DISTINCT CASE WHEN nth = 1 THEN name_norm END) AS now_names, count(DISTINCT CASE WHEN nth = 2 THEN name_norm END) AS prev_names FROM history h JOIN d ON d.supplier_id = h.supplier_id AND d.snapshot_date = h.snapshot_date WHERE nth <= 2 GROUP BY 1 HAVING count(DISTINCT CASE WHEN nth = 1 THEN name_norm END) < 0.98 * count(DISTINCT CASE WHEN nth = 2 THEN name_norm END)")
def q7_shrunk_suppliers(m, s, spark, sf):
    return history.collapsed(_history(m), share=0.02)


# --- entities ----------------------------------------------------------------------------------

_CONFLICT = """, k AS (SELECT * REPLACE (CASE WHEN material_type = 'ECONOMY' THEN base || '|natural stone' ELSE material_key END AS material_key) FROM materials),
a AS (SELECT material_key, base, split_part(material_key, '|', -1) AS type, count(DISTINCT supplier_id) AS suppliers, CAST(sum(available_slabs) AS BIGINT) AS slabs FROM k GROUP BY ALL),
c AS (SELECT *, first_value(material_key) OVER (PARTITION BY base ORDER BY type IN ('other', 'natural stone', ''), suppliers DESC, slabs DESC, material_key) AS canonical, count(*) OVER (PARTITION BY base) AS types, CAST(sum(suppliers) OVER (PARTITION BY base) AS BIGINT) AS reach FROM a)"""


def _weakly_typed(m: DataFrame) -> DataFrame:
    """Listings of one type as if nobody knew it: most suppliers of some names have just that."""
    return m.withColumn("material_key", F.when(F.col("material_type") == "ECONOMY", F.concat("base", F.lit("|natural stone"))).otherwise(F.col("material_key")))


@query(_CONFLICT + " SELECT material_key, base, suppliers, slabs, canonical, reach FROM c WHERE types >= 2")
def e3_type_conflicts(m, s, spark, sf):
    return entity.conflict_clusters(_weakly_typed(m)).select("material_key", "base", "suppliers", "slabs", "canonical", "reach")


_MOSTLY = "CASE WHEN supplier_id % 20 = 0 THEN material_key ELSE base || '|promo' END"


@query(f""", a AS (SELECT {_MOSTLY} AS key, base, count(DISTINCT supplier_id) AS suppliers, sum(available_slabs) AS slabs FROM materials GROUP BY ALL),
c AS (SELECT *, first_value(key) OVER (PARTITION BY base ORDER BY suppliers DESC, slabs DESC, key) AS canonical, count(*) OVER (PARTITION BY base) AS types FROM a),
l AS (SELECT base, canonical, CAST(sum(CASE WHEN key = canonical THEN suppliers ELSE 0 END) AS BIGINT) AS winner, CAST(sum(CASE WHEN key <> canonical THEN suppliers ELSE 0 END) AS BIGINT) AS rest FROM c WHERE types >= 2 GROUP BY 1, 2) SELECT * FROM l WHERE rest > 0 AND winner >= 4 * rest""")
def e5_landslides(m, s, spark, sf):
    return entity.landslides(entity.conflict_clusters(m.withColumn("material_key", F.expr(_MOSTLY))))


@query("RAW SELECT 'k' || p_partkey AS alias_key, 'k' || (p_partkey - p_partkey % 64) AS canonical_key FROM part WHERE p_partkey % 64 <> 0 AND p_partkey // 64 % 10 <> 0")
def e7_resolved_aliases(m, s, spark, sf):
    """Chains of up to 63 steps; every tenth chain ends in a cycle and has no answer."""
    k = F.col("p_partkey")
    to = F.when((k % 64 == 1) & (F.floor(k / 64) % 10 == 0), k + 3).otherwise(k - 1)
    key = lambda c: F.concat(F.lit("k"), c.cast("string"))
    return entity.resolve_aliases(fixture.table(spark, sf, "part").where(k % 64 != 0).select(key(k).alias("alias_key"), key(to).alias("canonical_key")))


@query("SELECT material_key, material_type, count(*) AS n FROM (SELECT CASE WHEN base IN ('red bolt', 'new rod') THEN 'red bolt|folded' ELSE material_key END AS material_key, CASE base WHEN 'red bolt' THEN 'Marble' ELSE material_type END AS material_type FROM materials) GROUP BY ALL")
def e7_applied_aliases(m, s, spark, sf):
    base = F.col("base")
    edges = m.where(base.isin("red bolt", "new rod")).select(F.col("material_key").alias("alias_key"), F.lit("red bolt|folded").alias("canonical_key"), F.when(base == "red bolt", "Marble").alias("canonical_type")).distinct()
    return entity.apply_aliases(m, edges).groupBy("material_key", "material_type").agg(F.count(F.lit(1)).alias("n"))


# --- scalar functions --------------------------------------------------------------------------


@query("SELECT DISTINCT item_name, CASE WHEN item_name LIKE '%Polished/Honed' THEN 'Multiple' WHEN item_name LIKE '%Polished' THEN 'Polished' WHEN item_name LIKE '%Honed' THEN 'Honed' WHEN item_name LIKE '%Leather' THEN 'Leathered' ELSE '' END AS finish FROM materials")
def x4_finish(m, s, spark, sf):
    return m.select("item_name", N.finish(F.col("item_name"), F.lit("")).alias("finish")).distinct()


@query("SELECT DISTINCT item_name, CASE WHEN split_part(base, ' ', 1) = lower(material_type) THEN split_part(base, ' ', 2) ELSE base END || '|' || lower(material_type) AS key FROM materials")
def e1_material_key(m, s, spark, sf):
    return m.select("item_name", N.material_key(F.col("item_name"), F.col("material_type")).alias("key")).distinct()


@query("SELECT DISTINCT material_key, CASE WHEN split_part(base, ' ', 1) = lower(material_type) THEN split_part(base, ' ', 2) ELSE base END || '|' || lower(material_type) AS again FROM materials")
def e2_remapped_key(m, s, spark, sf):
    return m.select("material_key", N.remap_key(F.col("material_key")).alias("again")).distinct()


@query("RAW SELECT DISTINCT item_name, p_size, CASE WHEN p_size % 5 = 4 THEN 'Dark Green' WHEN item_name LIKE 'red %' THEN 'Red' WHEN item_name LIKE 'blue %' THEN 'Blue' WHEN p_size % 5 = 3 THEN 'Off-White' ELSE '' END AS color FROM (SELECT p_name AS item_name, p_size FROM part)")
def x3_color_in_name(m, s, spark, sf):
    p = fixture.table(spark, sf, "part")
    name = F.when(F.col("p_size") % 5 == 4, F.concat(F.lit("Redwood DARK green "), "p_name")).when(F.col("p_size") % 5 == 3, F.concat("p_name", F.lit(" off-white/tan"))).otherwise(F.col("p_name"))
    return p.select(F.col("p_name").alias("item_name"), "p_size", N.color_in_name(name).alias("color")).distinct()


@query("SELECT DISTINCT thickness, CASE thickness WHEN '20cm' THEN '2cm' ELSE thickness END AS fixed FROM materials")
def x6_millimetres(m, s, spark, sf):
    return m.select("thickness", N.repair_mm(F.col("thickness"), F.lit("mm")).alias("fixed")).distinct()


@query("SELECT DISTINCT avg_length, CASE WHEN avg_length / 10 < 20 THEN round(avg_length / 10 * 39.3701, 1) END AS inches FROM materials")
def x7_inches(m, s, spark, sf):
    return m.select("avg_length", N.inches(F.col("avg_length") / 10).alias("inches")).distinct()


@query("""RAW SELECT p_partkey, CASE WHEN p_partkey % 7 IN (0, 1, 2, 3) THEN 'sqft' WHEN p_partkey % 7 = 4 THEN 'unit' END AS basis, CASE WHEN p_partkey % 7 < 5 THEN 1000 + p_partkey + 0.5::DOUBLE END AS amount FROM part""")
def x20_prices(m, s, spark, sf):
    k = F.col("p_partkey")
    money = F.format_string("$ %,d.50", 1000 + k)
    text = (
        F.when(k % 7 == 0, F.concat(money, F.lit(" / sq ft")))
        .when(k % 7 == 1, F.concat(F.lit("from "), money, F.lit("/SF, polished")))
        .when(k % 7 == 2, F.concat(money, F.lit("/sq. ft")))
        .when(k % 7 == 3, F.concat(money, F.lit(" /sqft")))
        .when(k % 7 == 4, F.concat(F.lit(" "), money, F.lit(" ")))
        .when(k % 7 == 5, F.concat(F.lit("about "), money))
        .otherwise("Group 5")
    )
    return fixture.table(spark, sf, "part").select("p_partkey", N.price(text).alias("p")).select("p_partkey", "p.basis", "p.amount")


@query("SELECT DISTINCT base, upper(base[1]) || split_part(base, ' ', 1)[2:] || ' ' || upper(split_part(base, ' ', 2)[1]) || split_part(base, ' ', 2)[2:] AS name FROM materials")
def x13_display_name(m, s, spark, sf):
    return m.select("base", F.initcap("base").alias("name")).distinct()


# --- vectors -----------------------------------------------------------------------------------

_NEAR = """, q AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, material_key, supplier_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(query AS DOUBLE[])), 6) AS score FROM vectors, q),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM s)
"""


def _near(spark: SparkSession, sf: str, k: int) -> DataFrame:
    v = fixture.vectors(spark, sf)
    return matching.nearest(v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), k)


@query(_NEAR + "SELECT query_id, CAST(rank AS INT) AS rank, vec_id, material_key, supplier_id, score FROM t WHERE rank < 10")
def t6_nearest_vectors(m, s, spark, sf):
    return _near(spark, sf, 10)


_CONSENSUS = _NEAR + """, c AS (SELECT query_id, material_key, max(score) AS best_score, count(*) AS images, count(DISTINCT supplier_id) AS suppliers FROM t WHERE rank < 40 GROUP BY 1, 2),
r AS (SELECT *, images / sum(images) OVER (PARTITION BY query_id) AS sh FROM c), e AS (SELECT *, round(sh, 6) AS share, round(best_score * (0.55 + 0.45 * sh) * (0.7 + 0.3 * sqrt(suppliers / images)), 6) AS rank_score FROM r)
"""


@query(_CONSENSUS + "SELECT query_id, material_key, best_score, images, suppliers, share, rank_score FROM e")
def a25_consensus(m, s, spark, sf):
    return matching.consensus(_near(spark, sf, 40))


@query(_CONSENSUS + """, g AS (SELECT *, row_number() OVER w AS rn, lead(best_score) OVER w AS s2, lead(rank_score) OVER w AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best_score DESC, material_key) AS nth FROM e) WHERE nth <= 12 WINDOW w AS (PARTITION BY query_id ORDER BY rank_score DESC, material_key)),
h AS (SELECT *, round(coalesce(best_score - s2, 1.0), 6) AS margin, round(rank_score - coalesce(r2, 0.0), 6) AS lead_ FROM g WHERE rn = 1)
SELECT query_id, material_key, best_score, share, CASE WHEN margin < 0.02 THEN 'none' WHEN best_score >= 0.95 AND lead_ >= 0.02 THEN 'strong' WHEN share >= 0.25 AND best_score >= 0.80 AND lead_ >= 0.03 THEN 'strong' WHEN share >= 0.12 OR best_score >= 0.75 THEN 'likely' ELSE 'uncertain' END AS confidence FROM h""")
def x27_identify(m, s, spark, sf):
    return matching.identify(matching.consensus(_near(spark, sf, 40)))


# --- logs --------------------------------------------------------------------------------------


@query("""RAW WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS ok FROM events WHERE event_type <> 'view'),
i AS (SELECT *, sum(ok) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM e),
r AS (SELECT user_id, CAST(sum(1 - ok) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM i)
SELECT user_id, max(streak) AS longest FROM r GROUP BY user_id HAVING max(streak) >= 3""")
def w9_breaker(m, s, spark, sf):
    e = fixture.table(spark, sf, "events")
    return ledger.tripped(ledger.error_runs(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "view"), "user_id", 3)


@query("""RAW WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 90 MINUTE THEN 0 ELSE 1 END AS starts FROM events),
n AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 90 MINUTE AS ended, count(*) AS beats, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM n GROUP BY user_id, k""")
def r2_heartbeat_sessions(m, s, spark, sf):
    from .streaming.heartbeat import activity

    return activity(fixture.table(spark, sf, "events"))


_RUNS = """RAW WITH r AS (SELECT event_id AS run_id, ts AS started_at, ts + to_days(CAST(event_id % 40 AS INTEGER)) AS heartbeat, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN NULL WHEN 'click' THEN '' ELSE 'done' END AS outcome FROM events)
"""


@query(_RUNS + "SELECT run_id, CASE WHEN coalesce(outcome, '') <> '' THEN outcome WHEN heartbeat < TIMESTAMP '2024-02-05' - INTERVAL 90 MINUTE OR heartbeat < (SELECT max(started_at) FROM r) THEN 'interrupted' ELSE 'running' END AS state FROM r")
def q14_run_ledger(m, s, spark, sf):
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "").when(F.col("event_type") != "view", "done")
    runs = fixture.table(spark, sf, "events").select(F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"), (F.col("ts") + F.make_dt_interval((F.col("event_id") % 40).cast("int"))).alias("heartbeat"), outcome.alias("outcome"))
    return ledger.run_state(runs, F.lit("2024-02-05").cast("timestamp")).select("run_id", "state")


@query("""RAW WITH t AS (SELECT *, max(ts) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id) AS fulls, max(event_id) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id) AS fulle FROM events WHERE event_type <> 'view'),
n AS (SELECT user_id, count(*) AS streak FROM t WHERE fulls IS NULL OR (ts, event_id) > (fulls, fulle) GROUP BY 1) SELECT 'h' || u.user_id AS host, coalesce(streak, 0) AS streak, coalesce(streak, 0) >= 3 AS dead FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN n ON n.user_id = u.user_id""")
def w10_empty_streaks(m, s, spark, sf):
    e = fixture.table(spark, sf, "events")
    crawls = e.select(F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("host"), "ts", "event_id", F.when(F.col("event_type") == "purchase", 5).otherwise(0).alias("items"), "event_type")
    return ledger.empty_streaks(crawls, ["ts", "event_id"], F.col("event_type") == "view")


@query("RAW SELECT date_diff('day', max(CAST(ts AS DATE)) FILTER (WHERE event_type = 'purchase'), DATE '2024-03-01') AS days FROM events")
def x25_lost_days(m, s, spark, sf):
    e = fixture.table(spark, sf, "events").select(F.col("ts").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.when(F.col("event_type") == "purchase", "done").otherwise("failed").alias("outcome"))
    return ledger.lost_days(e, F.lit("2024-03-01").cast("date"))


@query("""RAW SELECT 'r' || user_id AS run_id, min(ts) FILTER (WHERE event_type = 'signup') AS started_at, max(ts) AS heartbeat, arg_max(left(repeat(props, 60), 500), (ts, props)) FILTER (WHERE event_type = 'click') AS phase,
arg_max('done', ts) FILTER (WHERE event_type = 'purchase') AS outcome, arg_max(CAST(event_id AS VARCHAR), ts) FILTER (WHERE event_type = 'purchase') AS detail FROM events GROUP BY user_id""")
def n13_ledger_of_writes(m, s, spark, sf):
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "click", "phase").when(F.col("event_type") == "purchase", "finish").otherwise("beat")
    value = F.when(F.col("event_type") == "purchase", F.concat(F.lit("done: "), F.col("event_id").cast("string"))).otherwise(F.repeat("props", F.lit(60)))
    e = fixture.table(spark, sf, "events")
    return ledger.ledger(e.select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run_id"), F.col("ts").alias("at"), kind.alias("kind"), value.alias("value")))
