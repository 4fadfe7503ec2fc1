"""More of the catalog's queries: stores, search, repairs, policies and rankings, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import normalize as N
from .operators import entity, policy, rollup, status
from .plans import pages, search
from .queries import _TRIED, INNER, PREFIX, SLABS, _tried
from .sources import fixture, store

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(fixture.materials(spark, sf_dir), fixture.suppliers(spark, sf_dir), spark, sf_dir)
        if sql:
            ORACLE_SQL[f.__name__] = sql.removeprefix("RAW ") if sql.startswith("RAW ") else PREFIX + sql
        return f

    return wrap


# --- stores ------------------------------------------------------------------------------------


@query(", n AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'new ' || id END AS company FROM suppliers WHERE id % 3 = 0) SELECT s.id, s.host, coalesce(n.company, s.company) AS company FROM suppliers s LEFT JOIN n ON n.id = s.id")
def c4_upsert(m, s, spark, sf):
    new = s.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("new "), F.col("id").cast("string"))).alias("company"))
    return store.upsert(s.select("id", "host", "company"), new, "id")


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY supplier_id, item_id, idone ORDER BY id) AS rn FROM materials WHERE supplier_id % 4 = 0) SELECT supplier_id, count(*) AS n FROM (SELECT supplier_id FROM materials WHERE supplier_id % 4 <> 0 UNION ALL SELECT supplier_id FROM r WHERE rn = 1 OR idone IS NULL) GROUP BY 1")
def c5_replace_partitions(m, s, spark, sf):
    return store.replace_suppliers(m, m.where("supplier_id % 4 = 0")).groupBy("supplier_id").agg(F.count(F.lit(1)).alias("n"))


@query(", gone AS (SELECT id FROM suppliers WHERE host LIKE '%3.example.com') SELECT material_key, count(*) AS n FROM materials WHERE supplier_id NOT IN (SELECT id FROM gone) GROUP BY 1")
def c7_purge(m, s, spark, sf):
    denied = s.where(F.col("host").endswith("3.example.com")).select(F.upper("host").alias("domain"))
    return store.purge({"suppliers": s, "materials": m}, denied)["materials"].groupBy("material_key").agg(F.count(F.lit(1)).alias("n"))


@query(", o AS (SELECT s.host, max(crawled_at) AS x FROM materials m JOIN suppliers s ON s.id = supplier_id WHERE product_form = 'Slab' GROUP BY 1), t AS (SELECT s.host, max(crawled_at) AS y FROM materials m JOIN suppliers s ON s.id = supplier_id WHERE product_form = 'Tile' GROUP BY 1) SELECT t.host FROM t LEFT JOIN o ON o.host = t.host WHERE x IS NULL OR y > x")
def j13_newer_watermarks(m, s, spark, sf):
    at = m.join(s.select(F.col("id").alias("supplier_id"), "host"), "supplier_id")
    return store.newer_partitions(at.where("product_form = 'Slab'"), at.where("product_form = 'Tile'"), "crawled_at")


@query("SELECT supplier_id, item_id, max(id) - max(id) + min(id) AS id FROM materials GROUP BY supplier_id, item_id")
def u3_first_seen(m, s, spark, sf):
    return store.first_of_key(m, ["supplier_id", "item_id"], [F.col("id")]).select("supplier_id", "item_id", "id")


# --- search ------------------------------------------------------------------------------------

def _found(where: str) -> str:
    return INNER.replace("FROM materials GROUP BY material_key, supplier_id", f"FROM materials WHERE {where} GROUP BY material_key, supplier_id")


@query(_found("contains(lower(item_name), 'plate') AND thickness = '3cm' AND upper(product_form) LIKE '%SLAB%' AND (color = 'Red' OR contains(item_name, 'red'))") + "SELECT grp, suppliers, available_slabs, total_slabs FROM rollup_ WHERE available_slabs > 0 OR has_tile = 1 ORDER BY suppliers DESC, available_slabs DESC, material_key, grp LIMIT 30")
def q1_search(m, s, spark, sf):
    found = search.search(m, s, "show me a Red plate slab, 30mm please", search.Filters(in_stock=True))
    return found.products.select("grp", "suppliers", "available_slabs", "total_slabs")


_REACH = "2 * 3958.8 * asin(sqrt(pow(sin(radians(lat - 10.0) / 2), 2) + cos(radians(lat)) * cos(radians(10.0)) * pow(sin(radians(lon - 20.0) / 2), 2)))"


@query(f", near AS (SELECT s.id AS supplier_id, round({_REACH}, 1) AS miles FROM suppliers s JOIN location_geo g ON g.location = s.location WHERE lat IS NOT NULL AND {_REACH} <= 4000), found AS (SELECT m.*, miles FROM materials m JOIN near USING (supplier_id) WHERE material_type = 'PROMO' AND avg_length >= 70 AND avg_width >= 45 AND new_arrival = 1 AND contains(item_name, 'widget')), y AS (SELECT material_key AS grp, supplier_id, sum({SLABS}) AS n, max(CASE WHEN upper(product_form) LIKE '%TILE%' THEN 1 ELSE 0 END) AS tile, min(miles) AS miles, sum({SLABS} * avg_length * avg_width) / 144.0 AS sqft FROM found GROUP BY 1, 2), g AS (SELECT grp, count(*) AS suppliers, CAST(max(n) AS BIGINT) AS available_slabs, max(tile) AS tile, min(miles) AS miles, max(sqft) AS sqft FROM y GROUP BY 1) SELECT grp, suppliers, available_slabs, miles FROM g WHERE (available_slabs > 0 OR tile = 1) AND sqft >= 100 ORDER BY miles, available_slabs DESC, grp LIMIT 20")
def q1_search_nearby(m, s, spark, sf):
    chosen = search.Filters(material_type="PROMO", near=(10.0, 20.0, 4000.0), min_length=70, min_width=45, min_sqft=100, new_only=True)
    found = search.search(m, s, "widgets", chosen, fixture.location_geo(spark, sf), sort="distance", size=20)
    return found.products.select("grp", "suppliers", "available_slabs", "miles")


@query(INNER.replace("FROM materials GROUP BY material_key, supplier_id", "FROM materials WHERE contains(item_name, 'widget') AND contains(item_name, 'plate') IS NOT NULL AND contains(item_name, 'blue') GROUP BY material_key, supplier_id") + "SELECT grp, suppliers, total_slabs FROM rollup_")
def q1_search_misspelt(m, s, spark, sf):
    """No name has these words as they are spelt; a navy blue widget is found by words like them."""
    found = search.search(m.withColumn("item_name", F.regexp_replace("item_name", "^blue", "blueish")), s, "blueisch widgett", size=10_000)
    return found.products.select("grp", "suppliers", "total_slabs")


@query(", u AS (SELECT s.id FROM suppliers s WHERE id % 3 = 0) SELECT CAST((SELECT count(DISTINCT supplier_id) FROM materials WHERE contains(item_name, 'rod') AND supplier_id IN (SELECT id FROM u)) AS BIGINT) AS suppliers, CAST((SELECT count(DISTINCT material_key) FROM materials WHERE contains(item_name, 'rod') AND supplier_id IN (SELECT id FROM u)) AS BIGINT) AS products, CAST((SELECT count(DISTINCT material_key) FROM materials JOIN suppliers s ON s.id = supplier_id WHERE contains(item_name, 'rod') AND s.id % 3 <> 0 AND s.location = 'NATION_3') AS BIGINT) AS total")
def q1_search_unlocated(m, s, spark, sf):
    placed = s.withColumn("locations", F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("elsewhere, "), "location")))
    found = search.search(m, placed, "rod", search.Filters(locations=("Nation_3",)))
    return spark.createDataFrame([(*found.unlocated, found.total)], "suppliers long, products long, total long")


@query(INNER + "SELECT material_type, count(*) AS products, CAST(sum(total_slabs) AS BIGINT) AS slabs, count(CASE WHEN available_slabs > 0 THEN 1 END) AS in_stock FROM rollup_ GROUP BY 1")
def q2_rollup_by_type(m, s, spark, sf):
    r = rollup.product_rollup(m, s)
    return r.groupBy("material_type").agg(F.count(F.lit(1)).alias("products"), F.sum("total_slabs").alias("slabs"), F.count(F.when(F.col("available_slabs") > 0, 1)).alias("in_stock"))


@query(f"""SELECT material_key, supplier_id, location, CAST(sum({SLABS}) AS BIGINT) AS slabs, count(DISTINCT item_id) AS items, array_to_string(list_transform(list_sort(list_distinct(list({{'n': TRY_CAST(replace(thickness, 'cm', '') AS DOUBLE), 't': thickness}}) FILTER (WHERE thickness <> ''))), lambda x: x.t), ',') AS thicknesses, min(nullif(avg_length, 0)) AS shortest, max(avg_length) AS longest
FROM materials JOIN suppliers s ON s.id = supplier_id WHERE material_key IN ('red plate|promo', 'red rod|economy') GROUP BY 1, 2, 3""")
def q3_product_page(m, s, spark, sf):
    return pages.supplier_blocks(m, s, ["red plate|promo", "red rod|economy"])


@query("""SELECT material_key, coalesce(array_to_string(list_sort(list_distinct(list_filter(flatten(list(string_split(color, ', '))), lambda x: x <> ''))), ','), '') AS colors, min(avg_length) AS shortest, max(avg_length) AS longest, min(avg_width) AS narrowest, max(avg_width) AS widest, count(DISTINCT supplier_id) AS suppliers, count(*) AS listings
FROM materials WHERE material_key IN ('red plate|promo', 'blue ring|economy', 'cold rod|promo') GROUP BY 1""")
def a15_page_facts(m, s, spark, sf):
    return pages.facts(m, ["red plate|promo", "blue ring|economy", "cold rod|promo"], None).withColumn("colors", F.array_join("colors", ","))


@query("""SELECT material_key, nth, image_url FROM (SELECT *, row_number() OVER (PARTITION BY material_key ORDER BY contains(image_url, 'slabcloud.com/slabs/'), a) AS nth FROM (SELECT material_key, image_url, min((coalesce(nullif(company, ''), host), thickness, m.id)) AS a FROM materials m JOIN suppliers s ON s.id = supplier_id WHERE image_url <> '' AND material_key IN ('red plate|promo', 'blue ring|economy') GROUP BY 1, 2)) WHERE nth <= 8""")
def a15_page_photos(m, s, spark, sf):
    return pages.photos(m, s, ["red plate|promo", "blue ring|economy"])


@query(", i AS (SELECT DISTINCT supplier_id, item_id FROM materials WHERE material_key = 'red plate|promo') SELECT supplier_id, item_id, idone AS slab_no, image_url, (SELECT min(crawled_at) FROM materials JOIN i USING (supplier_id, item_id)) AS oldest FROM materials JOIN i USING (supplier_id, item_id) WHERE idone IS NOT NULL")
def q5_slab_gallery(m, s, spark, sf):
    slabs = m.select("supplier_id", "item_id", F.col("idone").alias("slab_no"), "image_url", "crawled_at")
    return pages.gallery(m.where("material_key = 'red plate|promo'"), slabs)


@query("SELECT m.supplier_id, m.id, m.item_name, m.available_slabs FROM materials m JOIN (SELECT supplier_id, min(id) AS id FROM materials WHERE base = 'red plate' GROUP BY 1) r ON r.id = m.id")
def j8_first_rows(m, s, spark, sf):
    return pages.first_rows(m.where("base = 'red plate'")).select("supplier_id", "id", "item_name", "available_slabs")


@query(", k AS (SELECT item_id, supplier_id, thickness, product_form, CAST(sum(available_slabs) AS BIGINT) AS slabs FROM materials WHERE item_id IN ('7', '11') GROUP BY ALL) SELECT * FROM k")
def a16_item_variants(m, s, spark, sf):
    return m.where(F.col("item_id").isin("7", "11")).groupBy("item_id", "supplier_id", "thickness", "product_form").agg(F.sum("available_slabs").alias("slabs"))


@query(_TRIED + """, tried AS (SELECT supplier_id AS id, CASE supplier_id % 5 WHEN 0 THEN newest + INTERVAL 24 HOUR WHEN 1 THEN newest + INTERVAL 25 HOUR WHEN 2 THEN TIMESTAMP '2001-10-31' WHEN 3 THEN newest END AS last_crawled FROM f)
SELECT s.id, coalesce(nullif(company, ''), host) AS name, CASE WHEN s.id % 5 <> 0 THEN '555-' || s.id END AS phone, coalesce(n.n, 0) AS items, CASE WHEN coalesce(n.n, 0) > 0 THEN CASE WHEN last_error <> '' THEN 'stale' ELSE 'ok' END WHEN last_error <> '' THEN 'broken' ELSE 'empty' END AS status,
round((epoch(TIMESTAMP '2002-06-01') - floor(epoch(tried.last_crawled))) / 3600, 2) AS age_hours, round((epoch(TIMESTAMP '2002-06-01') - floor(epoch(n.last))) / 3600, 2) AS data_age_hours, s.id IN (SELECT supplier_id FROM r) AS residue
FROM suppliers s LEFT JOIN tried ON tried.id = s.id LEFT JOIN (SELECT supplier_id, count(*) AS n, max(crawled_at) AS last FROM materials GROUP BY 1) n ON n.supplier_id = s.id""")
def q11_supplier_health(m, s, spark, sf):
    """Every supplier's contacts and state, when it was last tried and how old what it serves is."""
    tried = _tried(m, s)
    phone = F.when(F.col("id") % 5 != 0, F.concat(F.lit("555-"), F.col("id").cast("string")))
    return status.health_page(tried.withColumn("phone", phone), m, rollup.residue(m, tried), F.lit("2002-06-01").cast("timestamp")).drop("email")


_PLACES = "CASE WHEN s.id % 9 = 0 THEN '' WHEN s.id % 9 = 1 THEN 'Warehouse B' ELSE location END"


@query(f"SELECT y.location, slabs, suppliers, products, lat, lon, label, source, lat IS NOT NULL AS pinned, lat IS NOT NULL AND coalesce(source, '') = 'ambiguous' AS approximate FROM (SELECT {_PLACES} AS location, count(*) AS slabs, count(DISTINCT supplier_id) AS suppliers, count(DISTINCT supplier_id || '/' || item_id) AS products FROM materials JOIN suppliers s ON s.id = supplier_id WHERE idone IS NOT NULL GROUP BY 1 HAVING {_PLACES} <> '') y LEFT JOIN (SELECT location, lat, lon, label, CASE WHEN label IN ('City 1', 'City 2') THEN 'ambiguous' ELSE 'city' END AS source FROM location_geo WHERE label <> 'City 3') g ON g.location = y.location".replace(f"HAVING {_PLACES} <> ''", "HAVING location <> ''").replace("GROUP BY 1 HAVING location <> ''", "GROUP BY ALL") + " WHERE y.location <> ''")
def q10_location_pins(m, s, spark, sf):
    """Places of slabs, of which some aren't places and some have not been looked up."""
    g = fixture.location_geo(spark, sf).where("label <> 'City 3'").withColumn("source", F.when(F.col("label").isin("City 1", "City 2"), "ambiguous").otherwise("city"))
    slabs = m.where("idone is not null").join(s.select(F.col("id").alias("supplier_id"), F.expr(_PLACES.replace("s.id", "id")).alias("location")), "supplier_id")
    return pages.locations(slabs.select("supplier_id", "item_id", "location"), g)


# --- rankings ----------------------------------------------------------------------------------


@query(", a AS (SELECT *, row_number() OVER (ORDER BY available_slabs DESC, id) AS nth FROM materials), p AS (SELECT *, row_number() OVER (PARTITION BY product_form ORDER BY available_slabs DESC, id) AS rn FROM a WHERE nth <= 600) SELECT product_form, id, available_slabs FROM p WHERE rn <= 300")
def t5_cap_per_kind(m, s, spark, sf):
    """The 600 deepest listings, and of each form 300 of them."""
    most = m.select("product_form", "id", "available_slabs").orderBy(F.desc("available_slabs"), "id").limit(600)
    return most.withColumn("rn", F.row_number().over(Window.partitionBy("product_form").orderBy(F.desc("available_slabs"), "id"))).where("rn <= 300").drop("rn")


@query(", p AS (SELECT supplier_id, item_id, CAST(sum(available_slabs) AS BIGINT) AS slabs FROM materials GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY supplier_id ORDER BY slabs DESC, item_id) AS rn FROM p) SELECT supplier_id, item_id, slabs FROM r WHERE rn <= 5")
def t7_most_stocked_items(m, s, spark, sf):
    items = m.groupBy("supplier_id", "item_id").agg(F.sum("available_slabs").alias("slabs"))
    return items.withColumn("rn", F.row_number().over(Window.partitionBy("supplier_id").orderBy(F.desc("slabs"), "item_id"))).where("rn <= 5").drop("rn")


@query("SELECT id, image_url FROM materials WHERE supplier_id = 3 ORDER BY image_url = '', available_slabs DESC, id LIMIT 40")
def t4_photos_first(m, s, spark, sf):
    return m.where("supplier_id = 3").orderBy(F.col("image_url") == "", F.desc("available_slabs"), "id").limit(40).select("id", "image_url")


@query(f", y AS (SELECT base, supplier_id, sum({SLABS}) AS n FROM materials GROUP BY 1, 2), w AS (SELECT *, max(n) OVER (PARTITION BY base) AS top FROM y) SELECT base, CAST(min(n) AS BIGINT) AS slabs, min(supplier_id) AS winner FROM w WHERE n = top GROUP BY base HAVING count(*) = 1")
def w7_unique_winner(m, s, spark, sf):
    held = m.groupBy("base", "supplier_id").agg(F.sum(rollup.slabs()).alias("slabs"))
    return entity.only_leader(held, "base", "supplier_id", "slabs").withColumnRenamed("supplier_id", "winner")


@query(""", n AS (SELECT id // 4 AS cluster, CASE WHEN id % 2 = 1 THEN 'w' || (id // 4) || '.example.com' ELSE host END AS host, CASE WHEN id % 8 < 4 THEN 9 ELSE id % 4 END AS items, 'W' || (id // 4) AS token FROM suppliers)
SELECT cluster, host AS canonical FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY items DESC, split_part(host, '.', 1) <> lower(token), host) AS rn FROM n) WHERE rn = 1""")
def w6_canonical_host(m, s, spark, sf):
    k = F.col("id")
    host = F.when(k % 2 == 1, F.concat(F.lit("w"), F.floor(k / 4).cast("string"), F.lit(".example.com"))).otherwise(F.col("host"))
    members = s.select(F.floor(k / 4).alias("cluster"), host.alias("host"), F.concat(F.lit("W"), F.floor(k / 4).cast("string")).alias("token"), F.when(k % 8 < 4, 9).otherwise(k % 4).alias("items"))
    return entity.canonical_hosts(members)


def _mirrored(m, s):
    """Storefronts in fours: three show the first one's items, the third but for one in 97, and the last its own; the second has the tenant's name."""
    k = F.col("id")
    shops = s.select("id", F.when(k % 4 == 1, F.concat(F.lit("t"), F.floor(k / 4).cast("string"), F.lit(".example.com"))).otherwise(F.col("host")).alias("host"), "company", F.concat(F.lit("T"), F.floor(k / 4).cast("string")).alias("token"))
    of = s.select(F.col("id").alias("shop"), F.when(k % 4 == 3, k).otherwise(k - k % 4).alias("supplier_id"))
    items = m.select("supplier_id", "item_id").distinct().join(of, "supplier_id").where("shop % 4 <> 2 or cast(item_id as bigint) % 97 <> 0")
    return items.select(F.col("shop").alias("supplier_id"), "item_id"), shops


_MIRRORED = """, shops AS (SELECT id, CASE WHEN id % 4 = 1 THEN 't' || (id // 4) || '.example.com' ELSE host END AS host, company, 'T' || (id // 4) AS token FROM suppliers),
items AS (SELECT DISTINCT s.id AS supplier_id, item_id FROM suppliers s JOIN materials m ON m.supplier_id = CASE WHEN s.id % 4 = 3 THEN s.id ELSE s.id - s.id % 4 END WHERE s.id % 4 <> 2 OR CAST(item_id AS BIGINT) % 97 <> 0),
n AS (SELECT supplier_id, count(*) AS n FROM items GROUP BY 1),
p AS (SELECT x.supplier_id AS a, y.supplier_id AS b, count(*) AS shared FROM items x JOIN items y ON x.item_id = y.item_id AND x.supplier_id // 4 = y.supplier_id // 4 AND x.supplier_id <> y.supplier_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n u ON u.supplier_id = a JOIN n v ON v.supplier_id = b WHERE shared / (u.n + v.n - shared) >= 0.98),
c AS (SELECT s.id, s.host, (SELECT o.host FROM shops o JOIN n ON n.supplier_id = o.id WHERE o.id = s.id OR o.id IN (SELECT b FROM l WHERE a = s.id) OR o.id IN (SELECT k.b FROM l k JOIN l j ON j.b = k.a WHERE j.a = s.id) ORDER BY n DESC, split_part(o.host, '.', 1) <> lower(token), o.host LIMIT 1) AS canonical FROM shops s),
f AS (SELECT host, CASE WHEN id = 8 THEN 'elsewhere.example.com' ELSE canonical END AS mirror_of, CASE WHEN id = 8 THEN 'curated' ELSE 'computed' END AS source FROM c WHERE id NOT IN (2, 8) AND host <> canonical OR id = 8)"""


def _found_mirrors(m, s, spark):
    items, shops = _mirrored(m, s)
    overrides = shops.where("id in (2, 8)").select("host", F.when(F.col("id") == 8, "elsewhere.example.com").alias("canonical"))
    return items, shops, entity.mirrors(items, shops, overrides)


@query(_MIRRORED + " SELECT host, mirror_of, source FROM f")
def e11_mirrors(m, s, spark, sf):
    return _found_mirrors(m, s, spark)[2]


@query(_MIRRORED + """ SELECT f.host AS mirror_host, coalesce(nullif(x.company, ''), x.host) AS mirror_name, mirror_of AS canonical_host, coalesce(nullif(y.company, ''), y.host, mirror_of) AS canonical_name, source, round(coalesce(shared / (u.n + v.n - shared), 0), 6) AS overlap, coalesce(u.n, 0) AS mirror_items, coalesce(v.n, 0) AS canonical_items
FROM f LEFT JOIN shops x ON x.host = f.host LEFT JOIN shops y ON y.host = mirror_of LEFT JOIN n u ON u.supplier_id = x.id LEFT JOIN n v ON v.supplier_id = y.id LEFT JOIN p ON a = x.id AND b = y.id""")
def e12_mirror_report(m, s, spark, sf):
    items, shops, found = _found_mirrors(m, s, spark)
    return entity.mirror_report(found, items, shops).withColumn("overlap", F.round("overlap", 6))


@query("SELECT supplier_id, CAST(sum(available_slabs) AS BIGINT) AS slabs, string_agg(DISTINCT item_name, '; ' ORDER BY item_name) AS items FROM materials WHERE item_id IN ('1', '2', '3', '5') GROUP BY supplier_id")
def a32_grouped_list(m, s, spark, sf):
    rows = m.where(F.col("item_id").isin("1", "2", "3", "5"))
    return rows.groupBy("supplier_id").agg(F.sum("available_slabs").alias("slabs"), F.array_join(F.array_sort(F.collect_set("item_name")), "; ").alias("items"))


_SAVED = ", q AS (SELECT unnest(['red', 'blue', 'cold']) AS term), h AS (SELECT term, m.* FROM q JOIN materials m ON contains(item_name, term))"


@query(_SAVED + ", p AS (SELECT term, material_key, sum(available_slabs) AS n FROM h GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY n DESC, material_key) AS nth FROM p), w AS (SELECT term, string_agg(material_key, ';' ORDER BY nth) AS preview FROM r WHERE nth <= 6 GROUP BY 1) SELECT term, count(DISTINCT material_key) AS products, count(DISTINCT CASE WHEN new_arrival = 1 THEN material_key END) AS new_, any_value(preview) AS preview FROM h JOIN w USING (term) GROUP BY term")
def a31_watchlist(m, s, spark, sf):
    terms = F.explode(F.filter(F.array(*map(F.lit, ("red", "blue", "cold"))), lambda t: F.col("item_name").contains(t))).alias("term")
    hits = m.select("material_key", "new_arrival", "available_slabs", terms)  # one pass for all saved queries
    keys = hits.groupBy("term", "material_key").agg(F.max("new_arrival").alias("new"), F.sum("available_slabs").alias("n"))
    nth = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("n"), "material_key"))
    first = F.array_sort(F.collect_list(F.when(F.col("nth") <= 6, F.struct("nth", "material_key"))))
    return keys.withColumn("nth", nth).groupBy("term").agg(F.count(F.lit(1)).alias("products"), F.count(F.when(F.col("new") == 1, 1)).alias("new_"), F.array_join(F.transform(first, lambda x: x["material_key"]), ";").alias("preview"))


@query("SELECT count(DISTINCT image_url) FILTER (WHERE image_url <> '') AS images, count(DISTINCT CASE WHEN CAST(item_id AS BIGINT) IN (SELECT vec_id FROM vectors) AND image_url <> '' THEN image_url END) AS indexed FROM materials")
def a24_index_coverage(m, s, spark, sf):
    v = fixture.vectors(spark, sf).select(F.col("vec_id").cast("string").alias("item_id"), F.lit(True).alias("_v"))
    at = m.where("image_url <> ''").select("item_id", "image_url").distinct().join(v, "item_id", "left")
    return at.agg(F.count_distinct("image_url").alias("images"), F.count_distinct(F.when(F.col("_v"), F.col("image_url"))).alias("indexed"))


# --- repairs -----------------------------------------------------------------------------------

_TYPES = "CASE p_type WHEN 'PROMO' THEN 'Quartzite slabs' WHEN 'SMALL' THEN 'natural marble' WHEN 'LARGE' THEN 'Sink' WHEN 'MEDIUM' THEN 'Ceramic' WHEN 'STANDARD' THEN '12.5' ELSE '' END"


@query(f"""RAW SELECT DISTINCT p_name, p_type, CASE p_type WHEN 'PROMO' THEN 'Quartzite' WHEN 'SMALL' THEN 'Marble' WHEN 'LARGE' THEN 'Accessory / Non-Slab' WHEN 'MEDIUM' THEN 'Sintered Stone' WHEN 'STANDARD' THEN 'Granite' ELSE 'Other' END AS material_type FROM part""")
def x1_classified(m, s, spark, sf):
    p = fixture.table(spark, sf, "part")
    t = F.col("p_type")
    category = F.when(t == "PROMO", "Quartzite slabs").when(t == "SMALL", "natural marble").when(t == "LARGE", "Sink").when(t == "MEDIUM", "Ceramic").when(t == "STANDARD", "12.5").otherwise("")
    name = F.when(t == "MEDIUM", F.concat(F.lit("DEKTON "), "p_name")).when(t == "STANDARD", F.concat("p_name", F.lit(" granite"))).otherwise(F.col("p_name"))
    return p.select("p_name", "p_type", N.canonical_type(category, F.lit(None).cast("string"), name).alias("material_type")).distinct()


@query("""RAW SELECT DISTINCT p_size, CASE p_size % 4 WHEN 0 THEN p_size || 'cm' WHEN 1 THEN CASE WHEN p_size % 10 = 0 THEN (p_size // 10) || 'cm' ELSE (p_size // 10) || '.' || (p_size % 10) || 'cm' END WHEN 2 THEN p_size || '.5cm' ELSE '' END AS thickness FROM part""")
def x5_thickness(m, s, spark, sf):
    size = F.col("p_size")
    text = size.cast("string")
    raw = F.when(size % 4 == 0, text).when(size % 4 == 1, F.concat(text, F.lit("mm")))
    name = F.when(size % 4 == 2, F.concat(F.lit("x "), text, F.lit(".50 CM y"))).otherwise("plain")
    return fixture.table(spark, sf, "part").select("p_size", N.thickness(raw, name, F.lit("SF")).alias("thickness")).distinct()


@query("""RAW SELECT DISTINCT p_size, CASE p_size % 4 WHEN 0 THEN 'Beige' WHEN 1 THEN 'Gray, Off-White' WHEN 2 THEN '' ELSE 'Light Blue' END AS color FROM part""")
def x2_clean_color(m, s, spark, sf):
    size = F.col("p_size") % 4
    raw = F.when(size == 0, "BEIGE,Shell Reef Brushed 24 X 48 2 Cm Limestone Tile, beige").when(size == 1, "gray, off-white,GRAY").when(size == 2, "123.4").otherwise(" light  blue ")
    return fixture.table(spark, sf, "part").select("p_size", N.clean_color(F.regexp_replace(raw, " +", " ")).alias("color")).distinct()


@query("""RAW WITH p AS (SELECT DISTINCT p_size AS n FROM part), v AS (SELECT n, CASE WHEN n % 10 = 0 THEN n / 100.0 ELSE n / 100.0 END AS cm FROM p), s AS (SELECT n, cm, printf('%.2fcm', cm) AS stored FROM v)
SELECT n, stored, CASE WHEN cm NOT IN (0.4, 0.6, 0.8, 1.0, 1.2, 1.5, 1.6, 2.0, 3.0, 4.0, 5.0, 6.0) AND round(cm * 2.54, 1) IN (0.4, 0.6, 0.8, 1.0, 1.2, 1.5, 1.6, 2.0, 3.0, 4.0, 5.0, 6.0) THEN CASE WHEN round(cm * 2.54, 1) % 1 = 0 THEN CAST(round(cm * 2.54, 1) AS INTEGER) || 'cm' ELSE printf('%.1fcm', round(cm * 2.54, 1)) END ELSE stored END AS fixed FROM s""")
def x8_inch_thickness(m, s, spark, sf):
    rows = fixture.table(spark, sf, "part").select(F.col("p_size").alias("n"), F.format_string("%.2fcm", F.col("p_size") / 100.0).alias("stored")).distinct()
    return rows.select("n", "stored", N.repair_inches(F.col("stored")).alias("fixed"))


# --- policies ----------------------------------------------------------------------------------


@query("""RAW SELECT page_id, CASE page_id % 5 WHEN 0 THEN page_id % 3 = 0 OR page_id % 2 = 1 WHEN 1 THEN true WHEN 2 THEN page_id % 2 = 1 WHEN 3 THEN page_id % 2 = 1 ELSE page_id % 4 <> 2 END AS allowed FROM pages""")
def f25_robots(m, s, spark, sf):
    """Hosts of five kinds: an own group with a longer allowing pattern; an own group without rules; a name that is part of ours; one that ours begins with and a shorter one; end marks and missing slashes."""
    k = F.col("page_id")
    path = F.concat(F.when(k % 2 == 0, F.lit("/casino")).otherwise(F.lit("/")), F.when(k % 3 == 0, F.lit("/en/")).otherwise(F.lit("x")), F.when(k % 4 == 2, F.lit("/end")).otherwise(F.lit("/go")))
    path = F.when(k % 5 == 4, F.regexp_replace(path, "^/", "")).otherwise(path)
    pages_ = fixture.table(spark, sf, "pages").select("page_id", F.concat(F.lit("h"), (k % 5).cast("string"), F.lit("-"), (k % 40).cast("string")).alias("host"), path.alias("path"))
    bodies = (
        "Disallow: /nobody\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nUser-agent: tessera # us\nDisallow: /casino\nAllow: /casino*/en/\nDisallow:\n",
        "User-agent: *\nDisallow: /\nUseragent: TesseraBot\nDisallow:\n",
        "User-agent: tess\nDisallow: /casino\nUser-agent: *\nDisallow: /\n",
        "User-agent: t\nDisallow: /\nUser-agent: tesserabot\ncrawl-delay: 5\nUser-agent: tesserabot/1\nDisallow: /casino\nUser-agent: *\nAllow: /\n",
        "User-agent: *\nDisallow: /*/end$\nDisallow: /*/go$x\n",
    )
    made = F.element_at(F.array(*map(F.lit, bodies)), (F.split_part(F.substr("host", F.lit(2)), F.lit("-"), F.lit(1)).cast("int") + 1))
    verdict = policy.robots_allowed(policy.robots_rules(pages_.select("host").distinct().withColumn("body", made)), pages_.select("host", "path").distinct(), "TesseraBot/1.0")
    return pages_.join(verdict, ["host", "path"]).select("page_id", "allowed")


@query("""RAW WITH d AS (SELECT doc_id, doc_id % 4 AS s, doc_id % 9 AS b, doc_id % 11 = 0 AS h FROM documents)
SELECT doc_id, CASE WHEN h THEN 'bot-protection challenge (cf-mitigated: challenge)' WHEN s < 2 AND b IN (0, 1, 2) THEN 'bot-protection challenge (interstitial, server: ' || CASE WHEN doc_id % 5 = 0 THEN 'hcdn' ELSE 'unknown' END || ')' ELSE '' END AS reason FROM d""")
def f26_challenges(m, s, spark, sf):
    """Phrases at the start and within the first 4000 characters, and beyond them; bare words; statuses that challenges aren't served with."""
    k = F.col("doc_id")
    pad = F.repeat(F.lit("x"), F.lit(3980))
    body = (
        F.when(k % 9 == 0, "Just a moment...").when(k % 9 == 1, F.concat(pad, F.lit(" DataDome "), pad)).when(k % 9 == 2, "<p>px-captcha</p>")
        .when(k % 9 == 3, F.concat(pad, F.lit("x" * 40), F.lit("just a moment"))).when(k % 9 == 4, "Access denied. Attention required! captcha").otherwise("plain")
    )
    status = F.element_at(F.array(*map(F.lit, (403, 503, 429, 200))), (k % 4 + 1).cast("int"))
    headers = F.map_concat(F.when(k % 11 == 0, F.create_map(F.lit("CF-Mitigated"), F.lit(" Challenge "))).otherwise(F.create_map().cast("map<string,string>")), F.when(k % 5 == 0, F.create_map(F.lit("Server"), F.lit("hcdn"))).otherwise(F.create_map().cast("map<string,string>")))
    return fixture.table(spark, sf, "documents").select("doc_id", policy.challenge_reason(status, headers, body).alias("reason"))


@query("""RAW SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 1) THEN CASE doc_id % 7 WHEN 0 THEN 'rules' WHEN 1 THEN 'none' WHEN 2 THEN 'none' WHEN 3 THEN 'rules' ELSE 'none' END WHEN doc_id % 6 = 2 THEN CASE doc_id % 7 WHEN 4 THEN 'unreachable' ELSE 'none' END WHEN doc_id % 6 = 3 THEN 'none' ELSE 'unreachable' END AS verdict FROM documents""")
def n6_robots_verdicts(m, s, spark, sf):
    k = F.col("doc_id")
    body = (
        F.when(k % 7 == 0, "User-Agent: *\nDisallow: /x").when(k % 7 == 1, "  <!DOCTYPE html><p>Disallow: nothing").when(k % 7 == 2, '{"Disallow": 1}').when(k % 7 == 3, " \n").when(k % 7 == 4, "Checking your browser").otherwise("OK")
    )
    status = F.element_at(F.array(*map(F.lit, (200, 204, 403, 404, 500, 302))), (k % 6 + 1).cast("int"))
    return fixture.table(spark, sf, "documents").select("doc_id", policy.robots_verdict(status, F.lit(None).cast("map<string,string>"), body).alias("verdict"))


@query("RAW SELECT page_id, CASE page_id % 3 WHEN 0 THEN CASE WHEN page_id % 4 < 2 AND page_id % 5 = 0 THEN 'allowed' ELSE 'blocked' END WHEN 1 THEN 'unreachable' ELSE 'allowed' END AS verdict FROM pages")
def f27_overridden_robots(m, s, spark, sf):
    k = F.col("page_id")
    rows = fixture.table(spark, sf, "pages").select("page_id", F.when(k % 4 == 0, "shop.example.com").when(k % 4 == 1, "Example.com").otherwise("notexample.com").alias("host"), F.concat(F.when(k % 5 == 0, F.lit("/media/")).otherwise(F.lit("/x/")), k.cast("string")).alias("path"), F.when(k % 3 == 0, "blocked").when(k % 3 == 1, "unreachable").otherwise("allowed").alias("verdict"))
    over = spark.createDataFrame([("example.com", "/media/"), ("example.com", "/med"), ("other.org", "/")], "host string, prefix string")
    return rows.drop("verdict").join(policy.with_overrides(rows.drop("page_id").distinct(), over), ["host", "path"]).select("page_id", "verdict")


@query("SELECT lower(host) AS host, CASE id % 5 WHEN 0 THEN 'crawl' WHEN 1 THEN 'paused' WHEN 2 THEN 'crawl' WHEN 3 THEN 'paused' ELSE 'crawl' END AS reach FROM suppliers")
def n5_crawl_reach(m, s, spark, sf):
    at = F.element_at(F.array(*map(F.lit, ("2024-01-01", "2024-04-01", "2023-01-01", "some day", ""))), (F.col("id") % 5 + 1).cast("int"))
    entries = s.select(F.upper("host").alias("host"), F.col("id").isNotNull().alias("rejected"), at.alias("rejected_at"), F.col("id"))
    return policy.reach(entries.withColumn("rejected", F.col("id") % 5 < 4), F.lit("2024-04-10").cast("date"))


@query("RAW SELECT event_id FROM events WHERE date_diff('day', CAST(ts AS DATE), DATE '2024-04-10') < 90")
def f17_active_rejections(m, s, spark, sf):
    e = fixture.table(spark, sf, "events").withColumn("at", F.date_format("ts", "yyyy-MM-dd"))
    return policy.active_rejections(e, F.lit("2024-04-10").cast("date")).select("event_id")
