"""Queries of what follows from something else: removals, sitemaps of sitemaps, places near origins, products compared, questions and saved searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import cascade, close, curation, entity, history, places, policy, rollup, status
from .plans import compare, pages, saved, search
from .queries import _TRIED, HISTORY, INNER, PREFIX, SLABS, TILE, _history, _tried
from .sources import feeds, fixture, landed, staging

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(fixture.materials(spark, sf_dir), fixture.suppliers(spark, sf_dir), spark, sf_dir)
        if sql:
            ORACLE_SQL[f.__name__] = sql.removeprefix("RAW ") if sql.startswith("RAW ") else PREFIX + sql
        return f

    return wrap


# --- removals -----------------------------------------------------------------------------------

#: All tables of a catalog; photos are shared between suppliers, and some slabs are of items that nobody lists.
_ALL = f""", sup AS (SELECT *, 7 AS item_count, 9 AS slab_count, 'mail' || id AS email FROM suppliers),
slb AS (SELECT supplier_id, CASE WHEN id % 7 = 0 THEN 'stray' ELSE item_id END AS item_id, idone FROM materials WHERE idone IS NOT NULL),
his AS (SELECT date_trunc('year', crawled_at) AS d, supplier_id, base, thickness, product_form, sum({SLABS}) AS n FROM materials GROUP BY ALL),
vec AS (SELECT DISTINCT image_url FROM materials WHERE image_url <> '' UNION SELECT 'kept elsewhere'), lst AS (SELECT DISTINCT p_partkey % 50 AS supplier_id, CAST(p_partkey AS VARCHAR) AS item_id FROM part)"""


def _tables(m, s, spark, sf):
    shots = m.where("image_url <> ''").select("image_url").distinct().unionByName(spark.range(1).select(F.lit("kept elsewhere").alias("image_url")))
    return {
        "suppliers": s.withColumns({"item_count": F.lit(7), "slab_count": F.lit(9), "email": F.concat(F.lit("mail"), F.col("id").cast("string"))}),
        "materials": m,
        "slabs": m.where("idone is not null").select("supplier_id", F.when(F.col("id") % 7 == 0, "stray").otherwise(F.col("item_id")).alias("item_id"), "idone"),
        "history": history.snapshots(m, F.date_trunc("year", "crawled_at")),
        "vectors": shots,
        "list_items": fixture.table(spark, sf, "part").select((F.col("p_partkey") % 50).alias("supplier_id"), F.col("p_partkey").cast("string").alias("item_id")).distinct(),
    }


def _sizes(tables):
    out = None
    for name, df in tables.items():
        if name == "suppliers":
            one = df.select(F.lit(name).alias("name"), F.col("id").alias("supplier_id"), F.concat_ws("/", F.coalesce("company", F.lit("-")), F.coalesce("email", F.lit("-")), F.col("item_count").cast("string"), F.col("slab_count").cast("string")).alias("holds"))
        elif name == "vectors":
            one = df.select(F.lit(name).alias("name"), F.lit(None).cast("long").alias("supplier_id"), F.col("image_url").alias("holds"))
        else:
            one = df.groupBy("supplier_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "supplier_id", F.col("n").cast("string").alias("holds"))
        out = one if out is None else out.unionByName(one)
    return out


_SIZES = """ SELECT 'materials' AS name, supplier_id, CAST(count(*) AS VARCHAR) AS holds FROM m2 GROUP BY 2 UNION ALL SELECT 'slabs', supplier_id, CAST(count(*) AS VARCHAR) FROM s2 GROUP BY 2 UNION ALL SELECT 'history', supplier_id, CAST(count(*) AS VARCHAR) FROM h2 GROUP BY 2
UNION ALL SELECT 'vectors', NULL, image_url FROM v2 UNION ALL SELECT 'list_items', supplier_id, CAST(count(*) AS VARCHAR) FROM lst GROUP BY 2 UNION ALL SELECT 'suppliers', id, holds FROM u2"""


@query(_ALL + """, g AS (SELECT id FROM suppliers WHERE id % 10 = 3), m2 AS (SELECT * FROM materials WHERE supplier_id NOT IN (SELECT id FROM g)), s2 AS (SELECT * FROM slb WHERE supplier_id NOT IN (SELECT id FROM g)), h2 AS (SELECT * FROM his WHERE supplier_id NOT IN (SELECT id FROM g)),
v2 AS (SELECT * FROM vec WHERE image_url NOT IN (SELECT image_url FROM materials WHERE supplier_id IN (SELECT id FROM g) AND image_url <> '')), u2 AS (SELECT id, CASE WHEN id IN (SELECT id FROM g) THEN '-/-/0/0' ELSE company || '/' || email || '/7/9' END AS holds FROM sup)""" + _SIZES)
def c7_purged_tables(m, s, spark, sf):
    """Every table after every tenth supplier was erased: their photos' vectors go, users' saved items stay."""
    return _sizes(cascade.purged(_tables(m, s, spark, sf), s.where("id % 10 = 3").select(F.upper("host").alias("host")))[0])


@query(_ALL + """, sc AS (SELECT id, CASE WHEN id % 8 = 0 THEN 'NOWHERE' ELSE 'PROMO' END AS scope FROM suppliers WHERE id % 4 = 0), ok AS (SELECT id, scope FROM sc WHERE EXISTS (SELECT 1 FROM materials m WHERE m.supplier_id = sc.id AND m.material_type = scope)),
m2 AS (SELECT m.* FROM materials m LEFT JOIN ok ON ok.id = supplier_id WHERE scope IS NULL OR material_type = scope), s2 AS (SELECT b.* FROM slb b WHERE supplier_id NOT IN (SELECT id FROM ok) OR EXISTS (SELECT 1 FROM m2 WHERE m2.supplier_id = b.supplier_id AND m2.item_id = b.item_id)), h2 AS (SELECT * FROM his), v2 AS (SELECT * FROM vec),
u2 AS (SELECT id, company || '/' || email || '/' || CASE WHEN id IN (SELECT id FROM ok) THEN (SELECT count(*) FROM m2 WHERE supplier_id = sup.id) || '/' || (SELECT count(*) FROM s2 WHERE supplier_id = sup.id) ELSE '7/9' END AS holds FROM sup)""" + _SIZES)
def e14_rescoped_tables(m, s, spark, sf):
    """Every table after storefronts were cut to their confirmed type: slabs of items that are gone go, counts are made anew."""
    scopes = s.where("id % 4 = 0").select("host", F.when(F.col("id") % 8 == 0, "NOWHERE").otherwise("PROMO").alias("material_type"))
    return _sizes(cascade.rescoped(_tables(m, s, spark, sf), scopes))


# --- sitemaps -----------------------------------------------------------------------------------


@query("RAW SELECT 'https://x/p/' || p_partkey AS url, 2 AS depth FROM part WHERE (p_partkey // 50) % 7 <> 0")
def c18_sitemaps_of_sitemaps(m, s, spark, sf):
    """A root that names maps of maps, itself, maps that haven't landed, and a chain that is too deep."""
    k = F.col("p_partkey")
    p = fixture.table(spark, sf, "part").select(k, F.floor(k / 500).alias("g"), F.floor(k / 50).alias("h"))
    loc = lambda *parts: F.concat(F.lit("<url><loc> "), *parts, F.lit(" </loc></url>"))
    body = lambda c: F.array_join(F.collect_list(c), "\n").alias("body")
    name = lambda tag, c: F.concat(F.lit(f"https://x/{tag}"), c.cast("string"), F.lit(".XML"))
    pages = p.where("h % 7 <> 0").groupBy(name("n", F.col("h")).alias("url")).agg(body(loc(F.lit("https://x/p/"), F.col("p_partkey").cast("string"))))
    groups = p.select("g", "h").distinct().groupBy(name("m", F.col("g")).alias("url")).agg(body(loc(name("n", F.col("h")))))
    tops = p.select(name("m", F.col("g")).alias("u")).unionByName(spark.range(1).select(F.explode(F.array(F.lit("https://x/root.xml"), F.lit("https://x/d1.xml"))).alias("u"))).distinct()
    root = tops.agg(body(loc(F.col("u")))).select(F.lit("https://x/root.xml").alias("url"), "body")
    deep = spark.range(1, 6).select(F.concat(F.lit("https://x/d"), F.col("id").cast("string"), F.lit(".xml")).alias("url"), F.when(F.col("id") < 5, loc(F.lit("https://x/d"), (F.col("id") + 1).cast("string"), F.lit(".xml"))).otherwise(loc(F.lit("https://x/too-deep"))).alias("body"))
    maps = pages.unionByName(groups).unionByName(root).unionByName(deep)
    return feeds.expanded_sitemaps(maps, root.select("url"))


# --- places -------------------------------------------------------------------------------------

_ORIGIN = "(c_custkey * 37 % 1790) / 10.0 - 89.5 AS lat, (c_custkey * 101 % 3600) / 10.0 - 180.0 AS lon"
_AWAY = "2 * 3958.8 * asin(sqrt(least(1.0, pow(sin(radians(g.lat - o.lat) / 2), 2) + cos(radians(g.lat)) * cos(radians(o.lat)) * pow(sin(radians(g.lon - o.lon) / 2), 2))))"


def _origins(spark, sf):
    return fixture.table(spark, sf, "customer").select(F.col("c_custkey").alias("origin_id"), ((F.col("c_custkey") * 37 % 1790) / 10.0 - 89.5).alias("lat"), ((F.col("c_custkey") * 101 % 3600) / 10.0 - 180.0).alias("lon"))


@query(f", o AS (SELECT c_custkey AS origin_id, {_ORIGIN} FROM customer) SELECT origin_id, location, round({_AWAY}, 3) AS miles FROM o, location_geo g WHERE g.lat IS NOT NULL AND {_AWAY} <= 900")
def j9_within_reach_of_many(m, s, spark, sf):
    found = places.within(_origins(spark, sf), fixture.location_geo(spark, sf), 900)
    return found.withColumn("miles", F.round("miles", 3))


@query(f", o AS (SELECT c_custkey AS origin_id, {_ORIGIN} FROM customer), d AS (SELECT origin_id, location, {_AWAY} AS miles FROM o, location_geo g WHERE g.lat IS NOT NULL) SELECT origin_id, min(miles).round(3) AS miles, arg_min(location, miles) AS location FROM d GROUP BY 1".replace("min(miles).round(3)", "round(min(miles), 3)"))
def f9_nearest_of_many(m, s, spark, sf):
    found = places.nearest(_origins(spark, sf), fixture.location_geo(spark, sf), 100)
    return found.withColumn("miles", F.round("miles", 3))


_TRAY = f""", tray AS (SELECT p_partkey // 4 AS user_id, CASE WHEN p_partkey % 11 = 0 THEN 'gone ' || p_partkey || '|x' WHEN p_partkey % 5 = 0 THEN 'old ' || p_name || '|' || lower(p_type) ELSE p_name || '|' || lower(p_type) END AS asked, CASE WHEN p_partkey % 11 = 0 THEN 'gone ' || p_partkey || '|x' ELSE p_name || '|' || lower(p_type) END AS material_key FROM part),
y AS (SELECT material_key, supplier_id, sum({SLABS}) AS n FROM materials GROUP BY 1, 2), e AS (SELECT material_key, count(*) AS suppliers, CAST(max(n) AS BIGINT) AS deepest, CAST(sum(n) AS BIGINT) AS total FROM y GROUP BY 1),
pr AS (SELECT material_key, min(CAST(regexp_extract(price_range, '^\\$([0-9.]+)/sf$', 1) AS DOUBLE)) AS price_sqft FROM materials WHERE price_range LIKE '%/sf' GROUP BY 1),
g AS (SELECT DISTINCT material_key, lat, lon FROM materials JOIN suppliers s ON s.id = supplier_id JOIN location_geo USING (location) WHERE lat IS NOT NULL),
o AS (SELECT DISTINCT user_id, (user_id * 37 % 1790) / 10.0 - 89.5 AS lat, (user_id * 101 % 3600) / 10.0 - 180.0 AS lon FROM tray WHERE user_id % 3 <> 0),
n AS (SELECT t.user_id, t.material_key, round(min({_AWAY}), 1) AS miles FROM (SELECT DISTINCT user_id, material_key FROM tray) t JOIN o USING (user_id) JOIN g ON g.material_key = t.material_key GROUP BY 1, 2),
c AS (SELECT tray.*, suppliers IS NULL AS gone, suppliers, deepest, total, price_sqft, miles FROM tray LEFT JOIN e USING (material_key) LEFT JOIN pr USING (material_key) LEFT JOIN n ON n.user_id = tray.user_id AND n.material_key = tray.material_key)"""


def _won(figure, best, value=None):
    v = value or figure
    return f"coalesce({v} = {best}({v}) OVER u AND count({v}) OVER u >= 2 AND (SELECT count(*) FROM c d WHERE d.user_id = c.user_id AND {v.replace(figure, 'd.' + figure)} = (SELECT {best}({v}) FROM c WHERE user_id = d.user_id)) = 1, false) AS wins_{figure}"


@query(_TRAY + " SELECT c.*, " + ", ".join((_won("suppliers", "max"), _won("deepest", "max"), _won("total", "max", "nullif(total, 0)"), _won("price_sqft", "min"), _won("miles", "min"))) + " FROM c WINDOW u AS (PARTITION BY user_id)")
def q8_compared_trays(m, s, spark, sf):
    """Every user's tray: old keys follow aliases, some products are gone, two of three users have an origin."""
    k, name = F.col("p_partkey"), F.concat_ws("|", "p_name", F.lower("p_type"))
    lost = F.concat(F.lit("gone "), k.cast("string"), F.lit("|x"))
    tray = fixture.table(spark, sf, "part").select(F.floor(k / 4).alias("user_id"), F.when(k % 11 == 0, lost).when(k % 5 == 0, F.concat(F.lit("old "), name)).otherwise(name).alias("material_key"), name.alias("_now"))
    aliases = tray.where(F.col("material_key").startswith("old ")).where("material_key <> _now").select(F.col("material_key").alias("alias_key"), F.col("_now").alias("canonical_key")).distinct().where(F.col("alias_key") == F.concat(F.lit("old "), "canonical_key"))
    u = F.col("user_id")
    origins = tray.where("user_id % 3 <> 0").select("user_id").distinct().select("user_id", ((u * 37 % 1790) / 10.0 - 89.5).alias("lat"), ((u * 101 % 3600) / 10.0 - 180.0).alias("lon"))
    return compare.columns(tray.drop("_now"), m, s, aliases, origins, fixture.location_geo(spark, sf))


# --- words --------------------------------------------------------------------------------------


@query("RAW SELECT DISTINCT 'Show me a ' || upper(p_name) || CASE WHEN p_size % 2 = 0 THEN ' POLISHD, 30mm slabs' ELSE ' honed QUARTSITE tile please' END AS question, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'Quartzite' END AS material_type, CASE WHEN split_part(p_name, ' ', 1) IN ('red', 'blue') THEN split_part(p_name, ' ', 1) ELSE '' END AS color, CASE WHEN p_size % 2 = 0 THEN '3cm' ELSE '' END AS thickness, CASE WHEN p_size % 2 = 0 THEN 'slab' ELSE 'tile' END AS form, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'honed,' END || CASE WHEN split_part(p_name, ' ', 1) IN ('red', 'blue') THEN '' ELSE split_part(p_name, ' ', 1) || ',' END || split_part(p_name, ' ', 2) || CASE WHEN p_size % 2 = 0 THEN ',polishd' ELSE '' END AS terms FROM part")
def x11_parsed_queries(m, s, spark, sf):
    """Questions about every product's name, as columns."""
    even = F.col("p_size") % 2 == 0
    asked = fixture.table(spark, sf, "part").select(F.concat(F.lit("Show me a "), F.upper("p_name"), F.when(even, " POLISHD, 30mm slabs").otherwise(" honed QUARTSITE tile please")).alias("question")).distinct()
    return asked.select("question", search.asked(F.col("question")).alias("a")).select("question", "a.material_type", "a.color", "a.thickness", "a.form", F.array_join("a.terms", ",").alias("terms"))


@query("""SELECT substr(w, 1, 1) || substr(w, 3) AS term, w, round(2.0 * (length(w) - 1) / (2 * length(w) - 1), 6)::DOUBLE AS ratio, 1 AS rank FROM (SELECT DISTINCT unnest(regexp_split_to_array(upper(item_name), '[^A-Z0-9]+')) AS w FROM materials) WHERE length(w) > 3 AND NOT regexp_full_match(w, '[0-9]+')""")
def x21_close_words(m, s, spark, sf):
    """For every word of names without its second letter, the words that are spelt much like it."""
    words = search.name_words(m)
    found = close.closest(close.close_pairs(words.select(F.concat(F.substring("w", 1, 1), F.substring("w", 3, 1000)).alias("term")), words))
    return found.withColumn("ratio", F.round("ratio", 6))


@query("""SELECT p_partkey AS search_id, count(DISTINCT material_key) AS total, count(DISTINCT material_key) FILTER (WHERE new_arrival = 1) AS new FROM part JOIN materials ON contains(lower(item_name), split_part(p_name, ' ', 2)) AND (p_partkey % 3 <> 0 OR thickness = '3cm') AND (p_partkey % 3 <> 2 OR product_form = 'Slab') AND (p_partkey % 4 <> 0 OR color = 'Red' OR contains(item_name, 'red')) GROUP BY 1""".replace("FROM part JOIN materials ON", "FROM part JOIN (SELECT DISTINCT material_key, item_name, thickness, product_form, color, new_arrival FROM materials) materials ON"))
def a31_saved_searches(m, s, spark, sf):
    """Totals of a saved search for every part, all in one pass."""
    k = F.col("p_partkey")
    words = F.concat_ws(" ", F.when(k % 4 == 0, "red"), F.split_part("p_name", F.lit(" "), F.lit(2)), F.when(k % 3 == 0, "3cm"), F.when(k % 3 == 2, "slabs"))
    asked = fixture.table(spark, sf, "part").select(k.alias("search_id"), words.alias("query"))
    return saved.totals(m, s, asked).select("search_id", "total", "new")


@query("RAW SELECT p_partkey AS search_id, p_partkey % 5 = 1 OR p_partkey % 7 = 0 OR p_partkey % 3 = 0 AS narrow FROM part")
def f22_narrowing(m, s, spark, sf):
    """Which of many saved filters leave out suppliers."""
    k = F.col("p_partkey")
    chosen = F.map_from_arrays(F.array(*map(F.lit, ("material_type", "near", "in_stock", "min_sqft", "supplier"))), F.array(F.lit("Marble"), F.when(k % 5 == 1, "1,2"), F.when(k % 7 == 0, "true").otherwise("false"), F.when(k % 3 == 0, "40").otherwise("0"), F.lit("")))
    return fixture.table(spark, sf, "part").select(k.alias("search_id"), policy.narrowing(chosen).alias("narrow"))


@query("RAW SELECT o_orderkey AS id, array_to_string(list_transform(range(greatest(1, o_custkey % 40 - 1), least(1 + o_orderkey % 40, o_custkey % 40 + 3) + 1), lambda x: CAST(x AS VARCHAR)), ',') AS pages FROM orders WHERE o_custkey % 40 + 1 <= 1 + o_orderkey % 40".replace("greatest(1, o_custkey % 40 - 1)", "greatest(1, o_custkey % 40 + 1 - 2)").replace("o_custkey % 40 + 3)", "o_custkey % 40 + 1 + 2)"))
def n18_chips_and_pages(m, s, spark, sf):
    """The pages to link to beside each of many present ones."""
    o = fixture.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40 + 1).alias("number"), (1 + F.col("o_orderkey") % 40).alias("pages")).where("number <= pages")
    return o.select("id", F.array_join(F.transform(search.pages_around(F.col("number"), F.col("pages")), lambda x: x.cast("string")), ",").alias("pages"))


# --- landed feeds -------------------------------------------------------------------------------


@query("""RAW SELECT provider, count(*) AS items, count(DISTINCT item_name) AS names FROM (
SELECT 'slabware' AS provider, CAST(p_partkey AS VARCHAR) AS item, p_name AS item_name FROM part UNION ALL SELECT 'stonetrash', CAST(p_partkey AS VARCHAR), p_name FROM part WHERE p_partkey % 3 <> 0
UNION ALL SELECT 'unbuilt', CAST(p_partkey AS VARCHAR), p_name FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'iblocky', CAST(p_partkey AS VARCHAR), p_name FROM part WHERE p_partkey % 5 <> 0
UNION ALL SELECT 'slabcloud', p_name, p_name FROM (SELECT DISTINCT p_name FROM part) UNION ALL SELECT 'genericfeed', CAST(p_partkey AS VARCHAR), p_name FROM part UNION ALL SELECT 'umi', CAST(p_partkey AS VARCHAR), p_name FROM part) GROUP BY 1""")
def c12_providers(m, s, spark, sf):
    """Every part as a document of each of seven providers, landed by host and read through the provider's data source."""
    landed.register(spark)
    path, k = staging.scratch(spark, "landed"), F.col("p_partkey")
    p = fixture.table(spark, sf, "part").withColumns({"id": k.cast("string"), "host": F.concat(F.lit("h"), (k % 3).cast("string"))})
    struct, name = (lambda **c: F.struct(*(v.alias(n) for n, v in c.items()))), F.col("p_name")
    bodies = {
        "slabware": struct(Bundles=F.array(struct(id=F.col("id"), nomeMaterial=name))),
        "stonetrash": struct(id=F.col("id"), title=F.when(k % 3 != 0, name).otherwise(" ")),
        "unbuilt": struct(data=F.array(struct(id=F.col("id"), title=name, category_path=F.when(k % 2 == 0, "Slabs").otherwise("Sinks")))),
        "iblocky": struct(form=F.lit("SLAB"), commesse=F.array(struct(id=F.col("id"), material=name, isActive=k % 5 != 0))),
        "slabcloud": struct(Name=name, Thickness=F.lit("2cm")),
        "genericfeed": struct(url=F.col("id"), html=F.concat(F.lit('<script type="application/ld+json">{"@type":"Product","name":"'), name, F.lit('"}</script>'))),
        "umi": struct(items=F.array(struct(item=F.col("id"), MaterialName=name))),
    }
    out = None
    for provider, body in bodies.items():
        for host in ("h0", "h1", "h2"):
            p.where(F.col("host") == host).select(F.to_json(body).alias("value")).write.text(f"{path}/{provider}/{host}")
        read = landed.materials(spark, provider, path)
        item = F.col("page_id") if provider == "genericfeed" else F.upper("item_name") if provider == "slabcloud" else F.col("item_id")
        named = read.select(item.alias("item"), F.col("name" if provider == "genericfeed" else "item_name").alias("item_name"))
        one = named.agg(F.lit(provider).alias("provider"), F.count_distinct("item").alias("items"), F.count_distinct("item_name").alias("names"))
        out = one if out is None else out.unionByName(one)
    return out


# --- pages --------------------------------------------------------------------------------------

_ASKED = ", a AS (SELECT * FROM materials WHERE id IN (SELECT min(id) FROM materials GROUP BY supplier_id))"


def _asked(m):
    return m.groupBy("supplier_id").agg(F.min("id").alias("id")).select("id")


@query(_TRIED + _ASKED + """, p AS (SELECT base, max_by(image_url, (available_slabs, -id)) AS rep FROM materials WHERE image_url <> '' GROUP BY 1)
SELECT a.id, item_name, material_key, supplier_id, coalesce(nullif(company, ''), host) AS supplier_name, supplier_id IN (SELECT supplier_id FROM r) AS is_residue, coalesce(nullif(image_url, ''), rep) AS photo FROM a JOIN suppliers s ON s.id = supplier_id LEFT JOIN p ON p.base = a.base""")
def q4_item_page(m, s, spark, sf):
    """The first listing of every supplier with what its page says of it."""
    return pages.item_pages(m, s, _asked(m), rollup.residue(m, _tried(m, s)))["item"]


@query(_ASKED + f""", o AS (SELECT material_key, supplier_id, min(id) AS id, count(*) AS variants, CAST(sum({SLABS}) AS BIGINT) AS slabs, max(CAST({TILE} AS INT)) AS has_tile, max(image_url) AS image_url FROM materials GROUP BY 1, 2)
SELECT a.id AS of, o.supplier_id, o.id, variants, slabs, has_tile, o.image_url, coalesce(nullif(company, ''), host) AS supplier_name FROM a JOIN o ON o.material_key = a.material_key JOIN suppliers s ON s.id = o.supplier_id""")
def q4_item_others(m, s, spark, sf):
    return pages.item_pages(m, s, _asked(m), m.limit(0))["others"]


@query(_ASKED + f""", v AS (SELECT supplier_id, material_key, base, thickness, product_form, min(id) AS id, CAST(sum({SLABS}) AS BIGINT) AS slabs, max(CAST({TILE} AS INT)) AS has_tile, max(image_url) AS image_url FROM materials GROUP BY 1, 2, 3, 4, 5)
SELECT a.id AS of, v.id, v.thickness, v.product_form, slabs, has_tile, v.image_url FROM a JOIN v ON v.supplier_id = a.supplier_id AND v.material_key = a.material_key WHERE NOT (v.base = a.base AND v.thickness = a.thickness AND v.product_form = a.product_form)""")
def q4_item_variants(m, s, spark, sf):
    return pages.item_pages(m, s, _asked(m), m.limit(0))["variants"]


@query(HISTORY + """, c AS (SELECT CASE WHEN previous IS NULL THEN 'listed' ELSE 'restock' END AS kind, supplier_id, name_norm, thickness, latest AS slabs, row_number() OVER (ORDER BY latest DESC, supplier_id, name_norm, thickness) AS top FROM both_ WHERE latest > 0 AND (previous IS NULL OR previous = 0)),
n AS (SELECT c.*, row_number() OVER (PARTITION BY kind ORDER BY slabs DESC, supplier_id, name_norm, thickness) AS nth FROM c WHERE top <= 600) SELECT kind, nth, n.supplier_id, name_norm, n.thickness, slabs, (SELECT min(id) FROM materials m WHERE m.supplier_id = n.supplier_id AND m.base = name_norm AND m.thickness = n.thickness) AS id FROM n WHERE nth <= 300""")
def q18_whats_new(m, s, spark, sf):
    """What is back in stock or newly listed, as the page shows it."""
    return history.stock_changes(_history(m), m)


@query(INNER.replace("FROM materials", "FROM (SELECT * FROM materials WHERE new_arrival = 1) materials") + "SELECT grp, suppliers, available_slabs, total_slabs FROM rollup_ ORDER BY suppliers DESC, available_slabs DESC, material_key, grp LIMIT 60")
def q18_arrivals_page(m, s, spark, sf):
    """The first page of new arrivals."""
    found = search.search(m, s, "", search.Filters(new_only=True), size=60)
    return found.products.select("grp", "suppliers", "available_slabs", "total_slabs")


_KEYS = ", k AS (SELECT material_key, split_part(material_key, '|', 1) AS base, split_part(material_key, '|', -1) AS type, count(DISTINCT supplier_id) AS suppliers, CAST(sum(available_slabs) AS BIGINT) AS slabs FROM materials GROUP BY 1)"


@query(_KEYS + """, c AS (SELECT base, arg_min(material_key, (CAST(type IN ('other', 'natural stone', '') AS INT), -suppliers, -slabs, material_key)) AS canonical, CAST(sum(suppliers) AS BIGINT) AS suppliers, CAST(sum(slabs) AS BIGINT) AS slabs FROM k GROUP BY 1 HAVING count(DISTINCT type) >= 2)
SELECT row_number() OVER (ORDER BY suppliers DESC, slabs DESC, base) AS nth, * FROM c QUALIFY nth <= 4""")
def q13_conflict_preview(m, s, spark, sf):
    """The four widest of the clusters that wait for a curator."""
    return status.cluster_preview(entity.conflict_clusters(m), ["base"])


@query(_KEYS.replace("FROM materials", "FROM z").replace(", k AS", ", z AS (SELECT * REPLACE (CASE WHEN supplier_id % 2 = 0 THEN replace(material_key, ' ', '-') ELSE material_key END AS material_key) FROM materials), k AS") + """, c AS (SELECT type, regexp_replace(base, '[^a-z0-9]', '', 'g') AS norm, arg_min(material_key, (-suppliers, -slabs, material_key)) AS canonical, CAST(sum(suppliers) AS BIGINT) AS suppliers, CAST(sum(slabs) AS BIGINT) AS slabs FROM k GROUP BY 1, 2 HAVING count(DISTINCT base) >= 2)
SELECT row_number() OVER (ORDER BY suppliers DESC, slabs DESC, type, norm) AS nth, * FROM c QUALIFY nth <= 4""")
def q13_spelling_preview(m, s, spark, sf):
    spelt = m.withColumn("material_key", F.when(F.col("supplier_id") % 2 == 0, F.replace("material_key", F.lit(" "), F.lit("-"))).otherwise(F.col("material_key")))
    return status.cluster_preview(curation.spelling_clusters(spelt), ["type", "norm"])


@query("SELECT source, count(*) FILTER (WHERE id % (nth + 2) = 0) AS hosts, count(*) FILTER (WHERE id % (nth + 2) = 0 AND NOT (nth > 0 AND id % 2 = 0 OR nth > 1 AND id % 3 = 0 OR nth > 2 AND id % 4 = 0 OR nth > 3 AND id % 5 = 0 OR nth > 4 AND id % 6 = 0)) AS new FROM suppliers, (VALUES (0, 'certificates'), (1, 'passive names'), (2, 'scans'), (3, 'host search'), (4, 'subdomains'), (5, 'web search')) t(nth, source) GROUP BY nth, source")
def c23_hosts_by_source(m, s, spark, sf):
    """Hosts in the six forms that public indexes answer in: JSON of names, of records and of pages, a table, a list, and a page of results."""
    h = F.col("host")
    forms = {
        "certificates": F.to_json(F.struct(F.concat(F.lit("*."), h, F.lit(" "), F.upper(h)).alias("name_value"))), "passive names": F.to_json(F.struct(F.array(F.struct(h.alias("hostname"), F.lit("1.2.3.4").alias("address"))).alias("passive_dns"))),
        "scans": F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("https://"), h, F.lit("/slabs?x=1")).alias("url"))).alias("results"))), "host search": F.concat(h, F.lit(",10.0.0.1")),
        "subdomains": F.concat(F.lit('["'), h, F.lit('","api-1.example.com"]')), "web search": F.concat(F.lit('<a href="//x/?u=https%3A%2F%2Fy">'), h, F.lit("</a> <b>other.example.company</b> www.example.com.br")),
    }
    texts = None
    for rank, (source, text) in enumerate(forms.items()):
        one = s.where(F.col("id") % (rank + 2) == 0).select(F.lit(rank).alias("rank"), F.lit(source).alias("source"), text.alias("text"))
        texts = one if texts is None else texts.unionByName(one)
    return feeds.hosts_by_source(texts, "example.com", ("api", "www"))
