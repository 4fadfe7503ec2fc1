"""Queries of curation, facts and feeds, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import curation, entity, facts
from .queries import _CONFLICT, _weakly_typed, PREFIX, SLABS, TILE
from .sources import feeds, fixture

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def wrap(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(fixture.materials(spark, sf_dir), fixture.suppliers(spark, sf_dir), spark, sf_dir)
        ORACLE_SQL[f.__name__] = sql.removeprefix("RAW ") if sql.startswith("RAW ") else PREFIX + sql
        return f

    return wrap


# --- spellings and aliases ---------------------------------------------------------------------

_SPELT = """, z AS (SELECT CASE WHEN supplier_id % 5 = 0 THEN replace(material_key, ' ', '-') ELSE material_key END AS material_key, supplier_id, available_slabs FROM materials),
k AS (SELECT material_key, split_part(material_key, '|', 1) AS base, split_part(material_key, '|', 2) AS type, count(DISTINCT supplier_id) AS suppliers, CAST(sum(available_slabs) AS BIGINT) AS slabs FROM z GROUP BY material_key),
c AS (SELECT *, 'fuzzy:' || type || ':' || regexp_replace(base, '[^a-z0-9]', '', 'g') AS sig FROM k),
g AS (SELECT *, first_value(material_key) OVER (PARTITION BY sig ORDER BY suppliers DESC, slabs DESC, material_key) AS canonical, count(*) OVER (PARTITION BY sig) AS n FROM c)
"""


def _spelt(m):
    return m.withColumn("material_key", F.when(F.col("supplier_id") % 5 == 0, F.replace("material_key", F.lit(" "), F.lit("-"))).otherwise(F.col("material_key")))


@query(_SPELT + "SELECT material_key, canonical, sig, suppliers, slabs FROM g WHERE n >= 2")
def e4_spelling_clusters(m, s, spark, sf):
    return curation.spelling_clusters(_spelt(m)).select("material_key", "canonical", "sig", "suppliers", "slabs")


@query(_SPELT + "SELECT material_key AS alias_key, canonical AS canonical_key FROM g WHERE n >= 2 AND material_key <> canonical AND sig NOT LIKE 'fuzzy:promo:%'")
def f15_folds_without_rejected(m, s, spark, sf):
    clusters = curation.spelling_clusters(_spelt(m))
    rejected = clusters.where(F.col("type") == "promo").select("sig")
    return curation.fold_edges(curation.without_rejected(clusters, rejected))


@query(_CONFLICT + " SELECT material_key AS alias_key, canonical AS canonical_key FROM c WHERE types >= 2 AND material_key <> canonical")
def n11_folded_conflicts(m, s, spark, sf):
    return curation.fold_edges(entity.conflict_clusters(_weakly_typed(m)))


@query("RAW SELECT 'a' || p_partkey AS alias_key, CASE WHEN p_partkey % 7 IN (1, 2, 3) THEN 'h9' WHEN p_partkey % 7 = 4 THEN 'g5' ELSE 'g' || (p_partkey % 7) END AS canonical_key FROM part UNION ALL SELECT * FROM (VALUES ('g1', 'h9'), ('g2', 'h9'), ('g3', 'h9'), ('h1', 'h9'), ('h0', 'h9'), ('g4', 'g5'), ('x', 'z'), ('y', 'z')) t(a, c)")
def e6_added_aliases(m, s, spark, sf):
    """New aliases that chain with each other and with stored ones; x, y and z would close a cycle."""
    p = fixture.table(spark, sf, "part")
    old = p.select(F.concat(F.lit("a"), F.col("p_partkey").cast("string")).alias("alias_key"), F.concat(F.lit("g"), (F.col("p_partkey") % 7).cast("string")).alias("canonical_key"))
    new = [("g1", "h1"), ("g2", "h0"), ("g3", "h1"), ("h1", "h9"), ("h0", "h1"), ("g4", "g5"), ("x", "y"), ("y", "z"), ("z", "x"), ("same", "same")]
    return curation.add_aliases(old, spark.createDataFrame(new, "alias_key string, canonical_key string"))


@query("RAW SELECT 'a' || p_partkey AS alias_key, 'g' AS canonical_key FROM part WHERE p_partkey % 3 <> 0")
def n20_removed_aliases(m, s, spark, sf):
    p = fixture.table(spark, sf, "part").select("p_partkey", F.concat(F.lit("a"), F.col("p_partkey").cast("string")).alias("alias_key"))
    return curation.without_aliases(p.select("alias_key", F.lit("g").alias("canonical_key")), p.where("p_partkey % 3 = 0"))


@query(", r AS (SELECT DISTINCT CASE WHEN split_part(base, ' ', 1) = lower(material_type) THEN split_part(base, ' ', 2) ELSE base END || '|' || lower(material_type) AS alias_key FROM materials) SELECT alias_key, 'red plate|promo' AS canonical_key FROM r WHERE alias_key <> 'red plate|promo'")
def e9_remapped_aliases(m, s, spark, sf):
    edges = m.select(F.col("material_key").alias("alias_key")).distinct().withColumn("canonical_key", F.lit("red plate|promo"))
    return curation.remapped_aliases(edges, F.col("alias_key"))


# --- storefronts -------------------------------------------------------------------------------

_TEXT = "host || ' ' || company || CASE id % 3 WHEN 0 THEN ' Promo goods' WHEN 1 THEN ' small and large' ELSE '' END"


@query(f""", i AS (SELECT supplier_id, material_type, count(DISTINCT item_id) AS n FROM materials GROUP BY 1, 2), t AS (SELECT supplier_id, count(DISTINCT item_id) AS total FROM materials GROUP BY 1),
h AS (SELECT id, min(material_type) AS material_type, min(n) AS matched FROM suppliers JOIN i ON i.supplier_id = id WHERE regexp_matches(lower({_TEXT}), '\\b' || lower(material_type) || '\\b') GROUP BY id HAVING count(*) = 1)
SELECT host, CASE WHEN s.id % 5 <> 0 THEN material_type END AS material_type, CASE WHEN s.id % 5 <> 0 THEN coalesce(matched, 0) ELSE 0 END AS matched, CASE WHEN matched IS NULL OR s.id % 5 = 0 THEN 0 ELSE total END AS total FROM suppliers s LEFT JOIN h ON h.id = s.id LEFT JOIN t ON t.supplier_id = s.id WHERE s.id % 4 <> 1""")
def e13_scope_proposals(m, s, spark, sf):
    """Of mirrors only; what has been rejected isn't proposed again."""
    rejected = s.where("id % 5 = 0").select("host", F.lit("PROMO").alias("material_type")).unionByName(s.where("id % 5 = 1").select("host", F.lit("NOWHERE").alias("material_type")))
    return curation.scope_proposals(s.withColumn("text", F.expr(_TEXT)), m, s.where("id % 4 <> 1").select("host"), rejected)


@query(", sc AS (SELECT id, CASE WHEN id % 8 = 0 THEN 'NOWHERE' ELSE 'PROMO' END AS scope FROM suppliers WHERE id % 4 = 0), ok AS (SELECT id, scope FROM sc WHERE EXISTS (SELECT 1 FROM materials m WHERE m.supplier_id = sc.id AND m.material_type = scope)) SELECT supplier_id, material_type, count(*) AS n FROM materials LEFT JOIN ok ON ok.id = supplier_id WHERE scope IS NULL OR material_type = scope GROUP BY 1, 2")
def e14_applied_scopes(m, s, spark, sf):
    scopes = s.where("id % 4 = 0").select("host", F.when(F.col("id") % 8 == 0, "NOWHERE").otherwise("PROMO").alias("material_type"))
    return curation.apply_scopes(m, s, scopes).groupBy("supplier_id", "material_type").agg(F.count(F.lit(1)).alias("n"))


# --- saved items and comparisons ---------------------------------------------------------------


@query(f", l AS (SELECT DISTINCT CAST(p_partkey % 50 AS BIGINT) AS supplier_id, CAST(p_partkey AS VARCHAR) AS item_id FROM part), n AS (SELECT supplier_id, item_id, min(id) AS live_id, CAST(sum({SLABS}) AS BIGINT) AS slabs, CAST(sum(CASE WHEN {TILE} AND uom = 'SF' THEN available_slabs ELSE 0 END) AS BIGINT) AS tile_sf FROM materials GROUP BY 1, 2) SELECT l.supplier_id, l.item_id, live_id, slabs, tile_sf, live_id IS NULL AS gone FROM l LEFT JOIN n ON n.supplier_id = l.supplier_id AND n.item_id = l.item_id")
def j4_list_items(m, s, spark, sf):
    saved = fixture.table(spark, sf, "part").select((F.col("p_partkey") % 50).alias("supplier_id"), F.col("p_partkey").cast("string").alias("item_id")).distinct()
    return curation.list_items(saved, m)


@query(f""", y AS (SELECT material_key, supplier_id, sum({SLABS}) AS n FROM materials WHERE material_key IN ('red plate|promo', 'blue widget|small', 'red bolt|small', 'cold gear|promo') GROUP BY 1, 2),
e AS (SELECT material_key, count(*) AS suppliers, CAST(sum(n) AS BIGINT) AS total, CAST(max(n) AS BIGINT) AS deepest FROM y GROUP BY 1)
SELECT *, suppliers = (SELECT max(suppliers) FROM e) AND (SELECT count(*) FROM e WHERE suppliers = (SELECT max(suppliers) FROM e)) = 1 AS wins_suppliers, total = (SELECT max(total) FROM e) AND (SELECT count(*) FROM e WHERE total = (SELECT max(total) FROM e)) = 1 AS wins_total,
  deepest = (SELECT max(deepest) FROM e) AND (SELECT count(*) FROM e WHERE deepest = (SELECT max(deepest) FROM e)) = 1 AS wins_deepest FROM e""")
def q8_compared(m, s, spark, sf):
    return curation.compared(m, ["red plate|promo", "blue widget|small", "red bolt|small", "cold gear|promo"])


# --- facts -------------------------------------------------------------------------------------


@query("SELECT DISTINCT material_key, item_name AS name, CASE WHEN base = 'red bolt' THEN 0 WHEN base = 'blue widget' THEN 1 WHEN regexp_matches(item_name, '\\brod\\b') THEN 2 END AS fact FROM materials")
def j16_fact_of_product(m, s, spark, sf):
    rows = [(0, "red bolt|promo", "Red Bolt", [], "natural"), (1, "x y|z", "Blue Widget", ["none such"], "natural"), (2, "", "Acme Rod", ["rod"], "engineered")]
    known = spark.createDataFrame(rows, "fact int, key string, display_name string, also_known_as array<string>, formation string")
    return facts.lookup(m.select("material_key", F.col("item_name").alias("name")), known)


@query("RAW SELECT n_name AS location, CASE WHEN n_nationkey % 6 = 0 THEN 1.0::DOUBLE WHEN n_nationkey % 6 < 4 THEN n_nationkey::DOUBLE END AS lat, CASE WHEN n_nationkey % 6 = 0 THEN 'override' WHEN n_nationkey % 6 = 1 THEN 'ambiguous' WHEN n_nationkey % 6 < 4 THEN 'exact' END AS source FROM nation")
def x15_places(m, s, spark, sf):
    n = fixture.table(spark, sf, "nation")
    key = F.col("n_nationkey")
    hand = n.where(key % 6 == 0).select(F.upper("n_name").alias("name"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.lit(None).cast("string").alias("label"))
    large = n.where((key % 6 > 0) & (key % 6 < 4)).select(F.col("n_name").alias("name"), F.lit(1000).alias("population"), key.cast("double").alias("lat"), F.lit(0.0).alias("lon"), F.lit("l").alias("label"))
    small = n.where(key % 6 == 1).select(F.col("n_name").alias("name"), F.lit(400).alias("population"), F.lit(-9.0).alias("lat"), F.lit(0.0).alias("lon"), F.lit("s").alias("label"))
    return facts.places(n.select(F.col("n_name").alias("location")), hand, large.unionByName(small)).select("location", "lat", "source")


# --- feeds -------------------------------------------------------------------------------------


@query("RAW SELECT p_partkey AS page_id, p_name AS name, CASE p_partkey % 3 WHEN 2 THEN '' ELSE '$' || (p_partkey * 3) END AS price FROM part WHERE p_partkey % 4 <> 3")
def c18_products_in_pages(m, s, spark, sf):
    p = fixture.table(spark, sf, "part")
    k = F.col("p_partkey")
    offer = F.when(k % 3 == 0, F.format_string('{"price": %d}', k * 3)).when(k % 3 == 1, F.format_string('[{"priceSpecification": [{"price": %d}]}]', k * 3)).otherwise("{}")
    one = F.concat(F.lit('{"@type": "Product", "name": "'), "p_name", F.lit('", "offers": '), offer, F.lit("}"))
    body = F.when(k % 4 == 0, one).when(k % 4 == 1, F.concat(F.lit("["), one, F.lit(', {"@type": "Offer"}]'))).when(k % 4 == 2, F.concat(F.lit('{"@graph": ['), one, F.lit("]}"))).otherwise("{broken")
    html = F.concat(F.lit('<html><script type="application/ld+json">'), body, F.lit("</script></html>"))
    return feeds.products(p.select(k.alias("page_id"), html.alias("html"))).select("page_id", "name", "price")


@query("SELECT host, CASE WHEN id % 2 = 0 THEN 1 ELSE 2 END AS source FROM suppliers WHERE host NOT LIKE 'supplier-000000004%'")
def u2_hosts_in_texts(m, s, spark, sf):
    text = F.concat(F.lit("see https://"), F.upper("host"), F.lit("/x or www."), "host", F.lit(".br; "), "host")
    texts = s.select(F.lit(2).alias("source"), text.alias("text")).unionByName(s.where("id % 2 = 0").select(F.lit(1).alias("source"), F.col("host").alias("text")))
    return feeds.hosts_in(texts, "example.com", ("supplier-000000004",))


@query("SELECT host FROM suppliers WHERE id % 5 <> 0 AND host NOT LIKE '%3.example.com'")
def c24_new_hosts(m, s, spark, sf):
    found = s.select("host").unionByName(spark.createDataFrame([("test.example.com",), ("demo-2.example.com",)], "host string"))
    return feeds.new_hosts(found, s.where("id % 5 = 0"), s.where(F.col("host").endswith("3.example.com")).select(F.col("host").alias("domain")))


@query("SELECT min(id) AS id, upper(item_name) AS name FROM materials GROUP BY upper(item_name)")
def c16_one_per_name(m, s, spark, sf):
    named = m.select("id", F.when(F.col("id") % 2 == 0, F.upper("item_name")).otherwise(F.concat(F.lit("\t"), "item_name")).alias("name"))
    named = named.withColumn("name", F.regexp_replace("name", r"^\t", " "))
    return feeds.one_per_name(named, "name", "id").select("id", F.upper(F.trim("name")).alias("name"))


@query("RAW SELECT DISTINCT p_size, CASE WHEN p_size > 20 THEN round((p_size - 20) / 10 * 39.3701, 1) END AS inches, CASE p_size % 4 WHEN 0 THEN 'SLAB' WHEN 1 THEN 'MOSAIC' WHEN 2 THEN 'TILE' ELSE '' END AS form FROM part")
def x28_metres_and_forms(m, s, spark, sf):
    size = F.col("p_size")
    name = F.when(size % 4 == 0, "A Slab tile").when(size % 4 == 1, "Mosaic Tile").when(size % 4 == 2, "TILES").otherwise("x")
    return fixture.table(spark, sf, "part").select("p_size", feeds.metres_to_inches((size - 20) / 10).alias("inches"), feeds.form_in_name(name).alias("form")).distinct()
