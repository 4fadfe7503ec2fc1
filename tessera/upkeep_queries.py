"""Queries of upkeep: states, lists, facts, places, feeds, merges and stores, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import labels as L
from .operators import curation, facts, history, lists, matching, photos, rollup, status
from .plans import merge, nightly
from .queries import _DIGEST, PREFIX, SLABS, TILE
from .sources import feeds, fixture, staging, store

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(fixture.materials(spark, sf_dir), fixture.suppliers(spark, sf_dir), spark, sf_dir)
        if sql:
            ORACLE_SQL[f.__name__] = sql.removeprefix("RAW ") if sql.startswith("RAW ") else PREFIX + sql
        return f

    return wrap


def _pick(k, *values):
    """One of the values by a number, from 0."""
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


# --- states ------------------------------------------------------------------------------------

_STATES = """, f AS (SELECT id, host, id % 6 AS e, CASE WHEN id % 4 = 0 THEN 0 ELSE id END AS item_count, id % 5 AS r FROM suppliers),
o AS (SELECT *, CASE WHEN e = 0 THEN 'blocked' WHEN e = 1 THEN 'challenged' WHEN item_count > 0 THEN CASE WHEN e = 2 THEN 'stale' ELSE 'ok' END WHEN e = 2 THEN 'broken' ELSE 'empty' END AS own FROM f),
h AS (SELECT id, host, item_count, CASE WHEN r = 0 THEN 'delisted' WHEN r = 1 AND own NOT IN ('blocked', 'challenged') THEN 'paused' ELSE own END AS status, r > 1 AS crawled FROM o)"""


def _health(s):
    k = F.col("id")
    error = F.coalesce(_pick(k, "X: challenge-blocked: after robots-blocked: no", "Y: challenge-blocked: no", "timeout", "", None, ""), F.lit(""))
    rows = s.select("id", "host", error.alias("last_error"), F.when(k % 4 == 0, 0).otherwise(k).alias("item_count"))
    reach = s.where(k % 5 > 0).select("host", F.when(k % 5 == 1, "paused").otherwise("crawl").alias("reach"))
    return status.health(rows, reach)


@query(_STATES + " SELECT id, status, crawled FROM h")
def x19_supplier_states(m, s, spark, sf):
    return _health(s).select("id", "status", "crawled")


@query(_STATES + " SELECT id, status FROM h ORDER BY NOT crawled, list_position(['broken', 'stale', 'empty', 'blocked', 'challenged', 'ok', 'paused', 'delisted'], status), item_count DESC, host LIMIT 12")
def t10_states_by_priority(m, s, spark, sf):
    return status.by_priority(_health(s)).select("id", "status").limit(12)


_TRIAGE = """, t AS (SELECT host, CASE id % 3 WHEN 0 THEN 'umi' WHEN 1 THEN 'unbuilt' ELSE 'stoneprofits' END AS provider, CASE WHEN id % 7 = 0 THEN 0 WHEN id % 4 = 0 THEN 0 ELSE id END AS items,
CASE WHEN id % 10 = 9 THEN 'rejected' WHEN id % 7 = 0 THEN 'unprobed' WHEN id % 6 = 0 THEN 'blocked' WHEN id % 6 = 1 THEN 'challenged' WHEN id % 6 = 2 THEN 'broken' WHEN id % 4 = 0 THEN 'empty' ELSE 'live' END AS status, CASE WHEN id % 10 = 9 THEN 90 - id % 50 END AS days_left FROM suppliers)"""


def _triage(s):
    k = F.col("id")
    entries = s.select("host", F.when(k % 3 < 2, _pick(k, "umi", "unbuilt", "x")).alias("provider"), (k % 10 == 9).alias("rejected"), F.date_sub(F.lit("2024-04-10").cast("date"), (k % 50).cast("int")).cast("string").alias("rejected_at"))
    probed = s.where(k % 7 != 0).select("host", F.when(k % 4 == 0, F.lit(None)).otherwise(k).alias("item_count"), _pick(k, "robots-blocked:", "challenge-blocked:", "timeout", "", "", "").alias("last_error"))
    return status.triage(entries, probed, F.lit("2024-04-10").cast("date"))


@query(_TRIAGE + " SELECT host, provider, items, status, days_left FROM t")
def q12_triage(m, s, spark, sf):
    return _triage(s)


@query(_TRIAGE + " SELECT provider, count(*) AS total, count(CASE WHEN status = 'live' THEN 1 END) AS live, CAST(sum(items) AS BIGINT) AS materials FROM t GROUP BY 1")
def a29_providers(m, s, spark, sf):
    return status.by_provider(_triage(s))


_PENDING = ", p AS (SELECT (SELECT count(*) FROM (SELECT base FROM materials GROUP BY base HAVING count(DISTINCT material_type) >= 2)) AS conflicts, 0 AS spellings)"


@query(_PENDING + " SELECT conflicts, (SELECT count(DISTINCT material_type || regexp_replace(base, '[^a-z0-9]', '', 'g')) FROM materials) AS spellings FROM p")
def q13_pending(m, s, spark, sf):
    spelt = m.withColumn("material_key", F.when(F.col("supplier_id") % 2 == 0, F.replace("material_key", F.lit(" "), F.lit("-"))).otherwise(F.col("material_key")))
    return status.pending(m, curation.spelling_clusters(spelt))


@query(_STATES + _TRIAGE + _PENDING + " SELECT (SELECT count(*) FROM h WHERE status IN ('broken', 'stale', 'empty')) AS health, (SELECT count(*) FROM t WHERE status = 'unprobed') AS discovery, (SELECT conflicts FROM p) AS quality, (SELECT count(*) FROM h WHERE status IN ('broken', 'stale', 'empty')) + (SELECT count(*) FROM t WHERE status = 'unprobed') + (SELECT conflicts FROM p) AS total")
def n21_badge(m, s, spark, sf):
    return status.badge(_health(s), _triage(s), status.pending(m, curation.spelling_clusters(m)))


@query(" SELECT material_type, count(*) AS listings, count(DISTINCT material_key) AS products FROM materials WHERE material_type NOT IN ('', 'Accessory / Non-Slab') GROUP BY 1")
def a6_by_type(m, s, spark, sf):
    return rollup.by_type(m)


@query("SELECT thickness FROM (SELECT DISTINCT thickness FROM materials) ORDER BY CASE thickness WHEN '' THEN 0 ELSE CAST(replace(thickness, 'cm', '') AS DOUBLE) END, thickness LIMIT 3")
def t9_thicknesses(m, s, spark, sf):
    return m.select("thickness").distinct().orderBy(*rollup.thickness_order()).limit(3)


# --- what users keep ---------------------------------------------------------------------------

_EVENTS = "RAW WITH e AS (SELECT user_id, 'k' || (event_id % 9) AS material_key, ts AS added_at, event_id FROM events)"


def _tray(spark, sf):
    e = fixture.table(spark, sf, "events").select("user_id", F.concat(F.lit("k"), (F.col("event_id") % 9).cast("string")).alias("material_key"), F.col("ts").alias("added_at"), "event_id")
    old = e.where("event_id % 2 = 0 and event_id % 9 < 3").groupBy("user_id", "material_key").agg(F.min("added_at").alias("added_at"))
    return old, e.where("event_id % 2 = 1").select("user_id", "material_key", "added_at")


_TRAY = _EVENTS + """, o AS (SELECT user_id, material_key, min(added_at) AS added_at FROM e WHERE event_id % 2 = 0 AND event_id % 9 < 3 GROUP BY 1, 2),
n AS (SELECT user_id, material_key, min(added_at) AS added_at FROM e WHERE event_id % 2 = 1 GROUP BY 1, 2),
b AS (SELECT *, 0 AS fresh FROM o UNION ALL SELECT *, 1 FROM n WHERE (user_id, material_key) NOT IN (SELECT (user_id, material_key) FROM o)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY fresh, added_at, material_key) AS nth FROM b)"""


@query(_TRAY + " SELECT user_id, material_key, added_at FROM r WHERE fresh = 0 OR nth <= 4")
def m1_tray(m, s, spark, sf):
    return lists.into_tray(*_tray(spark, sf))[0]


@query(_TRAY + " SELECT n.user_id, n.material_key, CASE WHEN fresh = 0 THEN 'exists' WHEN nth <= 4 THEN 'added' ELSE 'full' END AS answer FROM n JOIN r ON r.user_id = n.user_id AND r.material_key = n.material_key")
def m1_tray_answers(m, s, spark, sf):
    return lists.into_tray(*_tray(spark, sf))[1]


@query(_EVENTS + ", o AS (SELECT user_id, material_key, min(added_at) AS added_at FROM e WHERE event_id % 2 = 0 AND event_id % 9 < 3 GROUP BY 1, 2), n AS (SELECT user_id, material_key, min(added_at) AS added_at FROM e WHERE event_id % 2 = 1 AND event_id % 9 > 0 GROUP BY 1, 2), k AS (SELECT * FROM o UNION ALL SELECT * FROM n WHERE (user_id, material_key) NOT IN (SELECT (user_id, material_key) FROM o)) SELECT user_id, material_key, added_at, CASE WHEN material_key = 'k2' THEN 'see this' ELSE '' END AS note FROM k WHERE user_id % 4 <> 0")
def m1_lists(m, s, spark, sf):
    """Items added twice stay once, blank ones don't come in; a note is written, and lists go with their items."""
    old, new = _tray(spark, sf)
    new = new.withColumn("material_key", F.when(F.col("material_key") == "k0", " ").otherwise(F.col("material_key")))
    kept = lists.added(old, new, ["user_id", "material_key"]).withColumn("note", F.lit("")).withColumnRenamed("user_id", "list_id")
    kept = lists.noted(kept, spark.createDataFrame([("k2", "see this")], "material_key string, note string"), ["material_key"])
    every = kept.select("list_id").distinct()
    return lists.without_lists(every, kept, every.where("list_id % 4 = 0"))[1].withColumnRenamed("list_id", "user_id")


@query("SELECT supplier_id AS supplier, 'Please quote:' || chr(10) || string_agg('- ' || item_name || CASE WHEN thickness <> '' THEN ' (' || thickness || ')' ELSE '' END || ': ' || n || ' slabs', chr(10) ORDER BY lower(item_name), '- ' || item_name || CASE WHEN thickness <> '' THEN ' (' || thickness || ')' ELSE '' END || ': ' || n || ' slabs') AS text FROM (SELECT CAST(supplier_id AS VARCHAR) AS supplier_id, item_name, thickness, CAST(sum(available_slabs) AS BIGINT) AS n FROM materials WHERE item_id IN ('1', '2', '3', '5', '8') GROUP BY ALL) GROUP BY 1")
def a32_request_texts(m, s, spark, sf):
    items = m.where(F.col("item_id").isin("1", "2", "3", "5", "8")).groupBy(F.col("supplier_id").cast("string").alias("supplier"), "item_name", "thickness").agg(F.sum("available_slabs").alias("slabs"))
    return lists.request_texts(items)


@query("SELECT min(id) AS first_id, material_key, count(*) AS n FROM materials WHERE new_arrival = 1 GROUP BY material_key")
def q18_new_arrivals(m, s, spark, sf):
    return m.where("new_arrival = 1").groupBy("material_key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))


# --- labels ------------------------------------------------------------------------------------


@query("""RAW SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN p_name ELSE '' END AS blanked, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_type END AS first_one, p_name AS cleaned,
CASE WHEN p_partkey % 2 = 0 THEN 'https://b/Item_Img%20' || p_partkey || '/a%26b.jpg' ELSE '' END AS image, CASE p_partkey % 3 WHEN 0 THEN 'u?width=2400&x' WHEN 1 THEN 'https://slabcloud.com/a.jpg' ELSE 'https://other.com/a_thumb.jpg' END AS large,
CASE p_partkey % 4 WHEN 0 THEN 'https://shop.x/p/1' WHEN 1 THEN 'https://h.com/InventoryDetail/' || p_partkey WHEN 2 THEN 'https://h.com/' ELSE 'https://h.com/' END AS link, 'a' || p_partkey || '-b.com' AS host, 'A' || p_partkey || ' B' AS apex,
p_partkey % 2 = 0 AS geological FROM part""")
def x9_x10_x29_addresses(m, s, spark, sf):
    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    p = fixture.table(spark, sf, "part")
    empty = F.lit("")
    file = F.when(k % 2 == 0, F.concat(F.lit(" Item_Img "), n, F.lit("/a&b.jpg"))).otherwise(F.lit("logo.png"))
    source = F.when(k % 4 == 0, "https://shop.x/p/1").when(k % 4 == 1, "https://h.com/").when(k % 4 == 2, "").otherwise(" https://h.com/ ")
    return p.select(
        "p_partkey", L.not_a_number(F.when(k % 4 == 0, n).when(k % 4 == 1, F.concat(F.lit(" "), "p_name")).when(k % 4 == 2, "10.54").otherwise(None)).alias("blanked"),
        L.first_filled(F.lit(None).cast("string"), F.when(k % 3 == 0, F.col("p_name")).otherwise(empty), F.col("p_type")).alias("first_one"), L.clean_name(F.replace(F.concat(F.lit("\t"), "p_name", F.lit("  ")), F.lit(" "), F.lit(" \n "))).alias("cleaned"),
        L.image_url(F.lit("https://b/"), file).alias("image"), L.full_size(F.when(k % 3 == 0, " u?width=1400&x").when(k % 3 == 1, "https://slabcloud.com/a_thumb.jpg").otherwise("https://other.com/a_thumb.jpg")).alias("large"),
        L.product_url(F.lit("h.com"), F.when(k % 4 == 1, n).otherwise(empty), source).alias("link"), L.plain_host(F.concat(F.lit(" HTTPS://www.A"), n, F.lit("-B.com/x/y"))).alias("host"),
        L.apex_name(F.concat(F.lit("https://www.a"), n, F.lit("-b.co.uk/x"))).alias("apex"), L.geological_origin(F.when(k % 2 == 0, "X.iBlocky.it").otherwise("iblocky.it.com")).alias("geological"),
    )


@query("""RAW WITH e AS (SELECT DISTINCT p_size AS n FROM part) SELECT n, CASE WHEN n * 7 < 90 THEN n * 7 || 's' ELSE printf('%.0f min', round_even(n * 7 / 60.0, 0)) END AS short, printf('%.1f h', n * 5400 / 3600.0) AS long, n || ',000' AS commas, least(100, greatest(0, n * 4 - 100)) AS pct, CASE WHEN n % 5 = 0 THEN '' ELSE '$' || n || ',001' END AS price FROM e""")
def x30_n8_numbers(m, s, spark, sf):
    n = F.col("p_size")
    p = fixture.table(spark, sf, "part").select("p_size").distinct()
    return p.select(
        n.alias("n"), L.elapsed((n * 7).cast("double")).alias("short"), L.elapsed((n * 5400).cast("double")).alias("long"), L.comma((n * 1000).cast("string")).alias("commas"), L.match_percent(n / 50.0).alias("pct"),
        L.whole_price(F.when(n % 5 == 0, "0").otherwise((n * 1000 + 1.25).cast("string"))).alias("price"),
    )


# --- facts -------------------------------------------------------------------------------------

_FACT = "struct<country:string,region:string,confidence:string,sources:array<string>>"
_PRICE = "struct<low:double,high:double,currency:string,basis:string,confidence:string,sources:array<string>>"
_ENTRY = f"key string, display_name string, formation string, provenance string, origin {_FACT}, price {_PRICE}, quarries array<struct<name:string,sources:array<string>>>, at long"


def _entries(spark, sf):
    """An entry for each part: facts with and without sources, known and not, quarries with and without names."""
    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    src = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("u")))
    conf = F.when(k % 5 == 0, "unknown").otherwise("high")
    quarries = F.array(F.struct(F.when(k % 2 == 0, "Q").otherwise("").alias("name"), F.array(F.lit("u")).alias("sources")), F.struct(F.lit("R").alias("name"), F.array().cast("array<string>").alias("sources")))
    return fixture.table(spark, sf, "part").select(
        F.concat(F.lit("Key "), n).alias("key"), F.concat(F.lit("Stone "), n).alias("display_name"), F.when(k % 4 == 0, "engineered").otherwise("natural").alias("formation"), F.when(k % 6 == 0, "looked_up").when(k % 6 == 1, None).otherwise("curated").alias("provenance"),
        F.struct(F.lit("Italy").alias("country"), F.when(k % 2 == 0, "Carrara").otherwise("").alias("region"), conf.alias("confidence"), src.alias("sources")).alias("origin"),
        F.struct(F.lit(60.0).alias("low"), F.when(k % 2 == 0, 100.5).otherwise(60.0).alias("high"), F.when(k % 7 == 0, "EUR").alias("currency"), F.when(k % 2 == 1, "installed").alias("basis"), conf.alias("confidence"), src.alias("sources")).alias("price"),
        quarries.alias("quarries"), k.alias("at"),
    )


@query("RAW SELECT count(*) AS total, count(*) FILTER (WHERE p_partkey % 6 <> 0) AS curated, count(*) FILTER (WHERE p_partkey % 6 = 0) AS looked_up, count(*) AS with_quarries, count(*) FILTER (WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0) AS with_price, count(*) FILTER (WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0) AS with_origin, count(*) FILTER (WHERE p_partkey % 4 = 0) AS engineered FROM part")
def a30_fact_coverage(m, s, spark, sf):
    return facts.coverage(_entries(spark, sf))


@query("RAW SELECT p_partkey AS at, p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AS shown FROM part")
def f23_shown_facts(m, s, spark, sf):
    o = F.col("origin")
    return _entries(spark, sf).select("at", facts.shown(o["sources"], o["confidence"], o["country"]).alias("shown"))


@query("""RAW WITH p AS (SELECT p_partkey AS k, p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AS ok FROM part)
SELECT 'Key ' || k AS key, CASE WHEN NOT ok THEN '' WHEN k % 2 = 0 THEN 'Carrara, Italy' ELSE 'Italy' END AS origin_text, CASE WHEN NOT ok THEN '' ELSE (CASE WHEN k % 7 = 0 THEN '' ELSE '$' END) || CASE WHEN k % 2 = 0 THEN '60–' || (CASE WHEN k % 7 = 0 THEN '' ELSE '$' END) || '100.5 / sq ft' ELSE '60 / sq ft · installed' END END AS price_text,
CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS n_quarries, CASE WHEN ok THEN '' ELSE 'origin,price' END || CASE WHEN k % 2 = 1 THEN CASE WHEN ok THEN '' ELSE ',' END || 'quarries' ELSE '' END AS gaps FROM p""")
def x24_fact_summaries(m, s, spark, sf):
    return facts.summaries(_entries(spark, sf)).withColumn("gaps", F.array_join("gaps", ","))


@query("RAW SELECT 'Key ' || p_partkey AS key, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 5 = 0 THEN 'unknown' ELSE 'high' END AS confidence, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS quarries, CASE WHEN p_partkey % 3 = 0 THEN 'origin,price,' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN '1' ELSE '2' END || ' quarry claim(s)' AS removed FROM part")
def x32_sourced_facts(m, s, spark, sf):
    return facts.sourced(_entries(spark, sf)).select("key", F.col("origin.confidence").alias("confidence"), F.size("quarries").alias("quarries"), F.array_join("removed", ",").alias("removed"))


@query("RAW SELECT 'Key ' || p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN 'new' ELSE 'old' END AS state, p_partkey + CASE WHEN p_partkey % 2 = 0 THEN 1000000 ELSE 0 END AS at FROM part UNION ALL SELECT 'brand new', 'new', 7")
def x32_imported_facts(m, s, spark, sf):
    """Half of the entries come again, under keys in other spelling and twice; the last of them stays, and one that nobody has."""
    old = _entries(spark, sf)
    again = old.where("at % 2 = 0").withColumns({"key": F.upper(F.replace("key", F.lit(" "), F.lit("-"))), "display_name": F.lit("new"), "at": F.col("at") + 1000000})
    more = again.limit(1).withColumns({"key": F.lit("brand new"), "at": F.lit(7).cast("long"), "display_name": F.lit("new")})
    out = facts.imported(old, again.unionByName(again.withColumn("at", F.lit(1).cast("long"))).unionByName(more).unionByName(again.withColumn("display_name", F.lit(""))))
    key = F.when(F.col("key") == "brand new", F.col("key")).otherwise(F.initcap(F.replace("key", F.lit("-"), F.lit(" "))))
    return out.select(key.alias("key"), F.when(F.col("display_name") == "new", "new").otherwise("old").alias("state"), "at")


@query("RAW SELECT p_partkey AS key, p_partkey % 3 = 0 AS bundled FROM part")
def n15_n16_merged_facts(m, s, spark, sf):
    """Bundled entries that are missing come in, looked-up ones take the place of those with their key."""
    p = fixture.table(spark, sf, "part").select(F.col("p_partkey").alias("key"))
    own = facts.merged(p.where("key % 3 <> 0").withColumn("bundled", F.lit(False)), p.withColumn("bundled", F.lit(True)), "key")
    return facts.latest(own, own.where("key % 6 = 1"), "key")


@query("SELECT DISTINCT material_type, CASE material_type WHEN 'PROMO' THEN 'seal it' WHEN 'SMALL' THEN 'no acid' END AS care FROM materials")
def n17_care(m, s, spark, sf):
    return facts.with_care(m.select("material_type").distinct(), spark.createDataFrame([(" promo ", "seal it"), ("Small", "no acid"), ("x", "y")], "type string, care string"))


@query("RAW SELECT doc_id, doc_id % 4 = 0 AS about FROM documents")
def x31_about(m, s, spark, sf):
    k = F.col("doc_id")
    title = F.when(k % 4 == 0, "Black-Galaxy (stone)").when(k % 4 == 1, "Black Galaxy").when(k % 4 == 2, "Black Widow").otherwise("")
    body = F.when(k % 4 == 0, "A GRANITE quarried in India.").when(k % 4 == 1, "A rock band.").otherwise("Granite.")
    return fixture.table(spark, sf, "documents").select("doc_id", facts.about(F.lit("black  galaxy"), title, body).alias("about"))


# --- places ------------------------------------------------------------------------------------


def _places(spark, sf):
    n = fixture.table(spark, sf, "nation")
    key = F.col("n_nationkey")
    name = F.concat(F.lit("Town "), F.translate(key.cast("string"), "0123456789", "abcdefghij"))
    city = lambda state, people, lat: n.select(name.alias("name"), F.lit(state).alias("state"), F.lit("US").alias("country"), F.lit(people).alias("population"), (key + lat).cast("double").alias("lat"), F.lit(0.0).alias("lon"))
    cities = city("TX", 900, 100).unionByName(city("OH", 100, 200)).unionByName(city("ME", 500, 300).where(F.col("lat") % 2 == 0))
    zips = n.select(F.lpad(key.cast("string"), 5, "0").alias("zip"), key.cast("double").alias("lat"), F.lit(1.0).alias("lon"), F.lit("z").alias("label"))
    hand = n.where(key == 24).select(F.lit(" By Hand ").alias("name"), F.lit(7.0).alias("lat"), F.lit(8.0).alias("lon"), F.lit("").alias("label"))
    text = (
        F.when(key == 24, "by hand").when(key % 7 == 0, F.concat(F.lpad(key.cast("string"), 5, "0"), F.lit("-1234"))).when(key % 7 == 1, F.concat(name, F.lit(", oh."))).when(key % 7 == 2, F.upper(name))
        .when(key % 7 == 3, F.concat(F.lit("BF - "), name, F.lit(" | yard"))).when(key % 7 == 4, F.concat(F.lit("our big "), name, F.lit(" yard 3"))).when(key % 7 == 5, F.concat(name, F.lit(", zz"))).otherwise("abcd")
    )
    return n.select(key.alias("k"), text.alias("location")), hand, zips, cities


_PLACED = """RAW WITH n AS (SELECT n_nationkey AS k, n_nationkey % 2 = 0 AS unsure FROM nation) SELECT k, CASE WHEN k = 24 THEN 7.0::DOUBLE WHEN k % 7 = 0 THEN k::DOUBLE WHEN k % 7 = 1 THEN k + 200.0::DOUBLE WHEN k % 7 IN (2, 3, 4, 5) THEN k + 100.0::DOUBLE END AS lat,
CASE WHEN k = 24 THEN 'override' WHEN k % 7 = 0 THEN 'zip' WHEN k % 7 = 1 THEN 'state' WHEN k % 7 = 2 THEN CASE WHEN unsure THEN 'ambiguous' ELSE 'exact' END WHEN k % 7 IN (3, 4, 5) THEN CASE WHEN unsure THEN 'ambiguous' ELSE 'parsed' END END AS source FROM n"""


@query(_PLACED)
def x15_n3_resolved_places(m, s, spark, sf):
    at, hand, zips, cities = _places(spark, sf)
    found = facts.resolved(at.select("location").distinct(), hand, zips, cities)
    return at.join(found, "location").select("k", "lat", "source")


@query(_PLACED.replace("SELECT k, CASE WHEN k = 24", "SELECT k, CASE WHEN k % 5 = 0 THEN -1.0::DOUBLE WHEN k = 24").replace("CASE WHEN k = 24 THEN 'override'", "CASE WHEN k % 5 = 0 THEN 'known' WHEN k = 24 THEN 'override'"))
def n2_all_resolved(m, s, spark, sf):
    at, hand, zips, cities = _places(spark, sf)
    at = at.withColumn("location", F.when(F.col("location") == "abcd", F.concat(F.lit("abc"), F.col("k").cast("string"))).otherwise(F.col("location")))
    known = at.where("k % 5 = 0").select("location", F.lit(-1.0).alias("lat"), F.lit(0.0).alias("lon"), F.lit("l").alias("label"), F.lit("known").alias("source"))
    return at.join(facts.all_resolved(known, at, hand, zips, cities), "location").select("k", "lat", "source")


# --- feeds -------------------------------------------------------------------------------------


@query("RAW SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'REMNANT' WHEN 1 THEN 'TILE' ELSE 'SLAB' END AS form, CASE WHEN p_partkey % 2 = 0 THEN 'Granite' ELSE '' END AS composition, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN '$5' ELSE '' END AS price FROM part")
def n7_forms_and_prices(m, s, spark, sf):
    k = F.col("p_partkey")
    return fixture.table(spark, sf, "part").select(
        "p_partkey", feeds.form_of_group(_pick(k, "Granite REMNANTS", "Porcelain tile", None)).alias("form"), feeds.composition(_pick(k, " Granite / Polished", None)).alias("composition"), feeds.shown_price(_pick(k, "call", "Login for Price", " $5 ", None)).alias("price")
    )


@query("""RAW SELECT 'i' || p_partkey AS item_id, CASE WHEN p_partkey % 2 = 0 THEN 'east' ELSE 'west' END AS branch, p_name AS item_name, CASE WHEN p_partkey % 3 = 0 THEN 'Quartzite' ELSE 'Tile stock' END AS category, CASE WHEN p_partkey % 3 = 0 THEN 'REMNANT' ELSE 'TILE' END AS product_form,
coalesce(n, 0) AS available_slabs, l AS avg_length, w AS avg_width, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS new_arrival FROM part LEFT JOIN (SELECT l_partkey AS k, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n, round(avg(CASE WHEN l_linenumber > 1 THEN l_quantity END), 1) AS l, round(avg(CASE WHEN l_linenumber > 1 THEN l_linenumber::DOUBLE END), 1) AS w FROM lineitem WHERE l_partkey % 4 = 0 GROUP BY 1) ON k = p_partkey""")
def c13_umi(m, s, spark, sf):
    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    one = lambda name: F.to_json(F.struct(F.concat(F.lit(" i"), n).alias("item"), name.alias("MaterialName"), F.when(k % 3 == 0, "Quartzite remnants").otherwise("Tile stock").alias("GroupName"), F.when(k % 5 == 0, True).alias("newArrival"), F.lit(" u ").alias("url")))
    p = fixture.table(spark, sf, "part")
    east = p.where("p_partkey % 2 = 0").select(F.lit(0).alias("rank"), F.lit("east").alias("branch"), F.concat(F.lit("﻿[["), one(F.col("p_name")), F.lit("]]")).alias("json"))
    west = p.select(F.lit(1).alias("rank"), F.lit("west").alias("branch"), F.concat(F.lit("["), one(F.when(k % 2 == 0, "second").otherwise(F.col("p_name"))), F.lit("]")).alias("json"))
    li = fixture.table(spark, sf, "lineitem").where("l_partkey % 4 = 0")
    lots = li.select(F.concat(F.lit("i"), F.col("l_partkey").cast("string")).alias("item"), F.col("l_quantity").cast("long").alias("Qty"), F.col("l_quantity").alias("length"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber").cast("double")).alias("wide"))
    return feeds.umi(east.unionByName(west), lots).drop("image_url")


@query("RAW SELECT 'h' || (p_partkey % 3) AS host, CAST(p_partkey AS VARCHAR) AS item_id, p_name AS item_name, 'Granite' AS category, 'Polished' AS finish, '2cm' AS thickness, CAST(p_size AS BIGINT) AS available_slabs, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 4 <> 0 THEN p_size + 0.5::DOUBLE END AS avg_length, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 4 <> 0 THEN 70::DOUBLE END AS avg_width, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '12' END AS price_range FROM part")
def c14_slabware(m, s, spark, sf):
    k = F.col("p_partkey")
    b = F.struct(
        k.alias("id"), F.concat(F.lit(" "), "p_name").alias("nomeMaterial"), F.lit("Granite / x").alias("nomeComposicao"), F.lit("Polished").alias("acabamento"), F.lit("2 cm").alias("nomeEspessura"), F.col("p_size").alias("qtdChapas"),
        F.when(k % 2 == 0, F.concat((F.col("p_size") + 0.5).cast("string"), F.when(k % 4 == 0, " x 70").when(k % 3 == 0, "' x 70").otherwise("'' x 70''"))).alias("averageSize"), F.when(k % 5 == 0, "CALL").otherwise("12").alias("preco1"),
    )
    p = fixture.table(spark, sf, "part").groupBy((k % 3).alias("h"), F.floor(k / 60).alias("page")).agg(F.collect_list(b).alias("rows"))
    text = F.when(F.col("page") % 2 == 0, F.to_json(F.struct(F.to_json("rows").alias("Bundles")))).otherwise(F.to_json(F.struct(F.col("rows").alias("Bundles"))))
    pages = p.select(F.concat(F.lit("h"), F.col("h").cast("string")).alias("host"), text.alias("json"))
    return feeds.slabware(pages.unionByName(pages.where(F.col("host") == "h1")))


@query("""RAW SELECT CASE p_partkey % 3 WHEN 0 THEN 'abc-' || p_partkey WHEN 1 THEN p_partkey || 'ab_c' ELSE CAST(p_partkey AS VARCHAR) END AS item_id, p_name AS item_name, CASE WHEN p_partkey % 2 = 0 THEN 'marble' ELSE 'Countertops' END AS category, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(round_even(p_size / 16.0::DOUBLE * 2.54::DOUBLE * 2, 0) / 2 AS VARCHAR).replace('.0', '') || 'cm' END AS thickness, 'SLAB' AS product_form, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size::BIGINT END AS available_slabs, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '$12.5/sf' END AS price_range FROM part WHERE p_partkey % 11 <> 0""".replace("CAST(round_even(p_size / 16.0::DOUBLE * 2.54::DOUBLE * 2, 0) / 2 AS VARCHAR).replace('.0', '')", "replace(CAST(round_even(p_size / 16.0::DOUBLE * 2.54::DOUBLE * 2, 0) / 2 AS VARCHAR), '.0', '')"))
def c15_stonetrash(m, s, spark, sf):
    """Listings by the ids of their sitemap; those without a title are left out."""
    k = F.col("p_partkey")
    n = F.when(k % 3 == 0, F.concat(F.lit("abc-"), k.cast("string"))).when(k % 3 == 1, F.concat(k.cast("string"), F.lit("ab_c"))).otherwise(k.cast("string"))
    p = fixture.table(spark, sf, "part")
    maps = p.groupBy(F.floor(k / 100).alias("g")).agg(F.array_join(F.transform(F.collect_list(n), lambda x: F.concat(F.lit("<loc>https://x/listings/"), x, F.lit("</loc>"))), "").alias("xml"))
    body = F.to_json(
        F.struct(
            F.when(k % 11 == 0, " ").otherwise(F.col("p_name")).alias("title"), F.when(k % 5 == 0, "Sold").otherwise("ListedForSale").alias("status"), F.col("p_size").alias("qtyUnitsAvailable"), F.struct(F.lit("Countertops").alias("segment")).alias("category"),
            F.when(k % 2 == 0, F.array(F.lit("marble"), F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("materials_Tags"), F.when(k % 3 == 0, 0).otherwise(F.col("p_size")).alias("dimensionThickness_SixteenthInches"), F.when(k % 7 != 0, 12.5).alias("pricePerSqFt_USD"),
        )
    )
    ids = feeds.sitemap_ids(maps.unionByName(maps))
    return feeds.stonetrash(ids.join(p.select(n.alias("id"), body.alias("json")), "id"))


@query("RAW SELECT 'u' || p_partkey AS item_id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'Dekton Blue' END AS item_name, 'Dekton' AS category, CASE WHEN p_partkey % 3 = 0 THEN '2cm' ELSE '' END AS thickness, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE p_size::BIGINT END AS available_slabs, CASE WHEN p_partkey % 5 = 0 THEN 'Austin, TX' ELSE 'TX' END AS origin, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE '$1,250' END AS price_range FROM part WHERE p_partkey % 7 <> 0")
def c17_unbuilt(m, s, spark, sf):
    k = F.col("p_partkey")
    d = F.struct(
        F.concat(F.lit("u"), k.cast("string")).alias("id"), F.when(k % 2 == 0, F.col("p_name")).otherwise("").alias("title"), F.lit("Dekton").alias("brand"), F.lit("Blue").alias("canonicalColor"), F.when(k % 7 == 0, "Tools").otherwise("Stone > Slabs").alias("category_path"),
        F.when(k % 4 == 0, 0).otherwise(F.col("p_size")).alias("quantity"), F.when(k % 6 == 0, "0").otherwise("1250.4").alias("price"), F.struct(F.when(k % 3 == 0, "0.787").alias("height_thickness")).alias("dimensions"), F.struct(F.when(k % 5 == 0, "Austin").otherwise("").alias("city"), F.lit("TX").alias("state")).alias("location"),
    )
    p = fixture.table(spark, sf, "part").groupBy(F.floor(k / 50).cast("int").alias("rank")).agg(F.to_json(F.struct(F.collect_list(d).alias("data"))).alias("json"))
    late = p.select((F.col("rank") + 1000).alias("rank"), F.regexp_replace("json", '"Dekton"', '"Later"').alias("json"))
    return feeds.unbuilt(p.unionByName(late))


@query("RAW SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name AS item_name, CASE p_partkey % 4 WHEN 0 THEN 'Marble' WHEN 1 THEN '' WHEN 2 THEN 'Gneiss' ELSE '' END AS category, CASE p_partkey % 3 WHEN 0 THEN 'Italy' WHEN 1 THEN '' ELSE 'South Africa' END AS origin, CASE WHEN p_partkey % 2 = 0 THEN 'BLOCK' ELSE 'SLAB' END AS product_form, 'Lucido' AS finish, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '2' END AS thickness, p_size::BIGINT AS available_slabs, CASE WHEN p_partkey % 2 = 0 THEN round((p_size + 100.5) / 2.54, 1) END AS avg_length, CASE WHEN p_partkey % 2 = 0 THEN round(150 / 2.54, 1) END AS avg_width FROM part WHERE p_partkey % 9 <> 0")
def c19_iblocky(m, s, spark, sf):
    k = F.col("p_partkey")
    size = F.when(k % 2 == 0, F.concat(F.regexp_replace((F.col("p_size") + 100.5).cast("string"), r"\.", ","), F.lit(" x 150 x 2"))).otherwise("on request")
    c = F.struct(
        k.cast("string").alias("id"), F.concat(F.lit(" "), "p_name").alias("material"), _pick(k, " MARMI", "Altro", "Gneiss", None).alias("petroDesc"), _pick(k, "Italia", "Atlantis", "Sudafrica").alias("origin"), F.when(k % 9 == 0, False).alias("isActive"), F.lit("c").alias("code"),
        F.struct(size.alias("dimensions"), F.array(F.lit("Lucido")).alias("finishes"), F.when(k % 5 != 0, F.array(F.lit("2"))).otherwise(F.array().cast("array<string>")).alias("thickness"), F.col("p_size").alias("availableSlabs")).alias("stats"),
    )
    p = fixture.table(spark, sf, "part").groupBy((k % 2).alias("kind"), F.floor(k / 50).alias("page")).agg(F.to_json(F.struct(F.collect_list(c).alias("commesse"))).alias("json"))
    pages = p.select(F.when(F.col("kind") == 0, "BLOCK").otherwise("SLAB").alias("form"), "json")
    return feeds.iblocky(pages.unionByName(pages))


# --- photos ------------------------------------------------------------------------------------

_HELD = """, q AS (SELECT vec_id AS query_id, embedding AS query, supplier_id AS own, material_key AS true_key FROM vectors WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, material_key, supplier_id, true_key, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(query AS DOUBLE[])), 6) AS score FROM vectors, q WHERE supplier_id <> own),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM s),
c AS (SELECT query_id, any_value(true_key) AS true_key, material_key, max(score) AS best_score, count(*) AS images, count(DISTINCT supplier_id) AS suppliers FROM t WHERE rank < 40 GROUP BY 1, 3),
r AS (SELECT *, images / sum(images) OVER (PARTITION BY query_id) AS share FROM c), e AS (SELECT *, round(best_score * (0.55 + 0.45 * share) * (0.7 + 0.3 * sqrt(suppliers / images)), 6) AS rank_score FROM r),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best_score DESC, material_key) AS nth FROM e) WHERE nth <= 12),
g AS (SELECT *, row_number() OVER w AS rn, lead(best_score) OVER w AS s2, lead(rank_score) OVER w AS r2 FROM n WINDOW w AS (PARTITION BY query_id ORDER BY rank_score DESC, material_key)),
h AS (SELECT *, round(coalesce(best_score - s2, 1.0), 6) AS margin, round(rank_score - coalesce(r2, 0.0), 6) AS lead_ FROM g WHERE rn = 1),
v AS (SELECT *, CASE WHEN margin < 0.02 THEN 'none' WHEN best_score >= 0.95 AND lead_ >= 0.02 THEN 'strong' WHEN round(share, 6) >= 0.25 AND best_score >= 0.80 AND lead_ >= 0.03 THEN 'strong' WHEN round(share, 6) >= 0.12 OR best_score >= 0.75 THEN 'likely' ELSE 'uncertain' END AS confidence FROM h)"""


@query(_HELD + """ SELECT confidence, count(*) AS queries, count(*) FILTER (WHERE confidence <> 'none') AS shown, count(*) FILTER (WHERE confidence <> 'none' AND material_key = true_key) AS right_, round(100.0 * count(*) FILTER (WHERE confidence <> 'none') / count(*), 1) AS shown_pct,
CASE WHEN count(*) FILTER (WHERE confidence <> 'none') > 0 THEN round(100.0 * count(*) FILTER (WHERE confidence <> 'none' AND material_key = true_key) / count(*) FILTER (WHERE confidence <> 'none'), 1) END AS precision_pct FROM v GROUP BY 1""")
def a33_q20_held_out(m, s, spark, sf):
    """How well products are told by photos of other suppliers: a query's own supplier is left out before its 40 best are taken."""
    v = fixture.vectors(spark, sf)
    own = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("supplier_id").alias("own"), "material_key")
    found = matching.identify(matching.consensus(matching.nearest(v, own.drop("material_key"), 40)))
    return photos.evaluation(found, own.select("query_id", "material_key")).withColumnRenamed("right", "right_")


@query("RAW WITH v AS (SELECT vec_id, label, (vec_id % 5) / 100.0 AS margin FROM embeddings) SELECT CASE WHEN margin >= 0.03 THEN 0.03::DOUBLE WHEN margin >= 0.02 THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END AS bucket, count(*) AS queries, round(100.0 * avg(CASE WHEN label % 2 = 0 THEN 1 ELSE 0 END), 1) AS right_pct FROM v GROUP BY 1")
def a33_margins(m, s, spark, sf):
    v = fixture.table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.when(F.col("label") % 2 == 0, "yes").otherwise("no").alias("material_key"), ((F.col("vec_id") % 5) / F.lit(100.0)).alias("margin"))
    return photos.margins(v, v.select("query_id", F.lit("yes").alias("material_key")))


@query("SELECT query_id, material_key, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, material_key) AS nth FROM (SELECT query_id, material_key, max(score) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM (SELECT q.vec_id AS query_id, v.vec_id, v.material_key, round(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM vectors v, vectors q WHERE q.vec_id % 100 = 0)) WHERE rn <= 200 GROUP BY 1, 2)) WHERE nth <= 5")
def w4_best_products(m, s, spark, sf):
    v = fixture.vectors(spark, sf)
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return matching.best_products(v, asked, 5).select("query_id", "material_key", "score")


@query("SELECT base, any_value(arg) AS name, any_value(img) AS photo FROM (SELECT base, first_value(item_name) OVER (PARTITION BY base ORDER BY available_slabs DESC, id) AS arg, first_value(nullif(image_url, '')) OVER (PARTITION BY base ORDER BY image_url = '', available_slabs DESC, id) AS img FROM materials) GROUP BY base")
def n10_cluster_names(m, s, spark, sf):
    members = m.select(F.col("base").alias("cluster"), "item_name", "base", "image_url", F.lit(1).alias("suppliers"), F.col("available_slabs").alias("slabs"), F.col("id").alias("at"))
    return curation.shown_clusters(members).select(F.col("cluster").alias("base"), "name", "photo")


# --- repairs and plans -------------------------------------------------------------------------


@query("SELECT id, CASE WHEN supplier_id % 10 = 3 THEN round(avg_length / 30 * 39.3701, 1) ELSE avg_length / 30 END AS avg_length, CASE WHEN supplier_id % 10 = 4 AND thickness = '1.2cm' THEN '3cm' WHEN supplier_id % 10 = 4 AND thickness = '0.79cm' THEN '2cm' ELSE thickness END AS thickness FROM (SELECT * REPLACE (CASE thickness WHEN '1.2cm' THEN '1.18cm' ELSE thickness END AS thickness) FROM materials)".replace("thickness = '1.2cm' THEN '3cm'", "thickness = '1.18cm' THEN '3cm'"))
def n4_repaired(m, s, spark, sf):
    hosts = lambda digit: s.where(F.col("id") % 10 == digit).select("host")
    rows = m.withColumns({"avg_length": F.col("avg_length") / 30, "thickness": F.when(F.col("thickness") == "1.2cm", "1.18cm").otherwise(F.col("thickness"))})
    once = nightly.repaired(rows, s, hosts(3), hosts(4))
    return nightly.repaired(once, s, hosts(3), hosts(4)).select("id", "avg_length", "thickness")


_SNAP = f", old AS (SELECT date_trunc('year', crawled_at) AS d, supplier_id, base AS name_norm, thickness, product_form, CAST(sum({SLABS}) AS BIGINT) AS slabs FROM materials GROUP BY ALL)"


@query(_SNAP + f" SELECT d AS snapshot_date, supplier_id, CAST(sum(slabs) AS BIGINT) AS slabs, 0 AS rebased FROM old WHERE d <> TIMESTAMP '2001-01-01' GROUP BY 1, 2 UNION ALL SELECT TIMESTAMP '2001-01-01', supplier_id, CAST(sum({SLABS}) AS BIGINT), 1 FROM materials WHERE supplier_id IN (SELECT supplier_id FROM old WHERE d = TIMESTAMP '2001-01-01') GROUP BY supplier_id")
def n1_resnapshot(m, s, spark, sf):
    past = history.snapshots(m, F.date_trunc("year", "crawled_at"))
    again = history.resnapshot(past, m, F.lit("2001-01-01").cast("timestamp"))
    return again.groupBy("snapshot_date", "supplier_id").agg(F.sum("slabs").alias("slabs"), F.max("rebased").alias("rebased"))


@query(_SNAP + ", c AS (SELECT name_norm, thickness, supplier_id, CAST(sum(CASE WHEN d = TIMESTAMP '2001-01-01' THEN slabs END) AS BIGINT) AS latest, CAST(sum(CASE WHEN d = TIMESTAMP '2000-01-01' THEN slabs END) AS BIGINT) AS previous FROM old WHERE d >= TIMESTAMP '2000-01-01' AND supplier_id IN (SELECT supplier_id FROM old WHERE d = TIMESTAMP '2001-01-01') AND supplier_id IN (SELECT supplier_id FROM old WHERE d = TIMESTAMP '2000-01-01') GROUP BY 1, 2, 3) SELECT CASE WHEN previous IS NULL THEN 'listed' ELSE 'restock' END AS kind, count(*) AS n FROM c WHERE latest > 0 AND (previous IS NULL OR previous = 0) GROUP BY 1")
def q7_rebased_alerts(m, s, spark, sf):
    """Across a change of how slabs are counted nothing is said to have fallen; what a reader has seen, and what is beyond a page, isn't shown."""
    past = history.snapshots(m, F.date_trunc("year", "crawled_at"))
    past = past.withColumn("rebased", (F.col("snapshot_date") == F.lit("2001-01-01").cast("timestamp")).cast("int"))
    return history.digest(past).where("kind <> 'delisted'").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(_DIGEST.replace("SELECT k.supplier_id, name_norm", ", g AS (SELECT k.supplier_id, name_norm") + """), w AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind IN ('restock', 'listed') THEN coalesce(latest, 0) WHEN kind = 'dropped' THEN previous - latest ELSE previous END DESC, supplier_id, name_norm, thickness) AS nth FROM g WHERE supplier_id % 2 <> 0) SELECT kind, nth, sig FROM w WHERE nth <= 300""")
def q7_unread_page(m, s, spark, sf):
    """Of the alerts that nobody has seen, each kind has 300 on a page at most, the largest first."""
    alerts = history.digest(history.snapshots(m, F.date_trunc("year", "crawled_at")))
    seen = alerts.where(F.col("supplier_id") % 2 == 0).select("sig")
    return history.shown(history.unread(alerts, seen)).select("kind", "nth", "sig")


_FEW = "CASE WHEN supplier_id % 2 = 0 THEN crawled_at ELSE crawled_at - to_days(400) END"


@query(f", o AS (SELECT s.host, max({_FEW}) AS x FROM materials JOIN suppliers s ON s.id = supplier_id GROUP BY 1), t AS (SELECT s.host, max(crawled_at - to_days(30)) AS y FROM materials JOIN suppliers s ON s.id = supplier_id WHERE s.id % 3 <> 0 GROUP BY 1) SELECT t.host, y AS newest, x IS NULL OR y > x AS moves FROM t LEFT JOIN o ON o.host = t.host")
def j13_merge_plan(m, s, spark, sf):
    ours = {"suppliers": s, "materials": m.withColumn("crawled_at", F.expr("CASE WHEN supplier_id % 2 = 0 THEN crawled_at ELSE crawled_at - interval 400 days END"))}
    theirs = {"suppliers": s, "materials": m.where("supplier_id % 3 <> 0").withColumn("crawled_at", F.expr("crawled_at - interval 30 days"))}
    return merge.plan(ours, theirs)


@query(", z AS (SELECT id FROM suppliers WHERE id % 2 = 1 AND id % 3 <> 0 AND id % 5 <> 0) SELECT supplier_id, material_key, count(*) AS n, CAST(sum(available_slabs) AS BIGINT) AS slabs FROM (SELECT supplier_id, CASE WHEN base = 'red rod' THEN 'folded|x' ELSE material_key END AS material_key, available_slabs * CASE WHEN supplier_id IN (SELECT id FROM z) THEN 2 ELSE 1 END AS available_slabs FROM materials) GROUP BY 1, 2")
def q17_n14_merged(m, s, spark, sf):
    """Hosts that the other catalog, which numbers them otherwise, has read later come over; those in the ledger have done so before."""
    ours = {"suppliers": s, "materials": m.withColumn("crawled_at", F.expr("CASE WHEN supplier_id % 2 = 0 THEN crawled_at ELSE crawled_at - interval 400 days END")), "history": history.snapshots(m, F.date_trunc("year", "crawled_at"))}
    late = m.where("supplier_id % 3 <> 0").withColumns({"crawled_at": F.expr("crawled_at - interval 30 days"), "available_slabs": F.col("available_slabs") * 2, "supplier_id": F.col("supplier_id") + 5000})
    theirs = {"suppliers": s.withColumn("id", F.col("id") + 5000), "materials": late, "history": history.snapshots(late, F.date_trunc("year", "crawled_at"))}
    done = merge.plan(ours, theirs).where("moves").join(s.where("id % 5 = 0").select("host"), "host", "left_semi").select("host", "newest")
    edges = m.where("base = 'red rod'").select(F.col("material_key").alias("alias_key"), F.lit("folded|x").alias("canonical_key")).distinct()
    out = merge.merged(ours, theirs, edges, done)
    return out["materials"].groupBy("supplier_id", "material_key").agg(F.count(F.lit(1)).alias("n"), F.sum("available_slabs").alias("slabs"))


@query(", c AS (SELECT id, supplier_id, item_id, base, material_type FROM materials), r AS (SELECT id, split_part(base, ' ', 1) || ' ' || split_part(base, ' ', 2) AS b FROM c) SELECT id, CASE WHEN b = 'new rod' THEN 'folded|marble' ELSE b || '|' || CASE WHEN b LIKE 'red %' THEN 'marble' ELSE 'other' END END AS material_key FROM r")
def q16_reclassified(m, s, spark, sf):
    """Listings stored under other rules: types come from categories, or the names' siblings, keys from names, and aliases under old keys still fold."""
    stored = m.select("id", "supplier_id", "item_id", F.when(F.col("base").startswith("red ") & (F.col("id") % 4 != 0), "natural marble").otherwise("").alias("category"), F.lit("").alias("subcategory"), "item_name", "color", F.lit("").alias("finish"), "thickness", "uom", "avg_length", "avg_width", "available_slabs", "image_url", "product_form", "new_arrival", F.lit("old").alias("material_key"), F.lit("old").alias("material_type"))
    aliases = spark.createDataFrame([("New Rod 2cm|other", "Folded|Marble")], "alias_key string, canonical_key string").select(F.lower("alias_key").alias("alias_key"), F.lower("canonical_key").alias("canonical_key"))
    return nightly.reclassified(stored, s, aliases)["materials"].select("id", "material_key")


_NIGHT = f""", v AS (SELECT * REPLACE (CASE WHEN base = 'red rod' THEN 'folded|x' ELSE material_key END AS material_key) FROM materials), ok AS (SELECT * FROM v WHERE supplier_id <> 4 OR material_type = 'PROMO'),
r AS (SELECT *, {TILE} AS tile, coalesce(idone, '') <> '' AS named FROM ok), w AS (SELECT *, count(*) OVER i AS n, sum(CAST(named AS INT)) OVER i AS idents, max(available_slabs) OVER i AS most, row_number() OVER (PARTITION BY supplier_id, item_id, tile ORDER BY CASE WHEN named AND avg_length > 0 THEN 0 WHEN named THEN 1 WHEN avg_length > 0 THEN 2 ELSE 3 END, available_slabs DESC, id) AS rn FROM r WINDOW i AS (PARTITION BY supplier_id, item_id, tile)),
k AS (SELECT *, CAST(CASE WHEN tile OR n = 1 THEN available_slabs WHEN rn > 1 THEN 0 WHEN idents > 0 THEN idents ELSE most END AS BIGINT) AS fixed FROM w)"""
#: Suppliers 10 and 20 list what supplier 5 lists, under one token.
_TWINS = _NIGHT.replace("FROM materials)", "FROM (SELECT * EXCLUDE (o, t) REPLACE (t AS supplier_id, id * 100 + t AS id) FROM materials JOIN (VALUES (5, 5), (5, 10), (5, 20)) x(o, t) ON o = supplier_id UNION ALL SELECT * REPLACE (id * 100 AS id) FROM materials WHERE supplier_id NOT IN (5, 10, 20)) q)", 1)


@query(_NIGHT + " SELECT material_key AS grp, count(DISTINCT supplier_id) AS suppliers, CAST(sum(CASE WHEN tile THEN 0 ELSE fixed END) AS BIGINT) AS total_slabs FROM k GROUP BY 1")
def q15_nightly_rollup(m, s, spark, sf):
    return _nightly(m, s).rollup.select("grp", "suppliers", "total_slabs")


@query(_NIGHT + " SELECT (SELECT count(DISTINCT supplier_id) FROM k) AS suppliers, (SELECT count(*) FROM k) AS listings, (SELECT count(*) FROM k WHERE image_url <> '') AS images, (SELECT count(DISTINCT material_key) FROM k) AS products")
def q15_nightly_stats(m, s, spark, sf):
    return _nightly(_landed(m), s).stats


@query(_NIGHT + f""", h AS (SELECT supplier_id, date_trunc('year', crawled_at) AS d, CAST(sum({SLABS}) AS BIGINT) AS slabs, 0 AS rebased FROM materials GROUP BY 1, 2
UNION ALL SELECT supplier_id, TIMESTAMP '2002-01-01', CAST(sum(CASE WHEN tile THEN 0 ELSE fixed END) AS BIGINT), 1 FROM k WHERE supplier_id % 3 <> 0 GROUP BY 1), n AS (SELECT *, dense_rank() OVER (PARTITION BY supplier_id ORDER BY d DESC) AS nth FROM h) SELECT supplier_id, d AS snapshot_date, slabs, rebased FROM n WHERE nth <= 3""")
def q15_nightly_history(m, s, spark, sf):
    """Suppliers whose listings the crawl has snapshotted today have that taken again, marked, from honest counts."""
    return _nightly(m, s).history.groupBy("supplier_id", "snapshot_date").agg(F.sum("slabs").alias("slabs"), F.max("rebased").alias("rebased"))


def _landed(m):
    """Listings as a crawl leaves them, written once: votes, aliases and scopes each read them, and would each make them from their tables."""
    return staging.staged(m.select("id", "supplier_id", "item_id", "idone", "base", "material_key", "material_type", "product_form", "thickness", "available_slabs", "avg_length", "image_url", "crawled_at"), "landed")  # what the tail and snapshots look at


def _twins(m, s):
    """Three storefronts of one catalog, and of one token; what supplier 20 could be has been rejected."""
    pairs = s.where("id in (5, 10, 20)").select(F.col("id").alias("supplier_id"), F.lit(5).alias("_of"))
    five = m.where("supplier_id = 5").withColumnRenamed("supplier_id", "_of").join(pairs, "_of").drop("_of").withColumn("id", F.col("id") * 100 + F.col("supplier_id"))
    rest = m.where("supplier_id not in (5, 10, 20)").withColumn("id", F.col("id") * 100)
    texts = s.withColumns({"token": F.when(F.col("id").isin(5, 10, 20), F.lit("shared")).otherwise(F.concat(F.lit("own"), F.col("id").cast("string"))), "text": F.when(F.col("id").isin(10, 20), F.concat("host", F.lit(" Promo goods"))).otherwise(F.col("host"))})
    rejected = s.where("id = 20").select("host", F.lit("PROMO").alias("material_type"))
    return nightly.Tail(rest.unionByName(five.select(*rest.columns)), texts, *_decided(m, s), history.snapshots(rest, F.date_trunc("year", "crawled_at")), F.lit("2002-01-01").cast("timestamp"), rejected=rejected)


@query(_TWINS + ", c AS (SELECT host, id FROM suppliers WHERE id IN (5, 10, 20)) SELECT host, (SELECT min(host) FROM c) AS mirror_of FROM c WHERE host <> (SELECT min(host) FROM c)")
def q15_nightly_mirrors(m, s, spark, sf):
    return _twins(m, s).mirrors.select("host", "mirror_of")


@query(_TWINS + " SELECT host, CASE WHEN s.id = 10 THEN 'PROMO' END AS material_type, CASE WHEN s.id = 10 THEN (SELECT count(DISTINCT item_id) FROM k WHERE supplier_id = 10 AND material_type = 'PROMO') ELSE 0 END AS matched, CASE WHEN s.id = 10 THEN (SELECT count(DISTINCT item_id) FROM k WHERE supplier_id = 10) ELSE 0 END AS total FROM suppliers s WHERE s.id IN (10, 20)")
def q15_nightly_proposals(m, s, spark, sf):
    return _twins(m, s).proposals


def _decided(m, s):
    edges = m.where("base = 'red rod'").select(F.col("material_key").alias("alias_key"), F.lit("folded|x").alias("canonical_key")).distinct()
    return edges, s.where("id in (4, 8)").select("host", F.when(F.col("id") == 4, "PROMO").otherwise("NOWHERE").alias("material_type"))


def _nightly(m, s):
    past = history.snapshots(m, F.date_trunc("year", "crawled_at")).unionByName(history.snapshots(m.where("supplier_id % 3 <> 0"), F.lit("2002-01-01").cast("timestamp")))
    return nightly.Tail(m, s, *_decided(m, s), past, F.lit("2002-01-01").cast("timestamp"))


# --- stores ------------------------------------------------------------------------------------


def _path(spark, name):
    return f"{staging.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT 'suppliers' AS name, count(*) AS n, count(company) AS filled, 0 AS later FROM suppliers UNION ALL SELECT 'lists', 0, 0, 0")
def c1_c2_c3_published_store(m, s, spark, sf):
    """A snapshot that is published twice and opened in a schema with a column that came later, and a table that isn't there yet."""
    path = store.publish({"suppliers": s.limit(1)}, _path(spark, "store"))
    store.publish({"suppliers": s}, path)
    later = s.schema.add("contact", "string")
    tables = store.opened(spark, path, {"suppliers": later, "lists": spark.createDataFrame([], "company string, contact string").schema})
    one = lambda n: tables[n].agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"), F.count("company").alias("filled"), F.count("contact").cast("int").alias("later"))
    return one("suppliers").unionByName(one("lists"))


@query("SELECT supplier_id, count(*) AS n, max(v) AS v FROM (SELECT supplier_id, 0 AS v FROM materials WHERE supplier_id % 3 <> 0 UNION ALL SELECT supplier_id, 1 FROM materials WHERE supplier_id % 3 = 0 AND product_form = 'Slab') GROUP BY 1")
def c6_replaced_slabs(m, s, spark, sf):
    old = m.select("supplier_id", "id", F.lit(0).alias("v"))
    return store.replace_partitions(old, m.where("supplier_id % 3 = 0 and product_form = 'Slab'").select("supplier_id", "id", F.lit(1).alias("v")), "supplier_id").groupBy("supplier_id").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("v"))


@query("SELECT id, host, CASE WHEN id % 5 = 0 THEN NULL ELSE 'mail' || id END AS email, company FROM suppliers")
def c7_scrubbed_contacts(m, s, spark, sf):
    rows = s.select("id", "host", F.concat(F.lit("mail"), F.col("id").cast("string")).alias("email"), "company")
    return store.scrubbed(rows, s.where("id % 5 = 0").select("host"))


@query("SELECT id, host, company FROM suppliers")
def c8_registry_json(m, s, spark, sf):
    path = _path(spark, "registry")
    s.select("id", "host", "company").write.json(path)
    return store.read_json(spark, path, "id long, host string, company string", strict=True, lines=True)


@query("SELECT true AS strict_fails, count(*) + 1 AS rows, count(*) AS read FROM suppliers")
def c9_c10_corrupt_json(m, s, spark, sf):
    """Where a file is cut short strict reading fails, and lenient reading has a row of nulls for it."""
    path = _path(spark, "corrupt")
    s.select(F.to_json(F.struct("id", "host")).alias("value")).unionByName(spark.createDataFrame([('{"id": 1, "ho',)], "value string")).write.text(path)
    try:
        store.read_json(spark, path, "id long, host string", strict=True, lines=True).count()
        fails = False
        store.read_json(spark, path, "id long, host string", strict=True, lines=True).collect()
    except Exception:
        fails = True
    soft = store.read_json(spark, path, "id long, host string", strict=False, lines=True)
    return soft.agg(F.lit(fails).alias("strict_fails"), F.count(F.lit(1)).alias("rows"), F.count("host").alias("read"))


@query("SELECT id, host, company FROM suppliers")
def c21_q19_csv_export(m, s, spark, sf):
    path = _path(spark, "export")
    store.write_csv(s.select("id", "host", "company"), path, [F.asc("id")])
    back = spark.read.option("header", True).csv(path)
    assert back.columns[0].lstrip("﻿") == "id"
    return back.toDF("id", "host", "company").select(F.col("id").cast("long").alias("id"), "host", F.coalesce("company", F.lit("")).alias("company"))


@query("SELECT '{\"id\":' || id || ',\"host\":\"' || host || '\",\"miles\":null}' AS json FROM suppliers")
def c22_api_rows(m, s, spark, sf):
    return store.to_api(s.select("id", "host", F.lit(None).cast("double").alias("miles")))


@query("RAW SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'Marble' ELSE 'Other' END AS material_type, p_name || '|' || CASE p_type WHEN 'PROMO' THEN 'marble' ELSE 'other' END AS material_key, CASE WHEN split_part(p_name, ' ', 1) = 'red' THEN 'Red' WHEN split_part(p_name, ' ', 1) = 'blue' THEN 'Blue' ELSE '' END AS color, 'Honed' AS finish, '3cm' AS thickness FROM part")
def c20_built_rows(m, s, spark, sf):
    raw = fixture.table(spark, sf, "part").select("p_partkey", F.when(F.col("p_type") == "PROMO", "Natural MARBLE").otherwise("").alias("category"), F.lit(None).cast("string").alias("subcategory"), F.concat("p_name", F.lit(" Honed 3CM (lot 7)")).alias("item_name"), F.lit("1054").alias("color"), F.lit("n/a").alias("finish"), F.lit("").alias("thickness"), F.lit("SF").alias("uom"))
    return nightly.normalized(raw).select("p_partkey", "material_type", "material_key", "color", "finish", "thickness")


@query(f"SELECT date_trunc('year', crawled_at) AS snapshot_date, supplier_id, base AS name_norm, thickness, product_form, CAST(sum({SLABS}) AS BIGINT) AS slabs FROM materials GROUP BY ALL")
def r1_streamed_snapshots(m, s, spark, sf):
    """A stream of landed listings, snapshotted by year: every crawl is cut over three batches, and follows one of other listings."""
    from .streaming import snapshots

    landed, path, state = _path(spark, "landed"), _path(spark, "snapshots"), _path(spark, "stream")
    rows = m.withColumn("crawl", F.lit(2))
    wrong = m.where("product_form = 'Slab'").withColumns({"available_slabs": F.col("available_slabs") * 3, "crawl": F.lit(1)})
    for i, part in enumerate((wrong, *(rows.where(F.pmod("id", F.lit(3)) == j) for j in range(3)))):
        # what has landed by then is a batch, in as many files as it was written in
        part.write.parquet(f"{landed}/{i}")
        snapshots.follow(spark.readStream.schema(rows.schema).parquet(f"{landed}/*"), path, state, "year").awaitTermination()
    return snapshots.read(spark, path).select("snapshot_date", "supplier_id", "name_norm", "thickness", "product_form", "slabs")


# --- gates --------------------------------------------------------------------------------------


@query("""SELECT 'same' AS name, '' AS reason, count(*) AS rows FROM materials UNION ALL SELECT 'older', 'materials: missing color; not known here: nothing', 0 UNION ALL SELECT 'newer', 'materials: missing nothing; not known here: color2', 0 UNION ALL SELECT 'none', 'no table materials', 0""")
def j14_schema_gate(m, s, spark, sf):
    """Of four catalogs of the same listings only the one with our columns may come over."""
    ours, theirs = {"materials": m}, {"same": {"materials": m.select(*sorted(m.columns))}, "older": {"materials": m.drop("color")}, "newer": {"materials": m.withColumn("color2", F.lit(""))}, "none": {}}
    out = None
    for name, tables in theirs.items():
        reason = store.schema_gate(ours, tables)
        rows = tables["materials"] if not reason else m.limit(0)
        one = rows.agg(F.lit(name).alias("name"), F.lit(reason).alias("reason"), F.count(F.lit(1)).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out
