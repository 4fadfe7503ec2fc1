"""Queries of what is stored and followed: the log of commits, the rollup with its index of tokens, and streams with state."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import history
from .plans import merge, search
from .queries import _DIGEST, INNER, PREFIX
from .sources import catalog_index, commits, fixture, staging, store

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(fixture.materials(spark, sf_dir), fixture.suppliers(spark, sf_dir), spark, sf_dir)
        if sql:
            ORACLE_SQL[f.__name__] = sql.removeprefix("RAW ") if sql.startswith("RAW ") else PREFIX + sql
        return f

    return wrap


# --- the stored rollup --------------------------------------------------------------------------

#: Every fourth supplier is read again: its early lots are gone, the others have changed, and each lists one more product.
_AGAIN = """, z AS (SELECT * FROM materials WHERE supplier_id % 4 <> 0 UNION ALL SELECT * REPLACE (available_slabs + 7 AS available_slabs, avg_length - 3 AS avg_length) FROM materials WHERE supplier_id % 4 = 0 AND crawled_at >= TIMESTAMP '1998-01-01'
UNION ALL SELECT * REPLACE (id * 10 AS id, 'fresh find|promo' AS material_key, 'Fresh Find' AS item_name, 'PROMO' AS material_type) FROM materials WHERE id IN (SELECT min(id) FROM materials WHERE supplier_id % 4 = 0 GROUP BY supplier_id))"""


def _again(m):
    own = m.where("supplier_id % 4 = 0")
    late = own.where(F.col("crawled_at") >= F.lit("1998-01-01").cast("timestamp")).withColumns({"available_slabs": F.col("available_slabs") + 7, "avg_length": F.col("avg_length") - 3})
    first = own.join(own.groupBy("supplier_id").agg(F.min("id").alias("id")), ["supplier_id", "id"], "left_semi").select(*m.columns)
    found = first.withColumns({"id": F.col("id") * 10, "material_key": F.lit("fresh find|promo"), "item_name": F.lit("Fresh Find"), "material_type": F.lit("PROMO")})
    return late.unionByName(found)


def _refreshed(m, s, spark):
    path = staging.scratch(spark, "index")
    catalog_index.ensure(spark, path, m, s)
    catalog_index.refresh(spark, path, s.where("id % 4 = 0").select(F.col("id").alias("supplier_id")), _again(m), s)
    return path


@query(_AGAIN + INNER.replace("FROM materials", "FROM z") + "SELECT * FROM rollup_")
def q2_stored_rollup(m, s, spark, sf):
    """What a stored rollup has after every fourth supplier was replaced."""
    return commits.table(spark, _refreshed(m, s, spark), "rollup")


_TOKENS = """, t AS (SELECT DISTINCT material_key AS grp, unnest(list_filter(regexp_split_to_array(lower(item_name), '[^a-z0-9]+'), lambda x: x <> '')) AS token FROM z)"""


@query(_AGAIN + _TOKENS + " SELECT asked, grp FROM (VALUES ('wid'), ('re'), ('2'), ('fresh')) a(asked) JOIN t ON starts_with(token, asked) GROUP BY ALL UNION ALL SELECT 're pla', a.grp FROM (SELECT DISTINCT grp FROM t WHERE starts_with(token, 're')) a JOIN (SELECT DISTINCT grp FROM t WHERE starts_with(token, 'pla')) b ON a.grp = b.grp")
def f12_stored_tokens(m, s, spark, sf):
    """Products by prefixes of their names' words, from the index after the same replacement."""
    postings = commits.table(spark, _refreshed(m, s, spark), "postings")
    every = [catalog_index.with_prefixes(postings, asked.split()).select(F.lit(asked).alias("asked"), "grp") for asked in ("wid", "re", "2", "fresh", "re pla")]
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return out


@query(INNER + _TOKENS.replace("FROM z", "FROM materials") + " SELECT 'tokens' AS way, grp, suppliers, available_slabs, total_sqft FROM rollup_ WHERE material_type = 'PROMO' AND total_sqft >= 40 AND (available_slabs > 0 OR has_tile = 1) AND grp IN (SELECT grp FROM t WHERE starts_with(token, 'polished')) AND grp IN (SELECT grp FROM t WHERE starts_with(token, 'plate')) ORDER BY total_sqft DESC, material_key, grp LIMIT 20")
def q1_search_by_tokens(m, s, spark, sf):
    """A page of whole products of which some name has the words, from the index."""
    path = staging.scratch(spark, "index")
    catalog_index.ensure(spark, path, m, s)
    found = search.search_stored(spark, path, m, s, "polished plate", search.Filters(material_type="PROMO", in_stock=True, min_sqft=40), sort="area", size=20, few=2)
    return found.products.select(F.lit(found.way).alias("way"), "grp", "suppliers", "available_slabs", "total_sqft")


# --- the log ------------------------------------------------------------------------------------


@query("SELECT v.version, supplier_id, count(*) AS n, CAST(sum(available_slabs) AS BIGINT) AS slabs FROM materials, (VALUES (1), (2), (3)) v(version) WHERE v.version = 1 AND supplier_id % 2 = 0 OR v.version = 2 OR v.version = 3 AND supplier_id % 5 <> 0 GROUP BY 1, 2")
def c3_pinned_versions(m, s, spark, sf):
    """Three versions of a store, each still as its readers have pinned it."""
    path = staging.scratch(spark, "store")
    store.publish({"materials": m.where("supplier_id % 2 = 0"), "suppliers": s}, path)
    commits.commit(spark, path, 1, {"materials": m})
    commits.transact(spark, path, lambda now: {"materials": now["materials"].where("supplier_id % 5 <> 0")})
    of = lambda v: commits.table(spark, path, "materials", v).groupBy("supplier_id").agg(F.count(F.lit(1)).alias("n"), F.sum("available_slabs").alias("slabs")).select(F.lit(v).alias("version"), "*")
    return of(1).unionByName(of(2)).unionByName(of(3))


@query("""SELECT host, count(*) AS n, CAST(sum(available_slabs * CASE WHEN s.id % 2 = 1 AND s.id % 3 <> 0 THEN 3 ELSE 1 END) AS BIGINT) AS slabs, s.id % 2 = 1 AND s.id % 3 <> 0 AS moved FROM materials JOIN suppliers s ON s.id = supplier_id GROUP BY host, s.id""")
def q17_committed_merge(m, s, spark, sf):
    """A merge as one version: hosts that the other catalog has read later come over once, also when it is merged again."""
    path, snap = staging.scratch(spark, "store"), lambda rows: history.snapshots(rows, F.date_trunc("year", "crawled_at"))
    ours = m.withColumn("crawled_at", F.expr("CASE WHEN supplier_id % 2 = 0 THEN crawled_at ELSE crawled_at - interval 400 days END"))
    late = m.where("supplier_id % 3 <> 0").withColumns({"crawled_at": F.expr("crawled_at - interval 30 days"), "available_slabs": F.col("available_slabs") * 3, "supplier_id": F.col("supplier_id") + 5000})
    theirs = {"suppliers": s.withColumn("id", F.col("id") + 5000), "materials": late, "history": snap(late)}
    store.publish({"suppliers": s, "materials": ours, "history": snap(ours)}, path)
    merge.merge_into(spark, path, theirs)
    merge.merge_into(spark, path, theirs)
    now = commits.read(spark, path)
    hosts = now["suppliers"].select(F.col("id").alias("supplier_id"), "host")
    return now["materials"].join(hosts, "supplier_id").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("available_slabs").alias("slabs")).join(now["ledger"].select("host", F.lit(True).alias("_m")), "host", "left").withColumn("moved", F.coalesce("_m", F.lit(False))).drop("_m")


# --- streams ------------------------------------------------------------------------------------


@query(_DIGEST)
def q7_streamed_alerts(m, s, spark, sf):
    """The digest from a stream: every crawl is cut over three batches, its end comes with the second, and the third is landed twice."""
    from .streaming import alerts

    landed, out, state = staging.scratch(spark, "landed"), staging.scratch(spark, "alerts"), staging.scratch(spark, "state")
    rows = alerts.crawled(m, F.date_trunc("year", "crawled_at"))
    ends = alerts.ended(rows.select("supplier_id", "day").distinct().withColumn("rebased", F.lit(0)))
    third = F.pmod("id", F.lit(3))
    for i, part in enumerate((rows.where(third == 0), rows.where(third == 1).unionByName(ends), rows.where(third == 2), rows.where(third == 2))):
        # what has landed by then is a batch, in as many files as it was written in
        part.write.parquet(f"{landed}/{i}")
        alerts.follow(spark, spark.readStream.schema(rows.schema).parquet(f"{landed}/*"), out, state, salts=2).awaitTermination()
    return alerts.digest(spark, out)


@query("""RAW WITH e AS (SELECT event_id % 5 AS c, event_id // 100 AS block, event_id % 100 AS nth, ts, event_type, max(ts) OVER () AS now_ FROM events),
r AS (SELECT 'c' || c AS catalog, 'r' || block AS run_id, min(ts) FILTER (WHERE nth < 5) AS started, max(ts) AS beat, max(ts) FILTER (WHERE nth >= 95) AS ended, any_value(now_) AS now_ FROM e WHERE nth < 5 OR event_type = 'click' OR nth >= 95 AND event_type = 'purchase' GROUP BY 1, 2),
n AS (SELECT r.*, max(started) OVER (PARTITION BY catalog) AS newest, EXISTS (SELECT 1 FROM e WHERE 'c' || c = catalog AND 'r' || block = run_id AND nth >= 95 AND event_type = 'purchase') AS done FROM r)
SELECT catalog, run_id, CASE WHEN done THEN 'done' WHEN now_ - beat > INTERVAL 90 MINUTE OR beat < newest THEN 'interrupted' ELSE 'running' END AS state FROM n""")
def r2_run_monitor(m, s, spark, sf):
    """States of runs when the last event comes, from a stream in order of time with timers for those that fall silent."""
    from .streaming import monitor

    e = fixture.table(spark, sf, "events").withColumn("nth", F.col("event_id") % 100)
    e = e.where("nth < 5 or event_type = 'click' or nth >= 95 and event_type = 'purchase'")
    kind = F.when(F.col("nth") < 5, "start").when((F.col("nth") >= 95) & (F.col("event_type") == "purchase"), "finish").otherwise("beat")
    rows = e.select(F.concat(F.lit("c"), (F.col("event_id") % 5).cast("string")).alias("catalog"), F.concat(F.lit("r"), F.floor(F.col("event_id") / 100).cast("string")).alias("run_id"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"), F.lit("done").alias("value"))
    landed, out, state = staging.scratch(spark, "landed"), staging.scratch(spark, "told"), staging.scratch(spark, "state")
    ends = fixture.table(spark, sf, "events").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    step = (ends["hi"] - ends["lo"]) / 4
    parts = [rows.where((F.col("at") > ends["lo"] + i * step) if i else F.lit(True)).where(F.col("at") <= ends["lo"] + (i + 1) * step if i < 3 else F.lit(True)) for i in range(4)]
    # a clock, a day later, moves time on for all
    clock = rows.agg(F.lit("clock").alias("catalog"), F.lit("x").alias("run_id"), (F.max("at") + F.expr("interval 1 day")).alias("at"), F.lit("beat").alias("kind"), F.lit("done").alias("value"))
    for i, part in enumerate((*parts, clock)):
        # what has landed by then is a batch, in as many files as it was written in
        part.write.parquet(f"{landed}/{i}")
        monitor.follow(spark, spark.readStream.schema(rows.schema).parquet(f"{landed}/*"), out, state).awaitTermination()
    return monitor.states(monitor.told(spark, out), F.lit(ends["hi"]))
