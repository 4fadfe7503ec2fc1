"""Catalog operators on small hand-written rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import normalize as N
from tessera.operators import entity, history, ledger, matching, policy, rollup
from tessera.plans import nightly, search
from tessera.sources import store
from tessera.streaming.heartbeat import activity


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).orderBy("i").select(column).collect()]


def test_types(spark):
    rows = [("Quartz", "", "x"), ("Ceramic", "", "DEKTON KERANIUM"), ("", "", "Taj Mahal Quartzite 3cm"), ("12.0", None, "Blue marble"), ("Sink", "", "Silestone X SLAB"), ("", "", "36 GRIT"), ("", "", "gritstone"), ("", "", "slab rack"), (None, None, None)]
    got = one(spark, rows, "a string, b string, n string", N.canonical_type(F.col("a"), F.col("b"), F.col("n")))
    assert got == ["Quartz", "Sintered Stone", "Quartzite", "Marble", "Quartz", "Accessory / Non-Slab", "Other", "Accessory / Non-Slab", "Other"]


def test_keys(spark):
    rows = [("Taj Mahal Quartzite Slab 30mm", "Quartzite"), ("Quartzite Taj Mahal (L & R)", "Quartzite"), ("Cassablanca Polished126.5 x 78.5", "Granite"), ("Quartzite", "Quartzite"), ("Slabs", "Marble"), ("Grey Stone", "Sintered Stone"), ("", "Marble"), ("Blue Granite 2cm Honed", "Marble")]
    key = N.material_key(F.col("n"), F.col("t"))
    got = one(spark, rows, "n string, t string", key)
    assert got == ["taj mahal|quartzite", "taj mahal|quartzite", "cassablanca|granite", "quartzite|quartzite", "slabs|marble", "grey stone|sintered stone", "", "blue granite|marble"]
    assert one(spark, [(k,) for k in got], "k string", N.remap_key(F.col("k"))) == got


def test_finish_color_thickness(spark):
    rows = [("a Polished/Honed", ""), ("a", "Matt"), ("Leathered x", "Unspecified"), ("x", "Textured"), (None, None)]
    assert one(spark, rows, "n string, f string", N.finish(F.col("n"), F.col("f"))) == ["Multiple", "Matte", "Leathered", "Textured", ""]
    assert one(spark, [("White, white",), ("Amarillo Santa Cecilia",), ("12",), ("off-white",)], "c string", N.clean_color(F.col("c"))) == ["White", "", "", "Off-White"]
    assert one(spark, [("Blue Bahia",), ("Off White Marble",), ("Redwood",)], "c string", N.color_in_name(F.col("c"))) == ["Blue", "Off White", ""]
    rows = [("30mm", "", ""), ("3", "", ""), ("0.79", "", "in"), (None, "x 2.0cm", ""), ("1.25", "", "EA"), ("", "", "")]
    assert one(spark, rows, "t string, n string, u string", N.thickness(F.col("t"), F.col("n"), F.col("u"))) == ["3cm", "3cm", "2cm", "2cm", "1.25cm", ""]
    twice = N.repair_inches(N.repair_inches(F.col("t")))
    assert one(spark, [("0.79cm",), ("0.84cm",)], "t string", twice) == ["2cm", "0.84cm"]
    assert one(spark, [(3.13,), (282.84,), (96.0,)], "v double", N.inches(N.inches(F.col("v")))) == [123.2, 111.4, 96.0]
    assert one(spark, [("$1,250.50/sf",), ("$12",), ("Group 3",), (None,)], "p string", N.price(F.col("p"))["amount"]) == [1250.5, 12.0, None, None]


def test_collapsed_counts(spark):
    rows = [(1, 1, "a", "x1", 5, 10.0), (2, 1, "a", "x2", 5, 0.0), (3, 1, "a", None, 5, 10.0), (4, 1, "b", None, 7, 0.0), (5, 2, "c", "", 3, 0.0), (6, 2, "c", None, 4, 0.0)]
    df = spark.createDataFrame([(*r, 1.0, "Slab") for r in rows], "id long, supplier_id long, item_id string, idone string, available_slabs long, avg_length double, avg_width double, product_form string")
    once = rollup.collapse_counts(df)
    want = {1: 2, 2: 0, 3: 0, 4: 7, 5: 0, 6: 4}
    assert {r.id: r.available_slabs for r in once.collect()} == want == {r.id: r.available_slabs for r in rollup.collapse_counts(once).collect()}


def snap(spark, rows):
    return spark.createDataFrame([(dt.date(2024, 1, d), s, n, t, k, "Slate") for d, s, n, t, k in rows], "snapshot_date date, supplier_id long, name_norm string, thickness string, slabs long, material_type string")


def test_digest(spark):
    rows = [(1, 1, "old", "2cm", 50), (2, 1, "up", "2cm", 0), (3, 1, "up", "2cm", 2), (2, 1, "half", "2cm", 10), (3, 1, "half", "2cm", 5), (2, 1, "small", "2cm", 4), (3, 1, "small", "2cm", 1), (2, 1, "gone", "2cm", 3), (2, 1, "moved", "2cm", 3), (3, 1, "moved", "3cm", 3),
            (2, 1, "out", "2cm", 3), (3, 1, "out", "2cm", 0), (1, 2, "a", "2cm", 1), (1, 2, "b", "2cm", 1), (1, 2, "c", "2cm", 1), (9, 2, "a", "2cm", 1), (5, 3, "single", "2cm", 1)]
    h = snap(spark, rows)
    got = {(r.supplier_id, r.name_norm, r.thickness): r.kind for r in history.digest(h).collect()}
    assert got == {(1, "up", "2cm"): "restock", (1, "half", "2cm"): "dropped", (1, "gone", "2cm"): "delisted", (1, "moved", "3cm"): "listed", (1, "out", "2cm"): "soldout"}
    assert [r.supplier_id for r in history.collapsed(h).collect()] == [2]
    assert sorted(map(tuple, history.digest(history.prune(h, 2)).collect())) == sorted(map(tuple, history.digest(h).collect()))


def test_aliases_and_votes(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("x", "y"), ("y", "x"), ("z", "z")]
    for data in (edges, edges[::-1]):
        got = entity.resolve_aliases(spark.createDataFrame(data, "alias_key string, canonical_key string")).collect()
        assert {(r.alias_key, r.canonical_key) for r in got} == {(k, "f") for k in "abcde"}
    rows = [("n", "A"), ("n", "A"), ("n", "B"), ("n", "Other"), ("tie", "A"), ("tie", "B"), ("only", "Other")]
    assert [tuple(r) for r in entity.majority(spark.createDataFrame(rows, "base string, t string"), "base", "t").collect()] == [("n", "A", 2)]


def test_streaks(spark):
    kinds = "ok error error skip error ok error error error".split()
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)], "who int, at int, kind string")
    runs = ledger.error_runs(df, "who", ["at"], F.col("kind") == "error", F.col("kind") == "skip")
    assert [r.streak for r in runs.orderBy("at").collect()] == [0, 1, 2, 3, 0, 1, 2, 3]
    assert ledger.tripped(runs, "who", 3).count() == 1 and ledger.tripped(runs, "who", 4).count() == 0


@pytest.mark.parametrize(
    "best, second, want",
    [((0.97, 0.2, 0.9), (0.94, 0.1, 0.8), "strong"), ((0.97, 0.2, 0.9), (0.955, 0.1, 0.8), "none"), ((0.85, 0.3, 0.8), (0.8, 0.1, 0.76), "strong"), ((0.76, 0.1, 0.6), (0.7, 0.1, 0.5), "likely"), ((0.5, 0.05, 0.4), (0.4, 0.05, 0.3), "uncertain")],
)
def test_confidence(spark, best, second, want):
    df = spark.createDataFrame([(1, "a", *best), (1, "b", *second)], "query_id int, material_key string, best_score double, share double, rank_score double")
    assert matching.identify(df).first().confidence == want


def test_robots(spark):
    body = "user-agent: a\nDisallow: /x\n\nUser-Agent: *\nDisallow: /p\nAllow: /p/ok\nDisallow: /*.pdf$\nDisallow: /same\nAllow: /same # tie"
    rules = policy.robots_rules(spark.createDataFrame([("h", body)], "host string, body string"))
    paths = ["/", "/p/1", "/p/ok/1", "/f.pdf", "/f.pdf?x", "/same", "/x"]
    df = spark.createDataFrame([("h", p) for p in paths], "host string, path string")
    assert {r.path: r.allowed for r in policy.robots_allowed(rules, df, "bot").collect()} == dict(zip(paths, [True, False, True, False, True, True, True], strict=True))
    assert {r.path for r in policy.robots_allowed(rules, df, "A").collect() if not r.allowed} == {"/x"}


def test_store(spark, tmp_path):
    s = spark.createDataFrame([(1, "a.com"), (2, "sub.b.com"), (3, "xb.com")], "id long, host string")
    m = spark.createDataFrame([(1, "u"), (2, "u"), (2, "v"), (3, "w")], "supplier_id long, image_url string")
    v = spark.createDataFrame([("u",), ("v",), ("w",)], "image_url string")
    out = store.purge({"suppliers": s, "materials": m, "vectors": v}, spark.createDataFrame([("B.com",)], "domain string"))
    assert {r.id for r in out["suppliers"].collect()} == {1, 3} and {r.image_url for r in out["vectors"].collect()} == {"u", "w"}
    rows = spark.createDataFrame([(1, "i", None), (1, "i", None), (1, "i", "x"), (1, "i", "x")], "id long, item string, one string")
    assert store.first_of_key(rows, ["item", "one"], ["id"]).count() == 3
    path = str(tmp_path / "t")
    store.write_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, "k")
    store.write_partitions(spark.createDataFrame([(2, "c")], "k int, v string"), path, "k")
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}


def test_query_in_words(spark):
    asked = search.parse("Show me honed calcutta marble 20mm light blue tiles")
    assert (asked.material_type, asked.color, asked.thickness, asked.form, asked.terms) == ("Marble", "light blue", "2cm", "tile", ["honed", "calacatta"])


def test_nightly_tail(spark):
    cols = "id long, supplier_id long, item_id string, idone string, base string, material_key string, item_name string, material_type string, product_form string, uom string, available_slabs long, avg_length double, avg_width double, color string, thickness string, new_arrival int, image_url string"
    row = lambda i, s, base, kind: (i, s, str(i), "x", base, f"{base}|{kind.lower()}", base, kind, "Slab", "EA", 3, 100.0, 50.0, "", "2cm", 0, "u")
    m = spark.createDataFrame([row(1, 1, "a", "Slate"), row(2, 2, "a", "Slate"), row(3, 3, "a", "Other"), row(4, 1, "b", "Onyx")], cols)
    s = spark.createDataFrame([(1, "one.com", "", "a"), (2, "two.com", "", "a"), (3, "three.com", "", "a")], "id long, host string, company string, token string")
    scopes = spark.createDataFrame([("two.com", "Slate"), ("three.com", "Marble")], "host string, material_type string")  # the second would empty a storefront
    aliases = spark.createDataFrame([("b|onyx", "a|slate")], "alias_key string, canonical_key string")
    past = history.snapshots(m.where("false"), F.lit("2024-01-01").cast("date"))
    today = F.lit("2024-01-02").cast("date")
    crawled = past.unionByName(history.snapshots(m.where("supplier_id < 3"), today))
    out = nightly.Tail(m, s, aliases, scopes, crawled, today)
    assert [(r.grp, r.suppliers, r.total_slabs) for r in out.rollup.collect()] == [("a|slate", 3, 12)]
    # today's snapshots of the two suppliers that have one are taken again and marked; doing it again changes nothing
    rows = sorted((r.supplier_id, r.name_norm, r.slabs, r.rebased) for r in out.history.collect())
    assert rows == [(1, "a", 3, 1), (1, "b", 3, 1), (2, "a", 3, 1)]
    again = nightly.Tail(m, s, aliases, scopes, out.history, today)
    assert sorted((r.supplier_id, r.name_norm, r.slabs, r.rebased) for r in again.history.collect()) == rows
    assert out.mirrors.count() == 0 and out.proposals.count() == 0
    assert out.stats.first().asDict() == {"suppliers": 3, "listings": 4, "images": 4, "products": 1}


def test_mirrors_equal_brute_force(spark):
    """Pairs by prefixes of rare items connect the same storefronts as all pairs do."""
    import random

    rng = random.Random(8)
    shops = {}
    for i in range(40):
        near = shops[rng.randrange(i)] if i and rng.random() < 0.7 else set(rng.sample(range(60), rng.randrange(1, 30)))
        shops[i] = {x for x in near if rng.random() > 0.04} | set(rng.sample(range(60), rng.randrange(2)))
    m = spark.createDataFrame([(i, str(x)) for i, items in shops.items() for x in items] + [(1, ""), (2, None)], "supplier_id long, item_id string")
    s = spark.createDataFrame([(i, "T" if i % 3 else "U ") for i in shops] + [(99, None)], "id long, token string")
    for overlap in (0.6, 0.9):
        roots = {i: i for i in shops}

        def root(i, roots=roots):
            return i if roots[i] == i else root(roots[i])

        for i in shops:
            for j in shops:
                if i < j and (i % 3 == 0) == (j % 3 == 0) and shops[i] and shops[j] and len(shops[i] & shops[j]) >= overlap * len(shops[i] | shops[j]) - 1e-9:
                    x, y = sorted((root(i), root(j)))
                    roots[y] = x
        got = {r.node: r.root for r in entity.components(entity.mirror_pairs(m, s, overlap)).collect()}
        assert {i: root(i) for i in shops if root(i) != i} == {i: r for i, r in got.items() if r != i} and len(set(got.values())) > 1


def test_aliases_of_any_length(spark):
    """A chain of 25 edges is followed to its end; cycles and what leads into them have no end."""
    chain = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(25)] + [("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("self", "self")]
    df = spark.createDataFrame(chain, "alias_key string, canonical_key string")
    assert {(r.alias_key, r.canonical_key) for r in entity.resolve_aliases(df).collect()} == {(f"c{i:02d}", "c25") for i in range(25)}
    assert entity.resolve_aliases(df.where("false")).count() == 0


def test_sessions_of_a_stream(spark, tmp_path):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    rows = [(1, at(0, 0), "view"), (1, at(1, 0), "error"), (1, at(5, 0), "view"), (2, at(0, 30), "view"), (3, at(23, 0), "view")]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, event_type string")
    want = {(r.user_id, r.started, r.beats, r.errors) for r in activity(df).collect()}
    assert len(want) == 4
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = activity(stream).writeStream.format("memory").queryName("beats").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.user_id, r.started, r.beats, r.errors) for r in spark.table("beats").collect()}
    assert got == {w for w in want if w[0] != 3}  # the last session is still open at the watermark


def test_page_facts_have_every_colour_in_sql_too(spark):
    """A product whose listings are of several colours: the query's SQL looks at all of them, as its code does."""
    import duckdb

    from tessera.more_queries import ORACLE_SQL
    from tessera.plans import pages
    from tessera.sources.fixture import PREFIX

    key = "red plate|promo"
    rows = [(key, c, 60.0 + i, 40.0, i % 2) for i, c in enumerate(("Red", "Gray, White", "Navy Blue", "", "Red"))]
    con = duckdb.connect()
    con.execute("CREATE TABLE materials (material_key VARCHAR, color VARCHAR, avg_length DOUBLE, avg_width DOUBLE, supplier_id BIGINT)")
    con.executemany("INSERT INTO materials VALUES (?, ?, ?, ?, ?)", rows)
    want = con.execute(ORACLE_SQL["a15_page_facts"].removeprefix(PREFIX)).fetchall()
    m = spark.createDataFrame(rows, "material_key string, color string, avg_length double, avg_width double, supplier_id long")
    got = [(r[0], ",".join(r[1]), *r[2:]) for r in pages.facts(m, [key]).collect()]
    assert got == want and want[0][1] == "Gray,Navy Blue,Red,White"


def test_page_facts_list_more_than_eight_colours(spark):
    """The query lists as many colours of a product as its SQL does, which has no limit."""
    import duckdb

    from tessera.more_queries import ORACLE_SQL, a15_page_facts
    from tessera.sources.fixture import PREFIX

    colours = "Beige Black Blue Brown Gold Gray Green Pink Red White".split()
    rows = [("cold rod|promo", c, 60.0 + i, 40.0, i % 3) for i, c in enumerate(colours)]
    con = duckdb.connect()
    con.execute("CREATE TABLE materials (material_key VARCHAR, color VARCHAR, avg_length DOUBLE, avg_width DOUBLE, supplier_id BIGINT)")
    con.executemany("INSERT INTO materials VALUES (?, ?, ?, ?, ?)", rows)
    want = con.execute(ORACLE_SQL["a15_page_facts"].removeprefix(PREFIX)).fetchall()
    m = spark.createDataFrame(rows, "material_key string, color string, avg_length double, avg_width double, supplier_id long")
    assert [tuple(r) for r in a15_page_facts(m, None, spark, "").collect()] == want and want[0][1] == ",".join(colours)


def test_a_colour_is_looked_at_once_for_each_product(spark):
    """Choices are weighed on (product, colour), of which there are few, and count its listings."""
    rows = [("a", "Gray, White")] * 3 + [("a", None), ("a", "Red"), ("b", "Gray, White")]
    found = rollup.by_choice(spark.createDataFrame(rows, "material_key string, color string"), ["Gray", "Red"])
    assert sorted(map(tuple, found.collect())) == [("Gray", "a", 3), ("Gray", "b", 1), ("Red", "a", 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.rindex("Aggregate [material_key") and "color" in plan[plan.rindex("Aggregate [material_key") :].split("]")[0]


def test_mirrors_ask_for_listings_once(spark):
    """However often what storefronts list is compared, the plan that it comes from runs once."""
    from tessera.operators import entity

    read = spark.sparkContext.accumulator(0)
    mark = F.udf(lambda i: (read.add(1), i)[1], "string")
    m = spark.createDataFrame([(s, str(i)) for s in (1, 2, 3) for i in range(10 * (s // 3), 10 + 10 * (s // 3))], "supplier_id long, item_id string")
    s = spark.createDataFrame([(i, f"h{i}", "t") for i in (1, 2, 3)], "id long, host string, token string")
    found = entity.mirrors(m.withColumn("item_id", mark("item_id")), s)
    assert [tuple(r) for r in found.collect()] == [("h2", "h1", "computed")] and 0 < read.value <= 60


def test_rollup_hashes_listings(spark):
    """Numbers and texts are rolled up apart, by hashing, and make what both together make from each supplier's rows."""
    schema = "id long, supplier_id int, material_key string, item_name string, material_type string, color string, new_arrival int, avg_length double, avg_width double, available_slabs long, product_form string, uom string, image_url string"
    rows = [
        (1, 1, "a|x", "A two", "x", None, 0, 10.0, 20.0, 3, "Slab", "EA", ""), (2, 1, "a|x", "A one", "x", "Red", 1, 11.0, 20.0, 4, "Tile", "SF", None),
        (3, 2, "a|x", None, "y", "", 0, None, 20.0, None, None, None, "https://slabcloud.com/slabs/3.jpg"), (4, 2, "a|x", "A", "y", "", None, 9.0, 1.0, 9, "Slab", "EA", "https://img/4.jpg"),
        (5, 2, None, "bare", None, None, 0, 1.0, 1.0, 1, "Slab", "EA", None), (6, 2, "", "bare", None, None, 0, 1.0, 1.0, 1, "Slab", "EA", ""), (7, 1, "id:5", "named like it", "z", "", 0, 1.0, 1.0, 1, "Slab", "EA", ""),
        (8, 9, "gone|x", "of no supplier", "x", "", 0, 1.0, 1.0, 1, "Slab", "EA", ""),
    ]
    m, s = spark.createDataFrame(rows, schema), spark.createDataFrame([(1,), (2,)], "id int")
    found = rollup.product_rollup(m, s)
    want = rollup.across_suppliers(rollup.per_supplier(m.where("supplier_id <> 9")))
    assert found.columns == want.columns and sorted(map(repr, found.collect())) == sorted(map(repr, want.collect())) and found.count() == 3
    totals = rollup.product_totals(m, s)
    assert sorted(map(repr, totals.collect())) == sorted(map(repr, found.select(*totals.columns).collect()))
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 4


def test_figures_by_type_have_every_listing_of_a_named_type(spark):
    """The query counts the listings of all types that the tables have, as its SQL does; listings of no type and accessories are left out by the operator."""
    import duckdb

    from tessera.operators import rollup
    from tessera.sources.fixture import PREFIX
    from tessera.upkeep_queries import ORACLE_SQL, a6_by_type

    kinds = "SMALL ECONOMY PROMO LARGE STANDARD MEDIUM".split()
    rows = [(k, f"{'old' if j % 2 else 'red'} rod {j}|{k.lower()}", f"{'old' if j % 2 else 'red'} rod {j}") for i, k in enumerate(kinds) for j in range(i + 2)]
    rows += [("", "plain rod|", "plain rod"), ("Accessory / Non-Slab", "sink|accessory", "sink")]
    m = spark.createDataFrame(rows, "material_type string, material_key string, base string")
    con = duckdb.connect()
    con.execute("CREATE TABLE materials (material_type VARCHAR, material_key VARCHAR, base VARCHAR)")
    con.executemany("INSERT INTO materials VALUES (?, ?, ?)", rows)
    want = [(k, i + 2, i + 2) for i, k in enumerate(kinds)]
    assert sorted(map(tuple, a6_by_type(m, None, spark, "").collect())) == sorted(want)
    assert sorted(con.execute(ORACLE_SQL["a6_by_type"].removeprefix(PREFIX)).fetchall()) == sorted(want)
    assert {r.material_type for r in rollup.by_type(m).collect()} == set(kinds)
