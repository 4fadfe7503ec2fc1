"""Facts, aliases and feeds on hand-written rows."""

from tessera.operators import curation, facts
from tessera.sources import feeds

FACTS = "fact int, key string, display_name string, also_known_as array<string>, formation string"


def test_natural_entry_does_not_answer_for_a_manufactured_type(spark):
    known = spark.createDataFrame([(0, "oro|marble", "Oro", None, "natural"), (1, None, "Viatera", ["LX Viatera"], "engineered"), (2, None, "LX", [], "engineered")], FACTS)
    asked = spark.createDataFrame([("oro|marble", "Oro 3cm"), ("oro|quartz", "Oro"), ("oro|quartz", "Oro LX Viatera"), ("oro|quartz", "LXViatera"), ("x|granite", None)], "material_key string, name string")
    got = {(r.material_key, r.name): r.fact for r in facts.lookup(asked, known).collect()}
    assert got == {("oro|marble", "Oro 3cm"): 0, ("oro|quartz", "Oro"): None, ("oro|quartz", "Oro LX Viatera"): 1, ("oro|quartz", "LXViatera"): None, ("x|granite", None): None}


def test_new_alias_never_closes_a_cycle(spark):
    edges = "alias_key string, canonical_key string"
    old = spark.createDataFrame([("a", "b"), ("c", "b")], edges)
    got = curation.add_aliases(old, spark.createDataFrame([("b", "a")], edges)).collect()
    assert sorted(map(tuple, got)) == [("a", "b"), ("c", "b")]
    got = curation.add_aliases(old, spark.createDataFrame([("b", "d"), ("a", "c")], edges)).collect()
    assert sorted(map(tuple, got)) == [("a", "d"), ("b", "d"), ("c", "d")]  # b goes on to d, and with it all that led to b


def test_scope_never_empties_a_storefront(spark):
    m = spark.createDataFrame([(1, "Quartz"), (1, "Marble"), (2, "Marble")], "supplier_id long, material_type string")
    s = spark.createDataFrame([(1, "x"), (2, "y")], "id long, host string")
    scopes = spark.createDataFrame([("x", "Quartz"), ("y", "Quartz")], "host string, material_type string")
    assert sorted(map(tuple, curation.apply_scopes(m, s, scopes).collect())) == [(1, "Quartz"), (2, "Marble")]


def test_products_in_odd_pages(spark):
    html = '<script type="application/ld+json"> [{"@type":["Thing","Product"],"name":"n","offers":[{"price":""},{"price":5}]}] </script><script type=\'application/ld+json\'>{</script>'
    rows = spark.createDataFrame([(1, html), (2, None), (3, "<p>none</p>")], "page_id long, html string")
    assert [(r.page_id, r.name) for r in feeds.products(rows).collect()] == [(1, "n")]


def test_hosts_end_where_they_are_named(spark):
    rows = spark.createDataFrame([(1, "a.x.com b.x.company c.x.com.br D.X.com, api-1.x.com x.com")], "source int, text string")
    assert sorted(r.host for r in feeds.hosts_in(rows, "x.com", ("api",)).collect()) == ["a.x.com", "d.x.com"]
