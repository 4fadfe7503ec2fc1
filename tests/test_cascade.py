"""Removals from declared keys, all tables compared; sitemaps of sitemaps against a plain walk."""

import random
import re

import pytest

from tessera.operators import cascade
from tessera.operators.cascade import Key
from tessera.sources import feeds


def tables(spark):
    return {
        "suppliers": spark.createDataFrame([(1, "a.com", "A", "t", "a@x", 3, 4, ""), (2, "b.com", "B", "t", "b@x", 9, 9, "")], "id long, host string, company string, token string, email string, item_count long, slab_count long, last_error string"),
        "materials": spark.createDataFrame([(1, "i", "Slate", "u1"), (1, "j", "Onyx", "u2"), (1, "k", None, ""), (2, "i", "Slate", "u2"), (2, "z", "Onyx", "u3"), (2, "", "Marble", None)], "supplier_id long, item_id string, material_type string, image_url string"),
        "slabs": spark.createDataFrame([(1, "i", 1), (1, "j", 2), (1, "q", 3), (1, None, 4), (2, "i", 5), (2, "z", 6)], "supplier_id long, item_id string, slab int"),
        "history": spark.createDataFrame([(1, "x"), (2, "x")], "supplier_id long, name_norm string"),
        "vectors": spark.createDataFrame([("u1",), ("u2",), ("u3",), ("",), ("other",)], "image_url string"),
        "list_items": spark.createDataFrame([(1, "i"), (2, "i")], "supplier_id long, item_id string"),
        "seen": spark.createDataFrame([("sig",)], "sig string"),
    }


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_purge(spark):
    before = tables(spark)
    after, counts = cascade.purged(before, spark.createDataFrame([("A.com",), ("unknown.com",)], "host string"))
    assert set(after) == set(before)
    assert rows(after["materials"]) == rows(before["materials"].where("supplier_id = 2")) and rows(after["history"]) == ["(2, 'x')"]
    assert rows(after["slabs"]) == rows(before["slabs"].where("supplier_id = 2"))
    # the photo that both show was theirs: its vector goes; empty addresses name none
    assert rows(after["vectors"]) == ["('',)", "('other',)", "('u3',)"]
    assert rows(after["list_items"]) == rows(before["list_items"]) and rows(after["seen"]) == ["('sig',)"]
    kept = {r.id: r for r in after["suppliers"].collect()}
    assert (kept[1].host, kept[1].company, kept[1].token, kept[1].email, kept[1].item_count, kept[1].slab_count, kept[1].last_error) == ("a.com", None, None, None, 0, 0, cascade.REMOVED)
    assert kept[2] == [r for r in before["suppliers"].collect() if r.id == 2][0]
    assert {(r["table"], r.supplier_id): r.removed for r in counts.collect()} == {("materials", 1): 3, ("slabs", 1): 4, ("history", 1): 1}
    again, counts = cascade.purged(after, spark.createDataFrame([("a.com",)], "host string"))
    assert all(rows(again[n]) == rows(after[n]) for n in after) and counts.count() == 0


def test_rescope(spark):
    before = tables(spark)
    scopes = spark.createDataFrame([("a.com", "Slate"), ("b.com", "Nothing"), ("c.com", "Slate")], "host string, material_type string")
    after = cascade.rescoped(before, scopes)
    assert rows(after["materials"]) == rows(before["materials"].where("supplier_id = 2 or material_type = 'Slate'"))
    assert rows(after["slabs"]) == rows(before["slabs"].where("supplier_id = 2 or slab = 1"))
    assert {(r.id, r.item_count, r.slab_count) for r in after["suppliers"].collect()} == {(1, 1, 1), (2, 9, 9)}  # a skipped scope leaves counts alone
    assert all(rows(after[n]) == rows(before[n]) for n in ("history", "vectors", "list_items"))
    marble = cascade.rescoped(before, spark.createDataFrame([("b.com", "Marble")], "host string, material_type string"))
    assert rows(marble["materials"]) == rows(before["materials"])  # its only listing of the type has no item


def test_order(spark):
    assert cascade.order(cascade.PURGE, "suppliers") == ["suppliers", "history", "materials", "slabs", "vectors"]
    assert cascade.order(cascade.RESCOPE, "materials") == ["materials", "slabs"]
    chain = (Key("c", ("b",), "b", ("id",)), Key("b", ("a",), "a", ("id",)), Key("c", ("a",), "a", ("id",)))
    assert cascade.order(chain, "a") == ["a", "b", "c"]
    with pytest.raises(ValueError):
        cascade.order((*chain, Key("b", ("c",), "c", ("id",))), "a")
    t = {"a": spark.createDataFrame([(1,), (2,)], "id long"), "b": spark.createDataFrame([(10, 1), (20, 2)], "id long, a long"), "c": spark.createDataFrame([(1, 10, 2), (2, 20, 2), (3, 20, 1), (4, 20, None), (5, None, 2)], "k long, b long, a long")}
    done = cascade.removal(t, chain, "a", spark.createDataFrame([(1,)], "id long"), ("id",))
    assert sorted(r.k for r in done["c"][1].collect()) == [1, 3] and sorted(r.k for r in done["c"][0].collect()) == [2, 4, 5]


def walk(maps, roots, depth=3):
    """Pages by the fewest levels, a level at a time."""
    out, seen, front = {}, set(roots), list(roots)
    for level in range(depth + 1):
        after = []
        for m in front:
            locs = re.findall(r"<loc>\s*([^<]+?)\s*</loc>", maps.get(m, ""), re.I)
            children = [u for u in locs if u.lower().endswith(".xml")]
            after += [u for u in children if u not in seen and not seen.add(u)]
            for u in [] if children else locs:
                out.setdefault(u, level)
        front = after
    return out


def test_sitemaps_of_sitemaps(spark):
    r = random.Random(6)
    names = [f"http://x/{i}.{'XML' if i % 5 == 0 else 'xml'}" for i in range(60)]
    maps = {}
    for n in names[:-5]:  # some maps have not landed
        some = r.sample(names, r.randrange(1, 3)) if r.random() < 0.6 else [f"http://x/p{r.randrange(200)}" for _ in range(r.randrange(6))]
        maps[n] = "<urlset>" + "".join(f"<url><LOC>\n {u} </LOC></url>" for u in some + (["http://x/beside"] if r.random() < 0.3 else [])) + "</urlset>"
    maps["chain0.xml"] = "<loc>chain1.xml</loc><loc>chain0.xml</loc>"
    for i in range(1, 6):
        maps[f"chain{i}.xml"] = f"<loc>chain{i + 1}.xml</loc>" if i < 5 else "<loc>too deep</loc>"
    df = spark.createDataFrame([*maps.items(), ("empty.xml", None), (names[0], maps[names[0]])], "url string, body string")
    for roots in (names[:3], ["chain0.xml", names[7]], ["chain2.xml"], ["nowhere.xml", "empty.xml"]):
        got = {x.url: x.depth for x in feeds.expanded_sitemaps(df, spark.createDataFrame([(u,) for u in roots], "url string")).collect()}
        assert got == walk(maps, roots), roots
