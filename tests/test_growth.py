"""Steps that are shared by many rows are made once for all of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import history
from tessera.plans import pages


def test_others_repeat_a_suppliers_row_for_each_page(spark):
    """Each page of a product has all its suppliers; what meets suppliers is a few lists of pages, not the pages one by one."""
    m = spark.range(4000).select(
        F.col("id"), (F.col("id") % 50).alias("supplier_id"), F.concat(F.lit("k"), F.when(F.col("id") % 50 < 48, F.col("id") % 2)).alias("material_key"), F.lit("b").alias("base"), F.lit("2cm").alias("thickness"),
        F.lit("Slab").alias("product_form"), F.lit(1).cast("long").alias("available_slabs"), F.lit("u").alias("image_url"), F.lit("n").alias("item_name"), F.lit("t").alias("material_type"),
    )
    s = spark.range(50).select("id", F.lit("").alias("company"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("host"))
    asked = spark.range(50).select("id").unionByName(spark.range(1).select("id"))  # one twice, two without a key
    others = pages.item_pages(m, s, asked, m.limit(0))["others"]
    rows = others.collect()
    assert others.columns == ["of", "supplier_id", "id", "variants", "slabs", "has_tile", "image_url", "supplier_name"]
    assert sorted((r.of, r.supplier_id) for r in rows) == [(a, b) for a in range(48) for b in range(48) if a % 2 == b % 2]
    assert all((r.id, r.variants, r.slabs, r.has_tile, r.image_url, r.supplier_name) == (r.supplier_id, 80, 80, 0, "u", f"h{r.supplier_id}") for r in rows)
    plan = others._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and plan.index("Generate explode") < plan.index("Join")


def test_others_of_a_product_are_written_next_to_each_other(spark, tmp_path, monkeypatch):
    """A task writes product after product, its pages always in the same order; many pages share the suppliers out, and nothing is told or lost twice."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(pages, "LIST", 4, raising=False)
    monkeypatch.setattr(pages, "SPREAD", 8, raising=False)
    # supplier i has products 0 to 5 as listings i * 6 to i * 6 + 5; its page is that of product i % 6
    m = spark.range(360).select(
        F.col("id"), F.expr("id div 6").alias("supplier_id"), F.concat(F.lit("k"), F.col("id") % 6).alias("material_key"), F.lit("b").alias("base"), F.lit("2cm").alias("thickness"),
        F.lit("Slab").alias("product_form"), F.lit(1).cast("long").alias("available_slabs"), F.lit("u").alias("image_url"), F.lit("n").alias("item_name"), F.lit("t").alias("material_type"),
    )
    s = spark.range(60).select("id", F.lit("").alias("company"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("host"))
    s = s.hint("merge")  # many suppliers are met in the order of their ids
    asked = [i * 6 + i % 6 for i in range(60)]
    pages.item_pages(m, s, spark.createDataFrame([(i,) for i in asked], "id long"), m.limit(0))["others"].write.parquet(str(tmp_path / "out"))
    every = []
    for file in sorted((tmp_path / "out").glob("*.parquet")):
        rows = pq.ParquetFile(file).read().to_pylist()
        products = [r["of"] % 6 for r in rows]
        assert sum(a != b for a, b in zip(products, products[1:], strict=False)) < max(1, len(set(products)))
        by_supplier: dict = {}
        for r in rows:
            by_supplier.setdefault((r["of"] % 6, r["supplier_id"]), []).append(r["of"])
        assert all(len(v) == 10 for v in by_supplier.values()) and len({tuple(v) for v in by_supplier.values()}) == len(set(products))
        every += [(r["of"], r["supplier_id"], r["id"], r["supplier_name"]) for r in rows]
    assert sorted(every) == sorted((a, i, i * 6 + a % 6, f"h{i}") for a in asked for i in range(60))


def test_nightly_figures_read_what_was_written(spark):
    """Figures of the tail come from listings that were written once; the tables beneath are not read and joined again for each."""
    from tessera.upkeep_queries import QUERIES

    found = QUERIES["q15_nightly_stats"](spark, "/root/testdata/sf0.001")
    assert "l_partkey" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert len(found.collect()) == 1


def test_pruned_history_is_made_once(spark):
    """Dates are ranked on the rows themselves; rows without supplier or date go, two dates stay at least."""
    rows = [(d, s, n) for s in (1, 2, None) for d in ("2001-01-01", "2002-01-01", "2003-01-01", "2004-01-01", None) for n in "aab"] + [("2000-01-01", 3, "a")]
    past = spark.createDataFrame(rows, "day string, supplier_id long, name_norm string")
    past = past.groupBy("name_norm", F.col("day").cast("timestamp").alias("snapshot_date"), "supplier_id").agg(F.count(F.lit(1)).alias("slabs"))
    for keep, first in ((1, 2003), (3, 2002)):
        out = history.prune(past, keep)
        assert out.columns == ["supplier_id", "snapshot_date", "name_norm", "slabs"]
        want = [(s, y, n, 1 + (n == "a")) for s in (1, 2) for y in range(first, 2005) for n in "ab"] + [(3, 2000, "a", 1)]
        assert sorted((r.supplier_id, r.snapshot_date.year, r.name_norm, r.slabs) for r in out.collect()) == sorted(want)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Aggregate") == 1 and "Join" not in plan
