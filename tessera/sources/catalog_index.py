"""The product rollup and an inverted index of name tokens, stored under a log of commits and kept up with replaced suppliers.

Three tables are cut into the same buckets by product: `held` (product and supplier), `rollup`
(product) and `postings` (token, product), the last sorted by token in each bucket, so that a prefix
is a range that Parquet's statistics prune. Maxima can't be subtracted: a refresh makes the products
anew that the replaced suppliers had or have, from the stored rows of `held`, and rewrites only the
buckets that have such products.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rollup
from . import commits
from .commits import BUCKET
from .staging import staged

#: Rows of product and supplier for each bucket, about.
PER_BUCKET = 1_000_000
#: Tasks that make the rows of product and supplier of a bucket.
PARTS = 4


def tokens(name: Column) -> Column:
    """The words of a name, lower-cased."""
    return F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda t: t != "")


def _known(materials: DataFrame, suppliers: DataFrame) -> DataFrame:
    return materials.join(suppliers.select(F.col("id").alias("supplier_id")), "supplier_id", "left_semi")


def _held(known: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    return rollup.per_supplier(known, more=(F.collect_set("item_name").alias("names"),), within=within)


def _held_in_buckets(known: DataFrame, n: int) -> DataFrame:
    """The same in its buckets: listings go straight to where their rows are made and written."""
    used = ("id", "supplier_id", "material_key", "item_name", "material_type", "color", "new_arrival", "avg_length", "avg_width", "available_slabs", "product_form", "uom", "image_url")
    part = F.pmod(F.xxhash64("supplier_id"), F.lit(PARTS)).alias("_part")
    dealt = known.select(*used, rollup.group_key().alias("grp")).select("*", commits.bucket_of("grp", n), part).drop("grp").repartition(n * PARTS, BUCKET, "_part")
    return _held(dealt, (BUCKET, "_part")).drop("_part").sortWithinPartitions(BUCKET, "grp", "supplier_id")


def _postings(held: DataFrame) -> DataFrame:
    return held.select("grp", F.explode(F.array_distinct(F.flatten(F.transform("names", tokens)))).alias("token")).distinct()


def _cut(df: DataFrame, n: int, *order: str) -> DataFrame:
    """df in its buckets, a task for each."""
    return df.withColumn(BUCKET, commits.bucket_of("grp", n)).repartition(n, BUCKET).sortWithinPartitions(BUCKET, *order)


def rebuild(spark: SparkSession, path: str, materials: DataFrame, suppliers: DataFrame, per_bucket: int = PER_BUCKET) -> int:
    """Makes all three tables anew; returns the version."""
    base, _ = commits.manifest(spark, path)
    known = _known(materials, suppliers)
    rows = known.agg(F.approx_count_distinct(F.xxhash64(rollup.group_key(), "supplier_id")).alias("n")).first()["n"]
    n = max(1, -(-rows // per_bucket))
    tables = {
        "held": _held_in_buckets(known, n),
        "rollup": lambda made: _cut(rollup.across_suppliers(made["held"]), n, "grp"),
        "postings": lambda made: _cut(_postings(made["held"]), n, "token", "grp"),
    }
    return commits.commit(spark, path, base, tables, note={"buckets": n})


def ensure(spark: SparkSession, path: str, materials: DataFrame, suppliers: DataFrame) -> int:
    """Makes the tables where there are none, or empty ones though there are materials; returns the version."""
    version, now = commits.manifest(spark, path)
    complete = all(now.get("tables", {}).get(t, {}).get("folders") for t in ("held", "rollup", "postings"))
    return version if complete or materials.limit(1).count() == 0 else rebuild(spark, path, materials, suppliers)


def refresh(spark: SparkSession, path: str, replaced: DataFrame, materials: DataFrame, suppliers: DataFrame) -> int:
    """The tables after all materials of some suppliers (replaced: supplier_id) have given way to new ones (materials, of those suppliers only). Returns the version."""
    base, now = commits.manifest(spark, path)
    n = now["note"]["buckets"]
    gone = F.broadcast(replaced.select("supplier_id").distinct())  # numbers of storefronts; what is stored stays where it lies
    fresh = staged(_held(_known(materials.join(gone, "supplier_id", "left_semi"), suppliers)), "fresh")
    had = commits.table(spark, path, "held", base).join(gone, "supplier_id", "left_semi").select("grp")
    touched = staged(had.unionByName(fresh.select("grp")).distinct().withColumn(BUCKET, commits.bucket_of("grp", n)), "touched")
    buckets = [r[0] for r in touched.select(BUCKET).distinct().collect()]
    if not buckets:
        return base
    products = touched.select("grp")
    old = {t: commits.table(spark, path, t, base, buckets) for t in ("held", "rollup", "postings")}
    held = old["held"].join(gone, "supplier_id", "left_anti").select(*fresh.columns).unionByName(fresh)
    again = lambda made: made["held"].join(products, "grp", "left_semi")
    tables = {
        "held": _cut(held, n, "grp", "supplier_id"),
        "rollup": lambda made: _cut(old["rollup"].join(products, "grp", "left_anti").unionByName(rollup.across_suppliers(again(made))), n, "grp"),
        "postings": lambda made: _cut(old["postings"].join(products, "grp", "left_anti").unionByName(_postings(again(made))), n, "token", "grp"),
    }
    return commits.commit(spark, path, base, tables, replacing=dict.fromkeys(tables, buckets))


def prefix_range(column: str, prefix: str) -> Column:
    """Whether a token begins with the prefix, as a range."""
    return (F.col(column) >= prefix) & (F.col(column) < prefix[:-1] + chr(ord(prefix[-1]) + 1))


def with_prefixes(postings: DataFrame, prefixes: list[str]) -> DataFrame:
    """(grp): products that have, for every prefix, a token that begins with it."""
    wanted = sorted(set(prefixes))
    ranges = [prefix_range("token", p) for p in wanted]
    met = postings.where(reduce(lambda a, b: a | b, ranges))
    return met.groupBy("grp").agg(*(F.max(r).alias(f"_{i}") for i, r in enumerate(ranges))).where(reduce(lambda a, b: a & b, (F.col(f"_{i}") for i in range(len(wanted))))).select("grp")
