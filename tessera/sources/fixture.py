"""Catalog tables projected from the given star-schema tables, for Spark and, as SQL, for the oracle.

materials has one row for each inventory identifier, suppliers one for each storefront, history one
for each yearly snapshot of a supplier's listing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        F.col("s_suppkey").alias("id"),
        F.concat(F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))), F.lit(".example.com")).alias("host"),
        F.when(F.col("s_suppkey") % 7 == 0, F.lit("")).otherwise(F.col("s_name")).alias("company"),
        F.floor(F.col("s_suppkey") / 2).alias("token"),
        F.col("n_name").alias("location"),
        F.when(F.col("s_acctbal") < 0, F.lit("HTTP 503")).otherwise("").alias("last_error"),
    )


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    i = F.col
    return li.join(p, li["l_partkey"] == p["p_partkey"]).select(
        (((i("l_orderkey") * 8 + i("l_linenumber")) * 100000 + i("l_partkey")) * 10000 + i("l_suppkey")).alias("id"),
        i("l_suppkey").alias("supplier_id"),
        i("l_partkey").cast("string").alias("item_id"),
        F.when(i("l_orderkey") % 5 == 0, F.lit(None)).otherwise(F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("idone"),
        i("p_name").alias("base"),
        F.concat_ws("|", "p_name", F.lower("p_type")).alias("material_key"),
        F.concat_ws(" ", "p_name", *_words()).alias("item_name"),
        i("p_type").alias("material_type"),
        F.when(i("l_returnflag") == "R", "Tile").when(i("l_returnflag") == "A", "Remnant").otherwise("Slab").alias("product_form"),
        F.when(i("l_linestatus") == "O", "SF").otherwise("EA").alias("uom"),
        i("l_quantity").cast("long").alias("available_slabs"),
        (60.0 + i("p_size")).alias("avg_length"),
        (40.0 + i("p_partkey") % 50).alias("avg_width"),
        F.when(i("p_name").startswith("red "), "Red").when(i("p_name").startswith("blue "), "Navy Blue").when(i("p_name").startswith("cold "), "Gray, White").otherwise("").alias("color"),
        _thickness().alias("thickness"),
        _price().alias("price_range"),
        (i("l_shipdate") >= F.lit("2001-01-01").cast("timestamp")).cast("int").alias("new_arrival"),
        i("l_shipdate").alias("crawled_at"),
        F.when(i("p_partkey") % 3 == 0, "").when(i("p_partkey") % 3 == 1, F.concat(F.lit("https://cdn.slabcloud.com/slabs/"), i("p_partkey").cast("string"), F.lit(".jpg"))).otherwise(F.concat(F.lit("https://img.example.com/"), i("p_partkey").cast("string"), F.lit(".jpg"))).alias("image_url"),
    )


def _words():
    i = F.col
    size = F.when(i("p_size") % 5 == 0, "2cm").when(i("p_size") % 5 == 1, "3cm").when(i("p_size") % 5 == 2, "20mm").when(i("p_size") % 5 == 3, "1.2cm")
    finish = F.when(i("p_partkey") % 6 == 0, "Polished").when(i("p_partkey") % 6 == 1, "Honed").when(i("p_partkey") % 6 == 2, "Leather").when(i("p_partkey") % 6 == 3, "Polished/Honed")
    return size, finish


def _thickness():
    i = F.col("p_size") % 5
    return F.when(i == 0, "2cm").when(i == 1, "3cm").when(i == 2, "20cm").when(i == 3, "1.2cm").otherwise("")


def _price():
    i, price = F.col("p_partkey"), F.format_string("%.2f", F.col("p_retailprice"))
    return F.when(i % 4 == 0, F.concat(F.lit("$"), price, F.lit("/sf"))).when(i % 4 == 1, F.concat(F.lit("$"), price)).when(i % 4 == 2, F.concat(F.lit("Group "), (i % 9).cast("string"))).otherwise("")


def location_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    known = n % 6 != 5
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("location"), F.when(known, -60.0 + 5 * n).alias("lat"), F.when(known, -170.0 + 13 * n).alias("lon"), F.concat(F.lit("City "), (n % 8).cast("string")).alias("label")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.concat(F.lit("key "), F.col("label").cast("string")).alias("material_key"), (F.col("vec_id") % 17).alias("supplier_id"))


#: The same tables as common table expressions.
PREFIX = """WITH suppliers AS (
  SELECT s_suppkey AS id, lower(replace(s_name, '#', '-')) || '.example.com' AS host, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE s_name END AS company,
         s_suppkey // 2 AS token, n_name AS location, CASE WHEN s_acctbal < 0 THEN 'HTTP 503' ELSE '' END AS last_error
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
materials AS (
  SELECT ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS id, l_suppkey AS supplier_id, CAST(l_partkey AS VARCHAR) AS item_id,
         CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_orderkey || '-' || l_linenumber END AS idone, p_name AS base, p_name || '|' || lower(p_type) AS material_key,
         p_name || CASE p_size % 5 WHEN 0 THEN ' 2cm' WHEN 1 THEN ' 3cm' WHEN 2 THEN ' 20mm' WHEN 3 THEN ' 1.2cm' ELSE '' END
                || CASE p_partkey % 6 WHEN 0 THEN ' Polished' WHEN 1 THEN ' Honed' WHEN 2 THEN ' Leather' WHEN 3 THEN ' Polished/Honed' ELSE '' END AS item_name,
         p_type AS material_type, CASE l_returnflag WHEN 'R' THEN 'Tile' WHEN 'A' THEN 'Remnant' ELSE 'Slab' END AS product_form,
         CASE l_linestatus WHEN 'O' THEN 'SF' ELSE 'EA' END AS uom, CAST(l_quantity AS BIGINT) AS available_slabs, 60.0::DOUBLE + p_size AS avg_length, 40.0::DOUBLE + p_partkey % 50 AS avg_width,
         CASE WHEN p_name LIKE 'red %' THEN 'Red' WHEN p_name LIKE 'blue %' THEN 'Navy Blue' WHEN p_name LIKE 'cold %' THEN 'Gray, White' ELSE '' END AS color,
         CASE p_size % 5 WHEN 0 THEN '2cm' WHEN 1 THEN '3cm' WHEN 2 THEN '20cm' WHEN 3 THEN '1.2cm' ELSE '' END AS thickness,
         CASE p_partkey % 4 WHEN 0 THEN '$' || printf('%.2f', p_retailprice) || '/sf' WHEN 1 THEN '$' || printf('%.2f', p_retailprice) WHEN 2 THEN 'Group ' || (p_partkey % 9) ELSE '' END AS price_range,
         CAST(l_shipdate >= TIMESTAMP '2001-01-01' AS INTEGER) AS new_arrival, l_shipdate AS crawled_at,
         CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'https://cdn.slabcloud.com/slabs/' || p_partkey || '.jpg' ELSE 'https://img.example.com/' || p_partkey || '.jpg' END AS image_url
  FROM lineitem JOIN part ON l_partkey = p_partkey),
location_geo AS (
  SELECT n_name AS location, CASE WHEN n_nationkey % 6 <> 5 THEN -60.0::DOUBLE + 5 * n_nationkey END AS lat, CASE WHEN n_nationkey % 6 <> 5 THEN -170.0::DOUBLE + 13 * n_nationkey END AS lon,
         'City ' || (n_nationkey % 8) AS label FROM nation),
vectors AS (SELECT vec_id, embedding, 'key ' || label AS material_key, vec_id % 17 AS supplier_id FROM embeddings)
"""
