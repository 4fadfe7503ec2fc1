"""Places near origins, and products compared, against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import places
from tessera.plans import compare

POINT = "lat double, lon double"


def apart(a, b):
    x = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * places.EARTH * math.asin(math.sqrt(min(x, 1.0)))


def points(seed, n):
    """Points everywhere, many near the poles, the date line and each other."""
    r = random.Random(seed)
    out = [(90.0, 0.0), (-90.0, 12.0), (89.9, -179.99), (89.9, 0.01), (-89.99, 90.0), (0.0, 180.0), (0.0, -180.0), (10.0, 179.95), (10.0, -179.95), (60.0, 179.9), (60.0, -179.8)]
    while len(out) < n:
        out += [(r.uniform(-90, 90), r.uniform(-180, 180)), (r.choice((-1, 1)) * r.uniform(80, 90), r.uniform(-180, 180)), (r.uniform(-70, 70), r.choice((-1, 1)) * r.uniform(178, 180)), (r.uniform(40, 42), r.uniform(-75, -73))]
    return out[:n]


@pytest.mark.parametrize("radius", [0.5, 25, 300, 2000, 7000, 13000])
def test_within_equals_all_pairs(spark, radius):
    a, b = points(1, 60), points(2, 150)
    origins = spark.createDataFrame([(i, *p) for i, p in enumerate(a)] + [(99, None, 1.0), (98, math.nan, 1.0)], f"origin_id int, {POINT}")
    known = spark.createDataFrame([(f"p{i}", *p) for i, p in enumerate(b)] + [("none", None, None)], f"location string, {POINT}")
    got = {(r.origin_id, r.location): r.miles for r in places.within(origins, known, radius).collect()}
    want = {(i, f"p{j}"): d for i, p in enumerate(a) for j, q in enumerate(b) if (d := apart(p, q)) <= radius}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_few_cells_are_looked_at(spark):
    grid = places.Grid(50)
    rows = spark.createDataFrame([(lat, -120.0) for lat in (0.0, 30.0, 45.0, 60.0, 75.0, 85.0)], POINT)
    sizes = [r.n for r in rows.select(F.size(grid.around(F.col("lat"), F.col("lon"))).alias("n")).collect()]
    assert max(sizes) <= 12


def test_nearest_equals_all_pairs(spark):
    a, b = points(3, 50), points(4, 40) + [(41.0, -74.0), (41.0, -74.0)]
    origins = spark.createDataFrame([(i, *p) for i, p in enumerate(a)], f"origin_id int, {POINT}")
    known = spark.createDataFrame([(f"p{i:03d}", *p) for i, p in enumerate(b)], f"location string, {POINT}")
    got = {r.origin_id: (round(r.miles, 6), r.location) for r in places.nearest(origins, known, 5).collect()}
    for i, p in enumerate(a):
        best = min((round(apart(p, q), 6), f"p{j:03d}") for j, q in enumerate(b))
        assert got[i][0] == pytest.approx(best[0], abs=1e-5) and (got[i][1] == best[1] or apart(p, b[int(got[i][1][1:])]) == pytest.approx(best[0], abs=1e-5))
    assert places.nearest(origins, known.limit(0)).count() == 0


def test_compared(spark):
    m = spark.createDataFrame(
        [("a|x", 1, 5, "$9/sf"), ("a|x", 2, 3, "$7/sf"), ("b|x", 1, 8, "$7/sf"), ("c|x", 2, 0, "")], "material_key string, supplier_id long, available_slabs long, price_range string"
    ).withColumn("product_form", F.lit("Slab"))
    s = spark.createDataFrame([(1, "Here, There"), (2, "Nowhere")], "id long, locations string")
    geo = spark.createDataFrame([("here", 10.0, 10.0), ("THERE ", 0.0, 0.0), ("nowhere", None, None)], f"location string, {POINT}")
    aliases = spark.createDataFrame([("old|x", "mid|x"), ("mid|x", "a|x")], "alias_key string, canonical_key string")
    trays = spark.createDataFrame([(1, "old|x"), (1, "b|x"), (1, "lost|x"), (2, "c|x"), (3, "a|x"), (3, "c|x")], "user_id int, material_key string")
    origins = spark.createDataFrame([(1, 0.0, 1.0), (3, 10.0, 10.0)], f"user_id int, {POINT}")
    got = {(r.user_id, r.asked): r for r in compare.columns(trays, m, s, aliases, origins, geo).collect()}
    one = got[1, "old|x"]
    assert (one.material_key, one.gone, one.suppliers, one.deepest, one.total, one.price_sqft, one.miles) == ("a|x", False, 2, 5, 8, 7.0, 69.1)
    assert one.wins_suppliers and not one.wins_total and not one.wins_price_sqft and not one.wins_miles  # ties win nothing
    assert got[1, "b|x"].wins_deepest and got[1, "lost|x"].gone and got[1, "lost|x"].suppliers is None
    assert not got[2, "c|x"].wins_suppliers and got[2, "c|x"].miles is None  # alone, and without an origin
    assert got[3, "a|x"].miles == 0.0 and not got[3, "a|x"].wins_miles and got[3, "a|x"].wins_deepest and not got[3, "a|x"].wins_total
