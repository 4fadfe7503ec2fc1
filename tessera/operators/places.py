"""Places near origins: cells of a grid by latitude, neighbours replicated, distances verified; at the poles and the date line too."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: miles of the earth's radius.
EARTH = 3958.8
#: Miles within which the nearest place is looked for first.
FIRST = 100.0
#: No two places are further apart, in miles.
FARTHEST = math.pi * EARTH


def miles_between(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat - lat0) / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(lat0)) * F.pow(F.sin(F.radians(lon - lon0) / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


class Grid:
    """Bands of latitude as high as a radius, each cut into cells that are no narrower at the end of the band that is nearer to a pole."""

    def __init__(self, radius: float) -> None:
        self.radius = min(max(radius, 1e-3), FARTHEST)
        self.height = min(180.0, math.degrees(self.radius / EARTH) * (1 + 1e-9))
        self.bands = max(1, math.ceil(180 / self.height))

    def band(self, lat: Column) -> Column:
        return F.least(F.floor((lat + 90) / self.height), F.lit(self.bands - 1)).cast("long")

    def cells(self, band: Column) -> Column:
        """Cells around the earth in a band: one where it reaches a pole."""
        low, high = band * self.height - 90, (band + 1) * self.height - 90
        top = F.greatest(F.abs(low), F.abs(high))
        return F.when(top >= 90, 1).otherwise(F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(top)) / self.height))).cast("long")

    def cell(self, lat: Column, lon: Column) -> Column:
        """The cell of a place: its band and its number there."""
        band = self.band(lat)
        n = self.cells(band)
        return F.struct(band.alias("band"), F.least(F.floor(F.pmod(lon + 180, F.lit(360.0)) * n / 360), n - 1).cast("long").alias("cell"))

    def around(self, lat: Column, lon: Column) -> Column:
        """All cells that may have places within the radius of an origin."""
        reach = F.lit(self.radius / EARTH)
        polar = F.radians(F.lit(90.0) - F.abs(lat)) <= reach * (1 + 1e-9)
        # places within the reach differ by so much in longitude at most
        wide = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.sin(reach) / F.cos(F.radians(lat)), F.lit(1.0)))) * (1 + 1e-9) + 1e-9)
        wide = F.when(reach >= math.pi / 2, F.lit(180.0)).otherwise(wide)

        def in_band(band: Column) -> Column:
            n = self.cells(band)
            first, last = F.floor((lon - wide + 180) * n / 360), F.floor((lon + wide + 180) * n / 360)
            some = F.sequence(first, F.least(last, first + n - 1))
            return F.transform(some, lambda c: F.struct(band.alias("band"), F.pmod(c, n).cast("long").alias("cell")))

        own = self.band(lat)
        bands = F.sequence(F.greatest(own - 1, F.lit(0)).cast("long"), F.least(own + 1, F.lit(self.bands - 1)).cast("long"))
        return F.flatten(F.transform(bands, in_band))


def within(origins: DataFrame, places: DataFrame, radius: float) -> DataFrame:
    """(origin_id, location, miles) of all places (location, lat, lon) within radius miles of origins (origin_id, lat, lon). What has no coordinates is near nothing."""
    grid = Grid(radius)
    known = "lat is not null and lon is not null and not isnan(lat) and not isnan(lon) and abs(lat) <= 90"
    at = places.where(known).select("location", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), grid.cell(F.col("lat"), F.col("lon")).alias("_cell"))
    asked = origins.where(known).select("origin_id", "lat", "lon", F.explode(F.array_distinct(grid.around(F.col("lat"), F.col("lon")))).alias("_cell"))
    met = asked.join(at, "_cell").withColumn("miles", miles_between(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")))
    return met.where(F.col("miles") <= radius).select("origin_id", "location", "miles")


def nearest(origins: DataFrame, places: DataFrame, first: float = FIRST) -> DataFrame:
    """(origin_id, location, miles): the nearest place of each origin, of equally near ones the first by name; origins without one have no row.

    Looked for within a radius that doubles four times over for those that found nothing, up to all
    around the earth: most are answered by a few cells. Places at the same point count once.
    """
    one = places.groupBy("lat", "lon").agg(F.min("location").alias("location"))
    left, found, radius = origins.select("origin_id", "lat", "lon").distinct(), None, first
    while True:
        met = within(left, one, radius)
        order = Window.partitionBy("origin_id").orderBy("miles", "location")
        best = met.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")
        found = best if found is None else found.unionByName(best)
        if radius >= FARTHEST:
            return found
        left, radius = left.join(best.select("origin_id"), "origin_id", "left_anti"), min(radius * 16, FARTHEST)
