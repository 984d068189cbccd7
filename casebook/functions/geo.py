"""Points, distances and grid cells without a spatial index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.8
#: Metres of a degree of latitude, rounded down so that covers are never too small.
DEGREE_M = 111_194.0
#: Side of a grid cell in degrees.
CELL = 0.05
#: Metres of the smallest radius that has cells of its own size; each level doubles it.
FINEST_M = 100.0
RINGS = 4


def distance_m(lat: Column, lon: Column, to_lat: Column, to_lon: Column) -> Column:
    """Great-circle distance; null unless all four are present."""
    half = lambda a, b: F.pow(F.sin(F.radians(a - b) / 2), 2)
    h = half(lat, to_lat) + F.cos(F.radians(to_lat)) * F.cos(F.radians(lat)) * half(lon, to_lon)
    return F.when(h.isNotNull(), F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * EARTH_M))  # least() alone would pass over a null


def ring(distance: Column, radius: Column) -> Column:
    """1 to RINGS, of equal width; the edge of the circle belongs to the last."""
    return F.least(F.width_bucket(distance, F.lit(0.0), radius.cast("double"), F.lit(RINGS)), F.lit(RINGS)).cast("int")


def cell(degrees: Column, side: Column | float = CELL) -> Column:
    return F.floor(degrees / side).cast("int")


def level(radius: Column) -> Column:
    """The smallest level whose cells are at least as high as the radius."""
    return F.ceil(F.log2(F.greatest(radius, F.lit(FINEST_M)) / FINEST_M)).cast("int")


def side(level_: Column) -> Column:
    """Degrees of a side of a level's cells."""
    return F.pow(F.lit(2.0), level_) * (FINEST_M / DEGREE_M)


def span_lat(radius: Column) -> Column:
    """Degrees of latitude that the radius covers."""
    return radius / DEGREE_M


def span_lon(lat: Column, radius: Column) -> Column:
    """Degrees of longitude at the circle's far edge, where they are shortest; all of them if it holds a pole."""
    edge = F.abs(lat) + span_lat(radius)
    return F.when(edge >= 90, F.lit(180.0)).otherwise(F.least(radius / (DEGREE_M * F.cos(F.radians(edge))), F.lit(180.0)))


def in_box(lat: Column, lon: Column, radius: Column) -> Column:
    """A range on latitude and longitude around a circle, which scans can use; across longitude 180 it is two ranges."""
    high, wide, at = span_lat(radius), span_lon(lat, radius), F.col("longitude")
    west, east = lon - wide, lon + wide
    round_ = ((west < -180) & (at >= west + 360)) | ((east > 180) & (at <= east - 360))
    return F.col("latitude").between(lat - high, lat + high) & (at.between(west, east) | round_ | (wide >= 180))


# Cells stand in rows of equal latitude. A row has as many columns of equal width as fit
# around it with at least the side's metres each, so that few of them meet a circle near
# the poles, and the last column's neighbour is the first.


def row_of(lat: Column, side_: Column) -> Column:
    """The row of a latitude, from the south pole on."""
    return F.floor((F.greatest(F.least(lat, F.lit(90.0)), F.lit(-90.0)) + 90) / side_)


def columns_of(row: Column, side_: Column) -> Column:
    """Columns of a row: by the length of its edge that is nearer to a pole."""
    edge = F.least(F.greatest(F.abs(row * side_ - 90), F.abs((row + 1) * side_ - 90)), F.lit(90.0))
    return F.greatest(F.floor(360 * F.cos(F.radians(edge)) / side_), F.lit(1).cast("long"))


def turn_of(lon: Column) -> Column:
    """A longitude as a part of the way around, from 0 to below 1."""
    part = (lon + 180) / 360
    return part - F.floor(part)


def cover(lat: Column, lon: Column, radius: Column, side_: Column) -> Column:
    """The cells (row, column) that a circle touches."""
    high, wide = span_lat(radius), span_lon(lat, radius)
    rows = F.sequence(row_of(lat - high, side_), row_of(lat + high, side_))

    def of_row(row: Column) -> Column:
        n = columns_of(row, side_)
        first, last = F.floor((lon - wide + 180) / 360 * n), F.floor((lon + wide + 180) / 360 * n)
        some = F.when(last - first + 1 >= n, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.sequence(first, last))
        return F.transform(some, lambda c: F.struct(row.alias("row"), F.pmod(c, n).alias("column")))

    return F.flatten(F.transform(rows, of_row))
