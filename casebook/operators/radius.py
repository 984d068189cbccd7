"""Counts, nearest rows and joins within a distance of points, by grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.functions.curve import in_stretches, stretches
from casebook.functions.geo import DEGREE_M, RINGS, cell, columns_of, cover, distance_m, in_box, level, ring, row_of, side, span_lat, span_lon, turn_of
from casebook.sources.schema import TAXONOMIES
from casebook.sources.storage import cut

#: Rows of a cell from which it is split in four; splits of a cell; split cells that are sent to every task.
LOAD, DEEPEST, BROADCAST_CELLS = 100_000, 12, 100_000
#: The most rows that a search for the nearest gives.
MOST = 50
CELL = ["level", "row", "column", "depth", "u", "v"]
PLACE, CIRCLE = ["latitude", "longitude"], ["lat", "lon", "radius"]
#: Points in a list; pairs of a place from which its rows are dealt out.
LISTED, SHARE = 1000, 5_000_000


def with_point(df: DataFrame) -> DataFrame:
    """Both coordinates or neither, and the grid cell."""
    both = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    lat, lon = F.when(both, F.col("latitude")), F.when(both, F.col("longitude"))
    return df.withColumns({"latitude": lat, "longitude": lon}).withColumns({"cell_lat": cell(F.col("latitude")), "cell_lon": cell(F.col("longitude"))})


def circle(lat: float, lon: float, radius: float, most: int = 16) -> list[tuple[int, int]]:
    """The stretches of the curve that hold a circle, across longitude 180 those of both sides."""
    high = radius / DEGREE_M
    edge = abs(lat) + high
    wide = 180.0 if edge >= 90 else min(180.0, radius / (DEGREE_M * math.cos(math.radians(edge))))
    sides = [(-180.0, 180.0)] if wide >= 180 else [(max(a, -180.0), min(b, 180.0)) for a, b in ((lon - wide + turn, lon + wide + turn) for turn in (-360, 0, 360)) if a <= 180 and b >= -180]
    return [s for west, east in sides for s in stretches(lat - high, lat + high, west, east, most)]


def within(df: DataFrame, lat: float, lon: float, radius: float) -> DataFrame:
    """Rows at most `radius` metres from a point, with distance_m. Rows without coordinates are never
    within. A table laid out by place is read where the circle's stretches of the curve are."""
    at, to, r = F.lit(lat), F.lit(lon), F.lit(float(radius))
    rows = df.where(in_stretches("place", circle(lat, lon, radius))) if "place" in df.columns else df
    rows = rows.where(in_box(at, to, r)).withColumn("distance_m", distance_m(F.col("latitude"), F.col("longitude"), at, to))
    return rows.where(F.col("distance_m") <= r)


def ring_counts(near: DataFrame, radius: float, taxonomy: str = "source") -> DataFrame:
    """category, ring and incidents of the rows of within()."""
    rows = near.select(F.col(TAXONOMIES[taxonomy]).alias("category"), ring(F.col("distance_m"), F.lit(radius)).alias("ring"))
    return rows.groupBy("category", "ring").agg(F.count("*").alias("incidents"))


def summary(counts: DataFrame) -> DataFrame:
    """kind (total, category or ring), category, ring and incidents; every ring has a row."""
    sets = counts.groupingSets([["category"], ["ring"], []], "category", "ring").agg(F.sum("incidents").alias("incidents"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "category").otherwise("ring")
    found = sets.select(kind.alias("kind"), "category", "ring", F.coalesce("incidents", F.lit(0)).alias("incidents"))
    rings = counts.sparkSession.range(1, RINGS + 1).select(F.col("id").cast("int").alias("ring"))
    every = rings.join(found.where("kind = 'ring'").select("ring", "incidents"), "ring", "left")
    every = every.select(F.lit("ring").alias("kind"), F.lit(None).cast("string").alias("category"), "ring", F.coalesce("incidents", F.lit(0)).alias("incidents"))
    return found.where("kind <> 'ring'").unionByName(every)


def by_size(counts: DataFrame) -> DataFrame:
    """Categories by incidents, the largest first."""
    return counts.groupBy("category").agg(F.sum("incidents").alias("incidents")).orderBy(F.desc("incidents"), F.col("category").asc_nulls_last())


def nearest(df: DataFrame, lat: float, lon: float, k: int = 10) -> DataFrame:
    """The k rows nearest to a point, 50 at most; ties by id."""
    if not 1 <= k <= MOST:
        raise ValueError(f"k is from 1 to {MOST}")
    rows = df.withColumn("distance_m", distance_m(F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lon))).where("distance_m IS NOT NULL")
    return rows.orderBy("distance_m", "id").limit(k)


def _hinted(hot: DataFrame, n: int) -> DataFrame:
    return F.broadcast(hot) if n <= BROADCAST_CELLS else hot


def _quarter(part: Column, depth: Column) -> Column:
    """Which of the 2 ** depth stretches of a cell's side a part of it is in."""
    return F.floor(part * F.pow(F.lit(2.0), depth)).cast("long")


def assigned(df: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and points with the cells that they meet in: CELL and `salt`. Cells are as large as
    the radius; a row has one for each level of sizes that the points use. A cell with more than
    LOAD rows is split in four, and so on; what lies too close together to be split is dealt
    out by id, and its points are repeated."""
    sized = points.select("point_id", "lat", "lon", "radius", level(F.col("radius")).alias("level"))
    cells = sized.select("*", F.explode(cover(F.col("lat"), F.col("lon"), F.col("radius"), side(F.col("level")))).alias("c")).select("point_id", "lat", "lon", "radius", "level", "c.*")
    used = sized.agg(F.collect_set("level")).scalar()  # one number for each doubling of the radius
    at_row, at_turn = (F.col("latitude") + 90) / side(F.col("level")), turn_of(F.col("longitude"))
    rows = with_point(df).where("latitude IS NOT NULL").withColumn("level", F.explode(used)).withColumn("row", row_of(F.col("latitude"), side(F.col("level"))))
    n = columns_of(F.col("row"), side(F.col("level")))
    rows = rows.withColumns({"column": F.least(F.floor(at_turn * n), n - 1), "y": at_row - F.col("row"), "x": at_turn * n - F.floor(at_turn * n)})
    zero = {c: F.lit(0).cast("long") for c in ("depth", "u", "v")}
    rows, cells = rows.withColumns(zero), cells.withColumns(zero)
    for depth in range(DEEPEST + 1):
        over = cut(rows.where(F.col("depth") == depth).groupBy(*CELL).agg(F.count("*").alias("n")).where(F.col("n") > LOAD))
        n_over = over.count()
        if not n_over or depth == DEEPEST:
            break
        hot = _hinted(over.select(*CELL, F.lit(1).alias("hot")), n_over)
        deeper = F.col("depth") + F.when(F.col("hot").isNotNull(), 1).otherwise(0)
        rows = rows.join(hot, CELL, "left").withColumn("depth", deeper).withColumns({"u": _quarter(F.col("y"), F.col("depth")), "v": _quarter(F.col("x"), F.col("depth"))}).drop("hot")
        cells = _split(cells.join(hot, CELL, "left"))
    parts = over.select(*CELL, F.ceil(F.col("n") * 2 / LOAD).alias("parts"))
    parts = _hinted(parts, n_over)
    shares = F.coalesce("parts", F.lit(1))
    rows = rows.join(parts, CELL, "left").withColumn("salt", F.pmod(F.xxhash64("id"), shares)).drop("parts", "x", "y")
    cells = cells.join(parts, CELL, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))).drop("parts")
    return rows, cells


def _split(cells: DataFrame) -> DataFrame:
    """A point's cells, with those that are `hot` replaced by the quarters that its circle touches."""
    two = lambda c: F.array(c * 2, c * 2 + 1)
    same = F.array(F.struct("depth", "u", "v"))
    quarters = F.flatten(F.transform(two(F.col("u")), lambda u: F.transform(two(F.col("v")), lambda v: F.struct((F.col("depth") + 1).alias("depth"), u.alias("u"), v.alias("v")))))
    each = cells.withColumn("q", F.explode(F.when(F.col("hot").isNull(), same).otherwise(quarters))).drop("depth", "u", "v").select("*", "q.*").drop("q")
    parts, n, high = F.pow(F.lit(2.0), F.col("depth")), columns_of(F.col("row"), side(F.col("level"))), side(F.col("level"))
    middle_lat = (F.col("row") + (F.col("u") + 0.5) / parts) * high - 90
    middle_lon = (F.col("column") + (F.col("v") + 0.5) / parts) * 360 / n - 180
    away = F.abs(F.col("lon") - middle_lon) % 360
    slack = 1e-9  # rounding keeps a quarter too many, never one too few
    near = (F.abs(F.col("lat") - middle_lat) <= span_lat(F.col("radius")) + high / parts / 2 + slack) & (F.least(away, 360 - away) <= span_lon(F.col("lat"), F.col("radius")) + 180 / n / parts + slack)
    return each.where(F.col("hot").isNull() | near).drop("hot")


def _met(places: DataFrame, circles: DataFrame, digits: int | None) -> DataFrame:
    """PLACE, CIRCLE and distance_m of the distinct places within distinct circles, across longitude
    180 and around the poles too: an equi-join on cells, of which a circle touches a few."""
    rows, cells = assigned(places.withColumn("id", F.xxhash64(*PLACE)), circles.withColumn("point_id", F.xxhash64(*CIRCLE)))
    away = distance_m(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon"))
    met = rows.join(cells, [*CELL, "salt"]).withColumn("distance_m", away).where("distance_m <= radius")
    told = F.col("distance_m") if digits is None else F.round("distance_m", digits)
    return met.select(*PLACE, *CIRCLE, told.alias("distance_m"))


def _placed(df: DataFrame) -> DataFrame:
    """Rows that have a place."""
    return with_point(df).where("latitude IS NOT NULL").drop("cell_lat", "cell_lon")


def radius_join(df: DataFrame, points: DataFrame, digits: int | None = None) -> DataFrame:
    """Rows within the radius of each of many points (point_id, lat, lon, radius), with distance_m
    (rounded to `digits` if given). Distances are taken once for rows of equal place and points of
    equal circle; the rows are then joined to lists of points, some LISTED of a circle in each.
    A place with more than SHARE pairs is dealt out by id, and its lists are repeated."""
    rows, points = _placed(df), points.select("point_id", *CIRCLE)
    met = _met(cut(rows.select(*PLACE).distinct()), cut(points.select(*CIRCLE).distinct()), digits)
    blocks = points.groupBy(*CIRCLE).agg(F.ceil(F.count("*") / LISTED).alias("blocks"))
    lists = points.join(blocks, CIRCLE).groupBy(*CIRCLE, F.pmod(F.xxhash64("point_id"), "blocks").alias("block")).agg(F.collect_list("point_id").alias("points")).drop("block")
    met = cut(met.join(lists, CIRCLE).select(*PLACE, "radius", "distance_m", "points"))
    loads = met.groupBy(*PLACE).agg(F.sum(F.size("points")).alias("n_points")).join(rows.groupBy(*PLACE).agg(F.count("*").alias("n_rows")), PLACE)
    crowded = cut(loads.where(F.col("n_points") * F.col("n_rows") > SHARE).select(*PLACE, F.least("n_rows", F.ceil(F.col("n_points") * F.col("n_rows") / SHARE)).alias("parts")))
    crowded = _hinted(crowded, crowded.count())
    shares = F.coalesce("parts", F.lit(1).cast("long"))
    rows = rows.join(crowded, PLACE, "left").withColumn("share", F.pmod(F.xxhash64("id"), shares)).drop("parts")
    met = met.join(crowded, PLACE, "left").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))).drop("parts")
    pairs = rows.join(met, [*PLACE, "share"])
    return pairs.select(*df.columns, F.explode("points").alias("point_id"), "radius", "distance_m")


def nearest_join(df: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """The k nearest rows within the radius of each of many points, ranked. Of rows of equal place
    only the k first by id can be among them, and points of equal circle have the same ones."""
    points = points.select("point_id", *CIRCLE)
    ranked = lambda by, *order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    first = cut(_placed(df).withColumn("rank", ranked(PLACE, "id")).where(F.col("rank") <= k).drop("rank"))
    met = _met(first.select(*PLACE).distinct(), cut(points.select(*CIRCLE).distinct()), None)
    near = met.withColumn("ring", F.rank().over(Window.partitionBy(*CIRCLE).orderBy("distance_m"))).where(F.col("ring") <= k).drop("ring")
    found = near.join(first, PLACE).withColumn("rank", ranked(CIRCLE, "distance_m", "id")).where(F.col("rank") <= k)
    return found.join(points, CIRCLE).select(*df.columns, "point_id", "radius", "distance_m", "rank")


def ungeocoded_finding(near: DataFrame, coverage: DataFrame, taxonomy: str = "source") -> DataFrame:
    """One row: overall geocode rate of the categories found in a radius, and the worst of them.
    coverage: category, incidents, geocoded, geocode_rate by category."""
    found = near.select(F.col(TAXONOMIES[taxonomy]).alias("category")).where("category IS NOT NULL").distinct()
    rows = coverage.where("category IS NOT NULL").join(found, "category", "left_semi")
    worst = F.min(F.struct("geocode_rate", "category"))
    return rows.agg(F.coalesce(F.try_divide(F.sum("geocoded"), F.sum("incidents")), F.lit(0.0)).alias("geocode_rate"), worst.alias("w")).select("geocode_rate", F.col("w.category").alias("worst_category"), F.col("w.geocode_rate").alias("worst_rate"))
