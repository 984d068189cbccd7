"""The incident table's columns and types, stored and as received."""

from __future__ import annotations

from pyspark.sql import types as T

_string, _long, _double = T.StringType(), T.LongType(), T.DoubleType()
#: The stored form, without `year`, which is a partition of the path.
INCIDENTS = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in [
            ("id", _long), ("case_number", _string), ("date", T.TimestampNTZType()), ("block", _string), ("iucr", _string),
            ("primary_type", _string), ("description", _string), ("location_description", _string), ("arrest", T.BooleanType()),
            ("domestic", T.BooleanType()), ("beat", _string), ("district", _string), ("ward", _long), ("community_area", _long),
            ("fbi_code", _string), ("x_coordinate", _double), ("y_coordinate", _double), ("updated_on", T.TimestampNTZType()),
            ("latitude", _double), ("longitude", _double), ("primary_type_canonical", _string), ("stable_category", _string),
        ]
    ]
)
DERIVED = ("primary_type_canonical", "stable_category")
#: The feed: the same columns but the derived ones, all text.
RAW = T.StructType([T.StructField(f.name, _string) for f in INCIDENTS if f.name not in DERIVED])
#: The code table, all text, so that codes keep their zeros.
CODES = T.StructType([T.StructField(c, _string) for c in ("iucr", "primary_description", "secondary_description", "index_code", "active", "stable_category")])
#: Columns that are kept when a newer code table arrives.
CURATED = ("stable_category",)

TIMESTAMPS = ("date", "updated_on")
DOUBLES = ("x_coordinate", "y_coordinate", "latitude", "longitude")
INTEGERS = ("id", "ward", "community_area")
FLAGS = ("arrest", "domestic")
TEXTS = tuple(f.name for f in INCIDENTS if f.dataType == _string)

#: Projections of row results.
FULL = tuple(f.name for f in INCIDENTS)
#: Without the codes and labels that the two taxonomies replace, the second pair of coordinates and the time of the update.
COMPACT = tuple(c for c in FULL if c not in ("iucr", "primary_type", "fbi_code", "x_coordinate", "y_coordinate", "updated_on"))

#: Category column of each taxonomy; geography column of each level (none for citywide).
TAXONOMIES = {"source": "primary_type_canonical", "comparable": "stable_category"}
GEOGRAPHIES = {"citywide": None, "beat": "beat", "district": "district", "community_area": "community_area", "ward": "ward"}
#: Levels whose boundaries have moved between years.
UNSTABLE = ("ward", "district", "beat")
MEASURES = ("incidents", "arrests", "domestic", "geocoded")
