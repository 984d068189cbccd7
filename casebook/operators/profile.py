"""What a table holds: coverage of fields, frequent values, keys and vocabulary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casebook.functions.columns import rate
from casebook.sources.schema import GEOGRAPHIES, TAXONOMIES, UNSTABLE


def field_inventory(df: DataFrame) -> DataFrame:
    """field, share of rows that have it, and its least value as a sample, in one pass."""
    columns = df.columns
    row = df.agg(*(F.struct(rate(F.count(c), F.count("*")).alias("share"), F.min(F.col(c).cast("string")).alias("sample")).alias(c) for c in columns))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in columns)))
    return row.select(each.alias("x")).select("x.field", "x.v.share", "x.v.sample")


def frequent_values(df: DataFrame, columns: list[str], k: int = 8) -> DataFrame:
    """field, value, n_rows, rank and n_values for the k most frequent values of each column."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns)))
    counts = df.select(each.alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n_rows"))
    sizes = counts.groupBy("field").agg(F.count("value").alias("n_values"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n_rows"), F.col("value").asc_nulls_last()))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k).join(sizes, "field")


def dataset_profile(df: DataFrame) -> DataFrame:
    """One row: rows, distinct ids and case numbers, rows without place, time span, geocoded share."""
    return df.agg(
        F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.count_distinct("case_number").alias("n_case_numbers"),
        *(F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in ("ward", "community_area", "latitude")),
        F.min("date").alias("min_date"), F.max("date").alias("max_date"), rate(F.count("latitude"), F.count("*")).alias("geocoded_share"),
    )


def largest_categories(df: DataFrame, k: int = 15, taxonomy: str = "source") -> DataFrame:
    counts = df.groupBy(F.col(TAXONOMIES[taxonomy]).alias("category")).agg(F.count("*").alias("incidents"))
    return counts.orderBy(F.desc("incidents"), F.col("category").asc_nulls_last()).limit(k)


def arrest_rates(df: DataFrame, k: int = 10, taxonomy: str = "source") -> DataFrame:
    """The k largest categories with their arrest rate over rows whose flag is known."""
    rows = df.groupBy(F.col(TAXONOMIES[taxonomy]).alias("category")).agg(F.count("*").alias("incidents"), F.coalesce(F.avg(F.col("arrest").cast("int")), F.lit(0.0)).alias("arrest_rate"))
    return rows.orderBy(F.desc("incidents"), F.col("category").asc_nulls_last()).limit(k)


def distinct_values(rollup: DataFrame, column: str) -> DataFrame:
    return rollup.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def vocabulary(rollups: dict[str, DataFrame]) -> DataFrame:
    """dimension, taxonomy, value and stable_over_time of all categories and geographies, from the rollups."""
    told = lambda dimension, taxonomy, value, stable: F.struct(F.lit(dimension).alias("dimension"), F.lit(taxonomy).cast("string").alias("taxonomy"), F.col(value).cast("string").alias("value"), F.lit(stable).alias("stable_over_time"))
    both = F.explode(F.array(*(told("category", t, c, t == "comparable") for t, c in TAXONOMIES.items())))
    parts = [rollups["citywide"].select(both.alias("x")).select("x.*")]
    parts += [rollups[level].select(told(level, None, c, level not in UNSTABLE).alias("x")).select("x.*") for level, c in GEOGRAPHIES.items() if c]
    return reduce(DataFrame.unionByName, parts).where("value IS NOT NULL").distinct()


def vocabulary_sizes(words: DataFrame) -> DataFrame:
    return words.groupBy("dimension", "taxonomy").agg(F.count("*").alias("n_values"))
