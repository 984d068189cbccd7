"""The two category taxonomies, derived from the code table when rows are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.functions.columns import normal_code, typed
from casebook.sources.schema import CURATED

# The code table is joined without a hint: it is read from a file whose size Spark
# knows, and is broadcast as long as that is below the session's threshold.


def with_canonical(df: DataFrame, codes: DataFrame) -> DataFrame:
    """primary_type_canonical: the code table's label for the code, else the row's own."""
    labels = codes.select(normal_code(F.col("iucr")).alias("__code"), F.col("primary_description").alias("__label")).where("__code IS NOT NULL").dropDuplicates(["__code"])
    rows = df.withColumn("__key", normal_code(F.col("iucr"))).join(labels, F.col("__key") == F.col("__code"), "left")
    return rows.withColumn("primary_type_canonical", F.coalesce("__label", "primary_type")).drop("__key", "__code", "__label")


def with_stable(df: DataFrame, codes: DataFrame) -> DataFrame:
    """stable_category: the curated override for the code, else the canonical label."""
    over = codes.select(normal_code(F.col("iucr")).alias("__code"), F.trim("stable_category").alias("__over")).where("__code IS NOT NULL AND __over <> ''").dropDuplicates(["__code"])
    rows = df.drop("stable_category").withColumn("__key", normal_code(F.col("iucr"))).join(over, F.col("__key") == F.col("__code"), "left")
    return rows.withColumn("stable_category", F.coalesce("__over", "primary_type_canonical")).drop("__key", "__code", "__over")


def prepare(raw: DataFrame, codes: DataFrame) -> DataFrame:
    """Received rows as they are stored."""
    return typed(with_stable(with_canonical(raw, codes), codes))


def carried_over(new: DataFrame, old: DataFrame) -> DataFrame:
    """A newer code table with the curated columns of the one before."""
    kept = old.select("iucr", *CURATED).dropDuplicates(["iucr"])
    return new.drop(*CURATED).join(kept, "iucr", "left")


def code_changes(new: DataFrame, old: DataFrame) -> DataFrame:
    """iucr, change (added, removed or relabelled) and both labels."""
    a = new.select(F.col("iucr").alias("iucr"), F.col("primary_description").alias("new_label"), F.lit(1).alias("__new"))
    b = old.select(F.col("iucr").alias("iucr"), F.col("primary_description").alias("old_label"), F.lit(1).alias("__old"))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(~F.col("new_label").eqNullSafe(F.col("old_label")), "relabelled")
    return a.join(b, "iucr", "full_outer").select("iucr", change.alias("change"), "old_label", "new_label").where("change IS NOT NULL")


def retagged(df: DataFrame, codes: DataFrame) -> DataFrame:
    """Stored rows under the present curation. Applying it twice changes nothing more."""
    return with_stable(df, codes).select(df.columns)


def retag_report(df: DataFrame, codes: DataFrame) -> DataFrame:
    """By year: rows, rows whose stable category differs from the canonical one, and their share."""
    moved = F.count_if(~F.col("stable_category").eqNullSafe(F.col("primary_type_canonical")))
    rows = retagged(df, codes).groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n_rows"), moved.alias("moved"))
    return rows.withColumn("share", F.coalesce(F.try_divide("moved", "n_rows"), F.lit(0.0)))
