"""Rows by filter or key, newest first, page by page."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casebook.functions.predicates import before
from casebook.sources.schema import COMPACT, FULL
from casebook.sources.storage import cut


def projected(df: DataFrame, full: bool = False) -> DataFrame:
    """The full record or the compact one, as far as the table has the columns."""
    return df.select(*(c for c in (FULL if full else COMPACT) if c in df.columns))


def newest(df: DataFrame, limit: int = 50, after: tuple[datetime, int] | None = None) -> DataFrame:
    """The newest `limit` rows (after a key, if given) and one more, which tells that there are more."""
    if not 1 <= limit <= 200:
        raise ValueError("a limit is from 1 to 200")
    rows = df if after is None else df.where(before(*after))
    return rows.orderBy(F.desc("date"), F.desc("id")).limit(limit + 1)


def lookup(df: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """The rows of many ids, or of many case numbers in any letter case."""
    if key == "id":
        return df.join(keys.select("id"), "id", "left_semi").orderBy("id")
    wanted = keys.select(F.upper(F.trim("case_number")).alias("__case"))
    return df.join(wanted, F.upper("case_number") == F.col("__case"), "left_semi").orderBy("id")


def filter_text(filters: dict) -> str:
    """The filters as JSON with sorted names; its hash ties a page boundary to them."""
    return json.dumps(filters, sort_keys=True, separators=(",", ":"))


def page_boundaries(df: DataFrame, size: int, filters: dict) -> DataFrame:
    """One row per page of the newest-first order: page, n_rows, first and last key, filter_hash.

    Rows are ranged by key over partitions and numbered within them; the partitions'
    counts, one row each, give the numbers before them. No window sees all rows."""
    keys = df.select("date", "id").repartitionByRange(F.desc("date"), F.desc("id"))
    keys = cut(keys.withColumn("part", F.spark_partition_id()))
    parts = keys.groupBy("part").agg(F.count("*").alias("n"))
    earlier = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    numbered = keys.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("date"), F.desc("id"))))
    rows = numbered.join(earlier, "part").withColumn("page", F.floor((F.col("earlier") + F.col("k") - 1) / size).cast("long"))
    key = F.struct("date", "id")
    found = rows.groupBy("page").agg(F.count("*").alias("n_rows"), F.max(key).alias("f"), F.min(key).alias("l"))
    return found.select("page", "n_rows", F.col("f.date").alias("first_date"), F.col("f.id").alias("first_id"), F.col("l.date").alias("last_date"), F.col("l.id").alias("last_id"), F.sha2(F.lit(filter_text(filters)), 256).alias("filter_hash"))


#: Rows from one entry of a stored page index to the next.
EVERY = 10_000


def store_pages(df: DataFrame, path: str, filters: dict, every: int = EVERY) -> None:
    """A sparse index of the newest-first order of filtered rows: the keys of every stretch of `every` rows."""
    page_boundaries(df, every, filters).withColumn("every", F.lit(every)).coalesce(1).write.mode("overwrite").parquet(path)  # an entry for many rows


def stored_page(df: DataFrame, path: str, filters: dict, page: int, size: int = 50) -> DataFrame:
    """A page of a stored order, counted from 0, by a seek: the index tells between which keys it
    lies, and only rows from there are read and sorted, at most two stretches for pages no
    larger than one. An error if the index is of other filters; no rows beyond the last page."""
    index = df.sparkSession.read.parquet(path)
    told = index.select("every", "filter_hash").first()
    if told is None:
        return df.limit(0)
    if told.filter_hash != hashlib.sha256(filter_text(filters).encode()).hexdigest():
        raise ValueError("the index belongs to other filters")
    first = page * size
    ends = index.where(F.col("page").between(first // told.every, (first + size - 1) // told.every))
    key = ends.agg(F.max(F.struct("first_date", "first_id")).alias("high"), F.min(F.struct("last_date", "last_id")).alias("low")).first()
    if key.high is None:
        return df.limit(0)
    high, low = (F.lit(x).cast("timestamp_ntz") for x in (key.high.first_date, key.low.last_date))
    inside = (F.col("date") <= high) & (F.col("date") >= low) & ((F.col("date") < high) | (F.col("id") <= key.high.first_id)) & ((F.col("date") > low) | (F.col("id") >= key.low.last_id))
    if "year" in df.columns:  # partitions are pruned by it
        inside = inside & F.col("year").between(key.low.last_date.year, key.high.first_date.year)
    return df.where(inside).orderBy(F.desc("date"), F.desc("id")).offset(first % told.every).limit(size)


def shared_case_numbers(df: DataFrame) -> DataFrame:
    """Case numbers that cover several rows."""
    return df.groupBy("case_number").agg(F.count("*").alias("n_rows")).where("n_rows > 1")
