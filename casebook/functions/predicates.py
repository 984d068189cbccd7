"""Filters. Each returns a condition; an empty list of values means no filter."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.functions.columns import category_key, geography_key
from casebook.sources.schema import GEOGRAPHIES, TAXONOMIES


def in_span(df: DataFrame, start: date, end: date) -> Column:
    """Both days included. Where the table is partitioned by year, its years are named too, so that partitions are pruned."""
    stop = datetime.combine(end, datetime.min.time()) + timedelta(days=1)
    found = (F.col("date") >= F.lit(datetime.combine(start, datetime.min.time())).cast("timestamp_ntz")) & (F.col("date") < F.lit(stop).cast("timestamp_ntz"))
    return found & F.col("year").between(start.year, end.year) if "year" in df.columns else found


def months_in_span(start: date, end: date) -> Column:
    """Whole months that the span touches, for tables by month."""
    return F.col("month").between(F.lit(start.replace(day=1)), F.lit(end))


def in_categories(taxonomy: str, values: list[str]) -> Column:
    return F.col(TAXONOMIES[taxonomy]).isin([v.strip().upper() for v in values]) if values else F.lit(True)


def in_geographies(level: str, values: list) -> Column:
    """Citywide has no values to filter by."""
    column = GEOGRAPHIES[level]
    if not values or column is None:
        return F.lit(True)
    return F.col(column).isin(*(geography_key(F.lit(str(v)), level) for v in values))


def has_flag(name: str, value: bool | None) -> Column:
    """Rows whose flag is unknown match neither value; None is no filter."""
    return F.lit(True) if value is None else F.col(name) == F.lit(value)


def is_case(number: str) -> Column:
    return F.upper("case_number") == number.strip().upper()


def before(at: datetime, last_id: int) -> Column:
    """What comes after (at, last_id) in newest-first order, in a form that scans can use."""
    when = F.lit(at).cast("timestamp_ntz")
    return (F.col("date") <= when) & ((F.col("date") < when) | (F.col("id") < last_id))


def in_year(year: int) -> Column:
    return F.col("year") == year


def changed_since(watermark: Column, overlap_days: int = 1) -> Column:
    """Rows updated after the watermark (in whole seconds) less an overlap for late edits."""
    cutoff = F.date_trunc("second", watermark).cast("timestamp_ntz") - F.expr(f"INTERVAL {overlap_days} DAY")
    return F.col("updated_on") > cutoff


def geocoded() -> Column:
    return F.col("latitude").isNotNull()


__all__ = ["before", "category_key", "changed_since", "geocoded", "has_flag", "in_categories", "in_geographies", "in_span", "in_year", "is_case", "months_in_span"]
