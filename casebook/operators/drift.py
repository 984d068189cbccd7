"""Codes that appear or vanish inside a span, and their share of its rows.

Works on the monthly counts by code and the codes' lifespans, never on the rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.functions.columns import rate
from casebook.functions.predicates import in_categories

#: Months past an end of the span within which absence is not drift.
BUFFER = 12
LARGEST = 10
#: Share of rows from which drift is reported.
REPORTED = 0.005


def _lifespans(coverage: DataFrame) -> DataFrame:
    return coverage.select("iucr", "first_month", "last_month")


def _drifts() -> Column:
    """Whether a code was first seen too long after the span's start, or last seen too long before its end."""
    return (F.col("first_month") > F.add_months("from_month", BUFFER)) | (F.col("last_month") < F.add_months("to_month", -BUFFER))


def running(months: DataFrame, last: Column) -> DataFrame:
    """month, iucr and upto: rows of a code up to and with a month, for every month from the
    code's first to `last`. A month without rows repeats the one before, so that the entry as
    of any month is found by equality; there are as many as codes times months."""
    counts = months.groupBy("iucr", "month").agg(F.sum("incidents").alias("n"))
    code = Window.partitionBy("iucr").orderBy("month")
    sums = counts.withColumns({"upto": F.sum("n").over(code), "until": F.add_months(F.lead("month").over(code), -1)})
    each = F.sequence("month", F.coalesce("until", last), F.expr("INTERVAL 1 MONTH"))
    return sums.select("iucr", F.explode(each).alias("month"), "upto")


def batch_report(months: DataFrame, coverage: DataFrame, meta: DataFrame, spans: DataFrame, taxonomy: str = "source", categories: list[str] = ()) -> DataFrame:
    """span_id, total, affected, share, n_codes and reported, for spans (span_id, start, end).

    Spans are cut to the months that have data. What a code has in a span is the running sum
    at its end less that before its start. Spans of equal months have equal answers, so the
    sums are joined to the distinct pairs of months, at most the square of the months there
    are, and the answers to any number of spans."""
    months = months.where(in_categories(taxonomy, list(categories)))
    first, last = (meta.select(F.trunc(F.to_date(c), "month")).scalar() for c in ("min_date", "max_date"))
    asked = spans.select("span_id", F.greatest(F.trunc("start", "month"), first).alias("from_month"), F.least(F.trunc("end", "month"), last).alias("to_month"))
    pairs = asked.where("from_month <= to_month").select("from_month", "to_month").distinct()
    sums = running(months, last)
    at_end = sums.select(F.col("month").alias("to_month"), "iucr", "upto")
    before = sums.select(F.add_months("month", 1).alias("from_month"), F.col("iucr").alias("__code"), F.col("upto").alias("earlier"))
    counts = pairs.join(at_end, "to_month")
    same = (counts["from_month"] == before["from_month"]) & counts["iucr"].eqNullSafe(before["__code"])
    counts = counts.join(before, same, "left").select(counts["from_month"], "to_month", "iucr", (F.col("upto") - F.coalesce("earlier", F.lit(0))).alias("incidents")).where("incidents > 0")
    counts = counts.join(_lifespans(coverage).where("iucr IS NOT NULL"), "iucr", "left")
    hit = F.col("iucr").isNotNull() & _drifts()
    found = counts.groupBy("from_month", "to_month").agg(
        F.sum("incidents").alias("total"), F.sum(F.when(hit, F.col("incidents")).otherwise(0)).alias("affected"), F.count_if(hit).alias("n_codes")
    )
    rows = asked.join(found, ["from_month", "to_month"], "left")
    rows = rows.select("span_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "affected", "n_codes")))
    return rows.withColumn("share", rate(F.col("affected"), F.col("total"))).withColumn("reported", F.col("share") >= REPORTED)


def codes(months: DataFrame, coverage: DataFrame, meta: DataFrame, start: date, end: date, taxonomy: str = "source", categories: list[str] = ()) -> DataFrame:
    """The largest drifting codes of one span: iucr, first_month, last_month, incidents, introduced."""
    first, last = (meta.select(F.trunc(F.to_date(c), "month")).scalar() for c in ("min_date", "max_date"))
    low, high = F.greatest(F.trunc(F.lit(start), "month"), first), F.least(F.trunc(F.lit(end), "month"), last)
    rows = months.where(in_categories(taxonomy, list(categories)) & F.col("month").between(low, high) & F.col("iucr").isNotNull())
    counts = rows.groupBy("iucr").agg(F.sum("incidents").alias("incidents")).withColumns({"from_month": low, "to_month": high})
    hit = counts.join(_lifespans(coverage), "iucr").where(_drifts())
    introduced = F.col("first_month") > F.add_months("from_month", BUFFER)
    return hit.select("iucr", "first_month", "last_month", "incidents", introduced.alias("introduced")).orderBy(F.desc("incidents"), "iucr").limit(LARGEST)
