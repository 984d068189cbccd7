"""Counts by period, category and geography: whole months from a rollup, other days from the
rows, by one plan that differs in its source only."""

from __future__ import annotations

from calendar import monthrange
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.functions.columns import next_period, period, rate
from casebook.functions.predicates import in_categories, in_geographies, in_span, months_in_span
from casebook.operators.rollups import counted, summed
from casebook.sources.schema import GEOGRAPHIES, MEASURES, TAXONOMIES, UNSTABLE


@dataclass(frozen=True)
class Request:
    start: date
    end: date
    grain: str = "month"
    taxonomy: str = "source"
    level: str = "citywide"
    categories: tuple[str, ...] = ()
    geographies: tuple = ()
    by_category: bool = True
    by_geography: bool = True
    limit: int = 500

    def __post_init__(self):
        if self.start > self.end:
            raise ValueError("the span ends before it starts")
        if not 1 <= self.limit <= 2000:
            raise ValueError("a limit is from 1 to 2000")

    @property
    def whole_months(self) -> bool:
        return self.start.day == 1 and self.end.day == monthrange(self.end.year, self.end.month)[1]

    def parts(self) -> tuple[tuple[date, date] | None, list[tuple[date, date]]]:
        """The whole months of the span, if there are any, and the days before and after them."""
        first = self.start if self.start.day == 1 else (self.start.replace(day=28) + timedelta(days=4)).replace(day=1)
        last = self.end if (self.end + timedelta(days=1)).day == 1 else self.end.replace(day=1) - timedelta(days=1)
        if first > last:
            return None, [(self.start, self.end)]
        edges = [(self.start, first - timedelta(days=1)), (last + timedelta(days=1), self.end)]
        return (first, last), [(a, b) for a, b in edges if a <= b]

    @property
    def dims(self) -> list[str]:
        geography = GEOGRAPHIES[self.level]
        return ["period", *(["category"] if self.by_category else []), *([geography] if geography and self.by_geography else [])]


def _grouped(source: DataFrame, request: Request, when: str, measures) -> DataFrame:
    rows = source.where(in_categories(request.taxonomy, list(request.categories)) & in_geographies(request.level, list(request.geographies)))
    rows = rows.withColumns({"period": period(F.col(when), request.grain), "category": F.col(TAXONOMIES[request.taxonomy])})
    return rows.groupBy(*request.dims).agg(*measures)


def from_rows(incidents: DataFrame, request: Request) -> DataFrame:
    return _grouped(incidents.where(in_span(incidents, request.start, request.end)), request, "date", counted())


def from_rollup(rollup: DataFrame, request: Request) -> DataFrame:
    if not request.whole_months:
        raise ValueError("a rollup answers whole months only")
    return _grouped(rollup.where(months_in_span(request.start, request.end)), request, "month", summed())


def from_both(incidents: DataFrame, rollup: DataFrame, request: Request) -> DataFrame:
    """Whole months from the rollup and the days at both ends, less than two months of rows,
    from the incidents, added."""
    months, edges = request.parts()
    days = reduce(lambda a, b: a | b, (in_span(incidents, *edge) for edge in edges), F.lit(False))
    found = _grouped(incidents.where(days), request, "date", counted())
    if months:
        found = found.unionByName(_grouped(rollup.where(months_in_span(*months)), request, "month", summed()))
    return found.groupBy(*request.dims).agg(*summed())


def aggregate(incidents: DataFrame, rollups: dict[str, DataFrame], request: Request) -> DataFrame:
    """All groups, with rates: from the level's rollup where there is one, but for days beside whole months."""
    table = rollups.get(request.level)
    if table is None:
        found = from_rows(incidents, request)
    else:
        found = from_rollup(table, request) if request.whole_months else from_both(incidents, table, request)
    return found.withColumns({"arrest_rate": rate(F.col("arrests"), F.col("incidents")), "geocode_rate": rate(F.col("geocoded"), F.col("incidents"))})


def ordered(found: DataFrame, request: Request) -> DataFrame:
    """The first `limit` groups and one more, which tells that there are more."""
    return found.orderBy(*(F.col(c).asc_nulls_last() for c in request.dims)).limit(request.limit + 1)


def with_edges(found: DataFrame, meta: DataFrame, request: Request) -> DataFrame:
    """Adds whether a group's period is only partly in the span, whether it reaches past
    the newest incident, and whether its level's boundaries moved within the span."""
    start, stop = F.lit(request.start), F.date_add(F.lit(request.end), 1)
    after = next_period(F.col("period"), request.grain)
    newest = meta.select(F.to_date("max_date")).scalar()
    return found.withColumns(
        {
            "partial_period": (start > F.col("period")) | (stop < after),
            "provisional": after > newest,
            "boundary_instability": F.lit(request.level in UNSTABLE and request.start.year != request.end.year),
        }
    )


def geocode_coverage(rollup: DataFrame, taxonomy: str = "source", start: date | None = None, end: date | None = None, categories: list[str] = ()) -> DataFrame:
    """category, incidents, geocoded and geocode_rate; category null is the total over the named ones."""
    rows = rollup.where(in_categories(taxonomy, list(categories)))
    if start and end:
        rows = rows.where(months_in_span(start, end))
    rows = rows.withColumn("category", F.col(TAXONOMIES[taxonomy])).where("category IS NOT NULL")
    found = rows.rollup("category").agg(F.sum("incidents").alias("incidents"), F.sum("geocoded").alias("geocoded")).where("incidents > 0")
    return found.withColumn("geocode_rate", rate(F.col("geocoded"), F.col("incidents")))


__all__ = ["MEASURES", "Request", "aggregate", "from_both", "from_rollup", "from_rows", "geocode_coverage", "ordered", "with_edges"]
