"""Queries on rollups, aggregates, drift, rows, radius and findings (FLT, AGG, JOIN, WIN, SORT, QUAL)."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from casebook.functions import geo
from casebook.functions import predicates as P
from casebook.operators import aggregate as A
from casebook.operators import drift, findings, merge, profile, radius, rollups, rows
from casebook.plans import standin
from casebook.plans.ingest import SYNCED, begin_sync, inc, stored
from casebook.plans.registry import query
from casebook.plans.standin import table
from casebook.sources import storage
from casebook.sources.schema import GEOGRAPHIES

B = "CAST({} AS BIGINT)"
COUNTED = "count(*) AS incidents, CAST(count_if(arrest) AS BIGINT) AS arrests, CAST(count_if(domestic) AS BIGINT) AS domestic, CAST(count_if(latitude IS NOT NULL) AS BIGINT) AS geocoded"
MONTH = "CAST(date_trunc('month', date) AS DATE)"
RATES = "coalesce(arrests / nullif(incidents, 0), 0.0) AS arrest_rate, coalesce(geocoded / nullif(incidents, 0), 0.0) AS geocode_rate"


def _rollup_query(number: int, level: str) -> None:
    geography = GEOGRAPHIES[level]
    more = f", {geography}" if geography else ""

    def run(spark, d):
        return rollups.rollup(inc(spark, d), level)

    run.__name__ = f"agg{number:02d}_rollup_{level}"
    query(f"SELECT {MONTH} AS month, primary_type_canonical, stable_category{more}, {COUNTED} FROM incidents GROUP BY ALL")(run)


for _number, _level in enumerate(GEOGRAPHIES, 1):
    _rollup_query(_number, _level)


@query("SELECT count(*) AS row_count, count(DISTINCT year(date)) AS partition_count, min(date) AS min_date, max(date) AS max_date, true AS has_build_time FROM incidents")
def agg06_rollup_meta(spark, d):
    found = rollups.dataset_meta(spark, rollups_of(spark, d))
    return found.select("row_count", "partition_count", "min_date", "max_date", F.col("built_at").isNotNull().alias("has_build_time"))


COVERAGE = f"coverage AS (SELECT iucr, min(primary_type) AS primary_type, min(primary_type_canonical) AS primary_type_canonical, min(stable_category) AS stable_category, min({MONTH}) AS first_month, max({MONTH}) AS last_month, count(*) AS incidents FROM incidents GROUP BY iucr)"


@query(f", {COVERAGE} SELECT * FROM coverage")
def agg07_code_coverage(spark, d):
    return rollups.code_coverage(inc(spark, d))


@query(f"SELECT {MONTH} AS month, iucr, primary_type_canonical, stable_category, count(*) AS incidents FROM incidents GROUP BY ALL")
def agg08_code_months(spark, d):
    return rollups.code_months(inc(spark, d))


BUILT = " UNION ALL ".join(
    f"SELECT 'rollup_{level}' AS table_name, count(*) AS n_rows FROM (SELECT DISTINCT {MONTH}, primary_type_canonical, stable_category{', ' + g if g else ''} FROM incidents)" for level, g in GEOGRAPHIES.items()
) + f" UNION ALL SELECT 'rollup_code_month', count(*) FROM (SELECT DISTINCT {MONTH}, iucr, primary_type_canonical, stable_category FROM incidents) UNION ALL SELECT 'code_coverage', count(DISTINCT iucr) FROM incidents UNION ALL SELECT 'rollup_meta', 1"


@query(BUILT)
def agg09_sort08_build_rollups(spark, d):
    return rollups.build(inc(spark, d), storage.new_folder(spark, "rollups"), 1)


#: Stored rollups by application and by the very files they were built from.
_BUILT: dict[tuple[str, str, str], str] = {}


def _once(spark, d, name: str, make) -> str:
    key = spark.sparkContext.applicationId, storage.stamp(spark, inc(spark, d)), name
    if key not in _BUILT:
        _BUILT[key] = make(spark, d)
    return _BUILT[key]


def _build(spark, d) -> str:
    root = storage.new_folder(spark, "rollups")
    rollups.build(inc(spark, d), root, 1)
    return root


def rollups_of(spark, d) -> str:
    """Where the stored rollups of the table are; they are built once for the files as they are."""
    return _once(spark, d, "rollups", _build)


def published(spark, d, level):
    """A stored rollup of the table."""
    return rollups.published(spark, rollups_of(spark, d), f"rollup_{level}")


@query(f"""SELECT table_name, n_rows, CAST(0 AS BIGINT) AS n_out_of_order FROM ({BUILT}) WHERE table_name NOT IN ('code_coverage', 'rollup_meta')""")
def sort08_stored_order(spark, d):
    found = spark.read.parquet(f"{rollups_of(spark, d)}/v=1/rollups").where(F.col("table_name").isin(list(rollups.TABLES)))
    keys = F.struct("month", *rollups.CATEGORIES)
    found = found.select("table_name", keys.alias("key"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    before = F.lag("key").over(Window.partitionBy("file").orderBy("at"))
    return found.withColumn("before", before).groupBy("table_name").agg(F.count("*").alias("n_rows"), F.count_if(F.col("before") > F.col("key")).alias("n_out_of_order"))


#: The sync's rows as it stores them: with the categories of the code table.
TAGGED_SYNC = SYNCED.replace("(SELECT * FROM changed", """(SELECT n.* REPLACE (coalesce(c.primary_description, n.primary_type) AS primary_type_canonical,
  coalesce(nullif(trim(c.stable_category), ''), c.primary_description, n.primary_type) AS stable_category) FROM changed n LEFT JOIN codes c USING (iucr)""")
DELTAS = f"""SELECT {MONTH} AS month, primary_type_canonical, stable_category, ward, {COUNTED} FROM merged GROUP BY ALL"""


@query(f", {TAGGED_SYNC} {DELTAS}")
def agg05_after_merge(spark, d):
    """The ward rollup after a sync, by what changed alone."""
    return rollups.published(spark, _once(spark, d, "synced", _synced), "rollup_ward")


@query(f""", {TAGGED_SYNC} SELECT iucr, min(primary_type) AS primary_type, min(primary_type_canonical) AS primary_type_canonical, min(stable_category) AS stable_category, min({MONTH}) AS first_month, max({MONTH}) AS last_month, count(*) AS incidents FROM merged GROUP BY iucr""")
def agg07_after_merge(spark, d):
    return rollups.published(spark, _once(spark, d, "synced", _synced), "code_coverage")


@query(f", {TAGGED_SYNC} SELECT count(*) AS row_count, count(DISTINCT year(date)) AS partition_count, min(date) AS min_date, max(date) AS max_date FROM merged")
def agg06_after_merge(spark, d):
    return rollups.dataset_meta(spark, _once(spark, d, "synced", _synced)).select("row_count", "partition_count", "min_date", "max_date")


def _synced(spark, d) -> str:
    """Rollups that were built before a sync and changed by it."""
    root, folder, state = stored(spark, d), storage.new_folder(spark, "rollups"), storage.new_folder(spark, "state")
    df = storage.read_incidents(spark, root).drop("year")
    rollups.build(df, folder, 1)
    begin_sync(spark, df, state)
    merge.sync(spark, root, standin.feed(standin.changed(df)), standin.codes(df), state, folder)
    return folder


SPAN = (date(1996, 1, 1), date(1998, 12, 31))
IN_SPAN = "date >= timestamp '1996-01-01' AND date < timestamp '1999-01-01'"
YEARS = A.Request(*SPAN, grain="year", by_category=False)
BY_WARD = A.Request(*SPAN, grain="quarter", taxonomy="comparable", level="ward", categories=(" high ", "MEDIUM"), geographies=(3, 7, 11))


@query(f"SELECT CAST(date_trunc('year', date) AS DATE) AS period, {COUNTED} FROM incidents WHERE {IN_SPAN} GROUP BY 1")
def year_totals_scan(spark, d):
    return A.from_rows(inc(spark, d), YEARS)


@query(f"SELECT CAST(date_trunc('year', date) AS DATE) AS period, {COUNTED} FROM incidents WHERE {IN_SPAN} GROUP BY 1")
def agg10_year_totals_rollup(spark, d):
    return A.from_rollup(published(spark, d, "citywide"), YEARS)


WARDS = f"SELECT CAST(date_trunc('quarter', date) AS DATE) AS period, stable_category AS category, ward, {COUNTED} FROM incidents WHERE {IN_SPAN} AND stable_category IN ('HIGH', 'MEDIUM') AND ward IN (3, 7, 11) GROUP BY ALL"


@query(f"SELECT *, {RATES} FROM ({WARDS})")
def agg10_ward_quarters_rollup(spark, d):
    return A.aggregate(inc(spark, d), {"ward": published(spark, d, "ward")}, BY_WARD)


@query(f"SELECT *, {RATES} FROM ({WARDS})")
def agg11_col19_ward_quarters_scan(spark, d):
    return A.aggregate(inc(spark, d), {}, BY_WARD)


RAGGED = "date >= timestamp '1996-03-10' AND date < timestamp '1998-06-21'"


@query(f"SELECT *, {RATES} FROM (SELECT CAST(date_trunc('month', date) AS DATE) AS period, primary_type_canonical AS category, ward, {COUNTED} FROM incidents WHERE {RAGGED} GROUP BY ALL)")
def agg10_agg11_ragged_span(spark, d):
    """Whole months from the stored rollup, the days at both ends from the stored rows."""
    request = A.Request(date(1996, 3, 10), date(1998, 6, 20), level="ward")
    return A.aggregate(storage.read_incidents(spark, stored(spark, d)), {"ward": published(spark, d, "ward")}, request)


@query(f"SELECT CAST(date_trunc('month', date) AS DATE) AS period, beat, {COUNTED} FROM incidents WHERE date >= timestamp '1997-03-10' AND date < timestamp '1997-06-21' AND beat IN ('0111', '0010') GROUP BY ALL")
def agg12_13_total_by_beat(spark, d):
    request = A.Request(date(1997, 3, 10), date(1997, 6, 20), level="beat", geographies=("111", "10"), by_category=False)
    return A.from_rows(inc(spark, d), request)


@query(f"SELECT CAST(date_trunc('month', date) AS DATE) AS period, primary_type_canonical AS category, {COUNTED} FROM incidents WHERE {IN_SPAN} AND district IN ('003', '010') GROUP BY ALL")
def agg13_geography_as_filter(spark, d):
    request = A.Request(*SPAN, level="district", geographies=("3", "10"), by_geography=False)
    return A.from_rows(inc(spark, d), request)


@query(f"SELECT CAST(date_trunc('month', date) AS DATE) AS period, primary_type_canonical AS category, community_area, {COUNTED} FROM incidents WHERE {IN_SPAN} GROUP BY ALL ORDER BY period, category, community_area NULLS LAST LIMIT 101")
def sort01_first_groups(spark, d):
    request = A.Request(*SPAN, level="community_area", limit=100)
    return A.ordered(A.from_rows(inc(spark, d), request), request)


@query(f"SELECT count(*) AS total FROM incidents WHERE {IN_SPAN} AND primary_type_canonical IN ('HIGH', 'URGENT')")
def agg14_total_in_span(spark, d):
    months = published(spark, d, "code_month")
    rows = months.where(P.months_in_span(*SPAN) & P.in_categories("source", ["HIGH", "URGENT"]))
    return rows.agg(F.coalesce(F.sum("incidents"), F.lit(0)).alias("total"))


@query(f"SELECT iucr, count(*) AS incidents FROM incidents WHERE {IN_SPAN} AND iucr IS NOT NULL GROUP BY iucr")
def agg15_flt12_13_code_totals(spark, d):
    months = published(spark, d, "code_month")
    return months.where(P.months_in_span(*SPAN) & F.col("iucr").isNotNull()).groupBy("iucr").agg(F.sum("incidents").alias("incidents"))


GEOCODED = "SELECT primary_type_canonical AS category, count(*) AS incidents, CAST(count_if(latitude IS NOT NULL) AS BIGINT) AS geocoded FROM incidents WHERE primary_type_canonical IS NOT NULL GROUP BY ROLLUP (primary_type_canonical)"


@query(f"SELECT *, geocoded / incidents AS geocode_rate FROM ({GEOCODED})")
def agg16_geocode_coverage(spark, d):
    return A.geocode_coverage(published(spark, d, "citywide"))


@query("SELECT DISTINCT stable_category FROM incidents WHERE stable_category IS NOT NULL")
def agg17_categories(spark, d):
    return profile.distinct_values(published(spark, d, "citywide"), "stable_category")


@query("SELECT DISTINCT community_area FROM incidents WHERE community_area IS NOT NULL")
def agg18_geography_values(spark, d):
    return profile.distinct_values(published(spark, d, "community_area"), "community_area")


WORDS = """words AS (SELECT DISTINCT 'category' AS dimension, 'source' AS taxonomy, primary_type_canonical AS value, false AS stable_over_time FROM incidents WHERE primary_type_canonical IS NOT NULL
UNION ALL SELECT DISTINCT 'category', 'comparable', stable_category, true FROM incidents WHERE stable_category IS NOT NULL
UNION ALL SELECT DISTINCT 'beat', NULL, beat, false FROM incidents WHERE beat IS NOT NULL UNION ALL SELECT DISTINCT 'district', NULL, district, false FROM incidents WHERE district IS NOT NULL
UNION ALL SELECT DISTINCT 'community_area', NULL, CAST(community_area AS string), true FROM incidents WHERE community_area IS NOT NULL UNION ALL SELECT DISTINCT 'ward', NULL, CAST(ward AS string), false FROM incidents WHERE ward IS NOT NULL)"""


def _words(spark, d):
    root = rollups_of(spark, d)
    return profile.vocabulary({level: rollups.published(spark, root, f"rollup_{level}") for level in GEOGRAPHIES})


@query(f", {WORDS} SELECT * FROM words")
def agg19_vocabulary(spark, d):
    return _words(spark, d)


@query(f", {WORDS} SELECT dimension, taxonomy, count(*) AS n_values FROM words GROUP BY ALL")
def agg19_vocabulary_sizes(spark, d):
    return profile.vocabulary_sizes(_words(spark, d))


POINT = (41.75, -87.8, 5000.0)


def distance_sql(lat="latitude", lon="longitude", to_lat="41.75", to_lon="-87.8") -> str:
    found = f"2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians({lat} - ({to_lat})) / 2), 2) + cos(radians({to_lat})) * cos(radians({lat})) * pow(sin(radians({lon} - ({to_lon})) / 2), 2))))"
    return f"CASE WHEN {lat} IS NOT NULL AND {lon} IS NOT NULL THEN {found} END"


NEAR = f"near AS (SELECT *, {distance_sql()} AS distance_m FROM incidents WHERE {distance_sql()} <= 5000), ringed AS (SELECT primary_type_canonical AS category, least(4, 1 + CAST(floor(distance_m * 4 / 5000) AS INTEGER)) AS ring, count(*) AS incidents FROM near GROUP BY ALL)"


def _near(spark, d):
    return radius.within(inc(spark, d), *POINT)


@query("SELECT id, latitude, longitude, CAST(floor(latitude / 0.05E0) AS INTEGER) AS cell_lat, CAST(floor(longitude / 0.05E0) AS INTEGER) AS cell_lon FROM incidents")
def col16_point(spark, d):
    return radius.with_point(inc(spark, d)).select("id", "latitude", "longitude", "cell_lat", "cell_lon")


@query(f"SELECT id, round({distance_sql()}, 3) AS distance_m FROM incidents")
def col17_distance(spark, d):
    at = (F.lit(POINT[0]), F.lit(POINT[1]))
    return inc(spark, d).select("id", F.round(geo.distance_m(F.col("latitude"), F.col("longitude"), *at), 3).alias("distance_m"))


@query(f", {NEAR} SELECT id, least(4, 1 + CAST(floor(distance_m * 4 / 5000) AS INTEGER)) AS ring FROM near")
def col18_flt07_ring(spark, d):
    return _near(spark, d).select("id", geo.ring(F.col("distance_m"), F.lit(POINT[2])).alias("ring"))


@query(f", {NEAR} SELECT * FROM ringed")
def agg20_ring_counts(spark, d):
    return radius.ring_counts(_near(spark, d), POINT[2])


@query(f""", {NEAR} SELECT 'total' AS kind, NULL AS category, CAST(NULL AS INTEGER) AS ring, coalesce(CAST(sum(incidents) AS BIGINT), 0) AS incidents FROM ringed
UNION ALL SELECT 'category', category, NULL, CAST(sum(incidents) AS BIGINT) FROM ringed GROUP BY category
UNION ALL SELECT 'ring', NULL, r.ring, coalesce(CAST(sum(incidents) AS BIGINT), 0) FROM (SELECT CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS ring) r LEFT JOIN ringed USING (ring) GROUP BY r.ring""")
def agg21_radius_summary(spark, d):
    return radius.summary(radius.ring_counts(_near(spark, d), POINT[2]))


@query(f", {NEAR} SELECT category, CAST(sum(incidents) AS BIGINT) AS incidents FROM ringed GROUP BY category")
def sort05_categories_by_size(spark, d):
    return radius.by_size(radius.ring_counts(_near(spark, d), POINT[2]))


@query(f"SELECT id, round(distance_m, 3) AS distance_m FROM (SELECT id, {distance_sql()} AS distance_m FROM incidents WHERE latitude IS NOT NULL ORDER BY distance_m, id LIMIT 10)")
def win02_sort03_nearest(spark, d):
    return radius.nearest(inc(spark, d), *POINT[:2]).select("id", F.round("distance_m", 3).alias("distance_m"))


@query(f", {NEAR} SELECT id, date, iucr FROM near ORDER BY date DESC, id DESC LIMIT 51")
def sort04_rows_in_radius(spark, d):
    return rows.newest(_near(spark, d)).select("id", "date", "iucr")


@query(f", {NEAR} SELECT id, round(distance_m, 3) AS distance_m FROM near")
def flt07_by_place(spark, d):
    """The rows of a circle from a table laid out along a curve."""
    root = storage.new_folder(spark, "places")
    storage.write_by_place(inc(spark, d), root)
    near = radius.within(storage.read_incidents(spark, root), *POINT)
    return near.select("id", F.round("distance_m", 3).alias("distance_m"))


POINTS_SQL = "points AS (SELECT s_suppkey AS point_id, 41.65E0 + (s_suppkey % 37) / 100E0 AS lat, -87.93E0 + (s_suppkey % 41) / 100E0 AS lon, 300.0E0 + 100 * (s_suppkey % 12) AS radius FROM supplier)"


def _points(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("point_id"), (41.65 + (k % 37) / 100.0).alias("lat"), (-87.93 + (k % 41) / 100.0).alias("lon"), (300.0 + 100 * (k % 12)).alias("radius"))


PAIRS = f"pairs AS (SELECT point_id, id, radius, {distance_sql('latitude', 'longitude', 'lat', 'lon')} AS distance_m FROM points JOIN incidents ON abs(latitude - lat) < 0.05 AND latitude IS NOT NULL WHERE {distance_sql('latitude', 'longitude', 'lat', 'lon')} <= radius)"


@query(f", {POINTS_SQL}, {PAIRS} SELECT point_id, id, round(distance_m, 3) AS distance_m FROM pairs")
def join08_radius_join(spark, d):
    return radius.radius_join(inc(spark, d), _points(spark, d), digits=3).select("point_id", "id", "distance_m")


@query(f", {POINTS_SQL}, {PAIRS} SELECT point_id, id, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance_m, id) AS k FROM pairs) WHERE k <= 3")
def win02_nearest_join(spark, d):
    return radius.nearest_join(inc(spark, d), _points(spark, d), 3).select("point_id", "id", "rank")


@query(f""", {NEAR}, c AS (SELECT primary_type_canonical AS category, count(*) AS n, count(latitude) AS g FROM incidents WHERE primary_type_canonical IN (SELECT primary_type_canonical FROM near) GROUP BY 1)
SELECT sum(g) / sum(n) AS geocode_rate, arg_min(category, (g / n, category)) AS worst_category, min(g / n) AS worst_rate FROM c""")
def qual05_join09_ungeocoded(spark, d):
    coverage = A.geocode_coverage(published(spark, d, "citywide"))
    return radius.ungeocoded_finding(radius.within(inc(spark, d), *POINT), coverage)


DRIFT = f"""{COVERAGE}, ends AS (SELECT min({MONTH}) AS lo, max({MONTH}) AS hi FROM incidents),
spans AS (SELECT CAST(row_number() OVER (ORDER BY m) AS BIGINT) AS span_id, m AS start_, CAST(m + INTERVAL 17 MONTH AS DATE) AS end_ FROM (SELECT DISTINCT {MONTH} AS m FROM incidents)),
clamped AS (SELECT span_id, greatest(start_, lo) AS a, least(CAST(date_trunc('month', end_) AS DATE), hi) AS b FROM spans, ends),
weights AS (SELECT span_id, a, b, i.iucr, count(*) AS n FROM clamped JOIN incidents i ON {MONTH} BETWEEN a AND b GROUP BY ALL),
drifting AS (SELECT w.*, c.first_month, c.last_month FROM weights w JOIN coverage c USING (iucr) WHERE c.first_month > w.a + INTERVAL 12 MONTH OR c.last_month < w.b - INTERVAL 12 MONTH)"""


@query(f""", {DRIFT}, t AS (SELECT span_id, sum(n) AS total FROM weights GROUP BY 1), h AS (SELECT span_id, sum(n) AS affected, count(*) AS n_codes FROM drifting GROUP BY 1)
SELECT span_id, CAST(coalesce(total, 0) AS BIGINT) AS total, CAST(coalesce(affected, 0) AS BIGINT) AS affected, coalesce(n_codes, 0) AS n_codes, coalesce(affected / total, 0.0) AS share, coalesce(affected / total, 0.0) >= 0.005 AS reported
FROM clamped LEFT JOIN t USING (span_id) LEFT JOIN h USING (span_id)""")
def qual03_join03_drift_of_spans(spark, d):
    months, coverage, meta = _code_tables(spark, d)
    starts = months.select("month").distinct().selectExpr("CAST(row_number() OVER (ORDER BY month) AS bigint) AS span_id", "month AS start", "add_months(month, 17) AS end")
    return drift.batch_report(months, coverage, meta, starts)


def _code_tables(spark, d):
    root = rollups_of(spark, d)
    return [rollups.published(spark, root, name) for name in ("rollup_code_month", "code_coverage", "rollup_meta")]


@query(f", {COVERAGE} SELECT c.iucr, first_month, last_month, count(*) AS incidents, first_month > DATE '1998-01-01' AS introduced FROM incidents i JOIN coverage c USING (iucr) WHERE {MONTH} BETWEEN DATE '1997-01-01' AND DATE '1999-12-01' AND (first_month > DATE '1998-01-01' OR last_month < DATE '1998-12-01') GROUP BY ALL ORDER BY incidents DESC, c.iucr LIMIT 10")
def sort06_drifting_codes(spark, d):
    return drift.codes(*_code_tables(spark, d), date(1997, 1, 1), date(1999, 12, 31))


@query("SELECT id, date, iucr FROM incidents WHERE date >= timestamp '1997-03-01' AND date < timestamp '1998-01-01' AND stable_category IN ('HIGH') AND ward <= 20 AND arrest AND NOT domestic")
def flt01_04_filters(spark, d):
    df = storage.read_incidents(spark, stored(spark, d))
    keep = P.in_span(df, date(1997, 3, 1), date(1997, 12, 31)) & P.in_categories("comparable", ["high"]) & P.in_geographies("ward", list(range(1, 21)))
    return df.where(keep & P.has_flag("arrest", True) & P.has_flag("domestic", False)).select("id", "date", "iucr")


@query("SELECT id, case_number FROM incidents WHERE upper(case_number) = 'JF000007'")
def flt06_case_number(spark, d):
    return inc(spark, d).where(P.is_case(" jf000007 ")).select("id", "case_number")


@query("SELECT id, latitude FROM incidents WHERE latitude IS NOT NULL")
def flt11_geocoded(spark, d):
    return inc(spark, d).where(P.geocoded()).select("id", "latitude")


@query("""SELECT id, case_number, date, block, description, location_description, arrest, domestic, beat, district, ward, community_area, latitude, longitude, primary_type_canonical, stable_category
FROM records ORDER BY date DESC, id DESC LIMIT 51""")
def col15_sort02_newest(spark, d):
    return rows.projected(rows.newest(standin.records(inc(spark, d))))


@query("SELECT * FROM records WHERE arrest AND date >= timestamp '2001-01-01'")
def col15_full_record(spark, d):
    return rows.projected(standin.records(inc(spark, d)).where("arrest AND date >= timestamp '2001-01-01'"), full=True)


@query("SELECT id, date FROM incidents WHERE date < timestamp '1997-06-15' OR date = timestamp '1997-06-15' AND id < 9000 ORDER BY date DESC, id DESC LIMIT 51")
def flt08_next_page(spark, d):
    return rows.newest(inc(spark, d), after=(datetime(1997, 6, 15), 9000)).select("id", "date")


@query("SELECT id, case_number, date FROM incidents WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 48)")
def flt05_join06_sort07_ids(spark, d):
    keys = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 48").select(F.col("l_orderkey").alias("id"))
    return rows.lookup(inc(spark, d), keys).select("id", "case_number", "date")


@query("SELECT id, case_number FROM incidents WHERE case_number IN (SELECT 'JF' || lpad(CAST(c_custkey AS string), 6, '0') FROM customer WHERE c_mktsegment = 'BUILDING')")
def join06_case_numbers(spark, d):
    keys = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit(" jf"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("case_number"))
    return rows.lookup(inc(spark, d), keys, "case_number").select("id", "case_number")


FILTERS = {"categories": ["HIGH"], "taxonomy": "source"}


@query(f"""SELECT CAST((k - 1) // 50 AS BIGINT) AS page, count(*) AS n_rows, arg_min(date, k) AS first_date, arg_min(id, k) AS first_id, arg_max(date, k) AS last_date, arg_max(id, k) AS last_id, sha256('{rows.filter_text(FILTERS)}') AS filter_hash
FROM (SELECT date, id, row_number() OVER (ORDER BY date DESC, id DESC) AS k FROM incidents WHERE primary_type_canonical = 'HIGH') GROUP BY 1""")
def win03_page_boundaries(spark, d):
    return rows.page_boundaries(inc(spark, d).where(P.in_categories("source", FILTERS["categories"])), 50, FILTERS)


@query("SELECT id, date FROM incidents WHERE primary_type_canonical = 'HIGH' ORDER BY date DESC, id DESC LIMIT 20 OFFSET 140")
def win03_flt08_stored_page(spark, d):
    """The eighth page of 20, by a seek in a stored index of every 64th key."""
    df, path = storage.read_incidents(spark, stored(spark, d)), storage.new_folder(spark, "pages")
    found = df.where(P.in_categories("source", FILTERS["categories"]))
    rows.store_pages(found, path, FILTERS, every=64)
    return rows.stored_page(found, path, FILTERS, 7, 20).select("id", "date")


@query("SELECT case_number, count(*) AS n_rows FROM incidents GROUP BY 1 HAVING count(*) > 1")
def qual06_shared_case_numbers(spark, d):
    return rows.shared_case_numbers(inc(spark, d))


@query("""SELECT CAST(date_trunc('quarter', date) AS DATE) AS period, ward, count(*) AS incidents, CAST(date_trunc('quarter', date) AS DATE) < DATE '1999-02-10' OR DATE '2001-08-16' < CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH AS DATE) AS partial_period,
  CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH AS DATE) > (SELECT CAST(max(date) AS DATE) FROM incidents) AS provisional, true AS boundary_instability FROM incidents WHERE date >= timestamp '1999-02-10' AND date < timestamp '2001-08-16' GROUP BY ALL""")
def qual01_02_04_edges(spark, d):
    df = inc(spark, d)
    request = A.Request(date(1999, 2, 10), date(2001, 8, 15), grain="quarter", level="ward", by_category=False)
    return A.with_edges(A.from_rows(df, request), rollups.meta(df), request).select("period", "ward", "incidents", "partial_period", "provisional", "boundary_instability")


GAPS = f"""{WORDS}, frame AS (SELECT CAST(p AS DATE) AS period, c.value AS category, b.value AS ward FROM (SELECT unnest(generate_series(DATE '1996-01-01', DATE '1998-12-31', INTERVAL 1 MONTH)) AS p), (SELECT value FROM words WHERE taxonomy = 'source') c, (SELECT value FROM words WHERE dimension = 'ward') b)"""


@query(f", {GAPS} SELECT period, category, ward FROM frame WHERE NOT EXISTS (SELECT 1 FROM incidents WHERE {MONTH} = period AND primary_type_canonical = category AND CAST(incidents.ward AS string) = frame.ward)")
def qual07_gaps(spark, d):
    return findings.gaps(published(spark, d, "ward"), _words(spark, d), *SPAN, "month", "ward")


@query(f""", {GAPS}, missing AS (SELECT period, category, ward, datediff('month', DATE '1996-01-01', period) AS k FROM frame WHERE NOT EXISTS (SELECT 1 FROM incidents WHERE {MONTH} = period AND primary_type_canonical = category AND CAST(incidents.ward AS string) = frame.ward)),
islands AS (SELECT *, k - row_number() OVER (PARTITION BY category, ward ORDER BY k) AS g FROM missing)
SELECT category, ward, min(period) AS first_period, max(period) AS last_period, CAST(count(*) AS INTEGER) AS n_periods FROM islands GROUP BY category, ward, g""")
def qual07_gap_ranges(spark, d):
    return findings.gap_ranges(published(spark, d, "ward"), _words(spark, d), *SPAN, "month", "ward")


UNKNOWN = "unknown AS (SELECT value, count(*) AS n_rows FROM (SELECT substr(o_orderpriority, 3) || CASE WHEN o_orderkey % 2 = 0 THEN 'E' ELSE '' END AS value FROM orders) WHERE value NOT IN (SELECT value FROM words WHERE taxonomy = 'source') GROUP BY 1)"


def _priorities(spark, d):
    more = F.when(F.col("o_orderkey") % 2 == 0, "E").otherwise("")
    return table(spark, d, "orders").select(F.concat(F.expr("substr(o_orderpriority, 3)"), more).alias("priority"))


@query(f", {WORDS}, {UNKNOWN} SELECT value, n_rows FROM unknown")
def join07_unknown_values(spark, d):
    return findings.unknown_values(_priorities(spark, d), _words(spark, d), "category", "priority", "source")


@query(f""", {WORDS}, {UNKNOWN}, p AS (SELECT u.value, w.value AS suggestion, round(1 - levenshtein(upper(trim(u.value)), w.value) / greatest(length(u.value), length(w.value)), 6) AS likeness FROM unknown u, words w WHERE w.taxonomy = 'source'
  AND levenshtein(upper(trim(u.value)), w.value) <= greatest(length(u.value), length(w.value)) * (1 - 0.6E0)),
best AS (SELECT value, arg_max(suggestion, (likeness, suggestion)) AS suggestion, max(likeness) AS likeness FROM p GROUP BY 1) SELECT value, n_rows, suggestion, likeness FROM unknown LEFT JOIN best USING (value)""")
def qual08_suggestions(spark, d):
    words = _words(spark, d)
    return findings.with_suggestions(findings.unknown_values(_priorities(spark, d), words, "category", "priority", "source"), words, "category", "source")


@query("""SELECT count(id) - count(DISTINCT id) AS repeated_ids, CAST(count_if(date IS NULL) AS BIGINT) AS no_date, CAST(count_if(iucr IS NULL) AS BIGINT) AS no_iucr, CAST(count_if(primary_type IS NULL) AS BIGINT) AS no_primary_type,
CAST(count_if(primary_type_canonical IS NULL) AS BIGINT) AS no_primary_type_canonical, CAST(count_if(stable_category IS NULL) AS BIGINT) AS no_stable_category FROM (SELECT * FROM incidents UNION ALL SELECT * FROM changed)""")
def qual09_violations(spark, d):
    df = inc(spark, d)
    return findings.violations(df.unionByName(standin.changed(df)))


TOTALS = " UNION ALL ".join(f"SELECT 'rollup_{level}' AS table_name, {COUNTED}, true AS complete FROM incidents" for level in GEOGRAPHIES) + " UNION ALL SELECT 'rollup_code_month', count(*), NULL, NULL, NULL, true FROM incidents"


@query(TOTALS)
def qual10_totals(spark, d):
    df = inc(spark, d)
    return rollups.totals_report(rollups.every_rollup(df), df.agg(*rollups.counted())).drop("n_rows")


FIELDS = ("id", "ward", "community_area", "latitude", "beat", "iucr")


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) / count(*) AS share, min(CAST({c} AS string)) AS sample FROM incidents" for c in FIELDS).replace("SELECT", "SELECT", 1))
def agg26_field_inventory(spark, d):
    return profile.field_inventory(inc(spark, d).select(*FIELDS))


ENUMS = ("iucr", "stable_category", "district", "arrest")


@query("SELECT field, value, n_rows, CAST(rank AS INTEGER) AS rank, n_values FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n_rows DESC, value NULLS LAST) AS rank, count(value) OVER (PARTITION BY field) AS n_values FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS field, CAST({c} AS string) AS value, count(*) AS n_rows FROM incidents GROUP BY 2" for c in ENUMS) + ")) WHERE rank <= 8")
def agg27_frequent_values(spark, d):
    return profile.frequent_values(inc(spark, d), list(ENUMS))


@query("""SELECT count(*) AS n_rows, count(DISTINCT id) AS n_ids, count(DISTINCT case_number) AS n_case_numbers, CAST(count_if(ward IS NULL) AS BIGINT) AS no_ward, CAST(count_if(community_area IS NULL) AS BIGINT) AS no_community_area,
CAST(count_if(latitude IS NULL) AS BIGINT) AS no_latitude, min(date) AS min_date, max(date) AS max_date, count(latitude) / count(*) AS geocoded_share FROM incidents""")
def agg28_dataset_profile(spark, d):
    return profile.dataset_profile(inc(spark, d))


@query("SELECT primary_type_canonical AS category, count(*) AS incidents FROM incidents GROUP BY 1 ORDER BY incidents DESC, category LIMIT 15")
def agg28_largest_categories(spark, d):
    return profile.largest_categories(inc(spark, d))


@query("SELECT primary_type_canonical AS category, count(*) AS incidents, avg(CAST(arrest AS INT)) AS arrest_rate FROM incidents GROUP BY 1 ORDER BY incidents DESC, category LIMIT 10")
def agg29_arrest_rates(spark, d):
    return profile.arrest_rates(inc(spark, d))
