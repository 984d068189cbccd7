"""The incident table of the registered queries: a view over orders and customer whose
text runs unchanged in Spark and DuckDB, and what is derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.sources.schema import DERIVED

VIEW = """
SELECT
  o_orderkey AS id,
  'JF' || lpad(cast(o_custkey AS string), 6, '0') AS case_number,
  o_orderdate AS date,
  o_orderdate + interval '1' day * cast(o_orderkey % 60 AS int) AS updated_on,
  CASE WHEN o_orderkey % 10 = 0 AND o_orderdate >= timestamp '1998-07-01 00:00:00' THEN '0760'
       ELSE '0' || substr(o_orderpriority, 1, 1)
            || CASE o_orderstatus WHEN 'F' THEN '10' WHEN 'O' THEN '20' ELSE '30' END END AS iucr,
  o_orderpriority AS primary_type,
  upper(substr(o_orderpriority, 3)) AS primary_type_canonical,
  CASE WHEN o_orderkey % 10 = 0 AND o_orderdate >= timestamp '1998-07-01 00:00:00' THEN 'MEDIUM'
       ELSE upper(substr(o_orderpriority, 3)) END AS stable_category,
  lpad(cast(c_nationkey * 10 + o_custkey % 10 AS string), 4, '0') AS beat,
  lpad(cast(c_nationkey AS string), 3, '0') AS district,
  CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE 1 + o_custkey % 50 END AS ward,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE 1 + o_custkey % 77 END AS community_area,
  o_orderstatus = 'F' AS arrest,
  o_totalprice > 250000 AS domestic,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE 41.64E0 + (o_custkey % 400) / 1000E0 END AS latitude,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE -87.94E0 + (o_custkey % 420) / 1000E0 END AS longitude
FROM orders JOIN customer ON o_custkey = c_custkey
"""
#: The feed: text columns, some of them spoiled.
RAW = """
SELECT cast(id AS string) AS id, case_number,
  CASE WHEN id % 101 = 0 THEN 'x' ELSE replace(cast(date AS string), ' ', 'T') END AS date,
  CASE WHEN id % 17 = 0 THEN ' 810 ' WHEN id % 19 = 0 THEN '  ' ELSE iucr END AS iucr,
  primary_type, CASE WHEN id % 11 = 0 THEN 'yes' WHEN arrest THEN 'true' ELSE 'false' END AS arrest,
  CASE WHEN domestic THEN 'true' ELSE 'false' END AS domestic, beat, district,
  CASE WHEN id % 23 = 0 THEN '1.5' ELSE cast(ward AS string) END AS ward,
  CASE WHEN id % 29 = 0 THEN 'n/a' ELSE cast(community_area AS string) END AS community_area,
  replace(cast(updated_on AS string), ' ', 'T') AS updated_on,
  CASE WHEN id % 13 = 0 THEN 'x' ELSE cast(latitude AS string) END AS latitude, cast(longitude AS string) AS longitude
FROM incidents
"""
#: A code table with a code missing, a blank override and a real one.
CODES = """
SELECT iucr, 'LABEL ' || iucr AS primary_description, cast(NULL AS string) AS secondary_description, 'I' AS index_code, 'true' AS active,
  CASE WHEN iucr = '0760' THEN ' THEFT ' WHEN iucr = '0110' THEN '  ' END AS stable_category
FROM (SELECT DISTINCT iucr FROM incidents) AS c WHERE iucr <> '0230'
"""
#: The code table before: one code more, one less, one with another label.
OLD_CODES = """
SELECT CASE WHEN iucr = '0220' THEN '0999' ELSE iucr END AS iucr, CASE WHEN iucr = '0320' THEN 'OTHER' ELSE primary_description END AS primary_description,
  secondary_description, index_code, active, stable_category FROM codes
"""
#: Edits: later and earlier ones by turns, a third of them in another year, a few without date.
CHANGED = """
SELECT id, case_number, CASE WHEN id % 1100 = 7 THEN NULL WHEN id % 300 = 7 THEN date + interval '400' day ELSE date END AS date,
  CASE WHEN id % 200 = 7 THEN updated_on + interval '90' day ELSE updated_on - interval '90' day END AS updated_on,
  iucr, 'CHANGED' AS primary_type, primary_type_canonical, stable_category, beat, district, ward, community_area, NOT arrest AS arrest, domestic, latitude, longitude
FROM incidents WHERE id % 100 = 7
"""
#: Incidents with the columns that only whole records have.
RECORDS = """
SELECT *, lpad(cast(id % 1000 AS string), 3, '0') || 'XX N ' || primary_type_canonical || ' ST' AS block, 'CODE ' || iucr AS description,
  CASE WHEN id % 7 = 0 THEN NULL ELSE 'STREET ' || cast(id % 5 AS string) END AS location_description, substr(iucr, 1, 2) AS fbi_code,
  longitude * 1000 AS x_coordinate, latitude * 1000 AS y_coordinate
FROM incidents
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = VIEW.replace("FROM orders JOIN customer", "FROM {orders} JOIN {customer}")
    return spark.sql(text, orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"))


def derived(incidents: DataFrame, text: str, **more: DataFrame) -> DataFrame:
    frames = {"incidents": incidents, **more}
    for name in frames:
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
    return incidents.sparkSession.sql(text, **{n: f for n, f in frames.items() if f"{{{n}}}" in text})


def codes(inc: DataFrame) -> DataFrame:
    return derived(inc, CODES)


def old_codes(inc: DataFrame) -> DataFrame:
    return derived(inc, OLD_CODES, codes=codes(inc))


def raw(inc: DataFrame) -> DataFrame:
    return derived(inc, RAW)


def changed(inc: DataFrame) -> DataFrame:
    return derived(inc, CHANGED)


def records(inc: DataFrame) -> DataFrame:
    return derived(inc, RECORDS)


def feed(df: DataFrame) -> DataFrame:
    """Rows as received: all text, without what is derived."""
    return df.select(*(F.col(c).cast("string") for c in df.columns if c not in DERIVED))
