"""Monthly rollups, one per geography, and the tables that go with them.

Counts only; null codes and geographies keep a group of their own, so every table's
counts add up to the rows it was built from.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.functions.columns import period
from casebook.functions.predicates import geocoded
from casebook.sources.schema import GEOGRAPHIES, INCIDENTS, MEASURES, TAXONOMIES
from casebook.sources.storage import cut, listed, read_text, remove, write_text

CATEGORIES = tuple(TAXONOMIES.values())


def counted() -> list[Column]:
    """MEASURES of rows."""
    return [F.count("*").alias("incidents"), F.count_if("arrest").alias("arrests"), F.count_if("domestic").alias("domestic"), F.count_if(geocoded()).alias("geocoded")]


def summed() -> list[Column]:
    """MEASURES of rollup rows."""
    return [F.sum(m).alias(m) for m in MEASURES]


def rollup(df: DataFrame, level: str = "citywide") -> DataFrame:
    geography = GEOGRAPHIES[level]
    return df.groupBy(period(F.col("date"), "month").alias("month"), *CATEGORIES, *([geography] if geography else [])).agg(*counted())


def meta(df: DataFrame) -> DataFrame:
    """One row: rows, partitions, first and last date."""
    return df.agg(F.count("*").alias("row_count"), F.count_distinct(F.year("date")).alias("partition_count"), F.min("date").alias("min_date"), F.max("date").alias("max_date"))


def code_coverage(df: DataFrame) -> DataFrame:
    """For each code as stored: labels, first and last month, and rows."""
    return df.groupBy("iucr").agg(
        *(F.min(c).alias(c) for c in ("primary_type", *CATEGORIES)),
        F.trunc(F.min("date").cast("date"), "month").alias("first_month"),
        F.trunc(F.max("date").cast("date"), "month").alias("last_month"),
        F.count("*").alias("incidents"),
    )


def code_months(df: DataFrame) -> DataFrame:
    return df.groupBy(period(F.col("date"), "month").alias("month"), "iucr", *CATEGORIES).agg(F.count("*").alias("incidents"))


#: Keys of each rollup.
TABLES = {f"rollup_{level}": ["month", *CATEGORIES, *([g] if g else [])] for level, g in GEOGRAPHIES.items()} | {"rollup_code_month": ["month", "iucr", *CATEGORIES]}
#: Those that are stored: code_detail has what code_coverage needs.
STORED = TABLES | {"code_detail": ["month", "iucr", "primary_type", *CATEGORIES]}
KEYS = ["month", *CATEGORIES, "iucr", "primary_type", *filter(None, GEOGRAPHIES.values())]
CODED = [name for name, keys in STORED.items() if "iucr" in keys]


def every_rollup(df: DataFrame, tables: dict[str, list[str]] = TABLES) -> DataFrame:
    """table_name, KEYS and MEASURES of all rollups in one pass; keys that a table lacks are null, and codes have incidents only."""
    rows = df.withColumn("month", period(F.col("date"), "month"))
    found = rows.groupingSets(list(tables.values()), *KEYS).agg(*counted(), F.grouping_id().alias("__g"))
    bits = {name: sum(1 << (len(KEYS) - 1 - i) for i, c in enumerate(KEYS) if c not in keys) for name, keys in tables.items()}
    named = F.create_map(*(F.lit(x) for name, g in bits.items() for x in (g, name)))[F.col("__g")]
    found = found.withColumn("table_name", named)
    measures = [F.when(~F.col("table_name").isin(CODED) | F.lit(m == "incidents"), F.col(m)).alias(m) for m in MEASURES]
    return found.select("table_name", *KEYS, *measures)


def totals_report(stored: DataFrame, source: DataFrame) -> DataFrame:
    """table_name, MEASURES, n_rows and whether the measures add up to `source`, one row of them."""
    sums = stored.groupBy("table_name").agg(*(F.sum(m).alias(m) for m in MEASURES), F.count("*").alias("n_rows"))
    equal = reduce(lambda a, b: a & b, (F.coalesce(F.col(m) == source.select(m).scalar(), F.lit(True)) for m in MEASURES))
    return sums.withColumn("complete", equal)


# Stored rollups are kept by table and year, each year in the version that wrote it last. A
# manifest in root/published, one small file a version, tells which that is; the last
# manifest is what readers follow. A manifest whose name ends in `pending` announces the
# years of a change before the table is changed, and is gone after it is published.

_KINDS = {f.name: f.dataType.simpleString() for f in INCIDENTS} | {"month": "date"} | dict.fromkeys(MEASURES, "bigint")
YEARS_SCHEMA = "year int, " + ", ".join(f"{m} bigint" for m in MEASURES) + ", min_date timestamp_ntz, max_date timestamp_ntz"


def _year() -> Column:
    """The partition of a month; rows without a date have one of their own."""
    return F.coalesce(F.year("month"), F.lit(0))


def _write(found: DataFrame, where: str) -> None:
    rows = found.withColumn("year", _year())
    rows = rows.repartition("table_name", "year").sortWithinPartitions("table_name", "year", *KEYS)
    rows.write.partitionBy("table_name", "year").mode("overwrite").parquet(f"{where}/rollups")


def _years(df: DataFrame) -> DataFrame:
    """MEASURES, first and last date of each year."""
    return df.groupBy(F.coalesce(F.year("date"), F.lit(0)).alias("year")).agg(*counted(), F.min("date").cast("timestamp_ntz").alias("min_date"), F.max("date").cast("timestamp_ntz").alias("max_date"))


def _manifest(spark: SparkSession, root: str) -> dict:
    names = [n for n in listed(spark, f"{root}/published") if n.endswith(".json")]
    if not names:
        raise ValueError(f"no rollups are published at {root}")
    return json.loads(read_text(spark, f"{root}/published/{names[-1]}"))


def _read(spark: SparkSession, root: str, manifest: dict, name: str, years: list[int] | None = None) -> DataFrame:
    measures = MEASURES[:1] if name in CODED else MEASURES
    schema = ", ".join(f"{c} {_KINDS[c]}" for c in [*STORED[name], *measures])
    kept = {y: v for y, v in manifest["years"].items() if years is None or int(y) in years}
    paths = [f"{root}/v={v}/rollups/table_name={name}/year={y}" for y, v in kept.items()]
    reader = spark.read.schema(schema)
    return reader.parquet(*paths) if paths else spark.createDataFrame([], schema)


def _finish(spark: SparkSession, root: str, manifest: dict, years: DataFrame) -> dict:
    """Writes what belongs to a version as a whole: totals by year, the metadata and the codes' lifespans."""
    where = f"{root}/v={manifest['version']}"
    years.coalesce(1).write.mode("overwrite").parquet(f"{where}/years")  # a row a year
    years = spark.read.schema(YEARS_SCHEMA).parquet(f"{where}/years")
    sums = [F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES]
    meta = years.agg(*sums, F.count_if(F.col("year") != 0).alias("partition_count"), F.min("min_date").alias("min_date"), F.max("max_date").alias("max_date"))
    meta.select(F.col("incidents").alias("row_count"), "*", F.current_timestamp().alias("built_at")).write.mode("overwrite").parquet(f"{where}/rollup_meta")
    detail = _read(spark, root, manifest, "code_detail")
    coverage = detail.groupBy("iucr").agg(
        *(F.min(c).alias(c) for c in ("primary_type", *CATEGORIES)), F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.sum("incidents").alias("incidents")
    )
    coverage.coalesce(1).write.mode("overwrite").parquet(f"{where}/code_coverage")  # a row a code
    return manifest


def _sums(spark: SparkSession, root: str, manifest: dict) -> DataFrame:
    """table_name and MEASURES of all stored rollups of a version, by one scan."""
    paths = [f"{root}/v={v}/rollups/table_name={name}/year={y}" for name in STORED for y, v in manifest["years"].items()]
    schema = ", ".join(f"{m} bigint" for m in MEASURES)
    if not paths:
        return spark.createDataFrame([], f"table_name string, {schema}")
    return spark.read.schema(schema).parquet(*paths).withColumn("table_name", F.regexp_extract("_metadata.file_path", "table_name=([^/]+)/", 1))


def _check(spark: SparkSession, root: str, manifest: dict) -> DataFrame:
    """The totals report of a version; an error if a table does not add up to its source."""
    source = spark.read.parquet(f"{root}/v={manifest['version']}/rollup_meta")
    report = cut(totals_report(_sums(spark, root, manifest), source))
    if report.where("NOT complete").limit(1).count():
        raise ValueError(f"version {manifest['version']} does not add up to its source")
    return report


def publish(spark: SparkSession, root: str, manifest: dict) -> None:
    """Makes a version the one that readers follow."""
    told = manifest | {"at": datetime.now(UTC).isoformat()}
    write_text(spark, f"{root}/published/{manifest['version']:09d}.json", json.dumps(told, sort_keys=True))
    remove(spark, f"{root}/published/pending")


def build(df: DataFrame, root: str, version: int) -> DataFrame:
    """Writes all tables as version `version` under root, by table and year, sorted by month and
    categories, checks their totals against the rows and publishes the version.
    Returns (table_name, n_rows)."""
    spark = df.sparkSession
    where = f"{root}/v={version}"
    _write(every_rollup(df, STORED), where)
    years = cut(_years(df))
    manifest = {"version": version, "years": {str(r.year): version for r in years.select("year").collect()}}
    _finish(spark, root, manifest, years)
    report = _check(spark, root, manifest)
    publish(spark, root, manifest)
    rest = spark.read.parquet(f"{where}/code_coverage").agg(F.count("*").alias("n_rows")).select(F.lit("code_coverage").alias("table_name"), "n_rows")
    one = spark.range(1).select(F.lit("rollup_meta").alias("table_name"), F.lit(1).cast("long").alias("n_rows"))
    return report.where(F.col("table_name").isin(list(TABLES))).select("table_name", "n_rows").unionByName(rest).unionByName(one)


def changed(spark: SparkSession, root: str, before: DataFrame, after: DataFrame, staged: DataFrame, years: list[int]) -> dict:
    """A new version in which `before`, the rows that a merge replaces, are counted off and
    `after`, the rows that replace them, counted on; other years stay in the version that has
    them. staged: all rows of `years` as they will be, of which only dates and flags are read.
    Returns the manifest for `publish`, which follows when the table has been replaced."""
    manifest = _manifest(spark, root)
    pending = f"{root}/published/pending"
    if listed(spark, pending):
        raise ValueError(f"a change of {root} has not been published: build the years that {pending} names with `rebuilt`")
    version = manifest["version"] + 1
    write_text(spark, f"{pending}/{version:09d}", json.dumps(years))
    sign = lambda df, n: every_rollup(df, STORED).withColumns({m: F.col(m) * n for m in MEASURES})
    known = [y for y in years if str(y) in manifest["years"]]
    stored = []
    for name in STORED:
        rows = _read(spark, root, manifest, name, known)
        lacking = {c: F.lit(None).cast(_KINDS[c]) for c in (*KEYS, *MEASURES) if c not in rows.columns}
        stored.append(rows.withColumns({"table_name": F.lit(name)} | lacking).select("table_name", *KEYS, *MEASURES))
    rows = reduce(DataFrame.unionByName, [*stored, sign(before, -1), sign(after, 1)])
    found = rows.groupBy("table_name", *KEYS).agg(*summed()).where("incidents <> 0")
    return _version(spark, root, manifest, version, found, _years(staged), years)


def rebuilt(spark: SparkSession, root: str, rows: DataFrame, years: list[int]) -> dict:
    """A new version in which some years are counted anew from all their rows. Returns the manifest for `publish`."""
    manifest = _manifest(spark, root)
    return _version(spark, root, manifest, manifest["version"] + 1, every_rollup(rows, STORED), _years(rows), years)


def _version(spark: SparkSession, root: str, manifest: dict, version: int, found: DataFrame, by_year: DataFrame, years: list[int]) -> dict:
    where = f"{root}/v={version}"
    _write(found, where)
    by_year = cut(by_year)
    kept = {y: v for y, v in manifest["years"].items() if int(y) not in years}
    new = {"version": version, "years": kept | {str(r.year): version for r in by_year.select("year").collect()}}
    old = spark.read.schema(YEARS_SCHEMA).parquet(f"{root}/v={manifest['version']}/years").where(~F.col("year").isin(years))
    _finish(spark, root, new, old.unionByName(by_year))
    _check(spark, root, new)
    return new


def pending_years(spark: SparkSession, root: str) -> list[int]:
    """Years of changes that were begun and not published."""
    pending = f"{root}/published/pending"
    return sorted({y for n in listed(spark, pending) for y in json.loads(read_text(spark, f"{pending}/{n}"))})


def published(spark: SparkSession, root: str, name: str, years: list[int] | None = None) -> DataFrame:
    """A table of the version published last, of some years or of all. No job runs and no
    schema is inferred; the driver reads one small file."""
    manifest = _manifest(spark, root)
    if name in STORED:
        return _read(spark, root, manifest, name, years)
    return spark.read.schema(OTHERS[name]).parquet(f"{root}/v={manifest['version']}/{name}")


OTHERS = {
    "code_coverage": ", ".join(f"{c} string" for c in ("iucr", "primary_type", *CATEGORIES)) + ", first_month date, last_month date, incidents bigint",
    "rollup_meta": "row_count bigint, " + ", ".join(f"{m} bigint" for m in MEASURES) + ", partition_count bigint, min_date timestamp_ntz, max_date timestamp_ntz, built_at timestamp",
    "years": YEARS_SCHEMA,
}


def dataset_meta(spark: SparkSession, root: str) -> DataFrame:
    """The stored metadata, one row with the time it was built; an error if nothing was counted."""
    found = published(spark, root, "rollup_meta")
    if found.where("row_count > 0").limit(1).count() == 0:
        raise ValueError(f"the rollups at {root} have no rows")
    return found
