"""Queries on sources, sinks, derivations, code tables and merges (SRC, COL, JOIN, SET, WIN-1, INC)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from casebook.functions import columns as C
from casebook.functions import predicates as P
from casebook.operators import ids, merge, taxonomy
from casebook.plans import standin
from casebook.plans.registry import query
from casebook.sources import storage
from casebook.streaming.sync import batches, sync_stream, unmerged

RAW_COLUMNS = "id, case_number, date, iucr, primary_type, arrest, domestic, beat, district, ward, community_area, updated_on, latitude, longitude"
TYPED = """
typed AS (SELECT CAST(id AS BIGINT) AS id, case_number, TRY_CAST(date AS TIMESTAMP) AS date, iucr, primary_type,
  CASE arrest WHEN 'true' THEN true WHEN 'false' THEN false END AS arrest, CASE domestic WHEN 'true' THEN true WHEN 'false' THEN false END AS domestic, beat, district,
  CASE WHEN regexp_full_match(ward, '[0-9]+') THEN CAST(ward AS BIGINT) END AS ward, CASE WHEN regexp_full_match(community_area, '[0-9]+') THEN CAST(community_area AS BIGINT) END AS community_area,
  TRY_CAST(updated_on AS TIMESTAMP) AS updated_on, TRY_CAST(latitude AS DOUBLE) AS latitude, TRY_CAST(longitude AS DOUBLE) AS longitude FROM raw)
"""
NORM = "CASE WHEN length(trim({0})) = 0 THEN NULL WHEN length(trim({0})) >= 4 THEN trim({0}) ELSE lpad(trim({0}), 4, '0') END"
TAGGED = f"""
tagged AS (SELECT r.*, coalesce(c.primary_description, r.primary_type) AS primary_type_canonical, coalesce(nullif(trim(c.stable_category), ''), c.primary_description, r.primary_type) AS stable_category
  FROM raw r LEFT JOIN codes c ON {NORM.format("r.iucr")} = {NORM.format("c.iucr")})
"""
MERGED = """
both_ AS (SELECT *, 0 AS r FROM incidents UNION ALL BY NAME SELECT *, 1 AS r FROM changed WHERE date IS NOT NULL AND year(date) IN (SELECT year(date) FROM incidents)),
merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_on DESC NULLS FIRST, r DESC) AS n FROM both_) WHERE n = 1)
"""


def inc(spark, d):
    return standin.incidents(spark, d)


def landed(spark, d, n_files: int = 4) -> str:
    """The feed as JSON lines in a landing folder of the shared storage."""
    folder = storage.new_folder(spark, "landing")
    standin.raw(inc(spark, d)).repartition(n_files, "id").write.json(folder)
    return folder


def stored(spark, d) -> str:
    """The incident table, partitioned by year."""
    root = storage.new_folder(spark, "incidents")
    storage.write_incidents(inc(spark, d), root)
    return root


@query(f"SELECT {RAW_COLUMNS} FROM raw")
def src01_raw_feed(spark, d):
    return storage.read_raw(spark, landed(spark, d)).select(*RAW_COLUMNS.split(", "))


@query("SELECT iucr, primary_description, nullif(trim(stable_category), '') AS stable_category FROM codes")
def src02_code_table(spark, d):
    folder = storage.new_folder(spark, "codes")
    standin.codes(inc(spark, d)).write.option("header", True).csv(folder)
    return storage.read_codes(spark, folder).select("iucr", "primary_description", F.expr("nullif(trim(stable_category), '')").alias("stable_category"))


@query("SELECT CAST(year(date) AS INTEGER) AS year, id, date, iucr, ward, latitude FROM incidents")
def src03_partitioned_scan(spark, d):
    return storage.read_incidents(spark, stored(spark, d)).select("year", "id", "date", "iucr", "ward", "latitude")


@query("SELECT id, date FROM incidents WHERE year(date) IN (1996, 1998, 2050)")
def src04_select_years(spark, d):
    return storage.select_years(storage.read_incidents(spark, stored(spark, d)), [1996, 1998, 2050]).select("id", "date")


@query("SELECT count(id) AS n_ids, max(updated_on) AS watermark FROM incidents")
def src05_pruned_scan(spark, d):
    df = inc(spark, d)
    return df.agg(F.count("id").alias("n_ids"), F.max("updated_on").alias("watermark"))


@query("SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS n_rows, min(id) AS first_id, max(id) AS last_id FROM incidents GROUP BY ALL")
def src06_partitioned_sink(spark, d):
    rows = storage.read_incidents(spark, stored(spark, d))
    return rows.groupBy("year").agg(F.count("*").alias("n_rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("SELECT count(DISTINCT year(date)) AS partitions, count(*) AS n_rows FROM incidents")
def src07_full_refresh(spark, d):
    rows = storage.read_incidents(spark, stored(spark, d))
    table = f"serving_{uuid.uuid4().hex}"
    for _ in range(2):  # repeating it replaces
        found = storage.cut(storage.full_refresh(rows, table))
    spark.sql(f"DROP TABLE {table}")
    return found


@query(f", {TYPED} SELECT {RAW_COLUMNS} FROM typed")
def col01_05_typed_columns(spark, d):
    return C.typed(standin.raw(inc(spark, d)))


@query(f"SELECT id, {NORM.format('iucr')} AS code FROM raw")
def col06_normal_code(spark, d):
    return standin.raw(inc(spark, d)).select("id", C.normal_code(F.col("iucr")).alias("code"))


@query(f", {TAGGED} SELECT id, primary_type_canonical FROM tagged")
def col07_join01_canonical_label(spark, d):
    df = inc(spark, d)
    return taxonomy.with_canonical(standin.raw(df), standin.codes(df)).select("id", "primary_type_canonical")


@query(f", {TAGGED} SELECT id, stable_category FROM tagged")
def col08_join02_stable_category(spark, d):
    df = inc(spark, d)
    codes = standin.codes(df)
    return taxonomy.with_stable(taxonomy.with_canonical(standin.raw(df), codes), codes).select("id", "stable_category")


@query(f", {TYPED}, {TAGGED} SELECT typed.*, primary_type_canonical, stable_category FROM typed JOIN tagged ON typed.id = CAST(tagged.id AS BIGINT)")
def col09_prepare(spark, d):
    df = inc(spark, d)
    return taxonomy.prepare(standin.raw(df), standin.codes(df))


@query("SELECT id, upper(trim('  ' || lower(primary_type_canonical) || ' ')) AS category FROM incidents")
def col10_category_key(spark, d):
    return inc(spark, d).select("id", C.category_key(F.concat(F.lit("  "), F.lower("primary_type_canonical"), F.lit(" "))).alias("category"))


@query("""SELECT id, lpad(CAST(CAST(beat AS INT) AS string), 4, '0') AS beat, lpad(CAST(CAST(district AS INT) AS string), 3, '0') AS district,
  CASE WHEN regexp_full_match(trim(ward), '[0-9]+') THEN CAST(ward AS BIGINT) END AS ward, ward IS NOT NULL AND NOT regexp_full_match(trim(ward), '[0-9]+') AS rejected FROM raw""")
def col11_geography_key(spark, d):
    df = standin.raw(inc(spark, d))
    ward = C.geography_key(F.col("ward"), "ward")
    return df.select("id", C.geography_key(F.col("beat").cast("int"), "beat").alias("beat"), C.geography_key(F.col("district").cast("int"), "district").alias("district"), ward.alias("ward"), (F.col("ward").isNotNull() & ward.isNull()).alias("rejected"))


@query("SELECT id, CAST(date_trunc('month', date) AS DATE) AS m, CAST(date_trunc('quarter', date) AS DATE) AS q, CAST(date_trunc('year', date) AS DATE) AS y FROM incidents")
def col12_period(spark, d):
    return inc(spark, d).select("id", *(C.period(F.col("date"), g).alias(g[0]) for g in ("month", "quarter", "year")))


@query("SELECT id, CAST(date_trunc('quarter', date) AS DATE) AS period, CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH AS DATE) AS next_period FROM incidents")
def col13_next_period(spark, d):
    start = C.period(F.col("date"), "quarter")
    return inc(spark, d).select("id", start.alias("period"), C.next_period(start, "quarter").alias("next_period"))


@query("SELECT id, CAST(year(date) AS INTEGER) AS year FROM incidents")
def col14_year(spark, d):
    return inc(spark, d).select("id", merge.year_of().alias("year"))


@query("SELECT CAST(year(date) AS INTEGER) AS year, year(date) IN (1996, 1998) AS carried, count(*) AS n_rows FROM incidents GROUP BY ALL")
def col20_drop_stored_year(spark, d):
    root = stored(spark, d)
    for year in (1996, 1998):  # a stored year that is wrong
        inc(spark, d).where(F.year("date") == year).withColumn("year", F.lit(-1)).write.mode("overwrite").parquet(f"{root}/year={year}")
    storage.drop_stored_year(spark, root, dry_run=True)
    report = storage.drop_stored_year(spark, root)
    if storage.drop_stored_year(spark, root).where("carried").count():
        raise ValueError("a stored year is left")
    return storage.read_incidents(spark, root).groupBy("year").agg(F.count("*").alias("n_rows")).join(report, "year")


RETAGGED = "retagged AS (SELECT i.* REPLACE (coalesce(nullif(trim(c.stable_category), ''), i.primary_type_canonical) AS stable_category) FROM incidents i LEFT JOIN codes c USING (iucr))"


@query(f", {RETAGGED} SELECT id, stable_category FROM retagged")
def col21_retagged(spark, d):
    root, codes = stored(spark, d), standin.codes(inc(spark, d))
    for dry_run in (True, False, False):  # repeating it changes nothing
        merge.retag(spark, root, codes, dry_run)
    return storage.read_incidents(spark, root).select("id", "stable_category")


@query(f", {RETAGGED} SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS n_rows, CAST(count_if(stable_category IS DISTINCT FROM primary_type_canonical) AS BIGINT) AS moved, count_if(stable_category IS DISTINCT FROM primary_type_canonical) / count(*) AS share FROM retagged GROUP BY 1")
def agg25_rows_moved(spark, d):
    df = inc(spark, d)
    return taxonomy.retag_report(df, standin.codes(df))


@query("SELECT n.iucr, n.primary_description, o.stable_category FROM codes n LEFT JOIN old_codes o USING (iucr)")
def join04_carried_over(spark, d):
    df = inc(spark, d)
    return taxonomy.carried_over(standin.codes(df), standin.old_codes(df)).select("iucr", "primary_description", "stable_category")


@query("""SELECT coalesce(n.iucr, o.iucr) AS iucr, CASE WHEN o.iucr IS NULL THEN 'added' WHEN n.iucr IS NULL THEN 'removed' ELSE 'relabelled' END AS change, o.primary_description AS old_label, n.primary_description AS new_label
FROM codes n FULL JOIN old_codes o ON n.iucr = o.iucr WHERE n.primary_description IS DISTINCT FROM o.primary_description""")
def set02_code_changes(spark, d):
    df = inc(spark, d)
    return taxonomy.code_changes(standin.codes(df), standin.old_codes(df))


@query("SELECT id, updated_on, NULL AS beat, 1 AS page FROM changed UNION ALL SELECT id, updated_on, beat, 2 FROM incidents")
def set01_union(spark, d):
    df = inc(spark, d)
    first = standin.changed(df).select("id", "updated_on", F.lit(1).alias("page"))
    return merge.together(first, df.select("id", "updated_on", "beat", F.lit(2).alias("page"))).select("id", "updated_on", "beat", "page")


@query(f", {MERGED} SELECT id, primary_type, date, updated_on, arrest FROM merged")
def win01_latest_per_id(spark, d):
    df = inc(spark, d)
    new = merge.status_of(standin.changed(df), df.select(F.year("date").alias("year"))).where("status = 'applied'").drop("status", "year")
    return merge.merged(df, new).select("id", "primary_type", "date", "updated_on", "arrest")


@query("SELECT id, primary_type, arrest FROM changed UNION ALL SELECT id, primary_type, arrest FROM incidents WHERE id NOT IN (SELECT id FROM changed)")
def join05_upsert(spark, d):
    df = inc(spark, d)
    return merge.upsert(df, standin.changed(df)).select("id", "primary_type", "arrest")


@query("SELECT id, updated_on FROM incidents WHERE updated_on > (SELECT date_trunc('second', max(updated_on)) - INTERVAL 60 DAY FROM incidents) - INTERVAL 1 DAY")
def flt10_inc03_changed_since(spark, d):
    df = inc(spark, d)
    mark = merge.watermark_of(df).select(F.col("watermark") - F.expr("INTERVAL 60 DAY")).scalar()
    return df.where(P.changed_since(mark)).select("id", "updated_on")


def begin_sync(spark, df, state: str) -> None:
    """The state of a sync that ran when the table was 400 days younger."""
    merge.watermark_of(df).select((F.col("watermark") - F.expr("INTERVAL 400 DAY")).alias("watermark")).write.parquet(state)


SINCE = "changed WHERE updated_on > (SELECT max(updated_on) FROM incidents) - INTERVAL 400 DAY - INTERVAL 1 DAY"
SYNCED = MERGED.replace("FROM changed WHERE", f"FROM (SELECT * FROM {SINCE}) WHERE")


@query(f""", {SYNCED} SELECT CAST(year(date) AS INTEGER) AS year, id, primary_type, updated_on,
greatest((SELECT max(updated_on) FROM incidents) - INTERVAL 400 DAY, (SELECT max(updated_on) FROM {SINCE})) AS watermark FROM merged""")
def inc01_incremental_sync(spark, d):
    df = inc(spark, d)
    root, state = stored(spark, d), storage.new_folder(spark, "state")
    begin_sync(spark, df, state)
    merge.sync(spark, root, standin.feed(standin.changed(df)), standin.codes(df), state, strict=True)
    mark = merge.watermark_of(spark.read.parquet(state).withColumnRenamed("watermark", "updated_on")).scalar()
    return storage.read_incidents(spark, root).select("year", "id", "primary_type", "updated_on", mark.alias("watermark"))


MOVED = "year(date) + 1 AS y, * REPLACE (date + INTERVAL '400' DAY AS date, updated_on + INTERVAL '400' DAY AS updated_on) FROM incidents WHERE year(date) = 1995"


@query(f"""SELECT CAST(year(date) AS INTEGER) AS year, id, updated_on FROM (SELECT * FROM incidents WHERE year(date) <> 1995 UNION ALL BY NAME SELECT * EXCLUDE (y) FROM (SELECT {MOVED}))""")
def inc01_emptied_year(spark, d):
    """A feed that moves every row of a year on by 400 days: the year's partition goes."""
    df = inc(spark, d)
    root = stored(spark, d)
    later = [(F.col(c) + F.expr("INTERVAL '400' DAY")).alias(c) for c in ("date", "updated_on")]
    merge.merge_into(spark, root, df.where("year(date) = 1995").withColumns(dict(zip(("date", "updated_on"), later, strict=True))))
    return storage.read_incidents(spark, root).select("year", "id", "updated_on")


@query(f", {SYNCED} SELECT CAST(year(date) AS INTEGER) AS year, id FROM merged")
def inc01_index_of_ids(spark, d):
    """The index of ids after a sync."""
    df = inc(spark, d)
    root, state = stored(spark, d), storage.new_folder(spark, "state")
    begin_sync(spark, df, state)
    merge.sync(spark, root, standin.feed(standin.changed(df)), standin.codes(df), state)
    return ids.Index(spark, root).years_of(df.select("id"))


STREAMED = f""", {TYPED}, {TAGGED},
prepared AS (SELECT typed.*, primary_type_canonical, stable_category FROM typed JOIN tagged ON typed.id = CAST(tagged.id AS BIGINT)),
both_ AS (SELECT *, 0 AS r FROM incidents WHERE year(date) < 1998 UNION ALL BY NAME SELECT *, 1 AS r FROM prepared WHERE year(date) < 1998)
SELECT CAST(year(date) AS INTEGER) AS year, id, iucr, primary_type_canonical, stable_category, updated_on, arrest FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_on DESC NULLS FIRST, r DESC) AS n FROM both_) WHERE n = 1"""


@query(STREAMED)
def inc02_stream_sync(spark, d):
    df = inc(spark, d)
    root = storage.new_folder(spark, "incidents")
    storage.write_incidents(df.where("year(date) < 1998"), root)
    sync_stream(spark, landed(spark, d), root, standin.codes(df), storage.new_folder(spark, "stream"), files_per_batch=2).awaitTermination()
    return storage.read_incidents(spark, root).select("year", "id", "iucr", "primary_type_canonical", "stable_category", "updated_on", "arrest")


def _streamed(spark, d) -> str:
    """The report of a stream that runs twice, the second time over a batch that is done."""
    df = inc(spark, d)
    root, report = storage.new_folder(spark, "incidents"), storage.new_folder(spark, "report")
    storage.write_incidents(df.where("year(date) < 1998"), root)
    folder = landed(spark, d)
    for _ in range(2):  # another checkpoint reads the same files as the same batches
        sync_stream(spark, folder, root, standin.codes(df), storage.new_folder(spark, "stream"), files_per_batch=2, report=report).awaitTermination()
    return report


STATUS = f"""{TYPED}, told AS (SELECT id, CAST(year(date) AS INTEGER) AS year, CASE WHEN date IS NULL THEN 'rejected' WHEN year(date) < 1998 THEN 'applied' ELSE 'skipped' END AS status FROM typed)"""


@query(f", {STATUS} SELECT year, status, CAST(count(*) AS BIGINT) AS n_rows FROM told GROUP BY ALL")
def inc02_stream_batches(spark, d):
    return batches(spark, _streamed(spark, d)).groupBy("year", "status").agg(F.sum("n_rows").alias("n_rows"))


@query(f", {STATUS} SELECT id, status FROM told WHERE status <> 'applied'")
def inc02_stream_unmerged(spark, d):
    return unmerged(spark, _streamed(spark, d)).select("id", "status")


@query("""SELECT CAST(year(date) AS INTEGER) AS year, CASE WHEN date IS NULL THEN 'rejected' WHEN year(date) IN (SELECT year(date) FROM incidents WHERE year(date) <> 1997) THEN 'applied' ELSE 'skipped' END AS status, count(*) AS n_rows FROM changed GROUP BY ALL""")
def inc04_agg24_merge_summary(spark, d):
    df = inc(spark, d)
    return merge.merge_summary(standin.changed(df), df.select(F.year("date").alias("year")).where("year <> 1997"))


@query("SELECT greatest((SELECT max(updated_on) FROM incidents WHERE year(date) < 1997), (SELECT max(updated_on) FROM changed)) AS watermark")
def inc05_agg23_watermark(spark, d):
    df = inc(spark, d)
    return merge.advanced(merge.watermark_of(df.where("year(date) < 1997")).scalar(), standin.changed(df))


COMPLETE = """a AS (SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS n_rows FROM incidents WHERE year(date) <> 1996 AND NOT (year(date) = 1997 AND id % 3 = 0) GROUP BY 1),
b AS (SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS n_expected FROM incidents GROUP BY 1),
report AS (SELECT year, n_rows, n_expected, CASE WHEN n_rows IS NULL THEN 'missing' WHEN n_rows = n_expected THEN 'complete' ELSE 'mismatch' END AS status FROM a FULL JOIN b USING (year))"""


def _partial(spark, d):
    return inc(spark, d).where("year(date) <> 1996 AND NOT (year(date) = 1997 AND id % 3 = 0)")


@query(f", {COMPLETE} SELECT * FROM report")
def agg22_completeness(spark, d):
    return merge.completeness(merge.year_counts(_partial(spark, d)), merge.year_counts(inc(spark, d)))


@query("SELECT year, CAST(count(*) AS BIGINT) AS n_rows FROM (SELECT CAST(year(TRY_CAST(date AS TIMESTAMP)) AS INTEGER) AS year FROM raw WHERE year(TRY_CAST(date AS TIMESTAMP)) BETWEEN 1996 AND 1997 UNION ALL SELECT CAST(year(date) AS INTEGER) FROM incidents WHERE year(date) NOT BETWEEN 1996 AND 1997) GROUP BY 1")
def inc06_backfill(spark, d):
    df = inc(spark, d)
    root = storage.new_folder(spark, "incidents")
    storage.write_incidents(_partial(spark, d), root)
    merge.backfill(spark, root, standin.raw(df), standin.codes(df), storage.read_incidents(spark, root), 1996, 1997, strict=True)
    return storage.read_incidents(spark, root).groupBy("year").agg(F.count("*").alias("n_rows"))


@query("SELECT id, primary_type FROM changed WHERE year(date) IN (1996, 1998) UNION ALL SELECT id, primary_type FROM incidents WHERE year(date) IN (1996, 1998) AND id NOT IN (SELECT id FROM changed WHERE year(date) IN (1996, 1998))")
def inc07_upsert_by_years(spark, d):
    df = inc(spark, d).withColumn("year", F.year("date"))
    new = standin.changed(inc(spark, d)).withColumn("year", F.year("date"))
    years = [1996, 1998]
    return merge.upsert(storage.select_years(df, years), storage.select_years(new, years)).select("id", "primary_type")


@query("SELECT id, date FROM incidents WHERE date >= timestamp '1997-01-01' AND date < timestamp '1998-01-01'")
def flt09_calendar_year(spark, d):
    return storage.read_incidents(spark, stored(spark, d)).where(P.in_year(1997)).select("id", "date")


@query("SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_out_of_order FROM incidents GROUP BY ALL")
def sort09_stored_order(spark, d):
    rows = storage.read_incidents(spark, stored(spark, d)).select("year", F.struct("date", "id").alias("key"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    before = F.lag("key").over(Window.partitionBy("file").orderBy("at"))
    return rows.withColumn("before", before).groupBy("year").agg(F.count("*").alias("n_rows"), F.count_if(F.col("before") > F.col("key")).alias("n_out_of_order"))
