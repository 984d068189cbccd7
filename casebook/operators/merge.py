"""Merging changed rows into the stored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casebook.functions.predicates import changed_since
from casebook.operators import ids as I
from casebook.operators import rollups as R
from casebook.operators.findings import checked
from casebook.operators.taxonomy import prepare, retag_report, retagged
from casebook.sources.storage import cut, kept, listed, new_folder, read_incidents, remove, select_years, stored_years, write_incidents


def together(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; columns that one lacks are null there."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def latest(df: DataFrame, rank: str | None = None) -> DataFrame:
    """The row of each id that was updated last; an unknown time counts as last, and of
    equal times the higher `rank` wins."""
    order = [F.col("updated_on").desc_nulls_first(), *([F.col(rank).desc()] if rank else [])]
    return df.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where("__n = 1").drop("__n")


def merged(stored: DataFrame, changed: DataFrame, touched: str | None = None) -> DataFrame:
    """Stored and changed rows, the latest of each id; of equal times the changed row. A column
    `touched`, if it is named, tells whether a changed row has the id."""
    both = together(stored.withColumn("__rank", F.lit(0)), changed.withColumn("__rank", F.lit(1)))
    if touched:
        both = both.withColumn(touched, F.max("__rank").over(Window.partitionBy("id")) == 1)
    return latest(both, "__rank").drop("__rank")


def upsert(target: DataFrame, staged: DataFrame) -> DataFrame:
    """Staged rows replace those of equal id and are added otherwise; nothing is deleted."""
    return together(target.join(staged.select("id"), "id", "left_anti"), staged)


def year_of(date: str = "date") -> Column:
    return F.year(date)


def status_of(changed: DataFrame, years: DataFrame | list[int]) -> DataFrame:
    """Adds status: applied (its year is managed), skipped (it is not) or rejected (no date)."""
    if isinstance(years, list):
        rows = changed.withColumn("year", year_of()).withColumn("__has", F.col("year").isin(years))
    else:
        managed = years.select(F.col("year").alias("__year")).distinct().withColumn("__has", F.lit(True))
        rows = changed.withColumn("year", year_of()).join(managed, F.col("year") == F.col("__year"), "left").drop("__year")
    status = F.when(F.col("year").isNull(), "rejected").when(F.col("__has"), "applied").otherwise("skipped")
    return rows.withColumn("status", status).drop("__has")


def merge_summary(changed: DataFrame, years: DataFrame | list[int]) -> DataFrame:
    """year, status and rows."""
    return status_of(changed, years).groupBy("year", "status").agg(F.count("*").alias("n_rows"))


def advanced(watermark: Column, changed: DataFrame) -> DataFrame:
    """One row: the watermark after a sync, which never goes back and counts skipped rows too."""
    return changed.agg(F.max("updated_on").alias("m")).select(F.greatest(watermark, F.col("m")).alias("watermark"))


def merge_into(spark: SparkSession, root: str, changed: DataFrame, rollups: str | None = None, strict: bool = False) -> DataFrame:
    """Merges prepared rows into the table at root and returns merge_summary. Rows that move
    to another year leave their old one, and a year that loses its last row loses its
    partition. Only the years of the changed rows, and those where the index has their ids,
    are read and replaced; the merged rows are written to a staging folder in full before any
    stored one is replaced, and with `strict` they must meet the table's constraints. Where
    rollups are kept at `rollups`, what changed is counted off and on there."""
    lost = R.pending_years(spark, rollups) if rollups else []
    if lost:  # a merge before this one broke off
        R.publish(spark, rollups, R.rebuilt(spark, rollups, select_years(read_incidents(spark, root), lost), lost))
    years = stored_years(spark, root)
    changed = kept(changed.drop("year"))
    report = merge_summary(changed, years)
    applied = status_of(changed, years).where("status = 'applied'").drop("status")
    pairs = kept(applied.select("id", "year").distinct())
    index = I.Index(spark, root)
    known = kept(index.years_of(pairs))
    touched = sorted({r.year for r in pairs.select("year").union(known.select("year")).distinct().collect()})  # of the table's years
    if not touched:
        return report
    old = select_years(read_incidents(spark, root), touched).drop("year")
    staging = new_folder(spark, "staging")
    merged(old, applied.drop("year"), touched="__touched").write.parquet(staging)
    staged = spark.read.parquet(staging)
    now = staged.where("__touched AND id IS NOT NULL").drop("__touched").withColumn("year", year_of())
    staged = staged.drop("__touched")
    staged = checked(staged) if strict else staged
    index.add(pairs, known)
    version = None
    if rollups:
        before = kept(old.join(pairs.select("id").distinct(), "id", "left_semi"))
        version = R.changed(spark, rollups, before, now.drop("year"), staged, touched)
    write_incidents(staged, root, keep_index=True)
    left = {r[0] for r in staged.select(year_of()).distinct().collect()}
    for year in touched:
        if year not in left:
            remove(spark, f"{root}/year={year}")
    if version:
        R.publish(spark, rollups, version)
    index.forget(together(known, pairs).select("id", F.col("year").cast("int").alias("year")).distinct().join(now.select("id", "year"), ["id", "year"], "left_anti"))
    return report


def sync(spark: SparkSession, root: str, raw: DataFrame, codes: DataFrame, state: str, rollups: str | None = None, strict: bool = False) -> DataFrame:
    """One incremental run: prepared rows changed since the watermark are merged, and the
    watermark advances. The watermark is the last of the state table; without one it is
    that of the stored rows, and it is an error if there are none."""
    if listed(spark, state):
        known = spark.read.parquet(state).agg(F.max("watermark").alias("watermark"))
    else:
        known = watermark_of(read_incidents(spark, root))
    known = cut(known)
    if known.where("watermark IS NULL").count():
        raise ValueError("neither a state nor a stored row tells where to begin")
    rows = prepare(raw, kept(codes))
    changed = kept(rows.where(changed_since(known.scalar())))
    report = merge_into(spark, root, changed, rollups, strict)
    advanced(known.scalar(), changed).write.mode("append").parquet(state)
    return report


def watermark_of(df: DataFrame) -> DataFrame:
    """The newest update in the table, from one column."""
    return df.agg(F.max("updated_on").alias("watermark"))


def year_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n_rows"))


def completeness(have: DataFrame, expected: DataFrame) -> DataFrame:
    """year, n_rows, n_expected and status (complete, mismatch or missing), by two tables of counts per year."""
    rows = have.select("year", "n_rows").join(expected.select("year", F.col("n_rows").alias("n_expected")), "year", "full_outer")
    status = F.when(F.col("n_rows").isNull(), "missing").when(F.col("n_rows").eqNullSafe(F.col("n_expected")), "complete").otherwise("mismatch")
    return rows.withColumn("status", status)


def years_to_load(report: DataFrame, first: int, last: int, force: bool = False) -> DataFrame:
    """The years of a range that a backfill loads: all if forced, else those that are not complete."""
    rows = report.where(F.col("year").between(first, last))
    return (rows if force else rows.where("status <> 'complete'")).select("year")


def backfill(spark: SparkSession, root: str, raw: DataFrame, codes: DataFrame, have: DataFrame, first: int, last: int, force: bool = False, strict: bool = False) -> DataFrame:
    """Loads the years of a range that are missing or differ in count; returns the completeness report it acted on."""
    rows = prepare(raw, codes).where(F.col("date").isNotNull())
    report = cut(completeness(year_counts(have), year_counts(rows)))
    todo = years_to_load(report, first, last, force)
    staging = new_folder(spark, "backfill")
    latest(rows.withColumn("year", year_of()).join(todo, "year", "left_semi").drop("year")).write.parquet(staging)
    loaded = spark.read.parquet(staging)
    if loaded.limit(1).count():
        write_incidents(checked(loaded) if strict else loaded, root)
    return report


def retag(spark: SparkSession, root: str, codes: DataFrame, dry_run: bool = False) -> DataFrame:
    """Rewrites the stored years in which the present curation changes a row's stable category;
    returns the retag report of all years. Repeating it changes nothing; a dry run only reports."""
    stored = read_incidents(spark, root)
    report = cut(retag_report(stored, codes))
    if dry_run:
        return report
    columns = [c for c in stored.columns if c != "year"]
    rows = stored.select("year", "iucr", "primary_type_canonical", "stable_category", F.col("stable_category").alias("__was"))
    changed = retagged(rows, codes).where(~F.col("stable_category").eqNullSafe(F.col("__was"))).select("year").distinct()
    years = [r.year for r in changed.collect() if r.year is not None]  # of the table's years
    if years:
        staging = new_folder(spark, "retagged")
        retagged(select_years(stored, years).select(*columns), codes).write.parquet(staging)
        write_incidents(spark.read.parquet(staging), root, keep_index=True)
    return report
