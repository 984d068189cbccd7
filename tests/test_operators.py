"""Operators on small tables made here: contracts that the stand-in view does not pin."""

from __future__ import annotations

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from casebook.functions import columns as C
from casebook.functions import curve, geo
from casebook.functions import predicates as P
from casebook.operators import aggregate as A
from casebook.operators import drift, findings, ids, merge, radius, rollups, rows, taxonomy
from casebook.sources import storage
from casebook.sources.schema import INCIDENTS, RAW
from casebook.streaming import sync

DEFAULTS = {
    "id": 1, "case_number": "JF100001", "date": datetime(2025, 1, 1, 3), "block": "001XX N STATE ST", "iucr": "0486", "primary_type": "BATTERY",
    "description": "SIMPLE", "location_description": "APARTMENT", "arrest": False, "domestic": True, "beat": "1011", "district": "010", "ward": 1,
    "community_area": 29, "fbi_code": "08B", "x_coordinate": 1150000.0, "y_coordinate": 1900000.0, "updated_on": datetime(2025, 1, 2),
    "latitude": 41.8781, "longitude": -87.6298, "primary_type_canonical": "BATTERY", "stable_category": "BATTERY",
}


def table(spark, *rows_):
    return spark.createDataFrame([tuple((DEFAULTS | r)[f.name] for f in INCIDENTS) for r in rows_], INCIDENTS)


@pytest.fixture(scope="module")
def base(spark):
    return table(
        spark,
        {"id": 1, "date": datetime(2024, 1, 5), "arrest": True, "primary_type_canonical": "THEFT", "stable_category": "THEFT", "iucr": "0810"},
        {"id": 2, "date": datetime(2024, 1, 31, 23, 30), "beat": "2422", "district": "024"},
        {"id": 3, "date": datetime(2024, 2, 1), "beat": "2422", "district": "006", "arrest": True},
        {"id": 4, "date": datetime(2024, 2, 2), "ward": None, "community_area": None, "latitude": None, "longitude": None},
        {"id": 5, "date": datetime(2025, 3, 1), "iucr": None, "primary_type_canonical": "BURGLARY", "stable_category": "THEFT"},
    ).cache()


def test_span_includes_its_last_day(base):
    found = base.where(P.in_span(base, date(2024, 1, 31), date(2024, 1, 31)))
    assert [r.id for r in found.collect()] == [2] and found.count() < base.count()


def test_rollups_keep_null_groups_and_totals(base):
    every = rollups.every_rollup(base)
    of = lambda name: every.where(F.col("table_name") == f"rollup_{name}")
    assert of("ward").where("ward IS NULL").count() == 1
    assert rollups.totals_report(every, base.agg(*rollups.counted())).where("complete").count() == len(rollups.TABLES)
    assert rollups.totals_report(every, base.where("id < 3").agg(*rollups.counted())).where("complete").count() == 0
    assert of("beat").where("beat = '2422'").agg(F.sum("incidents")).first()[0] == 2
    assert of("district").where("district = '024'").agg(F.sum("incidents")).first()[0] == 1
    for level in ("citywide", "ward", "beat"):
        keys = rollups.TABLES[f"rollup_{level}"]
        assert of(level).select(*keys, "incidents", "arrests", "domestic", "geocoded").exceptAll(rollups.rollup(base, level)).count() == 0


@pytest.mark.parametrize("level,values", [("citywide", ()), ("ward", (1,)), ("district", ("24", "010")), ("community_area", ())])
@pytest.mark.parametrize("taxonomy_", ["source", "comparable"])
@pytest.mark.parametrize("grain", ["month", "quarter", "year"])
def test_both_tiers_agree(base, level, values, taxonomy_, grain):
    request = A.Request(date(2024, 1, 1), date(2025, 3, 31), grain, taxonomy_, level, ("BATTERY", "theft"), values)
    scan = {tuple(r) for r in A.from_rows(base, request).collect()}
    assert scan and scan == {tuple(r) for r in A.from_rollup(rollups.rollup(base, level), request).collect()}


def test_rollup_refuses_part_months(base):
    with pytest.raises(ValueError):
        A.from_rollup(rollups.rollup(base), A.Request(date(2024, 1, 2), date(2024, 1, 31)))


def test_rates_are_zero_without_rows(spark):
    assert spark.range(1).select(C.rate(F.lit(0), F.lit(0))).first()[0] == 0.0


def test_codes_and_flags(spark):
    df = spark.createDataFrame([(" 810 ", "true"), ("12345", "yes"), ("", "false"), (None, None)], "c string, f string")
    assert [tuple(r) for r in df.select(C.normal_code(F.col("c")), C.to_flag(F.col("f"))).collect()] == [("0810", True), ("12345", None), (None, False), (None, None)]


def test_typed_skips_missing_columns(spark):
    df = C.typed(spark.createDataFrame([("7", "1.5", "x")], "id string, ward string, latitude string"))
    assert tuple(df.first()) == (7, None, None) and df.dtypes[0] == ("id", "bigint")


def test_stable_category_falls_back_and_is_idempotent(spark, base):
    codes = spark.createDataFrame([("810", "LARCENY", "GRAND"), ("0486", "BATTERY2", " ")], "iucr string, primary_description string, stable_category string")
    tagged = taxonomy.with_stable(taxonomy.with_canonical(base, codes), codes)
    found = {r.id: (r.primary_type_canonical, r.stable_category) for r in tagged.collect()}
    assert found[1] == ("LARCENY", "GRAND") and found[2] == ("BATTERY2", "BATTERY2") and found[5] == ("BATTERY", "BATTERY")
    once = taxonomy.retagged(tagged, codes)
    assert sorted(once.collect()) == sorted(taxonomy.retagged(once, codes).collect())


def test_latest_lets_unknown_times_and_new_rows_win(spark):
    stored = table(spark, {"id": 1}, {"id": 2}, {"id": 3, "updated_on": datetime(2030, 1, 1)})
    new = table(spark, {"id": 1, "iucr": "NEW"}, {"id": 2, "iucr": "NEW", "updated_on": None}, {"id": 3, "iucr": "NEW"}, {"id": 4, "iucr": "NEW"})
    assert {r.id: r.iucr for r in merge.merged(stored, new).collect()} == {1: "NEW", 2: "NEW", 3: "0486", 4: "NEW"}


def test_merge_moves_rows_between_years_and_skips_unmanaged(spark, base):
    root = storage.new_folder(spark, "t")
    storage.write_incidents(base, root)
    new = table(spark, {"id": 1, "date": datetime(2025, 5, 5), "updated_on": datetime(2026, 1, 1)}, {"id": 9, "date": datetime(1990, 1, 1)}, {"id": 10, "date": None})
    report = {(r.year, r.status): r.n_rows for r in merge.merge_into(spark, root, new).collect()}
    assert report == {(2025, "applied"): 1, (1990, "skipped"): 1, (None, "rejected"): 1}
    found = {r.id: r.year for r in storage.read_incidents(spark, root).collect()}
    assert found == {1: 2025, 2: 2024, 3: 2024, 4: 2024, 5: 2025}


def test_sync_needs_a_state_or_rows(spark, base):
    root, state = storage.new_folder(spark, "t"), storage.new_folder(spark, "state")
    storage.write_incidents(base, root)
    codes = spark.createDataFrame([], "iucr string, primary_description string, stable_category string")
    raw = base.drop("primary_type_canonical", "stable_category").select(*(F.col(c).cast("string") for c in base.columns if c not in ("primary_type_canonical", "stable_category")))
    merge.sync(spark, root, raw.withColumn("updated_on", F.lit("2025-06-01T00:00:00")), codes, state)
    assert storage.read_incidents(spark, root).where("updated_on > '2025-05-01'").count() == 5
    assert spark.read.parquet(state).first().watermark == datetime(2025, 6, 1)
    merge.sync(spark, root, raw, codes, state)  # nothing new
    assert storage.read_incidents(spark, root).count() == 5


def test_published_rollups_follow_the_last_version(spark, base):
    root = storage.new_folder(spark, "rollups")
    rollups.build(base, root, 1)
    rollups.build(base.where("id < 3"), root, 2)
    assert rollups.published(spark, root, "rollup_citywide").agg(F.sum("incidents")).first()[0] == 2


def test_pages_meet_every_row_once(spark):
    df = table(spark, *({"id": i, "date": datetime(2025, 1, 1 + i % 7)} for i in range(80)))
    seen, after = [], None
    while True:
        page = rows.newest(df, 9, after).collect()
        seen += [r.id for r in page[:9]]
        if len(page) <= 9:
            break
        after = (page[8].date, page[8].id)
    assert sorted(seen) == list(range(80))
    ends = {(r.last_date, r.last_id) for r in rows.page_boundaries(df, 9, {}).collect()}
    assert after in ends and len(ends) == 9


def test_radius_join_equals_all_pairs(spark):
    df = table(spark, *({"id": i, "latitude": 41.6 + (i * 37 % 100) / 400, "longitude": -87.9 + (i * 53 % 100) / 350} for i in range(300)), {"id": 999, "latitude": None, "longitude": None})
    points = spark.createDataFrame([(i, 41.6 + i / 25, -87.9 + i / 30, 500.0 + 900 * i) for i in range(6)], "point_id long, lat double, lon double, radius double")
    mine = {(r.point_id, r.id) for r in radius.radius_join(df, points).collect()}
    pairs = df.crossJoin(points).where(geo.distance_m(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon")) <= F.col("radius"))
    assert mine and mine == {(r.point_id, r.id) for r in pairs.collect()}


def test_rings_add_up(spark):
    df = table(spark, *({"id": i, "latitude": 41.8781 + i / 1000, "primary_type_canonical": "AB"[i % 2]} for i in range(6)))
    found = radius.summary(radius.ring_counts(radius.within(df, 41.8781, -87.6298, 400.0), 400.0)).collect()
    total = next(r.incidents for r in found if r.kind == "total")
    assert total == 4 and sum(r.incidents for r in found if r.kind == "ring") == 4 == sum(r.incidents for r in found if r.kind == "category")
    assert sorted(r.ring for r in found if r.kind == "ring") == [1, 2, 3, 4]


def test_drift_onset_retirement_and_clamp(spark):
    day = lambda y, m: datetime(y, m, 1)
    df = table(spark, *({"id": 10 * y + m, "date": day(y, m)} for y in range(2020, 2026) for m in (1, 7)), {"id": 1, "date": day(2020, 1), "iucr": "1310"}, {"id": 2, "date": day(2025, 7), "iucr": "0810"})
    args = rollups.code_months(df), rollups.code_coverage(df), rollups.meta(df)
    assert {r.iucr: r.introduced for r in drift.codes(*args, date(2015, 1, 1), date(2030, 1, 1)).collect()} == {"1310": False, "0810": True}
    assert drift.codes(*args, date(2025, 1, 1), date(2025, 12, 31)).count() == 0
    spans = spark.createDataFrame([(1, date(2015, 1, 1), date(2030, 1, 1)), (2, date(2031, 1, 1), date(2032, 1, 1))], "span_id int, start date, end date")
    assert {r.span_id: (r.total, r.affected, r.reported) for r in drift.batch_report(*args, spans).collect()} == {1: (14, 2, True), 2: (0, 0, False)}


def test_constraints(base):
    assert findings.violations(base).first().no_iucr == 1
    with pytest.raises(ValueError):
        findings.checked(base)
    findings.checked(base.where("iucr IS NOT NULL"))


def test_date_filters_prune_years(spark, base):
    root = storage.new_folder(spark, "t")
    storage.write_incidents(base, root)
    df = storage.read_incidents(spark, root)
    plan = df.where(P.in_span(df, date(2025, 1, 1), date(2025, 12, 31)))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "PushedFilters: [IsNotNull(date)" in plan


def test_full_refresh_replaces(spark, base):
    rows_ = base.withColumn("year", F.year("date"))
    with pytest.raises(ValueError):  # a row without a code stops the write
        storage.full_refresh(rows_, "refreshed")
    assert not spark.catalog.tableExists("refreshed")
    for _ in range(2):
        assert tuple(storage.full_refresh(rows_.fillna("0110", ["iucr"]), "refreshed").first()) == (2, 5)


def test_a_stored_year_is_dropped_once(spark, base):
    root = storage.new_folder(spark, "t")
    storage.write_incidents(base, root)
    base.where("date >= '2025-01-01'").withColumn("year", F.lit(1)).write.mode("overwrite").parquet(f"{root}/year=2025")
    told = lambda dry_run: {r.year: r.carried for r in storage.drop_stored_year(spark, root, dry_run).collect()}
    assert told(True) == told(True) == told(False) == {2024: False, 2025: True}
    assert told(False) == {2024: False, 2025: False}
    assert sorted(r.id for r in storage.read_incidents(spark, root).collect()) == sorted(r.id for r in base.collect())


def test_retagging_rewrites_what_changes(spark, base):
    root = storage.new_folder(spark, "t")
    storage.write_incidents(base, root)
    code = base.where("iucr IS NOT NULL").first().iucr
    codes = spark.createDataFrame([(code, "X", "OTHER")], "iucr string, primary_description string, stable_category string")
    before = {r.id: r.stable_category for r in base.collect()}
    merge.retag(spark, root, codes, dry_run=True)
    assert {r.id: r.stable_category for r in storage.read_incidents(spark, root).collect()} == before
    assert sum(r.moved for r in merge.retag(spark, root, codes).collect()) > 0
    after = {r.id: (r.iucr, r.stable_category) for r in storage.read_incidents(spark, root).collect()}
    assert set(after) == set(before) and all((c == "OTHER") == (k == code) for k, c in after.values())
    merge.retag(spark, root, codes)
    assert {r.id: (r.iucr, r.stable_category) for r in storage.read_incidents(spark, root).collect()} == after


def test_a_year_that_empties_leaves_no_row_behind(spark):
    root = storage.new_folder(spark, "t")
    storage.write_incidents(table(spark, {"id": 1, "date": datetime(2015, 3, 1)}, {"id": 2, "date": datetime(2016, 3, 1)}, {"id": 3, "date": datetime(2017, 3, 1)}), root)
    merge.merge_into(spark, root, table(spark, {"id": 1, "date": datetime(2016, 5, 1), "updated_on": datetime(2026, 1, 1)}))
    assert {(r.id, r.year) for r in storage.read_incidents(spark, root).collect()} == {(1, 2016), (2, 2016), (3, 2017)}
    assert storage.stored_years(spark, root) == [2016, 2017]
    # an older edit does not move the row back, and the emptied year is no longer managed
    report = merge.merge_into(spark, root, table(spark, {"id": 1, "date": datetime(2017, 5, 1), "updated_on": datetime(2020, 1, 1)}, {"id": 9, "date": datetime(2015, 1, 1)}))
    assert {(r.year, r.status) for r in report.collect()} == {(2017, "applied"), (2015, "skipped")}
    assert {(r.id, r.year) for r in storage.read_incidents(spark, root).collect()} == {(1, 2016), (2, 2016), (3, 2017)}


def test_a_merge_reads_and_writes_the_years_of_its_ids_only(spark, monkeypatch):
    root = storage.new_folder(spark, "t")
    storage.write_incidents(table(spark, *({"id": 10 * y + i, "date": datetime(y, 1 + i, 1)} for y in range(2010, 2020) for i in range(5))), root)
    plans = []

    def watched(df, years):
        found = storage.select_years(df, years)
        plans.append((found._jdf.queryExecution().executedPlan().toString(), found.select("_metadata.file_path").distinct().count()))
        return found

    monkeypatch.setattr(merge, "select_years", watched)
    files = lambda: {y: storage.listed(spark, f"{root}/year={y}") for y in range(2010, 2020)}
    before, n_files = files(), len(spark.read.parquet(f"{root}/year=2012", f"{root}/year=2015").inputFiles())
    merge.merge_into(spark, root, table(spark, {"id": 20120, "date": datetime(2015, 7, 7), "updated_on": datetime(2026, 1, 1)}))
    ((plan, read),) = plans
    assert "PartitionFilters: [year#" in plan and "IN (2012,2015)" in plan and read == n_files
    assert {y for y, names in files().items() if names != before[y]} == {2012, 2015}
    found = {y: sorted(r.id for r in spark.read.parquet(f"{root}/year={y}").collect()) for y in (2012, 2015)}
    assert found == {2012: [20121, 20122, 20123, 20124], 2015: [20120, 20150, 20151, 20152, 20153, 20154]}


def test_the_index_follows_moves_and_forgets_left_years(spark, monkeypatch):
    monkeypatch.setattr(ids, "RUN_BITS", 1)
    monkeypatch.setattr(ids, "IDS_PER_BUCKET", 2)
    root = storage.new_folder(spark, "t")
    storage.write_incidents(table(spark, *({"id": i, "date": datetime(2015 + i % 3, 3, 1)} for i in range(9))), root)
    every = spark.range(20)
    told = lambda: sorted((r.id, r.year) for r in ids.Index(spark, root).years_of(every).collect())
    assert told() == sorted((i, 2015 + i % 3) for i in range(9)) and ids.Index(spark, root).buckets == 5
    later = datetime(2026, 1, 1)
    merge.merge_into(spark, root, table(spark, {"id": 0, "date": datetime(2016, 1, 1), "updated_on": later}, {"id": 12, "date": datetime(2017, 1, 1)}, {"id": 4, "date": datetime(2015, 1, 1), "updated_on": datetime(2000, 1, 1)}))
    assert told() == sorted({**{i: 2015 + i % 3 for i in range(9)}, 0: 2016, 12: 2017}.items())
    storage.write_incidents(table(spark, {"id": 17, "date": datetime(2015, 3, 1)}), root)  # another writer
    assert (17, 2015) in told()


def test_a_merge_that_broke_off_is_taken_up(spark):
    """The index has too many years then, and the rollups a pending change; both are mended by the next merge."""
    root, folder = storage.new_folder(spark, "t"), storage.new_folder(spark, "rollups")
    rows_ = table(spark, {"id": 1, "date": datetime(2015, 3, 1)}, {"id": 2, "date": datetime(2016, 3, 1)})
    storage.write_incidents(rows_, root)
    rollups.build(rows_, folder, 1)
    new = table(spark, {"id": 1, "date": datetime(2016, 5, 1), "updated_on": datetime(2026, 1, 1)})
    real, storage_write = rollups.publish, merge.write_incidents
    for broken in ("write_incidents", "R.publish"):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(*((merge, "write_incidents") if broken == "write_incidents" else (rollups, "publish")), lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                merge.merge_into(spark, root, new, folder)
        assert rollups.pending_years(spark, folder) == ([2015, 2016] if broken == "write_incidents" else [2016])
        assert rollups.published(spark, folder, "rollup_citywide").agg(F.sum("incidents")).first()[0] == 2
        merge.merge_into(spark, root, new, folder)
        assert rollups.pending_years(spark, folder) == []
        assert {(r.id, r.year) for r in storage.read_incidents(spark, root).collect()} == {(1, 2016), (2, 2016)}
        same_rollups(spark, folder, storage.read_incidents(spark, root).drop("year"))
    assert (real, storage_write) == (rollups.publish, merge.write_incidents)


def same_rollups(spark, folder, rows_):
    """Stored rollups equal those of all rows."""
    for name, keys in rollups.TABLES.items():
        mine = rollups.published(spark, folder, name)
        true = rollups.code_months(rows_) if name == "rollup_code_month" else rollups.rollup(rows_, name.removeprefix("rollup_"))
        true = true.select(mine.columns)
        assert mine.exceptAll(true).count() == 0 == true.exceptAll(mine).count(), name
    coverage = rollups.published(spark, folder, "code_coverage")
    assert coverage.exceptAll(rollups.code_coverage(rows_).select(coverage.columns)).count() == 0
    meta = rollups.dataset_meta(spark, folder)
    assert tuple(meta.select("row_count", "partition_count", "min_date", "max_date").first()) == tuple(rollups.meta(rows_).first())


def test_rollups_by_deltas_equal_a_full_rebuild(spark):
    root, folder = storage.new_folder(spark, "t"), storage.new_folder(spark, "rollups")
    rows_ = table(spark, *({"id": 10 * y + i, "date": datetime(y, 1 + i, 1), "ward": i % 3 or None, "arrest": i % 2 == 0, "iucr": f"0{i}10"} for y in range(2010, 2016) for i in range(5)))
    storage.write_incidents(rows_, root)
    rollups.build(rows_, folder, 1)
    later = {"updated_on": datetime(2026, 1, 1)}
    merge.merge_into(spark, root, table(spark, *({"id": 20110 + i, "date": datetime(2012, 2, 2), **later} for i in range(5))), folder)  # 2011 empties
    merge.merge_into(spark, root, table(spark, {"id": 20120, "date": datetime(2012, 1, 1), "arrest": True, "iucr": None, "latitude": None, **later}, {"id": 5, "date": datetime(2010, 12, 31), **later}), folder)
    same_rollups(spark, folder, storage.read_incidents(spark, root).drop("year"))
    versions = rollups._manifest(spark, folder)["years"]
    assert versions == {"2010": 3, "2012": 3, "2013": 1, "2014": 1, "2015": 1}  # other years are where they were
    assert rollups.published(spark, folder, "rollup_ward", [2013]).select(F.year("month")).distinct().collect() == [(2013,)]


def test_metadata_without_rows_is_an_error(spark):
    folder = storage.new_folder(spark, "rollups")
    with pytest.raises(ValueError):
        rollups.published(spark, folder, "rollup_meta")
    rollups.build(table(spark, {"id": 1}).where("id > 1"), folder, 1)
    with pytest.raises(ValueError):
        rollups.dataset_meta(spark, folder)


def test_a_strict_merge_keeps_the_constraints(spark):
    root = storage.new_folder(spark, "t")
    storage.write_incidents(table(spark, {"id": 1}), root)
    with pytest.raises(ValueError):
        merge.merge_into(spark, root, table(spark, {"id": 2, "iucr": None}), strict=True)
    assert [r.id for r in storage.read_incidents(spark, root).collect()] == [1]


def test_drift_of_many_spans_equals_that_of_each(spark):
    days = [datetime(2018 + k // 12, 1 + k % 12, 3) for k in range(60)]
    codes_ = {"0110": days, "0220": days[:20], "0330": days[25:], "0440": days[10:14] + days[40:44], None: days[::7]}
    df = table(spark, *({"id": 100 * i + k, "iucr": c, "date": d, "primary_type_canonical": "AB"[k % 2]} for i, (c, ds) in enumerate(codes_.items()) for k, d in enumerate(ds)))
    months, coverage, meta = rollups.code_months(df).cache(), rollups.code_coverage(df).cache(), rollups.meta(df).cache()
    asked = [(i, date(2016 + i % 9, 1 + i % 12, 1 + i % 28), date(2016 + i % 9 + i % 4, 1 + (5 * i) % 12, 28)) for i in range(120)]
    asked = [(i, a, b) for i, a, b in asked if a <= b] + [(999, date(2019, 2, 5), date(2019, 2, 6)), (1000, date(2030, 1, 1), date(2031, 1, 1))]
    spans = spark.createDataFrame(asked, "span_id int, start date, end date")
    first = lambda d: d.replace(day=1)
    lo, hi = date(2018, 1, 1), date(2022, 12, 1)
    shifted = lambda d, n: date(d.year + (d.month - 1 + n) // 12, (d.month - 1 + n) % 12 + 1, 1)
    for categories in ([], ["a"]):
        rows_ = [(c, d.date(), k) for c, ds in codes_.items() for k, d in enumerate(ds)]
        true = {}
        for i, a, b in asked:
            a, b = max(first(a), lo), min(first(b), hi)
            inside = [(c, d) for c, d, k in rows_ if a <= first(d) <= b and (not categories or k % 2 == 0)]
            drift_ = lambda c: shifted(a, 12) < min(first(d.date()) for d in codes_[c]) or max(first(d.date()) for d in codes_[c]) < shifted(b, -12)  # noqa: B023, E731
            hit = [c for c, _ in inside if c is not None and drift_(c)]
            true[i] = (len(inside), len(hit), len(set(hit)))
        found = drift.batch_report(months, coverage, meta, spans, categories=categories).collect()
        assert {r.span_id: (r.total, r.affected, r.n_codes) for r in found} == true
    assert sum(1 for t in true.values() if t[1]) > 10


def test_a_million_spans_meet_only_the_months_there_are(spark):
    df = table(spark, *({"id": i, "iucr": f"0{i % 7}10", "date": datetime(2015 + i % 9, 1 + i % 12, 1)} for i in range(300)))
    args = [f(df).cache() for f in (rollups.code_months, rollups.code_coverage, rollups.meta)]
    spans = spark.range(1_000_000).selectExpr("id AS span_id", "date_add(DATE '2014-01-01', cast(id % 4000 AS int)) AS start", "date_add(DATE '2014-01-01', cast(id % 4000 + id % 900 AS int)) AS end")
    found = drift.batch_report(*args, spans)
    some = found.where("span_id < 2000").collect()
    one_by_one = {r.span_id: r for r in drift.batch_report(*args, spans.where("span_id < 2000")).collect()}
    assert found.agg(F.count("*")).first()[0] == 1_000_000 and all(r == one_by_one[r.span_id] for r in some)


def vocabulary(spark, values):
    return spark.createDataFrame([("category", "source", v, True) for v in values], "dimension string, taxonomy string, value string, stable_over_time boolean")


def test_suggestions_equal_those_of_all_pairs(spark):
    r = random.Random(4)
    valid = sorted({"".join(r.choice("ABCD E") for _ in range(r.randint(1, 14))).strip() or "A" for _ in range(150)} | {"THEFT", "BATTERY", "CRIMINAL DAMAGE", "A"})
    asked = ["".join(r.choice("ABCD E") for _ in range(r.randint(0, 16))) for _ in range(300)] + ["theft ", "  BATERY", "   a      ", "CRIMINL DAMGE", "", "x" * 40]
    for v in valid[:60]:  # a few edits away
        w = list(v)
        for _ in range(r.randint(1, 4)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randint(0, 1)] = r.choice(["", "Z", "A"])
        asked.append("".join(w))
    unknown = spark.createDataFrame([(v, 1) for v in sorted(set(asked))], "value string, n_rows long")
    words_ = vocabulary(spark, valid)
    longest = F.greatest(F.length("value"), F.length("suggestion"))
    apart = F.levenshtein(F.upper(F.trim("value")), F.col("suggestion"))
    every = unknown.crossJoin(words_.select(F.col("value").alias("suggestion"))).where(apart <= longest * (1 - findings.SIMILAR))
    true = {x.value: x.b for x in every.groupBy("value").agg(F.max(F.struct(F.round(1 - apart / longest, 6).alias("likeness"), "suggestion")).alias("b")).collect()}
    found = {x.value: x for x in findings.with_suggestions(unknown, words_, "category", "source").collect()}
    assert len(found) == unknown.count() and sum(x.suggestion is not None for x in found.values()) == len(true) > 60
    for v, b in true.items():
        assert (found[v].likeness, found[v].suggestion) == (b.likeness, b.suggestion)


def test_few_candidates_for_many_unknown_values(spark):
    r = random.Random(6)
    word = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    words_ = vocabulary(spark, sorted({word(r.randint(8, 14)) for _ in range(1000)}))
    unknown = spark.createDataFrame([(word(r.randint(8, 14)), 1) for _ in range(100_000)], "value string, n_rows long")
    valid = words_.select(F.col("value").alias("suggestion"))
    per_value = findings.candidates(unknown, valid).groupBy("value").count()
    assert per_value.agg(F.avg("count")).first()[0] < 60 and per_value.agg(F.max("count")).first()[0] < 250  # of 1000 words


def world(spark):
    """Rows and points around the date line, the poles and a crowded place."""
    r = random.Random(3)
    spots = [(10.0, 179.999), (-20.0, -180.0), (89.9, 40.0), (90.0, 0.0), (-89.95, -100.0), (0.0, 0.0), (41.88, -87.63)]
    rows_ = [(90.0, -170.0), (-90.0, 10.0), (10.0, 180.0), (10.0, -180.0)]
    for lat, lon in spots:
        for _ in range(60):
            a = max(-90.0, min(90.0, lat + r.uniform(-0.05, 0.05)))
            o = lon + r.uniform(-0.05, 0.05) * (1 if abs(lat) < 80 else 2000)
            rows_.append((a, (o + 180) % 360 - 180))
    rows_ += [(41.88 + r.gauss(0, 1e-4), -87.63 + r.gauss(0, 1e-4)) for _ in range(150)] + [(41.8801, -87.6301)] * 90
    df = table(spark, *({"id": i, "latitude": a, "longitude": o} for i, (a, o) in enumerate(rows_)), {"id": 9999, "latitude": 1.0, "longitude": None})
    asked = [(i, a, o, m) for i, (a, o, m) in enumerate((a, o, m) for a, o in spots for m in (50.0, 400.0, 3000.0, 12000.0))] + [(900, 10.0, -179.999, 500.0), (901, 0.0, 0.0, 15_000_000.0)]
    return df, spark.createDataFrame(asked, "point_id long, lat double, lon double, radius double")


def true_pairs(df, points):
    pairs = df.crossJoin(points).where(geo.distance_m(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon")) <= F.col("radius"))
    return {(r.point_id, r.id) for r in pairs.select("point_id", "id").collect()}


@pytest.mark.parametrize("load,deepest", [(100_000, 12), (20, 12), (20, 2)])
def test_radius_join_around_the_world_and_in_crowds(spark, monkeypatch, load, deepest):
    monkeypatch.setattr(radius, "LOAD", load)
    monkeypatch.setattr(radius, "DEEPEST", deepest)
    df, points = world(spark)
    points = points.where("radius < 1000000") if load < 1000 else points
    found = [(r.point_id, r.id) for r in radius.radius_join(df, points).select("point_id", "id").collect()]
    assert len(found) == len(set(found)) and set(found) == true_pairs(df, points)
    rows_, cells = radius.assigned(df, points)
    loads = rows_.groupBy(*radius.CELL, "salt").count()
    assert loads.agg(F.max("count")).first()[0] <= load
    assert load > 1000 or rows_.agg(F.max("depth")).first()[0] > 1


@pytest.mark.parametrize("listed,share", [(1000, 5_000_000), (3, 50)])
def test_radius_join_meets_distinct_places_only(spark, monkeypatch, listed, share):
    monkeypatch.setattr(radius, "LISTED", listed, raising=False)
    monkeypatch.setattr(radius, "SHARE", share, raising=False)
    df, points = crowds(spark)
    met, real = [], radius.assigned
    monkeypatch.setattr(radius, "assigned", lambda df, points: met.append((df.count(), points.count())) or real(df, points))
    found = radius.radius_join(df, points).select("point_id", "id", "distance_m").collect()
    assert len(found) == len({(r.point_id, r.id) for r in found}) == len(true_pairs(df, points))
    assert {(r.point_id, r.id) for r in found} == true_pairs(df, points)
    assert met == [(11, 4)]


def crowds(spark):
    """Rows at 11 places, one of which has most of them, and points with 4 circles."""
    places = [(41.88, -87.63)] * 70 + [(41.88 + i % 10 / 1000, -87.62) for i in range(40)]
    df = table(spark, *({"id": 7 * i % 110, "latitude": a, "longitude": o} for i, (a, o) in enumerate(places)), {"id": 999, "latitude": None})
    asked = [(i, 41.88 + i % 2 / 1000, -87.63 + i // 2 % 2 / 100, 300.0) for i in range(20)]
    return df, spark.createDataFrame(asked, "point_id long, lat double, lon double, radius double")


def test_nearest_join_ranks_by_distinct_places(spark, monkeypatch):
    df, points = crowds(spark)
    met, real = [], radius.assigned
    monkeypatch.setattr(radius, "assigned", lambda df, points: met.append((df.count(), points.count())) or real(df, points))
    away = geo.distance_m(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon"))
    true: dict[int, list] = {}
    for r in df.crossJoin(points).withColumn("away", away).where("away <= radius").orderBy("point_id", "away", "id").collect():
        true.setdefault(r.point_id, []).append(r.id)
    found = radius.nearest_join(df, points, 6).select("point_id", "id", "rank").collect()
    assert {(r.point_id, r.id, r["rank"]) for r in found} == {(p, x, i + 1) for p, ids_ in true.items() for i, x in enumerate(ids_[:6])}
    assert len(found) == 120 and met == [(11, 4)]


def test_within_around_the_world(spark):
    df, points = world(spark)
    true = true_pairs(df, points)
    for p in points.collect():
        assert {(p.point_id, r.id) for r in radius.within(df, p.lat, p.lon, p.radius).select("id").collect()} == {x for x in true if x[0] == p.point_id}


def test_nearest_has_a_cap(spark, base):
    assert len(radius.nearest(base, 41.8, -87.6, 50).collect()) == 4
    for k in (0, 51):
        with pytest.raises(ValueError):
            radius.nearest(base, 41.8, -87.6, k)


def test_no_distance_without_coordinates(base):
    found = {r.id: r.d for r in base.select("id", geo.distance_m(F.col("latitude"), F.col("longitude"), F.lit(41.8), F.lit(-87.6)).alias("d")).collect()}
    assert found[4] is None and all(d is not None for i, d in found.items() if i != 4)


def test_row_groups_are_capped(spark, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(storage, "ROWS_PER_GROUP", 300)
    root = storage.new_folder(spark, "t")
    storage.write_incidents(table(spark, {"id": 1}).withColumn("id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(2000).cast("long")))), root)
    groups = [f.metadata.row_group(i).num_rows for f in map(pq.ParquetFile, (x.removeprefix("file:") for x in spark.read.parquet(root).inputFiles())) for i in range(f.metadata.num_row_groups)]
    assert sum(groups) == 2000 and max(groups) <= 300


def test_the_compact_record_has_the_two_taxonomies(base):
    assert rows.projected(base).columns == [c for c in INCIDENTS.names if c not in ("iucr", "primary_type", "fbi_code", "x_coordinate", "y_coordinate", "updated_on")]
    assert len(rows.projected(base).columns) == 16 and rows.projected(base, full=True).columns == INCIDENTS.names


@pytest.mark.parametrize("start,end", [((2024, 1, 5), (2025, 3, 1)), ((2024, 1, 31), (2024, 2, 1)), ((2024, 1, 2), (2024, 1, 30)), ((2024, 1, 1), (2024, 2, 1)), ((2024, 1, 31), (2024, 2, 29)), ((2023, 12, 31), (2025, 3, 31))])
def test_ragged_spans_equal_the_scan(base, start, end):
    request = A.Request(date(*start), date(*end), "month", "source", "ward")
    scan = {tuple(r) for r in A.aggregate(base, {}, request).collect()}
    assert scan == {tuple(r) for r in A.aggregate(base, {"ward": rollups.rollup(base, "ward")}, request).collect()}
    months, edges = request.parts()
    days = sum((b - a).days + 1 for a, b in edges)
    assert days <= 61 and (months is None or months[0].day == 1)


def test_gap_ranges_name_every_empty_period_once(spark):
    df = table(spark, *({"id": i, "date": datetime(2020 + m // 12, m % 12 + 1, 3), "primary_type_canonical": c, "ward": w} for i, (m, c, w) in enumerate([(0, "A", 1), (1, "A", 1), (5, "A", 1), (11, "A", 2), (3, "B", 2), (3, "B", 2), (20, "C", 3), (4, "C", None)])))
    words_ = spark.createDataFrame([("category", "source", c) for c in "ABC"] + [("ward", None, str(w)) for w in (1, 2, 3)], "dimension string, taxonomy string, value string")
    for grain in ("month", "quarter", "year"):
        args = rollups.rollup(df, "ward"), words_, date(2020, 2, 1), date(2021, 6, 30), grain, "ward"
        every = [tuple(r) for r in findings.gaps(*args).collect()]
        start = {"month": lambda d: d.replace(day=1), "quarter": lambda d: d.replace(day=1, month=(d.month - 1) // 3 * 3 + 1), "year": lambda d: d.replace(day=1, month=1)}[grain]
        step = {"month": 1, "quarter": 3, "year": 12}[grain]
        periods, p = [], start(date(2020, 2, 1))
        while p <= date(2021, 6, 30):
            periods.append(p)
            p = date(p.year + (p.month - 1 + step) // 12, (p.month - 1 + step) % 12 + 1, 1)
        have = {(start(r.date.date()), r.primary_type_canonical, str(r.ward)) for r in df.collect()}
        assert len(every) == len(set(every)) and set(every) == {(p, c, w) for p in periods for c in "ABC" for w in "123"} - have
        plan = findings.gap_ranges(*args)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_replayed_batch_adds_nothing(spark, base, monkeypatch):
    root, landing, report = (storage.new_folder(spark, n) for n in ("t", "landing", "report"))
    storage.write_incidents(base.fillna("0110", ["iucr"]), root)
    new = table(spark, {"id": 1, "updated_on": datetime(2026, 1, 1)}, {"id": 50, "date": datetime(1990, 1, 1)}, {"id": 51, "date": None}, {"id": 52, "date": datetime(1990, 1, 1)})
    new.drop("primary_type_canonical", "stable_category").select(*(F.col(c).cast("string") for c in RAW.names)).coalesce(1).write.json(landing)
    codes = spark.createDataFrame([], "iucr string, primary_description string, stable_category string")
    calls = []
    real = sync.merge_into
    monkeypatch.setattr(sync, "merge_into", lambda *a: calls.append(1) or real(*a))
    for _ in range(3):  # other checkpoints number the same batch alike
        sync.sync_stream(spark, landing, root, codes, storage.new_folder(spark, "stream"), report=report).awaitTermination()
        assert {(r.year, r.status): r.n_rows for r in sync.batches(spark, report).collect()} == {(2025, "applied"): 1, (1990, "skipped"): 2, (None, "rejected"): 1}
        assert sorted((r.id, r.status) for r in sync.unmerged(spark, report).collect()) == [(50, "skipped"), (51, "rejected"), (52, "skipped")]
    assert len(calls) == 1


def read_often(spark, df):
    """The same rows, and a count of how many of them have been read."""
    n = spark.sparkContext.accumulator(0)
    return spark.createDataFrame(df.rdd.map(lambda r: (n.add(1), tuple(r))[1]), df.schema), n


def test_a_sync_reads_feed_and_codes_once(spark, base):
    root, state = storage.new_folder(spark, "t"), storage.new_folder(spark, "state")
    storage.write_incidents(base, root)
    text = table(spark, {"id": 1, "updated_on": datetime(2026, 1, 1)}, {"id": 60, "updated_on": datetime(2026, 1, 2)}).select(*(F.col(c).cast("string") for c in RAW.names))
    feed, n_rows = read_often(spark, text)
    codes, n_codes = read_often(spark, spark.createDataFrame([("0486", "BATTERY", " ASSAULT "), ("0810", "THEFT", None)], "iucr string, primary_description string, stable_category string"))
    merge.sync(spark, root, feed, codes, state)
    assert (n_rows.value, n_codes.value) == (2, 2)
    assert {(r.id, r.stable_category) for r in storage.read_incidents(spark, root).where("id IN (1, 60)").collect()} == {(1, "ASSAULT"), (60, "ASSAULT")}


def test_a_stream_derives_its_codes_once(spark, base):
    root, landing = (storage.new_folder(spark, n) for n in ("t", "landing"))
    storage.write_incidents(base.fillna("0110", ["iucr"]), root)
    new = table(spark, *({"id": i, "updated_on": datetime(2026, 1, 1)} for i in range(1, 5)))
    new.select(*(F.col(c).cast("string") for c in RAW.names)).repartition(2, "id").write.json(landing)
    codes, n = read_often(spark, spark.createDataFrame([("0486", "BATTERY", " ASSAULT ")], "iucr string, primary_description string, stable_category string"))
    sync.sync_stream(spark, landing, root, codes, storage.new_folder(spark, "stream"), files_per_batch=1).awaitTermination()
    assert n.value == 1
    assert {(r.id, r.stable_category) for r in storage.read_incidents(spark, root).where("id < 5").collect()} == {(i, "ASSAULT") for i in range(1, 5)}


@pytest.mark.parametrize("size,every", [(7, 20), (20, 20), (50, 20)])
def test_stored_pages_are_those_of_the_whole_order(spark, size, every):
    root, path = storage.new_folder(spark, "t"), storage.new_folder(spark, "pages")
    storage.write_incidents(table(spark, *({"id": i, "date": datetime(2015 + i % 4, 1 + i % 12, 1 + i % 5)} for i in range(230))), root)
    df = storage.read_incidents(spark, root)
    rows.store_pages(df, path, {"a": 1}, every)
    order = [r.id for r in df.orderBy(F.desc("date"), F.desc("id")).select("id").collect()]
    for page in (0, 1, 5, 230 // size, 230 // size + 1, 1000):
        found = rows.stored_page(df, path, {"a": 1}, page, size)
        assert [r.id for r in found.collect()] == order[page * size : (page + 1) * size]
    plan = rows.stored_page(df, path, {"a": 1}, 3, 7)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "LessThanOrEqual(date" in plan and "GreaterThanOrEqual(date" in plan
    with pytest.raises(ValueError):
        rows.stored_page(df, path, {"a": 2}, 0)


def test_a_circle_is_read_from_few_files_of_a_table_by_place(spark):
    root = storage.new_folder(spark, "t")
    df = table(spark, {"id": 1}).select(*(c for c in INCIDENTS.names if c not in ("id", "latitude", "longitude")), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3999).cast("long"))).alias("id"))
    df = df.withColumns({"latitude": 41.6 + (F.col("id") * 37 % 4001) / 10000, "longitude": -87.9 + (F.col("id") * 101 % 4003) / 10000})
    storage.write_by_place(df.coalesce(1), root, rows_per_file=50)
    stored_ = storage.read_incidents(spark, root)
    n_files = len(stored_.inputFiles())
    for lat, lon, r in ((41.8, -87.7, 800.0), (41.61, -87.89, 2000.0), (0.0, 0.0, 1000.0)):
        near = radius.within(stored_, lat, lon, r)
        assert {x.id for x in near.select("id").collect()} == {x.id for x in radius.within(df, lat, lon, r).select("id").collect()}
        low = stored_.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.min("place").alias("a"), F.max("place").alias("b")).collect()
        met = sum(any(x.a <= b and a <= x.b for a, b in radius.circle(lat, lon, r)) for x in low)
        assert met <= n_files / 4  # files whose range of places a stretch meets; the scan skips the others by their statistics
        spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
        plan = radius.within(stored_, lat, lon, r)._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.maxMetadataStringLength")
        assert "GreaterThanOrEqual(place" in plan.split("PushedFilters: ")[1]


def test_stretches_hold_their_rectangle(spark):
    r = random.Random(2)
    for _ in range(40):
        lat, lon, m = r.uniform(-90, 90), r.uniform(-180, 180), 10 ** r.uniform(1, 6.5)
        found = radius.circle(lat, lon, m)
        assert len(found) <= 32 and all(a <= b for a, b in found)
        near = [(max(-90.0, min(90.0, lat + r.gauss(0, m / 1e5))), (lon + r.gauss(0, m / 1e5) + 180) % 360 - 180) for _ in range(200)]
        df = spark.createDataFrame(near, "latitude double, longitude double")
        inside = df.where(geo.distance_m(F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lon)) <= m)
        told = inside.withColumn("p", curve.place(F.col("latitude"), F.col("longitude"))).select(curve.in_stretches("p", found).alias("x"))
        assert all(x.x for x in told.collect())
