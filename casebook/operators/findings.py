"""Data-quality findings on keys, values and gaps. (Edges of periods are in aggregate,
drift in drift, places without coordinates in radius, totals in rollups.)"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.functions.columns import period
from casebook.sources.schema import GEOGRAPHIES, TAXONOMIES

#: Similarity from which a valid value is suggested for an unknown one.
SIMILAR = 0.6


def unknown_values(rows: DataFrame, words: DataFrame, dimension: str, column: str, taxonomy: str | None = None) -> DataFrame:
    """value and n_rows: what a column holds and the vocabulary does not."""
    valid = words.where((F.col("dimension") == dimension) & F.col("taxonomy").eqNullSafe(F.lit(taxonomy))).select("value")
    held = rows.select(F.col(column).cast("string").alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n_rows"))
    return held.join(valid, "value", "left_anti")


def _edits(size: Column, length: Column) -> Column:
    """Edits that leave a value of `size` characters and a word of `length` similar enough."""
    return F.floor(F.greatest(size, length) * (1 - SIMILAR)).cast("int")


def _pieces(words: DataFrame, edits: DataFrame) -> DataFrame:
    """Each word cut into one piece more than there are edits, the last ones a character longer, for
    every number of edits asked for its length; so one piece is left whole. A word that has not
    as many characters has one empty piece, which all values asking for its length meet."""
    rows = words.withColumn("length", F.length("suggestion")).join(edits, "length")
    n = F.col("edits") + 1
    short, longer = F.floor(F.col("length") / n).cast("int"), F.col("length") % n
    size = lambda i: short + F.when(i >= n - longer, 1).otherwise(0)
    start = lambda i: i * short + F.greatest(i - (n - longer), F.lit(0))
    cut_ = F.transform(F.sequence(F.lit(0), F.col("edits")), lambda i: F.struct(i.alias("i"), F.col("suggestion").substr(start(i) + 1, size(i)).alias("piece")))
    none = F.array(F.struct(F.lit(0).alias("i"), F.lit("").alias("piece")))
    return rows.select("suggestion", "length", "edits", F.explode(F.when(F.col("edits") < F.col("length"), cut_).otherwise(none)).alias("p")).select("suggestion", "length", "edits", "p.*")


def _probes(values: DataFrame) -> DataFrame:
    """Where a value may hold the pieces of words: i-th piece, shifted by as many edits as can lie
    before it, or behind it, and no more."""
    n = F.col("edits") + 1
    short, longer = F.floor(F.col("length") / n).cast("int"), F.col("length") % n
    each = values.withColumn("i", F.explode(F.when(F.col("edits") < F.col("length"), F.sequence(F.lit(0), F.col("edits"))).otherwise(F.array(F.lit(0)))))
    each = each.withColumn("size", F.when(F.col("edits") < F.col("length"), short + F.when(F.col("i") >= n - longer, 1).otherwise(0)).otherwise(0))
    each = each.withColumn("start", F.col("i") * short + F.greatest(F.col("i") - (n - longer), F.lit(0)))
    gap, behind = F.col("trimmed") - F.col("length"), F.col("edits") - F.col("i")
    low = F.greatest(F.lit(0), F.col("start") - F.col("i"), F.col("start") + gap - behind)
    high = F.least(F.col("trimmed") - F.col("size"), F.col("start") + F.col("i"), F.col("start") + gap + behind)
    ways = F.when(F.col("size") == 0, F.array(F.lit(0))).when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    each = each.withColumn("at", F.explode(ways)).withColumn("piece", F.col("key").substr(F.col("at") + 1, F.col("size")))
    return each.select("value", "key", "length", "edits", "i", "piece").distinct()


def candidates(unknown: DataFrame, words: DataFrame) -> DataFrame:
    """value, key (as it is compared) and suggestion of all pairs that may be similar: of a word cut
    into more pieces than there are edits, the value holds one whole, near its place. An
    equi-join on length, edits, number and text of the pieces."""
    size, key = F.length("value"), F.upper(F.trim("value"))
    values = unknown.select("value", key.alias("key"), F.length(key).alias("trimmed"), size.alias("size")).distinct()
    lengths = words.select(F.length("suggestion").alias("length")).distinct()
    ranges = values.select("size", "trimmed").distinct()
    most = F.greatest(F.col("size"), F.ceil(F.col("trimmed") / SIMILAR)).cast("int")
    ranges = ranges.withColumn("length", F.explode(F.sequence(F.lit(0), most)))
    ranges = ranges.withColumn("edits", _edits(F.col("size"), F.col("length"))).where(F.abs(F.col("trimmed") - F.col("length")) <= F.col("edits")).join(lengths, "length", "left_semi")
    pieces = _pieces(words, ranges.select("length", "edits").distinct())
    probes = _probes(values.join(ranges, ["size", "trimmed"]))
    return probes.join(pieces, ["length", "edits", "i", "piece"]).select("value", "key", "suggestion").distinct()


def with_suggestions(unknown: DataFrame, words: DataFrame, dimension: str, taxonomy: str | None = None) -> DataFrame:
    """Adds the most similar valid value, if one is similar enough."""
    valid = words.where((F.col("dimension") == dimension) & F.col("taxonomy").eqNullSafe(F.lit(taxonomy))).select(F.col("value").alias("suggestion"))
    longest = F.greatest(F.length("value"), F.length("suggestion"))
    apart = F.levenshtein("key", "suggestion")
    pairs = candidates(unknown, valid).where(apart <= longest * (1 - SIMILAR)).withColumn("likeness", F.round(1 - apart / longest, 6))
    best = pairs.groupBy("value").agg(F.max(F.struct("likeness", "suggestion")).alias("b")).select("value", F.col("b.suggestion").alias("suggestion"), F.col("b.likeness").alias("likeness"))
    return unknown.join(best, "value", "left")


def violations(df: DataFrame) -> DataFrame:
    """One row: repeated ids, and rows without date, code or category, all of which must be 0 to store the table."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in ("date", "iucr", "primary_type", *TAXONOMIES.values())]
    return df.agg((F.count("id") - F.count_distinct("id")).alias("repeated_ids"), *nulls)


def checked(df: DataFrame) -> DataFrame:
    """The table itself, if it violates nothing."""
    found = {k: v for k, v in violations(df).first().asDict().items() if v}
    if found:
        raise ValueError(f"the table cannot be stored: {found}")
    return df


def gap_ranges(rollup: DataFrame, words: DataFrame, start: date, end: date, grain: str, level: str, taxonomy: str = "source") -> DataFrame:
    """category, value of a geography, first_period, last_period and n_periods: the longest ranges of
    periods in which valid filters match nothing. A pair that occurs has its gaps between the
    periods before and after; the values that a category never meets are all values less those
    it meets, and have one range."""
    months = {"month": 1, "quarter": 3, "year": 12}[grain]
    geography = GEOGRAPHIES[level]
    began, number = F.trunc(F.lit(start), grain), lambda day: F.floor(F.months_between(day, began) / months).cast("int")
    last = F.floor(F.months_between(F.trunc(F.lit(end), grain), began) / months).cast("int")
    categories = words.where((F.col("dimension") == "category") & (F.col("taxonomy") == taxonomy)).select(F.col("value").alias("category"))
    values = words.where(F.col("dimension") == level).agg(F.collect_set("value")).scalar()  # a vocabulary, not rows
    have = rollup.select(F.col(TAXONOMIES[taxonomy]).alias("category"), F.col(geography).cast("string").alias(geography), number(period(F.col("month"), grain)).alias("k"))
    have = have.where(F.col(geography).isNotNull() & F.col("k").between(0, last)).join(categories, "category", "left_semi").distinct()
    pair = Window.partitionBy("category", geography).orderBy("k")
    before = F.coalesce(F.lag("k").over(pair), F.lit(-1)) + 1
    between = have.select("category", geography, before.alias("a"), (F.col("k") - 1).alias("b"))
    behind = have.groupBy("category", geography).agg((F.max("k") + 1).alias("a")).withColumn("b", last)
    met = have.groupBy("category").agg(F.collect_set(geography).alias("met"))
    never = categories.join(met, "category", "left").select("category", F.explode(F.array_except(values, F.coalesce("met", F.array().cast("array<string>")))).alias(geography))
    never = never.withColumns({"a": F.lit(0), "b": last})
    found = between.unionByName(behind).unionByName(never).where("a <= b")
    day = lambda k: F.add_months(began, F.col(k) * months)
    return found.select("category", geography, day("a").alias("first_period"), day("b").alias("last_period"), (F.col("b") - F.col("a") + 1).alias("n_periods"))


def gaps(rollup: DataFrame, words: DataFrame, start: date, end: date, grain: str, level: str, taxonomy: str = "source") -> DataFrame:
    """period, category and value of a geography for which valid filters match nothing: every period of `gap_ranges`."""
    step = {"month": "1 MONTH", "quarter": "3 MONTH", "year": "1 YEAR"}[grain]
    found = gap_ranges(rollup, words, start, end, grain, level, taxonomy)
    return found.select(F.explode(F.sequence("first_period", "last_period", F.expr(f"INTERVAL {step}"))).alias("period"), "category", GEOGRAPHIES[level])
